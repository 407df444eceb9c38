"""Registered queries: frames x LUs from ``part``, negative sampling,
splits, and multiple-choice examples from ``orders`` + ``lineitem``.

Choice rows (the CSV shape): id = o_orderkey; sentence names
the order; the predicate word ``placed`` is word 3; the choices are the
order's lines in line order: frame name ``Ship_<flag><status>_<n>``,
definition = a sentence about the line, ``l_quantity * 3`` words long
(some are cut at 100 words); label = o_orderkey % n_choice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed
from ..operators import choices, sampling
from ..session import scratch_path
from .choice_queries import LINE_ORDER
from .context import table

MAX_LENGTH = 64
MAX_CHOICE = 15

CHOICE_SCHEMA = ("id BIGINT, sentence STRING, lu_name STRING, lu_head_position INT, lu_defs STRING, "
                 "frame_names STRING, frame_defs STRING, label INT")


def part_frame_lus(spark: SparkSession, sf: str) -> DataFrame:
    """(frame_name, lu, lu_def) from ``part``."""
    p = table(spark, sf, "part")
    pos = F.element_at(F.array(*[F.lit(x) for x in fixed.PART_POS]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select(F.concat_ws("/", "p_type", F.col("p_size").cast("string")).alias("frame_name"),
                    F.concat_ws(".", "p_name", pos).alias("lu"), F.col("p_brand").alias("lu_def"))


def frame_defs_table(spark, sf):
    return sampling.frame_lu_defs(part_frame_lus(spark, sf))


def q_frame_lu_defs(spark, sf):
    return frame_defs_table(spark, sf).select("frame_name", "lu", "lu_def", "lu_no_pos")


def frame_records(spark, sf) -> DataFrame:
    """One record per frame: FE map (FE_<brand> -> definition; the
    brand vocabulary bounds it), definition, FE count, LU count."""
    p = table(spark, sf, "part").select(F.concat_ws("/", "p_type", F.col("p_size").cast("string")).alias("name"),
                                        "p_brand", "p_name")
    fes = (p.select("name", F.concat(F.lit("FE_"), F.regexp_replace("p_brand", "#", "")).alias("fe"),
                    F.concat(F.lit("Brand "), F.col("p_brand")).alias("fe_def")).distinct()
           .groupBy("name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("fe", "fe_def")))).alias("fes")))
    lus = frame_defs_table(spark, sf).groupBy(F.col("frame_name").alias("name")).agg(F.count(F.lit(1)).alias("n_lus"))
    return (fes.join(lus, "name")
            .select("name", "fes", F.concat(F.lit("Frame "), F.col("name")).alias("definition"),
                    F.size("fes").alias("num_elements"), "n_lus"))


def q_frame_info(spark, sf):
    """Frame records, sorted by name."""
    r = frame_records(spark, sf).orderBy("name")
    return r.select("name", F.col("num_elements").cast("int").alias("num_elements"), "n_lus",
                    F.array_join(F.sort_array(F.map_keys("fes")), "|").alias("fe_names"))


def q_sample_negatives(spark, sf):
    """O3: up to 4 negative LUs per (frame, LU) of the part lexicon."""
    d = frame_defs_table(spark, sf)
    s = sampling.sample_negatives(d.select("frame_name", "lu"), d)
    return s.select("frame_name", "lu", "neg_frame", "neg_lu", F.col("tier").cast("int").alias("tier"),
                    F.col("rank").cast("int").alias("rank"))


def q_split_files(spark, sf):
    """Documents per source and split."""
    docs = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    return sampling.assign_split(docs, "source", fixed.DEV_SOURCES, fixed.TEST_SOURCES).select("source", "split", "n_docs")


def choice_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Choice rows in the CSV shape (one per order)."""
    o = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem")

    def name(c):
        return F.concat(F.lit("Ship_"), c["l_returnflag"], c["l_linestatus"], F.lit("_"), c["l_linenumber"].cast("string"))

    def defn(c):
        return F.concat_ws(" ", F.lit("Part"), c["l_partkey"].cast("string"), F.lit("from supplier"), c["l_suppkey"].cast("string"),
                           F.when(c["l_linenumber"] == 3, F.lit("ships\nlater")).otherwise(F.lit("ships")),
                           F.trim(F.repeat(F.lit("Word "), (c["l_quantity"] * 3).cast("int"))))

    def ludef(c):
        return F.concat(F.lit("To place part "), c["l_partkey"].cast("string"))

    per = (li.select("l_orderkey", F.struct(*LINE_ORDER).alias("c"))
           .groupBy("l_orderkey").agg(F.sort_array(F.collect_list("c")).alias("cs")))
    # the texts follow from the lines, so they are made where the lines are gathered and sorted, not before
    per = per.select("l_orderkey", F.size("cs").alias("n"),
                     F.array_join(F.transform("cs", name), fixed.CHOICE_SEP).alias("frame_names"),
                     F.array_join(F.transform("cs", defn), fixed.CHOICE_SEP).alias("frame_defs"),
                     F.array_join(F.transform("cs", ludef), fixed.CHOICE_SEP).alias("lu_defs"))
    j = o.join(per, o["o_orderkey"] == per["l_orderkey"])
    return j.select(F.col("o_orderkey").alias("id"),
                    F.concat_ws(" ", F.lit("Customer"), F.col("o_custkey").cast("string"), F.lit("placed"),
                                F.lit("an"), F.lower("o_orderpriority"), F.lit("order")).alias("sentence"),
                    F.concat(F.lit("place."), F.element_at(F.array(*[F.lit(x) for x in fixed.PART_POS]),
                                                           (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("lu_name"),
                    F.lit(3).alias("lu_head_position"), "lu_defs", "frame_names", "frame_defs",
                    (F.col("o_orderkey") % F.col("n")).cast("int").alias("label"))


def q_choice_examples(spark, sf):
    """One row per (example, choice)."""
    c = choices.explode_choices(choice_rows(spark, sf))
    return c.select("example_id", F.col("choice_idx").cast("int").alias("choice_idx"),
                    F.md5(F.concat_ws("|", "text_a", "text_b")).alias("text_md5"),
                    F.col("n_choice").cast("int").alias("n_choice"),
                    F.col("predicate_position").cast("int").alias("position"), "label")


def q_choice_text(spark, sf):
    """Lower-cased pair texts, ending cut at 100 words."""
    c = choices.choice_text(choices.explode_choices(choice_rows(spark, sf)))
    return c.select("example_id", F.col("choice_idx").cast("int").alias("choice_idx"), "text_a", "text_b")


def _features(spark, sf):
    c = choices.choice_text(choices.explode_choices(choice_rows(spark, sf)))
    return choices.features(c, MAX_LENGTH)


def q_choice_features(spark, sf):
    """Real length, crop flag, per-choice and per-example
    predicate position, choices kept."""
    f = choices.with_positions(_features(spark, sf), MAX_CHOICE)
    return f.select(
        "example_id", F.col("choice_idx").cast("int").alias("choice_idx"), F.col("n_real").cast("int").alias("n_real"),
        "cropped", F.col("choice_position").cast("int").alias("choice_position"),
        F.col("position").cast("int").alias("position"), F.col("n_kept").cast("int").alias("n_kept"))


def q_choice_crop_count(spark, sf):
    """Number of cropped pairs."""
    return _features(spark, sf).agg(F.count_if("cropped").alias("n_cropped"), F.count(F.lit(1)).alias("n_pairs"))


def q_eval_single_choice(spark, sf):
    """Single-frame examples and their LU POS."""
    return choices.single_choice(choice_rows(spark, sf))


def q_choice_csv(spark, sf):
    """Choice rows written as CSV (header, quoted, multi-line
    fields) to the shared stage folder and read back with an explicit
    schema."""
    path = scratch_path(spark, f"choice_csv/{uuid.uuid4().hex}")
    choice_rows(spark, sf).write.mode("overwrite").option("header", True).option("quote", '"') \
        .option("escape", '"').csv(path)
    back = (spark.read.schema(CHOICE_SCHEMA).option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').option("maxCharsPerColumn", -1).csv(path))
    check_header(spark, path)
    return back.select("id", F.size(choices.split_choices(F.col("frame_defs"))).alias("n_choice"), "label")


def check_header(spark, path: str, mode: str = "train") -> None:
    """A training file's header must end in ``label``."""
    header = spark.read.option("header", True).csv(path).columns
    if mode == "train" and (not header or header[-1] != "label"):
        raise ValueError(f"{path}: the last column of training rows has to be label")


def q_choice_split_read(spark, sf):
    """Choice rows as one CSV table partitioned by split (order status
    F -> train, O -> dev, P -> test); the dev split is read by partition
    pruning."""
    from ..sources import files
    st = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "dev")
                                            .when(F.col("o_orderstatus") == "P", "test").otherwise("train").alias("split"))
    rows = choice_rows(spark, sf).join(st, "id")
    path = scratch_path(spark, f"choice_splits/{uuid.uuid4().hex}")
    files.write_choice_splits(rows, path)
    dev = files.read_choice_csv(spark, path, CHOICE_SCHEMA, "dev")
    return dev.select("id", "split", F.size(choices.split_choices(F.col("frame_defs"))).alias("n_choice"), "label")


def q_choice_nested(spark, sf):
    """Per-example nested choices."""
    n = choices.nest(_features(spark, sf))
    return n.select("example_id", F.size("choices").alias("n"),
                    F.array_join(F.transform("n_real_per_choice", lambda x: x.cast("string")), ",").alias("n_real"))


def _digest(arr):
    """md5 of a matrix of integers, row by row."""
    return F.md5(F.array_join(F.transform(arr, lambda r: F.array_join(r.cast("array<string>"), ",")), ";"))


def _dense(spark, sf, **kw):
    d = choices.dense(_features(spark, sf), MAX_LENGTH, **kw)
    return d.select("example_id", F.col("n_choice").cast("int").alias("n_choice"), F.col("n_kept").cast("int").alias("n_kept"),
                    F.col("position").cast("int").alias("position"), "label", F.size("input_ids").alias("n_rows"),
                    *[_digest(F.col(c)).alias(f"{c}_md5") for c in ("input_ids", "attention_mask", "segment_ids")])


def q_choice_dense(spark, sf):
    """Padded model input, choices cropped to 4."""
    return _dense(spark, sf, max_choice=4)


def q_choice_dense_left(spark, sf):
    """Padded on the left, rows of zeros up to 8 choices."""
    return _dense(spark, sf, max_choice=8, pad_left=True)


def q_choice_questions(spark, sf):
    """P20: the question variant: LU definition and ending of each choice."""
    c = choices.explode_choices(choice_rows(spark, sf), choices.task("ludef_fndef_q")["encode_type"])
    return c.select("example_id", F.col("choice_idx").cast("int").alias("choice_idx"), "question", F.md5("text_b").alias("text_md5"))


def q_choice_splits(spark, sf):
    """All three splits of the partitioned CSV table; the test split
    carries no label."""
    from ..sources import files
    st = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "dev")
                                            .when(F.col("o_orderstatus") == "P", "test").otherwise("train").alias("split"))
    path = scratch_path(spark, f"choice_splits/{uuid.uuid4().hex}")
    files.write_choice_splits(choice_rows(spark, sf).join(st, "id"), path)
    parts = [files.read_choice_csv(spark, path, CHOICE_SCHEMA, s) for s in files.SPLITS]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.select("id", "split", F.size(choices.split_choices(F.col("frame_defs"))).alias("n_choice"), "label")

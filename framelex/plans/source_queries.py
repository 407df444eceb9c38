"""Registered queries for the XML sources, on XML that Spark writes from
the given tables into the shared stage folder (the XML files
are not shipped):

  frames    one ``frame`` per part frame (p_type/p_size): definition with
            escaped markup, FE per brand, lexUnit per LU; plus a
            ``Time_vector`` frame that the reader must skip
  LU index  one ``lu`` per corpus LU (fixture + part)
  full text one ``sentence`` per derived annotation, text with one leading
            blank (offsets count it), a MANUAL set and, for frame
            ``Partitive``, a second non-MANUAL set; Target labels with
            inclusive ends; FE layers of rank 1 and 2
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession, functions as F

from ..sources import xml
from ..session import scratch_path
from .annotation_queries import annotations
from .context import corpus_distinct, corpus_lexicon, table
from .frame_queries import frame_defs_table


def _frames_df(spark, sf):
    p = table(spark, sf, "part").select(F.concat_ws("/", "p_type", F.col("p_size").cast("string")).alias("name"), "p_brand")
    fes = (p.select("name", F.struct(F.concat(F.lit("FE_"), F.regexp_replace("p_brand", "#", "")).alias("_name"),
                                     F.concat(F.lit("<def-root>Brand "), F.col("p_brand"), F.lit("</def-root>")).alias("definition")).alias("fe"))
           .distinct().groupBy("name").agg(F.sort_array(F.collect_list("fe")).alias("FE")))
    lus = (frame_defs_table(spark, sf)
           .select(F.col("frame_name").alias("name"), F.struct(F.col("lu").alias("_name"), F.col("lu_def").alias("definition")).alias("l"))
           .groupBy("name").agg(F.sort_array(F.collect_list("l")).alias("lexUnit")))
    fr = fes.join(lus, "name", "left").select(
        F.col("name").alias("_name"),
        F.concat(F.lit("<def-root>Frame <fen>"), F.col("name"), F.lit("</fen> moves.</def-root>")).alias("definition"),
        "FE", "lexUnit")
    tv = spark.createDataFrame([("Time_vector", "<def-root>Skipped</def-root>", [], [])], xml.FRAME_SCHEMA)
    return fr.unionByName(tv)


def q_src_frame_xml(spark, sf):
    """Frames written as XML and read back."""
    path = scratch_path(spark, f"xml/frames/{uuid.uuid4().hex}")
    xml.write_xml(_frames_df(spark, sf), path, "frame", "frames")
    f = xml.read_frames(spark, path)
    return f.select("name", "definition", F.col("num_elements").cast("int").alias("num_elements"),
                    F.size("lu_definitions").cast("int").alias("n_lus"),
                    F.array_join(F.sort_array(F.map_keys("fes")), "|").alias("fe_names"),
                    F.array_join(F.sort_array(F.map_values("fes")), "|").alias("fe_defs"))


def q_src_lu_index(spark, sf):
    """The LU index written as XML and read back."""
    lus = corpus_lexicon(spark, sf).lus.select(F.col("name").alias("_name"), F.col("frame").alias("_frameName"))
    path = scratch_path(spark, f"xml/luindex/{uuid.uuid4().hex}")
    xml.write_xml(lus, path, "lu", "luIndex")
    return xml.read_lu_index(spark, path)


def _fulltext_sentences(spark, sf):
    """Annotated sentences in the shape of the full-text XML."""
    a = annotations(spark, sf).join(corpus_distinct(spark, sf).select("sent_id", "sentence"), "sent_id")

    def label(name, start, end):
        return F.struct(F.lit(name).alias("_name"), start.cast("int").alias("_start"), end.cast("int").alias("_end"))

    tlabels = F.transform("target_spans", lambda s: label("Target", s["start"] + 1, s["end"]))
    felabels = F.transform("fe_spans", lambda s: label("", s["start"] + 1, s["end"]).withField("_name", s["name"]))
    layer = lambda name, rank, labs: F.struct(F.lit(name).alias("_name"), F.lit(rank).alias("_rank"), labs.alias("label"))
    manual = F.struct(F.lit("MANUAL").alias("_status"), F.col("frame_name").alias("_frameName"),
                      F.col("lu_name").alias("_luName"),
                      F.array(layer("Target", "1", tlabels), layer("FE", "1", felabels),
                              layer("FE", "2", F.array(label("Other", F.lit(1), F.lit(1))))).alias("layer"))
    other = manual.withField("_status", F.lit("UNANN")).withField("_frameName", F.lit("Other"))
    sets = F.when(F.col("frame_name") == "Partitive", F.array(manual, other)).otherwise(F.array(manual))
    return a.select(F.col("ann_id").alias("_ID"), F.concat(F.lit(" "), F.col("sentence")).alias("text"), sets.alias("annotationSet"))


def q_src_fulltext_xml(spark, sf):
    """Full-text annotations written as XML and read back."""
    rows = _fulltext_sentences(spark, sf)
    path = scratch_path(spark, f"xml/fulltext/{uuid.uuid4().hex}")
    xml.write_xml(rows, path, "sentence", "fullTextAnnotation")
    f = xml.read_fulltext(spark, path)
    txt = lambda arr: F.array_join(F.transform(arr, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ";")
    return f.select(F.col("sent_key").alias("ann_id"), F.md5("sentence").alias("sent_id"), "frame_name", "lu_name",
                    txt(F.col("target_spans")).alias("targets"),
                    F.col("target_merged.start").alias("start"), F.col("target_merged.end").alias("end"),
                    F.size("fe_spans").alias("n_fes"))


def q_fulltext_rows(spark, sf):
    """Annotations of the listed files by split. The sentences are dealt
    to files of 16 numbers by id, to more files a number as the session has
    more shuffle partitions; a table lists the files' splits, without the files
    of number 15, which must not be read."""
    rows = _fulltext_sentences(spark, sf)
    number = F.conv(F.substring(F.col("_ID"), 1, 1), 16, 10).cast("int")
    path = scratch_path(spark, f"xml/fulltext_files/{uuid.uuid4().hex}")
    each = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 16)
    # a file holds sentences of one number only
    rows = rows.repartitionById(16 * each, number * each + F.pmod(F.hash("_ID"), F.lit(each)))
    xml.write_xml(rows, path, "sentence", "fullTextAnnotation")
    # what a file holds is known from the file itself, as a corpus' file list is
    listed = (spark.read.format("xml").option("rowTag", "sentence").schema("_ID STRING").load(path)
              .select(F.col("_metadata.file_name").alias("file_name"), number.alias("number")).distinct())
    split = F.when(F.col("number") < 2, "test").when(F.col("number") < 5, "dev").otherwise("train")
    files = listed.groupBy("file_name").agg(F.max("number").alias("number")).where("number < 15").select("file_name", split.alias("split"))
    f = xml.read_fulltext(spark, path, files)
    return f.select(F.col("sent_key").alias("ann_id"), "split", "frame_name", F.size("target_spans").alias("n_targets"))

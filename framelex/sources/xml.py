"""XML sources (S1-S4) with explicit schemas (no inference: a frame with
one ``lexUnit`` would otherwise infer a struct instead of an array).

Definitions are mixed content (escaped markup); they are read as strings
and their tags removed afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import strip_ws

DEF_STRUCT = "struct<_name:string,definition:string>"
FRAME_SCHEMA = f"_name STRING, definition STRING, FE ARRAY<{DEF_STRUCT}>, lexUnit ARRAY<{DEF_STRUCT}>"
LU_SCHEMA = "_name STRING, _frameName STRING"
LABEL = "struct<_name:string,_start:int,_end:int>"
LAYER = f"struct<_name:string,_rank:string,label:array<{LABEL}>>"
ANNSET = f"struct<_status:string,_frameName:string,_luName:string,layer:array<{LAYER}>>"
SENTENCE_SCHEMA = f"_ID STRING, text STRING, annotationSet ARRAY<{ANNSET}>"
SKIP_FRAMES = ["Time_vector"]


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frame records; ``Time_vector`` skipped; nameless FEs and
    LUs skipped; duplicate names: last wins (session map-key policy)."""
    raw = (spark.read.format("xml").option("rowTag", "frame").option("ignoreSurroundingSpaces", False)
           .schema(FRAME_SCHEMA).load(path))
    raw = raw.where(F.col("_name").isNotNull() & ~F.col("_name").isin(SKIP_FRAMES))

    def entries(arr):
        named = F.filter(F.coalesce(arr, F.array().cast(f"array<{DEF_STRUCT}>")), lambda x: x["_name"].isNotNull())
        return F.map_from_entries(F.transform(named, lambda x: F.struct(x["_name"], strip_tags(x["definition"]))))

    return raw.select(F.col("_name").alias("name"), entries(F.col("FE")).alias("fes"),
                      strip_tags(F.col("definition")).alias("definition"),
                      F.size(entries(F.col("FE"))).alias("num_elements"),
                      entries(F.col("lexUnit")).alias("lu_definitions"))


def read_lu_index(spark: SparkSession, path: str) -> DataFrame:
    """(name, frame) of every ``lu`` element."""
    return (spark.read.format("xml").option("rowTag", "lu").schema(LU_SCHEMA).load(path)
            .select(F.col("_name").alias("name"), F.col("_frameName").alias("frame")))


def read_fulltext(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """One row per MANUAL annotation set: stripped sentence
    (spans moved by the stripped prefix), frame and LU ('' when missing),
    half-open target spans (null when none), merged target, FE spans of
    the first rank-1 FE layer (null start/end kept; [] when empty).
    ``files``: a table with the names of the files to read (``file_name``) and
    any further columns, which the rows get (such as the split)."""
    raw = (spark.read.format("xml").option("rowTag", "sentence").option("ignoreSurroundingSpaces", False)
           .schema(SENTENCE_SCHEMA).load(path))
    extra = []
    if files is not None:
        extra = [c for c in files.columns if c != "file_name"]
        raw = raw.select("*", F.col("_metadata.file_name").alias("file_name")).join(files, "file_name")
    lead = F.length(F.regexp_extract("text", r"^\s*", 0))
    s = raw.select("_ID", *extra, strip_ws(F.col("text")).alias("sentence"), lead.alias("shift"),
                   F.explode("annotationSet").alias("a")).where(F.col("a._status") == "MANUAL")
    labels_of = lambda name: F.flatten(F.transform(F.filter(F.coalesce(F.col("a.layer"), F.array().cast(f"array<{LAYER}>")),
                                                            lambda l: l["_name"] == name), lambda l: l["label"]))
    tgt = F.filter(labels_of("Target"), lambda x: x["_name"] == "Target")
    spans = F.transform(tgt, lambda x: F.struct((x["_start"] - F.col("shift")).alias("start"),
                                                (x["_end"] + 1 - F.col("shift")).alias("end")))
    fe_layer = F.element_at(F.filter(F.coalesce(F.col("a.layer"), F.array().cast(f"array<{LAYER}>")),
                                     lambda l: (l["_name"] == "FE") & (l["_rank"] == "1")), 1)
    fes = F.transform(F.coalesce(fe_layer["label"], F.array().cast(f"array<{LABEL}>")),
                      lambda x: F.struct((x["_start"] - F.col("shift")).alias("start"),
                                         (x["_end"] + 1 - F.col("shift")).alias("end"), x["_name"].alias("name")))
    t = F.when(F.size(spans) > 0, spans)
    return s.select(F.col("_ID").alias("sent_key"), *extra, "sentence",
                    F.coalesce(F.col("a._frameName"), F.lit("")).alias("frame_name"),
                    F.coalesce(F.col("a._luName"), F.lit("")).alias("lu_name"),
                    fes.alias("fe_spans"), t.alias("target_spans"),
                    F.when(t.isNotNull(), F.struct(F.array_min(F.transform(t, lambda x: x["start"])).alias("start"),
                                                   F.array_max(F.transform(t, lambda x: x["end"])).alias("end"))
                           ).alias("target_merged"))


def write_xml(df: DataFrame, path: str, row_tag: str, root_tag: str) -> None:
    """XML files, one a partition; packed, as tags are most of what they hold."""
    df.write.mode("overwrite").format("xml").option("compression", "gzip").option("rowTag", row_tag).option("rootTag", root_tag).save(path)

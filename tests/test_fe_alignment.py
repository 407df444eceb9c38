"""fe_rows aligns both spans of a row in one pass over tokens and annotations."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

import __spark_entry__ as E


def test_fe_rows_make_tokens_twice_at_most(spark, tmp_path):
    docs = [(1, "One of the lights is the zebra of the of.", "en", "web", 40), (2, "the and attion of the the.", "en", None, 20)]
    spark.createDataFrame(docs, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG").write.parquet(str(tmp_path / "documents.parquet"))
    parts = [(0, "large ring", "Brand#1", "LARGE", 1, 9.0)]
    spark.createDataFrame(parts, "p_partkey LONG, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE").write.parquet(str(tmp_path / "part.parquet"))
    df = E.queries()["fe_rows"](spark, str(tmp_path))
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain()
    # once for the annotations, once for the tokens that they are aligned to
    assert buf.getvalue().count("ReadSchema: struct<text:string>") == 2
    rows = df.collect()
    of = [r for r in rows if (r.start, r.end, r.t_first, r.t_last) == (0, 3, 1, 1)]
    # One before of, the before and
    assert [(r.fe_name, r.first, r.last) for r in of] == [("Agent", 0, 0)] * 2
    assert {r.fe_name for r in rows} == {"Agent", "Theme"}
    assert all(r.first is not None and r.t_first is not None for r in rows)
    assert df.groupBy("ann_id", "fe_name").count().where(F.col("count") > 1).isEmpty()

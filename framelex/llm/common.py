"""Helpers shared by the operators: tables, lineage cuts, word patterns."""

from __future__ import annotations

import gc
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path

#: A word: a run of anything but the ASCII blanks. ``bytes.split()`` cuts a
#: UTF-8 text at exactly the same places.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package when it was found through the
    driver's ``sys.path`` alone (a no-op where it is installed)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


_MEMORY: dict = {}


def remembered(key, make):
    """What a Python worker keeps over tasks for one operator. Workers are
    reused by all stages of a job, so only the latest operator's is held."""
    if key not in _MEMORY:
        _MEMORY.clear()
        gc.collect()
        _MEMORY[key] = make()
    return _MEMORY[key]


def texts_of(column, rows: int = 512):
    """The texts of an Arrow column as bytes (or None), few at a time."""
    import pyarrow as pa

    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).cast(pa.binary()).to_pylist()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends
    there, a lost executor costs a reread, and the work above runs once."""
    path = scratch_path(df.sparkSession, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished stages: it does
    so once the driver has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Deletes tables of :func:`cut` that nothing will read again."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t._cut_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    for t in tables[:1]:
        release(t.sparkSession)


def hidden(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` under column names that no operator uses, and the new name of
    each column, in order: whatever a caller's columns are called, they meet
    none of an operator's own."""
    names = {c: f"__in{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def shown(df: DataFrame, names: dict[str, str], *added: Column | str) -> DataFrame:
    """The caller's columns under their own names, then the results ``added``
    (names or aliased columns); results replace columns of the same name."""
    results = df.select(*added).columns
    taken = {c.lower() for c in results}
    kept = [c for c in names if c.lower() not in taken]
    # renamed after the results are computed, so that those see no caller's name
    return df.select(*[names[c] for c in kept], *added).toDF(*kept, *results)


def bucket_of(*cols: Column | str, n: int) -> Column:
    """Bucket 0..n-1 from the columns' content (nulls allowed)."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def prefix_sums(rows: DataFrame, group: list[str], bucket: str, order: list[Column | str],
                size: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``size`` over the group's rows that come
    before the row in (bucket, order).

    A group is never one task: running sums are taken inside (group, bucket)
    and the buckets' totals, a small partially aggregated table, give each
    bucket's start.
    """
    from pyspark.sql import Window

    t = rows.withColumn("_size", size.cast("bigint"))
    keys = [*group, bucket]
    totals = t.groupBy(*keys).agg(F.sum("_size").alias("_total"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(k).alias(f"_s_{k}") for k in keys],
                           F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("_run", F.sum("_size").over(inner) - F.col("_size"))
    on = [t[k].eqNullSafe(starts[f"_s_{k}"]) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return (t.join(starts, cond).withColumn(name, (F.col("_start") + F.col("_run")).cast("bigint"))
            .select(*rows.columns, name))

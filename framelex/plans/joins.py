"""Join helpers: broadcast only a side whose size has been checked."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

# A side is broadcast only if its row count is at most this many rows AND
# its estimated bytes fit under the session's broadcast threshold.
DEFAULT_MAX_BROADCAST_ROWS = 2_000_000


def threshold_bytes(spark) -> int:
    """The session's broadcast threshold; 0 when broadcasts are off."""
    v = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    m = re.fullmatch(r"(-?\d+)\s*([kmgt]?)i?b?", str(v).strip().lower())
    if not m:
        return 10 << 20
    return max(0, int(m[1])) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[m[2]]


def broadcast_measured(small: DataFrame, n_bytes: int) -> DataFrame:
    """Broadcast hint for a side whose bytes were measured, if they fit the
    session's threshold; else the join is left to Spark."""
    return F.broadcast(small) if n_bytes <= threshold_bytes(small.sparkSession) else small


def fixed_small(df: DataFrame) -> DataFrame:
    """Broadcast hint for a table whose size is fixed by the code (a
    literal list such as the alias or override table), not by data."""
    return F.broadcast(df)


def broadcast_within(small: DataFrame, n_rows: int, row_bytes: int = 128,
                     max_rows: int | None = None) -> DataFrame:
    """Broadcast hint when a known row bound (computed once, e.g. when the
    lexicon is compiled) fits; no extra job. Beyond it the side is left to
    Spark's own choice (shuffle join under AQE)."""
    max_rows = DEFAULT_MAX_BROADCAST_ROWS if max_rows is None else max_rows
    if n_rows <= max_rows and n_rows * row_bytes <= threshold_bytes(small.sparkSession):
        return F.broadcast(small)
    return small

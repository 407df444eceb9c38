"""framelex: lexicon-driven text analytics as Spark DataFrame jobs.

Every public function takes and returns DataFrames (or Columns) so steps
compose with ``df.transform``; nothing is collected to the driver except
small scalars (a pattern length, a row count used for a broadcast check).
"""

__all__ = ["session"]

"""Plan checks: no cartesian or nested-loop joins, no Python UDF in the
match path, filters and column pruning reach the scan."""

import io
from contextlib import redirect_stdout

import __spark_entry__ as E

from conftest import SF_SMALL


def plan(df):
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_match_path_plan(spark):
    p = plan(E.queries()["candidates"](spark, SF_SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in p
    assert "BroadcastHashJoin" in p
    # column pruning: candidates are per sentence, so only the text is read
    assert "ReadSchema: struct<text:string>" in p


def test_no_cross_joins_anywhere(spark):
    skip = {"stream_tagger", "filter_predictions", "choice_csv", "stage_roundtrip", "feature_cache",
            "src_frame_xml", "src_lu_index", "src_fulltext_xml"}
    bad = []
    for name, q in E.queries().items():
        if name in skip:
            continue
        p = plan(q(spark, SF_SMALL))
        if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p:
            bad.append(name)
    assert bad == []

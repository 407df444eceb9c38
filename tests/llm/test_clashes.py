"""Columns named like an operator's own ones, in every operator that keeps
the caller's columns: same results, and the caller's values stay."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framelex.llm import fingerprint, mixing, packing, registry, sharding, simhash_dedup, substring_dedup, toxicity, url_filter

OWN = ["s", "_size", "_at", "_ends", "_source", "_c", "_quota", "_block", "_spot", "_bucket", "_words", "_order", "_start", "_run", "_total", "_d", "_t",
       "_ld", "_lt", "_covered", "_print", "_id", "_fp", "_stays", "_row", "root", "fp", "_part", "u_host", "u_path", "e_host", "_best", "_cut", "_n",
       "r_host", "r_path", "_group", "_fill", "_length", "parent", "shift", "bin", "fill", "d", "t", "h", "w", "__in0", "__in1", "with space", "dot.ted",
       "_guest", "_to", "_place", "_next0", "o0", "_o0"]
RESULTS = ["host", "path", "rule", "verdict", "score", "kept", "n_words", "n_removed", "copy", "shard", "slot", "copies", "target", "source_size"]


@pytest.fixture(scope="module")
def plain(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"doc {i} " + " ".join(f"w{(i * 7 + j * j) % 97}" for j in range(40)) + (" " + passage if i % 3 == 0 else ""), "ab"[i % 2], 5) for i in range(40)]
    rows += [(50, rows[3][1], "a", 5), (None, None, None, None), (51, "", "b", 0), (51, "", "b", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")


def clashing(df, names):
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in names])


STEPS = {
    "mix": lambda d: mixing.mix(d, shards=4),
    "plan": lambda d: mixing.plan(d, size="n_chars"),
    "slots": lambda d: sharding.slots(sharding.shard(d, "doc_id", 4, grown=5), ["doc_id", "text"]),
    "remove": substring_dedup.remove,
    "substrings": substring_dedup.deduplicate,
    "simhash": simhash_dedup.deduplicate,
    "judge": lambda d: url_filter.judge(d.withColumn("url", F.concat(F.lit("http://a.com/"), "text")),
                                        d.sparkSession.createDataFrame([("com", "/doc", "block")], "host string, path string, verdict string")),
    "score": lambda d: toxicity.score(d, (0.0, {"w1": 1.0})),
    "pack": lambda d: packing.pack(d.withColumn("length", F.lit(3)), capacity=8),
    "with_next": lambda d: fingerprint.with_next(d, ["doc_id", "text"], ["text"], buckets=3, place="place"),
    "stage_copies": lambda d: corpus_pipeline.drop_near_copies(d.sparkSession, d, ""),
    "stage_repeats": lambda d: corpus_pipeline.cut_repeats(d.sparkSession, d, ""),
    "stage_mixing": lambda d: corpus_pipeline.mix_sources(d.sparkSession, d, ""),
}


@pytest.mark.parametrize("step", STEPS)
def test_clashing_columns(plain, step):
    run = STEPS[step]
    keeps = step.startswith("stage") or step in ("simhash", "substrings")
    own = OWN + RESULTS if keeps else OWN
    want = run(plain)
    got = run(clashing(plain, own))
    assert set(got.columns) == set(want.columns) | set(own)
    values = lambda df: sorted(map(repr, df.select(*want.columns).collect()))
    assert values(got) == values(want)
    assert all(row[c] == f"own {c}" for row in got.select(*[F.col(f"`{c}`") for c in own]).collect() for c in own)


@pytest.mark.parametrize("step", [s for s in STEPS if not s.startswith("stage")])
def test_results_replace_columns_of_their_name(plain, step):
    run = STEPS[step]
    want = run(plain)
    added = [c for c in want.columns if c not in plain.columns and c not in ("url", "length", "sequence_id", "offset")]
    if step == "slots":
        added.remove("shard"), added.remove("grown_shard")
    got = run(clashing(plain, added))
    assert sorted(got.columns) == sorted(want.columns)
    values = lambda df: sorted(map(repr, df.select(*want.columns).collect()))
    assert values(got) == values(want)


def test_a_component_in_many_parts(plain, monkeypatch):
    want = sorted(map(repr, simhash_dedup.deduplicate(plain).collect()))
    for parts in (1, 3):
        monkeypatch.setattr(simhash_dedup, "PARTS", parts)
        assert sorted(map(repr, simhash_dedup.deduplicate(plain).collect())) == want


def test_registered_names():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in registry.queries()}

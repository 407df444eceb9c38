from framelex.operators import sampling


def defs(spark):
    rows = []
    for i in range(6):
        rows.append(("F6", f"w{i}.n"))          # tier 1 fills
    for i in range(3):
        rows.append(("F3", f"x{i}.v"))          # needs tier 2
    rows.append(("F3", "y.n"))
    rows.append(("F1", "z.a"))                  # needs tier 3
    rows.append(("F1", "q.prep"))               # POS unknown elsewhere -> tier 4
    rows.append(("F9", "pr.pron"))              # ends with "n"
    return spark.createDataFrame(rows, "frame_name STRING, lu STRING")


def test_tiers(spark):
    d = defs(spark)
    s = sampling.sample_negatives(d, d.withColumn("lu_def", d.lu), k=4).collect()
    by = {}
    for r in s:
        by.setdefault((r.frame_name, r.lu), []).append(r)
    for (f, lu), rs in by.items():
        assert len(rs) == 4, (f, lu)
        assert all(r.neg_lu != lu for r in rs)
        assert [r.rank for r in sorted(rs, key=lambda r: r.rank)] == [0, 1, 2, 3]
        tiers = [r.tier for r in sorted(rs, key=lambda r: r.rank)]
        assert tiers == sorted(tiers)
    assert {r.tier for r in by[("F6", "w0.n")]} == {1}
    t = sorted(r.tier for r in by[("F3", "x0.v")])
    assert t[:2] == [1, 1] and 2 in t          # two other .v in frame, then y.n
    assert sorted(r.tier for r in by[("F1", "q.prep")])[0] == 2
    assert {r.tier for r in by[("F1", "q.prep")]} <= {2, 4}
    # ".pron" counts as ending with "n"
    assert any(r.neg_lu == "pr.pron" and r.tier == 3 for r in by[("F6", "w0.n")]) or \
        all(r.tier == 1 for r in by[("F6", "w0.n")])


def test_deterministic(spark):
    d = defs(spark)
    a = sorted(map(tuple, sampling.sample_negatives(d, d.withColumn("lu_def", d.lu)).collect()))
    b = sorted(map(tuple, sampling.sample_negatives(d.orderBy("lu"), d.withColumn("lu_def", d.lu).repartition(3)).collect()))
    assert a == b


def test_top_k_per_group_matches_sort(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "md5(cast(id AS string)) AS o")
    got = sampling.top_k_per_group(df, ["g"], ["o"], 5).collect()
    want = {}
    for r in df.collect():
        want.setdefault(r.g, []).append(r.o)
    for g in want:
        assert sorted(r.o for r in got if r.g == g) == sorted(want[g])[:5]


def test_split_assignment(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "f STRING")
    got = {r.f: r.split for r in sampling.assign_split(files, "f", ["b"], ["c"]).collect()}
    assert got == {"a": "train", "b": "dev", "c": "test", "d": "train"}

import math

from framelex.operators import metrics, ranking

LOGITS = [  # example, choice, logit, label
    ("tie", 0, 1.0, 1), ("tie", 1, 3.0, 1), ("tie", 2, 3.0, 1),
    ("one", 0, -2.0, 0),
    ("eq", 0, 0.5, 2), ("eq", 1, 0.5, 2), ("eq", 2, 0.5, 2),
    ("big", 0, 800.0, 1), ("big", 1, -800.0, 1), ("big", 2, 799.0, 1),
]


def frame(spark):
    return spark.createDataFrame(LOGITS, "example_id STRING, choice_idx INT, logit DOUBLE, label INT")


def test_argmax_first_on_ties(spark):
    got = {r.example_id: r.pred for r in ranking.argmax(frame(spark)).collect()}
    assert got == {"tie": 1, "one": 0, "eq": 0, "big": 0}


def test_softmax_sums_to_one_and_is_stable(spark):
    rows = ranking.softmax(frame(spark)).collect()
    sums = {}
    for r in rows:
        assert not math.isnan(r.p)
        sums[r.example_id] = sums.get(r.example_id, 0) + r.p
    for v in sums.values():
        assert abs(v - 1) < 1e-12
    big = {r.choice_idx: r.p for r in rows if r.example_id == "big"}
    assert abs(big[0] - 1 / (1 + math.exp(-1))) < 1e-12


def test_loss_and_batches(spark):
    l = {r.example_id: r.loss for r in ranking.example_loss(frame(spark)).collect()}
    assert abs(l["eq"] - math.log(3)) < 1e-12
    assert abs(l["one"]) < 1e-12
    assert abs(l["big"] - (1600 + math.log(1 + math.exp(-1)))) < 1e-9
    mean = ranking.mean_loss(frame(spark)).first().loss
    assert abs(mean - sum(l.values()) / 4) < 1e-12
    # batches of 3 over examples big, eq, one | tie: mean of batch means
    b = ranking.batched_loss(frame(spark), 3).first().loss
    assert abs(b - ((l["big"] + l["eq"] + l["one"]) / 3 + l["tie"]) / 2) < 1e-12
    # no labels -> 0
    empty = frame(spark).where("label IS NULL")
    assert ranking.mean_loss(empty).first().loss == 0.0


def test_offsets_restart_per_batch(spark):
    o = {r.example_id: (r.n_choice, r.batch_id, r.offset) for r in ranking.choice_offsets(frame(spark), 2).collect()}
    assert o == {"big": (3, 0, 0), "eq": (3, 0, 3), "one": (1, 1, 0), "tie": (3, 1, 1)}


def test_binary_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1)], "pred INT, label INT")
    m = metrics.binary_metrics(df).first()
    assert m.precision == 0.0 and m.recall == 0.0 and m.f1 == 0.0
    assert abs(m.accuracy - 2 / 3) < 1e-12
    none = spark.createDataFrame([(0, 0)], "pred INT, label INT")
    assert metrics.binary_metrics(none).first().f1 == 0.0


def test_report_lines(spark):
    df = spark.createDataFrame([(1, 1), (0, 1)], "pred INT, label INT")
    lines = sorted(r.line for r in metrics.report_lines(metrics.binary_metrics(df)).collect())
    assert lines[0].startswith("accuracy        =0.5")
    assert all(l[16] == "=" for l in lines)

import pytest
from pyspark.sql import functions as F

from framelex.operators import choices
from framelex.plans import frame_queries


def rows(spark):
    return spark.createDataFrame([
        (1, "The cat sat here", "sit.v", 3, "d1", "A", "one def", 0),
        (2, "A dog ran", "run.v", 3, "d1~$~d2", "A~$~B", "x y z~$~" + " ".join(["w"] * 150), 1),
        (3, "No label here", "be.v", 2, "d", "A~$~B", "p~$~q", None),
    ], frame_queries.CHOICE_SCHEMA)


def test_split_escapes_dollar(spark):
    r = rows(spark).select(F.size(choices.split_choices(F.col("frame_names"))).alias("n")).collect()
    assert [x.n for x in r] == [1, 2, 2]


def test_encode_types(spark):
    with pytest.raises(ValueError):
        choices.explode_choices(rows(spark), "fn")
    with pytest.raises(ValueError):
        choices.explode_choices(rows(spark), "nonsense")


def test_features(spark):
    c = choices.choice_text(choices.explode_choices(rows(spark)))
    f = choices.features(c, max_length=20).collect()
    by = {(r.example_id, r.choice_idx): r for r in f}
    assert by[(1, 0)].choice_position == 3      # [CLS] the cat sat -> "sat" at 3
    assert by[(2, 1)].cropped and by[(2, 1)].choice_position == 0
    assert by[(2, 1)].n_real == 20
    assert len(by[(2, 0)].attention_mask) == 20
    assert by[(3, 0)].label is None
    e = {r.example_id: r.position for r in choices.example_positions(spark.createDataFrame(f)).collect()}
    assert e[2] == 0 and e[1] == 3


def test_single_choice(spark):
    got = {r.example_id: r.lu_pos for r in choices.single_choice(rows(spark)).collect()}
    assert got == {1: "v"}


def test_header_check(spark, tmp_path):
    p = str(tmp_path / "no_label")
    spark.createDataFrame([(1, "a")], "id INT, sentence STRING").write.option("header", True).csv(p)
    with pytest.raises(ValueError):
        frame_queries.check_header(spark, p)


def test_registries():
    from framelex.operators import scoring
    assert scoring.scorer("tfidf") is scoring.tfidf_scores
    with pytest.raises(ValueError):
        scoring.scorer("bert")


def test_sinks(spark, tmp_path):
    from framelex.sources import files
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "k INT, line STRING")
    p = str(tmp_path / "lines")
    files.write_lines(df, ["k"], "line", p)
    got = [r.value for r in spark.read.text(p).collect()]
    assert sorted(got) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        files.read_choice_csv(spark, p, frame_queries.CHOICE_SCHEMA, "holdout")

"""M3/M4: binary candidate filter over span labels, the best of several
settings by F1. Two scorers: smoothed log odds of counted features (grouped
sums, one pass, no iterations), and a ``pyspark.ml`` pipeline (hashed
features, logistic regression, softmax of the two logits)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from . import metrics

FEATURES = ["width", "first", "first_tok", "last_tok"]


def span_features(spans: DataFrame) -> DataFrame:
    """Features of a token span: width, position, and its first and last
    token texts (categorical, hashed)."""
    return spans.withColumn("width", (F.col("last") - F.col("first") + 1).cast("double")) \
                .withColumn("first", F.col("first").cast("double"))


def fit_predict(train: DataFrame, test: DataFrame, reg: float = 0.0, iters: int = 20):
    """Train on ``train``, score ``test``: adds ``p1`` (probability of
    label 1) and ``pred``."""
    hasher = FeatureHasher(inputCols=FEATURES, outputCol="features", numFeatures=1 << 12,
                           categoricalCols=["first_tok", "last_tok"])
    lr = LogisticRegression(featuresCol="features", labelCol="label_d", maxIter=iters, regParam=reg)
    model = Pipeline(stages=[hasher, lr]).fit(train.withColumn("label_d", F.col("label").cast("double")))
    out = model.transform(test.withColumn("label_d", F.col("label").cast("double")))
    return (out.withColumn("probs", vector_to_array("probability"))
            .withColumn("p1", F.element_at("probs", 2))
            .withColumn("pred", F.col("prediction").cast("int"))
            .drop("features", "rawPrediction", "probability", "prediction", "label_d"))


#: Buckets that a feature's values are hashed to, so the model's size is fixed.
BUCKETS = 4_096
COUNTED = ("width", "first_tok", "last_tok")


def _bucket(name: str):
    value = F.concat(F.lit(name + "="), F.coalesce(F.col(name).cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("bigint") % BUCKETS).cast("int")


def count_features(spans: DataFrame) -> DataFrame:
    """Spans with the hash bucket of each counted feature."""
    width = spans.withColumn("width", (F.col("last") - F.col("first") + 1).cast("int"))
    return width.withColumns({f"b_{c}": _bucket(c) for c in COUNTED})


def fit_counts(train: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """Per bucket the spans of label 1 and of label 0 (feature, bucket, p, n),
    grouped sums of at most ``BUCKETS`` rows a feature; and the totals."""
    seen = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"b_{c}").alias("bucket")) for c in COUNTED])).alias("f")
    rows = train.select("label", seen).groupBy("f.feature", "f.bucket").agg(
        F.sum(F.col("label").cast("bigint")).alias("p"), F.sum((1 - F.col("label")).cast("bigint")).alias("n"))
    total = train.agg(F.coalesce(F.sum(F.col("label").cast("bigint")), F.lit(0)).alias("p"), F.count(F.lit(1)).alias("c")).first()
    return rows, (int(total["p"]), int(total["c"] - total["p"]))


def score_counts(spans: DataFrame, model: DataFrame, totals: tuple[int, int], alpha: float = 1.0) -> DataFrame:
    """Adds ``p1`` and ``pred``: smoothed log odds of the label given each
    feature's bucket, summed. A model table has at most ``BUCKETS`` rows a
    feature, so it is broadcast."""
    pos, neg = totals
    prior = F.log(F.lit((pos + alpha) / (neg + alpha)))
    logit, out = prior, spans
    for c in COUNTED:
        m = model.where(F.col("feature") == c).select(F.col("bucket").alias(f"_b_{c}"), F.col("p").alias(f"_p_{c}"), F.col("n").alias(f"_n_{c}"))
        out = out.join(F.broadcast(m), out[f"b_{c}"] == m[f"_b_{c}"], "left")
        p, n = F.coalesce(f"_p_{c}", F.lit(0)), F.coalesce(f"_n_{c}", F.lit(0))
        like = F.log((p + alpha) / (pos + alpha * BUCKETS)) - F.log((n + alpha) / (neg + alpha * BUCKETS))
        logit = logit + like
    out = out.withColumn("_logit", logit)
    return out.select(*spans.columns, (1 / (1 + F.exp(-F.col("_logit")))).alias("p1"), F.when(F.col("_logit") > 0, 1).otherwise(0).alias("pred"))


def best_by_f1(runs: list[tuple[dict, DataFrame]]) -> tuple[dict, DataFrame]:
    """M4: the run with the highest F1 (first on ties); metrics are one-row
    frames, so this collects one row per run."""
    best, best_f1 = None, -1.0
    for params, preds in runs:
        f1 = metrics.binary_metrics(preds).first()["f1"]
        if f1 > best_f1:
            best, best_f1 = (params, preds), f1
    return best

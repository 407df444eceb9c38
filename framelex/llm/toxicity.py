"""Toxicity by multiple-instance learning: labels of documents, scores of
sentences.

A document is a bag of sentences; it is toxic if one of them is. A sentence's
probability is a logistic function of its words' weights, and the document's
score is the noisy-or of its sentences: 1 - prod(1 - p). The likelihood of the
documents' labels trains the weights, so sentence labels are not needed, and
the same weights then locate the offending sentences.

Features are a sentence's distinct lower-cased words and their first 4, 5 and
6 characters, so that inflected forms share weight. The fit reads at most ``FIT_ROWS`` labelled
rows of each label, the first ones by a hash of their id, of at most
``FIT_CHARS`` characters; rows are weighed so that each label counts as often
as in all labels. Scoring reads every whole text.

Defined cases: a text without words (null, empty) scores 0; without rows of
both labels all scores are the share of label 1; null labels are left out,
and an id with several labels has the largest; a null id is not learned from;
an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import hidden, importable, remembered, shown, texts_of

FIT_ROWS, FIT_CHARS = 3_000, 50_000
MAX_FEATURES = 5_000
#: Weight decay against the mean log-likelihood of a document.
L2 = 2e-5
#: Documents of label 1 in the sample that a feature must occur in.
MIN_DOCUMENTS = 4
CACHE_WORDS = 150_000
_SENTENCE = re.compile(r"[.!?\n]+")
_STRIP = re.compile(r"^\W+|\W+$")


def features(word: str) -> list[str]:
    """Features of a lower-cased word: itself and its prefixes."""
    w = _STRIP.sub("", word)
    if not w:
        return []
    return ["=" + w] + [w[:n] for n in (4, 5, 6) if len(w) >= n]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, learn: Column | None = None, rows: int = FIT_ROWS, chars: int = FIT_CHARS,
           doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[list, dict]:
    """The bounded fit sample as (text, label) pairs, and all labels' counts."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_label"))
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    # the ids are chosen from the labels alone and their number is bounded, so
    # they are broadcast and no text is shuffled
    chosen = None
    for y in (0, 1):
        t = known.where(F.col("_label") == y).orderBy(F.xxhash64("_id"), "_id").limit(rows)
        chosen = t if chosen is None else chosen.unionByName(t)
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where(F.length("_text") <= chars)
    # one text an id, the least, however often an id occurs
    found = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text")).collect()
    pairs = sorted(((r["_text"], r["_label"]) for r in found), key=lambda p: (p[1], p[0]))
    return pairs, counts


def fit(pairs: list, counts: dict | None = None, steps: int = 200, l2: float = L2) -> tuple[float, dict]:
    """(bias, weights by feature) from the sample's (text, label) pairs."""
    from array import array
    from collections import Counter

    import numpy as np

    y = np.array([p[1] for p in pairs], float)
    total = {v: float(max(1, (counts or {}).get(v) or (y == v).sum())) for v in (0, 1)}
    if not len(y) or y.min() == y.max():
        return _logit(float(y.mean()) if len(y) else 0.0), {}
    # features of label 1 first: those too rare there are never built for the
    # rest, so only counters of the survivors are held
    seen = [Counter(), Counter()]
    for label in (1, 0):
        for (t, v) in pairs:
            if v == label:
                found = {f for w in set(_SENTENCE.sub(" ", t.lower()).split()) for f in features(w)}
                seen[label].update(found if label else found & seen[1].keys())
        if label:
            seen[1] = Counter({f: n for f, n in seen[1].items() if n >= MIN_DOCUMENTS})
    n1, n0 = y.sum(), (1 - y).sum()

    def evidence(f):
        a, b = seen[1][f], seen[0][f]
        p = (a + b) / (n1 + n0)
        return (a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)

    chosen = sorted(sorted(seen[1]), key=lambda f: -abs(evidence(f)))[:MAX_FEATURES]
    index = {f: i for i, f in enumerate(f for f in chosen if abs(evidence(f)) > 3)}
    known: dict = {}  # of a word: the numbers of its features
    feat, sent, doc, n_sent = array("l"), array("l"), array("l"), 0
    for d, (t, _) in enumerate(pairs):
        for s in _SENTENCE.split(t.lower()):
            words = set(s.split())
            if words:
                for w in words:
                    ids = known.get(w)
                    if ids is None:
                        if len(known) > CACHE_WORDS:
                            known.clear()
                        ids = known[w] = tuple(index[f] for f in features(w) if f in index)
                    for i in ids:
                        feat.append(i)
                        sent.append(n_sent)
                doc.append(d)
                n_sent += 1
    feat, sent, doc = (np.array(x, np.int64) for x in (feat, sent, doc))
    each = np.where(y == 1, total[1] / n1, total[0] / n0)
    each /= each.sum()
    theta = np.zeros(len(index) + 1)
    theta[-1] = -5.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = np.bincount(sent, theta[feat], n_sent) + theta[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        # log(1 - score), the noisy-or of the document's sentences
        none = np.minimum(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)), -1e-12)
        q = np.exp(none)
        slope = np.where(y == 1, q / -np.expm1(none), -1.0) * each
        g = slope[doc] * p
        grad = np.concatenate((np.bincount(feat, g[sent], len(index)) - l2 * theta[:-1], [g.sum()]))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        theta += 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    return float(theta[-1]), {f: float(theta[i]) for f, i in index.items()}


def _logit(p: float) -> float:
    import math

    return -40.0 if p <= 0 else 40.0 if p >= 1 else math.log(p / (1 - p))


class WordWeights(dict):
    """Weight of a lower-cased word; a bounded number is remembered."""

    def __init__(self, weights: dict):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        get = self.weights.get
        v = self[word] = sum(get(f, 0.0) for f in features(word))
        return v


def sentence_scores(text: str, bias: float, words: WordWeights):
    """(start, stop, probability) of each sentence with words. Lower-casing is
    by word, so the offsets are those of the text itself."""
    import math

    at = 0
    for m in list(_SENTENCE.finditer(text)) + [None]:
        stop = m.start() if m else len(text)
        parts = set(text[at:stop].lower().split())
        if parts:
            z = bias + sum(map(words.__getitem__, parts))
            yield at, stop, 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))
        at = m.end() if m else stop


def score(docs: DataFrame, model: tuple[float, dict], text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the noisy-or over all sentences of the text."""
    importable(docs.sparkSession)
    bias, weights = model
    docs, names = hidden(docs)
    at = docs.columns.index(names[text])
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        import math

        import pyarrow as pa

        remembered("toxicity", dict)  # drops what other operators keep
        words = WordWeights(weights)
        prior = 1 / (1 + math.exp(-bias))
        for batch in batches:
            out = []
            for t in texts_of(batch.column(at)):
                t, none = t.decode() if t else t, 0.0
                if not weights and t and t.split():
                    none = math.log1p(-min(prior, 1 - 1e-16))  # no evidence: the share of label 1
                elif t:
                    for _, _, p in sentence_scores(t, bias, words):
                        none += math.log1p(-p) if p < 1 else -40.0
                out.append(-math.expm1(none))
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(out, pa.float64())], names=[f.name for f in schema])

    return shown(docs.mapInArrow(run, schema), names, "score")


def offending(docs: DataFrame, model: tuple[float, dict], threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The sentences at or above the threshold: (doc_id, start, stop,
    sentence, score), offsets in characters."""
    importable(docs.sparkSession)
    bias, weights = model
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("start", T.LongType()),
                           T.StructField("stop", T.LongType()), T.StructField("sentence", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        words = WordWeights(weights)
        for batch in batches:
            row, found = [], []
            for i, t in enumerate(batch.column(1)):
                t = t.as_py() or ""
                for a, b, p in sentence_scores(t, bias, words):
                    if p >= threshold:
                        row.append(i)
                        found.append((a, b, t[a:b], p))
            columns = list(zip(*found)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64()))] + [pa.array(c, k) for c, k in zip(
                columns, (pa.int64(), pa.int64(), pa.string(), pa.float64()))], names=[f.name for f in schema])

    return docs.select(doc_id, text).mapInArrow(run, schema)

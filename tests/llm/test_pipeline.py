"""The pipeline's stages, each on its own input, against brute force."""

import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from test_groups import brute_components, brute_fp, brute_kept


def corpus(spark, folder):
    rng = random.Random(11)
    vocabulary = [f"wort{i}" for i in range(2000)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = sentence(60)
    docs, labels = [], []
    for i in range(400):
        parts = [sentence(rng.randint(5, 30)) for _ in range(rng.randint(1, 8))]
        toxic = i % 5 == 0
        if toxic:
            parts.insert(rng.randrange(len(parts) + 1), sentence(4) + " vilest " + sentence(4))
        if i % 9 == 0:
            parts.insert(rng.randrange(len(parts) + 1), passage)
        docs.append((i, ". ".join(parts), "en", rng.choice(["a", "b", None, "hot", "hot"]), 1))
        labels.append((i, 1, int(toxic) if i % 4 else None))
    docs += [(1000 + i, docs[1][1], "en", "a", 1) for i in range(5)] + [(2000, None, None, None, None), (2001, "", "en", "b", 0), (2002, "one", "en", "b", 3)]
    near = docs[2][1].split(" ")
    near[len(near) // 2] = "ander"
    docs.append((1500, " ".join(near), "en", "b", 1))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages_against_brute_force(spark, tmp_path):
    sf = str(tmp_path)
    corpus(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, outputs = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/out{k}")
        before, docs = docs.collect(), spark.read.parquet(f"{sf}/out{k}")
        outputs.append((name, before, docs.collect()))
        assert k == 4 or docs.columns == columns
    (n0, d0, d1), (n1, _, d2), (n2, _, d3), (n3, _, d4), (n4, _, packed) = outputs
    assert [n0, n1, n2, n3, n4] == ["toxicity", "simhash_dedup", "substring_dedup", "mixing", "packing"]
    # toxic documents go, clean ones stay
    kept = {x.doc_id for x in d1}
    assert all((x.doc_id in kept) != ("vilest" in (x.text or "")) for x in d0)
    # the least id of each group of near copies stays, unchanged
    ids, fps = [x.doc_id for x in d1], [brute_fp(x.text) for x in d1]
    groups = brute_components(ids, fps, 4)
    assert sorted(x.doc_id for x in d2) == sorted(set(groups.values()))
    assert {x.doc_id: x for x in d2}.items() <= {x.doc_id: x for x in d1}.items()
    assert not {1000, 1004} & {x.doc_id for x in d2}
    # repeated windows go; other texts stay as they are
    want = brute_kept(sorted((x.doc_id, x.text) for x in d2 if x.text is not None), 20)
    old = {x.doc_id: x for x in d2}
    assert len(d3) == len(d2)
    for x in d3:
        was = old[x.doc_id]
        n, gone, text = want.get((x.doc_id, was.text), (0, 0, None))
        assert (x.text, x.n_chars) == ((text, len(text)) if gone else (was.text, was.n_chars))
    assert sum(x.text != old[x.doc_id].text for x in d3) > 5
    # no document more than twice, sources near their targets
    size = lambda t: len((t or "").encode().split())
    copies = {}
    for x in d4:
        copies[x.doc_id] = copies.get(x.doc_id, 0) + 1
    assert max(copies.values()) <= 2 and {x.doc_id for x in d4} <= {x.doc_id for x in d3}
    total = sum(size(x.text) for x in d3)
    assert abs(sum(size(x.text) for x in d4) - 1.5 * total) <= 4 * 300
    # every row of the mix is packed whole
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = sorted(len(tok.encode(x.text or "", add_special_tokens=False).ids) + 1 for x in d4)
    assert sorted(x.length for x in packed if x.piece == 0) == [min(4096, n) for n in lengths]
    assert sum(x.length for x in packed) == sum(lengths)
    bins = {}
    for x in packed:
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= 1.02 * sum(lengths) / 4096 + 2


def test_run_gives_the_last_stage(spark, tmp_path):
    corpus(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    assert out.where(F.col("length") > 4096).count() == 0 and out.count() > 100


def test_stages_of_an_empty_table(spark, tmp_path):
    corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0

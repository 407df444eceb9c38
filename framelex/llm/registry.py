"""Queries that apply the operators to the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, ball_tree, exact_dedup, fingerprint, merkle, mixing, packing, sharding, simhash_dedup, substring_dedup, token_counts, toxicity, url_filter
from .common import cut, table

#: Rules of op1 (host, path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op6_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, "piece_bpe_32k.model").select("doc_id", "n_words", "n_tokens")


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit(*toxicity.sample(docs, table(spark, sf_dir, "labels"), learn=~held))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    t = sharding.slots(sharding.shard(docs, "doc_id", 16, grown=17), ["doc_id", "size", "text_crc32"])
    return t.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: op9 counts, for ids divisible by 20, the other documents within so many of
#: 128 bits; ten block tables find them.
NEAR_RADIUS, NEAR_BLOCKS = 3, 5


def op9_fingerprint(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("n_chars", F.length("text").cast("bigint"))
    # equal rows are told apart by their place, which also keeps the order
    t = fingerprint.with_next(docs, ["doc_id", "text"], ["text"], place="place")
    edited = F.concat(F.expr("substring(text, 1, int(n_chars) - int(n_chars div 2))"), F.expr("substring(next_text, 1, int(n_chars div 2))"))
    t = t.withColumn("edited", edited).select("doc_id", "place", "n_chars", "text", "edited", F.unhex(F.sha2("edited", 256)).alias("sha"))
    prints = cut(fingerprint.fingerprints(t, ["doc_id", "place", "n_chars", "sha"], {"fp": "text", "ed": "edited"}), "fingerprints")
    asked = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    near = fingerprint.near_counts(prints, asked, radius=NEAR_RADIUS, blocks=NEAR_BLOCKS)
    lined = fingerprint.with_next(prints, ["place"], ["fp_0", "fp_1"])
    met = lined.where(asked).join(near, (F.col("fp_0") == F.col("q_0")) & (F.col("fp_1") == F.col("q_1")), "left").withColumn("near_count", F.col("near") - 1)
    out = lined.where(~asked).withColumn("near_count", F.lit(None).cast("bigint")).unionByName(met.drop("q_0", "q_1", "near"))
    return out.select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"),
                      fingerprint.as_string("fp").alias("fingerprint"), fingerprint.as_string("ed").alias("edited_fingerprint"),
                      fingerprint.likeness("fp", "ed").alias("near_edited"), fingerprint.likeness("fp", "next_fp").alias("near_next"), "near_count")


#: Tokenizer of op10, a file of the public_tokenizers package.
TOKENIZER = "word_bpe_49k.json"


def op10_packing(spark, sf_dir):
    pieces = packing.pieces(table(spark, sf_dir, "documents"), TOKENIZER, capacity=4096, end_id=1)
    return packing.pack(pieces, capacity=4096).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    return mixing.plan(docs, weights=(5, 2, 1), share=1.5, cap=2.0).select(
        "doc_id", "size", "source_size", "target", mixing.taken().alias("taken"))


def op3_substring_dedup(spark, sf_dir):
    out = substring_dedup.remove(table(spark, sf_dir, "documents").select("doc_id", "text"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_ann(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_simhash_dedup(spark, sf_dir):
    groups = simhash_dedup.cluster(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = merkle.leaf(*fields, F.translate("text", _UPPER, _LOWER))
    leaves = docs.select(F.col("doc_id").alias("id"), "source", merkle.leaf(*fields, F.col("text")).alias("leaf"),
                         F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, tampered).alias("changed"))
    return merkle.prove(leaves).withColumnRenamed("id", "doc_id")


def op13_lexical_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ball_tree.search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), k=20)


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_mixing": op2_mixing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_ann": op4_ann,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_toxicity": op7_toxicity,
    "op8_sharding": op8_sharding,
    "op9_fingerprint": op9_fingerprint,
    "op10_packing": op10_packing,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_merkle": op12_merkle,
    "op13_lexical_search": op13_lexical_search,
}


def _merkle_sql(levels: int = 5, top: int = 3) -> str:
    """SQL of op12, unrolled for sources of up to 16**levels documents and up
    to 16**top sources."""
    def grow(name, steps):
        # each step: nodes (t, i, n, h), climbing where more than one is left
        out = []
        for k in range(steps):
            out.append(f"""{name}r{k} AS (SELECT t, i // 16 AS up, string_agg(h, '' ORDER BY i) AS run FROM {name}{k} WHERE n > 1 GROUP BY t, i // 16),
        {name}{k + 1} AS (SELECT t, up AS i, count(*) OVER (PARTITION BY t) AS n, sha256(run) AS h FROM {name}r{k}
              UNION ALL SELECT t, i, n, h FROM {name}{k} WHERE n = 1)""")
        return ",\n        ".join(out)

    def climb(name, steps, start):
        # each step: siblings left and right of a document's node
        out, last = [], start
        for k in range(steps):
            out.append(f"""{name}p{k} AS (SELECT p.* EXCLUDE (spot, proof, folded), CASE WHEN run IS NULL THEN spot ELSE spot // 16 END AS spot,
                 proof || coalesce(run[:64 * (spot % 16)] || run[64 * (spot % 16) + 65:], '') AS proof,
                 CASE WHEN run IS NULL THEN folded ELSE sha256(run[:64 * (spot % 16)] || folded || run[64 * (spot % 16) + 65:]) END AS folded
              FROM {last} p LEFT JOIN {name}r{k} r ON r.t = p.t AND r.up = p.spot // 16)""")
            last = f"{name}p{k}"
        return ",\n        ".join(out), last

    inner, reached = climb("s", levels, "d0")
    outer, ended = climb("t", top, "d1")
    field = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
    fields = " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    return f"""
        WITH poly AS (SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, i:
                        CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
        l AS (SELECT doc_id, source, sha256({fields} || {field.format('text')}) AS leaf,
                     sha256({fields} || {field.format(lower)}) AS low,
                     xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
                         lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295) % 5 = 0 AS hit FROM documents, poly),
        s0 AS (SELECT dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t, count(*) OVER (PARTITION BY source) AS n,
                      row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, doc_id, low, hit FROM l),
        {grow("s", levels)},
        t0 AS (SELECT 0 AS t, t AS i, count(*) OVER () AS n, h FROM s{levels}),
        {grow("t", top)},
        d0 AS (SELECT doc_id, h AS leaf, t, i AS spot, '' AS proof, CASE WHEN hit THEN low ELSE h END AS folded FROM s0),
        {inner},
        d1 AS (SELECT p.* EXCLUDE (t, spot), s.h AS subroot, 0 AS t, p.t AS spot FROM {reached} p JOIN s{levels} s ON s.t = p.t),
        {outer}
        SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.h AS verified
        FROM {ended} p, t{top} r"""


SQL = {
    "op11_exact_dedup": r"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
               sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
    "op12_merkle": _merkle_sql(),
    "op13_lexical_search": r"""
        WITH d AS (
          SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
        n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
        a AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM n),
        w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, a GROUP BY term, docs),
        m AS (SELECT doc_id, 75 + ((25 * n * docs) // len) AS m FROM n, a),
        q AS (SELECT item_id, term, count(*) AS qtf FROM (
                SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
        s AS (SELECT item_id, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
              FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20""",
    "op2_mixing": r"""
        WITH d AS (
          SELECT doc_id, source, md5('0|' || coalesce(doc_id::VARCHAR, '')) AS spot,
                 coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
                     2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS everything FROM s),
        l AS (SELECT *, (everything - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                        / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, cap / weight) FROM l WHERE level <= cap / weight) * weight, cap)) AS target FROM l),
        p AS (SELECT doc_id, size, source_size, target, round(target)::BIGINT AS quota,
                     (sum(size) OVER (PARTITION BY d.source ORDER BY spot, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS place
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CASE WHEN source_size = 0 THEN 0 ELSE (quota // source_size) * size
                    + greatest(0, least(size, quota % source_size - place)) END::BIGINT AS taken
        FROM p""",
    "op1_url_filter": r"""
        WITH cut AS (
          SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        u AS (
          SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                              ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        hit AS (
          SELECT page_id, h || p AS rule, v,
                 row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) AS k
          FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT u.page_id, host, path, rule, coalesce(v, 'allow') AS verdict
        FROM u LEFT JOIN hit ON hit.page_id = u.page_id AND k = 1""",
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)

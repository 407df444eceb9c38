"""DuckDB oracle SQL for the registered queries.

The oracle states the same semantics in another engine: CTE blocks for
sentences, tokens, annotation, lexicon compile and a recursive pattern
walk. The given tables are views named after their files.
"""

from __future__ import annotations

from ..functions import fixed
from ..functions.text import PIECE_PATTERN, SENTENCE_SPLIT


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows, cols: str) -> str:
    body = ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({cols})"


def _lit(v) -> str:
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return str(v)
    return q(v)


def lst(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def number_words_sql(x: str) -> str:
    """Whole numbers in words: groups of three digits with their scales."""
    ones, tens, scales = lst(fixed.ONES), lst(fixed.TENS), lst(fixed.SCALES)
    s = f"regexp_replace({x}, '^0+(.)', '\\1')"
    n = f"((length({s}) + 2) // 3)"

    def b100(v: str) -> str:
        return (f"(CASE WHEN {v} < 20 THEN {ones}[{v} + 1] ELSE {tens}[{v} // 10 + 1] || "
                f"(CASE WHEN {v} % 10 > 0 THEN '-' || {ones}[{v} % 10 + 1] ELSE '' END) END)")

    def b1000(v: str) -> str:
        return (f"(CASE WHEN {v} < 100 THEN {b100(v)} ELSE {ones}[{v} // 100 + 1] || ' hundred' || "
                f"(CASE WHEN {v} % 100 > 0 THEN ' and ' || {b100(f'({v} % 100)')} ELSE '' END) END)")

    def group(i: str) -> str:
        return f"CAST(substr(lpad({s}, CAST({n} * 3 AS INTEGER), '0'), CAST({i} * 3 + 1 AS INTEGER), 3) AS INTEGER)"

    head = (f"array_to_string(list_transform(list_filter(range(0, {n} - 1), lambda i: {group('i')} > 0), "
            f"lambda i: {b1000(group('i'))} || {scales}[{n} - i]), ', ')")
    last = group(f"({n} - 1)")
    return (f"(CASE WHEN NOT regexp_full_match({x}, '[0-9]+') OR {n} > {len(fixed.SCALES)} THEN {x} "
            f"WHEN {n} = 1 THEN {b1000(last)} WHEN {last} = 0 THEN {head} "
            f"WHEN {last} < 100 THEN {head} || ' and ' || {b100(last)} ELSE {head} || ', ' || {b1000(last)} END)")


SENTS = rf"""
sents AS (
  SELECT doc_id, sent_idx, sentence, md5(sentence) AS sent_id FROM (
    SELECT doc_id, sent_idx, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS sentence FROM (
      SELECT doc_id, unnest(p) AS raw, generate_subscripts(p, 1) - 1 AS sent_idx
      FROM (SELECT doc_id, regexp_split_to_array(text, '{SENTENCE_SPLIT.replace(chr(10), "")}') AS p FROM documents)))
  WHERE sentence <> ''),
dsent AS (SELECT sent_id, any_value(sentence) AS sentence, count(*) AS n_occ FROM sents GROUP BY sent_id)"""

TOKS = rf"""
pieces AS (
  SELECT sent_id, pass, unnest(p) AS piece, generate_subscripts(p, 1) AS piece_idx FROM (
    SELECT sent_id, 0 AS pass, regexp_extract_all(sentence, '{PIECE_PATTERN}') AS p FROM dsent
    UNION ALL
    SELECT sent_id, 1 AS pass, regexp_extract_all(replace(sentence, '-', ' '), '{PIECE_PATTERN}') AS p FROM dsent)),
tok0 AS (
  SELECT sent_id, pass, piece_idx, piece, NOT regexp_matches(piece, '^\s') AS is_word,
    coalesce(sum(length(piece)) OVER w, 0) AS start,
    coalesce(sum(CASE WHEN regexp_matches(piece, '^\s') THEN 0 ELSE 1 END) OVER w, 0) AS tok_idx
  FROM pieces
  WINDOW w AS (PARTITION BY sent_id, pass ORDER BY piece_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
toks AS (
  SELECT sent_id, pass, CAST(tok_idx AS INTEGER) AS tok_idx, CAST(start AS INTEGER) AS start,
    CAST(start + length(piece) AS INTEGER) AS "end",
    CASE WHEN pass = 1 THEN lower(piece) ELSE piece END AS text
  FROM tok0 WHERE is_word)"""

ANN = rf"""
forms AS (SELECT * FROM {values(fixed.FORMS, 'form, f_lemma, f_pos')}),
ann AS (
  SELECT t.*,
    CASE WHEN regexp_full_match(t.text, '[0-9]+') THEN {number_words_sql('t.text')}
         ELSE coalesce(f.f_lemma, lower(t.text)) END AS lemma,
    CASE WHEN regexp_full_match(t.text, '[0-9]+') THEN {number_words_sql('t.text')}
         ELSE regexp_replace(lower(t.text), '^(.{{3,}}?)(ing|ed|ly|es|s)$', '\1') END AS stem,
    CASE WHEN regexp_full_match(t.text, '[0-9]+') THEN 'NUM' ELSE coalesce(f.f_pos, 'X') END AS pos
  FROM toks t LEFT JOIN forms f ON lower(t.text) = f.form)"""


def _extras_rows():
    return [(n, f, True) for n, f in fixed.EXTRA_SIMPLE] + [(n, f, False) for n, f in fixed.EXTRA_NAMED]


def _spell_cases() -> str:
    """Structs (variant, root, to_us) of a root word under the ending rules."""
    parts = []
    for us, gb in fixed.SPELLING_SUFFIXES:
        for a, b, to_us in ((us, gb, "TRUE"), (gb, us, "FALSE")):
            parts.append(f"CASE WHEN ends_with(root, {q(a)}) AND length(root) >= {len(a) + fixed.SPELLING_MIN_STEM} THEN "
                         f"{{'variant': substr(root, 1, length(root) - {len(a)}) || {q(b)}, 'root': root, 'to_us': {to_us}}} END")
    return "[" + ", ".join(parts) + "]"


LEX = rf"""
lus AS (
  SELECT name, frame FROM {values(fixed.FIXTURE_LUS, 'name, frame')}
  UNION ALL
  SELECT concat_ws('.', p_name, {lst(fixed.PART_POS)}[p_partkey % 5 + 1]) AS name,
         concat_ws('/', p_type, CAST(p_size AS VARCHAR)) AS frame FROM part),
lus_l AS (
  SELECT name, frame, FALSE AS direct FROM lus
  UNION ALL SELECT lower(name), frame, FALSE FROM lus WHERE name <> lower(name)
  UNION ALL SELECT name, frame, direct FROM {values(_extras_rows(), 'name, frame, direct')}),
based AS (
  SELECT name, frame, direct,
    CASE WHEN instr(name, '.') > 0 THEN regexp_replace(name, '\.[^.]*$', '') ELSE '' END AS base FROM lus_l),
vp AS (SELECT *, regexp_extract(base, '\(.*\)', 0) AS m, instr(base, '(') AS pi FROM based),
vp2 AS (
  SELECT *, regexp_replace(m, '^[ ()]+|[ ()]+$', '', 'g') AS inner_,
    CASE WHEN pi > 0 THEN substr(base, 1, pi - 1) ELSE '' END AS pre,
    CASE WHEN pi > 0 THEN substr(base, pi + length(m)) ELSE '' END AS suf FROM vp),
varr AS (
  SELECT name, frame, direct, base,
    (CASE WHEN instr(base, '-') > 0 THEN [replace(base, '-', ' '), replace(base, '-', ' - ')] ELSE [] END)
    || (CASE WHEN regexp_matches(base, ' *\[.*\] *')
             THEN [regexp_replace(regexp_replace(base, ' *\[.*\] *', '', 'g'), '^\s+|\s+$', '', 'g')] ELSE [] END)
    || (CASE WHEN m <> '' AND instr(inner_, '/') > 0 THEN list_transform(string_split(inner_, '/'), lambda x: pre || x || suf)
             WHEN m <> '' AND inner_ IN ({", ".join(q(g) for g in fixed.GENERICS)})
               THEN list_transform({lst(fixed.GENERICS["one's"])}, lambda x: pre || x || suf)
             WHEN m <> '' THEN [pre || inner_ || suf] ELSE [] END) AS vs
  FROM vp2),
variants AS (
  SELECT DISTINCT name AS lu, frame, v AS variant FROM (
    SELECT name, frame, unnest(CASE WHEN direct THEN [name] WHEN len(vs) = 0 THEN [base] ELSE vs END) AS v FROM varr)),
pats AS (
  SELECT array_to_string(words, ' ') AS key, words, len(words) AS n, list_sort(list(DISTINCT frame)) AS frames
  FROM (SELECT DISTINCT string_split(variant, ' ') AS words, frame FROM variants) GROUP BY words),
pre AS (SELECT array_to_string(words[1:k], ' ') AS key, k AS depth, k < n AS child
        FROM (SELECT words, n, unnest(range(1, n + 1)) AS k FROM pats)),
nodes AS (
  SELECT p.key, max(p.depth) AS depth, bool_or(p.child) AS has_children,
         coalesce(any_value(t.frames), []::VARCHAR[]) AS frames
  FROM pre p LEFT JOIN pats t ON p.key = t.key GROUP BY p.key),
roots AS (SELECT DISTINCT words[1] AS root FROM pats),
spell AS (
  SELECT DISTINCT v.variant AS variant, v.root AS root, v.to_us AS to_us
  FROM (SELECT unnest({_spell_cases()}) AS v FROM roots) WHERE v IS NOT NULL)"""

WALK = rf"""
al AS (SELECT * FROM {values(fixed.ALIASES, 'a_form, a_word')}),
starts AS (
  SELECT sent_id, pass, tok_idx, start, "end", 'surface' AS view, text AS first FROM ann
  UNION ALL SELECT sent_id, pass, tok_idx, start, "end", 'lemma', lemma FROM ann
  UNION ALL SELECT sent_id, pass, tok_idx, start, "end", 'stem', stem FROM ann
  UNION ALL SELECT a.sent_id, a.pass, a.tok_idx, a.start, a."end", 'alias', al.a_word FROM ann a JOIN al ON a.text = al.a_form
  UNION ALL SELECT * FROM (
    SELECT DISTINCT a.sent_id, a.pass, a.tok_idx, a.start, a."end", 'spelling', s.root
    FROM ann a JOIN spell s ON s.variant = CASE
      WHEN EXISTS (SELECT 1 FROM spell x WHERE x.variant = a.text AND x.to_us = s.to_us) THEN a.text
      WHEN EXISTS (SELECT 1 FROM spell x WHERE x.variant = a.lemma AND x.to_us = s.to_us) THEN a.lemma
      ELSE a.stem END)),
walk AS (
  SELECT s.sent_id, s.pass, s.view, s.tok_idx, s.start, s."end", 1 AS depth, n.key
  FROM starts s JOIN nodes n ON n.key = s.first AND n.depth = 1
  UNION ALL
  SELECT w.sent_id, w.pass, w.view, w.tok_idx, w.start, x."end", w.depth + 1, coalesce(nl.key, np.key)
  FROM walk w JOIN nodes c ON c.key = w.key AND c.has_children
  JOIN ann x ON x.sent_id = w.sent_id AND x.pass = w.pass AND x.tok_idx = w.tok_idx + w.depth
  LEFT JOIN nodes nl ON nl.key = w.key || ' ' || (CASE WHEN w.view IN ('surface', 'alias') THEN x.text
                                                      WHEN w.view = 'lemma' THEN x.lemma ELSE x.stem END)
  LEFT JOIN nodes np ON np.key = w.key || ' <' || upper(x.pos) || '>'
  WHERE coalesce(nl.key, np.key) IS NOT NULL),
emits AS (
  SELECT w.sent_id, w.pass, w.view, w.start, w."end", w.key AS lu, n.frames
  FROM walk w JOIN nodes n ON n.key = w.key WHERE len(n.frames) > 0),
ovr AS (SELECT * FROM {values(fixed.OVERRIDES, 'o_lemma, o_pos, o_lu, extra')}),
ov_rows AS (
  SELECT a.sent_id, a.pass, 'override' AS view, a.start, CAST(a."end" + o.extra AS INTEGER) AS "end", o.o_lu AS lu, n.frames
  FROM ann a JOIN ovr o ON a.lemma = o.o_lemma AND a.pos = o.o_pos JOIN nodes n ON n.key = o.o_lu
  WHERE NOT (a.pass = 0 AND a.tok_idx = 0)),
cand_rows AS (
  SELECT * FROM (SELECT * FROM emits UNION ALL SELECT * FROM ov_rows) WHERE "end" > start),
lu_hits AS (SELECT DISTINCT sent_id, start, "end", lu FROM cand_rows),
cands AS (
  SELECT sent_id, start, "end", list_sort(list_distinct(flatten(list(frames)))) AS frames
  FROM cand_rows GROUP BY sent_id, start, "end")"""


def with_blocks(*blocks: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(b.strip("\n") for b in blocks) + "\n"


CORPUS = (SENTS, TOKS)
CAND = (SENTS, TOKS, ANN, LEX, WALK)

HIT_STATS = 'SELECT lu, count(*) AS n_hits, CAST(sum(start) AS BIGINT) AS sum_start, CAST(sum("end") AS BIGINT) AS sum_end FROM lu_hits'

SQL = {
    "tokens": with_blocks(*CORPUS) + """
SELECT sent_id, pass, count(*) AS n_tokens, CAST(sum(start) AS BIGINT) AS sum_start, CAST(sum("end") AS BIGINT) AS sum_end,
       md5(string_agg(text, ' ' ORDER BY tok_idx)) AS tokens_md5
FROM toks GROUP BY sent_id, pass""",
    "distinct_sentences": with_blocks(SENTS) + """
SELECT CAST(sum(n_occ) AS BIGINT) AS n_sentences, count(*) AS n_distinct FROM dsent""",
    "ngrams": with_blocks(*CORPUS, LEX) + """,
g AS (SELECT n, g FROM (
  SELECT list(text) OVER w AS a FROM toks WHERE pass = 0
  WINDOW w AS (PARTITION BY sent_id, pass ORDER BY tok_idx ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)),
  (SELECT unnest(range(1, max(n) + 1)) AS n FROM pats) r, LATERAL (SELECT array_to_string(a[1:n], ' ') AS g) WHERE len(a) >= n)
SELECT CAST(n AS INTEGER) AS n, count(*) AS n_ngrams, count(DISTINCT g) AS n_distinct FROM g GROUP BY n""",
    "lu_names": with_blocks(LEX) + r"""
SELECT name AS lu, split_part(name, '.', 1) AS lu_no_pos,
       CASE WHEN instr(name, '.') > 0 THEN regexp_extract(name, '[^.]*$', 0) ELSE name END AS lu_pos,
       CASE WHEN instr(name, '.') > 0 THEN regexp_replace(name, '\.[^.]*$', '') ELSE '' END AS trie_name
FROM (SELECT DISTINCT name FROM lus)""",
    "lu_variants": with_blocks(LEX) + "SELECT lu, frame, variant FROM variants",
    "lu_patterns": with_blocks(LEX) + """
SELECT key AS pattern, CAST(n AS INTEGER) AS n, array_to_string(frames, '|') AS frames FROM pats""",
    "lu_prefixes": with_blocks(LEX) + r""",
kids AS (SELECT regexp_replace(key, ' [^ ]*$', '') AS pkey, count(*) AS n_children FROM nodes WHERE depth > 1 GROUP BY 1)
SELECT key AS prefix, CAST(depth AS INTEGER) AS depth, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
       len(frames) > 0 AS terminal
FROM nodes LEFT JOIN kids ON nodes.key = kids.pkey""",
    "lu_exact_lookup": with_blocks(LEX) + """,
names AS (SELECT DISTINCT name AS lu FROM lus),
k AS (SELECT lu, list_filter(string_split(split_part(replace(replace(replace(lu, '-', ' '), '(', ''), ')', ''), '.', 1), ' '),
             lambda w: length(w) > 0 AND NOT starts_with(w, '[') AND NOT ends_with(w, ']')) AS ws FROM names)
SELECT lu, array_to_string(coalesce(n.frames, []::VARCHAR[]), '|') AS frames
FROM k LEFT JOIN nodes n ON len(k.ws) > 0 AND n.key = array_to_string(k.ws, ' ')""",
    "candidates": with_blocks(*CAND, recursive=True) + """
SELECT sent_id, start, "end", array_to_string(frames, '|') AS frames FROM cands""",
    "cand_unigram": with_blocks(*CAND, recursive=True) + HIT_STATS + " WHERE NOT contains(lu, ' ') GROUP BY lu",
    "cand_multiword": with_blocks(*CAND, recursive=True) + HIT_STATS + " WHERE contains(lu, ' ') GROUP BY lu",
    "cand_wildcard": with_blocks(*CAND, recursive=True) + HIT_STATS + " WHERE contains(lu, '<') GROUP BY lu",
    "cand_numbers": with_blocks(*CAND, recursive=True) + HIT_STATS.replace("FROM lu_hits", "FROM lu_hits JOIN dsent USING (sent_id)")
    + " WHERE regexp_matches(substr(sentence, start + 1, 1), '[0-9]') GROUP BY lu",
    "cand_views": with_blocks(*CAND, recursive=True) + """
SELECT pass, view, count(*) AS n_rows, CAST(sum(start) AS BIGINT) AS sum_start, CAST(sum("end") AS BIGINT) AS sum_end
FROM cand_rows GROUP BY pass, view""",
    "cand_spelling": with_blocks(SENTS, TOKS, ANN) + """,
w AS (SELECT DISTINCT text FROM toks WHERE pass = 1 AND regexp_full_match(text, '[a-z]{3,}')),
pairs AS (SELECT a.text AS us, b.text AS gb FROM w a JOIN w b ON b.text = a.text || 'ing'),
spell AS (SELECT gb AS variant, us AS root, TRUE AS to_us FROM pairs
          UNION SELECT us, gb, FALSE FROM pairs WHERE gb IN (SELECT us FROM pairs)),
lu_hits AS (SELECT DISTINCT a.sent_id, a.start, a."end", s.root AS lu FROM ann a JOIN spell s ON s.variant = CASE
      WHEN EXISTS (SELECT 1 FROM spell x WHERE x.variant = a.text AND x.to_us = s.to_us) THEN a.text
      WHEN EXISTS (SELECT 1 FROM spell x WHERE x.variant = a.lemma AND x.to_us = s.to_us) THEN a.lemma
      ELSE a.stem END)
""" + HIT_STATS + " GROUP BY lu",
    "cand_by_lu": with_blocks(*CAND, recursive=True) + """,
per_lu AS (SELECT sent_id, start, "end", lu, list_sort(list_distinct(flatten(list(frames)))) AS frames
           FROM cand_rows GROUP BY sent_id, start, "end", lu)
SELECT sent_id, start, "end", string_agg(lu || '=' || array_to_string(frames, '|'), ';' ORDER BY lu) AS lu_frames
FROM per_lu GROUP BY sent_id, start, "end\"""",
}

LOGITS = """
li AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
          l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS INTEGER) AS choice_idx,
          count(*) OVER (PARTITION BY l_orderkey) AS n_choice FROM lineitem),
lg AS (SELECT l_orderkey AS example_id, choice_idx, l_discount * 10 AS logit,
          CAST(l_orderkey % n_choice AS INTEGER) AS label, CAST(n_choice AS INTEGER) AS n_choice FROM li),
mx AS (SELECT example_id, max(logit) AS m FROM lg GROUP BY example_id),
ex_loss AS (SELECT lg.example_id, ln(sum(exp(logit - m))) + any_value(m)
              - max(CASE WHEN choice_idx = label THEN logit END) AS loss
            FROM lg JOIN mx USING (example_id) GROUP BY lg.example_id),
pred AS (SELECT example_id, CAST(arg_max(choice_idx, struct_pack(a := logit, b := -choice_idx)) AS INTEGER) AS pred
         FROM lg GROUP BY example_id)"""

SQL.update({
    "choice_offsets": with_blocks(LOGITS) + """,
n AS (SELECT example_id, count(*) AS n_choice FROM lg GROUP BY example_id),
b AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY example_id) - 1) / 8) AS BIGINT) AS batch_id FROM n)
SELECT example_id, n_choice, batch_id,
       CAST(coalesce(sum(n_choice) OVER (PARTITION BY batch_id ORDER BY example_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM b""",
    "choice_argmax": with_blocks(LOGITS) + "SELECT example_id, pred FROM pred",
    "choice_accuracy": with_blocks(LOGITS) + """
SELECT round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n
FROM pred JOIN (SELECT DISTINCT example_id, label FROM lg) USING (example_id)""",
    "choice_softmax": with_blocks(LOGITS) + """,
s AS (SELECT example_id, sum(exp(logit - m)) AS s FROM lg JOIN mx USING (example_id) GROUP BY example_id)
SELECT example_id, choice_idx, round(exp(logit - m) / s, 6) AS p FROM lg JOIN mx USING (example_id) JOIN s USING (example_id)""",
    "choice_probs": with_blocks(LOGITS) + "SELECT example_id, choice_idx, round((1 + tanh(logit)) / 2, 6) AS p FROM lg",
    "choice_loss": with_blocks(LOGITS) + "SELECT round(coalesce(avg(loss), 0.0), 6) AS loss FROM ex_loss",
    "eval_loss_batched": with_blocks(LOGITS) + """,
b AS (SELECT loss, floor((row_number() OVER (ORDER BY example_id) - 1) / 8) AS batch_id FROM ex_loss)
SELECT round(coalesce(avg(bl), 0.0), 6) AS loss FROM (SELECT batch_id, avg(loss) AS bl FROM b GROUP BY batch_id)""",
    "sink_pred_lines": with_blocks(LOGITS) + """,
pr AS (SELECT example_id, string_agg(format('{:.6f}', (1 + tanh(logit)) / 2), ',' ORDER BY choice_idx) AS probs
       FROM lg GROUP BY example_id)
SELECT example_id, CAST(pred AS VARCHAR) || chr(9) || probs AS line FROM pred JOIN pr USING (example_id)""",
    "train_batches": """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('0|0|' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rn FROM labels)
SELECT CAST(floor(rn / 36) AS BIGINT) AS batch_id, count(*) AS n,
       md5(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rn)) AS ids_md5
FROM r GROUP BY 1""",
    "train_log_windows": """
WITH g AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) AS step FROM events)
SELECT CAST(floor((step - 1) / 50) AS BIGINT) AS "window", count(*) AS n, round(avg(value), 6) AS avg_loss,
       arg_max(step, struct_pack(a := value, b := -step)) AS best_step
FROM g GROUP BY 1""",
})

#: Pass-0 word sequences that are a pattern; ``nx`` are the tokens from the
#: first one on.
GRAMS = """
an0 AS (
  SELECT t.*, lag(start) OVER w AS p_s, lag("end") OVER w AS p_e,
         list({'t': text, 's': start, 'e': "end"}) OVER (PARTITION BY sent_id, pass ORDER BY tok_idx
              ROWS BETWEEN CURRENT ROW AND 17 FOLLOWING) AS nx
  FROM toks t WHERE pass = 0 WINDOW w AS (PARTITION BY sent_id, pass ORDER BY tok_idx)),
ang AS MATERIALIZED (
  SELECT a.sent_id, a.tok_idx, r.n, a.start, a.nx[r.n].e AS "end", p_s, p_e, a.nx[r.n].t AS last_t, p.key AS gram, p.frames[1] AS g_frame,
         a.nx[r.n + 1].s AS n_s, a.nx[r.n + 1].e AS n_e, a.nx[r.n + 2].t AS n2_t, a.nx[r.n + 2].s AS n2_s, a.nx[r.n + 2].e AS n2_e
  FROM an0 a JOIN (SELECT DISTINCT n FROM pats) r ON len(a.nx) >= r.n
  JOIN pats p ON p.n = r.n AND p.key = array_to_string(list_transform(a.nx[1:r.n], lambda x: x.t), ' '))"""

GOLD = GRAMS + """,
gold AS (
  SELECT sent_id, start, "end", g_frame AS frame_name FROM ang
  UNION ALL
  SELECT sent_id, start, "end", 'Entity' FROM toks
  WHERE pass = 0 AND regexp_matches(text, '^[A-Z]') AND text NOT IN (SELECT key FROM pats WHERE n = 1)),
cex AS (SELECT DISTINCT sent_id, start, "end", unnest(frames) AS frame_name FROM cands),
gx AS (SELECT DISTINCT * FROM gold WHERE frame_name IS NOT NULL),
lab AS (
  SELECT coalesce(c.sent_id, g.sent_id) AS sent_id, coalesce(c.start, g.start) AS start,
         coalesce(c."end", g."end") AS "end", coalesce(c.frame_name, g.frame_name) AS frame_name,
         CASE WHEN g.sent_id IS NOT NULL THEN 1 ELSE 0 END AS label,
         CASE WHEN c.sent_id IS NOT NULL AND g.sent_id IS NOT NULL THEN 'both'
              WHEN c.sent_id IS NOT NULL THEN 'cand_only' ELSE 'gold_only' END AS side
  FROM cex c FULL OUTER JOIN gx g ON c.sent_id = g.sent_id AND c.start = g.start AND c."end" = g."end"
       AND c.frame_name = g.frame_name),
lspan AS (SELECT DISTINCT sent_id, start, "end" FROM lab),
t0 AS (SELECT sent_id, start AS t_start, "end" AS t_end, tok_idx FROM toks WHERE pass = 0),
al2 AS (
  SELECT s.sent_id, s.start, s."end",
    (SELECT CAST(t.tok_idx AS INTEGER) FROM t0 t WHERE t.sent_id = s.sent_id AND t.t_start <= s.start AND s.start < t.t_end) AS first,
    (SELECT CAST(t.tok_idx AS INTEGER) FROM t0 t WHERE t.sent_id = s.sent_id AND t.t_start <= s."end" - 1 AND s."end" - 1 < t.t_end) AS last_
  FROM lspan s),
aligned AS (SELECT sent_id, start, "end", first, coalesce(last_, first) AS last FROM al2)"""

PREDS = """
WITH j AS (SELECT l.doc_id, CASE WHEN ln(CAST(greatest(d.n_chars, 1) AS DOUBLE)) - 7.0 > 0 THEN 1 ELSE 0 END AS pred,
                  l.quality AS label FROM labels l JOIN documents d USING (doc_id)),
c AS (SELECT count(*) AS n, count_if(pred = 1 AND label = 1) AS tp, count_if(pred = 1 AND label = 0) AS fp,
             count_if(pred = 0 AND label = 1) AS fn, count_if(pred = label) AS ok FROM j),
m AS (SELECT CASE WHEN n = 0 THEN 0.0 ELSE ok / n END AS accuracy,
             CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS "precision",
             CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
             CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM c)
"""

SQL.update({
    "label_candidates": with_blocks(*CAND, GOLD, recursive=True) + """
SELECT label, side, count(*) AS n, CAST(sum(start) AS BIGINT) AS sum_start, CAST(sum("end") AS BIGINT) AS sum_end
FROM lab GROUP BY label, side""",
    "align_span": with_blocks(*CAND, GOLD, recursive=True) + 'SELECT sent_id, start, "end", first, last FROM aligned',
    "span_labels": with_blocks(*CAND, GOLD, recursive=True) + """
SELECT a.sent_id, a.first, a.last, CAST(max(l.label) AS INTEGER) AS label
FROM lab l JOIN aligned a ON l.sent_id = a.sent_id AND l.start = a.start AND l."end" = a."end"
WHERE a.first IS NOT NULL GROUP BY a.sent_id, a.first, a.last""",
    "binary_metrics": PREDS + """
SELECT round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision", round(recall, 6) AS recall,
       round(f1, 6) AS f1 FROM m""",
    "metrics_report": PREDS + """,
kv AS (SELECT unnest(['accuracy', 'precision', 'recall', 'f1']) AS key,
              unnest([accuracy, "precision", recall, f1]) AS v FROM m)
SELECT key, rpad(key, 16, ' ') || '=' || CAST(round(v, 6) AS VARCHAR) AS line FROM kv""",
})

PART_LUS = f"""
plu AS (SELECT concat_ws('/', p_type, CAST(p_size AS VARCHAR)) AS frame_name,
               concat_ws('.', p_name, {lst(fixed.PART_POS)}[p_partkey % 5 + 1]) AS lu, p_brand AS lu_def FROM part),
fld AS (SELECT frame_name, lu, min(lu_def) AS lu_def, split_part(lu, '.', 1) AS lu_no_pos FROM plu GROUP BY frame_name, lu)"""

CHOICE_ROWS = rf"""
lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
         l_returnflag, l_linestatus, l_shipdate,
         'Ship_' || l_returnflag || l_linestatus || '_' || CAST(l_linenumber AS VARCHAR) AS fn,
         concat_ws(' ', 'Part', CAST(l_partkey AS VARCHAR), 'from supplier', CAST(l_suppkey AS VARCHAR),
                   CASE WHEN l_linenumber = 3 THEN 'ships' || chr(10) || 'later' ELSE 'ships' END,
                   trim(repeat('Word ', CAST(l_quantity * 3 AS INTEGER)))) AS fd,
         'To place part ' || CAST(l_partkey AS VARCHAR) AS ld
  FROM lineitem),
per AS (
  SELECT l_orderkey, count(*) AS n,
    string_agg(fn, '~$~' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS frame_names,
    string_agg(fd, '~$~' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS frame_defs,
    string_agg(ld, '~$~' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS lu_defs
  FROM lines GROUP BY l_orderkey),
crows AS (
  SELECT o_orderkey AS id,
    concat_ws(' ', 'Customer', CAST(o_custkey AS VARCHAR), 'placed', 'an', lower(o_orderpriority), 'order') AS sentence,
    'place.' || {lst(fixed.PART_POS)}[o_orderkey % 5 + 1] AS lu_name, 3 AS lu_head_position,
    lu_defs, frame_names, frame_defs, CAST(o_orderkey % n AS INTEGER) AS label
  FROM orders JOIN per ON o_orderkey = l_orderkey),
cx AS (
  SELECT id AS example_id, sentence AS text_a, lu_head_position - 1 AS predicate_position, label,
         len(string_split(frame_defs, '~$~')) AS n_choice,
         unnest(string_split(frame_defs, '~$~')) AS text_b, generate_subscripts(string_split(frame_defs, '~$~'), 1) - 1 AS choice_idx
  FROM crows),
ctext AS (
  SELECT example_id, choice_idx, lower(text_a) AS text_a, predicate_position, n_choice, label,
    array_to_string(CASE WHEN regexp_replace(lower(text_b), '^\s+|\s+$', '', 'g') = '' THEN []::VARCHAR[]
         ELSE string_split_regex(regexp_replace(lower(text_b), '^\s+|\s+$', '', 'g'), '\s+') END[1:100], ' ') AS text_b
  FROM cx),
cw AS (
  SELECT *, string_split_regex(regexp_replace(text_a, '^\s+|\s+$', '', 'g'), '\s+') AS a,
            CASE WHEN regexp_replace(text_b, '^\s+|\s+$', '', 'g') = '' THEN []::VARCHAR[]
                 ELSE string_split_regex(regexp_replace(text_b, '^\s+|\s+$', '', 'g'), '\s+') END AS b
  FROM ctext),
cf AS (
  SELECT *, greatest(64 - 3 - len(a), 0) AS room FROM cw),
cf2 AS (
  SELECT example_id, choice_idx, n_choice, len(b) > room AS cropped,
         ['[CLS]'] || a || ['[SEP]'] || b[1:room] || ['[SEP]'] AS inp, a[predicate_position + 1] AS pw
  FROM cf),
feats AS (
  SELECT example_id, choice_idx, n_choice, cropped, CAST(len(inp) AS INTEGER) AS n_real,
         CAST(CASE WHEN cropped THEN 0 ELSE coalesce(list_position(inp, pw), 0) - 1 END AS INTEGER) AS choice_position
  FROM cf2)"""


def _choice_rows_sql():
    return CHOICE_ROWS.replace("{MAX_LEN}", "64")


SQL.update({
    "frame_lu_defs": with_blocks(PART_LUS) + "SELECT frame_name, lu, lu_def, lu_no_pos FROM fld",
    "frame_info": with_blocks(PART_LUS) + """,
fe AS (SELECT DISTINCT concat_ws('/', p_type, CAST(p_size AS VARCHAR)) AS name, 'FE_' || replace(p_brand, '#', '') AS fe FROM part),
fes AS (SELECT name, CAST(count(*) AS INTEGER) AS num_elements, array_to_string(list_sort(list(fe)), '|') AS fe_names FROM fe GROUP BY name),
nl AS (SELECT frame_name AS name, count(*) AS n_lus FROM fld GROUP BY frame_name)
SELECT name, num_elements, n_lus, fe_names FROM fes JOIN nl USING (name)""",
    "sample_negatives": with_blocks(PART_LUS) + """,
ex AS (SELECT frame_name, lu, string_split(lu, '.')[-1] AS pos FROM fld),
c AS (
  SELECT e.frame_name, e.lu, d.frame_name AS neg_frame, d.lu AS neg_lu,
         md5('0|' || d.frame_name || '|' || d.lu) AS rk,
         CASE WHEN d.frame_name = e.frame_name AND ends_with(d.lu, e.pos) THEN 1
              WHEN d.frame_name = e.frame_name THEN 2 WHEN ends_with(d.lu, e.pos) THEN 3 ELSE 4 END AS tier
  FROM ex e JOIN fld d ON d.lu <> e.lu),
r AS (SELECT *, row_number() OVER (PARTITION BY frame_name, lu ORDER BY tier, rk, neg_frame, neg_lu) - 1 AS rank FROM c)
SELECT frame_name, lu, neg_frame, neg_lu, CAST(tier AS INTEGER) AS tier, CAST(rank AS INTEGER) AS rank FROM r WHERE rank < 4""",
    "split_files": f"""
SELECT source, CASE WHEN source IN ({", ".join(q(x) for x in fixed.DEV_SOURCES)}) THEN 'dev'
                    WHEN source IN ({", ".join(q(x) for x in fixed.TEST_SOURCES)}) THEN 'test' ELSE 'train' END AS split,
       count(*) AS n_docs
FROM documents GROUP BY source""",
    "choice_examples": with_blocks(_choice_rows_sql()) + """
SELECT example_id, CAST(choice_idx AS INTEGER) AS choice_idx, md5(concat_ws('|', text_a, text_b)) AS text_md5,
       CAST(n_choice AS INTEGER) AS n_choice, CAST(predicate_position AS INTEGER) AS position, label FROM cx""",
    "choice_text": with_blocks(_choice_rows_sql()) + "SELECT example_id, CAST(choice_idx AS INTEGER) AS choice_idx, text_a, text_b FROM ctext",
    "choice_features": with_blocks(_choice_rows_sql()) + """,
ep AS (SELECT example_id, CASE WHEN min(choice_position) = max(choice_position) THEN min(choice_position) ELSE 0 END AS position,
              least(any_value(n_choice), 15) AS n_kept FROM feats GROUP BY example_id)
SELECT example_id, CAST(choice_idx AS INTEGER) AS choice_idx, n_real, cropped, choice_position,
       CAST(position AS INTEGER) AS position, CAST(n_kept AS INTEGER) AS n_kept FROM feats JOIN ep USING (example_id)""",
    "choice_crop_count": with_blocks(_choice_rows_sql()) + "SELECT count_if(cropped) AS n_cropped, count(*) AS n_pairs FROM feats",
    "eval_single_choice": with_blocks(_choice_rows_sql()) + """
SELECT id AS example_id, string_split(lu_name, '.')[-1] AS lu_pos FROM crows WHERE len(string_split(frame_names, '~$~')) = 1""",
    "choice_csv": with_blocks(_choice_rows_sql()) + "SELECT id, CAST(len(string_split(frame_defs, '~$~')) AS INTEGER) AS n_choice, label FROM crows",
})

ANNS = GRAMS + """,
vlu AS (SELECT variant AS v_key, frame AS v_frame, min(lu) AS v_lu FROM variants GROUP BY variant, frame),
an1 AS (
  SELECT md5(concat_ws(':', sent_id, CAST(tok_idx AS VARCHAR), CAST(n AS VARCHAR))) AS ann_id, sent_id, g_frame AS frame_name, v_lu AS lu_name,
    CASE WHEN lower(n2_t) = lower(last_t) THEN [{'start': start, 'end': "end"}, {'start': n2_s, 'end': n2_e}]
         ELSE [{'start': start, 'end': "end"}] END AS target_spans,
    CASE WHEN n_s IS NOT NULL THEN [{'start': p_s, 'end': p_e, 'name': 'Agent'}, {'start': n_s, 'end': n_e, 'name': 'Theme'}]
         ELSE [{'start': p_s, 'end': p_e, 'name': 'Agent'}] END AS fe_spans
  FROM ang LEFT JOIN vlu ON ang.gram = vlu.v_key AND ang.g_frame = vlu.v_frame),
anns AS (
  SELECT *, list_min(list_transform(target_spans, lambda s: s.start)) AS t_start,
            list_max(list_transform(target_spans, lambda s: s."end")) AS t_end FROM an1),
fer AS (
  SELECT ann_id, sent_id, t_start, t_end, f.name AS fe_name, f.start AS start, f."end" AS "end"
  FROM (SELECT ann_id, sent_id, t_start, t_end, unnest(fe_spans) AS f FROM anns)
  WHERE f.start IS NOT NULL AND f."end" IS NOT NULL),
t0a AS (SELECT sent_id, start AS ts, "end" AS te, tok_idx FROM toks WHERE pass = 0)"""


def _align_sql(s: str, e: str, alias: str) -> str:
    return (f"(SELECT CAST(t.tok_idx AS INTEGER) FROM t0a t WHERE t.sent_id = {alias}.sent_id AND t.ts <= {s} AND {s} < t.te)")


ANN_BLOCKS = (SENTS, TOKS, LEX, ANNS)
FIX_FRAMES = sorted({f for _, f in fixed.FIXTURE_LUS})

SQL.update({
    "target_spans": with_blocks(*ANN_BLOCKS) + """
SELECT ann_id, len(target_spans) AS n_parts,
       array_to_string(list_transform(target_spans, lambda s: concat_ws('-', CAST(s.start AS VARCHAR), CAST(s."end" AS VARCHAR))), ';') AS spans
FROM anns""",
    "target_merged": with_blocks(*ANN_BLOCKS) + 'SELECT ann_id, t_start AS start, t_end AS "end" FROM anns',
    "fe_spans": with_blocks(*ANN_BLOCKS) + """
SELECT ann_id, len(fe_spans) AS n_fes,
       array_to_string(list_transform(fe_spans, lambda s: concat_ws(':', s.name, coalesce(CAST(s.start AS VARCHAR), 'none'),
                                                                     coalesce(CAST(s."end" AS VARCHAR), 'none'))), ';') AS fes
FROM anns""",
    "fe_rows": with_blocks(*ANN_BLOCKS) + f""",
al3 AS (SELECT r.*, {_align_sql('r.start', 'r."end"', 'r')} AS first,
               {_align_sql('r."end" - 1', '', 'r')} AS last_,
               {_align_sql('r.t_start', '', 'r')} AS t_first,
               {_align_sql('r.t_end - 1', '', 'r')} AS t_last_ FROM fer r)
SELECT ann_id, fe_name, start, "end", first, coalesce(last_, first) AS last, t_first, coalesce(t_last_, t_first) AS t_last FROM al3""",
    "os_prepare": with_blocks(*ANN_BLOCKS, PART_LUS) + f""",
fr AS (SELECT name AS f_name, array_to_string(list_sort(list(DISTINCT fe)), '|') AS frame_fes
       FROM (SELECT concat_ws('/', p_type, CAST(p_size AS VARCHAR)) AS name, 'FE_' || replace(p_brand, '#', '') AS fe FROM part) GROUP BY name
       UNION ALL SELECT f_name, 'Agent|Theme' FROM {values([(f,) for f in FIX_FRAMES], 'f_name')}),
dfs AS (SELECT d_lu, d_frame, 'Definition of ' || d_lu AS lu_definition FROM {values(fixed.FIXTURE_LUS, 'd_lu, d_frame')}
        UNION ALL SELECT lu, frame_name, lu_def FROM fld),
osr AS (SELECT ann_id, frame_name, lu_name, len(fe_spans) AS n_fes FROM anns
        UNION ALL SELECT DISTINCT md5(concat_ws(':', 'part', frame_name, lu)), frame_name, lu, 0 FROM plu)
SELECT ann_id, frame_name, lu_name, lu_definition, frame_fes
FROM osr LEFT JOIN fr ON osr.frame_name = fr.f_name
LEFT JOIN dfs ON osr.frame_name = dfs.d_frame AND osr.lu_name = dfs.d_lu
WHERE osr.frame_name <> 'Time_vector'""",
})
SQL["os_lookup_misses"] = SQL["os_prepare"].replace(
    "SELECT ann_id, frame_name, lu_name, lu_definition, frame_fes",
    "SELECT count_if(lu_definition IS NULL) AS n_missing, count(*) AS n")
SQL["os_stage"] = SQL["os_prepare"].split("SELECT ann_id, frame_name, lu_name, lu_definition, frame_fes")[0] + (
    "SELECT frame_name, count(*) AS n, CAST(sum(n_fes) AS BIGINT) AS n_fes FROM osr GROUP BY frame_name")

from ..functions.text import TOKEN_PATTERN  # noqa: E402

SCORE = r"""
items AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS item_no FROM benchmark),
ni AS (SELECT count(*) AS n FROM benchmark),
pairs0 AS (SELECT doc_id, CAST(doc_id % 5 + 1 AS INTEGER) AS n_choice, unnest(range(0, CAST(doc_id % 5 + 1 AS INTEGER))) AS choice_idx FROM documents),
pairs AS (SELECT p.doc_id AS example_id, p.choice_idx, i.item_id AS def_id, CAST(p.doc_id % p.n_choice AS INTEGER) AS label
          FROM pairs0 p, ni JOIN items i ON i.item_no = (p.doc_id * 7 + p.choice_idx) % ni.n),
dt AS (SELECT id, term, count(*) AS tf FROM (SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark) GROUP BY id, term),
idf AS (SELECT term, ln((SELECT n FROM ni) / count(*)) AS idf FROM dt GROUP BY term),
dw AS (SELECT id AS def_id, term, tf * idf AS wd FROM dt JOIN idf USING (term)),
dn AS (SELECT def_id, sqrt(sum(wd * wd)) AS nd FROM dw GROUP BY def_id),
ct AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY id, term),
cw AS (SELECT id AS example_id, term, tf * idf AS wc FROM ct JOIN idf USING (term)),
cn AS (SELECT example_id, sqrt(sum(wc * wc)) AS nc FROM cw GROUP BY example_id),
dot AS (SELECT p.example_id, p.choice_idx, sum(wc * wd) AS dot FROM pairs p JOIN cw USING (example_id)
        JOIN dw ON dw.def_id = p.def_id AND dw.term = cw.term GROUP BY p.example_id, p.choice_idx),
sc AS (SELECT p.example_id, p.choice_idx, p.def_id, p.label,
         CASE WHEN coalesce(nc, 0) = 0 OR coalesce(nd, 0) = 0 THEN 0.0 ELSE coalesce(dot, 0.0) / (nc * nd) END AS logit
       FROM pairs p LEFT JOIN dot USING (example_id, choice_idx) LEFT JOIN cn USING (example_id) LEFT JOIN dn USING (def_id))"""

SQL.update({
    "choice_tfidf": with_blocks(SCORE) + """
SELECT example_id AS doc_id, CAST(choice_idx AS INTEGER) AS choice_idx, def_id AS item_id, round(logit, 6) AS score FROM sc""",
    "frame_identify": with_blocks(SCORE) + """,
s2 AS (SELECT example_id, choice_idx, label, round(logit, 9) AS logit FROM sc),
pr AS (SELECT example_id, arg_max(choice_idx, struct_pack(a := logit, b := -choice_idx)) AS pred, any_value(label) AS label
       FROM s2 GROUP BY example_id)
SELECT round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM pr""",
    "pad_global": f"""
WITH per AS (SELECT item_id, CAST(len(regexp_extract_all(text, '{TOKEN_PATTERN}')) AS BIGINT) AS n_real FROM benchmark
             WHERE len(regexp_extract_all(text, '{TOKEN_PATTERN}')) > 0)
SELECT item_id, n_real, (SELECT max(n_real) FROM per) AS n_total, (SELECT max(n_real) FROM per) - n_real AS n_pad FROM per""",
    "stage_roundtrip": with_blocks(SENTS, TOKS) + """
SELECT sent_id, start, "end" FROM toks WHERE pass = 0""",
    "feature_cache": with_blocks(SENTS, TOKS) + """
SELECT sent_id, count(*) AS n_tokens, TRUE AS reused FROM toks WHERE pass = 0 GROUP BY sent_id""",
})

SQL["stream_tagger"] = with_blocks(*CAND, recursive=True) + """
SELECT lu, count(*) AS n_hits FROM lu_hits JOIN sents USING (sent_id) GROUP BY lu"""

SQL.update({
    "src_frame_xml": with_blocks(PART_LUS) + """,
fe AS (SELECT DISTINCT concat_ws('/', p_type, CAST(p_size AS VARCHAR)) AS name, 'FE_' || replace(p_brand, '#', '') AS fe,
              'Brand ' || p_brand AS fe_def FROM part),
fes AS (SELECT name, CAST(count(*) AS INTEGER) AS num_elements, array_to_string(list_sort(list(fe)), '|') AS fe_names,
               array_to_string(list_sort(list(fe_def)), '|') AS fe_defs FROM fe GROUP BY name),
nl AS (SELECT frame_name AS name, CAST(count(*) AS INTEGER) AS n_lus FROM fld GROUP BY frame_name)
SELECT name, 'Frame ' || name || ' moves.' AS definition, num_elements, coalesce(n_lus, 0) AS n_lus, fe_names, fe_defs
FROM fes LEFT JOIN nl USING (name)""",
    "src_lu_index": with_blocks(LEX) + "SELECT name, frame FROM lus",
    "src_fulltext_xml": with_blocks(*ANN_BLOCKS) + """
SELECT ann_id, sent_id, frame_name, lu_name,
       array_to_string(list_transform(target_spans, lambda s: concat_ws('-', CAST(s.start AS VARCHAR), CAST(s."end" AS VARCHAR))), ';') AS targets,
       t_start AS start, t_end AS "end", len(fe_spans) AS n_fes
FROM anns""",
})

SQL.update({
    "choice_split_read": with_blocks(_choice_rows_sql()) + """
SELECT c.id, 'dev' AS split, CAST(len(string_split(frame_defs, '~$~')) AS INTEGER) AS n_choice, label
FROM crows c JOIN orders o ON c.id = o.o_orderkey WHERE o.o_orderstatus = 'O'""",
    "choice_nested": with_blocks(_choice_rows_sql()) + """
SELECT example_id, count(*) AS n, string_agg(CAST(n_real AS VARCHAR), ',' ORDER BY choice_idx) AS n_real
FROM feats GROUP BY example_id""",
})

SQL["cand_subsumed"] = with_blocks(*CAND, recursive=True) + """,
longest AS (SELECT sent_id, start, max("end") AS "end" FROM cands GROUP BY sent_id, start),
ord AS (SELECT sent_id, start, "end", row_number() OVER (PARTITION BY sent_id ORDER BY start) AS rn FROM longest),
sweep AS (
  SELECT sent_id, rn, "end" AS last_end, start AS k_start, "end" AS k_end FROM ord WHERE rn = 1
  UNION ALL
  SELECT o.sent_id, o.rn, CASE WHEN o.start > s.last_end THEN o."end" ELSE s.last_end END,
         CASE WHEN o.start > s.last_end THEN o.start END, CASE WHEN o.start > s.last_end THEN o."end" END
  FROM sweep s JOIN ord o ON o.sent_id = s.sent_id AND o.rn = s.rn + 1)
SELECT k.sent_id, k_start AS start, k_end AS "end", array_to_string(frames, '|') AS frames
FROM sweep k JOIN cands c ON c.sent_id = k.sent_id AND c.start = k_start AND c."end" = k_end"""


def _word_nodes(lus: str) -> str:
    """Lexicon blocks over ``lus`` (key, frame): plain words, no variants."""
    return f"""
{lus},
pats AS (SELECT key, string_split(key, ' ') AS words, len(string_split(key, ' ')) AS n, [frame] AS frames FROM plain),
pre AS (SELECT array_to_string(words[1:k], ' ') AS key, k AS depth, k < n AS child
        FROM (SELECT words, n, unnest(range(1, n + 1)) AS k FROM pats)),
nodes AS (SELECT p.key, max(p.depth) AS depth, bool_or(p.child) AS has_children, coalesce(any_value(t.frames), []::VARCHAR[]) AS frames
          FROM pre p LEFT JOIN pats t ON p.key = t.key GROUP BY p.key),
spell AS (SELECT '' AS variant, '' AS root, TRUE AS to_us WHERE FALSE)"""


MINED = _word_nodes("""
gw AS (SELECT sent_id, tok_idx, text AS w1, lead(text) OVER w AS w2, lead(text, 2) OVER w AS w3 FROM toks WHERE pass = 1
       WINDOW w AS (PARTITION BY sent_id ORDER BY tok_idx)),
grams AS (SELECT w1 || ' ' || w2 AS key, w1 FROM gw WHERE regexp_full_match(w1, '[a-z]+') AND regexp_full_match(w2, '[a-z]+')
          UNION ALL SELECT w1 || ' ' || w2 || ' ' || w3, w1 FROM gw
          WHERE regexp_full_match(w1, '[a-z]+') AND regexp_full_match(w2, '[a-z]+') AND regexp_full_match(w3, '[a-z]+')),
plain AS (SELECT key, 'Gram_' || any_value(w1) AS frame FROM grams GROUP BY key HAVING count(*) >= 5)""")

PLURAL = _word_nodes("""
w AS (SELECT DISTINCT text FROM toks WHERE pass = 1 AND regexp_full_match(text, '[a-z]{3,}')),
plurals AS (SELECT a.text AS word, b.text AS form FROM w a JOIN w b ON b.text = a.text || 's'),
plain AS (SELECT word AS key, 'Word_' || word AS frame FROM plurals)""")
#: The walk with the derived alias and override tables in place of the lists.
PLURAL_WALK = WALK.replace(f"al AS (SELECT * FROM {values(fixed.ALIASES, 'a_form, a_word')})",
                           "al AS (SELECT form AS a_form, word AS a_word FROM plurals)").replace(
    f"ovr AS (SELECT * FROM {values(fixed.OVERRIDES, 'o_lemma, o_pos, o_lu, extra')})",
    "ovr AS (SELECT form AS o_lemma, 'X' AS o_pos, word AS o_lu, 2 AS extra FROM plurals)")


def _view_sql(view: str) -> str:
    return with_blocks(SENTS, TOKS, ANN, PLURAL, PLURAL_WALK, recursive=True) + f""",
vh AS (SELECT DISTINCT sent_id, start, "end", lu FROM cand_rows WHERE view = '{view}')
""" + HIT_STATS.replace("lu_hits", "vh") + " GROUP BY lu"


SQL.update({
    "cand_alias": _view_sql("alias"),
    "cand_override": _view_sql("override"),
    "mined_nodes": with_blocks(SENTS, TOKS, MINED) + """
SELECT CAST(depth AS INTEGER) AS depth, count(*) AS n_nodes, count_if(has_children) AS n_inner, count_if(len(frames) > 0) AS n_terminal
FROM nodes GROUP BY depth""",
    "cand_mined": with_blocks(SENTS, TOKS, ANN, MINED, WALK, recursive=True) + HIT_STATS + " GROUP BY lu",
    "cand_dependency": with_blocks(SENTS, TOKS, ANN, MINED, recursive=True) + """,
hd AS (SELECT *, CASE WHEN tok_idx = 0 THEN NULL WHEN tok_idx % 2 = 1 THEN tok_idx - 1 ELSE tok_idx // 2 END AS head FROM ann),
anc AS (
  SELECT sent_id, pass, tok_idx, head AS at FROM hd WHERE head IS NOT NULL AND lemma IN (SELECT key FROM nodes WHERE depth = 1 AND has_children)
  UNION ALL
  SELECT a.sent_id, a.pass, a.tok_idx, h.head FROM anc a JOIN hd h ON h.sent_id = a.sent_id AND h.pass = a.pass AND h.tok_idx = a.at
  WHERE h.head IS NOT NULL),
near AS (SELECT * FROM anc UNION SELECT sent_id, pass, head, tok_idx FROM hd WHERE head IS NOT NULL),
lu_hits AS (
  SELECT DISTINCT m.sent_id, least(m.start, o.start) AS start, CASE WHEN m.start < o.start THEN o."end" ELSE m."end" END AS "end", p.key AS lu
  FROM near n JOIN hd m ON m.sent_id = n.sent_id AND m.pass = n.pass AND m.tok_idx = n.tok_idx
  JOIN hd o ON o.sent_id = n.sent_id AND o.pass = n.pass AND o.tok_idx = n.at
  JOIN pats p ON p.n = 2 AND p.key = m.lemma || ' ' || o.lemma
  WHERE m.start <> o.start)
""" + HIT_STATS + """ WHERE "end" > start GROUP BY lu""",
})


def _token_id(w: str) -> str:
    return (f"CASE WHEN {w} = '[CLS]' THEN 1 WHEN {w} = '[SEP]' THEN 2 "
            f"ELSE 3 + CAST('0x' || substr(md5({w}), 1, 8) AS BIGINT) % 29997 END")


def _dense_sql(max_choice: int, left: bool) -> str:
    def pad(values: str) -> str:
        filler = f"list_transform(range(0, 64 - len(inp)), lambda x: 0)"
        return f"{filler} || {values}" if left else f"{values} || {filler}"

    def matrix(name: str) -> str:
        zero = ",".join(["0"] * 64)
        lines = f"list({name} ORDER BY choice_idx) FILTER (WHERE choice_idx < {max_choice})"
        return (f"md5(array_to_string(list_transform({lines}, lambda r: array_to_string(r, ',')) || "
                f"list_transform(range(0, greatest(0, {max_choice} - count(*))), lambda x: '{zero}'), ';')) AS {name}_md5")

    return with_blocks(_choice_rows_sql()) + f""",
rowsd AS (
  SELECT c.example_id, c.choice_idx, c.n_choice, x.label,
         {pad(f"list_transform(inp, lambda w: {_token_id('w')})")} AS input_ids,
         {pad("list_transform(inp, lambda w: 1)")} AS attention_mask,
         {pad("list_transform(range(1, len(inp) + 1), lambda i: CASE WHEN i > len(inp) - len(b_kept) - 1 THEN 1 ELSE 0 END)")} AS segment_ids,
         CASE WHEN cropped THEN 0 ELSE coalesce(list_position(inp, pw), 0) - 1 END AS choice_position
  FROM (SELECT *, inp[(list_position(inp, '[SEP]') + 1):(len(inp) - 1)] AS b_kept FROM cf2) c JOIN cx x USING (example_id, choice_idx))
SELECT example_id, CAST(any_value(n_choice) AS INTEGER) AS n_choice, CAST(least(any_value(n_choice), {max_choice}) AS INTEGER) AS n_kept,
       CAST(CASE WHEN min(choice_position) = max(choice_position) THEN min(choice_position) ELSE 0 END AS INTEGER) AS position,
       max(label) AS label, {max_choice} AS n_rows, {matrix('input_ids')}, {matrix('attention_mask')}, {matrix('segment_ids')}
FROM rowsd GROUP BY example_id"""


FILTER = """
slab AS (SELECT a.sent_id, a.first, a.last, max(l.label) AS label
         FROM lab l JOIN aligned a ON l.sent_id = a.sent_id AND l.start = a.start AND l."end" = a."end"
         WHERE a.first IS NOT NULL GROUP BY a.sent_id, a.first, a.last),
hold AS (SELECT sent_id, max(CASE WHEN source IN ({held}) THEN 1 ELSE 0 END) AS held
         FROM sents JOIN documents USING (doc_id) GROUP BY sent_id),
fs AS (SELECT s.*, h.held, s.last - s.first + 1 AS width, coalesce(f.text, '') AS first_tok, coalesce(g.text, '') AS last_tok
       FROM slab s JOIN hold h USING (sent_id)
       LEFT JOIN toks f ON f.sent_id = s.sent_id AND f.pass = 0 AND f.tok_idx = s.first
       LEFT JOIN toks g ON g.sent_id = s.sent_id AND g.pass = 0 AND g.tok_idx = s.last),
fb AS (SELECT *, {buckets} FROM fs),
tot AS (SELECT sum(label) AS pos, count(*) - sum(label) AS neg FROM fb WHERE held = 0),
{models},
sm AS (SELECT unnest([1.0::DOUBLE, 0.1::DOUBLE]) AS alpha),
sco AS (SELECT fb.*, alpha, ln((pos + alpha) / (neg + alpha)) + {terms} AS logit
        FROM fb, tot, sm {joins} WHERE held = 1),
pr AS (SELECT *, CASE WHEN logit > 0 THEN 1 ELSE 0 END AS pred FROM sco),
f1 AS (SELECT alpha, CASE WHEN 2 * count_if(pred = 1 AND label = 1) + count_if(pred <> label) = 0 THEN 0.0
                          ELSE 2.0 * count_if(pred = 1 AND label = 1) / (2 * count_if(pred = 1 AND label = 1) + count_if(pred <> label)) END AS f1
       FROM pr GROUP BY alpha),
win AS (SELECT alpha FROM f1 ORDER BY f1 DESC, alpha DESC LIMIT 1)
SELECT sent_id, first, last, CAST(label AS INTEGER) AS label, round(1 / (1 + exp(-logit)), 6) AS p1, pred
FROM pr JOIN win USING (alpha)"""


def _filter_sql() -> str:
    names = ("width", "first_tok", "last_tok")
    buckets = ", ".join(f"CAST('0x' || substr(md5('{c}=' || CAST({c} AS VARCHAR)), 1, 8) AS BIGINT) % 4096 AS b_{c}" for c in names)
    models = ",\n".join(f"m_{c} AS (SELECT b_{c}, sum(label) AS p, count(*) - sum(label) AS n FROM fb WHERE held = 0 GROUP BY b_{c})" for c in names)
    terms = " + ".join(f"(ln((coalesce(m_{c}.p, 0) + alpha) / (pos + alpha * 4096)) - ln((coalesce(m_{c}.n, 0) + alpha) / (neg + alpha * 4096)))"
                       for c in names)
    joins = " ".join(f"LEFT JOIN m_{c} ON m_{c}.b_{c} = fb.b_{c}" for c in names)
    held = ", ".join(q(x) for x in fixed.DEV_SOURCES + fixed.TEST_SOURCES)
    return with_blocks(*CAND, GOLD, FILTER.format(buckets=buckets, models=models, terms=terms, joins=joins, held=held).split("SELECT sent_id, first, last, CAST")[0].rstrip(),
                       recursive=True) + "SELECT sent_id, first, last, CAST" + FILTER.split("SELECT sent_id, first, last, CAST")[1]


def _lines_sql(source: str, order: str, line: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY {order}) - 1 AS line_no, {line} AS line FROM ({source})"


SQL.update({
    "choice_dense": _dense_sql(4, False),
    "choice_dense_left": _dense_sql(8, True),
    "choice_questions": with_blocks(_choice_rows_sql()) + """
SELECT x.example_id, CAST(x.choice_idx AS INTEGER) AS choice_idx, string_split(r.lu_defs, '~$~')[x.choice_idx + 1] AS question,
       md5(x.text_b) AS text_md5
FROM cx x JOIN crows r ON r.id = x.example_id""",
    "choice_splits": with_blocks(_choice_rows_sql()) + """
SELECT c.id, CASE o.o_orderstatus WHEN 'O' THEN 'dev' WHEN 'P' THEN 'test' ELSE 'train' END AS split,
       CAST(len(string_split(frame_defs, '~$~')) AS INTEGER) AS n_choice, CASE WHEN o.o_orderstatus = 'P' THEN NULL ELSE label END AS label
FROM crows c JOIN orders o ON c.id = o.o_orderkey""",
    "pad_rows": f"""
WITH t AS (SELECT item_id, list_filter(regexp_extract_all(text, '{PIECE_PATTERN}'), lambda x: NOT regexp_matches(x, '^\\s')) AS w FROM benchmark),
per AS (SELECT item_id, w, len(w) AS n_real, max(len(w)) OVER () AS n_total FROM t WHERE len(w) > 0)
SELECT item_id, n_real, n_total,
       md5(array_to_string(list_transform(w, lambda x: {_token_id('x')}) || list_transform(range(0, n_total - n_real), lambda i: 0), ',')) AS ids_md5,
       md5(array_to_string(list_transform(w, lambda x: 1) || list_transform(range(0, n_total - n_real), lambda i: 0), ',')) AS mask_md5,
       md5(array_to_string(list_transform(range(0, n_total), lambda i: 1), ',')) AS mask1_md5
FROM per""",
    "pred_files": _lines_sql(SQL["choice_argmax"], "example_id", "CAST(pred AS VARCHAR)"),
    "prob_files": _lines_sql(SQL["sink_pred_lines"], "example_id", "split_part(line, chr(9), 2)"),
    "report_file": _lines_sql(SQL["metrics_report"], "key", "line"),
    "fulltext_rows": with_blocks(*ANN_BLOCKS) + """,
nm AS (SELECT *, CAST('0x' || substr(ann_id, 1, 1) AS INTEGER) AS number FROM anns)
SELECT ann_id, CASE WHEN number < 2 THEN 'test' WHEN number < 5 THEN 'dev' ELSE 'train' END AS split, frame_name,
       CAST(len(target_spans) AS INTEGER) AS n_targets
FROM nm WHERE number < 15""",
    "filter_predictions": _filter_sql(),
})

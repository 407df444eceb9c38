"""Candidate generation: every span that matches a lexicon pattern.

The walk through the pattern tree is a fixed number of hash-join levels (``Lmax`` = longest pattern): level 1 joins start words
to root nodes, level k looks up ``path + ' ' + word`` (literal child) and
``path + ' <POS>'`` (wildcard child), literal preferred. Every node with
frames that the walk passes is emitted, so the result for a start is all
terminal prefixes of the walked path. The node table is broadcast only
after a size check; otherwise the levels are shuffle joins.

Views (order of lookups per token):
  surface  start = text,                         walk = text
  lemma    start = lemma,                        walk = lemma
  stem     start = stem,                         walk = stem
  alias    start = alias(text),                  walk = text
  spelling start = each root of the other spelling of text|lemma|stem
           (American and British direction apart), walk = stem
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import fixed
from ..plans.joins import broadcast_measured, threshold_bytes
from ..session import scratch_path
from . import corpus, lexicon


#: Bits of the views that start with one word.
SURFACE, LEMMA, STEM, ALIAS, OVERRIDE, SPELLING = 1, 2, 4, 8, 16, 32
_READ = ("text", "lemma", "stem", "pos", "end")


def _with_next(toks: DataFrame, lmax: int) -> DataFrame:
    """Adds ``nx``, the next ``lmax-1`` tokens, where the tokens do not carry
    them: one struct-valued ``lead`` per offset."""
    if "nx" in toks.columns:
        return toks
    w = Window.partitionBy("sent_id", "pass").orderBy("tok_idx")
    nxt = F.struct(*_READ)
    return toks.withColumn("nx", F.slice(F.array(nxt, *[F.lead(nxt, k).over(w) for k in range(1, lmax)]), 2, max(lmax - 1, 0)))


def _starts(toks: DataFrame, lex: "lexicon.Compiled") -> DataFrame:
    """One row per token and start word, with the views that start there as
    bits; the override view (L20) is a start that does not walk and ends
    ``extra`` chars later (not on the first token of the first pass)."""
    # the alias and override tables are fixed lists of a few entries:
    # CASE expressions, not joins; a user's tables are joined
    a_word = F.lit(None).cast("string")
    o_lu, o_extra = F.lit(None).cast("string"), F.lit(None).cast("int")
    not_first = ~((F.col("pass") == 0) & (F.col("tok_idx") == 0))
    t = toks
    if lex.aliases is None:
        for form, word in reversed(fixed.ALIASES):
            a_word = F.when(F.col("text") == form, F.lit(word)).otherwise(a_word)
    else:
        t, a_word = _look_up(t, lex.aliases, lex.sizes["aliases"], "text", {"form": "_al", "word": "_aw"}), F.col("_aw")
    if lex.overrides is None:
        for lem, pos, lu, extra in reversed(fixed.OVERRIDES):
            hit = (F.col("lemma") == lem) & (F.col("pos") == pos) & not_first
            o_lu = F.when(hit, F.lit(lu)).otherwise(o_lu)
            o_extra = F.when(hit, F.lit(extra)).otherwise(o_extra)
    else:
        t = _look_up(t, lex.overrides, lex.sizes["overrides"], "lemma", {"lemma": "_ol", "pos": "_op", "lu": "_ou", "extra": "_oe"},
                     lambda t, ov: (t["pos"] == ov["_op"]) & not_first)
        o_lu, o_extra = F.col("_ou"), F.col("_oe")
    t = t.withColumns({"a_word": a_word, "o_lu": o_lu, "o_extra": o_extra})
    t, spelled = _spelled(t, lex)
    text, lemma, stem = F.col("text"), F.col("lemma"), F.col("stem")

    def same(x, y):
        return F.coalesce(x == y, F.lit(False))

    def start(kinds, first, end=F.col("end")):
        return F.struct(kinds.alias("kinds"), first.alias("first"), end.alias("end"))

    def bit(kind, cond):
        return F.when(cond, F.lit(kind)).otherwise(F.lit(0))

    # views that start with the same word look their root up once
    starts = F.array(
        start(F.lit(SURFACE) + bit(LEMMA, same(lemma, text)) + bit(STEM, same(stem, text)), text),
        start(F.lit(LEMMA) + bit(STEM, same(stem, lemma)), F.when(lemma != text, lemma)),
        start(F.lit(STEM), F.when(~same(stem, text) & ~same(stem, lemma), stem)),
        start(F.lit(ALIAS), F.col("a_word")),
        start(F.lit(OVERRIDE), F.col("o_lu"), (F.col("end") + F.col("o_extra")).cast("int")),
        *[start(F.lit(SPELLING), root) for root in spelled])
    keep = [*corpus.sentence_key(t), "pass", "start", "nx"]
    return (t.select(*keep, F.explode(starts).alias("v")).select(*keep, "v.kinds", "v.first", "v.end")
            .where(F.col("first").isNotNull()))


def _walks(met: DataFrame, read: bool, ahead: int, seconds: tuple[str, ...] | None = None) -> DataFrame:
    """Starts whose root is known, one row per walk: a view that walks the same
    words as an earlier one with the same start is walked once, with both
    labels. ``read``: the next tokens have their readings already; else they
    are read only where a longer pattern goes on (with one of ``seconds``)."""
    keep = [c for c in met.columns if c not in ("nx", "kinds")]
    nx = F.col("nx")
    if not read:
        second = corpus.stripped(F.get("nx", F.lit(0)))
        goes_on = F.col("c") if seconds is None else F.col("c") & corpus.may_be(second, seconds)
        lower, raw = F.col("pass") == 1, F.when(goes_on, nx)
        length = lambda k: F.coalesce(F.length(F.get("nx", F.lit(k))), F.lit(0))
        upto = lambda i: reduce(add, [F.when(i >= k, length(k)).otherwise(0) for k in range(ahead)], F.col("end"))
        # arrays of words, not of structs: a reading that nobody asks for is not made
        m = met.select(*keep, "kinds", F.transform(raw, lambda m: F.when(lower, F.lower(corpus.stripped(m))).otherwise(corpus.stripped(m))).alias("t"),
                       F.transform(raw, lambda m, i: upto(i)).alias("nx_end"))
        m = m.withColumn("_n", F.transform("t", corpus.number_name))
        reading = lambda r: F.transform("t", lambda w, i: corpus.readings(w, F.get("_n", i))[r])
        m = m.select(*keep, "kinds", "t", reading(0).alias("l"), reading(1).alias("s"), reading(2).alias("nx_pos"), "nx_end")
    else:
        m = met.select(*keep, "kinds", *[nx[c].alias(n) for c, n in (("text", "t"), ("lemma", "l"), ("stem", "s"), ("pos", "nx_pos"), ("end", "nx_end"))])
    t, l, s = F.col("t"), F.col("l"), F.col("s")
    has = lambda kind: F.col("kinds").bitwiseAND(F.lit(kind)) > 0
    lem_surf = has(SURFACE) & has(LEMMA) & l.eqNullSafe(t)
    stem_surf = has(SURFACE) & has(STEM) & s.eqNullSafe(t)
    stem_lem = has(LEMMA) & has(STEM) & s.eqNullSafe(l) & ~stem_surf

    def view(cond, labels, walk):
        return F.when(cond, F.struct(labels.alias("views"), walk.alias("walk")))

    def tag(name, cond):
        return F.when(cond, F.lit(name))

    views = F.array(
        view(has(SURFACE), F.concat_ws(",", F.lit("surface"), tag("lemma", lem_surf), tag("stem", stem_surf)), t),
        view(has(LEMMA) & ~lem_surf, F.concat_ws(",", F.lit("lemma"), tag("stem", stem_lem)), l),
        view(has(STEM) & ~stem_surf & ~stem_lem, F.lit("stem"), s),
        view(has(ALIAS), F.lit("alias"), t),
        view(has(OVERRIDE), F.lit("override"), F.lit(None).cast("array<string>")),
        view(has(SPELLING), F.lit("spelling"), s))
    return (m.select(*keep, "nx_pos", "nx_end", F.explode(views).alias("v"))
            .where(F.col("v").isNotNull()).select(*keep, "nx_pos", "nx_end", "v.views", "v.walk"))


def _spelled(t: DataFrame, lex: "lexicon.Compiled") -> tuple[DataFrame, list]:
    """Tokens with the roots of their other spelling, and the columns that
    hold them: as many for each direction as the compiled lexicon's longest
    root list, so none (and no join) when it has no spelling pair."""
    n_us, n_gb = lex.spelled
    names = [f"u{i}" for i in range(n_us)] + [f"g{i}" for i in range(n_gb)]
    if not names:
        return t, []
    lists = [F.try_element_at("us_roots", F.lit(i + 1)) for i in range(n_us)] + [F.try_element_at("gb_roots", F.lit(i + 1)) for i in range(n_gb)]
    key = [c for c in ("bucket",) if c in lex.spelling.columns]
    spell = lex.spelling.select(*key, "variant", *[c.alias(n) for n, c in zip(names, lists)])
    for src in ("text", "lemma", "stem"):
        t = _look_up(t, spell, lex.sizes["spelling"], src, {c: f"_{c}_{src}" for c in ("variant", *names)})

    def roots(letter, n):
        # the first of text, lemma and stem that has roots in this direction
        known = {src: F.col(f"_{letter}0_{src}").isNotNull() for src in ("text", "lemma")}
        return [F.when(known["text"], F.col(f"_{letter}{i}_text")).when(known["lemma"], F.col(f"_{letter}{i}_lemma"))
                .otherwise(F.col(f"_{letter}{i}_stem")) for i in range(n)]

    us, gb = roots("u", n_us), roots("g", n_gb)
    # a root that both directions give is walked once
    for i, g in enumerate(gb):
        for u in us:
            g = F.when(~F.coalesce(g == u, F.lit(False)), g)
        gb[i] = g
    return t, us + gb


def _look_up(t: DataFrame, table: DataFrame, n_bytes: int, word: str, names: dict[str, str], more=None, how: str = "left") -> DataFrame:
    """Rows with the entries of a lexicon table for their ``word``: its columns,
    as ``names`` calls them, the first of which is the word. A table that was
    dealt (:func:`dealt`) comes to the rows' buckets; the rows stay."""
    in_bucket = "bucket" in table.columns
    cols = [F.col(c).alias(n) for c, n in names.items()]
    s = table.select(F.col("bucket").alias("_bucket"), *cols).hint("shuffle_hash") if in_bucket else broadcast_measured(table.select(*cols), n_bytes)
    met = t[word] == s[next(iter(names.values()))]
    if in_bucket:
        met = met & (t["bucket"] == s["_bucket"])
    j = t.join(s, met if more is None else met & more(t, s), how)
    return j.drop("_bucket")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"{name}/{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _top_nodes(lex: "lexicon.Compiled") -> DataFrame:
    """The nodes where a walk may start: the roots, and the LUs that overrides name."""
    n = lex.nodes.select("key", "has_children", "depth", "terminal")
    if lex.overrides is None:
        return n.where((F.col("depth") == 1) | F.col("key").isin(*[r[2] for r in fixed.OVERRIDES]))
    named = lex.overrides.select(F.col("lu").alias("key")).distinct()
    return n.where("depth = 1").unionByName(n.where("depth > 1").join(named, "key", "left_semi"))


def dealt(toks: DataFrame, lex: "lexicon.Compiled") -> tuple["lexicon.Compiled", DataFrame]:
    """A lexicon too large to broadcast, and its top nodes, for tokens in
    buckets: each bucket gets the entries of the words that it holds. Only a
    bucket's distinct words are shuffled, and the entries found; no token is."""
    large_tops = lex.sizes["tops"] > threshold_bytes(toks.sparkSession)
    tops, sp, al, ov = _top_nodes(lex), lex.spelling, lex.aliases, lex.overrides
    if not (large_tops or any(lex.spelled) or al is not None or ov is not None):
        return lex, tops
    read = F.array_distinct(F.array("text", "lemma", "stem"))
    words = _written(toks.select("bucket", F.explode(read).alias("word")).where("word is not null").distinct(), "words")

    def entries(table, word):
        return _written(words.join(table, words["word"] == table[word]).select("bucket", *[table[c] for c in table.columns]), "dealt")

    also = [F.array(*[F.lit(r[-1]) for r in fixed.ALIASES])] if al is None else []
    also += [F.array(*[F.lit(r[2]) for r in fixed.OVERRIDES])] if ov is None else []
    started = words
    for a in also:
        started = started.unionByName(words.select("bucket").distinct().select("bucket", F.explode(a).alias("word")))
    if any(lex.spelled):
        sp = entries(sp, "variant")
        roots = F.array_union(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("us_roots", "gb_roots")])
        started = started.unionByName(sp.select("bucket", F.explode(roots).alias("word")))
    if al is not None:
        al = entries(al, "form")
        started = started.unionByName(al.select("bucket", "word"))
    if ov is not None:
        ov = entries(ov, "lemma")
        started = started.unionByName(ov.select("bucket", F.col("lu").alias("word")))
    if large_tops:
        started = started.distinct()
        tops = _written(started.join(tops, started["word"] == tops["key"]).select("bucket", *tops.columns), "dealt")
    return replace(lex, spelling=sp, aliases=al, overrides=ov), tops


def _met_paths(cur: DataFrame, lex: "lexicon.Compiled") -> DataFrame:
    """The nodes below the roots for walks in buckets: each bucket gets those
    that are the beginning of a walk in it. Beginnings are told by 64 bits; the
    nodes that these find carry their whole key."""
    path = lambda k: F.xxhash64(F.concat_ws(" ", F.col("n1"), F.slice("walk", 1, k)))
    paths = F.transform(F.sequence(F.lit(1), F.least(F.size("walk"), F.lit(lex.lmax - 1))), path)
    met = cur.where(F.col("c") & (F.size("walk") > 0)).select("bucket", F.explode(paths).alias("h")).distinct()
    below = lex.nodes.where("depth > 1").select(F.xxhash64("key").alias("_h"), "key", "has_children", "terminal")
    return _written(met.join(below, met["h"] == below["_h"]).select("bucket", "key", "has_children", "terminal").distinct(), "dealt")


def hits(toks: DataFrame, lex: "lexicon.Compiled") -> DataFrame:
    """Pattern walk over an annotated token table: ``(sent_id, pass, views,
    start, end, lu)``, one row per pattern that a walk passes; ``views`` names
    the views that walk there. Keys only: frames join later. Tokens in buckets
    keep their ``bucket``, and the lexicon is dealt to them."""
    lmax, sent = lex.lmax, corpus.sentence_key(toks)
    in_bucket = "bucket" in sent
    nds = tops = lex.nodes.select("key", "has_children", "depth", "terminal")
    if in_bucket:
        lex, tops = dealt(toks, lex)
    s = _starts(_with_next(toks, lmax), lex)
    # overrides carry no walk words, so they never go past level 1
    # a walk starts at a one-word root; only an override names a whole LU
    cur = (_look_up(s, tops, lex.sizes["tops" if in_bucket else "nodes"], "first", {"key": "n1", "has_children": "c", "terminal": "t1", "depth": "_depth"}, how="inner")
           .where((F.col("_depth") == 1) | (F.col("kinds") == OVERRIDE)).drop("first", "_depth"))
    cur = _walks(cur, "nx" not in toks.columns, lmax - 1, lex.seconds)
    if in_bucket and lmax > 1 and not lex.wild:
        nds = _met_paths(cur, lex)
    for k in range(1, lmax):
        node, nxt_w, nxt_p = F.col(f"n{k}"), F.get("walk", F.lit(k - 1)), F.get("nx_pos", F.lit(k - 1))
        live = F.col("c") & node.isNotNull() & nxt_w.isNotNull()
        cur = cur.withColumn("p_lit", F.when(live, F.concat_ws(" ", node, nxt_w)))
        key, c, t = F.col("l_key"), F.col("l_c"), F.col("l_t")
        if lex.wild:
            cur = cur.withColumn("p_pos", F.when(live, F.concat(node, F.lit(" <"), F.upper(nxt_p), F.lit(">"))))
        cur = _look_up(cur, nds, lex.sizes["nodes"], "p_lit", {"key": "l_key", "has_children": "l_c", "terminal": "l_t"})
        if lex.wild:
            cur = _look_up(cur, nds, lex.sizes["nodes"], "p_pos", {"key": "w_key", "has_children": "w_c", "terminal": "w_t"})
            known = F.col("l_key").isNotNull()
            key, c, t = F.coalesce("l_key", "w_key"), F.when(known, c).otherwise(F.col("w_c")), F.when(known, t).otherwise(F.col("w_t"))
        keep = [x for x in cur.columns if x not in ("p_lit", "p_pos", "l_key", "l_c", "l_t", "w_key", "w_c", "w_t", "c")]
        cur = cur.select(*keep, key.alias(f"n{k + 1}"), t.alias(f"t{k + 1}"), F.coalesce(c, F.lit(False)).alias("c"))
    visited = F.array(F.struct(F.col("end").alias("end"), F.when(F.col("t1"), F.col("n1")).alias("lu")),
                      *[F.struct(F.get("nx_end", F.lit(k - 1)).alias("end"), F.when(F.col(f"t{k + 1}"), F.col(f"n{k + 1}")).alias("lu"))
                        for k in range(1, lmax)])
    out = (cur.select(*sent, "pass", "views", "start", F.explode(visited).alias("v"))
           .where(F.col("v.lu").isNotNull())
           .select(*sent, "pass", "views", "start", F.col("v.end").alias("end"), F.col("v.lu").alias("lu")))
    if "head_idx" in toks.columns:
        out = out.unionByName(dependency_hits(toks, lex))
    return out.where(F.col("end") > F.col("start"))


def with_frames(rows: DataFrame, lex: "lexicon.Compiled") -> DataFrame:
    """Rows of a terminal pattern ``lu``, with its frames."""
    term = broadcast_measured(lex.patterns.select(F.col("key").alias("t_key"), F.col("frames")), lex.sizes["patterns"])
    return rows.join(term, rows["lu"] == term["t_key"], "inner").drop("t_key")


def walk(toks: DataFrame, lex: "lexicon.Compiled") -> DataFrame:
    """``(sent_id, pass, view, start, end, lu, frames)``, one row per view
    and pattern met."""
    return with_frames(hits(toks, lex), lex).select(
        "sent_id", "pass", F.explode(F.split("views", ",")).alias("view"), "start", "end", "lu", "frames")


#: Doublings of the heads that a row holds at once: 2**LEAPS steps up.
LEAPS = 6


def _flat(sets, of):
    """The distinct members of the sets that ``of`` has for ``sets``."""
    return F.array_distinct(F.flatten(F.transform(sets, lambda x: F.get(of, x))))


def head_pairs(toks: DataFrame) -> DataFrame:
    """(sent_id, pass, lu, start, end): every token marked ``root`` with each of
    its transitive heads and direct dependents, as a pattern of two lemmas.

    A sentence's tokens meet in one array, where they are already, and heads
    are followed in it by doubling: after k rounds a token knows its heads up to
    2**k steps away. So no pair is shuffled or written, and the work is that of
    the pairs. A tree deeper than 2**LEAPS steps is dealt out in stretches of
    that many, a row each. A token of several rows has the heads of all."""
    key = ["sent_id", "pass"]
    row = F.struct("tok_idx", "head_idx", "lemma", "start", "end", "root")
    t = (toks.where("sent_id is not null and pass is not null and tok_idx is not null")
         .groupBy(*key).agg(F.sort_array(F.collect_list(row)).alias("rows")))
    rows, n = F.col("rows"), F.size("rows")
    places = F.sequence(F.lit(0), n - 1)

    def slow(r):
        same = F.filter(rows, lambda q: (q["tok_idx"] == r["tok_idx"]) & (q["head_idx"] != q["tok_idx"]))
        heads = F.array_distinct(F.transform(same, lambda q: q["head_idx"]))
        return F.filter(places, lambda p: F.array_contains(heads, F.get(rows, p)["tok_idx"]))

    def place(r):
        # without gaps and repeats a token's place follows from its index
        return F.try_subtract(r["head_idx"], F.get(rows, F.lit(0))["tok_idx"]).try_cast("int")

    none = F.array().cast("array<int>")
    t = t.withColumn("plain", n == F.size(F.array_distinct(rows["tok_idx"])))
    t = t.withColumn("up", F.transform("rows", lambda r: F.when(F.col("plain") & (r["head_idx"].isNull() | (r["head_idx"] == r["tok_idx"])), none)
                                       .when(F.col("plain") & (F.get(rows, place(r))["tok_idx"] == r["head_idx"]), F.array(place(r))).otherwise(slow(r))))

    def further(acc, _):
        grown = F.zip_with(acc["near"], acc["leap"], lambda a, l: F.array_distinct(F.concat(a, _flat(l, acc["near"]))))
        leapt = F.transform(acc["leap"], lambda l: _flat(l, acc["leap"]))
        return F.when(F.exists(acc["leap"], lambda l: F.size(l) > 0), F.struct(grown.alias("near"), leapt.alias("leap"))).otherwise(acc)

    # one head a token, and no chain longer than that: numbers, not sets, are
    # doubled, and a token's heads are climbed to one by one in compiled code
    t = t.withColumn("l0", F.when(F.col("plain"), F.transform("up", lambda u: F.get(u, F.lit(0)))))
    for k in range(LEAPS):
        leap = F.col(f"l{k}")
        t = t.withColumn(f"l{k + 1}", F.when(F.exists(leap, lambda x: x.isNotNull()), F.transform(leap, lambda x: F.get(leap, x))))
    steps = F.lit(0)
    for k in range(LEAPS):
        steps = F.when(F.exists(f"l{k}", lambda x: x.isNotNull()), F.lit((2 << k) - 1)).otherwise(steps)
    t = t.withColumn("plain", F.col("plain") & ~F.coalesce(F.exists(f"l{LEAPS}", lambda x: x.isNotNull()), F.lit(False))).withColumn("steps", steps)
    t = t.withColumn("s", F.when(~F.col("plain"), F.aggregate(
        F.sequence(F.lit(1), F.lit(LEAPS)), F.struct(F.col("up").alias("near"), F.col("up").alias("leap")), further)))
    deep = ~F.col("plain") & F.exists("s.leap", lambda l: F.size(l) > 0)
    stretches = F.when(deep, F.sequence(F.lit(0), F.floor((n - 1) / (1 << LEAPS)).cast("int"))).otherwise(F.array(F.lit(0)))
    climbed = [f"l{k}" for k in range(LEAPS)]
    # outer: else Spark works the arrays out once more to sort out empty ones
    t = t.select(*key, "rows", "plain", "steps", *climbed, "up", "s", F.explode_outer(stretches).alias("j"))
    begun = F.aggregate(F.sequence(F.lit(1), F.col("j")), F.transform(places, lambda p: F.array(p)),
                        lambda cur, _: F.transform(cur, lambda c: _flat(c, F.col("s.leap"))))
    t = t.withColumn("heads", F.when(F.col("plain"), F.lit(None)).when(F.col("j") == 0, F.col("s.near"))
                     .otherwise(F.transform(begun, lambda c: _flat(c, F.col("s.near")))))
    t = t.select(*key, "rows", "plain", "steps", *climbed, "up", "heads", "j", F.posexplode_outer("rows").alias("p", "r"))

    # a token's heads, and its direct heads once more for the pairs that begin
    # with them: steps up, 0 for the latter; or places, the latter behind the
    # others. No function is called here: what is compiled hands on the pairs
    # alone, never a sentence's arrays
    p, x, root = F.col("p"), F.col("x"), F.col("r.root")
    above = F.when(root & F.col("heads").isNotNull(), F.get("heads", p)).otherwise(none)
    asked = F.when(F.col("plain"), F.when(F.get("l0", p).isNull(), none).otherwise(F.sequence(F.lit(0), F.when(root, F.col("steps")).otherwise(0))))
    asked = asked.otherwise(F.concat(above, F.when(F.col("j") == 0, F.get("up", p)).otherwise(none)))
    t = t.select(*key, "rows", "plain", *climbed, "p", "r", F.size(above).alias("n_above"), F.posexplode(asked).alias("nth", "x"))
    t = t.withColumn("at", p)
    for k in range(LEAPS):
        # a column for each leap: as one expression they would double in size
        t = t.withColumn("at", F.when(F.getbit(x, F.lit(k)) == 1, F.get(f"l{k}", F.col("at"))).otherwise(F.col("at")))
    at = F.when(F.col("plain"), F.when(x == 0, F.get("l0", p)).otherwise(F.col("at"))).otherwise(x)
    # a generator: else Spark writes the whole climb out for each condition below
    t = t.select(*key, F.when(F.col("plain"), x == 0).otherwise(F.col("nth") >= F.col("n_above")).alias("below"), "r", F.explode(F.array(F.get("rows", at))).alias("h"))
    r, h, below = F.col("r"), F.col("h"), F.col("below")
    t = t.where((h["start"] != r["start"]) & F.when(below, h["root"]).otherwise(h["tok_idx"] != r["tok_idx"]))
    # words, not the sentence, go with a pair
    first, second = (F.when(below, a).otherwise(b) for a, b in ((h["lemma"], r["lemma"]), (r["lemma"], h["lemma"])))
    return t.select(*key, F.concat(first, F.lit(" "), second).alias("lu"), F.least(r["start"], h["start"]).alias("start"),
                    F.when(r["start"] < h["start"], h["end"]).otherwise(r["end"]).alias("end"))


def dependency_hits(toks: DataFrame, lex: "lexicon.Compiled") -> DataFrame:
    """A token's lemma is a root with children and the lemma of a
    transitive head or a direct dependent is its second word; the span goes
    from the first of the two to the end of the later one. Needs ``head_idx``
    (supplied by a user's parser)."""
    t = toks.select("sent_id", "pass", "tok_idx", "head_idx", "lemma", "start", "end")
    if lex.sizes["roots"] <= threshold_bytes(toks.sparkSession):
        roots = lex.nodes.where("depth = 1 and has_children").select(F.col("key").alias("lemma"), F.lit(True).alias("root"))
        t = t.join(F.broadcast(roots), "lemma", "left").withColumn("root", F.coalesce("root", F.lit(False)))
    else:
        # only spares pairs: a pattern of two words begins with such a root
        t = t.withColumn("root", F.lit(True))
    two, pairs = lex.patterns.where("n = 2").select(F.col("key").alias("lu")), head_pairs(t)
    if lex.sizes["twos"] > threshold_bytes(toks.sparkSession) >= lex.sizes["two_ids"]:
        # the numbers that stand for the patterns are fewer bytes: with them a
        # pair that is no pattern is not shuffled
        ids = two.select(F.xxhash64("lu").alias("_id")).distinct()
        pairs = pairs.join(F.broadcast(ids), F.xxhash64("lu") == F.col("_id"), "left_semi")
    two = broadcast_measured(two, lex.sizes["twos"])
    return pairs.join(two, "lu", "left_semi").select("sent_id", "pass", F.lit("dependency").alias("views"), "start", "end", "lu")


def candidate_rows(toks: DataFrame, lex: "lexicon.Compiled") -> DataFrame:
    """All candidate rows of every view (overrides included), ``end >
    start`` only (L24)."""
    return walk(toks, lex)


def lu_hits(toks: DataFrame, lex: "lexicon.Compiled") -> DataFrame:
    """Distinct (sent_id, start, end, lu) of all views and passes."""
    return distinct_hits(hits(toks, lex))


def distinct_hits(rows: DataFrame) -> DataFrame:
    """Distinct (sent_id, start, end, lu), told apart inside their buckets."""
    return rows.select(*corpus.sentence_key(rows), "start", "end", "lu").distinct().drop("bucket")


def spans(toks: DataFrame, lex: "lexicon.Compiled") -> DataFrame:
    """(sent_id, start, end, lus): each span with the patterns that hit it,
    written once: whoever reads the spans twice must not walk twice, and Spark
    does not find the two walks equal."""
    found = lu_hits(toks, lex).groupBy("sent_id", "start", "end").agg(F.sort_array(F.collect_set("lu")).alias("lus"))
    path = scratch_path(toks.sparkSession, f"spans/{uuid.uuid4().hex}")
    found.write.parquet(path)
    return toks.sparkSession.read.schema(found.schema).parquet(path)


def with_set_frames(rows: DataFrame, lex: "lexicon.Compiled", by_lu: bool = False) -> DataFrame:
    """Rows with ``lus``, and the frames of these patterns in ``frames``
    (``by_lu``: a map of pattern to frames). Frames may be long lists: they are
    put together once per set of patterns, not once per span."""
    sets = rows.select("lus").distinct()
    parts = with_frames(sets.select("lus", F.explode("lus").alias("lu")), lex).groupBy(F.col("lus").alias("_lus"))
    if by_lu:
        frames = F.map_from_entries(F.sort_array(F.collect_list(F.struct("lu", "frames"))))
    else:
        frames = F.sort_array(F.array_distinct(F.flatten(F.collect_list("frames"))))
    known = parts.agg(frames.alias("frames"))
    return rows.join(known, rows["lus"] == known["_lus"]).drop("_lus")


def candidates(toks: DataFrame, lex: "lexicon.Compiled") -> DataFrame:
    """One row per (sentence, span) with its sorted frames, in one
    walk: the hits are grouped where they are found."""
    return dedupe(with_frames(lu_hits(toks, lex), lex))


def dedupe(rows: DataFrame) -> DataFrame:
    """One row per (sentence, span), frames unioned and sorted."""
    return (rows.groupBy("sent_id", "start", "end")
            .agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("frames")))).alias("frames")))


def by_lu(rows: DataFrame) -> DataFrame:
    """Per span, LU text -> frames."""
    per_lu = (rows.groupBy("sent_id", "start", "end", "lu")
              .agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("frames")))).alias("frames")))
    return (per_lu.groupBy("sent_id", "start", "end")
            .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lu", "frames")))).alias("lu_frames")))


def explode_frames(spans: DataFrame) -> DataFrame:
    """One row per (sentence, span, frame)."""
    return spans.select("sent_id", "start", "end", F.explode("frames").alias("frame_name"))


def subsumed(spans: DataFrame) -> DataFrame:
    """Per sentence, the greedy sweep over spans sorted by (start, end)
    that keeps a span when it starts after the last kept end; a longer span
    with the same start replaces it, so per start only the longest competes.
    The kept spans carry their frames.

    A span that starts after every earlier end is always kept, and what
    follows it does not depend on what came before. So windows cut a sentence
    at such spans, and the sweep folds over each stretch of overlapping spans
    alone: small groups however long the sentence is, and no Python."""
    top = spans.groupBy("sent_id", "start").agg(F.max(F.struct("end", "frames")).alias("top"))
    top = top.select("sent_id", "start", "top.end", "top.frames")
    order = Window.partitionBy("sent_id").orderBy("start")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = top.withColumn("_new", F.when(F.coalesce(F.col("start") > reach, F.lit(True)), 1).otherwise(0))
    cut = cut.withColumn("_part", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    row = F.struct("start", "end", "frames")
    parts = cut.groupBy("sent_id", "_part").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    kept = F.aggregate(
        "rows", F.struct(F.lit(-1).alias("last"), F.slice("rows", 1, 0).alias("kept")),
        lambda acc, r: F.when(r["start"] > acc["last"], F.struct(r["end"].alias("last"), F.concat(acc["kept"], F.array(r)).alias("kept")))
        .otherwise(acc))["kept"]
    return parts.select("sent_id", F.explode(kept).alias("k")).select("sent_id", "k.start", "k.end", "k.frames")

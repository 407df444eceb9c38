"""Lexicon compile: LU names -> variants -> pattern table -> node table.

The pattern tree is two tables:
``patterns(key, words, n, frames)`` (terminal paths) and
``nodes(key, depth, has_children, terminal, frames)`` (every prefix). The walk in
``match`` looks nodes up by key with hash joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.text import lu_base, strip_ws
from ..plans.joins import threshold_bytes
from . import corpus

LU_SCHEMA = "name STRING, frame STRING"


def fixture_lus(spark) -> DataFrame:
    return spark.createDataFrame(fixed.FIXTURE_LUS, LU_SCHEMA)


def part_lus(part: DataFrame) -> DataFrame:
    """LU index derived from ``part``: name = p_name.pos, frame =
    p_type/p_size, POS by ``p_partkey % 5``."""
    pos = F.element_at(F.array(*[F.lit(x) for x in fixed.PART_POS]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return part.select(F.concat_ws(".", "p_name", pos).alias("name"),
                       F.concat_ws("/", "p_type", F.col("p_size").cast("string")).alias("frame"))


def corpus_lus(spark, part: DataFrame) -> DataFrame:
    """The lexicon the corpus queries use: the inline fixture plus the
    part-derived LUs (so the lexicon grows with the data)."""
    return fixture_lus(spark).unionByName(part_lus(part))


def with_lowercase(lus: DataFrame) -> DataFrame:
    """Every LU also lower-cased when that differs."""
    low = lus.where(F.col("name") != F.lower("name")).select(F.lower("name").alias("name"), "frame")
    return lus.unionByName(low)


def variant_array(base: Column) -> Column:
    """Hyphen, bracket and parenthesis variants of an LU base name,
    each from the original name (the rules do not compose); the name
    itself when no rule fires."""
    hyph = F.when(F.instr(base, "-") > 0,
                  F.array(F.translate(base, "-", " "), F.replace(base, F.lit("-"), F.lit(" - "))))
    brack = F.when(base.rlike(r" *\[.*\] *"),
                   F.array(strip_ws(F.regexp_replace(base, r" *\[.*\] *", ""))))
    m = F.regexp_extract(base, r"\(.*\)", 0)
    inner = F.regexp_replace(m, r"^[ ()]+|[ ()]+$", "")
    i = F.instr(base, "(")
    prefix = F.substring(base, F.lit(1), i - 1)
    suffix = F.substring(base, i + F.length(m), F.lit(1 << 30))

    def put(x: Column) -> Column:
        return F.concat(prefix, x, suffix)

    generic_names = list(fixed.GENERICS)
    generic_slots = F.array(*[F.lit(x) for x in fixed.GENERICS[generic_names[0]]])
    paren = (F.when((m != "") & (F.instr(inner, "/") > 0), F.transform(F.split(inner, "/"), put))
             .when((m != "") & inner.isin(generic_names), F.transform(generic_slots, put))
             .when(m != "", F.array(put(inner))))
    empty = F.array().cast("array<string>")
    allv = F.concat(F.coalesce(hyph, empty), F.coalesce(brack, empty), F.coalesce(paren, empty))
    return F.when(F.size(allv) == 0, F.array(base)).otherwise(allv)


def extra_lus(spark) -> DataFrame:
    """Extra LUs; ``direct`` rows are inserted as they are."""
    rows = [(n, f, True) for n, f in fixed.EXTRA_SIMPLE] + [(n, f, False) for n, f in fixed.EXTRA_NAMED]
    return spark.createDataFrame(rows, "name STRING, frame STRING, direct BOOLEAN")


def lu_variants(lus: DataFrame, extras: DataFrame | None = None) -> DataFrame:
    """(lu, frame, variant, words): one row per distinct variant of each
    LU (lower-cased copies included; extras not lower-cased)."""
    base = with_lowercase(lus).withColumn("direct", F.lit(False))
    if extras is not None:
        base = base.unionByName(extras)
    v = base.select(F.col("name").alias("lu"), "frame",
                    F.explode(F.when(F.col("direct"), F.array(F.col("name")))
                              .otherwise(variant_array(lu_base(F.col("name"))))).alias("variant"))
    return v.distinct().withColumn("words", F.split("variant", " "))


def patterns(variants: DataFrame) -> DataFrame:
    """(key, words, n, frames) — same path merges frames."""
    return (variants.groupBy("words")
            .agg(F.sort_array(F.collect_set("frame")).alias("frames"))
            .select(F.array_join("words", " ").alias("key"), "words",
                    F.size("words").alias("n"), "frames"))


def nodes(pats: DataFrame) -> DataFrame:
    """Every prefix of every pattern is a node; ``has_children`` when a
    longer pattern passes through it; ``frames`` empty unless terminal."""
    pre = pats.select("words", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    pre = pre.select(F.array_join(F.slice("words", 1, F.col("k")), " ").alias("key"),
                     F.col("k").alias("depth"), (F.col("k") < F.col("n")).alias("child"))
    agg = pre.groupBy("key").agg(F.max("depth").alias("depth"), F.max("child").alias("has_children"))
    term = pats.select(F.col("key").alias("tkey"), "frames")
    return (agg.join(term, agg["key"] == term["tkey"], "left")
            .select("key", "depth", "has_children", F.col("tkey").isNotNull().alias("terminal"),
                    F.coalesce("frames", F.array().cast("array<string>")).alias("frames")))


@dataclass
class Compiled:
    """A compiled lexicon: tables plus the two scalars the walk needs."""
    variants: DataFrame
    patterns: DataFrame
    nodes: DataFrame
    spelling: DataFrame
    n_nodes: int
    lmax: int
    sizes: dict  # measured bytes of each table
    spelled: tuple[int, int] = (0, 0)  # most roots of a variant in each direction
    aliases: DataFrame | None = None  # (form, word); None: the fixed list
    overrides: DataFrame | None = None  # (lemma, pos, lu, extra); None: the fixed list
    wild: bool = True  # any node ends with a POS slot
    firsts: tuple[str, ...] | None = None  # first letters of the words that a walk may start with; None: too many
    seconds: tuple[str, ...] | None = None  # the same for the second word of a longer pattern

    def __iter__(self):  # (variants, patterns, nodes) unpacking
        return iter((self.variants, self.patterns, self.nodes))


def _bytes(t: DataFrame, *cols: str) -> int:
    """Bytes of the columns (strings or string arrays) and a row's overhead."""
    kinds = dict(t.dtypes)
    total = F.lit(64)
    for c in cols:
        text = F.array_join(c, "") if kinds[c].startswith("array") else F.col(c)
        extra = 16 * F.greatest(F.size(c), F.lit(0)) if kinds[c].startswith("array") else F.lit(0)
        total = total + F.coalesce(F.octet_length(text) + extra, F.lit(0))
    return int(t.agg(F.sum(total)).first()[0] or 0)


def compile_lexicon(lus: DataFrame, with_extras: bool = True, cache: bool = True,
                    pairs: DataFrame | None = None, aliases: DataFrame | None = None,
                    overrides: DataFrame | None = None) -> Compiled:
    """Compile an LU index ``(name, frame)``.

    Pattern, node and spelling tables are read many times (one lookup per
    walk level), so they are cached; their size is bounded by the LU
    index, not by the corpus. Their bytes are measured here, once, for
    every broadcast decision."""
    spark = lus.sparkSession
    v = lu_variants(lus, extra_lus(spark) if with_extras else None)
    p = patterns(v)
    n = nodes(p)
    sp = spelling_variants(p, pairs)
    if cache:
        p, n, sp = p.cache(), n.cache(), sp.cache()
    st = n.agg(F.count(F.lit(1)).alias("c"), F.max("depth").alias("d"), F.max(F.col("key").endswith(">")).alias("w"),
               F.count_if((F.col("depth") == 2) & F.col("terminal")).alias("twos")).first()
    sizes = {"variants": _bytes(v, "variant", "frame", "lu"), "patterns": _bytes(p, "key", "frames"), "keys": _bytes(p, "key"),
             "nodes": _bytes(n, "key"), "node_frames": _bytes(n, "key", "frames"),
             "tops": _bytes(n.where("depth = 1"), "key"), "roots": _bytes(n.where("depth = 1 and has_children"), "key"), "twos": _bytes(p.where("n = 2"), "key"),
             "two_ids": 16 * int(st["twos"]), "spelling": _bytes(sp, "variant", "us_roots", "gb_roots")}
    most = sp.agg(*[F.max(F.greatest(F.size(c), F.lit(0))) for c in ("us_roots", "gb_roots")]).first()
    if aliases is not None:
        # words that are no roots start no walk; a form has one word
        roots = n.where("depth = 1").select(F.col("key").alias("word"))
        aliases = aliases.join(roots, "word", "left_semi").groupBy("form").agg(F.min("word").alias("word"))
        sizes["aliases"] = _bytes(aliases, "form", "word")
    if overrides is not None:
        overrides = overrides.groupBy("lemma", "pos").agg(F.min(F.struct("lu", "extra")).alias("o")).select("lemma", "pos", "o.lu", "o.extra")
        sizes["overrides"] = _bytes(overrides, "lemma", "pos", "lu")
    firsts, seconds = first_letters(n, sp, aliases, overrides), second_letters(n)
    return Compiled(v, p, n, sp, int(st["c"] or 0), int(st["d"] or 1), sizes, tuple(int(x or 0) for x in most), aliases, overrides, bool(st["w"]), firsts, seconds)


#: More first letters than this do not sort out many tokens.
MAX_FIRSTS = 2_000


def first_letters(nds: DataFrame, spelling: DataFrame, aliases: DataFrame | None, overrides: DataFrame | None) -> tuple[str, ...] | None:
    """First letters of every token that may start a walk: of the roots, and of
    the words that an alias, an override, the other spelling or the default
    annotator's form list leads to a root. None if there are too many."""
    words = nds.where("depth = 1").select(F.col("key").alias("w")).unionByName(spelling.select(F.col("variant").alias("w")))
    for t, c in ((aliases, "form"), (overrides, "lemma")):
        if t is not None:
            words = words.unionByName(t.select(F.col(c).alias("w")))
    return _letters(words, [r[0] for r in (*fixed.FORMS, *fixed.ALIASES, *fixed.OVERRIDES)])


def second_letters(nds: DataFrame) -> tuple[str, ...] | None:
    """First letters of every token that may be the second word of a pattern.
    The default annotator's readings other than ``X`` are those of its form
    list and numbers; a slot for ``X`` takes any word."""
    words = nds.where("depth = 2").select(F.substring_index("key", " ", -1).alias("w"))
    return None if words.where("w = '<X>'").head(1) else _letters(words, [r[0] for r in fixed.FORMS])


def _letters(words: DataFrame, more: list[str]) -> tuple[str, ...] | None:
    found = words.select(corpus.first_letters(F.col("w")).alias("f")).distinct().limit(MAX_FIRSTS + 1).collect()
    if len(found) > MAX_FIRSTS:
        return None
    return tuple(sorted({r.f for r in found if r.f is not None} | {w.lower()[:corpus.FIRST] for w in more}))


def is_large(lex: Compiled) -> bool:
    """Whether a table that a walk looks words up in is beyond the broadcast bound."""
    return max(lex.sizes.get(t, 0) for t in ("nodes", "spelling", "aliases", "overrides")) > threshold_bytes(lex.nodes.sparkSession)


def release(lex: Compiled) -> None:
    """Drops the cached tables of a compiled lexicon."""
    for t in (lex.patterns, lex.nodes, lex.spelling):
        t.unpersist()


def frequent_grams(texts: DataFrame, support: int = 5, nmin: int = 1, nmax: int = 3) -> DataFrame:
    """(gram, n): word n-grams that occur ``support`` times or more in the
    arrays of words (``ws``), counted in one pass with map-side combine."""
    at = corpus.runs(texts, nmax).where(F.element_at("s", 1).rlike("^[a-z]+$") & (F.size("s") >= nmin))
    g = (at.select("s", F.explode(F.sequence(F.lit(nmin), F.size("s"))).alias("n"))
         .select(F.array_join(F.slice("s", F.lit(1), F.col("n")), " ").alias("gram"), "n"))
    # the first word is checked above, the others on the joined gram
    g = g.where((F.col("n") == 1) | F.col("gram").rlike("^[a-z ]+$"))
    return g.groupBy("gram", "n").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= support).select("gram", "n")


def frequent_ngrams(toks: DataFrame, support: int = 5, nmax: int = 3) -> DataFrame:
    """:func:`frequent_grams` of a token table, whose sentences are gathered."""
    row = F.sort_array(F.collect_list(F.struct("tok_idx", "text")))
    return frequent_grams(toks.groupBy("sent_id", "pass").agg(row["text"].alias("ws")), support, 1, nmax)


def normalise_lu(name: Column) -> Column:
    """L10 key of an exact LU lookup: ``-`` to blank, parentheses removed,
    cut at the first dot, words starting with ``[`` or ending with ``]``
    dropped, empty words dropped."""
    s = F.substring_index(F.translate(name, "-()", " "), ".", 1)
    words = F.filter(F.split(s, " "),
                     lambda w: (F.length(w) > 0) & ~w.startswith("[") & ~w.endswith("]"))
    return F.when(F.size(words) > 0, F.array_join(words, " "))


def exact_lookup(names: DataFrame, nds: DataFrame, name_col: str = "lu") -> DataFrame:
    """Frames of an exact LU name; unknown or non-terminal -> []."""
    k = names.withColumn("_key", normalise_lu(F.col(name_col)))
    j = k.join(nds.select(F.col("key").alias("_nk"), "frames"), F.col("_key") == F.col("_nk"), "left")
    return j.select(*names.columns, F.coalesce("frames", F.array().cast("array<string>")).alias("frames"))


def spelling_pairs(pats: DataFrame) -> DataFrame:
    """Default (us, gb) pairs: the lexicon's root words by the ending rules
    of ``fixed.SPELLING_SUFFIXES``, in both directions."""
    roots = pats.select(F.element_at("words", 1).alias("root")).distinct()
    pairs = []
    for us, gb in fixed.SPELLING_SUFFIXES:
        for a, b in ((us, gb), (gb, us)):
            other = F.concat(F.expr(f"substring(root, 1, length(root) - {len(a)})"), F.lit(b))
            us_word, gb_word = (F.col("root"), other) if a == us else (other, F.col("root"))
            pair = F.struct(us_word.alias("us"), gb_word.alias("gb"))
            pairs.append(F.when(F.col("root").endswith(a) & (F.length("root") >= len(a) + fixed.SPELLING_MIN_STEM), pair))
    p = roots.select(F.explode(F.array(*pairs)).alias("p")).where(F.col("p").isNotNull())
    return p.select("p.us", "p.gb")


def spelling_variants(pats: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(variant, us_roots, gb_roots): for a British spelling the American
    roots, for an American spelling the British roots, null where there are
    none. Every root of a variant counts, also if the variant is a root
    itself. ``pairs``: a user's (us, gb) table, else the ending rules."""
    roots = pats.select(F.element_at("words", 1).alias("root")).distinct()
    pairs = spelling_pairs(pats) if pairs is None else pairs.select("us", "gb")
    both = (pairs.select(F.col("gb").alias("variant"), F.col("us").alias("root"), F.lit(True).alias("to_us"))
            .unionByName(pairs.select(F.col("us").alias("variant"), F.col("gb").alias("root"), F.lit(False).alias("to_us"))))
    known = both.join(roots, "root", "left_semi").where("variant != root")
    sets = known.groupBy("variant").agg(F.sort_array(F.collect_set(F.when(F.col("to_us"), F.col("root")))).alias("us_roots"),
                                        F.sort_array(F.collect_set(F.when(~F.col("to_us"), F.col("root")))).alias("gb_roots"))
    return sets.select("variant", *[F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("us_roots", "gb_roots")])

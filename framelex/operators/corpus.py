"""Sentences, tokens and the built-in annotator (token-table contract).

Shuffle plan: ``distinct_sentences`` is the only exchange of the corpus (an
aggregate on the content id ``sent_id`` with map-side combine, sorted because
it keeps the text; a
line repeated across a third of the corpus is collapsed before the
shuffle). Tokens are made from a sentence's own array, without a sort; the
pattern walk and span aggregates are keyed by ``sent_id`` and reuse that
partitioning.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.text import SENTENCE_SPLIT, TOKEN_PATTERN_JAVA, number_words, stem, strip_ws


def sentence_id(text: Column) -> Column:
    """Content id of a sentence: md5 hex (128 bits, collision-safe at
    corpus scale, identical in DuckDB)."""
    return F.md5(text)


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sent_idx, sent_id, sentence): split on ``[.!?\\n]+``,
    strip, drop empty pieces. ``sent_idx`` is the position in the split,
    so it is stable. No shuffle."""
    return (docs.select(F.col(id_col).alias("doc_id"),
                        F.posexplode(F.split(F.col(text_col), SENTENCE_SPLIT)).alias("sent_idx", "raw"))
            .select("doc_id", "sent_idx", strip_ws(F.col("raw")).alias("sentence"))
            .where(F.col("sentence") != "")
            .withColumn("sent_id", sentence_id(F.col("sentence"))))


def distinct_sentences(sents: DataFrame) -> DataFrame:
    """(sent_id, sentence, n_occ): one row per distinct text, hash
    partitioned by ``sent_id``."""
    return sents.groupBy("sent_id").agg(F.any_value("sentence").alias("sentence"),
                                        F.count(F.lit(1)).alias("n_occ"))


def running_sums(values: Column, block: int = 32, few: int = 8) -> Column:
    """Running sums of an array of integers. ``few`` at a time are added up one
    by one, their sums in blocks, so a long array costs its length times
    ``block``, not its square."""
    def let(value, then):
        # evaluated once, however often ``then`` uses it
        return F.transform(F.array(value), then)[0]

    def total(part):
        return F.aggregate(part, F.lit(0), lambda s, x: s + x)

    def parts_of(v, n):
        return F.transform(F.sequence(F.lit(1), F.size(v), F.lit(n)), lambda i: F.slice(v, i, n))

    def in_blocks(v):
        return let(parts_of(v, block), lambda parts: let(F.transform(parts, total), lambda sums: F.flatten(
            F.transform(parts, lambda part, j: let(total(F.slice(sums, F.lit(1), j)), lambda before: F.transform(
                part, lambda x, i: before + total(F.slice(part, F.lit(1), i + 1))))))))

    def upto(part, i):
        # a slice for each element would cost more than its sum
        return reduce(add, [F.when(i >= k, F.get(part, F.lit(k))).otherwise(0) for k in range(few)])

    def of(v):
        return let(parts_of(v, few), lambda parts: let(F.transform(parts, total), lambda sums: let(in_blocks(sums), lambda ends: F.flatten(
            F.transform(parts, lambda part, j: F.transform(part, lambda x, i: F.get(ends, j) - F.get(sums, j) + upto(part, i)))))))

    return let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(v))


#: What ``\\s`` matches in the token pattern.
BLANKS = " \t\n\x0b\f\r"
#: Letters of a word that tell whether a lexicon word may start like it; a stem
#: keeps as many.
FIRST = 3


def stripped(match: Column) -> Column:
    """A token's text: its match without the blanks before it."""
    # most blanks are spaces, which are cut much faster alone
    short = F.ltrim(match)
    return F.when(F.ascii(short) > 32, short).otherwise(F.ltrim(match, F.lit(BLANKS)))


def first_letters(word: Column) -> Column:
    return F.substring(F.lower(word), 1, FIRST)


def may_be(text: Column, firsts: tuple[str, ...]) -> Column:
    """Whether a reading of a token may begin with one of ``firsts``; a number's
    words begin otherwise than its text."""
    return first_letters(text).isin(*firsts) | F.substring(text, 1, 1).between("0", "9")


def in_buckets(sents: DataFrame, per_partition: int = 4) -> DataFrame:
    """Sentences dealt into ``bucket``s, a few for each shuffle partition. Whatever
    keeps the bucket stays in its partition, so a lexicon too large to broadcast
    goes to the buckets that hold its words, not their tokens to the lexicon."""
    n = int(sents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sents.withColumn("bucket", F.pmod(F.xxhash64("sent_id"), F.lit(n * per_partition)).cast("int"))
    return dealt.repartition(n, "bucket")


def sentence_key(t: DataFrame) -> list[str]:
    """The columns that tell a sentence, with its bucket where it was dealt."""
    return [c for c in ("bucket", "sent_id") if c in t.columns]


def token_matches(sents: DataFrame, passes: bool = True) -> DataFrame:
    """(sent_id, pass, m): the matches of a sentence, a token with the blanks
    before it each; see :func:`tokens`."""
    variants = [F.struct(F.lit(0).alias("pass"), F.col("sentence").alias("txt"))]
    if passes:
        variants.append(F.struct(F.lit(1).alias("pass"),
                                 F.translate(F.col("sentence"), "-", " ").alias("txt")))
    key = sentence_key(sents)
    return (sents.select(*key, F.explode(F.array(*variants)).alias("v"))
            .select(*key, F.col("v.pass").alias("pass"), F.regexp_extract_all(F.col("v.txt"), F.lit(TOKEN_PATTERN_JAVA), 0).alias("m")))


def text_arrays(sents: DataFrame, number: int) -> DataFrame:
    """(sent_id, ws): the token texts of a sentence in one pass; see :func:`tokens`."""
    text = F.translate("sentence", "-", " ") if number == 1 else F.col("sentence")
    m = sents.select("sent_id", F.regexp_extract_all(text, F.lit(TOKEN_PATTERN_JAVA), 0).alias("m"))
    return m.select("sent_id", F.transform("m", lambda x: F.lower(stripped(x)) if number == 1 else stripped(x)).alias("ws"))


def token_arrays(sents: DataFrame, passes: bool = True) -> DataFrame:
    """(sent_id, pass, toks): the tokens (start, end, text) of a sentence in
    one array, in order; see :func:`tokens`."""
    p = token_matches(sents, passes)
    ends = running_sums(F.transform("m", F.length))
    pieces = F.transform("m", stripped)
    lower = F.col("pass") == 1

    def token(piece, end):
        return F.struct((end - F.length(piece)).alias("start"), end.alias("end"), F.when(lower, F.lower(piece)).otherwise(piece).alias("text"))

    return p.select("sent_id", "pass", F.zip_with(pieces, ends, token).alias("toks"))


#: Tokens of a block; the characters before a block are added up once.
BLOCK = 32


def _measured(p: DataFrame, block: int) -> DataFrame:
    """Matches with ``before``, the characters before each block of them."""
    n = F.size("m")
    each = F.transform(F.sequence(F.lit(1), n, F.lit(block)), lambda k: F.length(F.array_join(F.slice("m", k, block), "")))
    # few sentences are longer than a block
    return p.withColumn("before", F.when(n <= block, F.array(F.lit(0))).otherwise(F.concat(F.array(F.lit(0)), running_sums(each))))


def _each(p: DataFrame, *keep: str) -> DataFrame:
    """A row for each match, with its number ``tok_idx`` and itself as ``piece``."""
    # outer: else Spark matches the sentence again to sort out empty ones
    return p.select(*keep, F.posexplode_outer("m").alias("tok_idx", "piece")).where("piece is not null")


def _end(i: Column, block: int) -> Column:
    """Where the match number ``i`` ends. No function is called for each token,
    so Spark compiles it, and it is worked out only for rows that stay."""
    nth = F.floor(i / block).cast("int")
    return F.get("before", nth) + F.length(F.array_join(F.slice("m", nth * block + 1, i - nth * block + 1), ""))


def tokens(sents: DataFrame, passes: bool = True, block: int = BLOCK) -> DataFrame:
    """Token table ``(sent_id, pass, tok_idx, start, end, text)``.

    Pass 0 tokenizes the sentence; pass 1 tokenizes it with ``-`` replaced
    by a blank and lower-cases each token (offsets stay those of the
    original characters). Each regex match is one token with the blanks
    before it, so ``tok_idx`` is the match index and ``end`` the sum of the
    match lengths up to it: no window, so tokens are never sorted or shuffled.
    """
    p = _measured(token_matches(sents, passes), block)
    t = _each(p, "sent_id", "pass", "m", "before")
    t = t.select("sent_id", "pass", "tok_idx", _end(F.col("tok_idx"), block).alias("end"), stripped(F.col("piece")).alias("text"))
    return t.select("sent_id", "pass", "tok_idx", (F.col("end") - F.length("text")).alias("start"), "end",
                    F.when(F.col("pass") == 1, F.lower("text")).otherwise(F.col("text")).alias("text"))


def walk_tokens(sents: DataFrame, ahead: int, firsts: tuple[str, ...] | None = None, block: int = BLOCK, merged: bool = False) -> DataFrame:
    """The rows of :func:`tokens` with ``nx``, the matches of the ``ahead``
    tokens which follow in the sentence, fewer at its end. ``firsts``: the
    first letters (lower case) of every word that a walk may start with; only
    tokens that begin so, or with a digit, become rows. A sentence without
    hyphens is matched once for both passes. ``merged``: for readers that do
    not ask which pass met a span. In a sentence without hyphens a token that
    is lower case, as all that it looks ahead to, reads the same in both
    passes, so only the second one has its row."""
    key = sentence_key(sents)
    text = F.col("sentence")

    def variant(txt, *numbers):
        return F.struct(txt.alias("txt"), F.array(*[F.lit(n) for n in numbers]).alias("passes"))

    each = F.when(F.instr(text, "-") > 0, F.array(variant(text, 0), variant(F.translate(text, "-", " "), 1))).otherwise(F.array(variant(text, 0, 1)))
    p = sents.select(*key, F.explode(each).alias("v"))
    p = _measured(p.select(*key, "v.passes", F.regexp_extract_all("v.txt", F.lit(TOKEN_PATTERN_JAVA), 0).alias("m")), block)
    t = _each(p, *key, "passes", "m", "before")
    if firsts is not None:
        t = t.where(may_be(stripped(F.col("piece")), firsts))
    i = F.col("tok_idx")
    numbers = F.col("passes")
    if merged:
        read = F.array_join(F.slice("m", i + 1, ahead + 1), "")
        numbers = F.when((F.size("passes") == 2) & (read == F.lower(read)), F.array(F.lit(1))).otherwise(numbers)
    nx = F.slice("m", i + 2, ahead) if ahead > 0 else F.array().cast("array<string>")
    t = t.select(*key, "tok_idx", _end(i, block).alias("end"), stripped(F.col("piece")).alias("text"), nx.alias("nx"), numbers.alias("passes"))
    t = t.select(*key, F.explode_outer("passes").alias("pass"), "tok_idx", "end", "text", "nx")
    return t.select(*key, "pass", "tok_idx", (F.col("end") - F.length("text")).alias("start"), "end",
                    F.when(F.col("pass") == 1, F.lower("text")).otherwise(F.col("text")).alias("text"), "nx")


def sequence_starts(sents: DataFrame, ahead: int, firsts: tuple[str, ...] | None = None, block: int = BLOCK) -> DataFrame:
    """(sent_id, tok_idx, end, before, s, words): the pass-0 tokens that begin
    with one of ``firsts`` or a digit, where they end, the match before them
    (null for the first), and the matches and texts of the token and of the
    ``ahead`` tokens which follow."""
    p = _measured(token_matches(sents, passes=False), block)
    t = _each(p, "sent_id", "m", "before")
    if firsts is not None:
        t = t.where(may_be(stripped(F.col("piece")), firsts))
    i = F.col("tok_idx")
    t = t.select("sent_id", "tok_idx", _end(i, block).alias("end"), F.get("m", i - 1).alias("before"), F.slice("m", i + 1, ahead + 1).alias("s"))
    return t.withColumn("words", F.transform("s", stripped))


def annotated(sents: DataFrame, annotator, ahead: int, firsts: tuple[str, ...] | None = None, merged: bool = False) -> DataFrame:
    """Annotated tokens for a walk that looks ``ahead`` tokens ahead. The
    built-in annotator reads each token alone, so only tokens that may start a
    walk (``firsts``) are rows, and the walk reads the next ones (``nx``)
    itself; with another one it looks at the annotated table."""
    return annotator(walk_tokens(sents, ahead, firsts, merged=merged) if annotator is annotate else tokens(sents))


def runs(texts: DataFrame, n: int) -> DataFrame:
    """(s): from each word of the arrays ``ws`` on, at most ``n`` words."""
    at = texts.select("ws", F.posexplode_outer("ws").alias("i", "w")).where("w is not null")
    return at.select(F.slice("ws", F.col("i") + 1, n).alias("s"))


def words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(text): the distinct pass-1 words of whole texts. No word crosses a
    sentence's end or a hyphen, so the texts need not be split."""
    return docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"[\p{L}\p{N}]++"), 0)).alias("w")).select(F.lower("w").alias("text")).distinct()


def form_lexicon(spark) -> DataFrame:
    """Default (form -> lemma, pos) table of the built-in annotator."""
    return spark.createDataFrame(fixed.FORMS, "form STRING, f_lemma STRING, f_pos STRING")


def number_name(text: Column) -> Column:
    """The number words of an all-digit token, else null."""
    # only what starts with a digit can be a number
    return F.when(F.substring(text, 1, 1).between("0", "9") & text.rlike(r"^[0-9]+$"), number_words(text))


def readings(text: Column, number: Column) -> tuple[Column, Column, Column]:
    """(lemma, stem, pos) of a token text and its :func:`number_name` by the
    default form list, which the code fixes: a token is read without its
    neighbours, so no join is needed."""
    form = F.lower(text)

    def known(i):
        return F.try_element_at(F.create_map(*[F.lit(x) for row in fixed.FORMS for x in (row[0], row[i])]), form)

    return (F.coalesce(number, known(1), form), F.coalesce(number, stem(text)),
            F.when(number.isNotNull(), F.lit("NUM")).otherwise(F.coalesce(known(2), F.lit("X"))))


def annotate(toks: DataFrame, forms: DataFrame | None = None) -> DataFrame:
    """Add ``lemma, stem, pos`` by a (form -> lemma, pos) lexicon keyed by the
    lower-cased token (a user's table is joined). Default lemma = lower-cased
    text, default POS ``X``; all-digit tokens are ``NUM`` and their lemma
    and stem become number words (evaluated for number tokens only)."""
    if forms is None:
        lemma, stm, pos = readings(F.col("text"), F.col("_number"))
        return toks.withColumn("_number", number_name(F.col("text"))).select(*toks.columns, lemma.alias("lemma"), stm.alias("stem"), pos.alias("pos"))
    t = toks.withColumn("_form", F.lower("text"))
    t = t.join(forms, t["_form"] == forms["form"], "left")
    is_num = F.col("text").rlike(r"^[0-9]+$")
    pos = F.when(is_num, F.lit("NUM")).otherwise(F.coalesce(F.col("f_pos"), F.lit("X")))
    num = number_words(F.col("text"))
    lemma = F.when(is_num, num).otherwise(F.coalesce(F.col("f_lemma"), F.col("_form")))
    stm = F.when(is_num, num).otherwise(stem(F.col("text")))
    # a table's readings are not those of :func:`readings`
    cols = [c for c in toks.columns if c != "nx"]
    return t.select(*cols, lemma.alias("lemma"), stm.alias("stem"), pos.alias("pos"))

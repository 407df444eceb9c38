"""Column expressions for text: sentence split, token pieces, LU names,
stems and number words. All built-in functions, so they stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed

# Sentence boundary and token piece patterns (Java regex; the oracle uses
# the same strings in RE2). Pieces cover every character of the text.
SENTENCE_SPLIT = r"[.!?\n]+"
PIECE_PATTERN = r"\s+|[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
# The same pieces, each word/punctuation piece with the blanks before it:
# one match per token, so the token index is the match index.
TOKEN_PATTERN = r"\s*(?:[\p{L}\p{N}]+|[^\s\p{L}\p{N}])"
# The same for Java with possessive quantifiers (no backtracking; matches
# are identical because the blanks and the letter run cannot give back).
TOKEN_PATTERN_JAVA = r"\s*+(?:[\p{L}\p{N}]++|[^\s\p{L}\p{N}])"
STEM_PATTERN = r"^(.{3,}?)(ing|ed|ly|es|s)$"


def strip_ws(c: Column) -> Column:
    """Python's ``str.strip()`` for ASCII whitespace (``trim`` only strips
    blanks)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def lu_base(name: Column) -> Column:
    """LU name without its last dot part; '' when there is no dot."""
    return F.when(F.instr(name, ".") > 0, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(F.lit(""))


def lu_no_pos(name: Column) -> Column:
    """Text before the first dot."""
    return F.substring_index(name, ".", 1)


def lu_pos(name: Column) -> Column:
    """Text after the last dot."""
    return F.substring_index(name, ".", -1)


def stem(word: Column) -> Column:
    """Context-free stem: lower-case, strip one common suffix when at least
    three characters stay."""
    low = F.lower(word)
    # most words end otherwise: the expression only runs where a suffix is
    ends = low.endswith("s") | low.endswith("ed") | low.endswith("ing") | low.endswith("ly")
    return F.when(ends, F.regexp_replace(low, STEM_PATTERN, "$1")).otherwise(low)


def number_words(digits: Column) -> Column:
    """English words of a whole number of any length that has a name:
    ``21`` -> ``twenty-one``, ``101`` -> ``one hundred and one``, ``1234`` ->
    ``one thousand, two hundred and thirty-four``. Groups of three digits are
    read from the left; numbers beyond the named scales and other input are
    returned as they are."""
    ones = F.array(*[F.lit(x) for x in fixed.ONES])
    tens = F.array(*[F.lit(x) for x in fixed.TENS])
    scales = F.array(*[F.lit(x) for x in fixed.SCALES])

    def below_100(v: Column) -> Column:
        return F.when(v < 20, F.get(ones, v)).otherwise(
            F.concat(F.get(tens, F.floor(v / 10).cast("int")),
                     F.when(v % 10 > 0, F.concat(F.lit("-"), F.get(ones, v % 10))).otherwise(F.lit(""))))

    def below_1000(v: Column) -> Column:
        rest = v % 100
        return F.when(v < 100, below_100(v)).otherwise(
            F.concat(F.get(ones, F.floor(v / 100).cast("int")), F.lit(" hundred"),
                     F.when(rest > 0, F.concat(F.lit(" and "), below_100(rest))).otherwise(F.lit(""))))

    s = F.regexp_replace(digits, "^0+(?=.)", "")
    n = F.ceil(F.length(s) / 3).cast("int")
    padded = F.lpad(s, n * 3, "0")
    groups = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(padded, i * 3 + 1, F.lit(3)).cast("int"))
    named = F.transform(groups, lambda v, i: F.when(v > 0, F.concat(below_1000(v), F.get(scales, n - 1 - i))))
    last = F.get(groups, n - 1)
    joined = F.array_join(F.filter(F.slice(named, 1, n - 1), lambda w: w.isNotNull()), ", ")
    words = (F.when(last == 0, joined)
             .when(last < 100, F.concat(joined, F.lit(" and "), below_100(last)))
             .otherwise(F.concat(joined, F.lit(", "), below_1000(last))))
    return (F.when(~digits.rlike("^[0-9]+$") | (n > len(fixed.SCALES)), digits)
            .when(n == 1, below_1000(F.coalesce(s.try_cast("int"), F.lit(0)))).otherwise(words))

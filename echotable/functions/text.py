"""Text functions: built-in expressions where Spark has them, vectorized UDFs for Unicode forms and word distances."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"(?U)\s+", " ")


# Fixed value: marks that don't belong to a word.
EDGE = ".,!?\"'„():;[]{}<>…-–—"


def word(text: Column) -> Column:
    return F.btrim(F.lower(text), F.lit(EDGE))


def without_control(text: Column) -> Column:
    """Without model tokens of the form <|...|>, white space as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<\|[^|<>]*\|>", " "), r"(?U)\s+", " "))


# Fixed value: spellings of fillers.
FILLERS = ("ehm", "eee", "hm", "mhm")


def without_fillers(text: Column, fillers: tuple[str, ...] = FILLERS) -> Column:
    """Without filler words and the marks right behind them, pairs of marks left empty, blanks before marks, and the spaces all that leaves.

    A filler that closes a sentence takes the comma or slash before it instead, and leaves the sentence its end.
    """
    one = r"(?<![\w-])(?:" + "|".join(map(re.escape, fillers)) + r")(?![\w-])"
    # fixed values: what ends a sentence, what goes with a filler, which pairs can be empty
    out = F.regexp_replace(text, rf"(?iU)\s*[,/]\s*{one}\s*(?=[.…?!]|$)", "")
    out = F.regexp_replace(out, rf"(?iU){one}[,.…?!:;/]*", " ")
    out = F.regexp_replace(out, r"(?U)\(\s*\)|\[\s*\]|\"\s*\"|„\s*“|“\s*”|‚\s*‘|‘\s*’", " ")
    out = F.regexp_replace(out, r"(?U)\s+([,.!?;:])", "$1")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def asr_normal(text: Column) -> Column:
    """Lower case, punctuation, symbols, separators and controls as single spaces; input in composed form."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[\p{P}\p{S}\p{Z}\p{C}]", " "), " +", " "))


def query_tokens(text: Column, most: int = 32) -> Column:
    return F.slice(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{M}\p{Co}]*"), F.lit(0)), 1, most)


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[^a-z0-9._-]+", "-"), F.lit("-"))


def snippet(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("…"))).otherwise(text)


@F.pandas_udf(T.StringType())
def composed(text: pd.Series) -> pd.Series:
    """Canonical composition (NFC)."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def compatible(text: pd.Series) -> pd.Series:
    """Compatibility composition (NFKC)."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


_MARKS = re.compile(r"^\W+|\W+$")


def plain_word(w: str) -> str:
    """Compatibility composition, case folded, marks at the edges cut (NFKC)."""
    return _MARKS.sub("", unicodedata.normalize("NFKC", w).casefold())


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """Compatibility composition, case folded, marks at the edges of words cut (NFKC)."""
    return text.map(lambda t: " ".join(w for x in unicodedata.normalize("NFKC", t).casefold().split() if (w := _MARKS.sub("", x))), na_action="ignore")


def distance(a: list | str, b: list | str) -> int:
    """Levenshtein distance of two sequences, a whole column of the table at once.

    Neighbouring cells of a column differ by -1, 0 or 1. Two integers with a bit for each item of a hold where they rise
    and where they fall (Myers 1999, Hyyrö 2003), so an item of b costs a handful of operations on long integers.
    """
    start, end = 0, 0
    for x, y in zip(a, b):  # noqa: B905  equal ends cost nothing
        if x != y:
            break
        start += 1
    for x, y in zip(reversed(a[start:]), reversed(b[start:])):  # noqa: B905
        if x != y:
            break
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, last, bottom = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    rise, fall = full, 0
    for y in b:
        same = where.get(y, 0)
        level = same | fall
        across = ((same & rise) + rise ^ rise) | same
        up, down = fall | (full & ~(across | rise)), rise & across
        bottom += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & full, down << 1 & full
        rise, fall = down | (full & ~(level | up)), up & level
    return bottom


@F.pandas_udf(T.LongType())
def word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([distance((x or "").split(), (y or "").split()) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.LongType())
def char_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Levenshtein distance of texts by code points; null where either is null."""
    return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


AUTOJUNK = 200  # from so many characters on difflib leaves frequent ones out, and equal texts may have a lower ratio


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of matching blocks; the order of the two matters."""

    def ratio(x: str, y: str) -> float:
        return 1.0 if x == y and len(y) < AUTOJUNK else difflib.SequenceMatcher(None, x, y).ratio()

    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])

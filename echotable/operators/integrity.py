"""Texts of review spans, and whether what a workspace holds is what its source gives."""

from __future__ import annotations

import re
import unicodedata
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Fixed value: white space as browsers have it.
BLANKS = re.compile("[\\t-\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+")


def collapsed(text: str) -> str:
    """Composed (NFC), with single blanks inside and none at the edges."""
    return BLANKS.sub(" ", unicodedata.normalize("NFC", text)).strip(" ")


def texts(text: str, words: list[str], owners: list[int], spans: int) -> list[str]:
    """The text of each span: from the first of its words up to the next span's first word; the first span with words has what comes before as well.

    Where the words aren't found one behind the other in the text, or spans don't follow each other, a span's text is its words.
    """
    said = [(collapsed(w), o) for w, o in zip(words, owners, strict=True)]
    said = [(w, o) for w, o in said if w]
    ends, places = 0, []
    for w, _ in said:
        places.append(text.find(w, ends))
        ends = places[-1] + len(w)
        if places[-1] < 0:
            break
    if said and (places[-1] < 0 or any(a > b for (_, a), (_, b) in pairwise(said))):
        return [" ".join(w for w, o in said if o == span) for span in range(spans)]
    first = dict(reversed([(o, at) for (_, o), at in zip(said, places, strict=True)])) or {0: 0}
    cuts = sorted(first)
    bounds = [0, *(first[o] for o in cuts[1:]), len(text)]
    of = {o: collapsed(text[a:b]) for o, (a, b) in zip(cuts, pairwise(bounds), strict=True)}
    return [of.get(span, "") for span in range(spans)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def span_texts(text: pd.Series, words: pd.Series, owners: pd.Series, spans: pd.Series) -> pd.Series:
    """texts of each row; a null text or word is empty, null lists have no words."""
    rows = zip(text, words, owners, spans, strict=True)
    return pd.Series([texts(t or "", ["" if x is None else x for x in (w if w is not None else [])], list(o if o is not None else []), int(n)) for t, w, o, n in rows])


def differences(stored: DataFrame, made: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, columns, problem, times: rows that stored has more often than made (`unexpected`) or less often (`missing`), each with how much more often."""
    count = lambda df, sign: df.select(*keys, *columns, F.lit(sign).alias("sign"))
    both = count(stored, 1).unionByName(count(made, -1)).groupBy(*keys, *columns).agg(F.sum("sign").alias("more"))
    return both.where("more <> 0").select(*keys, *columns, F.when(F.col("more") > 0, "unexpected").otherwise("missing").alias("problem"), F.abs("more").alias("times"))


def problems(workspaces: DataFrame, **rules: Column) -> DataFrame:
    """workspace, problem: a row for each rule (a condition that must hold) that a workspace breaks; one that can't be told is broken."""
    broken = F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name.replace("_", " "))) for name, rule in rules.items()])
    return workspaces.select("workspace", F.explode(F.array_compact(broken)).alias("problem"))

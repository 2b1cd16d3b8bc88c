"""One form for what is said in many: fingerprints of transcripts and settings, and an order of names as people sort them."""

from __future__ import annotations

import hashlib
import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def json_number(values: pd.Series) -> pd.Series:
    """Numbers as JSON has them, rounded to six digits by their exact value, a whole one with its .0; null is null."""
    return values.map(lambda v: "null" if v is None or v != v else json.dumps(round(v, 6) if math.isfinite(v) else v))


@F.pandas_udf(T.StringType())
def json_text(values: pd.Series) -> pd.Series:
    """Texts as JSON has them, characters beyond ASCII as they are; null is null."""
    return values.map(lambda v: "null" if v is None else json.dumps(v, ensure_ascii=False))


def transcript_fingerprint(segments: DataFrame, keys: list[str], name: str = "audio_hash") -> DataFrame:
    """keys, segments (how many), fingerprint: SHA-256 of `{name: ..., "segments": [...]}`, keys of each object in order, without blanks.

    The segments of one transcript are put together in order of seg_idx; a transcript is what one task holds. NaN stands for null.
    """
    one = F.concat(F.lit('{"end":'), json_number("end_sec"), F.lit(',"start":'), json_number("start_sec"), F.lit(',"text":'), json_text("text"), F.lit("}"))
    parts = F.sort_array(F.collect_list(F.struct("seg_idx", one.alias("j"))))
    rows = segments.groupBy(*keys).agg(F.count("*").alias("segments"), F.array_join(parts["j"], ",").alias("body"))
    whole = F.concat(F.lit("{" + json.dumps(name) + ":"), json_text(name), F.lit(',"segments":['), F.col("body"), F.lit("]}"))
    return rows.select(*keys, "segments", F.sha2(whole, 256).alias("fingerprint"))


def settings_fingerprint(settings: dict) -> str:
    """SHA-256 of settings as JSON, whatever order they are given in."""
    return hashlib.sha256(json.dumps(settings, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def order_key(text: Column) -> Column:
    """A key that sorts names by letters regardless of case and accents, and runs of digits by their value; null for a null or empty text.

    A run of digits is led by its length without leading zeros, in a width that any length fits.
    """
    runs = F.regexp_extract_all(text, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    digits = lambda r: F.ltrim(r, F.lit("0"))
    padded = F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits(r)).cast("string"), 9, "0"), digits(r))).otherwise(r))
    return F.when(text != "", F.collate(F.array_join(padded, ""), "UNICODE_CI_AI"))


def in_order(df: DataFrame, column: str, nulls_first: bool = False, down: bool = False, *then: Column) -> DataFrame:
    """df sorted by the names of a column; missing ones last, or first, whichever way the rest goes."""
    key = order_key(F.col(column)) if dict(df.dtypes)[column].startswith("string") else F.col(column)
    ways = {(False, False): key.asc_nulls_last, (False, True): key.asc_nulls_first, (True, False): key.desc_nulls_last, (True, True): key.desc_nulls_first}
    return df.orderBy(ways[down, nulls_first](), *then)


def distinct_in_order(df: DataFrame, column: str) -> DataFrame:
    """column, nth: the trimmed, non-blank values, each once, numbered from 1 in order of names, values that are alike there in order of their bytes."""
    each = df.select(F.trim(column).alias(column)).where(F.col(column) != "").distinct()
    # few values as a rule; the key leads so that Spark can sort by ranges before it numbers
    return each.withColumn("nth", F.row_number().over(Window.orderBy(order_key(F.col(column)), column)).cast("long"))

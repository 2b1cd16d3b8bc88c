"""Speech recognition scoring: word and character error rates as ratios of sums, splits, reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .catalog import fingerprint, numbered


def errors(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """Adds word and character errors and reference lengths, on text as is and normalized."""
    for name, f in (("raw", lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))), ("norm", tx.asr_normal)):
        r, h = f(F.col(reference)), f(F.col(hypothesis))
        words = F.when(r == "", 0).otherwise(F.size(F.split(r, " ")))
        df = df.withColumns({f"{name}_word_errors": tx.word_distance(r, h), f"{name}_words": words.cast("long"), f"{name}_char_errors": tx.char_distance(r, h), f"{name}_chars": F.length(r).cast("long")})
    return df


def rate(errors: str, length: str) -> Column:
    """Sum of errors over sum of lengths, null without length; never a mean of ratios."""
    return F.round(F.sum(errors) / F.nullif(F.sum(length), F.lit(0)), 4)


def summary(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.groupBy(*keys).agg(F.count("*").alias("rows"), *[rate(f"{n}_{u}_errors", f"{n}_{u}s").alias(f"{n}_{k}") for n in ("raw", "norm") for u, k in (("word", "wer"), ("char", "cer"))])


def split_dev(recordings: DataFrame, key: str, part: float, seed: int) -> DataFrame:
    """(key, split): ceil(part n) recordings, at least one and not all, go to dev; which ones a seeded hash of the key decides."""
    r = recordings.select(key).distinct()
    n = r.count()
    take = min(max(1, math.ceil(round(part * n, 9))), max(n - 1, 0))
    # places in the order of the hash, numbered range by range, so that no task sorts them all
    placed = numbered(r, [F.xxhash64(F.lit(seed), key), F.col(key)])
    return placed.select(key, F.when(F.col("nth") < take, "dev").otherwise("train").alias("split"))


def worst(scored: DataFrame, key: str) -> DataFrame:
    """Hypotheses, highest word error rate first, ties by key."""
    wer = F.col("norm_word_errors") / F.nullif(F.col("norm_words"), F.lit(0))
    return scored.withColumn("wer", F.round(wer, 4)).orderBy(F.desc_nulls_last("wer"), key)


def report(rows: DataFrame, system: str, hypothesis: str | None = None) -> DataFrame:
    """rows (audio, text, machine_text, duration, and a hypothesis) -> one row: what a system scored on them, what the machine text scored, and a fingerprint of the rows.

    The fingerprint covers audio, text and machine text of all rows. Without a hypothesis the scores are null, and so are the machine's where no row has machine text.
    """
    scores = ("rows", "words", "raw_wer", "norm_wer", "norm_cer")

    def scored(df: DataFrame, column: str) -> DataFrame:
        e = errors(df.withColumn("hyp", F.col(column)).where(F.col("hyp").isNotNull()), "text", "hyp")
        return e.agg(F.count("*").alias("rows"), F.sum("raw_words").alias("words"), rate("raw_word_errors", "raw_words").alias("raw_wer"), rate("norm_word_errors", "norm_words").alias("norm_wer"), rate("norm_char_errors", "norm_chars").alias("norm_cer"))

    whole = rows.agg(F.count("*").alias("rows"), F.round(F.coalesce(F.sum("duration"), F.lit(0.0)) / 3600, 3).alias("hours"), F.count_if(F.col("machine_text").isNull()).alias("rows_without_machine_text"))
    digest = fingerprint(rows.select(F.lit(1).alias("one"), "audio", "text", "machine_text"), ["one"], ["audio", "text", "machine_text"]).select(F.col("fingerprint").alias("rows_sha256"))
    none = [F.lit(None).cast("double").alias(f"system_{c}") for c in scores]
    own = scored(rows, hypothesis).select(*[F.col(c).cast("double").alias(f"system_{c}") for c in scores]) if hypothesis else whole.select(*none)
    machine = scored(rows, "machine_text").select(*[F.col(c).cast("double").alias(f"machine_{c}") for c in scores])
    # one row each; rows without any have no digest
    return whole.select(F.lit(system).alias("system"), "*").join(digest, F.lit(True), "left").crossJoin(F.broadcast(own)).crossJoin(F.broadcast(machine))


def compared(reports: DataFrame) -> DataFrame:
    """Reports of the same rows -> a table: the machine's scores first, then each system's by name. Reports of other rows, or with another machine's scores, fail the read."""
    scores = ("rows", "words", "raw_wer", "norm_wer", "norm_cer")
    of = lambda side: F.struct(*[F.col(f"{side}_{c}").alias(c) for c in scores])
    same = reports.agg(F.count_distinct(F.coalesce("rows_sha256", F.lit(""))).alias("kinds"), F.count_distinct(F.when(F.col("machine_rows") > 0, of("machine").cast("string"))).alias("machines"))
    fault = F.when(F.col("kinds") > 1, "reports of different rows").when(F.col("machines") > 1, "reports with different machine scores")
    sound = F.when(fault.isNull(), F.lit(True)).otherwise(F.raise_error(fault).cast("boolean"))
    lines = reports.select("system", F.explode(F.array(F.struct(F.lit(1).alias("nth"), F.col("system").alias("name"), of("system").alias("s")), F.struct(F.lit(0).alias("nth"), F.lit("machine").alias("name"), of("machine").alias("s")))).alias("l"))
    lines = lines.select("l.nth", F.col("l.name").alias("system"), "l.s.*").where("rows > 0").distinct()
    return lines.crossJoin(F.broadcast(same)).where(sound).select("nth", "system", *scores).orderBy("nth", "system")

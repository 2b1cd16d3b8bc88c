"""Usage and audit analytics over event rows: plays, buckets, summaries, rollups, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plays(audit: DataFrame) -> DataFrame:
    """Events at which a user turns to another resource; repeats in a row are one play. Equal times are ordered by event_id."""
    w = Window.partitionBy("user_id").orderBy("created_at", "event_id")
    before = F.lag("resource_id").over(w)
    return audit.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("resource_id"))).drop("before")


def buckets(audit: DataFrame, unit: str) -> DataFrame:
    return audit.groupBy(F.date_trunc(unit, "created_at").alias("bucket")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def actions(audit: DataFrame, unit: str, played: str) -> DataFrame:
    """Events and users by bucket and action, where repeated rows of the action `played` count as plays."""
    p = plays(audit.where(F.col("resource_id") == played)).withColumn("action", F.lit("play"))
    o = audit.where(F.col("resource_id") != played).withColumn("action", F.col("resource_id"))
    return p.unionByName(o).groupBy(F.date_trunc(unit, "created_at").alias("bucket"), "action").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def latest(df: DataFrame, keys: list[str], by: list[str], columns: list[str]) -> DataFrame:
    """The columns of each key's last row."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*by)).alias("__last")).select(*keys, "__last.*")


def summary(audit: DataFrame, keys: list[str], good: Column, weight: Column) -> DataFrame:
    """Calls, distinct users, successes and the mean value weighted by calls; null without weight."""
    return audit.groupBy(*keys).agg(F.count("*").alias("calls"), F.count_distinct("user_id").alias("users"), F.count(F.when(good, 1)).alias("successes"), (F.sum(F.col("value") * weight) / F.nullif(F.sum(weight), F.lit(0))).alias("mean_value"))


def rollup(daily: DataFrame, raw: DataFrame, days_before: Column) -> tuple[DataFrame, DataFrame]:
    """Raw rows older than a day join the daily table; returns (daily, what stays raw). All measures merge associatively."""
    old = raw.where(F.col("created_at") < days_before)
    fresh = old.groupBy(F.date_trunc("day", "created_at").alias("day"), "user_id", "resource_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    both = daily.unionByName(fresh).groupBy("day", "user_id", "resource_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    return both, raw.where(F.col("created_at") >= days_before)


def top(df: DataFrame, measure: str, ties: list[str], n: int) -> DataFrame:
    return df.orderBy(F.desc(measure), *ties).limit(n)


def series(audit: DataFrame, version: Column, first: str, last: str, most: int) -> DataFrame:
    """Distinct users a day and version, the `most` largest versions by name and the rest as other, over a full calendar."""
    rows = audit.select(F.date_trunc("day", "created_at").alias("day"), F.coalesce(version, F.lit("unknown")).alias("version"), "user_id")
    ranked = rows.where("version <> 'unknown'").groupBy("version").agg(F.count_distinct("user_id").alias("u")).orderBy(F.desc("u"), "version").limit(most).select("version", F.lit(True).alias("named"))
    rows = rows.join(F.broadcast(ranked), "version", "left").withColumn("version", F.when(F.col("named") | (F.col("version") == "unknown"), F.col("version")).otherwise("other"))
    seen = rows.groupBy("day", "version").agg(F.count_distinct("user_id").alias("users"))
    days = audit.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp"), F.expr("interval 1 day"))).alias("day"))
    grid = days.crossJoin(F.broadcast(seen.select("version").distinct()))  # days by a handful of names
    return grid.join(seen, ["day", "version"], "left").withColumn("users", F.coalesce("users", F.lit(0)))


def periods(audit: DataFrame, start: str, now: str) -> DataFrame:
    """Counts in [start, now] beside those of the equal period before, in one pass."""
    s, n = F.lit(start).cast("timestamp"), F.lit(now).cast("timestamp")
    length = F.unix_timestamp(n) - F.unix_timestamp(s)
    t = F.col("created_at")
    cur, prev = (t >= s) & (t <= n), (t >= F.timestamp_seconds(F.unix_timestamp(s) - length)) & (t < s)
    each = lambda c, x: [F.count(F.when(c, 1)).alias(f"events_{x}"), F.count_distinct(F.when(c, F.col("user_id"))).alias(f"users_{x}"), F.count(F.when(c & (F.col("resource_id") == "error"), 1)).alias(f"errors_{x}")]
    return audit.agg(*each(cur, "now"), *each(prev, "before"))

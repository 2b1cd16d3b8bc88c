"""Interval algebra on (start, end) columns within keys: union, timelines, overlap and containment joins, coverage.

All of it is window functions and equi-joins with a range residue, partitioned by the keys; a recording is one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union(df: DataFrame, keys: list[str], start: str = "start_sec", end: str = "end_sec", tolerance: float = 1e-6, drop_empty: bool = True) -> DataFrame:
    """Merged intervals (keys, start, end, n_merged); those closer than the tolerance touch."""
    rows = df.where(F.col(end) > F.col(start)) if drop_empty else df
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach + tolerance), 1).otherwise(0))
    rows = rows.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).drop("__island")


def timeline(df: DataFrame, keys: list[str], start: str = "start_sec", end: str = "end_sec", seed: float | None = None, digits: int | None = None, least: float = 0.0) -> DataFrame:
    """Consecutive pairs of the distinct boundaries: (keys, lo, hi) with hi - lo > least. seed adds a boundary to each key."""
    points = F.array(F.col(start), F.col(end), *([F.lit(seed)] if seed is not None else []))
    p = df.select(*keys, F.explode(points).alias("lo")).where(F.col("lo").isNotNull() & ~F.isnan("lo"))
    if digits is not None:
        p = p.withColumn("lo", F.round("lo", digits))
    p = p.distinct().withColumn("hi", F.lead("lo").over(Window.partitionBy(*keys).orderBy("lo")))
    return p.where(F.col("hi") - F.col("lo") > least)


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], epsilon: float | None = None) -> DataFrame:
    """Pairs of left (lo, hi) and right (start_sec, end_sec) rows of one key that overlap; with epsilon, where right contains left."""
    r = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k) == F.col(f"__{k}") for k in keys]
    if epsilon is None:
        on += [F.col("end_sec") > F.col("lo"), F.col("start_sec") < F.col("hi")]
    else:
        on += [F.col("start_sec") <= F.col("lo") + epsilon, F.col("end_sec") >= F.col("hi") - epsilon]
    return left.join(r, on).drop(*[f"__{k}" for k in keys])


def shared_length(lo: Column, hi: Column, start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(hi, end) - F.greatest(lo, start))


def covered(segments: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The timeline of each key with how many sources cover each stretch (degree) and which."""
    found = overlapping(timeline(segments, keys), segments, keys, epsilon=1e-6)
    return found.groupBy(*keys, "lo", "hi").agg(F.array_sort(F.collect_set(by)).alias("sources")).withColumn("degree", F.size("sources").cast("long"))


def merge_adjacent(stretches: DataFrame, keys: list[str], same: str = "sources", gap: float = 1e-2) -> DataFrame:
    """Neighbouring stretches with the same sources, less than a gap apart, become one."""
    order = Window.partitionBy(*keys).orderBy("lo")
    new = (F.col(same) != F.lag(same).over(order)) | (F.col("lo") - F.lag("hi").over(order) >= gap)
    rows = stretches.withColumn("__new", F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0))
    rows = rows.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(*keys, "__run").agg(F.first(same).alias(same), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n_merged")).drop("__run")


def coverage_stats(stretches: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds and stretches of degree 1, 2 and 3 exactly; higher degrees count in no class."""
    length = F.col("hi") - F.col("lo")
    out = []
    for d in (1, 2, 3):
        out += [F.coalesce(F.sum(F.when(F.col("degree") == d, length)), F.lit(0.0)).alias(f"seconds_{d}"), F.count(F.when(F.col("degree") == d, 1)).alias(f"count_{d}")]
    return stretches.groupBy(*keys).agg(*out, F.sum(length).alias("covered"))


BUCKETS = (0.0, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0)


def histogram(df: DataFrame, keys: list[str], length: Column, edges: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Rows by half-open bucket of length, zero buckets included."""
    spark = df.sparkSession
    nth = sum((F.when(length >= e, 1).otherwise(0) for e in edges[1:]), F.lit(0))
    counted = df.groupBy(*keys, nth.cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    grid = df.select(*keys).distinct().crossJoin(F.broadcast(spark.range(len(edges)).withColumnRenamed("id", "bucket")))  # a fixed few rows
    return grid.join(counted, [*keys, "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


PERCENTS = (25, 50, 75, 90, 95, 99)


def percentiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact percentiles by linear interpolation of the positive values, with minimum, maximum and mean."""
    exact = [F.percentile(value, p / 100).alias(f"p{p}") for p in PERCENTS]
    return df.where(F.col(value) > 0).groupBy(*keys).agg(*exact, F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.count("*").alias("n"))


def windows_of_models(events: DataFrame, keys: list[str], tolerance: float, least_models: int) -> DataFrame:
    """Event windows (start_sec, end_sec, models array) merged within the tolerance; those of enough models."""
    order = Window.partitionBy(*keys).orderBy("start_sec", "end_sec")
    reach = F.max("end_sec").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = events.withColumn("__new", F.when(reach.isNull() | (F.col("start_sec") > reach + tolerance), 1).otherwise(0))
    rows = rows.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = rows.groupBy(*keys, "__island").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("models")))).alias("models"), F.count("*").alias("n_events"))
    return out.where(F.size("models") >= least_models).drop("__island")

"""Normalizing and checking transcript records, and reports over them: all expressions, windows and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-3  # by which a word may leave its segment


def first_text(*candidates: Column) -> Column:
    """The first one that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in candidates])


def normalized(df: DataFrame, keys: list[str], order: list[str], start: str = "start_sec", end: str = "end_sec", lower: Column | None = None, upper: Column | None = None) -> DataFrame:
    """Intervals in order, each beginning where the one before ended at the earliest, and none ending before it begins.

    What an interval may begin at is the latest start or end of all before it, a running maximum. With `upper` both
    ends stay within it; one that lies outside is left without length at the nearer boundary. Rounded to microseconds.
    """
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    floor = F.coalesce(lower, F.lit(0.0)) if lower is not None else F.lit(0.0)
    at_least = F.greatest(F.coalesce(F.max(F.greatest(start, end)).over(before), floor), floor)
    first = F.greatest(at_least, F.col(start))
    last = F.greatest(first, F.col(end))
    if upper is not None:
        first, last = F.least(upper, first), F.least(upper, last)
    return df.withColumns({"__start": F.round(first, 6), "__end": F.round(last, 6)}).withColumns({start: F.col("__start"), end: F.col("__end")}).drop("__start", "__end")


def confidence(scores: Column, logprob: Column) -> Column:
    """The mean of a segment's word scores, else e to its log probability; within 0 and 1, null if there is neither."""
    known = F.filter(scores, lambda x: x.isNotNull())
    within = F.transform(known, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    mean = F.aggregate(within, F.lit(0.0), lambda a, x: a + x) / F.size(within)
    return F.when(F.size(known) > 0, mean).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(logprob))))


def fallback_confidence(scalar: Column, *means: Column) -> Column:
    """A segment's own confidence, else the mean of the first array of scores that has any."""
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))
    return F.coalesce(scalar, *map(mean, means))


def documents(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and the text of each transcript, its segments' texts in order of time."""
    text = F.trim("text")
    words = F.when(text == "", 0).otherwise(F.size(F.split(text, r"\s+")))
    parts = F.array_sort(F.collect_list(F.when(text != "", F.struct("start_sec", "seg_idx", text.alias("t")))))
    return segments.groupBy(*keys).agg(F.count("*").alias("num_segments"), F.sum(words).cast("long").alias("num_words"), F.max("end_sec").alias("duration"), F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("transcript_text"))


def issues(items: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per transcript how many items break a rule of times or confidence. The previous end is the last one known."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    checked = items.withColumn("__before", F.last("end_sec", ignorenulls=True).over(before))
    s, e, c = F.col("start_sec"), F.col("end_sec"), F.col("confidence")
    rules = {"missing_time": s.isNull() | e.isNull(), "negative_start": s < 0, "ends_before_start": e < s, "not_monotone": (s < F.col("__before")) & e.isNotNull(), "confidence_range": ~c.between(0, 1)}
    return checked.groupBy(*keys).agg(F.count("*").alias("items"), *[F.count(F.when(rule, 1)).alias(name) for name, rule in rules.items()])


def words_outside(words: DataFrame, segments: DataFrame, keys: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Words that leave their segment by more than the tolerance."""
    s = segments.select(*keys, F.col("start_sec").alias("lo"), F.col("end_sec").alias("hi"))
    return words.join(s, keys).where((F.col("word_start") < F.col("lo") - tolerance) | (F.col("word_end") > F.col("hi") + tolerance))


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, median, extremes and sample deviation; 0 where there is nothing, or for the deviation of one value."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*keys).agg(F.count(value).alias("n"), *[zero(f(value)).alias(n) for n, f in (("mean", F.avg), ("median", F.median), ("least", F.min), ("most", F.max), ("deviation", F.stddev_samp))])


def latency(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    p = lambda q: F.percentile(value, q)
    return df.groupBy(*keys).agg(F.min(value).alias("least"), F.avg(value).alias("mean"), p(0.5).alias("median"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.max(value).alias("most"))


def sentences(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Sentences, words and sentences a minute. A sentence ends at each of . ! ?, at a gap of more than a second, and with the last words."""
    w = Window.partitionBy(*keys).orderBy("start_sec", "seg_idx")
    text = F.trim("text")
    s = segments.withColumns({"__w": F.when(text == "", 0).otherwise(F.size(F.split(text, r"\s+"))), "__p": F.length("text") - F.length(F.regexp_replace("text", "[.!?]", "")), "__g": F.coalesce((F.col("start_sec") - F.lag("end_sec").over(w) > 1.0).cast("int"), F.lit(0)), "__i": F.row_number().over(w)})
    every = Window.partitionBy(*keys)
    s = s.withColumns({"__mark": F.coalesce(F.max(F.when(F.col("__p") > 0, F.col("__i"))).over(every), F.lit(0)), "__gap": F.coalesce(F.max(F.when(F.col("__g") > 0, F.col("__i"))).over(every), F.lit(0))})
    trailing = F.sum(F.when((F.col("__i") > F.col("__mark")) & (F.col("__i") >= F.col("__gap")), F.col("__w")).otherwise(0))
    out = s.groupBy(*keys).agg((F.sum("__p") + F.sum("__g") + F.when(trailing > 0, 1).otherwise(0)).cast("long").alias("sentences"), F.sum("__w").cast("long").alias("words"), F.max("end_sec").alias("seconds"))
    return out.withColumn("per_minute", F.when(F.col("seconds") > 0, F.col("sentences") / (F.col("seconds") / 60)).otherwise(0.0))


def nearest_region(words: DataFrame, regions: DataFrame, keys: list[str], width: float = 30.0) -> DataFrame:
    """Each word's region of its keys and how far away it is: the first that holds the word's middle, else the nearest, of two as near the first.

    Regions that hold a middle are joined on bins of time. Of those before it the one that ends last counts, of those behind it the one that
    begins first; both are running extremes over words and regions in one order of time. A word of keys without regions, or without times, drops out.
    """
    w = words.where(F.col("word_start").isNotNull() & F.col("word_end").isNotNull()).withColumn("__m", (F.col("word_start") + F.col("word_end")) / 2)
    r = regions.where(F.col("hi") >= F.col("lo")).select(*keys, "region", "lo", "hi")
    bin_of = lambda c: F.floor(c / F.lit(width))
    binned = r.withColumn("__bin", F.explode(F.sequence(bin_of(F.col("lo")), bin_of(F.col("hi")))))
    held = w.withColumn("__bin", bin_of(F.col("__m"))).join(binned, [*keys, "__bin"]).where("__m BETWEEN lo AND hi").select(*words.columns, "region", F.lit(0.0).alias("away"))
    null = lambda t: F.lit(None).cast(t)
    kind, names = dict(r.dtypes)["region"], [c for c in words.columns if c not in keys]
    empty = [null(t).alias(c) for c, t in words.dtypes if c not in keys]
    beside = []
    for edge, ahead in (("hi", False), ("lo", True)):
        of = F.struct((F.col(edge) if ahead else -F.col(edge)).alias("far"), F.col("region").alias("region"))
        rows = r.select(*keys, F.col(edge).alias("__t"), F.lit(0).alias("__w"), of.alias("__r"), *empty).unionByName(w.select(*keys, F.col("__m").alias("__t"), F.lit(1).alias("__w"), null(f"struct<far:double,region:{kind}>").alias("__r"), *names))
        order = Window.partitionBy(*keys).orderBy(F.desc("__t") if ahead else F.asc("__t"), "__w").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        near = rows.withColumn("__best", F.min("__r").over(order)).where("__w = 1 AND __best IS NOT NULL")
        beside.append(near.select(*words.columns, F.col("__best.region").alias("region"), (F.col("__best.far") - F.col("__t") if ahead else F.col("__best.far") + F.col("__t")).alias("away")))
    every = held.unionByName(beside[0]).unionByName(beside[1])
    return every.groupBy(*words.columns).agg(F.min(F.struct("away", "region")).alias("m")).select(*words.columns, "m.region", "m.away")


def overlap_texts(spans: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (keys, lo, hi) with the text of the segments that overlap them and the share covered; overlaps count twice, to 1 at most."""
    s = segments.select(*keys, "seg_idx", "start_sec", "end_sec", F.trim("text").alias("t"))
    j = spans.join(s, keys, "left").where((F.col("end_sec") > F.col("lo")) & (F.col("start_sec") < F.col("hi")))
    shared = F.least("hi", "end_sec") - F.greatest("lo", "start_sec")
    parts = F.array_sort(F.collect_list(F.when(F.col("t") != "", F.struct("start_sec", "seg_idx", "t"))))
    return j.groupBy(*keys, "lo", "hi").agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("said"), F.least(F.lit(1.0), F.sum(shared) / (F.col("hi") - F.col("lo"))).alias("share"))


def ranked(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= most)


def samples(intervals: DataFrame, keys: list[str], degree: int, most: int) -> DataFrame:
    """Of each group the first intervals in time of at least that degree, or where it has none the first of all."""
    full = F.col("degree") >= degree
    some = intervals.withColumn("__any", F.max(full).over(Window.partitionBy(*keys))).where(full | ~F.col("__any"))
    return ranked(some.drop("__any"), keys, [F.col("lo")], most)


def joined_text(tokens: Column) -> Column:
    """Tokens as a text: no space before closing marks nor after opening ones."""
    text = F.array_join(F.filter(F.transform(tokens, F.trim), lambda t: t != ""), " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r" +([.,!?;:)\]}])", "$1"), r"([(\[{]) +", "$1"))


def ordered_sources(parts: DataFrame, keys: list[str], order: str, source: str) -> DataFrame:
    """Each output's sources in their order."""
    pair = F.struct(F.col(order).alias("o"), F.col(source).alias("s"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["s"]).alias("sources"))


def repeated_signatures(grouped: DataFrame, key: str) -> DataFrame:
    """Outputs made of the same sources in the same order as another one, with the first such output."""
    same = grouped.groupBy("sources").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")
    return grouped.join(same, "sources").select(key, "first", "n")


def coverage(expected: DataFrame, present: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """How many expected keys are present, missing, or stale (their value is off by more than the tolerance), and how many more there are."""
    a, b = expected.select(F.col(key).alias("k"), F.col(value).alias("want")), present.select(F.col(key).alias("p"), F.col(value).alias("have"))
    j = a.join(b, F.col("k") == F.col("p"), "full")
    off = F.abs(F.col("want") - F.col("have")) > tolerance
    n = lambda c: F.count(F.when(c, 1))
    counts = j.agg(n(F.col("k").isNotNull()).alias("expected"), n(F.col("k").isNotNull() & F.col("p").isNotNull()).alias("present"), n(F.col("p").isNull()).alias("missing"), n(off).alias("stale"), n(F.col("k").isNull()).alias("orphaned"))
    return counts.withColumn("first_error", F.when(F.col("missing") > 0, "missing").when(F.col("stale") > 0, "stale").when(F.col("orphaned") > 0, "orphaned"))


def page_with_totals(df: DataFrame, order: list[Column], value: str, limit: int, offset: int) -> DataFrame:
    """One page, each row beside the count and the sum of all rows. The totals are one row, joined to the page."""
    totals = df.agg(F.count("*").alias("total"), F.sum(value).alias("total_value"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(totals))


def last_activity(users: DataFrame, key: str, logs: dict[str, DataFrame]) -> DataFrame:
    """The latest of several logs (who, at) of each user; null for one that is in none."""
    out = users
    for name, log in logs.items():
        out = out.join(log.groupBy(F.col("who").alias(f"who_{name}")).agg(F.max("at").alias(f"at_{name}")), F.col(key) == F.col(f"who_{name}"), "left").drop(f"who_{name}")
    return out.withColumn("last_at", F.greatest(*[f"at_{n}" for n in logs]))

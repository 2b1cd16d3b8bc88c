"""Transcripts: extraction of segments under three rules, comparison of models, validation, subtitles, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals


def segments_timed(df: DataFrame) -> DataFrame:
    """For time analysis: numbers or nothing, empty texts stay, segments without length go."""
    rows = df.select("audio_hash", "model_key", "seg_idx", F.expr("try_cast(start_sec AS double)").alias("start_sec"), F.expr("try_cast(end_sec AS double)").alias("end_sec"), F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    return rows.where("end_sec > start_sec")


def segments_worded(df: DataFrame) -> DataFrame:
    """For text analysis: segments without length stay, empty texts go, file order stays."""
    return df.where(F.trim(F.coalesce("text", F.lit(""))) != "")


def segments_chunkable(df: DataFrame) -> DataFrame:
    """For chunking: empty texts go, ends before their start move to it."""
    return segments_worded(df).withColumn("end_sec", F.greatest("start_sec", "end_sec"))


def normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"(?U)\s+", " ")


def compare(segments: DataFrame) -> DataFrame:
    """Per recording: intervals with two models or more that agree in text, those that don't, seconds of either."""
    keys = ["audio_hash"]
    stretches = intervals.timeline(segments, keys, seed=0.0, digits=3, least=1e-3)
    found = intervals.overlapping(stretches, segments, keys)
    order = F.struct("start_sec", "seg_idx")
    texts = found.groupBy(*keys, "lo", "hi", "model_key").agg(F.array_sort(F.collect_list(F.struct(order.alias("at"), F.col("text").alias("text")))).alias("parts"))
    texts = texts.select(*keys, "lo", "hi", "model_key", normal(F.array_join(F.transform("parts", lambda p: p["text"]), " ")).alias("said"))
    each = texts.groupBy(*keys, "lo", "hi").agg(F.count("*").alias("models"), F.count_distinct("said").alias("versions"))
    length = F.col("hi") - F.col("lo")
    two = F.col("models") >= 2
    return each.groupBy(*keys).agg(
        F.count(F.when(two & (F.col("versions") == 1), 1)).alias("agreements"),
        F.count(F.when(two & (F.col("versions") > 1), 1)).alias("disagreements"),
        F.coalesce(F.sum(F.when(two & (F.col("versions") == 1), length)), F.lit(0.0)).alias("agreed_sec"),
        F.coalesce(F.sum(F.when(two & (F.col("versions") > 1), length)), F.lit(0.0)).alias("disagreed_sec"),
    )


WEIGHTS = {"empty_text": 5, "bad_times": 20, "not_monotone": 10, "crossings": 5}


def validate(df: DataFrame) -> DataFrame:
    """Issue counts, severity and a quality score of each transcript. Invalid times don't move the running state."""
    good = F.col("end_sec") > F.col("start_sec")
    order = Window.partitionBy("audio_hash", "model_key").orderBy("seg_idx")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("good", F.coalesce(good, F.lit(False)))
    last = F.last(F.when(F.col("good"), F.col("start_sec")), ignorenulls=True).over(before)
    reach = F.max(F.when(F.col("good"), F.col("end_sec"))).over(before)
    rows = rows.withColumns({"late": F.col("good") & (F.col("start_sec") < last - 1e-6), "over": F.col("good") & (F.col("start_sec") < reach - 1e-3), "blank": F.trim(F.coalesce("text", F.lit(""))) == ""})
    count = lambda c: F.count(F.when(c, 1))
    out = rows.groupBy("audio_hash", "model_key").agg(F.count("*").alias("segments"), count(F.col("blank")).alias("empty_text"), count(~F.col("good")).alias("bad_times"), count(F.col("late")).alias("not_monotone"), count(F.col("over")).alias("crossings"))
    loss = sum(F.col(k) * w for k, w in WEIGHTS.items())
    score = F.greatest(F.lit(0), F.lit(100) - loss).cast("long")
    return out.withColumn("score", score).withColumn("severity", F.when(F.col("bad_times") > 0, "high").when(F.col("not_monotone") + F.col("crossings") > 0, "medium").when(F.col("empty_text") > 0, "low").otherwise("none"))


def timestamp(seconds: Column, point: str) -> Column:
    """HH:MM:SS and milliseconds, never below zero."""
    ms = F.greatest(F.lit(0), F.bround(seconds * 1000)).cast("long")
    part = lambda by, mod: (F.floor(ms / by) % mod).cast("long")
    return F.format_string(f"%02d:%02d:%02d{point}%03d", F.floor(ms / 3_600_000).cast("long"), part(60_000, 60), part(1000, 60), ms % 1000)


def subtitles(df: DataFrame, form: str, keys: tuple[str, ...] = ("audio_hash", "model_key")) -> DataFrame:
    """(keys, body) as srt, vtt or txt. Cues with blank text or no length are left out, and srt numbers the rest from 1."""
    rows = df.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).where(F.col("text") != "")
    if form != "txt":
        rows = rows.where("end_sec > start_sec")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("start_sec", "seg_idx"))
    point = "," if form == "srt" else "."
    times = F.concat(timestamp(F.col("start_sec"), point), F.lit(" --> "), timestamp(F.col("end_sec"), point))
    rows = rows.withColumn("nth", nth)
    cue = {"srt": F.concat_ws("\n", F.col("nth").cast("string"), times, "text"), "vtt": F.concat_ws("\n", times, "text"), "txt": F.col("text")}[form]
    cues = rows.select(*keys, F.struct("nth", cue.alias("cue")).alias("c")).groupBy(*keys).agg(F.array_sort(F.collect_list("c")).alias("cs"))
    body = F.concat(F.array_join(F.transform("cs", lambda c: c["cue"]), "\n" if form == "txt" else "\n\n"), F.lit("\n"))
    return cues.select(*keys, (F.concat(F.lit("WEBVTT\n\n"), body) if form == "vtt" else body).alias("body"))


def page(df: DataFrame, lo: float, hi: float, budget: int, keys: tuple[str, ...] = ("audio_hash",)) -> DataFrame:
    """Segments that overlap [lo, hi), in order, until their texts exceed the budget; the first comes always."""
    rows = df.where((F.col("end_sec") > lo) & (F.col("start_sec") < hi))
    order = Window.partitionBy(*keys).orderBy("start_sec", "seg_idx")
    rows = rows.withColumns({"nth": F.row_number().over(order), "chars": F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    return rows.where((F.col("chars") <= budget) | (F.col("nth") == 1))


def adjacent_repeats(df: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """Runs of equal neighbouring texts: (keys, said, first, n), n >= 2."""
    w = Window.partitionBy(*keys).orderBy(order)
    said = normal(F.col(text))
    rows = df.select(*keys, F.col(order).alias("at"), said.alias("said")).where("said <> ''")
    w = Window.partitionBy(*keys).orderBy("at")
    rows = rows.withColumn("new", F.when(F.coalesce(F.col("said") != F.lag("said").over(w), F.lit(True)), 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(*keys, "run").agg(F.first("said").alias("said"), F.min("at").alias("first"), F.count("*").alias("n")).where("n >= 2").drop("run")


def interpolated_words(df: DataFrame) -> DataFrame:
    """Evenly spaced times for the words of a segment; the last one ends with it."""
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    cut = df.where("end_sec > start_sec").select("audio_hash", "model_key", "seg_idx", "start_sec", "end_sec", F.explode(F.array(words)).alias("words"))  # explode, so that the array is made once
    rows = cut.select("audio_hash", "model_key", "seg_idx", "start_sec", "end_sec", F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    step = (F.col("end_sec") - F.col("start_sec")) / F.col("n")
    return rows.select("audio_hash", "model_key", "seg_idx", F.col("i").cast("long").alias("i"), "word", F.round(F.col("start_sec") + step * F.col("i"), 6).alias("word_start"), F.when(F.col("i") == F.col("n") - 1, F.col("end_sec")).otherwise(F.round(F.col("start_sec") + step * (F.col("i") + 1), 6)).alias("word_end"))


def split_long(df: DataFrame, limit: float) -> DataFrame:
    """Segments longer than the limit in pieces of it."""
    n = F.greatest(F.lit(1), F.ceil((F.col("end_sec") - F.col("start_sec")) / limit)).cast("int")
    rows = df.where("end_sec > start_sec").select("audio_hash", "model_key", "seg_idx", "start_sec", "end_sec", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    return rows.select("audio_hash", "model_key", "seg_idx", F.col("i").cast("long").alias("i"), (F.col("start_sec") + F.col("i") * limit).alias("piece_start"), F.least("end_sec", F.col("start_sec") + (F.col("i") + 1) * limit).alias("piece_end"))

"""A corpus of chunks from the transcripts of one backend, with a count of what was left out and why."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import stored
from . import chunking

HASH = "^[0-9a-f]{64}$"


def sources(transcripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """transcripts (audio_hash, path, segments array<struct<start, end, text>> or null) -> (usable, skipped (path, reason)).

    A hash that isn't whole and a transcript that couldn't be read are skipped. Two usable transcripts of one hash fail the read that reaches them.
    """
    reason = F.when(~F.coalesce(F.col("audio_hash").rlike(HASH), F.lit(False)), "not a whole hash").when(F.col("segments").isNull(), "unreadable")
    rows = transcripts.withColumn("reason", reason)
    good = rows.where("reason IS NULL").drop("reason")
    n = F.count("*").over(Window.partitionBy("audio_hash"))
    said = F.concat(F.lit("several transcripts of "), F.col("audio_hash"), F.lit(": "), F.col("path"))
    single = good.withColumn("__n", n).where(F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(said).cast("boolean"))).drop("__n")
    return single, rows.where("reason IS NOT NULL").select("path", "reason")


def build(transcripts: DataFrame, group: str, backend: str, version: str, least: int = 220, most: int = 300, overlap: int = 50, count: Callable[[str], int] = chunking.count_tokens) -> tuple[DataFrame, DataFrame]:
    """(chunks, report): chunks are chunk_id, audio_hash, path, chunk_ordinal, start_sec, end_sec, text, token_count, each id once; the report has one row: transcripts, skipped, chunks, and the distribution of token counts.

    A segment without text is left out, one that ends before it starts ends where it starts. A transcript without segments has no chunks and isn't skipped. An empty scope
    gives a report of zeros.
    """
    usable, skipped = sources(transcripts)
    s = usable.select("audio_hash", F.lit(backend).alias("model_key"), F.posexplode("segments").alias("seg_idx", "s"))
    s = s.select("audio_hash", "model_key", F.col("seg_idx").cast("long").alias("seg_idx"), F.col("s.start").alias("start_sec"), F.greatest("s.start", "s.end").alias("end_sec"), F.trim("s.text").alias("text")).where("text <> '' AND start_sec IS NOT NULL AND end_sec IS NOT NULL")
    made = chunking.chunks(s, least, most, overlap, count).withColumn("chunk_id", chunking.chunk_id(F.lit(group), F.lit(backend), version))
    made = stored(made.join(usable.select(F.col("audio_hash").alias("__h"), "path"), F.col("audio_hash") == F.col("__h")).drop("__h", "model_key", "overflow"))
    last = Window.partitionBy("chunk_id").orderBy(F.desc("chunk_ordinal"))
    chunks = made.withColumn("__nth", F.row_number().over(last)).where("__nth = 1").drop("__nth")
    audit = chunking.token_audit(made.withColumn("__all", F.lit(1)), ["__all"], "token_count", least, most).drop("__all", "chunks")
    numbers = transcripts.agg(F.count("*").alias("transcripts")).crossJoin(F.broadcast(skipped.agg(F.count("*").alias("skipped")))).crossJoin(F.broadcast(chunks.agg(F.count("*").alias("chunks"))))  # one row each
    return chunks, numbers.join(audit, F.lit(True), "left")

"""Structured Streaming over event files: tumbling counts, sessions, plays with state, incremental rollup.

Late data: rows more than the watermark behind the latest event are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, files_at_once: int = 8) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def to_parquet(stream: DataFrame, folder: str, checkpoint: str, mode: str):
    """Runs stream over all there is; each batch is a folder of its own, which a batch that is run again overwrites."""
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/batch={n}")
    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(out: DataFrame, keys: list[str]) -> DataFrame:
    """What the last batch that names a key says of it."""
    rest = [c for c in out.columns if c not in (*keys, "batch")]
    if not rest:
        return out.select(keys).distinct()
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def plays(events: DataFrame, buckets: int = 1024) -> DataFrame:
    """A running number of plays by user: changes of the event type, over batches. Within a batch rows are in order of time. No type is another play each time.

    Users share a state by a hash, as a state and a call of pandas for each of them would take far longer than their rows. A checkpoint holds for one number of `buckets`.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {user: (kind, n) for user, kind, n in json.loads(state.get[0])} if state.exists else {}
        rows = pd.concat(parts).sort_values(["nobody", "user_id", "at", "event_id"])
        nobody, user, kind, none = rows["nobody"].to_numpy(), rows["user_id"].to_numpy(), rows["event_type"].to_numpy(object), rows["event_type"].isna().to_numpy()
        begin = np.flatnonzero(np.append(True, (user[1:] != user[:-1]) | (nobody[1:] != nobody[:-1])))
        new = none | np.append(True, kind[1:] != kind[:-1])
        new[begin] = True
        out = []
        for i, end, n in zip(begin, [*begin[1:], len(rows)], np.add.reduceat(new.astype("i8"), begin).tolist(), strict=True):
            who = None if nobody[i] else int(user[i])
            last, before = known.get(who, (None, 0))
            known[who] = (None if none[end - 1] else kind[end - 1], before + n - (not none[i] and kind[i] == last))
            out.append((who, known[who][1]))
        state.update((json.dumps([(who, *x) for who, x in known.items()]),))
        yield pd.DataFrame({"user_id": pd.array([who for who, _ in out], "Int64"), "plays": [n for _, n in out]})

    # numbers without nulls, which pandas would make floats; what has none comes last
    most = F.lit(2**63 - 1)
    whole = [F.isnull("user_id").alias("nobody"), F.coalesce("user_id", F.lit(0)).cast("long").alias("user_id"), F.coalesce(F.unix_micros("ts"), most).alias("at"), F.coalesce("event_id", most).alias("event_id")]
    rows = events.select(F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("bucket"), *whole, "event_type")
    return rows.groupBy("bucket").applyInPandasWithState(step, "user_id long, plays long", "known string", "update", GroupStateTimeout.NoTimeout)


def incremental(events: DataFrame, folder: str, checkpoint: str):
    """A daily rollup kept up to date: each batch merges with the version before into a new one."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        if number:
            new = new.unionByName(spark.read.parquet(f"{folder}/v{number - 1}")).groupBy("day", "event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        new.write.mode("overwrite").parquet(f"{folder}/v{number}")  # a batch that is run again writes the same version

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

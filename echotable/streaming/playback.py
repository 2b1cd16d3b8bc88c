"""Playback continuity as a stream: stretches played through, kept in order of event time whatever order ticks come in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STEPS = "player long, nth long, start_sec double, end_sec double, ticks long"
#: What waits, and the last stretch of each player with the tick that ends it; `nobody` marks the null player, whose number is 0.
TICK = np.dtype([("nobody", "?"), ("player", "<i8"), ("ms", "<i8"), ("tick", "<i8"), ("position", "<f8"), ("rate", "<f8")])
STRETCH = np.dtype([("nobody", "?"), ("player", "<i8"), ("nth", "<i8"), ("start", "<f8"), ("end", "<f8"), ("ticks", "<i8"), ("position", "<f8"), ("rate", "<f8")])


def goes_on(step: np.ndarray, rate: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Whether ticks follow from those before: a step forward, at the same rate, by no more than playing explains."""
    return (step >= 0) & (step <= 1.5 * np.maximum(1.0, rate)) & (rate == before)


def stretches(last: np.ndarray, ticks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last stretches (one a player) and ticks that come after them -> the stretches that ticks began or went on with, and each player's last."""
    n = last.size
    rows = np.zeros(n + ticks.size, STRETCH)
    rows[:n] = last
    for name in ("nobody", "player", "position", "rate"):
        rows[name][n:] = ticks[name]
    rows["start"][n:] = rows["end"][n:] = ticks["position"]
    rows["ticks"][n:] = 1
    when = np.concatenate([np.full(n, np.iinfo("i8").min), ticks["ms"]])  # a last stretch comes before the ticks of its player
    nth = np.concatenate([np.zeros(n, "i8"), ticks["tick"]])
    order = np.lexsort((rows["rate"], rows["position"], nth, when, rows["player"], rows["nobody"]))
    rows = rows[order]
    other = np.append(True, (rows["player"][1:] != rows["player"][:-1]) | (rows["nobody"][1:] != rows["nobody"][:-1]))
    on = ~other
    on[1:] &= goes_on(np.diff(rows["position"]), rows["rate"][1:], rows["rate"][:-1])
    begin = np.flatnonzero(~on)
    end = np.append(begin[1:], rows.size) - 1
    out = rows[end]
    out["start"], out["end"], out["ticks"] = (f.reduceat(rows[c], begin) for f, c in ((np.minimum, "start"), (np.maximum, "end"), (np.add, "ticks")))
    first = np.flatnonzero(other[begin])  # of each player
    of = np.cumsum(other[begin]) - 1
    out["nth"] = rows["nth"][begin[first]][of] + np.arange(begin.size) - first[of]
    return out[order[end] >= n], out[np.append(first[1:], begin.size) - 1]


def playback_steps(ticks: DataFrame, late: str = "10 seconds", buckets: int = 1024) -> DataFrame:
    """A stream of ticks (player, at timestamp, tick, position, rate) -> STEPS, in update mode: what a batch says last of (player, nth) holds.

    Ticks wait in the state until the watermark has passed them and are then taken in order of (at, tick), so that order of arrival doesn't matter. A tick behind
    the watermark or without a time is dropped. A timer wakes players whose waiting ticks the watermark passes although nothing new comes. What waits for a
    player is bounded by what it can send in the time of `late`.

    Players share a state by a hash, as a state and a call of pandas for each of them would take far longer than their ticks. A checkpoint holds for one number of `buckets`.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.get if state.exists else (b"", b"")
        waiting, last = [np.frombuffer(kept[0], TICK)], np.frombuffer(kept[1], STRETCH)
        passed = state.getCurrentWatermarkMs()
        for part in parts:
            waiting.append(np.zeros(len(part), TICK))
            for name in TICK.names:
                waiting[-1][name] = part[name]
        waiting = np.concatenate(waiting)
        ready = waiting["ms"] <= passed
        changed, last = stretches(last, waiting[ready]) if ready.any() else (last[:0], last)
        waiting = waiting[~ready]
        state.update((waiting.tobytes(), last.tobytes()))
        if waiting.size:
            state.setTimeoutTimestamp(max(int(waiting["ms"].min()), passed + 1))
        player = pd.arrays.IntegerArray(changed["player"].copy(), changed["nobody"].copy())
        yield pd.DataFrame({"player": player, "nth": changed["nth"], "start_sec": changed["start"], "end_sec": changed["end"], "ticks": changed["ticks"]})

    # numbers without nulls, which pandas would make floats, and times that don't depend on the session's time zone
    whole = [F.isnull("player").alias("nobody"), F.coalesce("player", F.lit(0)).cast("long").alias("player"), F.unix_millis("at").alias("ms"), F.coalesce("tick", F.lit(2**63 - 1)).alias("tick")]
    rows = ticks.withWatermark("at", late).where("at IS NOT NULL").select(F.pmod(F.xxhash64("player"), F.lit(buckets)).alias("bucket"), "at", *whole, "position", "rate")
    return rows.groupBy("bucket").applyInPandasWithState(step, STEPS, "waiting binary, last binary", "update", GroupStateTimeout.EventTimeTimeout)

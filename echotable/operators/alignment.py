"""Words of two models of a recording: which match in time, and how long and how often they overlap."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .repeats import overlap_pairs


def _side(words: DataFrame, keys: list[str], model: str, x: str) -> DataFrame:
    """The words of a model, numbered from 0 by start, end and word; a word without times isn't there."""
    w = words.where((F.col("model_key") == model) & F.col("word_start").isNotNull() & F.col("word_end").isNotNull())
    order = Window.partitionBy(*keys).orderBy("word_start", "word_end", "word")
    return w.select(*keys, (F.row_number().over(order) - 1).cast("long").alias(f"{x}_nth"), F.col("word_start").alias(f"{x}_start"), F.col("word_end").alias(f"{x}_end"), tx.word(F.col("word")).alias(f"{x}_word"))


def _in_order(words: DataFrame, keys: list[str], a: str, b: str, tolerance: float) -> DataFrame:
    """Words of both models, those of a recording together and in order: keys, of_b, word_start, word_end, plain, at, nth (from 1), b_early (words of b so far).

    A word of a stands right before the first word of b that doesn't start too early for it, so what it may take lies beside it: one sort brings words together, no join.
    Words that already lie together by keys are not shuffled.
    """
    of_b = F.col("model_key") == b
    w = words.where(F.col("model_key").isin(a, b) & F.col("word_start").isNotNull() & F.col("word_end").isNotNull())
    w = w.select(*keys, of_b.alias("of_b"), "word_start", "word_end", "word", tx.word(F.col("word")).alias("plain"), F.when(of_b, F.col("word_start")).otherwise(F.col("word_start") - tolerance).alias("at"))
    order = ["at", "of_b", "word_start", "word_end", "word"]
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = w.withColumns({"nth": F.count("*").over(so_far), "b_early": F.count(F.when(F.col("of_b"), 1)).over(so_far)})
    return w.sortWithinPartitions(*keys, *order).drop("word")  # the window has sorted them so


def _step(likes: int, moved: int, state: int) -> tuple[int, int]:
    """Which of its three words of b a word of a takes (0 to 2; 3: none), and the state after it.

    state has a bit for each of the three that is taken; moved is how much further on they are than those of the word before, 3 at most. Bits of likes: which of the three are near enough,
    then whether the first is no worse than the second, the first no worse than the third, the second no worse than the third.
    """
    state >>= moved
    best = 3
    for k in range(3):
        if likes >> k & 1 and not state >> k & 1 and (best == 3 or not likes & {(0, 1): 8, (0, 2): 16, (1, 2): 32}[best, k]):
            best = k
    return best, state | (1 << best) & 7


#: What _step gives, as one number, at the number that its arguments make.
_STEPS = [taken << 3 | state for likes in range(64) for moved in range(4) for taken, state in [_step(likes, moved, s) for s in range(8)]]


def _settled(batches: Iterator[pa.RecordBatch], tolerance: float) -> Iterator[tuple]:
    """Tables of rows of _in_order, each with: how many of its rows another table had already; the number of each row's recording; the words of a that it settles; for each the three words of b (places in
    the table), their scores (inf: not near), and which of them it takes (3: none).

    Words are taken in order, so a recording is read by one task, but as a stream: what stays of the rows read are those that words to come can still meet.
    """
    held, held_rec, new, last_rec, state, last = None, np.empty(0, int), [], 0, 0, (-1, 0)
    for batch in chain(batches, [None]):
        new += [] if batch is None else [batch]
        rows = sum(map(len, new))
        if rows + len(held_rec) == 0 or batch is not None and rows < max(1, len(held_rec)):
            continue
        t = pa.concat_tables([*([held] if held else []), pa.Table.from_batches(new, held.schema if held else None)]).combine_chunks()
        new, fresh = [], len(held_rec)
        of_b, start, end, at, nth, b_early = (t[c].to_numpy() for c in ("of_b", "word_start", "word_end", "at", "nth", "b_early"))
        rec = np.concatenate([held_rec, last_rec + np.cumsum(nth[fresh:] == 1)])
        early, mine = np.cumsum(of_b), np.flatnonzero(~of_b)
        places = np.concatenate([[-1], np.flatnonzero(of_b), [-1, -1]])
        around = places[early[mine][:, None] + [0, 1, 2]]
        with np.errstate(invalid="ignore"):
            apart, apart_end = np.abs(start[mine][:, None] - start[around]), np.abs(end[mine][:, None] - end[around])
            near = (around >= 0) & (rec[around] == rec[mine][:, None]) & (apart <= tolerance) & (apart_end <= tolerance)
            score = np.where(near, apart + apart_end, np.inf)
            whole = (around[:, 2] >= 0) | (rec[mine] < rec[-1]) | (at[-1] - start[mine] > tolerance)
        n = len(mine) if batch is None or whole.all() else int(np.argmin(whole))
        to = mine[n] if n < len(mine) else len(t)
        mine, around, score, near = mine[:n], around[:n], score[:n], near[:n]
        x, y, z = score.T
        likes = near @ [1, 2, 4] + (x <= y) * 8 + (x <= z) * 16 + (y <= z) * 32
        known = np.concatenate([[last], np.stack([rec[mine], b_early[mine]], 1)])
        moved = np.where(np.diff(known[:, 0]) > 0, 3, np.minimum(np.diff(known[:, 1]), 3))
        last, taken = tuple(known[-1]), []
        for step in (likes * 32 + moved * 8).tolist():
            now = _STEPS[step | state]
            state = now & 7
            taken.append(now >> 3)
        yield t, fresh, rec, mine, around, score, np.array(taken, int)
        # the last word of b before those not settled stays with them
        before = places[early[to - 1]] if to else -1
        keep = np.concatenate([[before] if before >= 0 and rec[before] == rec[min(to, len(t) - 1)] else [], np.arange(to, len(t))]).astype(int)
        held, held_rec, last_rec = t.take(keep), rec[keep], rec[-1]


def _pairs(words: DataFrame, keys: list[str], a: str, b: str, tolerance: float, every: bool) -> DataFrame:
    """keys, a_nth, b_nth, score, same: candidates, or those taken."""
    rows = _in_order(words, keys, a, b, tolerance)
    kind = T.StructType([*[rows.schema[k] for k in keys], *[T.StructField(c, t) for c, t in (("a_nth", T.LongType()), ("b_nth", T.LongType()), ("score", T.DoubleType()), ("same", T.BooleanType()))]])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _, _, mine, around, score, taken in _settled(batches, tolerance):
            i, k = np.nonzero(np.isfinite(score) if every else taken[:, None] == [0, 1, 2])
            x, y = t.take(mine[i]), t.take(around[i, k])
            out = [*[x[c] for c in keys], pc.subtract(pc.subtract(x["nth"], x["b_early"]), 1), pc.subtract(y["b_early"], 1), pa.array(score[i, k]), pc.equal(x["plain"], y["plain"])]
            yield from pa.table(out, kind.names).combine_chunks().to_batches()

    return rows.mapInArrow(read, kind)


def candidates(words: DataFrame, keys: list[str], a: str, b: str, tolerance: float) -> DataFrame:
    """keys, a_nth, b_nth, score, same: for each word of a, of three words of b those whose start and end are at most the tolerance away.

    The three lie around the first word of b that doesn't start too early. score is the sum of both differences; same, whether the words are alike.
    """
    return _pairs(words, keys, a, b, tolerance, True)


def matched(words: DataFrame, keys: list[str], a: str, b: str, tolerance: float = 0.1) -> DataFrame:
    """keys, a_nth, b_nth, score, same: one-to-one pairs, the words of a in order taking the free candidate of the least score, of equal ones the earlier."""
    return _pairs(words, keys, a, b, tolerance, False)


def word_matches(words: DataFrame, a: str, b: str, tolerance: float = 0.1, keys: tuple[str, ...] = ("audio_hash",)) -> DataFrame:
    """keys, left, right (words of a and b), matched, text_matched: a row for each recording with words of either."""
    rows, counts = _in_order(words, list(keys), a, b, tolerance), ("left", "right", "matched", "text_matched")
    kind = T.StructType([*[rows.schema[k] for k in keys], *[T.StructField(c, T.LongType()) for c in counts]])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, fresh, rec, mine, around, _, taken in _settled(batches, tolerance):
            of_b, got = t["of_b"].to_numpy()[fresh:], taken < 3
            x, y = mine[got], around[got, taken[got]]
            same = pc.fill_null(pc.equal(t["plain"].take(x), t["plain"].take(y)), False).to_numpy()
            found, heads = np.unique(rec, return_index=True)
            out = [np.bincount(r - found[0], minlength=len(found)) for r in (rec[fresh:][~of_b], rec[fresh:][of_b], rec[x], rec[x[same]])]
            yield from pa.table([*[t[k].take(heads) for k in keys], *map(pa.array, out)], kind.names).combine_chunks().to_batches()

    return rows.mapInArrow(read, kind).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])


def word_overlaps(words: DataFrame, a: str, b: str, keys: tuple[str, ...] = ("audio_hash",), width: float = 10.0) -> DataFrame:
    """Per recording: seconds that words of two models share, and how many words of each meet none or several of the other's."""
    keys = list(keys)
    left, right = _side(words, keys, a, "a"), _side(words, keys, b, "b")
    pairs = overlap_pairs(left, right, keys, width, ("a_start", "a_end"), ("b_start", "b_end"))
    shared = pairs.groupBy(*keys).agg(F.sum(F.least("a_end", "b_end") - F.greatest("a_start", "b_start")).alias("shared_sec"))
    out = words.where(F.col("model_key").isin(a, b)).select(*keys).distinct().hint("merge").join(shared, keys, "left")
    for side, x, name in ((left, "a", "left"), (right, "b", "right")):
        met = pairs.groupBy(*keys, f"{x}_nth").agg(F.count("*").alias("met"))
        counts = side.select(*keys, f"{x}_nth").hint("merge").join(met, [*keys, f"{x}_nth"], "left").groupBy(*keys).agg(F.count(F.when(F.col("met").isNull(), 1)).alias(f"{name}_none"), F.count(F.when(F.col("met") > 1, 1)).alias(f"{name}_several"))
        out = out.hint("merge").join(counts, keys, "left")
    return out.fillna(0)


def word_speakers(words: DataFrame, turns: DataFrame, keys: list[str], epsilon: float = 1e-6, width: float = 30.0) -> DataFrame:
    """words (keys, word_start, word_end, ...) with the speaker of the turn (keys, start_sec, end_sec, speaker) that holds them: the first by start, end and name, null where none does.

    Either bound may be missed by epsilon. Turns lie in the bins that they touch, a word in the bin of its start.
    """
    w = words.withColumn("__id", F.monotonically_increasing_id()).withColumn("__bin", F.floor(F.col("word_start") / width))
    bins = F.sequence(F.floor((F.col("start_sec") - epsilon) / width), F.floor((F.col("end_sec") + epsilon) / width))
    t = turns.where("end_sec >= start_sec").select(*[F.col(k).alias(f"t_{k}") for k in keys], "start_sec", "end_sec", "speaker", F.explode(bins).alias("t_bin"))
    on = [F.col(k).eqNullSafe(F.col(f"t_{k}")) for k in keys] + [F.col("__bin") == F.col("t_bin"), F.col("start_sec") <= F.col("word_start") + epsilon, F.col("end_sec") >= F.col("word_end") - epsilon]
    found = w.join(t, on).groupBy("__id").agg(F.min_by("speaker", F.struct("start_sec", "end_sec", "speaker")).alias("speaker"))
    return w.join(found, "__id", "left").drop("__id", "__bin")

"""Long segments cut where the voice pauses, by the probabilities of speech of a recording's frames."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Pauses:
    """Runs of frames below the threshold that last long enough, and running sums of the probabilities."""

    def __init__(self, frames: np.ndarray, unit: float, threshold: float, least: float):
        self.n, self.unit, self.block = len(frames), unit, max(1, math.ceil(least / unit)) if unit > 0 else 1
        edge = np.flatnonzero(np.diff(np.r_[False, frames < threshold, False]))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= self.block
        self.starts, self.ends = starts[long], ends[long]
        self.sums, self.last = np.r_[0.0, np.cumsum(frames)], float(frames[-1]) if len(frames) else 0.0

    def cut(self, start: float, limit: float) -> float | None:
        """The end of the last pause between the two, what lies outside of them not counted; None where there is none."""
        low, high = max(0, math.floor(start / self.unit)), min(self.n, math.ceil(limit / self.unit))
        k = int(np.searchsorted(self.starts, high)) - 1
        while k >= 0 and self.ends[k] > low:  # only a run that either bound clips can be too short
            end = min(int(self.ends[k]), high)
            if end - max(int(self.starts[k]), low) >= self.block:
                return end * self.unit if end * self.unit > start else None
            k -= 1
        return None

    def mean(self, start: float, end: float) -> float:
        low = max(0, math.floor(start / self.unit))
        if low >= self.n:
            return self.last
        high = min(max(low + 1, math.ceil(end / self.unit)), self.n)
        return float((self.sums[high] - self.sums[low]) / (high - low))


def pieces(start: float, end: float, pauses: Pauses | None, most: float, digits: int) -> list[tuple[float, float, float]]:
    """(start, end, mean probability) of the pieces of a segment, none longer than `most`: each ends at a pause or, without one, at the limit."""
    out, at, last = [], start, min(end, round(end, digits)) - 1e-6
    while end > start:
        to = end
        if end - at > most + 1e-6:
            limit = min(at + most, end)
            found = pauses.cut(at, limit) if pauses else None
            to = round(limit if found is None else found, digits)
            to = to if to > at else limit
        at, to = round(at, digits), round(to, digits)
        out.append((at, to, round(pauses.mean(at, to), 4) if pauses else 0.0))
        if to >= last:
            break
        at = to
    return out


def split_at_pauses(segments: DataFrame, frames: DataFrame, most: float = 30.0, threshold: float = 0.35, least: float = 0.5, digits: int = 3) -> DataFrame:
    """segments (audio_hash, seg_idx, start_sec, end_sec), frames (audio_hash, unit, probs array) -> audio_hash, seg_idx, piece, start_sec, end_sec, mean_prob.

    Segments without length give nothing. A recording without frames (no row, null, empty or a unit of zero) is cut at the limit, with a mean of 0. A recording's frames are what one task
    holds; of several rows of frames the longest counts. Null probabilities are speech.
    """

    if most <= 10.0**-digits:
        raise ValueError("a piece must be longer than what times are rounded to")

    def cut(key: tuple, s: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        there = [(p, u) for p, u in zip(f["probs"], f["unit"], strict=True) if p is not None and len(p) and u and u > 0]
        probs, unit = max(there, key=lambda x: len(x[0]), default=(None, 0.0))
        pauses = Pauses(np.nan_to_num(np.asarray(probs, float), nan=1.0), unit, threshold, least) if unit else None
        rows = [(key[0], seg, k, *p) for seg, a, b in zip(s["seg_idx"], s["start_sec"], s["end_sec"], strict=True) if a == a and b == b for k, p in enumerate(pieces(a, b, pauses, most, digits))]
        return pd.DataFrame(rows, columns=["audio_hash", "seg_idx", "piece", "start_sec", "end_sec", "mean_prob"])

    return segments.select("audio_hash", "seg_idx", "start_sec", "end_sec").groupBy("audio_hash").cogroup(frames.select("audio_hash", "unit", "probs").groupBy("audio_hash")).applyInPandas(cut, "audio_hash string, seg_idx long, piece long, start_sec double, end_sec double, mean_prob double")

"""Sequential algorithms on one recording: repeats, matching, packing, splitting. Each group is one recording (and model)."""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_word


def repeats(items: list | np.ndarray, size: int) -> list[tuple[int, int]]:
    """(start, times) of blocks of `size` items that follow themselves; the search goes on behind a find. Long lists are best given as numbers.

    A block that repeats is a run of places at which the items equal those `size` further on; a run of r places holds
    r // size repetitions after the first block.
    """
    if len(items) < 2 * size:
        return []
    items = items if isinstance(items, np.ndarray) else pd.factorize(np.array(items, object))[0]
    same, run = (items[:-size] == items[size:]).tobytes(), b"\1" * size
    out, at = [], 0
    while (start := same.find(run, at)) >= 0:
        end = same.find(b"\0", start + size)
        times = ((end if end >= 0 else len(same)) - start) // size + 1
        out.append((start, times))
        at = start + times * size
    return out


CELL = 64


def distinct_findings(found: list[tuple[int, int, int]], share: float = 0.8) -> list[tuple[int, int, int]]:
    """Of findings (start, size, times) the weightier ones; one that shares so much of the shorter span with a kept one is left out."""
    kept: list[tuple[int, int, int]] = []
    near: dict[int, list[tuple[int, int]]] = {}  # spans kept, by the cells that they touch
    for start, size, times in sorted(found, key=lambda f: (-f[1] * f[2], -f[2], -f[1], f[0])):
        end = start + size * times
        cells = range(start // CELL, (end - 1) // CELL + 1)
        if all(min(end, e) - max(start, s) < share * min(end - start, e - s) for c in cells for s, e in near.get(c, ())):
            kept.append((start, size, times))
            for c in cells:
                near.setdefault(c, []).append((start, end))
    return kept


ROWS = 4096  # findings that a task holds before it gives them on
FOUND = "doc_id long, unit string, start long, size long, times long, impact long, chars long, char_start long, char_end long, snippet string"
SHOWN = 80


def parts_of(text: str, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units as numbers that are equal where the units are, -1 for one of marks alone, their starts, their ends): characters, words without case and edge marks, or lines that aren't blank without case and edge blanks."""
    if unit == "char":
        n = np.arange(len(text) + 1)
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32), n[:-1], n[1:]
    found = np.array([m.span() for m in re.finditer(r"\S+" if unit == "word" else r"[^\n]*\S[^\n]*", text)], int).reshape(-1, 2)
    plain, codes = known_word if unit == "word" else (lambda x: x.strip().lower()), {"": -1}
    items = np.array([codes.setdefault(plain(text[a:b]), len(codes)) for a, b in found.tolist()], np.int32)
    return items, found[:, 0], found[:, 1]


known_word = functools.lru_cache(1 << 16)(plain_word)


def word_numbers(text: str) -> np.ndarray:
    """Words as numbers that are equal where the words are but for case and edge marks; -1 for one of marks alone."""
    codes = {"": -1}
    return np.array([codes.setdefault(known_word(w), len(codes)) for w in text.split()], np.int32)


def repetitions(texts: DataFrame, units: dict[str, tuple[int, int]] | None = None, key: str = "doc_id") -> DataFrame:
    """Repeated blocks of characters, words and lines of each (key, text), after suppression; impact is times * characters, weighted 1, 2, 3.

    chars are the characters of all repetitions, char_start and char_end their place, snippet what stands there. A block with a word of marks alone doesn't count.
    """
    units = units or {"char": (2, 32), "word": (1, 8), "line": (1, 16)}
    weight = {"char": 1, "word": 2, "line": 3}

    def kernel(parts):
        table = lambda rows: pd.DataFrame(rows, columns=[key, *(x.split()[0] for x in FOUND.split(", ")[1:])])
        rows = []
        for p in parts:
            for doc_id, text in zip(p[key], p["text"], strict=True):
                text = text or ""
                for unit, (lo, hi) in units.items():
                    items, starts, stops = parts_of(text, unit)
                    marks = np.r_[0, np.cumsum(items < 0)]
                    found = [(s, size, times) for size in range(lo, hi + 1) for s, times in repeats(items, size) if marks[s + size] == marks[s]]
                    ends = np.r_[0, np.cumsum(stops - starts)]
                    for s, z, t in distinct_findings(found):
                        chars, a, b = int(ends[s + z] - ends[s]), int(starts[s]), int(stops[s + z * t - 1])
                        shown = " ".join(text[a : a + 2 * SHOWN].split()) if b - a > 2 * SHOWN else " ".join(text[a:b].split())
                        rows.append((doc_id, unit, s, z, t, weight[unit] * t * max(1, chars), t * chars, a, b, shown if len(shown) <= SHOWN else shown[:SHOWN].rstrip() + "…"))
                if len(rows) >= ROWS:  # many small tables instead of one of a whole batch of texts
                    yield table(rows)
                    rows = []
        yield table(rows)

    return texts.select(key, "text").mapInPandas(kernel, f"{key} {texts.schema[key].dataType.simpleString()}, " + FOUND.partition(", ")[2])


def scores(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Findings -> key, score (sum of impacts), findings, covered (characters in repeats)."""
    return found.groupBy(key).agg(F.sum("impact").alias("score"), F.count("*").alias("findings"), F.sum("chars").alias("covered"))


def model_totals(scored: DataFrame, model: str) -> DataFrame:
    """scored (model, score, findings, covered, chars) of texts -> per model: texts, score, findings, ratio (characters in repeats to all), and how many texts there are of each severity."""
    level = F.coalesce(severity(F.coalesce("score", F.lit(0)), F.coalesce("covered", F.lit(0)) / F.nullif("chars", F.lit(0))), F.lit("none"))
    counts = [F.count(F.when(F.col("__level") == name, 1)).alias(name) for name in ("none", "low", "medium", "high")]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return scored.withColumn("__level", level).groupBy(model).agg(F.count("*").alias("texts"), total("score").alias("score"), total("findings").alias("findings"), (total("covered") / F.nullif(total("chars"), F.lit(0))).alias("ratio"), *counts)


def severity(score: Column, coverage: Column) -> Column:
    """None, low, medium or high: by the share of the text in repeats first, then by score; by score alone where the share isn't known."""
    # fixed values: shares, and the scores that part the level from the one above
    out = F.when(score == 0, "none").when(coverage.isNull(), F.when(score >= 3000, "high").when(score >= 1000, "medium").otherwise("low")).when(coverage >= 0.08, "high")
    for share, more, least, less in ((0.03, "high", 2000, "medium"), (0.015, "medium", 500, "low"), (0.005, "medium", 1500, "low")):
        out = out.when(coverage >= share, F.when(score >= least, more).otherwise(less))
    return out.otherwise(F.when(score >= 3500, "medium").otherwise("low"))


def pack_regions(regions: list[tuple[float, float]], most: float = 30.0) -> list[list[tuple[float, float]]]:
    """Consecutive regions in bins of at most so many seconds of speech. No regions make one empty bin, and a first region beyond the limit leaves one before it.

    A bin ends where the running sum of its regions passes the limit; a region beyond the limit is a bin by itself.
    """
    seconds = np.array([e - s for s, e in regions])
    out, at = [], 0
    if not len(seconds) or seconds[0] > most:
        out.append([])
    while at < len(seconds):
        over = np.flatnonzero(np.cumsum(seconds[at:]) > most)
        end = at + max(1, int(over[0])) if len(over) else len(seconds)
        out.append(regions[at:end])
        at = end
    return out


def split_at_gaps(spans: list[tuple[float, float]], gap: float = 1.0, most: float = 30.0, least: float = 2.0) -> list[tuple[int, int]]:
    """Runs [i, j) of spans: cut at long gaps, runs beyond `most` seconds at their widest inner gap, and short runs joined to a neighbour."""
    runs, i = [], 0
    for j in range(1, len(spans) + 1):
        if j == len(spans) or spans[j][0] - spans[j - 1][1] >= gap:
            runs.append((i, j))
            i = j

    def halve(i: int, j: int) -> list[tuple[int, int]]:
        if j - i < 2 or spans[j - 1][1] - spans[i][0] <= most:
            return [(i, j)]
        middle = (spans[i][0] + spans[j - 1][1]) / 2
        cut = max(range(i + 1, j), key=lambda k: (spans[k][0] - spans[k - 1][1], -abs(spans[k][0] - middle)))
        return halve(i, cut) + halve(cut, j)

    out: list[tuple[int, int]] = []
    for i, j in (r for run in runs for r in halve(*run)):
        length = lambda a, b: spans[b - 1][1] - spans[a][0]
        near = out and spans[i][0] - spans[out[-1][1] - 1][1] < gap
        if near and min(length(i, j), length(*out[-1])) < least and length(out[-1][0], j) <= most:
            out[-1] = (out[-1][0], j)
        else:
            out.append((i, j))
    return out


def sentence_stats(words: list[tuple[float, float, str]]) -> tuple[int, int]:
    """(sentences, words): a sentence ends at . ! ? or before more than a second of silence."""
    sentences = 0
    for k, (_, end, w) in enumerate(words):
        last = k + 1 == len(words)
        if w.rstrip("\"')").endswith((".", "!", "?")) or last or words[k + 1][0] - end > 1.0:
            sentences += 1
    return sentences, len(words)


def spans_of_segments(segments: DataFrame) -> DataFrame:
    """Review spans of each recording by split_at_gaps: (audio_hash, ordinal, start_sec, end_sec, segments)."""

    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        p = p[p["end_sec"] > p["start_sec"]].sort_values(["start_sec", "end_sec"])
        spans = list(zip(p["start_sec"], p["end_sec"], strict=True))
        rows = [(p["audio_hash"].iloc[0], k, spans[i][0], max(e for _, e in spans[i:j]), j - i) for k, (i, j) in enumerate(split_at_gaps(spans))]
        return pd.DataFrame(rows, columns=["audio_hash", "ordinal", "start_sec", "end_sec", "segments"])

    return segments.groupBy("audio_hash").applyInPandas(kernel, "audio_hash string, ordinal long, start_sec double, end_sec double, segments long")


def packed_regions(segments: DataFrame, most: float = 30.0) -> DataFrame:
    def kernel(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p[p["end_sec"] > p["start_sec"]].sort_values(["start_sec", "end_sec"])
        bins = pack_regions(list(zip(p["start_sec"], p["end_sec"], strict=True)), most)
        rows = [(key[0], k, b[0][0] if b else None, max((e for _, e in b), default=None), len(b), sum((e - s for s, e in b), 0.0)) for k, b in enumerate(bins)]
        return pd.DataFrame(rows, columns=["audio_hash", "bin", "start_sec", "end_sec", "regions", "speech_sec"])

    return segments.groupBy("audio_hash").applyInPandas(kernel, "audio_hash string, bin long, start_sec double, end_sec double, regions long, speech_sec double")


def segments_of_words(words: DataFrame, gap: float, most: float) -> DataFrame:
    """Words of each (audio_hash, model_key) -> segments: cut where the gap is longer or the segment would last longer.

    Where a segment ends depends on where it began, so a recording is one group.
    """
    least = max(1.0, most)

    def kernel(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["word_start", "word_end", "seg_idx", "i"])
        rows, first, last = [], None, None
        for s, e, w in zip(p["word_start"], p["word_end"], p["word"], strict=True):
            if first is None or max(0.0, s - last) > max(0.0, gap) or max(0.0, e - first) > least:
                rows.append([*key, len(rows), s, e, []])
                first = s
            rows[-1][4], last = e, e
            rows[-1][5].append(w)
        return pd.DataFrame([(*r[:3], round(r[3], 6), round(r[4], 6), " ".join(r[5])) for r in rows], columns=["audio_hash", "model_key", "ordinal", "start_sec", "end_sec", "text"])

    return words.groupBy("audio_hash", "model_key").applyInPandas(kernel, "audio_hash string, model_key string, ordinal long, start_sec double, end_sec double, text string")

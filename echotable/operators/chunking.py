"""Token-bounded chunks of a recording, their ids and their statistics.

Which segments end a chunk depends on where it began, so a recording is read by one task, one recording after the other; recordings are
bounded. Everything around it is expressions.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from itertools import accumulate, groupby
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class TokenCounter(Protocol):
    def __call__(self, text: str) -> int: ...


_TOKEN = re.compile(r"\w+|[^\w\s]")


def count_tokens(text: str) -> int:
    """Words and marks; at least one."""
    return max(1, len(_TOKEN.findall(text)))


count_tokens.additive = True


class Vocabulary:
    """Counts the tokens of a tokenizer file, which each task reads once; at least one.

    additive: tokens don't reach over a blank, so that those of texts joined by blanks are those of the first and of each other one with a blank before it.
    """

    def __init__(self, path: str, additive: bool = True):
        self.path, self.additive, self._read = path, additive, None

    def __call__(self, text: str) -> int:
        if self._read is None:
            from tokenizers import Tokenizer

            self._read = Tokenizer.from_file(self.path)
        return max(1, len(self._read.encode(text, add_special_tokens=False).ids))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_read": None}


KNOWN = 1 << 16  # words whose counts a task remembers
_ODD = re.compile(r"\s\s|^\s|\s\Z")


class ByWords:
    """Counts as an additive counter does, by the words between blanks: the first as it is, each other one with its blank. A task remembers words.

    A text that begins or ends with white space or has two of it side by side is counted whole.
    """

    additive = True

    def __init__(self, count: TokenCounter):
        self.count, self.known = count, functools.lru_cache(KNOWN)(count)

    def __call__(self, text: str) -> int:
        if not text or _ODD.search(text):
            return self.count(text)
        first, *rest = text.split(" ")
        return self.known(first) + sum([self.known(" " + w) for w in rest])

    def spaced(self, text: str) -> int:
        """Tokens of the text with a blank before it."""
        if not text or _ODD.search(text):
            return self.count(" " + text)
        return sum([self.known(" " + w) for w in text.split(" ")])


def joined_counts(texts: list[str], count: TokenCounter) -> Callable[[int, int], int]:
    """(i, j) -> tokens of texts i to j - 1 joined by blanks: by running sums where the counter allows it, else counted anew."""
    if not getattr(count, "additive", False) or any(t != t.strip() or not t for t in texts):
        return lambda i, j: count(" ".join(texts[i:j]))
    spaced = getattr(count, "spaced", lambda t: count(" " + t))
    first, rest = [count(t) for t in texts], [0, *accumulate(spaced(t) for t in texts)]
    return lambda i, j: first[i] + rest[j] - rest[i + 1]


def split_text(text: str, most: int, count: TokenCounter = count_tokens) -> list[str]:
    """Parts of at most `most` tokens: at sentence ends, else at commas, else at dashes, else between words."""
    if count(text) <= most:
        return [text]
    for cut in (r"(?<=[.!?…])\s+", r"(?<=[,;:])\s+", r"\s+[-–—]\s+", r"\s+"):
        parts = [p for p in re.split(cut, text) if p.strip()]
        if len(parts) < 2:
            continue
        out: list[str] = []
        for part in (q for p in parts for q in (split_text(p, most, count) if count(p) > most else [p])):
            if out and count(joined := f"{out[-1]} {part}") <= most:
                out[-1] = joined
            else:
                out.append(part)
        return out
    return [text]


def retimed(parts: list[str], start: float, end: float) -> list[tuple[float, float, str]]:
    """Parts of a segment with its time shared out by characters that aren't white space."""
    weights = [max(1, len(re.sub(r"\s", "", p))) for p in parts]
    total, at, out = sum(weights), 0, []
    for w, p in zip(weights, parts, strict=True):
        out.append((start + (end - start) * at / total, start + (end - start) * (at + w) / total, p))
        at += w
    return out


def windows(segments: list[tuple[float, float, str]], least: int, most: int, overlap: int, count: TokenCounter = count_tokens) -> list[tuple[int, int, int]]:
    """(first, end, tokens) of chunks over segments. Tokens are those of the joined text, which aren't the sum of the parts'.

    A chunk grows while it stays within `most`; a single longer segment is a chunk by itself. The next one begins with as many
    of its last segments as fit the overlap, but always moves on. A last chunk under `least` joins the one before if that fits.
    """
    texts = [s[2] for s in segments]
    tokens = joined_counts(texts, count)
    out: list[tuple[int, int, int]] = []
    i, n = 0, len(texts)
    while i < n:
        j = i + 1
        while j < n and tokens(i, j + 1) <= most:
            j += 1
        out.append((i, j, tokens(i, j)))
        if j >= n:
            break
        back = j
        while back - 1 > i and tokens(back - 1, j) <= overlap:
            back -= 1
        while back < j and tokens(back, j + 1) > most:  # the next one has to get further
            back += 1
        i = back
    if len(out) > 1 and out[-1][2] < least and (joined := tokens(out[-2][0], out[-1][1])) <= most:
        out[-2:] = [(out[-2][0], out[-1][1], joined)]
    return out


CHUNK = "audio_hash string, model_key string, chunk_ordinal long, start_sec double, end_sec double, text string, token_count long, overflow boolean"
ROWS = 4096  # chunks that a task holds before it gives them on


def chunks(segments: DataFrame, least: int = 180, most: int = 260, overlap: int = 40, count: Callable[[str], int] = count_tokens) -> DataFrame:
    """Chunks of each (audio_hash, model_key); long segments are split and re-timed before.

    A task reads its recordings one after the other, sorted by Spark, and holds one of them.
    """
    names = [c.split()[0] for c in CHUNK.split(", ")]

    def kernel(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = ByWords(count) if getattr(count, "additive", False) else count

        def made(key: tuple, said: list[tuple]) -> list[tuple]:
            rows = [r for _, _, s, e, t in said for r in retimed(split_text(t, most, counts), s, e)]
            return [(*key, k, rows[i][0], max(r[1] for r in rows[i:j]), " ".join(r[2] for r in rows[i:j]), n, n > most) for k, (i, j, n) in enumerate(windows(rows, least, most, overlap, counts))]

        rows = (r for p in parts for r in zip(*(p[c].tolist() for c in ("audio_hash", "model_key", "start_sec", "end_sec", "text")), strict=True))
        out = []
        for key, said in groupby(rows, key=lambda r: r[:2]):
            out += made(key, list(said))
            if len(out) >= ROWS:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    dealt = segments.select("audio_hash", "model_key", "start_sec", "seg_idx", "end_sec", "text").repartition("audio_hash", "model_key")
    dealt = dealt.sortWithinPartitions("audio_hash", "model_key", F.asc_nulls_last("start_sec"), F.asc_nulls_last("seg_idx"))
    return dealt.drop("seg_idx").mapInPandas(kernel, CHUNK)


def chunk_id(group: Column, backend: Column, version: str) -> Column:
    ms = lambda c: F.bround(F.col(c) * 1000).cast("long").cast("string")
    return F.sha2(F.concat_ws("|", group, backend, F.col("audio_hash"), ms("start_sec"), ms("end_sec"), F.lit(version)), 256)


def token_audit(df: DataFrame, keys: list[str], tokens: str, least: int, most: int) -> DataFrame:
    """Distribution of token counts, those below, within and above the bounds, and the overflow share."""
    n = F.col(tokens)
    return df.groupBy(*keys).agg(F.count("*").alias("chunks"), F.avg(n).alias("mean"), F.median(n).alias("median"), F.percentile(n, 0.95).alias("p95"), F.min(n).alias("least"), F.max(n).alias("most"), F.count(F.when(n < least, 1)).alias("below"), F.count(F.when(n.between(least, most), 1)).alias("within"), F.count(F.when(n > most, 1)).alias("above"), (F.count(F.when(n > most, 1)) / F.count("*")).alias("overflow"))


def recommended(candidates: DataFrame) -> DataFrame:
    """The configuration with least latency among those whose recall is within 0.02 of the best, first of all within the overflow ceiling."""
    fits = F.col("overflow") <= 0.01
    pool = candidates.withColumn("fits", fits).crossJoin(F.broadcast(candidates.agg(F.max(fits).alias("any"))))  # one row
    pool = pool.where(F.col("fits") | ~F.col("any"))
    best = pool.agg(F.max("recall").alias("best"))
    pool = pool.crossJoin(F.broadcast(best)).where("recall >= best - 0.02")
    return pool.orderBy("p95", "build_sec", "chunks", "config").limit(1).drop("fits", "any", "best")

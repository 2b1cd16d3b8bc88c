"""Best-fit decreasing packing of tokenized documents.

Lengths lie between 1 and the sequence length, so all that best-fit decreasing needs of the corpus is how many
pieces have each length: a histogram of at most 1024 rows, whatever the corpus holds. The driver packs that
histogram. A segment tree over remaining capacities finds the tightest open bin in logarithmic time, and equal
pieces go into equal bins together, so its work is bounded by the sequence length and not by the data. The
outcome is a plan of runs: the pieces of length L with ranks a..b go, k to a bin, into bins c.. at offset o. It
is exactly the packing that best-fit decreasing over all single pieces would make. Executors rank the pieces
within their length and look the plan up.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import documents_of, stored

END = 2
CACHE = 300_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Unicode white space but the space; next to a space it makes a run that is not cut at the space.
_OTHER = re.compile("[\\t-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


class Encoder(dict):
    """Token ids of a text as little-endian unsigned 32-bit bytes; a dictionary of the words met so far.

    The vocabulary's cut never joins a character to a following space, so " word" can be encoded by itself wherever words
    are parted by one space. Texts with other white space are cut at their lines where they can, or encoded
    whole. The vocabulary is read as ranks, which gives the ids of the tokenizer file of the same name several
    times as fast. Texts are cut at the strings in `added`, which have ids of their own; without any all is ordinary text.
    """

    def __init__(self, ranks: str, pattern: str, added: dict[str, int] | None = None):
        super().__init__()
        self.added = {t: array("I", [i]).tobytes() for t, i in (added or {}).items()}
        self.cut = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})") if self.added else None
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def whole(self, text: str) -> bytes:
        return array("I", self.coder.encode_ordinary(text)).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        out = self[word] = self.whole(word)
        return out

    def encode(self, text: str) -> bytes:
        if self.cut and self.cut.search(text):
            return b"".join(self.added[t] if k % 2 else self.part(t) for k, t in enumerate(self.cut.split(text)))
        return self.part(text)

    def part(self, text: str) -> bytes:
        if not text:
            return b""
        out = []
        for i, line in enumerate(text.split("\n")):
            if not line or line[0] == " " or line[-1] == " " or "  " in line or _OTHER.search(line):
                return self.whole(text)  # runs of white space may go beyond the line
            if i:
                out.append(self["\n"])
            first, *rest = line.split(" ")
            out.append(self[first])
            out += [self[" " + w] for w in rest]
        return b"".join(out)


def added_tokens(tokenizer: str) -> dict[str, int]:
    """The tokens that a tokenizer file adds to its vocabulary. Only plain ones: found wherever they stand, nothing stripped."""
    with open(tokenizer, encoding="utf-8") as file:
        found = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in found):
        raise ValueError(f"{tokenizer} has added tokens of other kinds")
    return {t["content"]: t["id"] for t in found}


def pieces_of(docs: DataFrame, ranks: str, pattern: str, size: int = 1024, added: dict[str, int] | None = None) -> DataFrame:
    """The pieces of each document: the first one takes the remainder, all others are full."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks, pattern, added)
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), ([], [], [], [], [])
            for doc_id, text in zip(ids, batch.column(1), strict=True):
                data = encoder.encode(text.as_py() or "") + END.to_bytes(4, "little")
                n = len(data) // 4
                count = -(-n // size)
                at = 0
                for k in range(count):
                    to = n - size * (count - 1 - k)
                    for column, value in zip(rows, (doc_id, k, at, to - at, zlib.crc32(data[4 * at : 4 * to])), strict=True):
                        column.append(value)
                    at = to
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(cut, PIECES)


class Tree:
    """A segment tree over capacities 0..size: leaves count open bins, inner nodes their sums."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.sums = [0] * (2 * self.width)

    def add(self, at: int, n: int) -> None:
        at += self.width
        while at:
            self.sums[at] += n
            at //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least `least` that has an open bin."""
        at = least + self.width
        if self.sums[at]:
            return least
        while at > 1:  # up to the first right sibling with bins, then down to its leftmost leaf
            if not at & 1 and self.sums[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.sums[2 * at] else 2 * at + 1
                return at - self.width
            at //= 2
        return None


def plan(histogram: dict[int, int], size: int = 1024) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces to a bin, first bin, offset) of best-fit decreasing, in order of length and rank."""
    tree, open_bins, bins, runs = Tree(size), [deque() for _ in range(size + 1)], 0, []

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            open_bins[capacity].append((first, n))
            tree.add(capacity, n)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:  # open as many bins as these pieces fill
                capacity, first, n = size, bins, -(-left // (size // length))
                bins += n
            else:
                first, n = open_bins[capacity].popleft()
                tree.add(capacity, -n)
            # the bin just used is the tightest until it's too full, so it takes k pieces in a row
            k = capacity // length
            full = min(n, left // k)
            if full:
                runs.append((length, rank, k, first, size - capacity))
                put(capacity - k * length, first, full)
                rank, left, first, n = rank + full * k, left - full * k, first + full, n - full
            if n and 0 < left < k:
                runs.append((length, rank, left, first, size - capacity))
                put(capacity - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(capacity, first, n)
    return runs


def pack(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, rows_per_cell: int = 500_000, added: dict[str, int] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece.

    `added`: strings that are tokens of their own, with their ids.
    A null or empty text is the end token alone. Repeated rows and null ids are packed like any others; an empty
    table gives no rows. Full pieces are sequences by themselves and take negative ids.
    """
    pieces = stored(pieces_of(documents_of(docs, id_col, text_col), ranks, pattern, size, added).withColumn("nth", F.monotonically_increasing_id()))
    full = pieces.where(F.col("length") == size).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))

    short = pieces.where(F.col("length") < size)
    cells = max(64, -(-short.count() // rows_per_cell))
    short = short.withColumn("cell", F.pmod(F.xxhash64("nth"), F.lit(cells)))
    counts = short.groupBy("length", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(counts.select(F.col("length").alias("b_length"), F.col("cell").alias("b_cell"), "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    histogram = {r[0]: r[1] for r in bases.groupBy("b_length").agg(F.sum("n")).collect()}  # one row a length
    runs = np.array(plan(histogram, size), np.int64).reshape(-1, 5)
    # one sorted key for length and rank: lengths fall from run to run, so their complement rises
    lengths, ranks, each, bins, offsets = runs.T
    keys = ((size - lengths) << 48) + ranks

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(), rank.to_numpy()
        at = np.searchsorted(keys, ((size - length) << 48) + rank, "right") - 1
        nth = rank - ranks[at]
        return pd.DataFrame({"sequence_id": bins[at] + nth // each[at], "offset": offsets[at] + nth % each[at] * length})

    within = Window.partitionBy("length", "cell").orderBy("nth")
    ranked = short.withColumn("rank", F.row_number().over(within).cast("long") - 1)
    ranked = ranked.join(bases, (F.col("length") == F.col("b_length")) & (F.col("cell") == F.col("b_cell")))
    ranked = ranked.withColumn("at", place("length", F.col("base") + F.col("rank")))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*names, "at.sequence_id", "at.offset").unionByName(full.select(*names, "sequence_id", "offset"))

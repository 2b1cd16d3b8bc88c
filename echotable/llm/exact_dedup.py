"""Exact duplicates by counting quotient filters.

A text has a fingerprint of 64 bits. Each partition builds quotient filters of its fingerprints: the upper bits (the
quotient) say where a fingerprint belongs, the lower ones (the remainder) are stored there in order, and one that repeats
has a counter. A filter covers one range of fingerprints, so the filters of a range, from all partitions, merge into one
by their sorted remainders, and nothing is lost: the merged filter holds every fingerprint with its count.

Fingerprints with a count above one go to byte verification: Spark groups the texts themselves. Which texts those are is
said by a bitmap of fixed size, so that texts which occur once don't move; what it lets through in vain is found to be
alone. Copies are put together before they move, so a text that a third of all rows share moves once a partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import documents_of, measured, stored

RANGE = 1 << 18  # fingerprints that a range of the fingerprints holds, about
MOST = 1 << 20  # fingerprints that one filter of a partition takes in
BITS = 27  # of the bitmap's index: 2 ** 21 words of 64 bits, however many texts repeat
FREQUENT = 100_000  # a text of more than a share of 1 / FREQUENT of the rows is joined by a broadcast; there are no more of them than that


class Filter(NamedTuple):
    """A counting quotient filter of fingerprints of `width` bits.

    Slot k holds a remainder. The remainders of one quotient are a run, in order; a run stands at its quotient's slot or,
    where runs before it reach that far, right behind them. `occupied` marks quotients that have a run, `run_end` the last slot of a run,
    `many` the slots whose count is in `counts`, in order of the slots; all others count one.
    """

    width: int
    quotient_bits: int
    remainders: np.ndarray
    occupied: np.ndarray
    run_end: np.ndarray
    many: np.ndarray
    counts: np.ndarray


def build(fingerprints: np.ndarray, counts: np.ndarray, width: int) -> Filter:
    """The filter of distinct, sorted fingerprints (below 2 ** width) and their counts."""
    n = len(fingerprints)
    q = min(width, max(1, int(np.ceil(np.log2(max(n, 1) / 0.75 + 1)))))
    quotients = (fingerprints >> np.uint64(width - q)).astype(np.int64)
    order = np.arange(n)
    slots = np.maximum.accumulate(quotients - order) + order if n else order
    size = max(1 << q, int(slots[-1]) + 1 if n else 0)
    remainders, occupied, run_end, many = np.zeros(size, np.uint64), np.zeros(1 << q, bool), np.zeros(size, bool), np.zeros(size, bool)
    remainders[slots] = fingerprints & np.uint64((1 << (width - q)) - 1)
    occupied[quotients] = True
    run_end[slots[np.flatnonzero(np.diff(quotients, append=-1))]] = True
    many[slots[counts > 1]] = True
    return Filter(width, q, remainders, occupied, run_end, many, counts[counts > 1].astype(np.int64))


def items(f: Filter) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, counts) of a filter, in order."""
    quotients, ends = np.flatnonzero(f.occupied), np.flatnonzero(f.run_end)  # the k-th run is that of the k-th quotient
    if not len(ends):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.maximum(quotients, np.r_[0, ends[:-1] + 1])
    lengths = ends - starts + 1
    slots = np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
    counts = np.ones(len(f.remainders), np.int64)
    counts[f.many] = f.counts
    return (np.repeat(quotients.astype(np.uint64), lengths) << np.uint64(f.width - f.quotient_bits)) | f.remainders[slots], counts[slots]


def merge(filters: list[Filter]) -> Filter:
    """One filter that counts what all of them count; they have one width."""
    found, counts = zip(*map(items, filters), strict=True)
    return build(*summed(np.concatenate(found), np.concatenate(counts)), filters[0].width)


def summed(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints in order, with the sums of their counts."""
    order = np.argsort(fingerprints, kind="stable")  # linear on lists that are put one behind another in order
    fingerprints, counts = fingerprints[order], counts[order]
    first = np.flatnonzero(np.r_[True, fingerprints[1:] != fingerprints[:-1]]) if len(order) else order
    return fingerprints[first], np.add.reduceat(counts, first) if len(order) else counts


def count_of(f: Filter, fingerprint: int) -> int:
    """How often the filter counts a fingerprint, by the run of its quotient alone."""
    quotient, remainder = fingerprint >> (f.width - f.quotient_bits), fingerprint & ((1 << (f.width - f.quotient_bits)) - 1)
    if not f.occupied[quotient]:
        return 0
    nth = int(np.count_nonzero(f.occupied[: quotient + 1])) - 1
    ends = np.flatnonzero(f.run_end)
    start = max(quotient, int(ends[nth - 1]) + 1 if nth else 0)
    at = start + int(np.searchsorted(f.remainders[start : ends[nth] + 1], np.uint64(remainder)))
    if at > ends[nth] or f.remainders[at] != np.uint64(remainder):
        return 0
    return int(f.counts[np.count_nonzero(f.many[:at])]) if f.many[at] else 1


def packed(f: Filter) -> bytes:
    """Remainders take the bytes they need, marks one bit each."""
    used = -(-max(f.width - f.quotient_bits, 1) // 8)
    body = f.remainders.view(np.uint8).reshape(-1, 8)[:, :used]  # little-endian
    return b"".join([np.array([f.width, f.quotient_bits, len(f.remainders)], np.int64).tobytes(), body.tobytes(), *(np.packbits(x).tobytes() for x in (f.occupied, f.run_end, f.many)), f.counts.tobytes()])


def unpacked(data: bytes) -> Filter:
    width, q, size = np.frombuffer(data, np.int64, 3).tolist()
    used, at = -(-max(width - q, 1) // 8), 24
    remainders = np.zeros((size, 8), np.uint8)
    remainders[:, :used] = np.frombuffer(data, np.uint8, size * used, at).reshape(size, used)
    at, marks = at + size * used, []
    for n in (1 << q, size, size):
        marks.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n).astype(bool))
        at += -(-n // 8)
    return Filter(width, q, remainders.reshape(-1).view(np.uint64), *marks, np.frombuffer(data, np.int64, -1, at))


def filters_of(fingerprints: DataFrame, range_bits: int) -> DataFrame:
    """fp -> part, filter: one filter for each range that a partition has fingerprints in; the range is the upper bits."""
    width = 64 - range_bits

    def made(values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values = np.sort(np.concatenate(values))
        if len(values):
            found, counts = summed(values, np.ones(len(values), np.int64))
            part = (found >> np.uint64(width)).astype(np.int64) if range_bits else np.zeros(len(found), np.int64)
            low = found & np.uint64((1 << width) - 1)
            cuts = np.r_[np.flatnonzero(np.diff(part, prepend=-1)), len(part)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                yield pa.RecordBatch.from_arrays([pa.array([int(part[i])]), pa.array([packed(build(low[i:j], counts[i:j], width))], pa.binary())], ["part", "filter"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            n += len(held[-1])
            if n >= MOST:
                yield from made(held)
                held, n = [], 0
        if n:
            yield from made(held)

    return fingerprints.mapInArrow(read, "part long, filter binary")


def repeated(filters: DataFrame, range_bits: int) -> DataFrame:
    """(part, filter) -> fp, n of the fingerprints that the merged filters count more than once."""
    width = 64 - range_bits

    def merged(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        found, counts = items(merge([unpacked(x.as_py()) for x in group.column("filter")]))
        found, counts = found[counts > 1], counts[counts > 1]
        if range_bits:
            found = found | (np.uint64(part) << np.uint64(width))
        return pa.table({"fp": pa.array(found.view(np.int64), pa.int64()), "n": pa.array(counts, pa.int64())})

    return filters.groupBy("part").applyInArrow(merged, "fp long, n long")  # about RANGE fingerprints a group


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", in_range: int = RANGE) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: for each row the row of its text that stays, which has the largest id.

    Texts are equal when all their bytes are. A null text counts as the empty one. Null ids are smaller than all others: a group without
    other ids has a null keep_id. Of rows that repeat id and text exactly one is kept. An empty table gives no rows.
    """
    docs = documents_of(docs, id_col, text_col)
    text = F.coalesce("text", F.lit(""))
    rows, seen = measured(docs.select("doc_id", F.xxhash64(text).alias("fp"), F.sha2(text, 256).alias("sha"), F.monotonically_increasing_id().alias("nth")), n=F.count("*"))
    range_bits = max(0, int(np.ceil(np.log2(max(seen["n"], 1) / in_range))))
    again = stored(repeated(filters_of(rows.select("fp"), range_bits), range_bits))

    # byte verification of the texts whose bit is set
    word, bit = F.expr(f"shiftrightunsigned(fp, {64 - BITS + 6})"), f"cast(shiftrightunsigned(fp, {64 - BITS}) & 63 AS int)"
    bitmap = stored(again.groupBy(word.alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias("bits")))
    hashed = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("fp"))
    passed = hashed.join(F.broadcast(bitmap), word == F.col("word")).where(F.expr(f"shiftright(bits, {bit}) & 1") == 1)
    same = passed.groupBy("fp", "text").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id")).where("group_size > 1")
    groups = stored(same.select(F.col("fp").alias("g_fp"), F.sha2("text", 256).alias("g_sha"), "group_size", "keep_id"))

    # rows learn their group: frequent texts by broadcast, as there can be only so many, the others by a join on the fingerprint
    hot = F.col("group_size") > F.lit(seen["n"] // FREQUENT + 1000)
    on = (F.col("fp") == F.col("g_fp")) & (F.col("sha") == F.col("g_sha"))
    names = ["g_fp", "g_sha", "group_size", "keep_id"]
    by_hot = rows.join(F.broadcast(groups.where(hot)), on, "left")
    first = by_hot.where("g_fp IS NOT NULL").select("doc_id", "nth", *names)
    rest = by_hot.where("g_fp IS NULL").drop(*names).join(groups.where(~hot), on, "left").select("doc_id", "fp", "sha", "nth", *names)
    known = stored(first.select("doc_id", F.col("g_fp").alias("fp"), F.col("g_sha").alias("sha"), "nth", *names).unionByName(rest))
    # which of rows that repeat the id that stays: usually there is but one
    ties = known.where("g_fp IS NOT NULL AND doc_id <=> keep_id").groupBy(F.col("g_fp").alias("t_fp"), F.col("g_sha").alias("t_sha")).agg(F.min("nth").alias("stays"), F.count("*").alias("n")).where("n > 1").drop("n")
    out = known.join(stored(ties), (F.col("fp") == F.col("t_fp")) & (F.col("sha") == F.col("t_sha")), "left")
    single = F.col("g_fp").isNull()
    kept = single | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("stays").isNull() | (F.col("nth") == F.col("stays"))))
    return out.select("doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each text, that of the largest id, all columns as they are; of rows that repeat id and text any one stays.

    A null text is a text like the empty one. An empty table stays empty.
    """
    ours, theirs = ([f"{c}_{uuid.uuid4().hex}" for c in ("id", "sha")] for _ in range(2))  # whatever columns docs has
    found = exact_duplicates(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(theirs[0]), F.col("text_sha256").alias(theirs[1]))
    keyed = docs.withColumns({ours[0]: docs[id_col].cast("long"), ours[1]: F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256)})
    left = keyed.join(found, F.col(ours[0]).eqNullSafe(F.col(theirs[0])) & (F.col(ours[1]) == F.col(theirs[1])), "left_semi")
    return left.dropDuplicates(ours).select(docs.columns)

"""Sharding by sampled splitters, with DataFrame functions only.

Each document gets a key, the hash of its text, so that equal texts lie side by side. A sample drawn in
proportion to size gives quantile boundaries of the keys; they cut the documents into many ranges of about equal
bytes. A range that is overfull, because one text is repeated often or one document is large, is subdivided: each
heavy key gets a range of its own, or several by row number when the key alone exceeds a shard's share. Ranges
are then dealt to shards, largest first, to the shard with the fewest bytes.

What the driver sees is bounded by the parameters: `ranges` splitters and the sizes of the ranges. Rows move once,
as (id, size, key) without their texts, to be numbered inside cells of a range.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import documents_of, stored

FINE = 32


def _longs(values: list[int]) -> str:
    return "array(" + ",".join("(-9223372036854775807L - 1L)" if v == -(1 << 63) else f"{v}L" for v in values) + ")"


def _range_of(key: str, splitters: list[int]) -> F.Column:
    """How many splitters are at most the key, by a coarse and a fine array, both literals."""
    if not splitters:
        return F.lit(0)
    blocks = [splitters[i : i + FINE] for i in range(0, len(splitters), FINE)]
    heads = _longs([b[0] for b in blocks])
    coarse = f"size(filter({heads}, x -> x <= {key}))"
    fine = f"size(filter(array({','.join(map(_longs, blocks))})[greatest({coarse} - 1, 0)], x -> x <= {key}))"
    return F.expr(f"CASE WHEN {coarse} = 0 THEN 0 ELSE ({coarse} - 1) * {FINE} + {fine} END")


def deal(sizes: dict[int, int], shards: int) -> dict[int, int]:
    """Ranges to shards: the largest first, each to the shard with the fewest bytes so far."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for r, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        full, s = heap[0]
        heapq.heapreplace(heap, (full + size, s))
        out[r] = s
    return out


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, ranges: int = 1024, sample: int = 8192, cells: int = 16) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1; null text 1), text_crc32, law, shard, slot (0.. within a shard), grown_shard (null).

    Law `bytes`: the shards' sums of size are as near to equal as the ranges allow, about a thousandth of the whole.
    Equal texts share a shard unless their sum exceeds a shard's share. Repeated rows and null ids are rows like any
    other; a null text has the key of its own null; an empty table gives no rows.
    """
    rows = documents_of(docs, id_col, text_col).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("key"),
        F.monotonically_increasing_id().alias("nth"),  # tells repeated rows apart once it is written
    )
    rows = stored(rows)
    spark = docs.sparkSession
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]

    # a size-weighted sample: a row comes in with probability size * sample / total, decided by a hash of its number
    rate = sample / max(total, 1)
    p = F.least(F.lit(1.0), F.col("size") * F.lit(rate))
    u = F.pmod(F.xxhash64(F.lit("sample"), "nth"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = rows.where(u < p).select("key", (F.col("size") / p).alias("weight"))
    order = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = F.floor(F.sum("weight").over(order) * F.lit(ranges / max(total, 1)))  # the sample is bounded, so one task sorts it
    splitters = [r["key"] for r in drawn.select("key", cut.alias("cut")).groupBy("cut").agg(F.min("key").alias("key")).orderBy("key").collect()]
    splitters = sorted(set(splitters))[1 : ranges + 1]

    # overfull ranges: their heavy keys leave for ranges of their own
    share, heavy_at = total / shards, total / (shards * 16)
    ranged = rows.withColumn("rid", _range_of("key", splitters).cast("int"))
    sums = ranged.groupBy("rid").agg(F.sum("size").alias("size")).collect()
    heavy: dict[int, tuple[int, int]] = {}
    next_rid = len(splitters) + 1
    if over := [r["rid"] for r in sums if r["size"] > heavy_at]:
        of_key = ranged.where(F.col("rid").isin(over)).groupBy("key").agg(F.sum("size").alias("size")).where(F.col("size") > heavy_at)
        for r in of_key.orderBy("key").collect():  # at most 16 * shards of them
            parts = 1 if r["size"] <= share else -int(-r["size"] // heavy_at)
            heavy[r["key"]] = (next_rid, parts)
            next_rid += parts
    if heavy:
        keys = _longs(list(heavy))
        at = f"array_position({keys}, key)"
        first, parts = (_longs([v[i] for v in heavy.values()]) for i in (0, 1))
        ranged = ranged.withColumn("rid", F.expr(f"CASE WHEN {at} > 0 THEN cast({first}[cast({at} - 1 AS int)] + pmod(xxhash64('part', nth), {parts}[cast({at} - 1 AS int)]) AS int) ELSE rid END"))
    ranged = ranged.withColumn("cell", F.pmod(F.xxhash64(F.lit("cell"), "nth"), F.lit(cells)).cast("int"))

    # at most (ranges + heavy parts) * cells rows from here on
    per_cell = stored(ranged.groupBy("rid", "cell").agg(F.count("*").alias("n"), F.sum("size").alias("size")))
    sizes = {r["rid"]: r["size"] for r in per_cell.groupBy("rid").agg(F.sum("size").alias("size")).collect()}
    dealt = deal(sizes, shards)
    shard_of = "array(" + ",".join(str(dealt.get(r, 0)) for r in range(next_rid)) + ")"
    placed = per_cell.withColumn("shard", F.expr(f"{shard_of}[rid]"))
    before = Window.partitionBy("shard").orderBy("rid", "cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = stored(placed.select(F.col("rid").alias("p_rid"), F.col("cell").alias("p_cell"), "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))

    within = Window.partitionBy("rid", "cell").orderBy("key", "doc_id", "nth")
    numbered = ranged.withColumn("rank", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(placed), (F.col("rid") == F.col("p_rid")) & (F.col("cell") == F.col("p_cell"))).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

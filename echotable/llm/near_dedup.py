"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation.

1. One pass over the texts gives each document the size and digest of its shingle set, 32 band hashes of four MinHash
   samples each, and an odd sketch: every sample flips one bit of a 512-bit bitmap. Two sets of similarity J differ in
   about 128 (1 - J) samples, so the set bits of the XOR of their bitmaps estimate J; the higher J, the closer.
2. Documents with equal sets form classes, and only the smallest id of each goes on.
3. Buckets are the documents that share a band hash. In small buckets all pairs are candidates. Larger ones would
   give too many, and only components are wanted: there each member is paired with two leaders, of those that
   share most bands with others.
4. What of a large bucket isn't in one component after that is either a crowd of near copies with stragglers, or shares a
   passage and little else. A shingle that no other document of these buckets has can't be common to a pair, so the
   number of such shingles bounds a document's similarity with any other, exactly; stragglers mostly fall out. Of the others
   the members outside a bucket's largest component are the leaders, all at once if they are few; a bucket with many
   is first split into finer ones (two such buckets agree), and those go on in rounds of four times as many leaders each. No pair is given up unless the bound or
   the sketch excludes it or its two documents are already connected.
5. Candidates whose sketches estimate less than `floor` are dropped; `floor` lies seven standard deviations
   below the threshold. In step 4, where crowds have very many pairs just below the threshold, odd sketches of 1024 samples
   in 4096 bits also have to reach `fine_floor`, six of their standard deviations below it; only the documents left there
   get them. The rest are confirmed on their full sets.

A pair at similarity 0.8 shares no band of 32 with a probability of 5e-8, and only one with 1e-6.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import BROADCAST_IDS, grams, hashed, measured, mixed, only_ids, rows_of, stored, text_hash, without_ids, word_list
from .components import components

BANDS, ROWS, BITS = 32, 4, 512
SAMPLES = BANDS * ROWS
FINE_SAMPLES, FINE_BITS = 1024, 4096
SMALL = 16
LEADERS = 2
MINORS = 256
_random = np.random.Generator(np.random.PCG64(20240607))
_A = _random.integers(0, 1 << 32, SAMPLES, np.uint32) | np.uint32(1)
_B = _random.integers(0, 1 << 32, SAMPLES, np.uint32)
_FINE_A = _random.integers(0, 1 << 32, FINE_SAMPLES, np.uint32) | np.uint32(1)
_FINE_B = _random.integers(0, 1 << 32, FINE_SAMPLES, np.uint32)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Hashes of the distinct runs of `words` words; of a shorter text the whole; of none nothing. Sorted."""
    hashes = hashed(word_list(text, lower=True))
    if len(hashes) == 0:
        return hashes
    return np.unique(grams(hashes, min(words, len(hashes))))


def minhash(shingled: np.ndarray, a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    x = (shingled >> np.uint64(32)).astype(np.uint32)
    least, step = np.full(len(a), 0xFFFFFFFF, np.uint32), (1 << 17) // len(a)
    for i in range(0, len(x), step):
        np.minimum(least, (a[:, None] * x[None, i : i + step] + b[:, None]).min(axis=1), out=least)
    return least


def band_hashes(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return out.view(np.int64)


def odd_sketch(samples: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parities of how many samples fall on each bit, as bits / 64 longs."""
    nth = np.arange(len(samples), dtype=np.uint64) << np.uint64(32)
    at = mixed(samples.astype(np.uint64) + nth) & np.uint64(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def most_bits(floor: float, samples: int = SAMPLES, bits: int = BITS) -> int:
    """How many of `bits` may differ if the estimate 1 + bits / (4 samples) ln(1 - 2 differing / bits) is to reach floor."""
    return math.floor(bits / 2 * (1 - math.exp(-4 * samples / bits * (1 - floor))))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """docs (doc_id, text, row) with `node`, a number of the row, its set's size and digest, bands and sketch."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, bands, bits = [], [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py(), words)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                m = minhash(s) if len(s) else None
                bands.append(band_hashes(m) if len(s) else None)
                bits.append(odd_sketch(m) if len(s) else None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, longs), pa.array(bits, longs)], ["doc_id", "row", "n_shingles", "set_key", "bands", "sketch"])

    out = docs.mapInArrow(sketch, "doc_id long, row long, n_shingles long, set_key binary, bands array<long>, sketch array<long>")
    return out.withColumn("node", F.monotonically_increasing_id())


def sets_of(docs: DataFrame, nodes: DataFrame, n: int, words: int) -> DataFrame:
    """(id, set) of the nodes (doc_id, row, node), of which there are n."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), words).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], ["id", "set"])

    names = nodes.select(F.col("doc_id").alias("of"), F.col("row").alias("of_row"), "node")
    read = docs.join(F.broadcast(names) if n <= BROADCAST_IDS // 3 else names, (F.col("doc_id") == F.col("of")) & (F.col("row") == F.col("of_row"))).select("node", "text")
    out, seen = measured(read.mapInArrow(sets, "id long, set array<long>"), rows=F.count("*"))
    return stored(out.dropDuplicates(["id"])) if seen["rows"] > n else out  # rows that repeat


def fine_sketches(sets: DataFrame) -> DataFrame:
    """(id, set) -> (sketched, fine): an odd sketch of eight times as many samples and bits."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = [odd_sketch(minhash(np.asarray(s.values).view(np.uint64), _FINE_A, _FINE_B), FINE_BITS) for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fine, pa.list_(pa.int64()))], ["sketched", "fine"])

    return sets.select("id", "set").mapInArrow(sketch, "sketched long, fine array<long>")


def _finely_differing(x: str, y: str) -> F.Column:
    # 64 longs: unrolled like the short sketch they would make a method too long to be compiled
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, k: n + k)


def _differing(x: str, y: str) -> F.Column:
    return sum(F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(BITS // 64))


def alike(pairs: DataFrame, sketched: DataFrame, floor: float) -> DataFrame:
    """The pairs (a, b) whose sketches reach floor."""
    of = {x: sketched.select(F.col("node").alias(f"id_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab"}
    near = pairs.join(of["a"], F.col("a") == F.col("id_a")).join(of["b"], F.col("b") == F.col("id_b"))
    return near.where(_differing("sketch_a", "sketch_b") <= most_bits(floor)).select("a", "b")


def _named(ids: DataFrame, reps: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, row, node) of the nodes in ids (one column of distinct nodes), and how many there are."""
    ids = ids.select(F.col(ids.columns[0]).alias("n_id"))
    out, seen = measured(reps.select("doc_id", "row", "node").join(ids, F.col("node") == F.col("n_id")).drop("n_id"), n=F.count("*"))
    return out, seen["n"]


def confirmed(near: DataFrame, docs: DataFrame, reps: DataFrame, words: int, percent: int) -> tuple[DataFrame, int]:
    """The pairs (a, b) that reach the threshold on their full sets, and how many there are."""
    near, seen = measured(near, n=F.count("*"))
    if not seen["n"]:
        return near, 0
    sets = sets_of(docs, *_named(near.select("a").union(near.select("b")).distinct(), reps), words)
    of = {x: sets.select(F.col("id").alias(f"id_{x}"), F.col("set").alias(f"set_{x}")) for x in "ab"}
    both = near.join(of["a"], F.col("a") == F.col("id_a")).join(of["b"], F.col("b") == F.col("id_b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    out, seen = measured(both.where(100 * common >= percent * (F.size("set_a") + F.size("set_b") - common)).select("a", "b"), n=F.count("*"))
    return out, seen["n"]


def usable(docs: DataFrame, ids: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, size, shared, fine, sketch): how many shingles a node of ids has, how many of them another one has, and its sketches; without those that can't reach the threshold."""
    sets = sets_of(docs, *_named(ids, reps), words)
    each = sets.select("id", F.explode("set").alias("shingle")).groupBy("shingle").agg(F.min("id").alias("owner"), F.count("*").alias("n"))
    novel = each.where("n = 1").groupBy("owner").agg(F.count("*").alias("novel"))
    size = F.size("set").cast("long")
    out = sets.select("id", size.alias("size")).join(novel, F.col("id") == F.col("owner"), "left").select("id", "size", (F.col("size") - F.coalesce("novel", F.lit(0))).alias("shared"))
    out, seen = measured(out.where(100 * F.col("shared") >= percent * F.col("size")), n=F.count("*"))
    fine = fine_sketches(only_ids(sets, "id", out.select("id"), n=seen["n"]))
    out = out.join(fine, F.col("id") == F.col("sketched")).drop("sketched")
    return stored(out.join(reps.select("node", "sketch"), F.col("id") == F.col("node")).drop("node"))


def in_components(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """rows with column c: the component of the node."""
    comp = comp.select(F.col("node").alias("c_id"), F.col("component").alias("c_of"))
    return rows.join(comp, F.col("node") == F.col("c_id"), "left").withColumn("c", F.coalesce("c_of", "node")).drop("c_id", "c_of")


def finer(docs: DataFrame) -> DataFrame:
    """(node, buckets, c) -> (bucket, node, c) for each two buckets of a document, at most 32 * 31 / 2."""
    one = docs.withColumn("one", F.explode("buckets"))
    two = one.withColumn("two", F.explode(F.expr("filter(buckets, x -> x > one)")))
    return two.select(F.xxhash64("one", "two").alias("bucket"), "node", "c")


def linked(reps: DataFrame, docs: DataFrame, words: int, percent: int, floor: float, fine_floor: float) -> DataFrame | None:
    """(node, component) of those of reps (doc_id, row, node, bands, sketch) that are linked, None if there are none."""
    rows = reps.select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy(F.col("bucket").alias("of")).agg(F.count("*").alias("n")).where("n > 1")
    members, seen = measured(rows.join(shared, F.col("bucket") == F.col("of")).select("bucket", "node", "n"), most=F.max("n"))
    if not seen["most"]:
        return None
    few, many = members.where(F.col("n") <= SMALL), members.where(F.col("n") > SMALL)
    one, two = few.select("bucket", F.col("node").alias("a")), few.select(F.col("bucket").alias("of"), F.col("node").alias("b"))
    pairs = one.join(two, (F.col("bucket") == F.col("of")) & (F.col("a") < F.col("b"))).select("a", "b")
    if crowded := seen["most"] > SMALL:
        mass = members.groupBy(F.col("node").alias("id")).agg(F.sum("n").alias("mass"))
        led = many.join(mass, F.col("node") == F.col("id")).groupBy(F.col("bucket").alias("of"), F.pmod(F.xxhash64("node"), F.lit(LEADERS)).alias("nth"))
        leaders = stored(led.agg(F.max_by("node", F.struct("mass", -F.col("node"))).alias("leader")))
        stars = many.join(leaders, F.col("bucket") == F.col("of")).where("node <> leader")
        pairs = pairs.union(stars.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")))
    links, n = confirmed(alike(pairs.distinct(), reps, floor), docs, reps, words, percent)
    comp = components(links)
    if not crowded:
        return comp
    # the leaders have met all of their bucket; what else of it isn't in one component goes on
    rest = many.join(leaders, (F.col("bucket") == F.col("of")) & (F.col("node") == F.col("leader")), "left_anti").select("bucket", "node")
    rest = stored(in_components(rest, comp))
    split = rest.groupBy(F.col("bucket").alias("of")).agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most").select("of")
    rest, seen = measured(rest.join(split, F.col("bucket") == F.col("of"), "left_semi"), n=F.count("*"))
    if not seen["n"]:
        return comp
    facts = usable(docs, rest.select("node").distinct(), reps, words, percent)
    rest = stored(rest.join(facts.select("id"), F.col("node") == F.col("id"), "left_semi"))
    crowds = _minors(rest).where(F.col("minors") > MINORS).select("of", F.lit(True).alias("crowd"))
    kinds = rest.join(crowds, F.col("bucket") == F.col("of"), "left")
    crowd = F.when(F.col("crowd"), F.col("bucket"))
    one = F.when(F.col("crowd").isNull(), F.col("bucket"))
    lists = kinds.groupBy(F.col("node").alias("of"), "c").agg(F.array_sort(F.collect_set(one)).alias("ones"), F.array_sort(F.collect_set(crowd)).alias("crowds"))  # 32 at most
    facts = stored(facts.join(lists, F.col("id") == F.col("of")).drop("of"))
    rows = stored(facts.select(F.explode("ones").alias("bucket"), F.col("id").alias("node"), "c").union(finer(facts.select(F.col("id").alias("node"), F.col("crowds").alias("buckets"), "c"))))
    facts = facts.drop("c")
    # a pair counts in the first only of the buckets of a kind that it shares
    ones, two = (F.array_intersect(c, f"leader_{c}") for c in ("ones", "crowds"))
    first = F.coalesce(F.get(ones, 0) == F.col("bucket"), F.lit(False)) | F.coalesce(F.xxhash64(F.get(two, 0), F.get(two, 1)) == F.col("bucket"), F.lit(False))
    most = MINORS
    while True:
        rows, seen = measured(rows.join(_minors(rows).where("minors > 0"), F.col("bucket") == F.col("of")).drop("of"), minors=F.max("minors"))
        if not seen["minors"]:
            return comp
        nth = F.when(F.col("minors") <= most, F.col("node")).otherwise(F.pmod(F.xxhash64("node"), F.lit(most)))
        leaders = rows.where("c <> major").groupBy(F.col("bucket").alias("of"), nth.alias("nth")).agg(F.min_by("c", "node").alias("leader_c"), F.min("node").alias("leader")).drop("nth")
        leaders = stored(leaders)
        ours = [F.col(c).alias(f"leader_{c}") for c in ("id", "size", "shared", "sketch", "fine", "ones", "crowds")]
        near = (_differing("sketch", "leader_sketch") <= most_bits(floor)) & first & (_finely_differing("fine", "leader_fine") <= most_bits(fine_floor, FINE_SAMPLES, FINE_BITS))
        stars = rows.join(facts, F.col("node") == F.col("id")).join(leaders.join(facts.select(ours), F.col("leader") == F.col("leader_id")), (F.col("bucket") == F.col("of")) & (F.col("c") != F.col("leader_c")) & _within(percent) & near)
        new, n = confirmed(stars.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), docs, reps, words, percent)
        if n:
            comp = components(new.union(comp.select("node", "component")))
        if seen["minors"] <= most:
            return comp
        rest = rows.join(leaders, (F.col("bucket") == F.col("of")) & (F.col("node") == F.col("leader")), "left_anti").where(F.col("minors") > most)
        rows = stored(in_components(rest.select("bucket", "node"), comp))
        most *= 4


def _minors(rows: DataFrame) -> DataFrame:
    """(of, major, minors): a bucket's largest component and how many members are outside it."""
    sizes = rows.groupBy("bucket", "c").agg(F.count("*").alias("k"))
    return sizes.groupBy(F.col("bucket").alias("of")).agg(F.max_by("c", F.struct("k", "c")).alias("major"), (F.sum("k") - F.max("k")).alias("minors"))


def _within(percent: int) -> F.Column:
    common = F.least("shared", "leader_shared")
    return 100 * common >= percent * (F.col("size") + F.col("leader_size") - common)


def grouped(docs: DataFrame, words: int, percent: int, floor: float, fine_floor: float) -> DataFrame:
    """docs (doc_id, text, row) -> doc_id, row, n_shingles, label (of its group, null for a null id), component_id."""
    named = docs.where("doc_id IS NOT NULL")
    base = stored(sketches(docs, words))
    copied = base.where("doc_id IS NOT NULL AND set_key IS NOT NULL").groupBy(F.col("set_key").alias("key")).agg(F.min("node").alias("rep"), F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    classed = base.join(copied, F.col("set_key") == F.col("key"), "left").withColumns({"rep": F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "node")), "first": F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id"))})
    alone = (F.col("node") == F.col("rep")) & (F.col("n_shingles") > 0)
    classed = stored(classed.select("doc_id", "row", "node", "n_shingles", "rep", "first", *[F.when(alone, F.col(c)).alias(c) for c in ("bands", "sketch")]))
    reps = classed.where("bands IS NOT NULL").select("doc_id", "row", "node", "first", "bands", "sketch")
    comp = linked(reps, named, words, percent, floor, fine_floor)
    if comp is None:
        return classed.select("doc_id", "row", "n_shingles", F.col("rep").alias("label"), F.col("first").alias("component_id"))
    comp = comp.select(F.col("node").alias("id"), "component")
    least = comp.join(reps.select("node", "first"), F.col("id") == F.col("node")).groupBy(F.col("component").alias("of")).agg(F.min("first").alias("component_id"))
    comp = stored(comp.join(least, F.col("component") == F.col("of")).select("id", "component", "component_id"))
    out = classed.join(comp, F.col("rep") == F.col("id"), "left")
    return out.select("doc_id", "row", "n_shingles", F.coalesce("component", "rep").alias("label"), F.coalesce("component_id", "first").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, floor: float = 0.55, fine_floor: float = 0.72) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id is that).

    Texts without words are linked with nothing. Rows with a null id are linked with nothing, have a null component
    and are kept. Rows of one id are documents of their own: each is linked by its own text, and a smaller id in a row's
    group makes that row a copy, not the others of its id. An empty table gives no rows.
    """
    out = grouped(rows_of(docs, id_col, text_col), words, percent, floor, fine_floor)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, floor: float = 0.55, fine_floor: float = 0.72) -> DataFrame:
    """docs with one row of each group of near duplicates: that with the smallest id, and of its rows that with the least text hash.

    A row that repeats id and text goes as well, whatever its other columns. Rows with a null id and texts without words
    stay. An empty table gives no rows.
    """
    found = stored(grouped(rows_of(docs, id_col, text_col), words, percent, floor, fine_floor).where("doc_id IS NOT NULL"))
    first = found.where("doc_id = component_id")
    crowd = first.groupBy(F.col("label").alias("of")).agg(F.count("*").alias("n"), F.min("row").alias("least")).where("n > 1")
    crowd, seen = measured(first.join(crowd, F.col("label") == F.col("of")).select("doc_id", "row", "least").distinct(), n=F.count("*"))
    gone = found.where("doc_id <> component_id").select("doc_id", "row").distinct()
    if seen["n"]:
        gone = gone.union(crowd.where("row <> least").select("doc_id", "row"))
    gone, lost = measured(gone, n=F.count("*"))
    ours = f"row_{uuid.uuid4().hex}"
    keyed = docs.withColumn(ours, text_hash(text_col)).withColumn(f"{ours}_id", docs[id_col].cast("long"))
    keyed = without_ids(keyed, [f"{ours}_id", ours], gone, n=lost["n"])
    if seen["n"]:  # rows that repeat
        few = crowd.where("row = least").select("doc_id", "row")
        keyed = without_ids(keyed, [f"{ours}_id", ours], few).unionByName(only_ids(keyed, [f"{ours}_id", ours], few).dropDuplicates([f"{ours}_id", ours]))
    return keyed.select(docs.columns)

"""Benchmark passages in training texts, by spaced seeds.

A mask of words of which some count (1) and some don't (0) gives a hash of the words at its ones. A copied
passage with words replaced still agrees with the benchmark item wherever a mask's ones miss the replaced words;
several masks make that likely. Spark joins the hashes of benchmark and documents; a hit gives the item and a diagonal, the
difference of the two positions. Along each diagonal hit all aligned words are compared, and what agrees is joined over
nearby diagonals where words were put in or left out. A document holds an item if enough words agree. A run of six
equal words is always hit, so a block of words replaced in a passage leaves its longer part to be found.

Few hashes of documents are in the benchmark. A bitmap of fixed size that all tasks hold keeps most others out of
the join; it has false positives and no false negatives, so it changes nothing but the work.

A seed that many items share, such as those of a common header, would pair each document that has it with all of them. Where
such seeds cover so much of an item that they alone may make it held, they do name it. Of any other item a document must hold so many
of the words that they leave out that one of its rarest is among them: it has to lie near the seed in the document. Seeds of the
same items are one family, and a join on family and word finds these items; none is lost.

With the masks below, of passages with words replaced at random at least 0.9 are found where a third of the words are
replaced, from 20 words on; where 40 % are, from 37 words on. Replacing every second, third, fourth or fifth word hides none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import hashed, measured, mixed, only_ids, rows_of, stored, text_hash, without_ids, word_list

MASKS = ("111111", "11001010011", "10101010101", "11010001101", "10010110011", "110100000111")
BITS = 27  # of the bitmap's index: 16 MB whatever the benchmark's size
_BASE = np.uint64(0x9E3779B97F4A7C15)


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """A hash for each position of the mask, over the words under its ones."""
    ones = [i for i, c in enumerate(mask) if c == "1"]
    n = len(hashes) - ones[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, int(mask, 2), np.uint64)
    for i in ones:
        out = out * _BASE + hashes[i : i + n]
    return mixed(out)


def _words(text: str | None) -> np.ndarray:
    return hashed(word_list(text, lower=True))


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, text) -> item, words (hashes); of items with words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array([_words(t.as_py()).view(np.int64) for t in batch.column("text")], pa.list_(pa.int64()))], ["item", "words"])

    return benchmark.mapInArrow(read, "item long, words array<long>").where(F.size("words") > 0)


def item_seeds(items: DataFrame, least: int) -> DataFrame:
    """item, hash, start, span of each seed; an item of less than `least` words has one, of all its words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(batch.column("item").to_pylist(), batch.column("words"), strict=True):
                words = words.values.to_numpy().view(np.uint64)
                for mask in MASKS if len(words) >= least else ("1" * len(words),):
                    h = seeds(words, mask).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), item)), pa.array(h), pa.array(np.arange(len(h))), pa.array(np.full(len(h), len(mask)))], ["item", "hash", "start", "span"])

    return items.mapInArrow(read, "item long, hash long, start long, span long")


def bitmap(found: DataFrame) -> np.ndarray:
    """One bit for each value of the first BITS bits of the hashes, as 64-bit words."""
    at = f"shiftrightunsigned(hash, {64 - BITS})"
    words = found.groupBy(F.expr(f"shiftrightunsigned({at}, 6)").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast({at} & 63 AS int)))").alias("bits")).toArrow()  # at most 2 ** (BITS - 6) rows
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _marked(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - BITS)
    return np.flatnonzero((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1))


def hits(docs: DataFrame, bits, lengths: list[int]) -> DataFrame:
    """doc_id, row, hash, pos of the seeds whose bit is set; `lengths` are those of the short items. bits is a broadcast bitmap."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, found, places = [], [], [], []
            for doc_id, row, text in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("text"), strict=True):
                words = _words(text.as_py())
                for mask in (*MASKS, *("1" * n for n in lengths)):
                    h = seeds(words, mask)
                    if len(at := _marked(h, bits.value)):
                        ids.append(np.full(len(at), doc_id))
                        rows.append(np.full(len(at), row))
                        found.append(h[at].view(np.int64))
                        places.append(at)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (ids, rows, found, places)], ["doc_id", "row", "hash", "pos"])

    return docs.mapInArrow(read, "doc_id long, row long, hash long, pos long")


def overlap(words: np.ndarray, want: np.ndarray, shifts: list[int]) -> tuple[int, int, int]:
    """(equal words, first word, end word) of the best place of an item among words, joined over diagonals within a quarter of its length."""
    shifts = sorted(shifts)
    agreeing = []
    for shift in shifts:
        first, end = max(0, -shift), min(len(want), len(words) - shift)
        agreeing.append(first + np.flatnonzero(want[first:end] == words[first + shift : end + shift]))
    best, low, high, reach = (0, 0, 0), 0, 0, len(want) // 4
    for s in shifts:
        while shifts[low] < s - reach:
            low += 1
        while high < len(shifts) and shifts[high] <= s + reach:
            high += 1
        near = [(shifts[k], agreeing[k]) for k in range(low, high) if len(agreeing[k])]
        if near:  # a word of either counts once
            ours, theirs = np.unique(np.concatenate([at for _, at in near])), np.unique(np.concatenate([shift + at for shift, at in near]))
            best = max(best, (min(len(ours), len(theirs)), -int(theirs[0]), int(theirs[-1]) + 1))
    return best[0], -best[1], best[2]


FOUND = "doc_id long, row long, item_id long, first_word long, end_word long, n_equal long, n_item long"


def _families(found: DataFrame, hot: int) -> DataFrame:
    """h, family: hashes of more than `hot` items; those of the same items (told by their number and two sums of hashes) are a family."""
    of = lambda seed: F.bit_xor(F.xxhash64("item", F.lit(seed)))
    each = found.select("hash", "item").distinct().groupBy(F.col("hash").alias("h")).agg(F.count("*").alias("n"), of(1).alias("x"), of(2).alias("y"))
    return each.where(F.col("n") > hot).select("h", F.xxhash64("n", "x", "y").alias("family"))


def _probes(items: DataFrame, shared: DataFrame, lacking: DataFrame) -> DataFrame:
    """family, w, item: of each item in `lacking` (of, at: the places that its common seeds cover, lacks: how many other words it needs) its rarest other words.

    Of m other words k must agree, so that one of any m - k + 1 does.
    """
    words = items.select("item", F.posexplode("words").alias("at", "w"))
    often = words.groupBy(F.col("w").alias("word")).agg(F.countDistinct("item").alias("often"))
    other = words.join(lacking, F.col("item") == F.col("of")).where("NOT array_contains(covered, at)").join(often, F.col("w") == F.col("word"))
    of_item = Window.partitionBy("item")
    ranked = other.withColumns({"m": F.count("*").over(of_item), "nth": F.row_number().over(of_item.orderBy("often", "w", "at"))})
    rare = ranked.where(F.col("nth") <= F.col("m") - F.col("lacks") + 1).select("item", "w").distinct()
    return rare.join(shared.select(F.col("item").alias("of"), "family").distinct(), F.col("item") == F.col("of")).select("family", "w", "item")


def _near(docs: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, row, family, w: the words near the seeds of a family, by places (id, id_row, family, lo, hi)."""
    texts = docs.join(places, (F.col("doc_id") == F.col("id")) & (F.col("row") == F.col("id_row"))).select("doc_id", "row", "text", "family", "lo", "hi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, row, text, family, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text", "family", "lo", "hi")), strict=True):
                w = np.unique(_words(text)[max(lo, 0) : hi]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), x)) for x in (doc_id, row, family)] + [pa.array(w)], ["doc_id", "row", "family", "w"])

    return texts.mapInArrow(read, "doc_id long, row long, family long, w long")


def held(docs: DataFrame, benchmark: DataFrame, part: float, least: int, hot: int) -> DataFrame:
    """docs (doc_id, text, row), benchmark (item, text) -> FOUND."""
    items, n_items = measured(items_of(benchmark), n=F.count("*"), short=F.collect_set(F.when(F.size("words") < least, F.size("words"))))
    if not n_items["n"]:
        return docs.sparkSession.createDataFrame([], FOUND)
    found = stored(item_seeds(items, least))
    common, n_common = measured(_families(found, hot), n=F.count("*"))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(found))
    met = stored(hits(docs, bits, sorted(n_items["short"])))
    places = ["doc_id", "row", "item"]
    named, shifts = found.select("item", F.col("hash").alias("h"), "start"), (F.col("pos") - F.col("start")).alias("shift")
    if not n_common["n"]:
        diagonals = met.join(named, F.col("hash") == F.col("h")).select(*places, shifts)
    else:
        shared = stored(found.join(common, F.col("hash") == F.col("h")).select("item", "h", "start", "span", "family"))
        covered = shared.select("item", F.explode(F.sequence("start", F.col("start") + F.col("span") - 1)).alias("at")).groupBy(F.col("item").alias("of")).agg(F.collect_set("at").alias("covered"))  # at most the item's words
        size = F.size("words")
        needed = F.ceil(F.greatest(F.least(F.lit(least), size), F.lit(part) * size))
        lacking = stored(items.join(covered, F.col("item") == F.col("of")).select("of", "covered", (needed - F.size("covered")).alias("lacks"), size.alias("size")))
        keep = lacking.where("lacks <= 0").select("of")
        direct = named.join(common, "h", "left_anti").unionByName(shared.join(keep, F.col("item") == F.col("of"), "left_semi").select("item", "h", "start"))
        pairs = met.join(direct, F.col("hash") == F.col("h")).select(*places, shifts)
        # the others of a family by a rare word near its seeds
        longest = shared.join(lacking, F.col("item") == F.col("of")).groupBy("h").agg(F.first("family").alias("family"), F.max("size").alias("size"))
        at = met.join(longest, F.col("hash") == F.col("h")).groupBy(F.col("doc_id").alias("id"), F.col("row").alias("id_row"), "family").agg(F.min(F.col("pos") - 2 * F.col("size")).alias("lo"), F.max(F.col("pos") + 2 * F.col("size")).alias("hi"))
        probes = _probes(items, shared, lacking.where("lacks > 0"))
        by_word = _near(docs, stored(at)).join(probes.withColumnRenamed("family", "f").withColumnRenamed("w", "v"), (F.col("family") == F.col("f")) & (F.col("w") == F.col("v"))).select(*places)
        pairs = stored(pairs.unionByName(by_word.distinct(), allowMissingColumns=True))
        # whatever a pair was found by, its common seeds give diagonals as well
        seen_in = met.select(F.col("doc_id").alias("id"), F.col("row").alias("id_row"), "hash", "pos")
        also = pairs.select(*places).distinct().join(shared.select(F.col("item").alias("of"), "h", "start"), F.col("item") == F.col("of"))
        also = also.join(seen_in, (F.col("doc_id") == F.col("id")) & (F.col("row") == F.col("id_row")) & (F.col("h") == F.col("hash"))).select(*places, shifts)
        diagonals = pairs.where("shift IS NOT NULL").unionByName(also)
    diagonals = diagonals.groupBy(*places).agg(F.collect_set("shift").alias("shifts"))  # at most the words of both
    wanted = stored(diagonals.join(items.select(F.col("item").alias("of"), "words"), F.col("item") == F.col("of")).drop("of"))
    bits.unpersist()
    return verified(docs, wanted, part, least)


def verified(docs: DataFrame, wanted: DataFrame, part: float, least: int, together: int = 1000) -> DataFrame:
    """docs and wanted (doc_id, row, item, shifts, words) -> FOUND, from a stream of each text followed by its items; a document with many items is dealt out."""
    counts, seen = measured(wanted.groupBy(F.col("doc_id").alias("id"), F.col("row").alias("id_row")).agg(F.ceil(F.count("*") / together).cast("int").alias("shares")), n=F.count("*"))
    on = (F.col("doc_id") == F.col("id")) & (F.col("row") == F.col("id_row"))
    texts = only_ids(docs, ["doc_id", "row"], counts, n=seen["n"]).join(counts, on)
    none = lambda t: F.lit(None).cast(t)
    texts = texts.withColumn("nth", F.monotonically_increasing_id()).select("doc_id", "row", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), none("long").alias("item"), "nth", "text", none("array<long>").alias("shifts"), none("array<long>").alias("words"))
    asked = wanted.join(counts, on).select("doc_id", "row", F.pmod(F.xxhash64("item"), "shares").cast("int").alias("share"), "item", none("long").alias("nth"), none("string").alias("text"), "shifts", "words")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows_of_text, words = None, 0, None  # rows that repeat an id and a text are found each
        for batch in batches:
            rows = []
            for doc_id, row, share, item, text, shifts, want in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "share", "item", "text", "shifts", "words")), strict=True):
                if item is None:
                    rows_of_text = rows_of_text + 1 if key == (doc_id, row, share) else 1
                    key, words = (doc_id, row, share), _words(text)
                    continue
                n, i, j = overlap(words, np.array(want, np.int64).view(np.uint64), shifts)
                if n >= min(least, len(want)) and n >= part * len(want):
                    rows += [(doc_id, row, item, i, j, n, len(want))] * rows_of_text
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "row", "item_id", "first_word", "end_word", "n_equal", "n_item"])

    both = texts.unionByName(asked).repartition("doc_id", "row", "share").sortWithinPartitions("doc_id", "row", "share", F.col("item").asc_nulls_first())
    return both.mapInArrow(verify, FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", part: float = 0.5, least: int = 12, hot: int = 100) -> DataFrame:
    """doc_id, item_id, first_word, end_word, n_equal, n_item: which documents hold which benchmark items.

    An item counts as held if at least `part` of its words, and `least` words or all of a shorter item, stand in the document
    in place, words replaced, put in or left out aside. Case of A-Z doesn't count. Seeds of more than `hot` items are joined in another way, to the same result. Items and
    documents without words, or with a null id, hold nothing. An item that repeats counts once; of an id with several texts each is an item. Rows that
    repeat are found each, rows of one id by their own text. Empty tables give no rows.
    """
    docs = rows_of(docs, id_col, text_col).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return held(docs, _items(benchmark, item_id, item_text), part, least, hot).drop("row")


def _items(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    return benchmark.select(benchmark[item_id].cast("long").alias("item"), benchmark[item_text].cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL").distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", part: float = 0.5, least: int = 12, hot: int = 100) -> DataFrame:
    """docs without the rows that hold a benchmark item, by the rules of contaminated; rows with a null id stay."""
    found = held(rows_of(docs, id_col, text_col).where("doc_id IS NOT NULL AND text IS NOT NULL"), _items(benchmark, item_id, item_text), part, least, hot)
    gone, seen = measured(found.select("doc_id", "row").distinct(), n=F.count("*"))
    names = [f"{c}_{uuid.uuid4().hex}" for c in ("id", "row")]  # whatever columns docs has
    keyed = docs.withColumns({names[0]: docs[id_col].cast("long"), names[1]: text_hash(text_col)})
    return without_ids(keyed, names, gone, n=seen["n"]).select(docs.columns)

"""Repeated passages: Rabin-Karp hashes of all windows of 50 words, counted in Spark.

Few windows can repeat, and only those are hashed and counted whole. Each window is named by its anchor, the
least hash of a run of ten words inside it. Equal windows have equal anchors, so windows whose anchor stands in one
document only are unique. Neighbouring windows mostly share their anchor, which leaves about one row in twenty words
for the first count. Windows with a repeated anchor are counted by their own hash together with the anchor's,
96 bits in all. Windows found in an earlier document merge into maximal intervals of words to remove.

Exact copies of a whole text are settled by its digest before all that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import grams, hashed, measured, only_ids, rows_of, stored, without_ids, word_list

RUN = 10


def window_anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window of words the least hash of a run of RUN words in it: a sliding minimum, by doubling."""
    runs = grams(hashes, RUN)
    width, least, length = window - RUN + 1, runs, 1
    while 2 * length <= width:
        least = np.minimum(least[:-length], least[length:])
        length *= 2
    rest = width - length
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def _texts(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, row, n_words, digest of the words, the distinct anchors of the windows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, anchors = [], [], []
            for text in batch.column("text"):
                words = word_list(text.as_py())
                sizes.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                anchors.append(np.unique(window_anchors(hashed(words), window)).view(np.int64) if len(words) >= window else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(anchors, pa.list_(pa.int64()))], ["doc_id", "row", "n_words", "digest", "anchors"])

    return docs.mapInArrow(read, "doc_id long, row long, n_words long, digest string, anchors array<long>")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, row, pos, window hash, anchor (32 bits of it) of the windows whose anchor is in the column `repeated`."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, row, text, repeated in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("text"), batch.column("repeated"), strict=True):
                hashes = hashed(word_list(text.as_py()))
                if len(hashes) < window:
                    continue
                anchors = window_anchors(hashes, window).view(np.int64)
                pos = np.flatnonzero(np.isin(anchors, repeated.values.to_numpy(zero_copy_only=False)))
                windows = grams(hashes, window).view(np.int64)[pos]
                for i in range(0, len(pos), 100_000):
                    p = pos[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), doc_id)), pa.array(np.full(len(p), row)), pa.array(p.astype(np.int32)), pa.array(windows[i : i + 100_000]), pa.array((anchors[p] >> 32).astype(np.int32))], ["doc_id", "row", "pos", "hash", "anchor"])

    return docs.mapInArrow(read, "doc_id long, row long, pos int, hash long, anchor int")


KEY = ["doc_id", "row"]


def _same(ids: str, rows: str) -> list:
    return [F.col("doc_id") == F.col(ids), F.col("row") == F.col(rows)]


def removals(docs: DataFrame, window: int = 50) -> tuple[DataFrame, DataFrame, int]:
    """docs (doc_id, text, row), ids not null -> (texts: doc_id, row, n_words, digest, copy; spans: id, id_row, starts of windows to remove; how many spans)."""
    texts = stored(_texts(docs, window))
    copies = texts.where(F.col("n_words") >= window).groupBy(F.col("digest").alias("key")).agg(F.min("doc_id").alias("first"), F.min_by("row", "doc_id").alias("first_row"), F.count("*").alias("n")).where("n > 1")
    alone = F.col("first").isNull() | ((F.col("doc_id") == F.col("first")) & (F.col("row") == F.col("first_row")))
    texts = stored(texts.join(copies, F.col("digest") == F.col("key"), "left").select(*KEY, "n_words", "digest", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("copy"), F.when(alone, F.col("anchors")).alias("anchors")))
    anchored = texts.where("anchors IS NOT NULL").select(*KEY, F.explode("anchors").alias("anchor"))
    repeated = stored(anchored.groupBy(F.col("anchor").alias("of")).agg(F.count("*").alias("n")).where("n > 1").select("of"))
    of_doc = anchored.join(repeated, F.col("anchor") == F.col("of")).groupBy(F.col("doc_id").alias("id"), F.col("row").alias("id_row")).agg(F.collect_set("anchor").alias("repeated"))  # as many as the document has
    of_doc, seen = measured(of_doc, n=F.count("*"))
    some = only_ids(docs, KEY, of_doc, n=seen["n"])
    some = stored(some.join(of_doc, _same("id", "id_row")).select(*KEY, "text", "repeated"))
    windows = _windows(some, window)
    first = stored(windows.groupBy(F.col("hash").alias("h"), F.col("anchor").alias("a")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"))
    later = windows.join(first, (F.col("hash") == F.col("h")) & (F.col("anchor") == F.col("a"))).where("doc_id > first")
    # at most one row for each word of the document
    starts, seen = measured(later.groupBy(F.col("doc_id").alias("id"), F.col("row").alias("id_row")).agg(F.collect_set("pos").alias("starts")), n=F.count("*"))
    return texts.drop("anchors"), starts, seen["n"]


def intervals(starts: np.ndarray, window: int) -> np.ndarray:
    """Maximal intervals [from, to) that windows at these starts cover."""
    starts = np.sort(starts)
    new = np.flatnonzero(np.diff(starts) > window) + 1
    return np.stack([starts[np.r_[0, new]], starts[np.r_[new - 1, len(starts) - 1]] + window], axis=1)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (intervals of removed words); with_text adds kept_text.

    A word goes if a window over it also starts in a document with a smaller id. Null texts have no words. Rows with a
    null id are neither searched nor cut. Rows of one id are judged each by its own text, and none removes from the
    other, as neither id is smaller. An empty table gives no rows.
    """
    docs = rows_of(docs, id_col, text_col)
    texts, starts, n = removals(docs.where("doc_id IS NOT NULL"), window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, at, copy in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "starts", "copy")), strict=True):
                words = word_list(text)
                spans = np.array([[0, len(words)]]) if copy else intervals(np.array(at), window) if at else np.zeros((0, 2), int)
                keep = np.ones(len(words), bool)
                for i, j in spans:
                    keep[i:j] = False
                left = b" ".join([w for w, k in zip(words, keep, strict=True) if k])
                rows.append((doc_id, len(words), int(len(words) - keep.sum()), hashlib.sha256(left).hexdigest(), spans.tolist(), left.decode("utf-8", "surrogatepass") if with_text else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names)

    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.string())
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"]
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<array<long>>, kept_text string"
    touched = only_ids(docs, KEY, starts, n=n).join(starts, _same("id", "id_row")).withColumn("copy", F.lit(False))
    unnamed = docs.where("doc_id IS NULL").withColumns({"starts": F.lit(None).cast("array<int>"), "copy": F.lit(False)})
    plain = without_ids(texts, KEY, starts, n=n)
    read = ["doc_id", "text", "starts", "copy"]
    if with_text:  # then the untouched texts are read again as well
        copies = plain.groupBy(F.col("doc_id").alias("id"), F.col("row").alias("id_row")).agg(F.first("copy").alias("copy"))
        plain = docs.join(copies, _same("id", "id_row")).withColumn("starts", F.lit(None).cast("array<int>"))
        return touched.select(read).unionByName(plain.select(read)).unionByName(unnamed.select(read)).mapInArrow(cut, schema)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    whole = F.array(F.array(F.lit(0).cast("long"), F.col("n_words")))
    plain = plain.select("doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(0).cast("long").alias("n_removed"), F.when(F.col("copy"), nothing).otherwise(F.col("digest")).alias("kept_sha256"), F.when(F.col("copy"), whole).otherwise(F.array().cast("array<array<long>>")).alias("spans"))
    return touched.select(read).unionByName(unnamed.select(read)).mapInArrow(cut, schema).drop("kept_text").unionByName(plain)

"""Repeated lines up to an edit: a deletion-neighbourhood join.

Two lines are alike if their edit distance is at most one after lower-casing and joining white space. Deleting each
character in turn gives a line's neighbourhood; alike lines share a member of it. Emitting it for every line would
give hundreds of rows a line, so a filter that loses nothing comes first. Of two lines at distance one, of which the
longer has M characters, either the first M // 2 characters or the last M - M // 2 are equal. Only lines that share
such a half with another line emit their variants, each with the index deleted. Lines that reach a variant by the
same index differ in that character alone, so all but the earliest of them go. The line equal to the variant is alike
all that reach it: those after it go, and it goes if one is before it. No other lines are alike.

Lines and shared variants are represented by 128-bit hashes; texts are read again only of the documents that hold a
line that passed the filter. Lines too short for an edit to leave them alike go only if their text repeats.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import measured, only_ids, rows_of, stored, text_hash, without_ids

_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def normal(line: str) -> str:
    return _SPACE.sub(" ", line).strip(" ").lower()


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed)


def halves(line: str) -> list[int]:
    """Hashes of the half keys, for the line as the longer of two and as the shorter."""
    m = len(line)
    return [_hash(part, 2 * longer + side) for longer in (m, m + 1) for side, part in enumerate((line[: longer // 2], line[m - (longer - longer // 2) :]))]


def variants(line: str) -> Iterator[tuple[int, str]]:
    """The line, as index -1, and for each index the line without that character."""
    yield -1, line
    for i in range(len(line)):
        yield i, line[:i] + line[i + 1 :]


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def lines_of(docs: DataFrame, least: int) -> DataFrame:
    """A row for each line that isn't blank: its place, two hashes of it, and four half keys if it has `least` normal characters."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, nths, ones, twos, keys = [], [], [], [], [], []
            for doc_id, row, text in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("text"), strict=True):
                for nth, line in enumerate((text.as_py() or "").split("\n")):
                    if line := normal(line):
                        ids.append(doc_id)
                        rows.append(row)
                        nths.append(nth)
                        ones.append(_hash(line))
                        twos.append(_hash(line, 1))
                        keys.append(halves(line) if len(line) >= least else (0,) * 4)
                if len(ids) > 50_000:
                    yield packed(ids, rows, nths, ones, twos, keys)
                    ids, rows, nths, ones, twos, keys = [], [], [], [], [], []
            yield packed(ids, rows, nths, ones, twos, keys)

    def packed(ids: list, rows: list, nths: list, ones: list, twos: list, keys: list) -> pa.RecordBatch:
        k = np.array(keys, np.uint64).reshape(-1, 4).view(np.int64)
        short = ~k.any(axis=1)
        columns = [pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(nths, pa.int32()), _signed(ones), _signed(twos), *[pa.array(k[:, i], mask=short) for i in range(4)]]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "nth", "h1", "h2", "k0", "k1", "k2", "k3"])

    return docs.mapInArrow(read, "doc_id long, row long, nth int, h1 long, h2 long, k0 long, k1 long, k2 long, k3 long")


def _chosen(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, str]]:
    """doc_id, row, number and normal form of the lines in column `nths`."""
    for doc_id, row, text, nths in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text", "nths")), strict=True):
        lines = (text or "").split("\n")
        for nth in nths:
            yield doc_id, row, nth, normal(lines[nth])


def _variants_met(docs: DataFrame) -> DataFrame:
    """docs with column `nths`: for those of its lines a row for each different variant."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, line in _chosen(batch):
                found = np.unique(np.fromiter((_hash(v) for _, v in variants(line)), np.uint64, len(line) + 1))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["variant"])

    return docs.mapInArrow(read, "variant long")


def _variant_rows(docs: DataFrame) -> DataFrame:
    """docs with column `nths`: for those of its lines a row for each index deleted, and one for the line itself."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, row, nth, line in _chosen(batch):
                ones, twos = zip(*((_hash(v), _hash(v, 1)) for _, v in variants(line)), strict=True)
                n = len(ones)
                columns = [_signed(ones), _signed(twos), pa.array(np.arange(-1, n - 1, dtype=np.int32)), pa.array(np.full(n, doc_id, np.int64)), pa.array(np.full(n, row, np.int64)), pa.array(np.full(n, nth, np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["variant", "v2", "cut", "doc_id", "row", "nth"])

    return docs.mapInArrow(read, "variant long, v2 long, cut int, doc_id long, row long, nth int")


AT = ("doc_id", "row", "nth")


def _near(met: DataFrame) -> DataFrame:
    """variant, v2, cut, doc_id, row, nth -> doc_id, row, nth of the lines that are alike an earlier one."""
    at = F.struct(*AT)
    lead = stored(met.groupBy("variant", "v2", "cut").agg(F.min(at).alias("lead")))
    whole = lead.groupBy("variant", "v2").agg(F.min(F.when(F.col("cut") == -1, F.col("lead"))).alias("own"), F.min(F.when(F.col("cut") >= 0, F.col("lead"))).alias("others"))
    # the earliest line that each one is alike to here, itself included
    least = F.when(F.col("cut") == -1, F.least("lead", "others")).otherwise(F.least("lead", "own"))
    least = lead.join(stored(whole), ["variant", "v2"]).select("variant", "v2", "cut", least.alias("least"))
    return met.join(stored(least), ["variant", "v2", "cut"]).where(at > F.col("least")).select(*AT).distinct()


def repeated_lines(docs: DataFrame, least: int = 20) -> tuple[DataFrame, int]:
    """docs (doc_id, text, row), ids not null -> (id, id_row, gone: the numbers of the lines to remove) for documents with any, and how many those are."""
    lines = stored(lines_of(docs, least))
    at = F.struct(*AT)
    unique = stored(lines.groupBy("h1", "h2").agg(F.min(at).alias("first"), *[F.first(k).alias(k) for k in ("k0", "k1", "k2", "k3")], F.count("*").alias("n")))

    keyed = unique.where("k0 IS NOT NULL").select("h1", F.explode(F.array("k0", "k1", "k2", "k3")).alias("key"))  # a line's four keys differ
    shared = stored(keyed.groupBy(F.col("key").alias("of")).agg(F.count("*").alias("n")).where("n > 1").select("of"))
    marked = stored(keyed.join(shared, F.col("key") == F.col("of"), "left_semi").select(F.col("h1").alias("m1")).distinct())
    passed = unique.where("k0 IS NOT NULL").join(marked, F.col("h1") == F.col("m1"), "left_semi")

    nths, seen = measured(passed.groupBy(F.col("first.doc_id").alias("id"), F.col("first.row").alias("id_row")).agg(F.collect_list("first.nth").alias("nths")), n=F.count("*"))
    some = only_ids(docs, ["doc_id", "row"], nths, n=seen["n"])
    some = stored(some.join(nths, (F.col("doc_id") == F.col("id")) & (F.col("row") == F.col("id_row"))).select("doc_id", "row", "text", "nths"))
    often = stored(_variants_met(some).groupBy(F.col("variant").alias("of")).agg(F.count("*").alias("n")).where("n > 1").select("of"))
    near = _near(stored(_variant_rows(some).join(often, F.col("variant") == F.col("of"), "left_semi")))
    # a line goes if it isn't the first of its text, or if its text is like an earlier one
    facts = unique.where("n > 1").select(F.col("h1").alias("u1"), F.col("h2").alias("u2"), "first")
    gone = lines.select(*AT, "h1", "h2").join(facts, (F.col("h1") == F.col("u1")) & (F.col("h2") == F.col("u2")))
    gone = gone.where(at > F.col("first")).select(*AT).union(near)
    gone, seen = measured(gone.groupBy(F.col("doc_id").alias("id"), F.col("row").alias("id_row")).agg(F.array_sort(F.collect_set("nth")).alias("gone")), n=F.count("*"))
    return gone, seen["n"]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers from 0) of every document.

    A line goes if an earlier line is equal but for case and white space or, both having at least `least` normal characters, at edit
    distance one. Earlier is by doc_id, then a hash of the text where an id repeats, then line number; lines are judged on the input, not on
    what is left. Blank lines stay. A null text has no lines. Rows with a null id lose nothing. Rows that repeat id and
    text are one document and lose the same lines; rows of one id with other texts are other documents. An empty table gives no rows.
    """
    docs = rows_of(docs, id_col, text_col)
    gone, _ = repeated_lines(docs.where("doc_id IS NOT NULL"), least)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    out = docs.select("doc_id", "row", n.cast("long").alias("n_lines")).join(gone, (F.col("doc_id") == F.col("id")) & (F.col("row") == F.col("id_row")), "left")
    removed = F.coalesce("gone", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20) -> DataFrame:
    """docs without their repeated lines, by the rules of dedup_lines; a document all of whose lines repeat keeps its row, with an empty text.

    Only documents that lose a line are moved; the others are passed on where they are. An empty table stays empty.
    """
    gone, n = repeated_lines(rows_of(docs, id_col, text_col).where("doc_id IS NOT NULL"), least)
    own, row, gone_id, gone_row, at = (f"{c}_{uuid.uuid4().hex}" for c in ("own", "row", "id", "id_row", "gone"))  # whatever columns docs has
    gone = gone.toDF(gone_id, gone_row, at)
    keyed = docs.withColumns({own: docs[id_col].cast("long"), row: text_hash(text_col)})
    rest = without_ids(keyed, [own, row], gone, n=n)
    # the lists have no bound on their size, so they are never broadcast
    cut = only_ids(keyed, [own, row], gone, n=n).join(gone.hint("merge"), (F.col(own) == F.col(gone_id)) & (F.col(row) == F.col(gone_row)))
    left = F.array_join(F.filter(F.split(text_col, "\n", -1), lambda x, i: ~F.array_contains(at, i)), "\n")
    return rest.select(docs.columns).unionByName(cut.withColumn(text_col, left).select(docs.columns))

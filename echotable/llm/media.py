"""Payloads as content-defined chunks, each stored once.

A payload is the UTF-8 text with zero bytes up to a positive multiple of 64, read as unsigned 8-bit samples. A gear
hash rolls over it and cuts where eleven bits of the hash are zero, so equal stretches get equal chunks wherever they
stand. Chunk digests are counted and joined in Spark; each chunk is owned by the first document that has it.

The store holds a row for each document: its stored form, which is the ordered list of its chunks (digest, length) as
`chunk_list` writes it, and, in one binary, the bodies of those it owns. A document that owns all its chunks is restored
from its row alone. For the others the bodies of shared chunks are joined by digest and laid out in order. What moves
between executors are digests and shared chunks, never the corpus.

The stored form depends on the payload alone, whoever owns its chunks. Restored payloads are checked chunk by chunk
against the digests of the list read back, and whole against the digest of the original; a difference raises.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import measured, only_ids, rows_of, stored, without_ids

LEAST, MOST, MASK, UNIT = 512, 8192, np.uint32(0xFFE0), 64
_GEAR = np.random.Generator(np.random.PCG64(64)).integers(0, 1 << 32, 256, np.uint32)


def payload(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\0" * (-len(data) % UNIT if data else UNIT), len(data)


def cuts(data: bytes) -> list[int]:
    """The ends of the chunks. The hash of a place takes in its last 16 bytes, put together by doubling."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    ends, start, n = [], 0, len(data)
    for end in (np.flatnonzero((h & MASK) == 0) + 1).tolist():
        while end - start > MOST:
            start += MOST
            ends.append(start)
        if end - start >= LEAST:
            ends.append(start := end)
    while n - start > MOST:
        start += MOST
        ends.append(start)
    return ends if start == n else [*ends, n]


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def chunk_list(parts: list[bytes]) -> bytes:
    """The stored form: a mark, the number of chunks, and of each its digest and length."""
    return b"".join([b"CHNK", struct.pack("<I", len(parts)), *[hashlib.sha256(c).digest() + struct.pack("<I", len(c)) for c in parts]])


def listed(form: bytes) -> list[tuple[bytes, int]]:
    """The digests and lengths in a stored form."""
    mark, n = struct.unpack_from("<4sI", form)
    if mark != b"CHNK" or len(form) != 8 + 36 * n:
        raise ValueError("not a chunk list")
    return list(struct.iter_unpack("<32sI", form[8:]))


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, row and the digests of its chunks in order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[hashlib.sha256(c).digest() for c in chunks(payload(t.as_py())[0])] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(found, pa.list_(pa.binary()))], ["doc_id", "row", "digests"])

    return docs.mapInArrow(read, "doc_id long, row long, digests array<binary>")


STORE = "doc_id long, row long, n_bytes long, payload_sha256 string, form binary, missing array<int>, bodies binary"
KEY = ["doc_id", "row"]


def _same(ids: str, rows: str) -> list:
    return [F.col("doc_id") == F.col(ids), F.col("row") == F.col(rows)]


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """docs (doc_id, text, row) -> (the store; refs: doc_id, row, seq, digest of chunks that another document owns; lent: id, id_row and the places of the chunks that it owns for others; how many lend)."""
    found = stored(recipes(docs.where("doc_id IS NOT NULL")))
    refs = found.select(*KEY, F.posexplode("digests").alias("seq", "digest"))
    at = F.struct("doc_id", "row", "seq")
    owners = stored(refs.groupBy(F.col("digest").alias("of")).agg(F.min(at).alias("owner"), F.count("*").alias("n")).where("n > 1"))
    others = stored(refs.join(owners, F.col("digest") == F.col("of")).where(at != F.col("owner")).select(*KEY, "seq", "digest"))
    missing, lacking = measured(others.groupBy(F.col("doc_id").alias("id"), F.col("row").alias("id_row")).agg(F.collect_set("seq").alias("missing")), n=F.count("*"))
    lent, lending = measured(owners.groupBy(F.col("owner.doc_id").alias("id"), F.col("owner.row").alias("id_row")).agg(F.collect_set("owner.seq").alias("lent")), n=F.count("*"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, row, text, lacks in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("text"), batch.column("missing").to_pylist(), strict=True):
                data, n = payload(text.as_py())
                parts, lacks = chunks(data), set(lacks or ())
                rows.append((doc_id, row, n, hashlib.sha256(data).hexdigest(), chunk_list(parts), sorted(lacks), b"".join(c for i, c in enumerate(parts) if i not in lacks)))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.binary())
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "row", "n_bytes", "payload_sha256", "form", "missing", "bodies"])

    read = [*KEY, "text", "missing"]
    whole = without_ids(docs, KEY, missing, n=lacking["n"]).withColumn("missing", F.lit(None).cast("array<int>"))
    partly = only_ids(docs, KEY, missing, n=lacking["n"]).join(missing.hint("merge"), _same("id", "id_row"))
    return stored(whole.select(read).unionByName(partly.select(read)).mapInArrow(write, STORE)), others, lent, lending["n"]


def restore(rows: DataFrame, others: DataFrame, lent: DataFrame, n_lent: int) -> DataFrame:
    """The store's rows with column `found`: (seq, body) of the chunks that they lack. Only documents that lend chunks move."""
    own = F.size("missing") == 0
    lenders = only_ids(rows, KEY, lent, n=n_lent).join(lent.hint("merge"), _same("id", "id_row"))  # lists of places have no bound, so they are never broadcast
    bodies = lenders.select("form", "missing", "lent", "bodies").mapInArrow(_bodies, "digest binary, body binary")
    bodies = stored(bodies.dropDuplicates(["digest"]).select(F.col("digest").alias("of"), "body"))  # rows may repeat
    found = others.distinct().join(bodies, F.col("digest") == F.col("of")).groupBy(F.col("doc_id").alias("id"), F.col("row").alias("id_row")).agg(F.collect_list(F.struct("seq", "body")).alias("found"))
    none = F.lit(None).cast("array<struct<seq:int,body:binary>>")
    return rows.where(own).withColumn("found", none).unionByName(rows.where(~own).join(found.hint("merge"), _same("id", "id_row")).drop("id", "id_row"))


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lent chunks of documents."""
    for batch in batches:
        digests, bodies = [], []
        for row in batch.to_pylist():
            lacks, lent, at = set(row["missing"]), set(row["lent"]), 0
            for i, (digest, length) in enumerate(listed(row["form"])):
                if i not in lacks:
                    if i in lent:
                        digests.append(digest)
                        bodies.append(row["bodies"][at : at + length])
                    at += length
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(bodies, pa.binary())], ["digest", "body"])


def feature(samples: np.ndarray, n_chunks: int) -> str:
    """Chunks, mean, root mean square and entropy of the samples, and how often they cross 128."""
    counts = np.bincount(samples, minlength=256)
    n = len(samples)
    values = np.arange(256)
    p = counts[counts > 0] / n
    cross = int(np.count_nonzero(np.diff(samples >= 128)))
    return f"chunks={n_chunks};mean={(counts @ values) / n:.4f};rms={np.sqrt((counts @ values**2) / n):.4f};entropy={-(p @ np.log2(p)):.4f};crossings={cross}"


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_payload: bool = False) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; with_payload adds payload.

    The payload's values are of the bytes read back from the store, those of the media of the stored form read back. Null and
    empty texts are 64 zero bytes. Rows with a null id own all their chunks. Rows of one id are documents of their own, each by its
    text; rows that repeat id and text share one entry and each give a row. An empty table gives none.
    """
    rows, others, lent, n_lent = store(rows_of(docs, id_col, text_col))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                lacking, parts, at = {x["seq"]: x["body"] for x in row["found"] or ()}, [], 0
                for i, (digest, length) in enumerate(listed(row["form"])):
                    if (part := lacking.get(i)) is None:
                        part = row["bodies"][at : at + length]
                        at += length
                    if hashlib.sha256(part).digest() != digest:
                        raise ValueError(f"chunk {i} of document {row['doc_id']} is not what was stored")
                    parts.append(part)
                data = b"".join(parts)
                sha = hashlib.sha256(data).hexdigest()
                if sha != row["payload_sha256"]:
                    raise ValueError(f"document {row['doc_id']} was not restored as stored")
                out.append((row["doc_id"], row["n_bytes"], len(data), sha, zlib.crc32(data[-UNIT:]), len(row["form"]), hashlib.sha256(row["form"]).hexdigest(), feature(np.frombuffer(data, np.uint8), len(parts)), data if with_payload else None))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            columns = list(zip(*out, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "payload"]
    out = restore(rows, others, lent, n_lent).mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, payload binary")
    return out if with_payload else out.drop("payload")

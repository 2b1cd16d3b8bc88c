"""Samples of WAV files by byte ranges, and datasets of a WAV for each chunk with a manifest.

Files are reached through Arrow's file systems, so a path may be local or a URI of a store. Only the ranges asked for are read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

RATE = 16_000


class Format(NamedTuple):
    start: int  # of the samples in the file
    frames: int
    channels: int
    width: int  # bytes of a sample
    rate: int


def header(read) -> Format:
    """The format of a RIFF file of plain samples; read(at, n) gives n bytes from a place on. Anything else fails."""
    riff, _, wave = struct.unpack("<4sI4s", read(0, 12).ljust(12, b"\0"))
    if (riff, wave) != (b"RIFF", b"WAVE"):
        raise ValueError("not a WAV file")
    at, form = 12, None
    while len(head := read(at, 8)) == 8:
        kind, size = struct.unpack("<4sI", head)
        if kind == b"fmt ":
            tag, channels, rate, _, block, bits = struct.unpack("<HHIIHH", read(at + 8, 16))
            if tag not in (1, 0xFFFE) or block != channels * bits // 8 or not block:
                raise ValueError("not plain samples")
            form = (channels, bits // 8, rate, block)
        elif kind == b"data":
            if not form:
                break
            return Format(at + 8, size // form[3], *form[:3])
        at += 8 + size + size % 2
    raise ValueError("a WAV file without samples")


def wav(pcm: bytes, channels: int = 1, width: int = 2, rate: int = RATE) -> bytes:
    block = channels * width
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(pcm) + len(pcm) % 2, b"WAVE", b"fmt ", 16, 1, channels, rate, rate * block, block, 8 * width, b"data", len(pcm))
    return head + pcm + b"\0" * (len(pcm) % 2)


def _opened(path: str):
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(at)


def regions(wanted: DataFrame, together: int = 1 << 24) -> DataFrame:
    """wanted (path, start, end in frames, and other columns) with pcm, the bytes of those frames. A range that isn't in its file fails.

    Ranges of one file are dealt out by where they start, `together` frames a task, so that a long file is read by many.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file, form = None, None, None
        for batch in batches:
            out = []
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
                if path != name:
                    name, file = path, _opened(path)
                    form = header(lambda at, n, f=file: f.read_at(n, at))
                if not 0 <= start <= end <= form.frames:
                    raise ValueError(f"{path}: frames {start} to {end} of {form.frames}")
                block = form.channels * form.width
                pcm = file.read_at((end - start) * block, form.start + start * block)
                if len(pcm) < (end - start) * block:
                    raise ValueError(f"{path}: ends before frame {end}")
                out.append(pcm)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "pcm"])

    dealt = wanted.repartition("path", F.floor(F.col("start") / together)).sortWithinPartitions("path", "start")
    return dealt.mapInArrow(read, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema), "pcm binary"]))


def dataset(chunks: DataFrame, folder: str, test: list[str] = (), keep_fillers: bool = True) -> tuple[DataFrame, DataFrame]:
    """Writes folder/audio/<name>.wav for each eligible chunk and folder/manifest; returns (manifest, reasons (reason, chunks)).

    chunks: audio_hash, workspace_id, chunk, eligible, reasons, path, regions (array of start, end in frames), covered (array of those that its spans cover), texts and
    machine_texts of its spans, revision_ids, origins, source_backend. A chunk whose spans don't cover its regions is left out for the reason `span coverage`. Files have
    names of their own chunk and come in by renaming, so a task that is done again leaves the same.
    """
    covers = F.col("covered").eqNullSafe(F.col("regions"))
    use = F.col("eligible") & covers
    reasons = F.when(~F.col("eligible"), F.array_distinct("reasons")).when(~covers, F.array(F.lit("span coverage")))
    out_of = chunks.where(~use).select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("chunks"))
    said = lambda c: (F.trim if keep_fillers else tx.without_fillers)(F.regexp_replace(F.array_join(c, " "), r"(?U)\s+", " "))
    rows = chunks.where(use).select("audio_hash", "workspace_id", "chunk", "path", "regions", said("texts").alias("text"), said("machine_texts").alias("machine_text"), "revision_ids", "origins", "source_backend")
    name = F.concat(F.substring("audio_hash", 1, 16), F.lit("_"), F.lpad(F.col("chunk").cast("string"), 5, "0"), F.lit(".wav"))
    rows = rows.withColumns({"audio": F.concat(F.lit("audio/"), name), "split": F.when(F.col("audio_hash").isin(list(test)), "test").otherwise("train")})
    wanted = rows.select("audio", "path", F.posexplode("regions").alias("nth", "r")).select("audio", "path", "nth", "r.start", "r.end")
    parts = F.sort_array(F.collect_list(F.struct("nth", "pcm")))  # the regions of one chunk: half a minute of sound
    sound = regions(wanted).groupBy(F.col("audio").alias("a")).agg(F.transform(parts, lambda p: p["pcm"]).alias("pcm"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        fs.create_dir(f"{root}/audio", recursive=True)
        for batch in batches:
            seconds = []
            for audio, pcm in zip(batch.column("a").to_pylist(), batch.column("pcm").to_pylist(), strict=True):
                body, draft = b"".join(pcm), f"{root}/audio/.{uuid.uuid4().hex}"
                with fs.open_output_stream(draft) as f:
                    f.write(wav(body))
                fs.move(draft, f"{root}/{audio}")
                seconds.append(round(len(body) / 2 / RATE, 3))
            yield pa.RecordBatch.from_arrays([batch.column("a"), pa.array(seconds, pa.float64())], ["a", "duration"])

    written = sound.mapInArrow(write, "a string, duration double")
    manifest = rows.join(written, F.col("audio") == F.col("a")).drop("a", "path", "regions")
    manifest.write.mode("overwrite").json(f"{folder}/manifest")
    return rows.sparkSession.read.schema(manifest.schema).json(f"{folder}/manifest"), out_of

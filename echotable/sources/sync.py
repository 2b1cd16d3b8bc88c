"""A table of chunks that follows its sources: only what changed is made anew, staged, checked and then cut over to.

Under a root lie `parts/<id>/chunks`, `parts/<id>/state` and `parts/<id>/found` (what a run found to do), which never change once written, and `log`, whose entries say which parts make up a
version. A part's state has a row for each hash it says something about: its fingerprint and how many chunks it has, or that it is gone. The newest part that
speaks of a hash holds all there is of it. A version is there when its log entry is; whatever a run that died left behind is in no entry and
so in no version. A batch that is run again under its name finds itself in the log and changes nothing. There is one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMPACT_AT = 20  # parts


def entry(spark: SparkSession, root: str) -> dict | None:
    """The newest log entry: version, settings, parts (oldest first), batches, report; None where there is none."""
    try:
        rows = spark.read.text(f"{root}/log").select(F.get_json_object("value", "$.version").cast("long").alias("v"), "value")
        newest = rows.orderBy(F.desc("v")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return json.loads(newest["value"]) if newest else None


def _append(spark: SparkSession, root: str, said: dict) -> None:
    spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.mode("append").text(f"{root}/log")  # one file, seen when it's renamed


def state(spark: SparkSession, root: str, parts: list[str], gone: bool = False) -> DataFrame:
    """audio_hash, fingerprint, chunk_count, seq of each hash by the newest part that speaks of it; with gone, those that are gone as well."""
    each = [spark.read.parquet(f"{root}/parts/{p}/state").withColumn("seq", F.lit(i).cast("long")) for i, p in enumerate(parts)]
    every = reduce(DataFrame.unionByName, each)
    newest = every.groupBy("audio_hash").agg(*[F.max_by(c, "seq").alias(c) for c in ("fingerprint", "chunk_count", "deleted")], F.max("seq").alias("seq"))
    return newest if gone else newest.where("NOT deleted").drop("deleted")


def packed(key: Column) -> Column:
    """A key as bytes that go through a shuffle in its place: a hexadecimal one (lower case, whole bytes) takes half its length. Different keys have different bytes."""
    raw = F.unhex(key)
    return F.when(F.lower(F.hex(raw)) == key, F.concat(F.lit(b"\1"), raw)).otherwise(F.concat(F.lit(b"\0"), key.cast("binary")))


def unpacked(key: Column) -> Column:
    """The key that packed made bytes of."""
    rest = F.substring(key, 2, 2**31 - 1)
    return F.when(F.substring(key, 1, 1) == F.lit(b"\1"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def _state(spark: SparkSession, root: str, parts: list[str]) -> DataFrame:
    """State rows, those that are gone as well, with the packed hash for a key."""
    each = [spark.read.parquet(f"{root}/parts/{p}/state").withColumn("seq", F.lit(i).cast("long")) for i, p in enumerate(parts)]
    every = reduce(DataFrame.unionByName, each).withColumn("key", packed(F.col("audio_hash"))).drop("audio_hash")
    return every.groupBy("key").agg(*[F.max_by(c, "seq").alias(c) for c in ("fingerprint", "chunk_count", "deleted")], F.max("seq").alias("seq"))


def state(spark: SparkSession, root: str, parts: list[str], gone: bool = False) -> DataFrame:
    """audio_hash, fingerprint, chunk_count, seq of each hash by the newest part that speaks of it; with gone, those that are gone as well."""
    newest = _state(spark, root, parts).select(unpacked(F.col("key")).alias("audio_hash"), "fingerprint", "chunk_count", "deleted", "seq")
    return newest if gone else newest.where("NOT deleted").drop("deleted")


def live(spark: SparkSession, root: str) -> DataFrame:
    """The chunks of the newest version: all of the newest part, and of each other part those of hashes that no newer part speaks of."""
    parts = entry(spark, root)["parts"]
    out = None
    for i, p in enumerate(parts):
        rows = spark.read.parquet(f"{root}/parts/{p}/chunks")
        if newer := parts[i + 1 :]:
            said = reduce(DataFrame.union, [spark.read.parquet(f"{root}/parts/{n}/state").select(packed(F.col("audio_hash")).alias("__said")) for n in newer])
            names = rows.columns
            rows = rows.withColumn("__key", packed(F.col("audio_hash"))).drop("audio_hash").join(said, F.col("__key") == F.col("__said"), "left_anti")
            rows = rows.withColumn("audio_hash", unpacked(F.col("__key"))).select(*names)
        out = rows if out is None else out.unionByName(rows)
    return out


def classified(sources: DataFrame, previous: DataFrame | None, force: bool = False, target: str | None = None) -> DataFrame:
    """Sources beside what is known of them: audio_hash, fingerprint, change (added, updated, removed or unchanged), times (how often the hash stands in sources), was_count (chunks so far), source (the row).

    With a target the others are left out, but for hashes that stand there twice; force makes what is unchanged updated. Sources go through one shuffle.
    """
    rest = [c for c in sources.columns if c not in ("audio_hash", "fingerprint")]
    now = sources.select(packed(F.col("audio_hash")).alias("key"), F.col("fingerprint").alias("now"), F.struct(F.lit(True).alias("there"), *rest).alias("source"))
    now = now.withColumn("times", F.count("*").over(Window.partitionBy("key")))
    if previous is None:
        j = now.withColumns({"was": F.lit(None).cast("string"), "was_count": F.lit(None).cast("long"), "known": F.lit(None).cast("boolean")})
    else:
        j = now.join(previous.select("key", F.col("fingerprint").alias("was"), F.col("chunk_count").alias("was_count"), F.lit(True).alias("known")), "key", "full_outer")
    change = F.when(F.col("source").isNull(), "removed").when(F.col("known").isNull(), "added").when(F.lit(force) | ~F.col("now").eqNullSafe(F.col("was")), "updated").otherwise("unchanged")
    out = j.select(unpacked(F.col("key")).alias("audio_hash"), F.col("now").alias("fingerprint"), change.alias("change"), F.coalesce("times", F.lit(0)).cast("long").alias("times"), "was_count", "source")
    return out if target is None else out.where((F.col("audio_hash") == target) | (F.col("times") > 1) | F.col("audio_hash").isNull())


def _reason(known: dict | None, settings: str, rebuild: bool, some: Callable[[], bool]) -> str | None:
    """Why everything has to be made anew; None where it doesn't."""
    if known is None:
        return "bootstrap: nothing is there"
    if rebuild:
        return "rebuild: asked for"
    if known["settings"] != settings:
        return "rebuild: other settings"
    if known["chunks"] == 0 and some():
        return "rebuild: no chunks but sources"
    return None


def sync(spark: SparkSession, root: str, sources: DataFrame, chunks_of: Callable[[DataFrame], DataFrame], settings: str, batch: str, rebuild: bool = False, force: bool = False, target: str | None = None) -> dict:
    """Brings the table to its sources and returns what was done.

    sources: audio_hash, fingerprint and what chunks_of needs; a hash that stands there twice is refused. chunks_of makes chunks
    (audio_hash, chunk_id, ...) from rows of sources. settings: a fingerprint of how chunks are made. batch: a name; one that the log has is not done again.
    target: a hash to which an incremental run is confined. A source without chunks is kept in the state with none.
    """
    known = entry(spark, root)
    if known and batch in known["batches"]:
        return known["batches"][batch]
    reason = _reason(known, settings, rebuild, lambda: bool(sources.take(1)))
    anew = reason is not None
    part = uuid.uuid4().hex
    at = f"{root}/parts/{part}"
    previous = _state(spark, root, known["parts"]).where("NOT deleted") if known else None
    found = classified(sources, previous, force, None if anew else target)
    # written once; of rows that stay as they are only the change is kept
    kept = F.lit(anew) | (F.col("change") != "unchanged") | (F.col("times") > 1) | F.col("audio_hash").isNull()
    found = found.select("change", "times", F.col("audio_hash").isNull().alias("nameless"), *[F.when(kept, F.col(c)).alias(c) for c in ("audio_hash", "fingerprint", "was_count", "source")])
    found.write.option("compression", "zstd").parquet(f"{at}/found")
    found = spark.read.schema(found.schema).parquet(f"{at}/found")
    twice = found.where("times > 1 OR nameless").take(1)
    if twice:
        raise ValueError(f"a source hash that isn't one: {twice[0]['audio_hash']}")
    counts = {r["change"]: (r["n"], r["chunks"]) for r in found.groupBy("change").agg(F.count("*").alias("n"), F.coalesce(F.sum("was_count"), F.lit(0)).alias("chunks")).collect()}  # four rows at most
    report = {"mode": reason or ("forced" if force else "incremental"), **{c: counts.get(c, (0, 0))[0] for c in ("added", "updated", "removed", "unchanged")}, "inserted": 0, "deleted": 0}
    if not anew and not sum(report[c] for c in ("added", "updated", "removed")):
        return report
    wanted = found.where("change <> 'removed'") if anew else found.where("change IN ('added', 'updated')")
    made = chunks_of(wanted.select(*[c if c in ("audio_hash", "fingerprint") else F.col("source")[c].alias(c) for c in sources.columns]))
    made.sortWithinPartitions("audio_hash").write.option("compression", "zstd").parquet(f"{at}/chunks")  # chunks of a source lie together, so that its hash takes little room
    staged = spark.read.parquet(f"{at}/chunks")
    n = staged.groupBy(packed(F.col("audio_hash")).alias("k")).agg(F.count("*").alias("n"))
    said = wanted.select(packed(F.col("audio_hash")).alias("key"), "fingerprint", F.lit(False).alias("deleted")).join(n, F.col("key") == F.col("k"), "full_outer")
    said = said.select(unpacked(F.coalesce("key", "k")).alias("audio_hash"), "fingerprint", F.coalesce("n", F.lit(0)).cast("long").alias("chunk_count"), "deleted")  # chunks of no source: neither deleted nor not
    gone = found.where("change = 'removed'").select("audio_hash", F.lit(None).cast("string").alias("fingerprint"), F.lit(0).cast("long").alias("chunk_count"), F.lit(True).alias("deleted"))
    said.unionByName(gone).write.option("compression", "zstd").parquet(f"{at}/state")
    report["inserted"] = check(spark, at)
    parts = [part] if anew else [*known["parts"], part]
    report["deleted"] = sum(c for _, c in counts.values())
    batches = {**(known["batches"] if known else {}), batch: report}
    total = report["inserted"] if anew else known["chunks"] + report["inserted"] - report["deleted"]
    _append(spark, root, {"version": (known["version"] if known else 0) + 1, "settings": settings, "parts": parts, "chunks": total, "batches": dict(list(batches.items())[-100:])})
    if len(parts) >= COMPACT_AT:
        compact(spark, root)
    return report


def check(spark: SparkSession, at: str, recount: bool = False) -> int:
    """How many chunks a staged part has. Raises where it contradicts itself: chunks of no source, counts that differ (in all; with recount those of each hash), ids that repeat."""
    chunks, said = spark.read.parquet(f"{at}/chunks"), spark.read.parquet(f"{at}/state")
    n = chunks.count()
    off = said.where("deleted IS NULL").take(1)
    if recount and not off:
        of = chunks.groupBy("audio_hash").agg(F.count("*").alias("n"))
        off = said.where("NOT deleted").join(of, "audio_hash", "full_outer").where("chunk_count IS NULL OR chunk_count <> coalesce(n, 0)").take(1)
    total = said.where("NOT deleted").agg(F.coalesce(F.sum("chunk_count"), F.lit(0))).first()[0]
    twice = chunks.groupBy("chunk_id").count().where("count > 1").take(1)
    if off or twice:
        raise ValueError(f"the staged part is wrong: {(off or twice)[0]}")
    if total != n:
        raise ValueError(f"the staged part is wrong: {n} chunks where its state has {total}")
    return n


def compact(spark: SparkSession, root: str) -> None:
    """The newest version as one part; the parts before stay where they are for readers that still have them open."""
    known = entry(spark, root)
    part = uuid.uuid4().hex
    live(spark, root).write.parquet(f"{root}/parts/{part}/chunks")
    state(spark, root, known["parts"]).select("audio_hash", "fingerprint", "chunk_count", F.lit(False).alias("deleted")).write.parquet(f"{root}/parts/{part}/state")
    check(spark, f"{root}/parts/{part}", recount=True)
    _append(spark, root, {**known, "version": known["version"] + 1, "parts": [part]})


def follow(stream: DataFrame, root: str, chunks_of: Callable[[DataFrame], DataFrame], settings: str, checkpoint: str):
    """A stream of sources (audio_hash, fingerprint, at, ..., gone): each micro-batch replaces its hashes, of several rows of one the latest; those marked gone are removed.

    A micro-batch that is repeated after a failure has its number for a name and so isn't done twice.
    """

    def one(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        others = [c for c in rows.columns if c != "audio_hash"]
        latest = rows.where("audio_hash IS NOT NULL").groupBy("audio_hash").agg(F.max_by(F.struct(*others), "at").alias("row")).select("audio_hash", "row.*").persist()
        known = entry(spark, root)
        untouched = latest.where("NOT gone")
        if known:  # hashes of earlier batches stay: they are given as they are
            now = state(spark, root, known["parts"]).select("audio_hash", F.col("fingerprint").alias("kept")).join(latest.select("audio_hash"), "audio_hash", "left_anti")
            untouched = untouched.unionByName(now.select("audio_hash", F.col("kept").alias("fingerprint")), allowMissingColumns=True)
        sync(spark, root, untouched, chunks_of, settings, f"stream {number}")
        latest.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

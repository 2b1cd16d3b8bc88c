"""Catalogs of recordings keyed by hash: merge, projection, coverage, duplicates, reconciliation, plans.

Joins are equi-joins on the hash; Spark chooses broadcast or sort-merge by the size it finds. Nothing is deleted:
commands that would delete give plans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.sinks import stored


def present(c: str | Column) -> Column:
    """The trimmed text, or null where it is blank."""
    return F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit(""))


def first_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def merge(target: DataFrame, source: DataFrame, order: list[Column]) -> DataFrame:
    """target with the source rows whose hash it lacks; blank hashes drop out, the first source row of a hash wins."""
    new = source.where(present("hash").isNotNull()).join(target.select("hash"), "hash", "left_anti")
    return target.unionByName(first_per_key(new, "hash", *order), allowMissingColumns=True)


def project(metadata: DataFrame, archived: DataFrame) -> DataFrame:
    """A row for each hash in either catalog; fields of the metadata come first; actionable where it stands in both."""
    m, a = (df.select("hash", *[F.col(c).alias(f"{c}_{x}") for c in df.columns if c != "hash"], F.lit(True).alias(f"in_{x}")) for df, x in ((metadata, "m"), (archived, "a")))
    both = m.join(a, "hash", "full_outer")
    shared = [c for c in metadata.columns if c != "hash" and c in archived.columns]
    return both.select("hash", *[F.coalesce(f"{c}_m", f"{c}_a").alias(c) for c in shared], (F.col("in_m").isNotNull() & F.col("in_a").isNotNull()).alias("is_actionable"))


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only: (key, side)."""
    missing = left.select(key).distinct().join(right.select(key), key, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(right.select(key).distinct().join(left.select(key), key, "left_anti").withColumn("side", F.lit("stale")))


def classify(current: DataFrame, previous: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """added, updated, removed or unchanged, by key."""
    c, p = (df.select(F.col(key), F.col(fingerprint).alias(x)) for df, x in ((current, "now"), (previous, "was")))
    j = c.join(p, key, "full_outer")
    return j.select(key, F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("was"), "updated").otherwise("unchanged").alias("change"))


def replace_by_key(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """table with all rows of new's keys replaced by new's rows."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def duplicates(df: DataFrame, key: str, size: str) -> DataFrame:
    """Groups of more than one file: how many, and what all but one take up."""
    return df.groupBy(key).agg(F.count("*").alias("files"), F.max(size).alias("size")).where("files > 1").select(key, "files", (F.col("size") * (F.col("files") - 1)).alias("savings"))


def reconcile(sources: dict[str, DataFrame], tolerance: float) -> DataFrame:
    """Seconds of each hash by source (hash, seconds): sources, spread, and whether two or more differ by over the tolerance."""
    parts = [df.select("hash", F.lit(name).alias("source"), "seconds") for name, df in sources.items()]
    rows = reduce(DataFrame.unionByName, parts).where("seconds > 0")
    out = rows.groupBy("hash").agg(F.count("*").alias("n"), F.min("seconds").alias("least"), F.max("seconds").alias("most"))
    return out.withColumn("differs", (F.col("n") >= 2) & (F.col("most") - F.col("least") > tolerance))


def chain(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """Counts of hashes through stages: of each stage how many, missing from the one before, orphaned."""
    out = []
    for (_, before), (name, now) in zip(stages, stages[1:], strict=False):
        b, n = before.select("hash").distinct().withColumn("b", F.lit(1)), now.select("hash").distinct().withColumn("n", F.lit(1))
        out.append(b.join(n, "hash", "full_outer").agg(F.count("n").alias("present"), F.count(F.when(F.col("n").isNull(), 1)).alias("missing"), F.count(F.when(F.col("b").isNull(), 1)).alias("orphans")).select(F.lit(name).alias("stage"), "present", "missing", "orphans"))
    return reduce(DataFrame.unionByName, out)


def removal_plan(entries: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """What removing entries would do: files that another catalog lists stay and are named shared."""
    o = others.select(key).distinct().withColumn("__other", F.lit(True))
    return entries.join(o, key, "left").withColumn("action", F.when(F.col("__other"), "keep_shared").otherwise("remove")).drop("__other")


def elect(links: DataFrame, live: DataFrame, group: str, member: str, order: list[Column]) -> DataFrame:
    """Links without an entry go; a group whose primary went elects its first remaining member."""
    left = links.join(live.select(member), member, "left_semi")
    w = Window.partitionBy(group)
    has = F.max(F.col("is_primary").cast("int")).over(w)
    nth = F.row_number().over(w.orderBy(*order))
    return left.withColumn("__has", has).withColumn("__nth", nth).withColumn("is_primary", F.when(F.col("__has") == 1, F.col("is_primary")).otherwise(F.col("__nth") == 1)).drop("__has", "__nth")


def fingerprint(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, fingerprint: SHA-256 of the sorted rows of each key as JSON, by line.

    A digest reads its rows one after the other, so a key is one task's work; it holds one row at a time, Spark sorts them.
    """
    rows = df.select(*keys, F.to_json(F.struct(*columns)).alias("__row"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done = []
            for *now, row in zip(*(batch.column(c).to_pylist() for c in [*keys, "__row"]), strict=True):
                if digest is None or now != key:
                    if digest is not None:
                        done.append([*key, digest.hexdigest()])
                    key, digest = now, hashlib.sha256(row.encode())
                else:
                    digest.update(b"\n" + row.encode())
            yield told(done)
        if digest is not None:
            yield told([[*key, digest.hexdigest()]])

    kinds = to_arrow_schema(T.StructType([rows.schema[k] for k in keys]))
    told = lambda done: pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate([*kinds.types, pa.string()])], [*keys, "fingerprint"])
    out = T.StructType([*[rows.schema[k] for k in keys], T.StructField("fingerprint", T.StringType())])
    return rows.repartition(*keys).sortWithinPartitions(*keys, "__row").mapInArrow(read, out)


def seconds_of(text: Column) -> Column:
    """HH:MM:SS as seconds; other text gives null."""
    p = F.regexp_extract
    form = r"^(\d+):(\d{1,2}):(\d{1,2}(?:\.\d+)?)$"
    whole = p(text, form, 1).try_cast("double") * 3600 + p(text, form, 2).try_cast("double") * 60 + p(text, form, 3).try_cast("double")
    return F.when(text.rlike(form), whole)


def partial_date(year: Column, month: Column, day: Column) -> Column:
    """A sort key of a date whose month or day may be unknown."""
    return year * 10000 + F.coalesce(month, F.lit(0)) * 100 + F.coalesce(day, F.lit(0))


def filtered(df: DataFrame, **want) -> DataFrame:
    """Optional filters: status, artist (contains, any case; "" for none), seconds bucket, and a date narrowed by year, then month, then day."""
    if (s := want.get("status")) is not None:
        df = df.where(F.col("status") == s)
    if (a := want.get("artist")) is not None:
        df = df.where(present("artist").isNull()) if a == "" else df.where(F.lower("artist").contains(a.lower()))
    if b := want.get("bucket"):
        lo, hi = {"short": (0, 1800), "medium": (1800, 3600), "long": (3600, None)}[b]
        df = df.where(F.col("seconds") >= lo)
        df = df if hi is None else df.where(F.col("seconds") < hi)
    for part, outer in (("year", None), ("month", "year"), ("day", "month")):
        if want.get(part) is not None and (outer is None or want.get(outer) is not None):
            df = df.where(F.col(part) == want[part])
    return df


def keyset_page(df: DataFrame, order: list[tuple[str, bool]], after: tuple | None, limit: int) -> DataFrame:
    """The next `limit` rows after a key, in order of (column, ascending); one more row tells that there are more."""
    if after is not None:
        cond, equal = F.lit(False), F.lit(True)
        for (c, up), v in zip(order, after, strict=True):
            cond = cond | (equal & ((F.col(c) > v) if up else (F.col(c) < v)))
            equal = equal & (F.col(c) == v)
        df = df.where(cond)
    return df.orderBy(*[F.col(c).asc() if up else F.col(c).desc_nulls_last() for c, up in order]).limit(limit + 1)


def uniform_sample(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """k of the n rows, evenly spaced, first and last among them. Row numbers come from counts of buckets, not from one task."""
    rows = numbered(df, order)
    n = rows.agg(F.count("*")).first()[0]
    if n <= k:
        return rows
    want = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * ((n - 1) / max(k - 1, 1))).cast("long")))
    return rows.join(F.broadcast(df.sparkSession.range(1).select(F.explode(want).alias("nth"))), "nth")  # k rows


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with nth, its place from 0 in the order.

    Rows are dealt to ranges of the order and sorted there, with their place inside; they are written before ranges are counted, so that counts and
    rows are of the same ranges. Rows that are equal in the order are numbered in any order.
    """
    inside = (1 << 33) - 1  # an increasing id has the partition above these bits and the place in it below
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit(inside))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    base = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")).select("__part", before.alias("__before"))
    return placed.join(F.broadcast(base), part == F.col("__part")).withColumn("nth", (F.col("__before") + place).cast("long")).drop("__id", "__part", "__before")


def batches(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """df with batch: rows 0 to size - 1 of the order are batch 0, and so on; the last one may be smaller."""
    return numbered(df, order).withColumn("batch", F.floor(F.col("nth") / size)).drop("nth")


def nested(parents: DataFrame, children: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """parents with `items`, the JSON array of their children's columns in order; an empty one for a parent without. The children of one parent are put together in one task."""
    one = F.struct(F.col(order).alias("__o"), F.struct(*columns).alias("c"))
    c = children.select(F.col(key).alias("__k"), one.alias("__c")).groupBy("__k").agg(F.to_json(F.transform(F.sort_array(F.collect_list("__c")), lambda x: x["c"])).alias("items"))
    return parents.join(c, F.col(key) == F.col("__k"), "left").drop("__k").withColumn("items", F.coalesce("items", F.lit("[]")))

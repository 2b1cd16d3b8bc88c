"""Validation of diarization files and rollups of validation results. Every fault is a row that names its file and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLACE = r"/([^/]+)/([^/]+)/speakers\.json$"


def diarization_files(spark: SparkSession, root: str) -> DataFrame:
    """path, backend, recording, body of <backend>/<recording>/speakers.json under root. A body that isn't UTF-8 is null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "speakers.json").load(root)
    rows = files.where(F.col("path").rlike(PLACE))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return rows.select("path", F.regexp_extract("path", PLACE, 1).alias("backend"), F.regexp_extract("path", PLACE, 2).alias("recording"), text.alias("body"))


def loaded(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (path, ..., body) -> (files with `doc`, a variant; errors (path, error)): a file is read if it is JSON and has audio_file and segments."""
    v = files.withColumn("doc", F.try_parse_json("body"))
    has = lambda name: F.expr(f"is_variant_null(variant_get(doc, '$.{name}', 'variant')) IS NOT NULL AND variant_get(doc, '$.{name}', 'variant') IS NOT NULL")
    error = F.when(F.col("doc").isNull(), "invalid JSON").when(~has("audio_file"), "missing audio_file").when(~has("segments"), "missing segments")
    v = v.withColumn("error", error)
    return v.where("error IS NULL").drop("error", "body"), v.where("error IS NOT NULL").select("path", "error")


def _kind(name: str) -> Column:
    return F.coalesce(F.expr(f"schema_of_variant(variant_get(element, '$.{name}', 'variant'))"), F.lit("VOID"))


def diarization_segments(files: DataFrame) -> DataFrame:
    """Files (path, body) -> path, idx, start_sec, end_sec, speaker, fault (null if none): each element of `segments`.

    The first rule that an element breaks is its fault: it is an object; start and end are numbers; the speaker is a text that isn't blank; it ends after its
    start; and it doesn't start before the last element that kept all rules but this one.
    """
    doc = files.select("path", F.try_parse_json("body").alias("doc"))
    elements = doc.select("path", F.posexplode(F.expr("try_variant_get(doc, '$.segments', 'array<variant>')")).alias("idx", "element"))
    number = lambda k: k.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|INT|SMALLINT|TINYINT)$")
    speaker = F.expr("try_variant_get(element, '$.speaker', 'string')")
    fault = F.when(~F.coalesce(F.expr("schema_of_variant(element)").startswith("OBJECT"), F.lit(False)), "not an object").when(~number(_kind("start")), "start must be a number").when(~number(_kind("end")), "end must be a number")
    fault = fault.when((_kind("speaker") != "STRING") | (F.trim(speaker) == ""), "speaker must be a non-empty string")
    rows = elements.select("path", F.col("idx").cast("long").alias("idx"), F.expr("try_variant_get(element, '$.start', 'double')").alias("start_sec"), F.expr("try_variant_get(element, '$.end', 'double')").alias("end_sec"), F.trim(speaker).alias("speaker"), fault.alias("fault"))
    rows = rows.withColumn("fault", F.coalesce("fault", F.when(F.col("end_sec") <= F.col("start_sec"), "end must be greater than start")))
    before = Window.partitionBy("path").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    previous = F.last(F.when(F.col("fault").isNull(), F.col("start_sec")), ignorenulls=True).over(before)
    return rows.withColumn("previous", previous).withColumn("fault", F.coalesce("fault", F.when(F.col("start_sec") < F.col("previous"), "start time is out of order"))).drop("previous")


def diarization_report(files: DataFrame) -> DataFrame:
    """Files (path, backend, body) -> path, backend, status, segments, speakers, seconds, issues, message (of the first): a row for each file. Figures are those of files that passed."""
    s = diarization_segments(files)
    first = F.min_by(F.concat(F.lit("segment "), F.col("idx").cast("string"), F.lit(" "), F.col("fault")), F.when(F.col("fault").isNotNull(), F.col("idx")))
    per = s.groupBy(F.col("path").alias("p")).agg(F.count("*").alias("n"), F.countDistinct("speaker").alias("who"), F.sum(F.col("end_sec") - F.col("start_sec")).alias("sec"), F.count("fault").alias("issues"), first.alias("first"))
    j = files.select("path", "backend", F.try_parse_json("body").isNotNull().alias("json")).join(per, F.col("path") == F.col("p"), "left")
    message = F.when(~F.col("json"), "invalid JSON").when(F.col("n").isNull(), "missing segments").otherwise(F.col("first"))
    passed = message.isNull()
    figure = lambda c: F.when(passed, F.col(c))
    return j.select("path", "backend", F.when(passed, "passed").otherwise("failed").alias("status"), figure("n").alias("segments"), figure("who").alias("speakers"), figure("sec").alias("seconds"), F.coalesce("issues", F.lit(0)).alias("issues"), message.alias("message"))


def rollup(report: DataFrame, group: str, figures: list[str]) -> DataFrame:
    """A report (group, status, figures) -> group, total, passed, failed, rate (percent passed), and the sum and mean of each figure over what passed. Of no rows there is none."""
    ok = F.col("status") == "passed"
    n, good = F.count("*"), F.count(F.when(ok, 1))
    sums = [a for c in figures for a in (F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(f"{c}_total"), F.coalesce(F.sum(F.when(ok, F.col(c))) / F.nullif(good, F.lit(0)), F.lit(0.0)).alias(f"{c}_mean"))]
    return report.groupBy(group).agg(n.alias("total"), good.alias("passed"), (n - good).alias("failed"), (good / n * 100).alias("rate"), *sums)


def ranked(report: DataFrame, score: str, key: str) -> DataFrame:
    """The report in order: what failed first, then by score, lowest first and null last, then by key, with nth from 1."""
    failed = F.when(F.col("status") == "failed", 0).otherwise(1)
    return report.withColumn("__failed", failed).orderBy("__failed", F.col(score).asc_nulls_last(), key).drop("__failed")

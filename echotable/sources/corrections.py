"""Published corrections: pointers that say which transcript holds for a recording. A pointer that can't be honoured stops the read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACTIVE = ("activating", "active")  # fixed values
FIELDS = "workflow_group_id string, audio_hash string, workspace_id string, publication_id string, state string, backend string, transcript_path string, artifact_sha256 string"


def pointers(spark: SparkSession, folder: str) -> DataFrame:
    """path and FIELDS of the *.json files of a folder. A file that isn't JSON has nulls."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    read = files.select("path", F.from_json(F.col("content").cast("string"), FIELDS).alias("p"))
    return read.select("path", *[F.col(f"p.{f.split()[0]}").alias(f.split()[0]) for f in FIELDS.split(", ")])


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), content_sha256 of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    below = F.regexp_replace("path", "^.*?" + "\\Q" + folder.rstrip("/") + "\\E/", "")
    return files.select(below.alias("content_path"), F.sha2("content", 256).alias("content_sha256"))


def problem(group: str, found: Column) -> Column:
    """What is wrong with a pointer; null if nothing. `found` is the digest of the transcript that it names."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    path = F.col("transcript_path")
    checks = [
        (F.col("state").isNull() | ~F.col("state").isin(*ACTIVE), "unknown state"),
        (F.coalesce(F.col("workflow_group_id") != group, F.lit(True)), "another catalog"),
        (blank(F.col("audio_hash")) | blank(path) | blank(F.col("artifact_sha256")), "incomplete"),
        (~F.lower(F.trim("audio_hash")).rlike("^[0-9a-f]{64}$"), "not a whole hash"),
        (path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)"), "outside of the corrections"),
        (found.isNull(), "no transcript"),
        (found != F.lower(F.trim("artifact_sha256")), "other bytes"),
    ]
    out = F.lit(None).cast("string")
    for cond, name in reversed(checks):
        out = F.when(cond, name).otherwise(out)
    return out


def checked(found: DataFrame, files: DataFrame, group: str) -> DataFrame:
    """Pointers with `problem`, by the digests of the files (content_path, content_sha256)."""
    j = found.join(files, found["transcript_path"] == files["content_path"], "left")
    return j.withColumn("problem", problem(group, F.col("content_sha256"))).drop("content_path", "content_sha256")


def effective(machine: DataFrame, corrections: DataFrame) -> DataFrame:
    """audio_hash, transcript_path, origin, publication_id, artifact_sha256: machine transcripts (audio_hash, transcript_path), each replaced by the correction of its hash; corrections without one come too.

    corrections are checked pointers; one with a problem fails the read that reaches it. Of several pointers of a hash the last by path counts.
    """
    hash_of = F.when(F.col("problem").isNull(), F.lower(F.trim("audio_hash"))).otherwise(F.raise_error(F.concat(F.lit("correction pointer "), F.col("path"), F.lit(": "), F.col("problem"))).cast("string"))
    c = corrections.select(hash_of.alias("hash"), "path", "transcript_path", "publication_id", F.lower(F.trim("artifact_sha256")).alias("artifact_sha256"))
    c = c.groupBy("hash").agg(F.max_by(F.struct(F.col("transcript_path").alias("c_path"), F.coalesce("publication_id", F.lit("")).alias("publication_id"), "artifact_sha256"), "path").alias("c")).select("hash", "c.*")
    j = machine.select("audio_hash", "transcript_path").join(c, F.col("audio_hash") == F.col("hash"), "full_outer")
    return j.select(F.coalesce("audio_hash", "hash").alias("audio_hash"), F.coalesce("c_path", "transcript_path").alias("transcript_path"), F.when(F.col("hash").isNotNull(), "correction").otherwise("machine").alias("origin"), "publication_id", "artifact_sha256")

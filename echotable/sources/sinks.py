"""Sinks: versioned tables with a pointer, CSV, JSON lines, subtitle files."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; only a local session that names none gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="echotable-")
    return f"{found}/echotable-tables/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: what is built on it depends on the files alone."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def publish(df: DataFrame, root: str, version: str) -> str:
    """Writes a version and then moves the pointer to it, so that readers see the old table or the new one."""
    path = f"{root}/versions/{version}"
    df.write.mode("errorifexists").parquet(path)
    df.sparkSession.createDataFrame([(json.dumps({"version": version}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/active")
    return path


def active(spark: SparkSession, root: str) -> DataFrame:
    version = json.loads(spark.read.text(f"{root}/active").first()[0])["version"]
    return spark.read.parquet(f"{root}/versions/{version}")


def guard_rows(new: DataFrame, old: DataFrame, share: float = 0.5) -> DataFrame:
    """new; raises if it has fewer rows than this share of old's."""
    n, o = new.count(), old.count()
    if n < share * o:
        raise ValueError(f"{n} rows would replace {o}")
    return new


def csv(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("header", "true").option("escape", '"').csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def bodies(df: DataFrame, path: str, key: str = "audio_hash", body: str = "body") -> None:
    """One text row a body, by folder of its key's first two characters."""
    df.select(F.substring(key, 1, 2).alias("shelf"), F.to_json(F.struct(key, body)).alias("value")).write.mode("overwrite").partitionBy("shelf").text(path)

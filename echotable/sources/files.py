"""Scans of transcript folders, catalogs and manifests. Bad input goes to an error table or raises; it is never skipped in silence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = "struct<start:double,end:double,word:string,confidence:double>"
SEGMENT = f"struct<start:double,end:double,text:string,confidence:double,words:array<{WORD}>,speaker:string>"
TRANSCRIPT = f"meta struct<backend:string,model:string,duration:double,transcript_text:string>, segments array<{SEGMENT}>, vad_segments array<struct<start:double,end:double>>, _corrupt string"
PLACE = r"/([^/]+)/([^/]*@lang-[a-z]{2})/([a-f0-9]{64})/transcript\.json$"
HASH = "^[a-f0-9]{64}$"


def transcripts(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of <workflow>/<component@lang-xx>/<hash>/transcript.json under root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "transcript.json").load(root)
    part = lambda i: F.regexp_extract("path", PLACE, i)
    rows = files.where(F.col("path").rlike(PLACE)).select(F.concat(part(1), F.lit("/"), part(2)).alias("model_key"), part(3).alias("audio_hash"), "path", F.col("content").cast("string").alias("json"))
    parsed = rows.withColumn("t", F.from_json("json", TRANSCRIPT, {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("t").isNull() | F.col("t._corrupt").isNotNull() | F.col("t.segments").isNull()
    return parsed.where(~bad).select("model_key", "audio_hash", "path", "t.meta", "t.segments", "t.vad_segments"), parsed.where(bad).select("path", F.lit("invalid_json").alias("error"))


def chosen(records: DataFrame, backends: list[str] | None = None, prefixes: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Records of these backends whose hash starts with one of the prefixes (four characters or more)."""
    if backends:
        records = records.where(F.col("model_key").isin(backends))
    if prefixes:
        if short := [p for p in prefixes if len(p) < 4]:
            raise ValueError(f"hash prefixes need four characters: {short}")
        records = records.where(F.col("audio_hash").rlike("^(" + "|".join(prefixes) + ")"))
    return records.limit(limit) if limit is not None else records


def segments(records: DataFrame) -> DataFrame:
    s = records.select("audio_hash", "model_key", F.posexplode("segments").alias("seg_idx", "s"))
    return s.select("audio_hash", "model_key", F.col("seg_idx").cast("long").alias("seg_idx"), F.col("s.start").alias("start_sec"), F.col("s.end").alias("end_sec"), "s.text", "s.confidence", "s.words", "s.speaker")


def duration(meta: str = "meta.duration", segs: str = "segments") -> Column:
    """The stated duration if positive, else the last segment's end."""
    return F.coalesce(F.when(F.col(meta) > 0, F.col(meta)), F.array_max(F.transform(segs, lambda s: s["end"])))


def csv(spark: SparkSession, path: str, required: list[str], filled: list[str] = ()) -> DataFrame:
    """A catalog of strings. Header names lose case and edges; missing headers and blank cells of `filled` raise."""
    df = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    df = df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])
    if lacks := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path}: no columns {lacks}")
    for c in filled:
        df = df.withColumn(c, F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.raise_error(F.lit(f"{path}: blank {c}"))).otherwise(F.col(c)))
    return df


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def rttm(spark: SparkSession, path: str) -> DataFrame:
    """SPEAKER rows: (file_id, start_sec, end_sec, speaker)."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.col("value").startswith("SPEAKER")).select(p.alias("p"))
    start = F.get("p", 3).try_cast("double")
    return rows.select(F.get("p", 1).alias("file_id"), start.alias("start_sec"), (start + F.get("p", 4).try_cast("double")).alias("end_sec"), F.get("p", 7).alias("speaker"))


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """df; raises where a key stands twice."""
    if twice := df.groupBy(key).count().where("count > 1").limit(5).collect():
        raise ValueError(f"{key} is not unique: {[r[0] for r in twice]}")
    return df


def require_hash(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column).rlike(HASH), F.col(column)).otherwise(F.raise_error(F.concat(F.lit("not a SHA-256: "), F.coalesce(column, F.lit("null"))))))

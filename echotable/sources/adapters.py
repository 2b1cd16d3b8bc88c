"""Views of the test tables in the shapes the operators work on, for Spark and, as common table expressions, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed segments of transcripts: a conversation is a recording, a role a model, a turn a segment."""
    t = read(spark, sf_dir, "conversations")
    start = F.col("turn") * F.lit(5.0)
    return t.select(
        F.sha2(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")), 256).alias("audio_hash"),
        F.col("role").alias("model_key"),
        F.col("turn").cast("long").alias("seg_idx"),
        start.alias("start_sec"),
        (start + F.length("text") / F.lit(20.0)).alias("end_sec"),
        F.col("text"),
        F.col("text").alias("full_text"),
    )


SEG = """seg AS (SELECT sha256('conv-' || conv_id::VARCHAR) AS audio_hash, role AS model_key, turn::BIGINT AS seg_idx, turn * 5.0::DOUBLE AS start_sec,
 turn * 5.0::DOUBLE + length(text) / 20.0::DOUBLE AS end_sec, text, text AS full_text FROM conversations)"""


def takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of three recognizers of each conversation: lines as they are; some said twice; some said twice, later, and some lost."""
    t = read(spark, sf_dir, "conversations")
    lines = t.select(F.sha2(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")), 256).alias("audio_hash"), F.col("turn").cast("long").alias("turn"), F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    lines = lines.withColumn("start", F.col("turn") * F.lit(5.0) + F.col("i") * F.lit(0.5)).withColumn("end", F.col("start") + F.lit(0.25) + F.length("text") / F.lit(100.0))
    nth, k, s, e = F.col("turn") + F.col("i"), (F.col("turn") * 1000 + F.col("i")) * 2, F.col("start"), F.col("end")
    out = []
    for model, twice, lost, late in (("plain", F.lit(False), F.lit(False), 0.0), ("stutter", nth % 3 == 0, F.lit(False), 0.0), ("lossy", nth % 6 == 0, nth % 7 == 5, 0.125)):
        rows = lines.where(~lost).select("audio_hash", "text", k.alias("k"), (s + late).alias("s"), (e + late).alias("e"), twice.alias("twice"))
        rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.when(F.col("twice"), 1).otherwise(0))))
        middle = (F.col("s") + F.col("e")) / 2
        out.append(rows.select("audio_hash", F.lit(model).alias("model_key"), (F.col("k") + F.col("part")).cast("long").alias("seg_idx"), F.when(F.col("part") == 1, middle).otherwise(F.col("s")).alias("start_sec"), F.when(F.col("twice") & (F.col("part") == 0), middle).otherwise(F.col("e")).alias("end_sec"), "text"))
    return out[0].unionByName(out[1]).unionByName(out[2])


TAKES = """said AS (SELECT sha256('conv-' || conv_id::VARCHAR) AS audio_hash, turn::BIGINT AS turn, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS text FROM conversations),
 timed AS (SELECT *, turn * 5.0::DOUBLE + i * 0.5::DOUBLE AS s, turn * 5.0::DOUBLE + i * 0.5::DOUBLE + 0.25::DOUBLE + length(text) / 100.0::DOUBLE AS e, (turn * 1000 + i) * 2 AS k FROM said),
 told AS (SELECT audio_hash, 'plain' AS model_key, k, s, e, text, 0 AS twice FROM timed UNION ALL SELECT audio_hash, 'stutter', k, s, e, text, ((turn + i) % 3 = 0)::INT FROM timed UNION ALL SELECT audio_hash, 'lossy', k, s + 0.125::DOUBLE, e + 0.125::DOUBLE, text, ((turn + i) % 6 = 0)::INT FROM timed WHERE (turn + i) % 7 <> 5),
 takes AS (SELECT audio_hash, model_key, k + part AS seg_idx, CASE WHEN part = 1 THEN (s + e) / 2 ELSE s END AS start_sec, CASE WHEN twice = 1 AND part = 0 THEN (s + e) / 2 ELSE e END AS end_sec, text FROM (SELECT *, unnest(range(twice + 1)) AS part FROM told))"""


def docseg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines of documents with their place."""
    t = read(spark, sf_dir, "documents")
    lines = t.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.where(F.trim("line") != "").select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


DOCSEG = """docseg AS (SELECT doc_id, (i - 1)::BIGINT AS pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
 generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(line) <> '')"""


def token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters-and-digits tokens of documents, lower-cased, with their place."""
    t = read(spark, sf_dir, "documents")
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return t.select("doc_id", F.posexplode(found).alias("pos", "term")).withColumn("pos", F.col("pos").cast("long"))


TOKEN = r"""token AS (SELECT doc_id, (i - 1)::BIGINT AS pos, term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term,
 generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 1) AS i FROM documents))"""


def speaker_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "embeddings")
    return t.select("vec_id", F.col("label").cast("long").alias("speaker"), (F.col("vec_id") % 20).alias("file_id"), (1 + F.col("vec_id") % 7).cast("double").alias("weight"), F.col("embedding").cast("array<double>").alias("vector"))


SPEAKER_VEC = """speaker_vec AS (SELECT vec_id, label::BIGINT AS speaker, vec_id % 20 AS file_id, (1 + vec_id % 7)::DOUBLE AS weight, embedding::DOUBLE[] AS vector FROM embeddings)"""


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "events")
    return t.select("event_id", "user_id", F.col("event_type").alias("resource_id"), F.col("ts").alias("created_at"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


AUDIT = """audit AS (SELECT event_id, user_id, event_type AS resource_id, ts AS created_at, value, json_extract_string(props, '$.k')::BIGINT AS k FROM events)"""


def catalog_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0")
    return t.select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("hash"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("artist"), F.col("o_totalprice").alias("seconds"), "o_orderkey", "o_custkey")


def catalog_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "orders").where("o_orderkey % 2 = 0")
    return t.select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("hash"), F.col("o_orderstatus").alias("status"), F.lit("archived").alias("artist"), (F.col("o_totalprice") + F.when(F.col("o_orderkey") % 10 == 0, 5.0).otherwise(0.5)).alias("seconds"), "o_orderkey", "o_custkey")


CATALOGS = """catalog_a AS (SELECT sha256(o_orderkey::VARCHAR) AS hash, o_orderstatus AS status, o_orderpriority AS artist, o_totalprice AS seconds, o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 <> 0),
 catalog_b AS (SELECT sha256(o_orderkey::VARCHAR) AS hash, o_orderstatus AS status, 'archived' AS artist, o_totalprice + CASE WHEN o_orderkey % 10 = 0 THEN 5.0 ELSE 0.5 END AS seconds, o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0)"""


def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision log: spans are documents' hundreds, actors their last digit."""
    t = read(spark, sf_dir, "labels")
    return t.select((F.col("doc_id") % 97).alias("span_id"), (F.col("doc_id") % 4).alias("actor_key"), F.when(F.col("quality") == 1, "APPROVE").otherwise("DISAPPROVE").alias("kind"), F.col("doc_id").alias("sequence"), ((F.col("doc_id") % 11) / F.lit(10.0)).alias("heard"), (F.col("toxic") == 1).alias("flagged"))


REVIEW = """review AS (SELECT doc_id % 97 AS span_id, doc_id % 4 AS actor_key, CASE WHEN quality = 1 THEN 'APPROVE' ELSE 'DISAPPROVE' END AS kind, doc_id AS sequence, (doc_id % 11) / 10.0::DOUBLE AS heard, toxic = 1 AS flagged FROM labels)"""

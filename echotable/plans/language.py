"""Queries on text: scoring, chunking, repeats, functions, streams, each with its SQL for DuckDB where that can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import asr, chunking, kernels
from ..operators import transcripts as tr
from ..sources.adapters import SEG, read, seg
from ..sources.sinks import shared_folder
from ..streaming import events as st

Q, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _pairs(spark, d):
    """Documents and what a recognizer might have made of them: every e of every seventh word is lost."""
    t = read(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.translate("text", "éèêëàâçôûùîïöäüßñóíáúÉÈÊÀÇÔÖÄÜÑÓÍÁÚ", "eeeeaacouuiioausnoiauEEEACOOAUNOIAU").alias("reference"))
    words = F.transform(F.split("reference", " "), lambda w, i: F.when(i % 7 == 3, F.replace(w, F.lit("e"), F.lit(""))).otherwise(w))
    return t.withColumn("hypothesis", F.array_join(words, " "))


@query()
def asr_error_rates(spark, d):
    return asr.summary(asr.errors(_pairs(spark, d), "reference", "hypothesis"), ["role"])


ASCII = "translate(text, 'éèêëàâçôûùîïöäüßñóíáúÉÈÊÀÇÔÖÄÜÑÓÍÁÚ', 'eeeeaacouuiioausnoiauEEEACOOAUNOIAU')"


@query(f"WITH r AS (SELECT role, regexp_replace({ASCII}, '[^\\x20-\\x7E]', '', 'g') AS x FROM conversations), p AS (SELECT role, x, replace(x, 'th', 'z') AS y FROM r) SELECT role, count(*) AS n, sum(levenshtein(x, y))::BIGINT AS errors, sum(length(x))::BIGINT AS chars, round(sum(levenshtein(x, y)) / nullif(sum(length(x)), 0), 4) AS cer FROM p GROUP BY role")
def asr_character_errors(spark, d):
    x = F.regexp_replace(F.translate("text", "éèêëàâçôûùîïöäüßñóíáúÉÈÊÀÇÔÖÄÜÑÓÍÁÚ", "eeeeaacouuiioausnoiauEEEACOOAUNOIAU"), r"[^\x20-\x7E]", "")
    t = read(spark, d, "conversations").select("role", x.alias("x")).withColumn("y", F.replace("x", F.lit("th"), F.lit("z")))
    t = t.withColumns({"errors": tx.char_distance("x", "y"), "chars": F.length("x")})
    return t.groupBy("role").agg(F.count("*").alias("n"), F.sum("errors").alias("errors"), F.sum("chars").alias("chars"), asr.rate("errors", "chars").alias("cer"))


@query()
def asr_worst_hypotheses(spark, d):
    t = asr.errors(_pairs(spark, d), "reference", "hypothesis").withColumn("key", F.concat_ws("-", "conv_id", "turn"))
    return asr.worst(t, "key").select("key", "wer").limit(50)  # a top-k report


@query()
def dev_split(spark, d):
    return asr.split_dev(read(spark, d, "conversations"), "conv_id", 0.1, 7)


def _tokens():
    """Counts tokens of a public vocabulary."""
    import public_tokenizers

    return chunking.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


@query()
def token_chunks(spark, d):
    s = tr.segments_chunkable(seg(spark, d).withColumn("text", F.col("full_text")))
    c = chunking.chunks(s, 180, 260, 40, _tokens())
    return c.withColumn("chunk_id", chunking.chunk_id(F.lit("archive"), F.col("model_key"), "v1")).drop("text")


@query()
def chunk_token_audit(spark, d):
    s = tr.segments_chunkable(seg(spark, d).withColumn("text", F.col("full_text")))
    return chunking.token_audit(chunking.chunks(s, 180, 260, 40, _tokens()), ["model_key"], "token_count", 180, 260)


@query("WITH c AS (SELECT p_size AS config, avg(p_retailprice) AS p95, count(*) AS chunks, max(p_retailprice) / 10000 AS recall, (p_size % 5) / 200.0::DOUBLE AS overflow, p_size::DOUBLE AS build_sec FROM part GROUP BY p_size), f AS (SELECT *, max((overflow <= 0.01)::INT) OVER () AS a FROM c), g AS (SELECT * FROM f WHERE overflow <= 0.01 OR a = 0) SELECT config, round(p95, 6) AS p95, chunks, round(recall, 6) AS recall FROM g WHERE recall >= (SELECT max(recall) FROM g) - 0.02 ORDER BY g.p95, build_sec, chunks, config LIMIT 1")
def recommended_chunking(spark, d):
    c = read(spark, d, "part").groupBy(F.col("p_size").alias("config")).agg(F.avg("p_retailprice").alias("p95"), F.count("*").alias("chunks"), (F.max("p_retailprice") / 10000).alias("recall"))
    c = c.withColumns({"overflow": (F.col("config") % 5) / 200.0, "build_sec": F.col("config").cast("double")})
    return chunking.recommended(c).select("config", F.round("p95", 6).alias("p95"), "chunks", F.round("recall", 6).alias("recall"))


@query()
def repetition_findings(spark, d):
    return kernels.repetitions(read(spark, d, "documents"))


@query()
def repetition_scores(spark, d):
    t = read(spark, d, "documents")
    n = t.select(F.col("doc_id").alias("id"), F.length("text").alias("chars")).groupBy("id").agg(F.max("chars").alias("chars"))
    return kernels.scores(kernels.repetitions(t)).join(n, F.col("doc_id") == F.col("id")).withColumn("severity", kernels.severity(F.col("score"), F.col("covered") / F.col("chars"))).select("doc_id", "score", "findings", "severity")


@query()
def review_spans(spark, d):
    return kernels.spans_of_segments(seg(spark, d))


@query()
def packed_speech_regions(spark, d):
    return kernels.packed_regions(seg(spark, d))


@query(r"SELECT doc_id, trim(regexp_replace(lower(text), '[.,;:!?%&#$|*\s]+', ' ', 'g')) AS plain, length(text) AS n FROM documents")
def plain_text(spark, d):
    t = read(spark, d, "documents")
    return t.select("doc_id", F.trim(F.regexp_replace(F.lower("text"), r"[.,;:!?%&#$|*\s]+", " ")).alias("plain"), F.length("text").cast("long").alias("n"))


@query()
def normalized_forms(spark, d):
    t = read(spark, d, "conversations")
    return t.select("conv_id", "turn", tx.normal(F.col("text")).alias("normal"), tx.asr_normal(tx.composed("text")).alias("asr"), tx.folded("text").alias("folded"), F.array_join(tx.query_tokens(tx.compatible("text")), " ").alias("tokens"), tx.snippet(F.col("text"), 80).alias("snippet"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 80 THEN rtrim(substr(text, 1, 80)) || '…' ELSE text END AS snippet, sha256(concat_ws('|', 'archive', role, conv_id::VARCHAR, (turn * 5000)::BIGINT::VARCHAR, 'v1')) AS chunk_id FROM conversations")
def snippets_and_ids(spark, d):
    t = read(spark, d, "conversations")
    return t.select("conv_id", "turn", tx.snippet(F.col("text"), 80).alias("snippet"), F.sha2(F.concat_ws("|", F.lit("archive"), "role", F.col("conv_id").cast("string"), (F.col("turn") * 5000).cast("string"), F.lit("v1")), 256).alias("chunk_id"))


@query()
def text_similarity(spark, d):
    s = seg(spark, d)
    a, b = (s.where(F.col("model_key") == m).select("audio_hash", "seg_idx", F.col("full_text").alias(m)) for m in ("user", "assistant"))
    j = a.join(b.withColumn("seg_idx", F.col("seg_idx") - 1), ["audio_hash", "seg_idx"])
    return j.select("audio_hash", "seg_idx", F.round(tx.similarity("user", "assistant"), 6).alias("similarity"))


def _stream(spark, build, d, mode, keys):
    """Runs a stream over all there is into Parquet, and reads what it said last of each key."""
    events = spark.readStream.schema(read(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    folder = shared_folder(spark)
    st.to_parquet(build(events), f"{folder}/out", f"{folder}/state", mode).awaitTermination()
    return st.latest(spark.read.parquet(f"{folder}/out"), keys)


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_hourly(spark, d):
    return _stream(spark, st.tumbling, d, "update", ["start", "event_type"]).withColumn("total", F.round("total", 6))


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e) SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", user_id, count(*) AS n FROM r GROUP BY user_id, run")
def stream_sessions(spark, d):
    return _stream(spark, st.sessions, d, "complete", ["start", "user_id"])


@query("WITH p AS (SELECT user_id, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS new FROM events) SELECT user_id, sum(new)::BIGINT AS plays FROM p GROUP BY user_id")
def stream_plays(spark, d):
    return _stream(spark, st.plays, d, "update", ["user_id"])

"""Queries on records and reports, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import kernels
from ..operators import records as rc
from ..operators import transcripts as tr
from ..sources.adapters import CATALOGS, REVIEW, SEG, catalog_a, catalog_b, read, review, seg

R = ["audio_hash", "model_key"]
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


MOVED = "mv AS (SELECT audio_hash, model_key, seg_idx, start_sec - (seg_idx % 3) * 4.0 AS start_sec, end_sec - (seg_idx % 5) * 6.0 AS end_sec FROM seg)"


def _moved(spark, d):
    i = F.col("seg_idx")
    return seg(spark, d).select(*R, "seg_idx", (F.col("start_sec") - (i % 3) * 4.0).alias("start_sec"), (F.col("end_sec") - (i % 5) * 6.0).alias("end_sec"))


@query(_with(SEG, MOVED, "b AS (SELECT *, greatest(0, coalesce(max(greatest(start_sec, end_sec)) OVER (PARTITION BY audio_hash, model_key ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lo FROM mv)") + "SELECT audio_hash, model_key, seg_idx, round(greatest(lo, start_sec), 6) AS start_sec, round(greatest(lo, start_sec, end_sec), 6) AS end_sec FROM b")
def normalized_segments(spark, d):
    return rc.normalized(_moved(spark, d), R, ["seg_idx"])


@query(_with(SEG, r"w AS (SELECT *, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT *, string_split_regex(trim(text), '\s+') AS ws FROM seg WHERE seg_idx % 4 = 0))", "t AS (SELECT *, start_sec + i * 0.5 - (i % 4) * 0.75 AS ws1, start_sec + i * 0.5 + 0.25 AS we1 FROM w)", "b AS (SELECT *, greatest(start_sec, coalesce(max(greatest(ws1, we1)) OVER (PARTITION BY audio_hash, model_key, seg_idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start_sec)) AS lo FROM t)") + "SELECT audio_hash, model_key, seg_idx, i::BIGINT AS i, round(least(end_sec, greatest(lo, ws1)), 6) AS word_start, round(least(end_sec, greatest(lo, ws1, we1)), 6) AS word_end FROM b")
def normalized_words(spark, d):
    w = seg(spark, d).where("seg_idx % 4 = 0").select(*R, "seg_idx", "start_sec", "end_sec", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("i", "word"))
    at = F.col("start_sec") + F.col("i") * 0.5
    w = w.withColumns({"word_start": at - (F.col("i") % 4) * 0.75, "word_end": at + 0.25})
    out = rc.normalized(w, [*R, "seg_idx"], ["i"], "word_start", "word_end", F.col("start_sec"), F.col("end_sec"))
    return out.select(*R, "seg_idx", F.col("i").cast("long").alias("i"), "word_start", "word_end")


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber % 3 > 0 THEN (least(1, greatest(0, l_discount * 12)) + l_tax) / 2 ELSE least(1, greatest(0, exp(-l_quantity / 10))) END, 9) AS confidence FROM lineitem")
def segment_confidence(spark, d):
    t = read(spark, d, "lineitem")
    some = F.when(F.col("l_linenumber") % 3 > 0, F.array(F.col("l_discount") * 12, F.lit(None).cast("double"), F.col("l_tax"))).otherwise(F.array().cast("array<double>"))
    return t.select("l_orderkey", "l_linenumber", F.round(rc.confidence(some, -F.col("l_quantity") / 10), 9).alias("confidence"))


@query("SELECT l_orderkey, l_linenumber, round(CASE l_linenumber % 3 WHEN 0 THEN l_discount WHEN 1 THEN (l_tax + l_discount) / 2 ELSE l_quantity / 50 END, 9) AS confidence FROM lineitem")
def confidence_fallback(spark, d):
    t, n = read(spark, d, "lineitem"), F.col("l_linenumber") % 3
    none = F.array().cast("array<double>")
    return t.select("l_orderkey", "l_linenumber", F.round(rc.fallback_confidence(F.when(n == 0, F.col("l_discount")), F.when(n == 1, F.array("l_tax", "l_discount")).otherwise(none), F.array(F.col("l_quantity") / 50)), 9).alias("confidence"))


@query(_with(SEG) + r"SELECT audio_hash, model_key, count(*) AS num_segments, sum(CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split_regex(trim(text), '\s+')) END)::BIGINT AS num_words, max(end_sec) AS duration, sha256(coalesce(string_agg(trim(text), ' ' ORDER BY start_sec, seg_idx) FILTER (trim(text) <> ''), '')) AS text_sha FROM seg GROUP BY ALL")
def canonical_documents(spark, d):
    return rc.documents(seg(spark, d), R).withColumn("text_sha", F.sha2("transcript_text", 256)).drop("transcript_text")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 AND trim(role) <> '' THEN trim(role) WHEN turn % 3 = 1 THEN 'predicted ' || role ELSE trim(text) END AS said FROM conversations WHERE trim(text) <> ''")
def transcript_text_choice(spark, d):
    t = read(spark, d, "conversations").where("trim(text) <> ''")
    n = F.col("turn") % 3
    return t.select("conv_id", "turn", rc.first_text(F.when(n == 0, F.col("role")).otherwise(" "), F.when(n == 1, F.concat(F.lit(" predicted "), "role")), F.col("text")).alias("said"))


_BROKEN = "br AS (SELECT audio_hash, model_key, seg_idx, CASE WHEN seg_idx % 7 = 6 THEN NULL ELSE start_sec - (seg_idx % 4) * 6 END AS start_sec, CASE WHEN seg_idx % 11 = 10 THEN NULL ELSE end_sec - (seg_idx % 5) * 5 END AS end_sec, (seg_idx % 13) / 11.0::DOUBLE AS confidence FROM seg)"


@query(_with(SEG, _BROKEN, "p AS (SELECT *, last_value(end_sec IGNORE NULLS) OVER (PARTITION BY audio_hash, model_key ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM br)") + "SELECT audio_hash, model_key, count(*) AS items, count(*) FILTER (start_sec IS NULL OR end_sec IS NULL) AS missing_time, count(*) FILTER (start_sec < 0) AS negative_start, count(*) FILTER (end_sec < start_sec) AS ends_before_start, count(*) FILTER (start_sec < pe AND end_sec IS NOT NULL) AS not_monotone, count(*) FILTER (confidence > 1) AS confidence_range FROM p GROUP BY ALL")
def schema_issues(spark, d):
    i = F.col("seg_idx")
    s = seg(spark, d).select(*R, "seg_idx", F.when(i % 7 != 6, F.col("start_sec") - (i % 4) * 6).alias("start_sec"), F.when(i % 11 != 10, F.col("end_sec") - (i % 5) * 5).alias("end_sec"), ((i % 13) / F.lit(11.0)).alias("confidence"))
    return rc.issues(s, R, ["seg_idx"])


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, median(value) AS median, min(value) AS least, max(value) AS most, round(coalesce(stddev_samp(value), 0), 6) AS deviation FROM events GROUP BY event_type")
def confidence_summary(spark, d):
    return rc.summary(read(spark, d, "events"), ["event_type"], "value").withColumns({"mean": F.round("mean", 6), "deviation": F.round("deviation", 6)})


@query("SELECT event_type, min(value) AS least, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS most FROM events GROUP BY event_type")
def latency_stats(spark, d):
    out = rc.latency(read(spark, d, "events"), ["event_type"], "value")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "p95", "p99")})


@query(_with(SEG, r"s AS (SELECT *, CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split_regex(trim(text), '\s+')) END AS w, length(text) - length(regexp_replace(text, '[.!?]', '', 'g')) AS p, coalesce((start_sec - lag(end_sec) OVER o > 1.0)::INT, 0) AS g, row_number() OVER o AS i FROM seg WINDOW o AS (PARTITION BY audio_hash, model_key ORDER BY start_sec, seg_idx))", "t AS (SELECT *, coalesce(max(CASE WHEN p > 0 THEN i END) OVER k, 0) AS mark, coalesce(max(CASE WHEN g > 0 THEN i END) OVER k, 0) AS gap FROM s WINDOW k AS (PARTITION BY audio_hash, model_key))", "u AS (SELECT audio_hash, model_key, (sum(p) + sum(g) + CASE WHEN sum(CASE WHEN i > mark AND i >= gap THEN w ELSE 0 END) > 0 THEN 1 ELSE 0 END)::BIGINT AS sentences, sum(w)::BIGINT AS words, max(end_sec) AS seconds FROM t GROUP BY ALL)") + "SELECT *, round(CASE WHEN seconds > 0 THEN sentences / (seconds / 60) ELSE 0 END, 6) AS per_minute FROM u")
def sentence_statistics(spark, d):
    return rc.sentences(seg(spark, d), R).withColumn("per_minute", F.round("per_minute", 6))


_CHUNKED = "x AS (SELECT audio_hash, seg_idx, floor(start_sec / 60)::BIGINT AS chunk, start_sec, end_sec, model_key FROM seg WHERE end_sec > start_sec)"


@query(_with(SEG, _CHUNKED, "j AS (SELECT a.audio_hash, a.chunk, a.seg_idx, b.seg_idx AS region, greatest(0, b.start_sec - (a.start_sec + a.end_sec) / 2, (a.start_sec + a.end_sec) / 2 - b.end_sec) AS away FROM x a JOIN x b ON a.audio_hash = b.audio_hash AND a.chunk = b.chunk AND a.model_key = 'user' AND b.model_key = 'assistant')") + "SELECT audio_hash, chunk, seg_idx, arg_min(region, {'away': away, 'region': region}) AS region, round(min(away), 6) AS away FROM j GROUP BY ALL")
def nearest_regions(spark, d):
    s = seg(spark, d).where("end_sec > start_sec").withColumn("chunk", F.floor(F.col("start_sec") / 60))
    words = s.where("model_key = 'user'").select("audio_hash", "chunk", "seg_idx", F.col("start_sec").alias("word_start"), F.col("end_sec").alias("word_end"))
    regions = s.where("model_key = 'assistant'").select("audio_hash", "chunk", F.col("seg_idx").alias("region"), F.col("start_sec").alias("lo"), F.col("end_sec").alias("hi"))
    out = rc.nearest_region(words, regions, ["audio_hash", "chunk"])
    return out.select("audio_hash", "chunk", "seg_idx", "region", F.round("away", 6).alias("away"))


@query(_with(SEG) + "SELECT u.audio_hash, u.start_sec AS lo, u.end_sec AS hi, sha256(coalesce(string_agg(trim(a.text), ' ' ORDER BY a.start_sec, a.seg_idx) FILTER (trim(a.text) <> ''), '')) AS said, round(least(1, sum(least(u.end_sec, a.end_sec) - greatest(u.start_sec, a.start_sec)) / (u.end_sec - u.start_sec)), 6) AS share FROM seg u JOIN seg a ON a.audio_hash = u.audio_hash AND u.model_key = 'user' AND a.model_key = 'assistant' AND a.end_sec > u.start_sec AND a.start_sec < u.end_sec WHERE u.end_sec > u.start_sec GROUP BY u.audio_hash, u.start_sec, u.end_sec")
def overlap_texts(spark, d):
    s = seg(spark, d)
    spans = s.where("model_key = 'user' AND end_sec > start_sec").select("audio_hash", F.col("start_sec").alias("lo"), F.col("end_sec").alias("hi"))
    out = rc.overlap_texts(spans, s.where("model_key = 'assistant'"), ["audio_hash"])
    return out.withColumns({"said": F.sha2("said", 256), "share": F.round("share", 6)})


@query("SELECT l_orderkey, l_linenumber, place FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_extendedprice DESC, l_linenumber) AS place FROM lineitem) WHERE place <= 3")
def best_suggestions(spark, d):
    t = read(spark, d, "lineitem")
    return rc.ranked(t, ["l_orderkey"], [F.desc("l_discount"), F.desc("l_extendedprice"), F.col("l_linenumber")], 3).select("l_orderkey", "l_linenumber", F.col("place").cast("long").alias("place"))


_COV = """pt AS (SELECT audio_hash, lo, lead(lo) OVER (PARTITION BY audio_hash ORDER BY lo) AS hi FROM (SELECT DISTINCT audio_hash, lo FROM (SELECT audio_hash, start_sec AS lo FROM seg UNION ALL SELECT audio_hash, end_sec FROM seg))),
cov AS (SELECT s.audio_hash, lo, hi, count(DISTINCT model_key) AS degree FROM pt s JOIN seg g ON g.audio_hash = s.audio_hash AND hi - lo > 0 AND g.start_sec <= lo + 1e-6 AND g.end_sec >= hi - 1e-6 GROUP BY ALL)"""


@query(_with(SEG, _COV, "a AS (SELECT *, max((degree >= 2)::INT) OVER (PARTITION BY audio_hash) AS f FROM cov)", "r AS (SELECT *, row_number() OVER (PARTITION BY audio_hash ORDER BY lo) AS place FROM a WHERE degree >= 2 OR f = 0)") + "SELECT audio_hash, lo, hi, degree, place FROM r WHERE place <= 10")
def interval_samples(spark, d):
    c = iv.covered(seg(spark, d), ["audio_hash"], "model_key")
    return rc.samples(c, ["audio_hash"], 2, 10).select("audio_hash", "lo", "hi", F.col("degree").cast("long").alias("degree"), F.col("place").cast("long").alias("place"))


@query(_with(SEG, _COV, "r AS (SELECT *, row_number() OVER (PARTITION BY audio_hash ORDER BY round(hi - lo, 6) DESC, lo) AS place FROM cov WHERE degree >= 2)") + "SELECT audio_hash, lo, round(hi - lo, 6) AS sec, place FROM r WHERE place <= 8")
def longest_hotspots(spark, d):
    c = iv.covered(seg(spark, d), ["audio_hash"], "model_key").where("degree >= 2").withColumn("sec", F.round(F.col("hi") - F.col("lo"), 6))
    return rc.ranked(c, ["audio_hash"], [F.desc("sec"), F.col("lo")], 8).select("audio_hash", "lo", "sec", F.col("place").cast("long").alias("place"))


@query(r"SELECT conv_id, turn, sha256(trim(regexp_replace(regexp_replace(array_to_string(list_filter(string_split_regex(text, '\s+'), lambda t: t <> ''), ' '), ' +([.,!?;:)\]}])', '\1', 'g'), '([(\[{]) +', '\1', 'g'))) AS said FROM (SELECT conv_id, turn, replace(replace(text, ',', ' , '), '.', ' . ') AS text FROM conversations)")
def joined_tokens(spark, d):
    t = read(spark, d, "conversations")
    apart = F.replace(F.replace("text", F.lit(","), F.lit(" , ")), F.lit("."), F.lit(" . "))
    return t.select("conv_id", "turn", F.sha2(rc.joined_text(F.split(apart, r"\s+")), 256).alias("said"))


_GROUPED = "g AS (SELECT l_orderkey, list(l_suppkey % 3 ORDER BY l_linenumber, l_suppkey % 3) AS sources FROM lineitem GROUP BY l_orderkey)"


def _grouped(spark, d):
    return rc.ordered_sources(read(spark, d, "lineitem").withColumn("source", F.col("l_suppkey") % 3), ["l_orderkey"], "l_linenumber", "source")


@query(_with(_GROUPED) + "SELECT l_orderkey, array_to_string(sources, ',') AS sources FROM g")
def joined_manifest(spark, d):
    return _grouped(spark, d).select("l_orderkey", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


@query(_with(_GROUPED, "s AS (SELECT sources, min(l_orderkey) AS first, count(*) AS n FROM g GROUP BY sources HAVING count(*) > 1)") + "SELECT l_orderkey, first, n FROM g JOIN s ON g.sources = s.sources")
def duplicate_joins(spark, d):
    return rc.repeated_signatures(_grouped(spark, d), "l_orderkey")


@query("SELECT l_orderkey, min(l_quantity) AS rate, min(l_suppkey % 2 + 1) AS channels, min(l_extendedprice) FILTER (l_returnflag <> 'N') AS lossy, count(DISTINCT l_linestatus) = 1 AS stream_copy FROM lineitem GROUP BY l_orderkey")
def join_strategy(spark, d):
    t = read(spark, d, "lineitem")
    return t.groupBy("l_orderkey").agg(F.min("l_quantity").alias("rate"), F.min(F.col("l_suppkey") % 2 + 1).alias("channels"), F.min(F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice"))).alias("lossy"), (F.count_distinct("l_linestatus") == 1).alias("stream_copy"))


@query("SELECT p_partkey, coalesce(abs(try_cast(p_size::VARCHAR AS DOUBLE) - 23) > 2, true) AS normalize, coalesce(p_retailprice >= 1400, false) AS declip FROM part")
def loudness_flags(spark, d):
    t = read(spark, d, "part")
    size = F.col("p_size").cast("string").try_cast("double")
    return t.select("p_partkey", F.coalesce(F.abs(size - 23) > 2, F.lit(True)).alias("normalize"), F.coalesce(F.col("p_retailprice") >= 1400, F.lit(False)).alias("declip"))


@query(_with(CATALOGS) + "SELECT count(a.hash) AS expected, count(*) FILTER (a.hash IS NOT NULL AND b.hash IS NOT NULL) AS present, count(*) FILTER (b.hash IS NULL) AS missing, count(*) FILTER (abs(a.seconds - b.seconds) > 1) AS stale, count(*) FILTER (a.hash IS NULL) AS orphaned, CASE WHEN count(*) FILTER (b.hash IS NULL) > 0 THEN 'missing' WHEN count(*) FILTER (abs(a.seconds - b.seconds) > 1) > 0 THEN 'stale' WHEN count(*) FILTER (a.hash IS NULL) > 0 THEN 'orphaned' END AS first_error FROM catalog_a a FULL JOIN catalog_b b ON a.hash = b.hash")
def coverage_counters(spark, d):
    return rc.coverage(catalog_a(spark, d), catalog_b(spark, d), "hash", "seconds", 1.0)


@query(_with(CATALOGS) + "SELECT hash, 'transcribe' AS stage FROM catalog_a WHERE hash NOT IN (SELECT hash FROM catalog_b) UNION ALL SELECT hash, 'align' FROM catalog_a WHERE status = 'F' AND hash NOT IN (SELECT hash FROM catalog_b WHERE status = 'O')")
def missing_artifacts(spark, d):
    a, b = catalog_a(spark, d), catalog_b(spark, d)
    first = a.join(b, "hash", "left_anti").select("hash", F.lit("transcribe").alias("stage"))
    return first.union(a.where("status = 'F'").join(b.where("status = 'O'"), "hash", "left_anti").select("hash", F.lit("align")))


@query(_with(CATALOGS) + "SELECT status, count(*) FILTER (b IS NULL) AS not_indexed, count(*) FILTER (a IS NULL) AS without_transcript, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS covered FROM (SELECT coalesce(a.status, b.status) AS status, a.hash AS a, b.hash AS b FROM catalog_a a FULL JOIN catalog_b b ON a.hash = b.hash AND a.status = b.status) GROUP BY status")
def index_coverage(spark, d):
    a, b = catalog_a(spark, d).select("status", F.col("hash").alias("a")), catalog_b(spark, d).select(F.col("status").alias("b_status"), F.col("hash").alias("b"))
    j = a.join(b, (F.col("a") == F.col("b")) & (F.col("status") == F.col("b_status")), "full").withColumn("status", F.coalesce("status", "b_status"))
    n = lambda c: F.count(F.when(c, 1))
    return j.groupBy("status").agg(n(F.col("b").isNull()).alias("not_indexed"), n(F.col("a").isNull()).alias("without_transcript"), n(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("covered"))


@query(_with(REVIEW) + "SELECT span_id % 10 AS workspace, actor_key, count(*) AS decisions, count(*) FILTER (kind = 'APPROVE') AS approved, count(*) FILTER (flagged) AS flags, round(coalesce(sum(heard) FILTER (kind = 'APPROVE'), 0), 6) AS heard FROM review GROUP BY ALL")
def review_state_counts(spark, d):
    r = review(spark, d)
    yes = F.col("kind") == "APPROVE"
    return r.groupBy((F.col("span_id") % 10).alias("workspace"), "actor_key").agg(F.count("*").alias("decisions"), F.count(F.when(yes, 1)).alias("approved"), F.count(F.when(F.col("flagged"), 1)).alias("flags"), F.round(F.coalesce(F.sum(F.when(yes, F.col("heard"))), F.lit(0.0)), 6).alias("heard"))


_LATEST = "l AS (SELECT span_id, arg_max(kind, sequence) AS kind, bool_or(flagged) AS flagged, max(sequence) AS sequence FROM review GROUP BY span_id)"


@query(_with(REVIEW, _LATEST) + "SELECT span_id % 10 AS workspace, count(*) AS spans, count(*) FILTER (kind = 'APPROVE') AS done, count(*) FILTER (flagged) AS flagged, bool_and(kind = 'APPROVE' AND NOT flagged) AS publishable FROM l GROUP BY ALL")
def publication_eligibility(spark, d):
    latest = review(spark, d).groupBy("span_id").agg(F.max_by("kind", "sequence").alias("kind"), F.max("flagged").alias("flagged"))
    done = F.col("kind") == "APPROVE"
    return latest.groupBy((F.col("span_id") % 10).alias("workspace")).agg(F.count("*").alias("spans"), F.count(F.when(done, 1)).alias("done"), F.count(F.when(F.col("flagged"), 1)).alias("flagged"), F.every(done & ~F.col("flagged")).alias("publishable"))


@query(_with(REVIEW, _LATEST) + "SELECT span_id % 10 AS workspace, row_number() OVER (PARTITION BY span_id % 10 ORDER BY span_id) - 1 AS ordinal, span_id, CASE WHEN flagged THEN 'flagged' WHEN kind = 'APPROVE' THEN 'done' ELSE 'open' END AS state, kind <> lag(kind, 1, '') OVER (PARTITION BY span_id % 10 ORDER BY span_id) AS boundary FROM l")
def span_strip(spark, d):
    s = review(spark, d).groupBy("span_id").agg(F.max_by("kind", "sequence").alias("kind"), F.max("flagged").alias("flagged")).withColumn("workspace", F.col("span_id") % 10)
    w = Window.partitionBy("workspace").orderBy("span_id")
    return s.select("workspace", (F.row_number().over(w) - 1).cast("long").alias("ordinal"), "span_id", F.when(F.col("flagged"), "flagged").when(F.col("kind") == "APPROVE", "done").otherwise("open").alias("state"), (F.col("kind") != F.lag("kind", 1, "").over(w)).alias("boundary"))


@query(_with(REVIEW) + "SELECT split_part(why, ' ', 1) AS reason, count(*) AS spans, round(sum(heard), 3) AS hours FROM (SELECT heard, unnest(['kind ' || kind, CASE WHEN flagged THEN 'flagged' END, CASE WHEN heard < 0.5 THEN 'heard ' || floor(heard * 10)::INT::VARCHAR || '0 %' END]) AS why FROM review) WHERE why IS NOT NULL GROUP BY 1")
def exclusion_reasons(spark, d):
    r = review(spark, d)
    why = F.array(F.concat(F.lit("kind "), "kind"), F.when(F.col("flagged"), "flagged"), F.when(F.col("heard") < 0.5, F.concat(F.lit("heard "), F.floor(F.col("heard") * 10).cast("string"), F.lit("0 %"))))
    each = r.select("heard", F.explode(F.filter(why, lambda x: x.isNotNull())).alias("why"))
    return each.groupBy(F.regexp_replace("why", " .*", "").alias("reason")).agg(F.count("*").alias("spans"), F.round(F.sum("heard"), 3).alias("hours"))


@query("WITH s AS (SELECT user_id, json_extract_string(props, '$.k')::BIGINT % 5 AS version, ts, event_id FROM events), l AS (SELECT user_id, arg_max(version, {'ts': ts, 'event_id': event_id}) AS version FROM s GROUP BY user_id), n AS (SELECT version, count(*) AS users FROM l GROUP BY version), c AS (SELECT version, count(*) AS starts, max(ts) AS last_seen, min(ts) AS first_seen FROM s GROUP BY version) SELECT c.version, starts, coalesce(users, 0) AS users, last_seen, first_seen, row_number() OVER (ORDER BY c.version = 4 DESC, coalesce(users, 0) DESC, last_seen DESC) AS place FROM c LEFT JOIN n ON n.version = c.version")
def version_distribution(spark, d):
    s = read(spark, d, "events").select("user_id", "event_id", (F.get_json_object("props", "$.k").cast("long") % 5).alias("version"), "ts")
    latest = s.groupBy("user_id").agg(F.max_by("version", F.struct("ts", "event_id")).alias("v")).groupBy("v").agg(F.count("*").alias("users"))
    c = s.groupBy("version").agg(F.count("*").alias("starts"), F.max("ts").alias("last_seen"), F.min("ts").alias("first_seen"))
    out = c.join(latest, F.col("version") == F.col("v"), "left").drop("v").fillna(0, ["users"])
    # a row for each version
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.col("version") == 4), F.desc("users"), F.desc("last_seen"))).cast("long"))


@query("SELECT n_nationkey, n_name, count(s_suppkey) AS used, count(s_suppkey) FILTER (s_acctbal > 0) AS eligible FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def lookup_counts(spark, d):
    n, s = read(spark, d, "nation"), read(spark, d, "supplier")
    return n.join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey", "n_name").agg(F.count("s_suppkey").alias("used"), F.count(F.when(F.col("s_acctbal") > 0, 1)).alias("eligible"))


@query("WITH o AS (SELECT o_custkey AS who, max(o_orderdate) AS at FROM orders GROUP BY 1), l AS (SELECT o_custkey AS who, max(l_shipdate) AS at FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1), e AS (SELECT user_id AS who, max(ts) AS at FROM events GROUP BY 1) SELECT c_custkey, greatest(o.at, l.at, e.at) AS last_at FROM customer LEFT JOIN o ON o.who = c_custkey LEFT JOIN l ON l.who = c_custkey LEFT JOIN e ON e.who = c_custkey")
def last_activity(spark, d):
    o, l, e = (read(spark, d, t) for t in ("orders", "lineitem", "events"))
    sent = l.where("l_returnflag = 'R'").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    logs = {"orders": o.select(F.col("o_custkey").alias("who"), F.col("o_orderdate").alias("at")), "returns": sent.select(F.col("o_custkey").alias("who"), F.col("l_shipdate").alias("at")), "events": e.select(F.col("user_id").alias("who"), F.col("ts").alias("at"))}
    return rc.last_activity(read(spark, d, "customer").select("c_custkey"), "c_custkey", logs).select("c_custkey", "last_at")


_LOGS = "lg AS (" + " UNION ALL ".join(f"SELECT user_id % 50 AS workspace, user_id AS actor, ts AS tm, event_id, '{k}' AS kind FROM events WHERE event_type = '{k}'" for k in ("click", "signup", "error", "view")) + ")"


@query(_with(_LOGS) + "SELECT workspace, arg_max(actor, {'tm': tm, 'event_id': event_id}) AS last_actor, max(tm) AS last_at, max(tm) FILTER (actor < 50) AS own_at, arg_max(kind, {'tm': tm, 'event_id': event_id}) AS last_kind FROM lg GROUP BY workspace")
def workspace_activity(spark, d):
    e, log = read(spark, d, "events"), None
    for kind in ("click", "signup", "error", "view"):
        part = e.where(F.col("event_type") == kind).select((F.col("user_id") % 50).alias("workspace"), F.col("user_id").alias("actor"), F.col("ts").alias("at"), "event_id", F.lit(kind).alias("kind"))
        log = part if log is None else log.unionByName(part)
    when = F.struct("at", "event_id")
    return log.groupBy("workspace").agg(F.max_by("actor", when).alias("last_actor"), F.max("at").alias("last_at"), F.max(F.when(F.col("actor") < 50, F.col("at"))).alias("own_at"), F.max_by("kind", when).alias("last_kind"))


_USAGE = "us AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, event_type AS tool, nullif(CASE WHEN event_id % 4 = 0 THEN '' ELSE 'c' || (event_id % 4)::VARCHAR END, '') AS catalog, 1 AS calls, value FROM events WHERE ts >= TIMESTAMP '2024-01-10' UNION ALL SELECT user_id, date_trunc('day', ts)::TIMESTAMP, event_type, nullif(CASE WHEN event_id % 4 = 0 THEN '' ELSE 'c' || (event_id % 4)::VARCHAR END, ''), count(*), sum(value) FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY ALL)"


def _usage(spark, d):
    e = read(spark, d, "events").select("user_id", F.date_trunc("day", "ts").alias("day"), F.col("event_type").alias("tool"), F.nullif(F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit("c"), (F.col("event_id") % 4).cast("string"))), F.lit("")).alias("catalog"), "value", "ts")
    raw = e.where("ts >= TIMESTAMP '2024-01-10'").select("user_id", "day", "tool", "catalog", F.lit(1).cast("long").alias("calls"), "value")
    old = e.where("ts < TIMESTAMP '2024-01-10'").groupBy("user_id", "day", "tool", "catalog").agg(F.count("*").alias("calls"), F.sum("value").alias("value"))
    return raw.unionByName(old)


@query(_with(_USAGE) + "SELECT tool, catalog, sum(calls)::BIGINT AS calls, count(DISTINCT user_id) AS users, round(sum(value), 4) AS value, min(day) AS first_day FROM us GROUP BY tool, catalog")
def usage_by_tool_and_catalog(spark, d):
    return _usage(spark, d).groupBy("tool", "catalog").agg(F.sum("calls").alias("calls"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("value"), F.min("day").alias("first_day"))


@query(_with(_USAGE) + "SELECT coalesce(c_mktsegment, 'none') AS segment, count(DISTINCT user_id) AS users, sum(calls)::BIGINT AS calls FROM us LEFT JOIN customer ON c_custkey = user_id GROUP BY ALL")
def usage_by_group(spark, d):
    u = _usage(spark, d).join(read(spark, d, "customer"), F.col("c_custkey") == F.col("user_id"), "left")
    return u.groupBy(F.coalesce("c_mktsegment", F.lit("none")).alias("segment")).agg(F.count_distinct("user_id").alias("users"), F.sum("calls").alias("calls"))


@query("WITH m AS (SELECT max(ts) AS t FROM events), w AS (SELECT e.* FROM events e, m WHERE ts > t - INTERVAL 7 DAY), p AS (SELECT *, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), true) AS play FROM w) SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (play) AS plays, count(DISTINCT user_id) AS users, count(*) FILTER (value > 100) AS slow, round(avg(value) FILTER (value <= 100), 6) AS mean FROM p GROUP BY event_type")
def weekly_report(spark, d):
    e = read(spark, d, "events")
    w = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("t")))).where("ts > t - INTERVAL 7 DAY")  # one row
    play = F.coalesce(F.col("event_type") != F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.lit(True))
    return w.withColumn("play", play).groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("calls"), F.count(F.when(F.col("play"), 1)).alias("plays"), F.count_distinct("user_id").alias("users"), F.count(F.when(F.col("value") > 100, 1)).alias("slow"), F.round(F.avg(F.when(F.col("value") <= 100, F.col("value"))), 6).alias("mean"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id) FILTER (event_type = 'error') AS users, round(count(*) / nullif(count(DISTINCT user_id), 0), 6) AS per_user FROM events GROUP BY ALL HAVING count(*) > 3")
def daily_health(spark, d):
    e, bad = read(spark, d, "events"), F.col("event_type") == "error"
    out = e.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count(F.when(bad, 1)).alias("errors"), F.count_distinct(F.when(bad, F.col("user_id"))).alias("users"), F.count("*").alias("n"), F.count_distinct("user_id").alias("u"))
    return out.where("n > 3").select("day", "errors", "users", F.round(F.col("n") / F.nullif("u", F.lit(0)), 6).alias("per_user"))


@query("SELECT 'customers' AS what, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS attention FROM customer UNION ALL SELECT 'orders', count(*), count(*) FILTER (o_orderstatus = 'F') FROM orders UNION ALL SELECT 'events', count(*), count(*) FILTER (event_type = 'error') FROM events")
def dashboard_counts(spark, d):
    one = lambda t, name, c: read(spark, d, t).agg(F.lit(name).alias("what"), F.count("*").alias("n"), F.count(F.when(F.expr(c), 1)).alias("attention"))
    return one("customer", "customers", "c_acctbal < 0").union(one("orders", "orders", "o_orderstatus = 'F'")).union(one("events", "events", "event_type = 'error'"))


@query("SELECT c_custkey, c_acctbal, count(*) OVER () AS total, round(sum(c_acctbal) OVER (), 2) AS total_value FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer) ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 25 OFFSET 50")
def page_with_totals(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    return rc.page_with_totals(c, [F.desc_nulls_last("c_acctbal"), F.col("c_custkey")], "c_acctbal", 25, 50).withColumn("total_value", F.round("total_value", 2))  # one page is the feature


@query("SELECT DISTINCT trim(p_type) AS album FROM part WHERE trim(p_type) <> ''")
def distinct_albums(spark, d):
    return read(spark, d, "part").select(F.trim("p_type").alias("album")).where("album <> ''").distinct()


@query()
def segments_from_words(spark, d):
    w = tr.interpolated_words(seg(spark, d).where("model_key = 'assistant'"))
    return kernels.segments_of_words(w, 1.0, 12.0).withColumn("text", F.sha2("text", 256))

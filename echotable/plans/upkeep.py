"""Queries on the upkeep of an archive: index sync, validation, fingerprints, corrections, order of names; with SQL for DuckDB where that can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import time as tm
from ..operators import alignment as al
from ..operators import asr, chunking
from ..operators import canonical as cn
from ..operators import catalog as ct
from ..operators import corpus as cp
from ..operators import filters as fl
from ..operators import integrity as ig
from ..operators import records as rc
from ..operators import silence, validation
from ..sources import corrections, sync
from ..sources.adapters import CATALOGS, SEG, catalog_a, catalog_b, read, seg
from ..sources.sinks import shared_folder
from ..streaming import events as st
from ..streaming import playback
from . import records

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


# a table of chunks that follows first one catalog, then another


def _synced(spark, d):
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")

    def chunks(s):  # lines meet their orders first and are summed where they lie then, all of an order in one task
        j = s.select("audio_hash", "o_orderkey").hint("merge").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        sums = j.groupBy("audio_hash", "l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("quantity"))
        return sums.select("audio_hash", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id"), "quantity")

    a = catalog_a(spark, d).select(F.col("hash").alias("audio_hash"), F.col("status").alias("fingerprint"), "o_orderkey")
    b = catalog_b(spark, d).select(F.col("hash").alias("audio_hash"), F.concat("status", F.when(F.col("o_orderkey") % 4 == 0, "").otherwise("x")).alias("fingerprint"), "o_orderkey")
    root = shared_folder(spark)
    reports = [sync.sync(spark, root, s, chunks, "settings", name) for name, s in (("first", a), ("second", b), ("second", b), ("third", b))]
    return root, reports


@query(_with(CATALOGS, "l AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL)") + "SELECT hash AS audio_hash, l_orderkey || '-' || l_linenumber AS chunk_id, quantity FROM catalog_b JOIN l ON l_orderkey = o_orderkey")
def index_sync_live(spark, d):
    return sync.live(spark, _synced(spark, d)[0])


@query(
    _with(CATALOGS, "l AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY l_orderkey)", "c AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS k, CASE WHEN a.hash IS NULL THEN 'added' WHEN b.hash IS NULL THEN 'removed' WHEN a.o_orderkey % 4 <> 0 THEN 'updated' ELSE 'unchanged' END AS change FROM catalog_a a FULL JOIN catalog_b b ON a.hash = b.hash)", "j AS (SELECT c.*, coalesce(n, 0) AS n FROM c LEFT JOIN l ON l_orderkey = k)")
    + "SELECT 1 AS run, 'bootstrap: nothing is there' AS mode, (SELECT count(*) FROM catalog_a) AS added, 0 AS updated, 0 AS removed, 0 AS unchanged, (SELECT sum(n)::BIGINT FROM catalog_a JOIN l ON l_orderkey = o_orderkey) AS inserted, 0 AS deleted UNION ALL "
    + "SELECT unnest([2, 3]), 'incremental', count(*) FILTER (change = 'added'), count(*) FILTER (change = 'updated'), count(*) FILTER (change = 'removed'), count(*) FILTER (change = 'unchanged'), (sum(n) FILTER (change IN ('added', 'updated')))::BIGINT, (sum(n) FILTER (change IN ('updated', 'removed')))::BIGINT FROM j UNION ALL "
    + "SELECT 4, 'incremental', 0, 0, 0, (SELECT count(*) FROM catalog_b), 0, 0"
)
def index_sync_reports(spark, d):
    reports = _synced(spark, d)[1]
    rows = [(i, r["mode"], *(int(r[c]) for c in ("added", "updated", "removed", "unchanged", "inserted", "deleted"))) for i, r in enumerate(reports, 1)]
    return spark.createDataFrame(rows, "run int, mode string, added long, updated long, removed long, unchanged long, inserted long, deleted long")  # what four syncs of the tables said


# validation

_DIA = """el AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, turn, role, turn * 5.0::DOUBLE - CASE WHEN turn % 3 = 2 THEN 12.0 ELSE 0.0 END AS s, turn * 5.0::DOUBLE + CASE WHEN turn % 4 = 3 THEN -20.0 ELSE 4.0 END AS e, conv_id % 3 AS kind FROM conversations),
 f1 AS (SELECT *, CASE WHEN kind = 0 THEN NULL WHEN turn % 7 = 6 THEN 'start must be a number' WHEN turn % 5 = 4 THEN 'speaker must be a non-empty string' WHEN e <= s THEN 'end must be greater than start' END AS f FROM (SELECT conv_id, idx, turn, role, CASE WHEN kind = 0 THEN turn * 5.0::DOUBLE ELSE s END AS s, CASE WHEN kind = 0 THEN turn * 5.0::DOUBLE + 4.0 ELSE e END AS e, kind FROM el)),
 f2 AS (SELECT *, coalesce(f, CASE WHEN s < last_value(CASE WHEN f IS NULL THEN s END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'start time is out of order' END) AS fault FROM f1),
 rp AS (SELECT conv_id, any_value(kind) AS kind, count(fault) AS issues, count(*) AS n, count(DISTINCT role) AS who, sum(e - s) AS sec, arg_min('segment ' || idx || ' ' || fault, idx) FILTER (fault IS NOT NULL) AS first FROM f2 GROUP BY conv_id)"""


def _diarization(spark, d):
    """A diarization file for each conversation, some with faults: as JSON texts."""
    t = read(spark, d, "conversations")
    fine = F.col("conv_id") % 3 == 0
    turn = F.col("turn")
    start = turn * F.lit(5.0) - F.when(~fine & (turn % 3 == 2), 12.0).otherwise(0.0)
    end = turn * F.lit(5.0) + F.when(~fine & (turn % 4 == 3), -20.0).otherwise(4.0)
    as_text = F.when(~fine & (turn % 7 == 6), F.concat(F.lit('"'), start.cast("string"), F.lit('"'))).otherwise(start.cast("string"))
    who = F.when(~fine & (turn % 5 == 4), " ").otherwise(F.col("role"))
    one = F.concat(F.lit('{"start": '), as_text, F.lit(', "end": '), end.cast("string"), F.lit(', "speaker": "'), who, F.lit('"}'))
    files = t.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("turn", one.alias("j"))))["j"], ", ").alias("body"))
    return files.select(F.col("conv_id").cast("string").alias("path"), F.concat(F.lit("backend "), (F.col("conv_id") % 3).cast("string")).alias("backend"), F.concat(F.lit('{"audio_file": "a", "segments": ['), "body", F.lit("]}")).alias("body"))


@query(_with(_DIA) + "SELECT conv_id::VARCHAR AS path, idx, fault FROM f2 WHERE fault IS NOT NULL")
def diarization_issues(spark, d):
    return validation.diarization_segments(_diarization(spark, d)).where("fault IS NOT NULL").select("path", "idx", "fault")


@query(_with(_DIA) + "SELECT conv_id::VARCHAR AS path, CASE WHEN issues = 0 THEN 'passed' ELSE 'failed' END AS status, CASE WHEN issues = 0 THEN n END AS segments, CASE WHEN issues = 0 THEN who END AS speakers, issues, first AS message FROM rp")
def diarization_report(spark, d):
    return validation.diarization_report(_diarization(spark, d)).select("path", "status", "segments", "speakers", "issues", "message")


@query(_with(_DIA) + "SELECT 'backend ' || kind AS backend, count(*) AS total, count(*) FILTER (issues = 0) AS passed, count(*) FILTER (issues > 0) AS failed, round(count(*) FILTER (issues = 0) / count(*) * 100, 6) AS rate, coalesce(sum(n) FILTER (issues = 0), 0)::BIGINT AS segments_total, round(coalesce(avg(n) FILTER (issues = 0), 0), 6) AS segments_mean, round(coalesce(sum(sec) FILTER (issues = 0), 0), 6) AS seconds_total, round(coalesce(avg(sec) FILTER (issues = 0), 0), 6) AS seconds_mean FROM rp GROUP BY kind")
def diarization_backends(spark, d):
    out = validation.rollup(validation.diarization_report(_diarization(spark, d)), "backend", ["segments", "seconds"])
    return out.withColumns({c: F.round(c, 6) for c in ("rate", "segments_mean", "seconds_total", "seconds_mean")})


@query("WITH x AS (" + records.SQL["schema_issues"] + ") SELECT model_key, count(*) AS total, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, round(count(*) FILTER (ok) / count(*) * 100, 6) AS rate, coalesce(sum(items) FILTER (ok), 0)::BIGINT AS items_total, round(coalesce(avg(items) FILTER (ok), 0), 6) AS items_mean FROM (SELECT *, missing_time + negative_start + ends_before_start + not_monotone + confidence_range = 0 AS ok FROM x) GROUP BY model_key")
def transcript_batch(spark, d):
    x = records.schema_issues(spark, d)
    faults = sum((F.col(c) for c in ("missing_time", "negative_start", "ends_before_start", "not_monotone", "confidence_range")), F.lit(0))
    out = validation.rollup(x.withColumn("status", F.when(faults == 0, "passed").otherwise("failed")), "model_key", ["items"])
    return out.withColumns({c: F.round(c, 6) for c in ("rate", "items_mean")})


@query("WITH x AS (" + records.SQL["schema_issues"] + "), y AS (SELECT *, missing_time + negative_start + ends_before_start + not_monotone + confidence_range AS faults FROM x) SELECT audio_hash, model_key, faults, row_number() OVER (ORDER BY faults = 0, items, audio_hash || model_key) AS nth FROM y ORDER BY nth LIMIT 25")
def worst_transcripts(spark, d):
    x = records.schema_issues(spark, d)
    faults = sum((F.col(c) for c in ("missing_time", "negative_start", "ends_before_start", "not_monotone", "confidence_range")), F.lit(0))
    x = x.withColumns({"faults": faults, "status": F.when(faults == 0, "passed").otherwise("failed"), "key": F.concat("audio_hash", "model_key")})
    top = validation.ranked(x, "items", "key").limit(25)  # a top-k report
    return top.agg(F.collect_list(F.struct("audio_hash", "model_key", "faults")).alias("r")).select(F.posexplode("r").alias("nth", "r")).select("r.*", (F.col("nth") + 1).cast("long").alias("nth"))


@query(_with(SEG, "w AS (SELECT audio_hash, model_key, seg_idx, start_sec - CASE WHEN seg_idx % 3 = 1 THEN 0.5 ELSE 0 END AS ws, end_sec + CASE WHEN seg_idx % 5 = 2 THEN 0.25 ELSE 0 END AS we FROM seg)") + "SELECT w.audio_hash, w.model_key, w.seg_idx FROM w JOIN seg USING (audio_hash, model_key, seg_idx) WHERE ws < start_sec - 0.05 OR we > end_sec + 0.05")
def words_outside_segments(spark, d):
    s, i = seg(spark, d), F.col("seg_idx")
    words = s.select("audio_hash", "model_key", "seg_idx", (F.col("start_sec") - F.when(i % 3 == 1, 0.5).otherwise(0.0)).alias("word_start"), (F.col("end_sec") + F.when(i % 5 == 2, 0.25).otherwise(0.0)).alias("word_end"))
    return rc.words_outside(words, s, ["audio_hash", "model_key", "seg_idx"], 0.05).select("audio_hash", "model_key", "seg_idx")


# fingerprints, corrections, names


@query(_with(SEG) + """SELECT audio_hash, count(*) AS segments, sha256('{"audio_hash":' || to_json(audio_hash) || ',"segments":[' || string_agg('{"end":' || round(end_sec, 6) || ',"start":' || round(start_sec, 6) || ',"text":' || to_json(text) || '}', ',' ORDER BY seg_idx) || ']}') AS fingerprint FROM seg GROUP BY audio_hash""")
def transcript_fingerprints(spark, d):
    return cn.transcript_fingerprint(seg(spark, d), ["audio_hash"])


@query(_with(CATALOGS, "p AS (SELECT hash, 'corrected/' || o_orderkey AS path, 'p' || o_orderkey AS pub FROM catalog_b WHERE o_orderkey % 5 = 0)") + "SELECT coalesce(a.hash, p.hash) AS audio_hash, coalesce(path, 'machine/' || a.o_orderkey) AS transcript_path, CASE WHEN p.hash IS NULL THEN 'machine' ELSE 'correction' END AS origin, pub AS publication_id FROM catalog_a a FULL JOIN p ON p.hash = a.hash")
def effective_sources(spark, d):
    machine = catalog_a(spark, d).select(F.col("hash").alias("audio_hash"), F.concat(F.lit("machine/"), F.col("o_orderkey").cast("string")).alias("transcript_path"))
    key = F.col("o_orderkey").cast("string")
    sha = F.sha2(key, 256)
    found = catalog_b(spark, d).where("o_orderkey % 5 = 0").select(F.concat(F.lit("p/"), key).alias("path"), F.lit("g").alias("workflow_group_id"), F.upper("hash").alias("audio_hash"), F.concat(F.lit("p"), key).alias("publication_id"), F.when(F.col("o_orderkey") % 20 == 0, "activating").otherwise("active").alias("state"), F.concat(F.lit("corrected/"), key).alias("transcript_path"), sha.alias("artifact_sha256"))
    files = catalog_b(spark, d).select(F.concat(F.lit("corrected/"), key).alias("content_path"), sha.alias("content_sha256"))
    return corrections.effective(machine, corrections.checked(found, files, "g")).drop("artifact_sha256")


@query("SELECT name, row_number() OVER (ORDER BY brand, size, lower(name), name) AS nth FROM (SELECT DISTINCT p_brand || ' size ' || p_size AS name, substr(p_brand, 7)::INT AS brand, p_size AS size FROM part)")
def names_in_order(spark, d):
    return cn.distinct_in_order(read(spark, d, "part").select(F.concat("p_brand", F.lit(" size "), F.col("p_size").cast("string"), F.lit(" ")).alias("name")), "name")


@query(_with(SEG, "o AS (SELECT audio_hash, seg_idx, model_key, start_sec FROM seg)", "s AS (SELECT audio_hash, CASE WHEN seg_idx % 6 = 5 THEN seg_idx + 100 ELSE seg_idx END AS seg_idx, model_key, start_sec FROM o WHERE seg_idx % 7 <> 3)", "b AS (SELECT *, 1 AS k FROM s UNION ALL SELECT *, -1 FROM o)") + "SELECT audio_hash, seg_idx, model_key, start_sec, CASE WHEN sum(k) > 0 THEN 'unexpected' ELSE 'missing' END AS problem, abs(sum(k))::BIGINT AS times FROM b GROUP BY ALL HAVING sum(k) <> 0")
def span_differences(spark, d):
    made = seg(spark, d).select("audio_hash", "seg_idx", "model_key", "start_sec")
    kept = made.where("seg_idx % 7 <> 3").withColumn("seg_idx", F.when(F.col("seg_idx") % 6 == 5, F.col("seg_idx") + 100).otherwise(F.col("seg_idx")))
    return ig.differences(kept, made, ["audio_hash"], ["seg_idx", "model_key", "start_sec"])


@query()
def span_texts(spark, d):
    """Each turn's text cut at its lines: the words of a line are a span's."""
    t = read(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "text", F.split("text", "\n", -1).alias("lines"))
    words = F.transform("lines", lambda line: F.regexp_extract_all(line, F.lit(r"\S+"), F.lit(0)))
    owners = F.flatten(F.transform(words, lambda ws, i: F.array_repeat(i, F.size(ws))))
    return t.select("conv_id", "turn", F.posexplode(ig.span_texts("text", F.flatten(words), owners, F.size("lines"))).alias("span", "text"))


@query()
def pause_pieces(spark, d):
    """Segments of half a minute and more cut at pauses of frames whose probability comes from the text's length."""
    s = seg(spark, d).select("audio_hash", "seg_idx", "start_sec", "end_sec")
    n = s.groupBy("audio_hash").agg(F.max("end_sec").alias("last"))
    frames = n.select("audio_hash", F.lit(0.1).alias("unit"), F.transform(F.sequence(F.lit(0), F.ceil(F.col("last") * 10).cast("int")), lambda i: F.pmod(F.floor(i / 6) * 7919 + F.length("audio_hash"), F.lit(10)) / F.lit(10.0)).alias("probs"))
    return silence.split_at_pauses(s, frames, most=10.0)


@query("WITH t AS (SELECT user_id AS player, event_id AS tick, ts, (event_id % 100) / 10.0::DOUBLE + json_extract_string(props, '$.k')::BIGINT / 50.0 AS position, 1.0 + (json_extract_string(props, '$.k')::BIGINT % 2) AS rate FROM events WHERE epoch_ms(ts) <= (SELECT epoch_ms(max(ts)) FROM events) - 10000), n AS (SELECT *, CASE WHEN position - lag(position) OVER w >= 0 AND position - lag(position) OVER w <= 1.5 * greatest(1.0, rate) AND rate = lag(rate) OVER w THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY player ORDER BY epoch_ms(ts), tick)), r AS (SELECT *, sum(new) OVER (PARTITION BY player ORDER BY epoch_ms(ts), tick ROWS UNBOUNDED PRECEDING) - 1 AS run FROM n) SELECT player, run::BIGINT AS nth, round(min(position), 6) AS start_sec, round(max(position), 6) AS end_sec, count(*) AS ticks FROM r GROUP BY player, run")
def stream_playback(spark, d):
    e = spark.readStream.schema(read(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    k = F.get_json_object("props", "$.k").cast("long")
    ticks = e.select(F.col("user_id").alias("player"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("tick"), ((F.col("event_id") % 100) / 10.0 + k / 50.0).alias("position"), (1.0 + k % 2).alias("rate"))
    folder = shared_folder(spark)
    st.to_parquet(playback.playback_steps(ticks), f"{folder}/out", f"{folder}/state", "update").awaitTermination()
    return st.latest(spark.read.parquet(f"{folder}/out"), ["player", "nth"]).withColumns({c: F.round(c, 6) for c in ("start_sec", "end_sec")})


# filters: every condition over all entries, the rows of each setting as how many they are and the sum of their keys

ENTRIES = """en AS (SELECT o_orderkey AS k, o_orderstatus <> 'P' AS is_actionable, o_orderkey % 3 <> 0 AS is_published, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 2 = 0 END AS verified, CASE WHEN o_orderkey % 11 = 0 THEN ' ' WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS artist, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 4 END AS album_id, o_orderkey * 37 % 6000 AS sec, o_orderkey % 17 = 0 AS bad, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey % 9 END AS recorder_id, CASE WHEN o_orderkey % 6 <> 0 THEN o_custkey % 25 END AS location_id, CASE WHEN o_orderkey % 8 <> 0 THEN (o_orderkey % 3)::INT END AS part, CASE WHEN o_orderkey % 9 <> 0 THEN year(o_orderdate) END AS y, CASE WHEN o_orderkey % 10 <> 0 THEN month(o_orderdate) END AS m, day(o_orderdate) AS d, o_orderkey % 4 AS dup FROM orders)"""
SETTINGS = [
    ({}, "true"),
    ({"status": "ready"}, "is_actionable AND is_published"),
    ({"status": "incomplete", "actionable_only": True}, "NOT (is_actionable AND is_published)"),
    ({"actionable_only": True}, "is_actionable"),
    ({"verified": True}, "verified"),
    ({"verified": False}, "NOT coalesce(verified, false)"),
    ({"artist": "HIGH"}, "contains(lower(artist), 'high')"),
    ({"artist": fl.EMPTY}, "coalesce(trim(artist), '') = ''"),
    ({"album": 2}, "album_id = 2"),
    ({"album": fl.EMPTY}, "album_id IS NULL"),
    ({"duration": "short"}, "NOT bad AND sec < 1800"),
    ({"duration": "medium"}, "NOT bad AND sec >= 1800 AND sec < 3600"),
    ({"duration": "long"}, "NOT bad AND sec >= 3600"),
    ({"recorder": 3, "location": fl.EMPTY}, "recorder_id = 3 AND location_id IS NULL"),
    ({"recorder": fl.EMPTY, "location": 7}, "recorder_id IS NULL AND location_id = 7"),
    ({"part": 1}, "part = 1"),
    ({"part": fl.EMPTY}, "part IS NULL"),
    ({"year": 1995}, "y = 1995"),
    ({"year": 1995, "month": 3}, "y = 1995 AND m = 3"),
    ({"year": 1995, "month": 3, "day": 8}, "y = 1995 AND m = 3 AND d = 8"),
    ({"year": 1995, "day": 8}, "y = 1995"),
    ({"month": 3}, "true"),
    ({"year": fl.EMPTY}, "y IS NULL"),
    ({"duplicates": 0}, "dup = 0"),
]


@query(_with(ENTRIES) + " UNION ALL ".join(f"SELECT {i} AS setting, count(*) AS n, coalesce(sum(k), 0)::BIGINT AS keys FROM en WHERE {cond}" for i, (_, cond) in enumerate(SETTINGS)))
def catalog_filters(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    at = k * 37 % 6000
    stamp = F.format_string("%02d:%02d:%02d", F.floor(at / 3600), F.floor(at / 60) % 60, at % 60)
    e = read(spark, d, "orders").select(
        k.alias("k"), (F.col("o_orderstatus") != "P").alias("is_actionable"), (k % 3 != 0).alias("is_published"), F.when(k % 7 != 0, k % 2 == 0).alias("verified"), F.when(k % 11 == 0, " ").when(k % 13 != 0, F.col("o_orderpriority")).alias("artist"),
        F.when(k % 5 != 0, c % 4).alias("album_id"), F.when(k % 17 == 0, "unknown").otherwise(stamp).alias("duration"), F.when(k % 4 != 0, c % 9).alias("recorder_id"), F.when(k % 6 != 0, c % 25).alias("location_id"), F.when(k % 8 != 0, (k % 3).cast("int")).alias("part"),
        F.when(k % 9 != 0, F.year("o_orderdate")).alias("date_year"), F.when(k % 10 != 0, F.month("o_orderdate")).alias("date_month"), F.dayofmonth("o_orderdate").alias("date_day"), (k % 4).alias("duplicate_count"),
    )
    out = [fl.entries(e, **want).agg(F.lit(i).alias("setting"), F.count("*").alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("keys")) for i, (want, _) in enumerate(SETTINGS)]
    for part in out[1:]:
        out[0] = out[0].unionByName(part)
    return out[0]


FOUND = """rc AS (SELECT o_orderkey AS h, o_custkey % 9 AS rec, o_orderkey % 2 = 0 AS ok FROM orders), lk AS (SELECT o_orderkey AS h, o_custkey AS ev, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS prim FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, o_custkey + 1, o_orderkey % 4 = 0 FROM orders WHERE o_orderkey % 7 = 0), ev AS (SELECT c_custkey AS ev, c_nationkey AS loc, 1990 + c_custkey % 7 AS y FROM customer)"""
_PRIMARY = "(NOT EXISTS (SELECT 1 FROM lk WHERE lk.h = rc.h) OR EXISTS (SELECT 1 FROM lk WHERE lk.h = rc.h AND prim))"
_EVENT = "EXISTS (SELECT 1 FROM lk JOIN ev USING (ev) WHERE lk.h = rc.h AND {})"
SEARCHES = [
    ({}, _PRIMARY),
    ({"secondary": True, "verified": True}, "ok"),
    ({"hashes": [1, 2, 3, 7, 14, 32]}, "h IN (1, 2, 3, 7, 14, 32)"),
    ({"event_ids": [1, 4, 7, 8]}, _PRIMARY + " AND " + _EVENT.format("ev IN (1, 4, 7, 8)")),
    ({"locations": [3, 9], "years": [1991, 1994], "secondary": True}, _EVENT.format("loc IN (3, 9) AND y IN (1991, 1994)")),
    ({"recorders": [2], "verified": False}, _PRIMARY + " AND rec = 2 AND NOT ok"),
]


@query(_with(FOUND) + " UNION ALL ".join(f"SELECT {i} AS setting, h AS audio_hash FROM rc WHERE {cond}" for i, (_, cond) in enumerate(SEARCHES)))
def search_filters(spark, d):
    o, k, c = read(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    recordings = o.select(k.alias("audio_hash"), (c % 9).alias("recorder_id"), (k % 2 == 0).alias("verified"))
    own = o.where("o_orderkey % 5 <> 0").select(k.alias("audio_hash"), c.alias("event_id"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) == 1).alias("is_primary"))
    links = own.unionByName(o.where("o_orderkey % 7 = 0").select(k.alias("audio_hash"), (c + 1).alias("event_id"), (k % 4 == 0).alias("is_primary")))
    events = read(spark, d, "customer").select(F.col("c_custkey").alias("event_id"), F.col("c_nationkey").alias("location_id"), (1990 + F.col("c_custkey") % 7).alias("date_year"))
    out = [fl.searchable(recordings, links, events, **want).select(F.lit(i).alias("setting"), "audio_hash") for i, (want, _) in enumerate(SEARCHES)]
    for part in out[1:]:
        out[0] = out[0].unionByName(part)
    return out[0]


# corpora, reports, schedules


@query(_with(SEG, "w AS (SELECT audio_hash, seg_idx, start_sec + 0.25 AS ws, start_sec + 0.75 AS we FROM seg WHERE model_key = 'user')") + "SELECT w.audio_hash, w.seg_idx, (SELECT arg_min(model_key, {'s': start_sec, 'e': end_sec, 'm': model_key}) FROM seg t WHERE t.audio_hash = w.audio_hash AND t.end_sec >= t.start_sec AND start_sec <= ws + 1e-6 AND end_sec >= we - 1e-6) AS speaker FROM w")
def word_speakers(spark, d):
    s = seg(spark, d)
    words = s.where("model_key = 'user'").select("audio_hash", "seg_idx", (F.col("start_sec") + 0.25).alias("word_start"), (F.col("start_sec") + 0.75).alias("word_end"))
    turns = s.select("audio_hash", "start_sec", "end_sec", F.col("model_key").alias("speaker"))
    return al.word_speakers(words, turns, ["audio_hash"]).select("audio_hash", "seg_idx", "speaker")


@query("SELECT r_regionkey, r_name, coalesce((SELECT to_json(list({'n_nationkey': n_nationkey, 'n_name': n_name} ORDER BY n_nationkey))::VARCHAR FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey % 4 = 3), '[]') AS items FROM region")
def nested_export(spark, d):
    children = read(spark, d, "nation").where("n_nationkey % 4 = 3").withColumnRenamed("n_regionkey", "r_regionkey")
    return ct.nested(read(spark, d, "region").select("r_regionkey", "r_name"), children, "r_regionkey", "n_nationkey", ["n_nationkey", "n_name"])


@query("SELECT n_name AS location, count(c_custkey) AS events FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 5000 GROUP BY n_name")
def events_per_location(spark, d):
    c = read(spark, d, "customer").where("c_acctbal > 5000")
    return read(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy(F.col("n_name").alias("location")).agg(F.count("c_custkey").alias("events"))


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) // 64 AS batch FROM orders")
def batch_windows(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return ct.batches(o, [F.col("o_totalprice"), F.col("o_orderkey")], 64).select("o_orderkey", "batch")


@query("SELECT event_type, " + ", ".join(f"count(*) FILTER (ts >= {start}) AS n_{name}" for name, start in (("24h", "last - INTERVAL 24 HOUR"), ("7d", "last - INTERVAL 168 HOUR"), ("30d", "last - INTERVAL 720 HOUR"), ("12m", "date_trunc('day', last) - INTERVAL 12 MONTH"))) + " FROM events, (SELECT max(ts) AS last FROM events) GROUP BY event_type")
def period_counts(spark, d):
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("last"))))  # one row
    return e.groupBy("event_type").agg(*[F.count_if(F.col("ts") >= tm.period_start(p, F.col("last"))).alias(f"n_{p}") for p in tm.PERIODS])


@query("WITH h AS (SELECT o_orderkey, o_orderdate, sha256(o_orderkey::VARCHAR) AS x FROM orders), t AS (SELECT o_orderkey, o_orderdate, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(x, ''), lambda c: (strpos('0123456789abcdef', c) - 1)::BIGINT)), lambda a, b: (a * 16 + b) % 7) AS turn FROM h) SELECT o_orderkey, turn = (date_diff('day', DATE '0001-01-01', o_orderdate::DATE) + 1) % 7 AS due FROM t")
def hash_schedule(spark, d):
    return read(spark, d, "orders").select("o_orderkey", tm.due(F.col("o_orderkey"), 7, F.to_date("o_orderdate")).alias("due"))


def _rows(spark, d):
    """Chunks with a text, what a machine heard and what a system made of it."""
    t = read(spark, d, "conversations").withColumn("k", F.col("conv_id") * 1000 + F.col("turn"))
    loud = F.upper(F.substring("text", 1, 20))
    return t.select(F.concat(F.lit("audio/"), F.col("k").cast("string")).alias("audio"), "text", F.when(F.col("k") % 5 != 0, F.concat(loud, F.expr("substring(text, 21)"))).alias("machine_text"), (F.length("text") / 20.0).alias("duration"), F.replace("text", F.lit("the "), F.lit("")).alias("one"), F.replace("text", F.lit("e"), F.lit("a")).alias("two"))


@query()
def asr_comparison(spark, d):
    rows = _rows(spark, d)
    return asr.compared(asr.report(rows, "one", "one").unionByName(asr.report(rows, "two", "two")))


@query()
def chunk_corpus(spark, d):
    s = seg(spark, d).where("model_key = 'assistant'").groupBy("audio_hash").agg(F.sort_array(F.collect_list(F.struct(F.col("start_sec").alias("start"), F.col("end_sec").alias("end"), "text"))).alias("segments"))
    odd = F.substring("audio_hash", 1, 1).isin("0", "1")
    t = s.select(F.when(odd, "short").otherwise(F.col("audio_hash")).alias("audio_hash"), F.concat(F.lit("w/"), F.col("audio_hash")).alias("path"), "segments")
    return cp.build(t, "archive", "assistant", "v1", count=chunking.count_tokens)[1]

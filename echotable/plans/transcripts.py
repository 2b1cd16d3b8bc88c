"""Queries on transcripts, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import transcripts as tr
from ..sources.adapters import DOCSEG, SEG, docseg, seg

R = "audio_hash"
ISLANDS = """isl AS (SELECT *, sum(new) OVER (PARTITION BY audio_hash ORDER BY start_sec, end_sec ROWS UNBOUNDED PRECEDING) AS island FROM (
 SELECT *, CASE WHEN max(end_sec) OVER w IS NULL OR start_sec > max(end_sec) OVER w + {tol} THEN 1 ELSE 0 END AS new FROM seg {where}
 WINDOW w AS (PARTITION BY audio_hash ORDER BY start_sec, end_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""
POINTS = """pt AS (SELECT audio_hash, lo, lead(lo) OVER (PARTITION BY audio_hash ORDER BY lo) AS hi FROM (SELECT DISTINCT audio_hash, lo FROM (SELECT audio_hash, start_sec AS lo FROM seg UNION ALL SELECT audio_hash, end_sec FROM seg {seed})))"""
STRETCH = "st AS (SELECT * FROM pt WHERE hi - lo > {least})"
COVER = """cov AS (SELECT s.audio_hash, lo, hi, list_sort(list(DISTINCT model_key)) AS sources, count(DISTINCT model_key) AS degree FROM st s JOIN seg g ON g.audio_hash = s.audio_hash AND g.start_sec <= lo + 1e-6 AND g.end_sec >= hi - 1e-6 GROUP BY ALL)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


Q, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(_with(SEG, ISLANDS.format(tol="1e-6", where="WHERE end_sec > start_sec")) + "SELECT audio_hash, round(sum(e - s), 6) AS covered_sec, count(*) AS n_islands FROM (SELECT audio_hash, island, min(start_sec) AS s, max(end_sec) AS e FROM isl GROUP BY ALL) GROUP BY audio_hash")
def interval_union_coverage(spark, d):
    u = iv.union(seg(spark, d), [R])
    return u.groupBy(R).agg(F.round(F.sum(F.col("end_sec") - F.col("start_sec")), 6).alias("covered_sec"), F.count("*").alias("n_islands"))


@query(_with(SEG, ISLANDS.format(tol="1e-3", where="")) + "SELECT audio_hash, min(start_sec) AS start_sec, max(end_sec) AS end_sec, count(*) AS n_merged FROM isl GROUP BY audio_hash, island")
def span_union_loose(spark, d):
    return iv.union(seg(spark, d), [R], tolerance=1e-3, drop_empty=False)


@query(_with(SEG, POINTS.format(seed="UNION ALL SELECT audio_hash, 0.0 FROM seg"), STRETCH.format(least="1e-3")) + "SELECT audio_hash, round(lo, 3) AS lo, round(hi, 3) AS hi FROM st")
def boundary_timeline(spark, d):
    return iv.timeline(seg(spark, d), [R], seed=0.0, digits=3, least=1e-3)


@query(_with(SEG, POINTS.format(seed=""), STRETCH.format(least="0")) + "SELECT s.audio_hash, lo, hi, model_key, count(*) AS n, round(sum(least(hi, end_sec) - greatest(lo, start_sec)), 6) AS shared_sec FROM st s JOIN seg g ON g.audio_hash = s.audio_hash AND end_sec > lo AND start_sec < hi GROUP BY ALL")
def interval_overlap_join(spark, d):
    s = seg(spark, d)
    j = iv.overlapping(iv.timeline(s, [R]), s, [R])
    return j.groupBy(R, "lo", "hi", "model_key").agg(F.count("*").alias("n"), F.round(F.sum(iv.shared_length(F.col("lo"), F.col("hi"), F.col("start_sec"), F.col("end_sec"))), 6).alias("shared_sec"))


@query(_with(SEG, POINTS.format(seed=""), STRETCH.format(least="0"), COVER) + "SELECT audio_hash, lo, hi, array_to_string(sources, ',') AS sources, degree FROM cov")
def interval_containment_join(spark, d):
    return iv.covered(seg(spark, d), [R], "model_key").withColumn("sources", F.array_join("sources", ","))


@query(_with(SEG, POINTS.format(seed=""), STRETCH.format(least="0"), COVER) + "SELECT audio_hash, " + ", ".join(f"round(coalesce(sum(CASE WHEN degree = {k} THEN hi - lo END), 0), 6) AS seconds_{k}, count(CASE WHEN degree = {k} THEN 1 END) AS count_{k}" for k in (1, 2, 3)) + ", round(sum(hi - lo), 6) AS covered FROM cov GROUP BY audio_hash")
def coverage_stats(spark, d):
    out = iv.coverage_stats(iv.covered(seg(spark, d), [R], "model_key"), [R])
    return out.withColumns({c: F.round(c, 6) for c in ("seconds_1", "seconds_2", "seconds_3", "covered")})


@query(_with(SEG, POINTS.format(seed=""), STRETCH.format(least="0"), COVER, "r AS (SELECT *, CASE WHEN lag(sources) OVER w = sources AND lo - lag(hi) OVER w < 1e-2 THEN 0 ELSE 1 END AS new FROM cov WINDOW w AS (PARTITION BY audio_hash ORDER BY lo))", "q AS (SELECT *, sum(new) OVER (PARTITION BY audio_hash ORDER BY lo ROWS UNBOUNDED PRECEDING) AS run FROM r)") + "SELECT audio_hash, array_to_string(any_value(sources), ',') AS sources, min(lo) AS lo, max(hi) AS hi, count(*) AS n_merged FROM q GROUP BY audio_hash, run")
def merge_adjacent_intervals(spark, d):
    return iv.merge_adjacent(iv.covered(seg(spark, d), [R], "model_key"), [R]).withColumn("sources", F.array_join("sources", ","))


@query(_with(SEG, "b AS (SELECT model_key, (CASE " + " ".join(f"WHEN end_sec - start_sec >= {e} THEN {i}" for i, e in reversed(list(enumerate(iv.BUCKETS)))) + " ELSE 0 END)::BIGINT AS bucket FROM seg)") + "SELECT m.model_key, r.bucket, count(b.bucket) AS n FROM (SELECT DISTINCT model_key FROM seg) m CROSS JOIN (SELECT range AS bucket FROM range(8)) r LEFT JOIN b ON b.model_key = m.model_key AND b.bucket = r.bucket GROUP BY ALL")
def duration_histogram(spark, d):
    return iv.histogram(seg(spark, d), ["model_key"], F.col("end_sec") - F.col("start_sec"))


@query(_with(SEG) + "SELECT model_key, " + ", ".join(f"round(quantile_cont(l, {p / 100}), 6) AS p{p}" for p in iv.PERCENTS) + ", min(l) AS least, max(l) AS most, round(avg(l), 6) AS mean, count(*) AS n FROM (SELECT model_key, end_sec - start_sec AS l FROM seg) WHERE l > 0 GROUP BY model_key")
def duration_percentiles(spark, d):
    s = seg(spark, d).withColumn("l", F.col("end_sec") - F.col("start_sec"))
    return iv.percentiles(s, ["model_key"], "l").withColumns({c: F.round(c, 6) for c in [*(f"p{p}" for p in iv.PERCENTS), "mean"]})


@query(_with(SEG, ISLANDS.format(tol="0.5", where="WHERE end_sec > start_sec")) + "SELECT audio_hash, min(start_sec) AS start_sec, max(end_sec) AS end_sec, array_to_string(list_sort(list(DISTINCT model_key)), ',') AS models, count(*) AS n_events FROM isl GROUP BY audio_hash, island HAVING count(DISTINCT model_key) >= 2")
def event_windows(spark, d):
    e = seg(spark, d).where("end_sec > start_sec").withColumn("models", F.array("model_key"))
    return iv.windows_of_models(e, [R], 0.5, 2).withColumn("models", F.array_join("models", ","))


@query(_with(SEG, POINTS.format(seed="UNION ALL SELECT audio_hash, 0.0 FROM seg"), STRETCH.format(least="1e-3"), "t AS (SELECT s.audio_hash, lo, hi, model_key, trim(lower(string_agg(g.text, ' ' ORDER BY start_sec, seg_idx))) AS said FROM st s JOIN seg g ON g.audio_hash = s.audio_hash AND end_sec > lo AND start_sec < hi GROUP BY ALL)", "e AS (SELECT audio_hash, lo, hi, count(*) AS models, count(DISTINCT said) AS versions FROM t GROUP BY ALL)") + "SELECT audio_hash, count(*) FILTER (models >= 2 AND versions = 1) AS agreements, count(*) FILTER (models >= 2 AND versions > 1) AS disagreements, round(coalesce(sum(hi - lo) FILTER (models >= 2 AND versions = 1), 0), 6) AS agreed_sec, round(coalesce(sum(hi - lo) FILTER (models >= 2 AND versions > 1), 0), 6) AS disagreed_sec FROM e GROUP BY audio_hash")
def compare_models(spark, d):
    return tr.compare(seg(spark, d)).withColumns({c: F.round(c, 6) for c in ("agreed_sec", "disagreed_sec")})


@query(_with(SEG, "m AS (SELECT audio_hash, 'all' AS model_key, seg_idx, CASE WHEN seg_idx % 5 = 4 THEN start_sec - 7 ELSE start_sec END AS start_sec, CASE WHEN seg_idx % 7 = 6 THEN start_sec - 8 ELSE end_sec END AS end_sec, CASE WHEN seg_idx % 3 = 2 THEN ' ' ELSE text END AS text FROM seg)", "v AS (SELECT *, end_sec > start_sec AS good FROM m)", "w AS (SELECT *, last_value(CASE WHEN good THEN start_sec END IGNORE NULLS) OVER p AS ps, max(CASE WHEN good THEN end_sec END) OVER p AS pe FROM v WINDOW p AS (PARTITION BY audio_hash, model_key ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))", "c AS (SELECT audio_hash, model_key, count(*) AS segments, count(*) FILTER (trim(text) = '') AS empty_text, count(*) FILTER (NOT good) AS bad_times, count(*) FILTER (good AND start_sec < ps - 1e-6) AS not_monotone, count(*) FILTER (good AND start_sec < pe - 1e-3) AS crossings FROM w GROUP BY ALL)") + "SELECT *, greatest(0, 100 - 5 * empty_text - 20 * bad_times - 10 * not_monotone - 5 * crossings)::BIGINT AS score, CASE WHEN bad_times > 0 THEN 'high' WHEN not_monotone + crossings > 0 THEN 'medium' WHEN empty_text > 0 THEN 'low' ELSE 'none' END AS severity FROM c")
def validate_transcripts(spark, d):
    i = F.col("seg_idx")
    s = seg(spark, d)
    s = s.select("audio_hash", F.lit("all").alias("model_key"), "seg_idx", F.when(i % 5 == 4, F.col("start_sec") - 7).otherwise(F.col("start_sec")).alias("start_sec"), F.when(i % 7 == 6, F.col("start_sec") - 8).otherwise(F.col("end_sec")).alias("end_sec"), F.when(i % 3 == 2, " ").otherwise(F.col("text")).alias("text"))
    return tr.validate(s)


_TS = "printf('%02d:%02d:%02d{p}%03d', ms({c}) // 3600000, ms({c}) // 60000 % 60, ms({c}) // 1000 % 60, ms({c}) % 1000)"


def _stamp(c: str, p: str) -> str:
    ms = f"greatest(0, round_even({c} * 1000, 0))::BIGINT"
    return _TS.format(c="@", p=p).replace("ms(@)", f"({ms})")


_NTH = "n AS (SELECT *, row_number() OVER (PARTITION BY audio_hash, model_key ORDER BY start_sec, seg_idx) AS nth FROM seg WHERE trim(text) <> '' AND end_sec > start_sec)"


@query(_with(SEG, _NTH) + f"SELECT audio_hash, model_key, string_agg(nth::VARCHAR || chr(10) || {_stamp('start_sec', ',')} || ' --> ' || {_stamp('end_sec', ',')} || chr(10) || text, chr(10) || chr(10) ORDER BY nth) || chr(10) AS body FROM n GROUP BY ALL")
def subtitles_srt(spark, d):
    return tr.subtitles(seg(spark, d), "srt")


@query(_with(SEG, _NTH) + f"SELECT audio_hash, model_key, 'WEBVTT' || chr(10) || chr(10) || string_agg({_stamp('start_sec', '.')} || ' --> ' || {_stamp('end_sec', '.')} || chr(10) || text, chr(10) || chr(10) ORDER BY nth) || chr(10) AS body FROM n GROUP BY ALL")
def subtitles_vtt(spark, d):
    return tr.subtitles(seg(spark, d), "vtt")


@query(_with(SEG) + "SELECT audio_hash, model_key, string_agg(text, chr(10) ORDER BY start_sec, seg_idx) || chr(10) AS body FROM seg WHERE trim(text) <> '' GROUP BY ALL")
def transcript_txt(spark, d):
    return tr.subtitles(seg(spark, d), "txt")


@query(_with(SEG, "p AS (SELECT *, row_number() OVER w AS nth, sum(length(full_text)) OVER w AS chars FROM seg WHERE end_sec > 4 AND start_sec < 40 WINDOW w AS (PARTITION BY audio_hash ORDER BY start_sec, seg_idx ROWS UNBOUNDED PRECEDING))") + "SELECT audio_hash, seg_idx, nth, chars::BIGINT AS chars FROM p WHERE chars <= 500 OR nth = 1")
def transcript_page(spark, d):
    s = seg(spark, d).withColumn("text", F.col("full_text"))
    return tr.page(s, 4, 40, 500).select(R, "seg_idx", F.col("nth").cast("long").alias("nth"), "chars")


@query(_with(DOCSEG, "s AS (SELECT doc_id, pos, regexp_replace(lower(trim(line, ' ')), '\\s+', ' ', 'g') AS said FROM docseg)", "r AS (SELECT *, CASE WHEN lag(said) OVER w = said THEN 0 ELSE 1 END AS new FROM s WHERE said <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos))", "q AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM r)") + "SELECT doc_id, any_value(said) AS said, min(pos) AS first, count(*) AS n FROM q GROUP BY doc_id, run HAVING count(*) >= 2")
def adjacent_line_repeats(spark, d):
    return tr.adjacent_repeats(docseg(spark, d), ["doc_id"], "line", "pos")


@query(_with(SEG, r"w AS (SELECT *, string_split_regex(trim(full_text), '\s+') AS ws FROM seg WHERE end_sec > start_sec)", "x AS (SELECT *, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM w)") + "SELECT audio_hash, model_key, seg_idx, i::BIGINT AS i, word, floor((start_sec + (end_sec - start_sec) / n * i) * 1000 + 0.37137)::BIGINT AS start_ms, floor(CASE WHEN i = n - 1 THEN end_sec ELSE start_sec + (end_sec - start_sec) / n * (i + 1) END * 1000 + 0.37137)::BIGINT AS end_ms FROM x")
def interpolated_words(spark, d):
    words = tr.interpolated_words(seg(spark, d).withColumn("text", F.col("full_text")))
    ms = lambda c: F.floor(F.col(c) * 1000 + 0.37137)
    return words.select(R, "model_key", "seg_idx", "i", "word", ms("word_start").alias("start_ms"), ms("word_end").alias("end_ms"))


@query(_with(SEG, "x AS (SELECT *, unnest(range(0, greatest(1, ceil((end_sec - start_sec) / 4.0))::BIGINT)) AS i FROM seg WHERE end_sec > start_sec)") + "SELECT audio_hash, model_key, seg_idx, i, start_sec + i * 4.0 AS piece_start, least(end_sec, start_sec + (i + 1) * 4.0) AS piece_end FROM x")
def split_long_segments(spark, d):
    return tr.split_long(seg(spark, d), 4.0)


@query(_with(SEG) + "SELECT audio_hash, 'timed' AS rule, count(*) AS n, round(sum(end_sec - start_sec), 6) AS sec FROM seg WHERE end_sec > start_sec GROUP BY ALL UNION ALL SELECT audio_hash, 'worded', count(*), round(sum(end_sec - start_sec), 6) FROM seg WHERE trim(text) <> '' GROUP BY ALL UNION ALL SELECT audio_hash, 'chunkable', count(*), round(sum(greatest(end_sec, start_sec) - start_sec), 6) FROM seg WHERE trim(text) <> '' GROUP BY ALL")
def segment_extractions(spark, d):
    s, out = seg(spark, d), None
    for rule, f in (("timed", tr.segments_timed), ("worded", tr.segments_worded), ("chunkable", tr.segments_chunkable)):
        part = f(s).groupBy(R).agg(F.lit(rule).alias("rule"), F.count("*").alias("n"), F.round(F.sum(F.col("end_sec") - F.col("start_sec")), 6).alias("sec"))
        out = part if out is None else out.unionByName(part)
    return out

"""Queries on repeats, hotspots of several models and replacements, each with its SQL for DuckDB where that can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import alignment as al
from ..operators import kernels
from ..operators import repeats as rp
from ..sources.adapters import TAKES, read, takes

Q, SQL = {}, {}
R = "audio_hash"


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# every pair of two models, by the conditions alone
NEAR = """near AS (SELECT audio_hash, model_a, model_b, CASE WHEN sh > sl THEN sl WHEN sh + 0.75 > sl - 0.75 THEN sl - 0.75 ELSE least(s_a, s_b) END AS lo, CASE WHEN sh > sl THEN sh WHEN sh + 0.75 > sl - 0.75 THEN sh + 0.75 ELSE greatest(e_a, e_b) END AS hi
 FROM (SELECT a.audio_hash, a.model_key AS model_a, b.model_key AS model_b, a.start_sec AS s_a, a.end_sec AS e_a, b.start_sec AS s_b, b.end_sec AS e_b, greatest(a.start_sec, b.start_sec) AS sl, least(a.end_sec, b.end_sec) AS sh FROM {spans} a JOIN {spans} b ON a.audio_hash = b.audio_hash AND a.model_key < b.model_key)
 WHERE sh > sl OR (abs((s_a + e_a) / 2 - (s_b + e_b) / 2) <= 0.75 AND greatest(e_a - s_a, e_b - s_b, 0) / greatest(least(greatest(e_a - s_a, 0), greatest(e_b - s_b, 0)), 1e-6) <= 3))"""
TWICE = """nb AS (SELECT *, lower(trim(text, ' ')) AS t, lead(lower(trim(text, ' '))) OVER w AS nt, lead(end_sec) OVER w AS ne FROM takes WHERE end_sec > start_sec WINDOW w AS (PARTITION BY audio_hash, model_key ORDER BY start_sec, end_sec, seg_idx)),
 rs AS (SELECT audio_hash, model_key, start_sec, ne AS end_sec FROM nb WHERE t <> '' AND t = nt),
 rn AS (SELECT *, CASE WHEN start_sec <= max(end_sec) OVER (PARTITION BY audio_hash, model_key ORDER BY start_sec, end_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-3 THEN 0 ELSE 1 END AS new FROM rs),
 ri AS (SELECT *, sum(new) OVER (PARTITION BY audio_hash, model_key ORDER BY start_sec, end_sec ROWS UNBOUNDED PRECEDING) AS island FROM rn),
 spans AS (SELECT audio_hash, model_key, min(start_sec) AS start_sec, max(end_sec) AS end_sec FROM ri GROUP BY audio_hash, model_key, island)"""
HOT = """ev AS (SELECT * FROM near WHERE hi > lo),
 hn AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY audio_hash ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.75 THEN 0 ELSE 1 END AS new FROM ev),
 hg AS (SELECT *, sum(new) OVER (PARTITION BY audio_hash ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM hn),
 hm AS (SELECT audio_hash, island, min(lo) AS lo, max(hi) AS hi, count(*) AS pair_matches, list_sort(list_distinct(flatten(list([model_a, model_b])))) AS models FROM hg GROUP BY ALL),
 hot AS (SELECT audio_hash, round(lo, 3) AS start_time, round(hi, 3) AS end_time, round(hi - lo, 3) AS duration, models, len(models) AS model_count, pair_matches FROM hm WHERE len(models) >= 2),
 hotspot AS (SELECT *, row_number() OVER (PARTITION BY audio_hash ORDER BY model_count DESC, duration DESC, pair_matches DESC, start_time) AS nth FROM hot)"""


@query(_with(TAKES, NEAR.format(spans="takes")) + "SELECT audio_hash, model_a, model_b, round(lo, 6) AS lo, round(hi, 6) AS hi FROM near WHERE hi > lo")
def span_near_matches(spark, d):
    return rp.near_matches(takes(spark, d), [R]).withColumns({c: F.round(c, 6) for c in ("lo", "hi")})


@query(_with(TAKES, TWICE) + "SELECT audio_hash, model_key, round(start_sec, 6) AS start_sec, round(end_sec, 6) AS end_sec FROM spans")
def repeated_spans(spark, d):
    return rp.repeated_spans(takes(spark, d), [R, "model_key"]).withColumns({c: F.round(c, 6) for c in ("start_sec", "end_sec")})


def _hotspots(spark, d):
    spans = rp.repeated_spans(takes(spark, d), [R, "model_key"])
    return rp.hotspots(rp.near_matches(spans, [R]), [R]), spans


@query(_with(TAKES, TWICE, NEAR.format(spans="spans"), HOT) + "SELECT audio_hash, start_time, end_time, duration, array_to_string(models, ',') AS models, model_count, pair_matches, nth FROM hotspot")
def cross_model_hotspots(spark, d):
    return _hotspots(spark, d)[0].withColumn("models", F.array_join("models", ","))


@query(_with(TAKES, TWICE, NEAR.format(spans="spans"), HOT, "m AS (SELECT audio_hash, count(DISTINCT model_key) AS k FROM spans GROUP BY audio_hash HAVING count(DISTINCT model_key) >= 2)", "p AS (SELECT m.audio_hash, count(nth) AS n, count(*) FILTER (model_count = k) AS every FROM m LEFT JOIN hotspot USING (audio_hash) GROUP BY m.audio_hash)") + "SELECT count(*) AS compared, count(*) FILTER (n > 0) AS with_hotspots, coalesce(sum(n), 0)::BIGINT AS hotspots, coalesce(sum(every), 0)::BIGINT AS all_models FROM p")
def hotspot_summary(spark, d):
    found, spans = _hotspots(spark, d)
    return rp.hotspot_summary(found, spans, [R])


@query(_with(TAKES, TWICE, NEAR.format(spans="spans"), HOT, "x AS (SELECT h.audio_hash, t.model_key, trim(regexp_replace(string_agg(trim(t.text), ' ' ORDER BY t.start_sec, t.end_sec, t.seg_idx), '\\s+', ' ', 'g')) AS said FROM hotspot h JOIN takes t ON t.audio_hash = h.audio_hash AND t.end_sec > h.start_time AND t.start_sec < h.end_time AND t.end_sec > t.start_sec AND list_contains(h.models, t.model_key) WHERE nth = 1 AND trim(t.text) <> '' GROUP BY ALL)") + "SELECT audio_hash, model_key, CASE WHEN length(said) > 180 THEN rtrim(substr(said, 1, 179)) || '…' ELSE said END AS snippet FROM x")
def hotspot_snippets(spark, d):
    return rp.hotspot_texts(_hotspots(spark, d)[0], takes(spark, d), [R])


@query(r"WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '\s*\S+')) AS part, generate_subscripts(regexp_extract_all(text, '\s*\S+'), 1) AS i FROM documents), w AS (SELECT doc_id, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS e, length(regexp_replace(part, '^\s+', '')) AS n FROM p) SELECT doc_id, count(*) AS words, sum(e - n)::BIGINT AS starts, sum(e)::BIGINT AS ends FROM w GROUP BY doc_id")
def word_places(spark, d):
    w = rp.word_offsets(read(spark, d, "documents"), ["doc_id"])
    return w.groupBy("doc_id").agg(F.count("*").alias("words"), F.sum("char_start").alias("starts"), F.sum("char_end").alias("ends"))


def _doubled(spark, d):
    """Character spans of words said twice running, in the whole text of each model."""
    return rp.doubled_words(takes(spark, d), [R, "model_key"])


OFFSETS = """off AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY audio_hash, model_key ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_lo FROM takes),
 pt AS (SELECT audio_hash, model_key, seg_idx, char_lo, unnest(regexp_extract_all(text, '\\s*\\S+')) AS part, generate_subscripts(regexp_extract_all(text, '\\s*\\S+'), 1) AS i FROM off),
 wd AS (SELECT audio_hash, model_key, seg_idx, i - 1 AS word_idx, regexp_replace(part, '^\\s+', '') AS word, char_lo + sum(length(part)) OVER (PARTITION BY audio_hash, model_key, seg_idx ORDER BY i ROWS UNBOUNDED PRECEDING) AS b FROM pt),
 wn AS (SELECT *, b - length(word) AS a, lead(word) OVER v AS nw, lead(b) OVER v AS nb FROM wd WINDOW v AS (PARTITION BY audio_hash, model_key ORDER BY b)),
 dbl AS (SELECT audio_hash, model_key, a::BIGINT AS char_start, nb::BIGINT AS char_end FROM wn WHERE word = nw)"""


@query(_with(TAKES, OFFSETS) + "SELECT audio_hash, model_key, char_start, char_end, seg_idx, round(ts, 6) AS time_start, round(te, 6) AS time_end FROM (SELECT d.*, o.seg_idx, start_sec + (greatest(char_start, char_lo) - char_lo) / length(text) * (end_sec - start_sec) AS ts, start_sec + (least(char_end, char_lo + length(text)) - char_lo) / length(text) * (end_sec - start_sec) AS te FROM dbl d JOIN off o ON o.audio_hash = d.audio_hash AND o.model_key = d.model_key AND char_start < char_lo + length(text) AND char_end > char_lo AND end_sec > start_sec) WHERE te > ts")
def doubled_word_times(spark, d):
    out = rp.time_spans(_doubled(spark, d), takes(spark, d), [R, "model_key"])
    return out.withColumns({c: F.round(c, 6) for c in ("time_start", "time_end")})


def _words(spark, d):
    t = takes(spark, d).withColumn("ws", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    w = t.select(R, "model_key", "seg_idx", F.posexplode("ws").alias("word_idx", "word"))
    return w.withColumn("confidence", ((F.col("word_idx") * 37 + F.col("seg_idx") * 11) % 100) / F.lit(100.0))


# the first word whose first place in its segment covers the sampled character, or the segment's first
AT = """ps AS (SELECT audio_hash, model_key, char_start, char_end, unnest(range(char_start, char_end, greatest(1, (char_end - char_start) // 25))) AS p FROM dbl),
 hit AS (SELECT ps.*, o.seg_idx, (SELECT coalesce(min(w.word_idx) FILTER (p >= char_lo + strpos(o.text, w.word) - 1 AND p < char_lo + strpos(o.text, w.word) - 1 + length(w.word)), min(w.word_idx)) FROM wd w WHERE w.audio_hash = o.audio_hash AND w.model_key = o.model_key AND w.seg_idx = o.seg_idx) AS word_idx FROM ps JOIN off o ON o.audio_hash = ps.audio_hash AND o.model_key = ps.model_key AND p >= char_lo AND p < char_lo + length(text)),
 sp AS (SELECT audio_hash, model_key, char_start, char_end, count(*) AS n, avg((word_idx * 37 + seg_idx * 11) % 100 / 100.0::DOUBLE) AS mean, min((word_idx * 37 + seg_idx * 11) % 100 / 100.0::DOUBLE) AS least, max((word_idx * 37 + seg_idx * 11) % 100 / 100.0::DOUBLE) AS most FROM hit WHERE word_idx IS NOT NULL GROUP BY ALL)"""


@query(_with(TAKES, OFFSETS, AT) + "SELECT audio_hash, model_key, char_start, char_end, n, round(mean, 6) AS mean, least, most FROM sp")
def sampled_confidences(spark, d):
    out = rp.span_confidences(_doubled(spark, d), takes(spark, d), _words(spark, d), [R, "model_key"])
    return out.withColumn("mean", F.round("mean", 6))


@query(_with(TAKES, OFFSETS, AT, "bl AS (SELECT audio_hash, model_key, avg((word_idx * 37 + seg_idx * 11) % 100 / 100.0::DOUBLE) AS baseline FROM wd GROUP BY ALL)", "rp AS (SELECT audio_hash, model_key, count(*) AS spans, avg(mean) AS repeated FROM sp GROUP BY ALL)") + "SELECT audio_hash, model_key, spans, round(repeated, 6) AS repeated, round(baseline, 6) AS baseline, round(repeated - baseline, 6) AS difference FROM rp JOIN bl USING (audio_hash, model_key)")
def repetition_confidence(spark, d):
    words = _words(spark, d)
    sampled = rp.span_confidences(_doubled(spark, d), takes(spark, d), words, [R, "model_key"])
    return rp.confidence_difference(sampled, words, [R, "model_key"]).withColumns({c: F.round(c, 6) for c in ("repeated", "baseline", "difference")})


@query()
def patch_candidates(spark, d):
    return rp.patch_candidates(takes(spark, d), [R])


@query()
def repetition_totals(spark, d):
    """How much each model repeats itself, over the texts of its transcripts."""
    t = takes(spark, d)
    lines = F.sort_array(F.collect_list(F.struct("seg_idx", "text")))["text"]
    texts = t.groupBy(R, "model_key").agg(F.array_join(lines, "\n").alias("text")).withColumn("key", F.concat_ws("/", R, "model_key"))
    found = kernels.scores(kernels.repetitions(texts, key="key"), "key")
    scored = texts.select(F.col("key").alias("k"), "model_key", F.length("text").alias("chars")).join(found, F.col("k") == F.col("key"), "left")
    return kernels.model_totals(scored, "model_key").withColumn("ratio", F.round("ratio", 6))


# words of two models


def _timed(segments):
    """The words of segments, evenly timed over them."""
    t = segments.where("end_sec > start_sec").withColumn("ws", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    w = t.select(R, "model_key", "start_sec", ((F.col("end_sec") - F.col("start_sec")) / F.nullif(F.size("ws"), F.lit(0))).alias("step"), F.posexplode("ws").alias("i", "word"))
    return w.select(R, "model_key", "word", (F.col("start_sec") + F.col("step") * F.col("i")).alias("word_start"), (F.col("start_sec") + F.col("step") * (F.col("i") + 1)).alias("word_end"))


WORDS = """wl AS (SELECT audio_hash, model_key, start_sec, end_sec, regexp_extract_all(text, '\\S+') AS ws FROM takes WHERE end_sec > start_sec),
 wt AS (SELECT audio_hash, model_key, start_sec, (end_sec - start_sec) / len(ws) AS step, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM wl WHERE len(ws) > 0),
 wo AS (SELECT audio_hash, model_key, word, start_sec + step * i AS s, start_sec + step * (i + 1) AS e FROM wt),
 wa AS (SELECT *, row_number() OVER (PARTITION BY audio_hash ORDER BY s, e, word) - 1 AS n FROM wo WHERE model_key = 'plain'),
 wb AS (SELECT *, row_number() OVER (PARTITION BY audio_hash ORDER BY s, e, word) - 1 AS n FROM wo WHERE model_key = 'lossy')"""
# word by word, with the words taken so far
GREEDY = """ct AS (SELECT * FROM (SELECT audio_hash, n, b, sum(b) OVER (PARTITION BY audio_hash ORDER BY t, b ROWS UNBOUNDED PRECEDING) AS j FROM (SELECT audio_hash, n, 0 AS b, s - 0.15 AS t FROM wa UNION ALL SELECT audio_hash, NULL, 1, s FROM wb)) WHERE b = 0),
 cd AS (SELECT wa.audio_hash, wa.n, list({'score': abs(wa.s - wb.s) + abs(wa.e - wb.e), 'k': wb.n, 'same': (trim(lower(wa.word), '.,!?"''„():;[]{}<>…-–—') = trim(lower(wb.word), '.,!?"''„():;[]{}<>…-–—'))::INT}) AS cs FROM wa JOIN ct ON ct.audio_hash = wa.audio_hash AND ct.n = wa.n JOIN (SELECT *, unnest([n - 1, n, n + 1]) AS at_j FROM wb) wb ON wb.audio_hash = wa.audio_hash AND at_j = j AND abs(wa.s - wb.s) <= 0.15 AND abs(wa.e - wb.e) <= 0.15 GROUP BY ALL),
 ix AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY audio_hash ORDER BY n) AS r FROM cd),
 st AS (SELECT DISTINCT audio_hash, 0::BIGINT AS r, []::BIGINT[] AS used, 0::BIGINT AS m, 0::BIGINT AS same FROM wo
  UNION ALL SELECT audio_hash, r, CASE WHEN best IS NULL THEN used ELSE list_append(list_filter(used, lambda u: u >= best.k - 3), best.k) END, m + (best IS NOT NULL)::BIGINT, same + coalesce(best.same, 0) FROM (SELECT st.audio_hash, ix.r, used, m, same, list_min(list_filter(cs, lambda c: NOT list_contains(used, c.k))) AS best FROM st JOIN ix ON ix.audio_hash = st.audio_hash AND ix.r = st.r + 1))"""


@query(_with(TAKES, WORDS, GREEDY).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT audio_hash, (SELECT count(*) FROM wa WHERE wa.audio_hash = x.audio_hash) AS \"left\", (SELECT count(*) FROM wb WHERE wb.audio_hash = x.audio_hash) AS \"right\", max(m) AS matched, max(same) AS text_matched FROM st x WHERE audio_hash IN (SELECT audio_hash FROM wo WHERE model_key <> 'stutter') GROUP BY audio_hash")
def word_match_pairs(spark, d):
    # segments are shuffled, not their words; into as many parts as are set, as the size of segments says little about that of their words
    together = takes(spark, d).where(F.col(R).isNotNull()).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), R)
    return al.word_matches(_timed(together), "plain", "lossy", 0.15)


@query(_with(TAKES, WORDS, "pr AS (SELECT wa.audio_hash, wa.n AS x, wb.n AS y, least(wa.e, wb.e) - greatest(wa.s, wb.s) AS sec FROM wa JOIN wb ON wa.audio_hash = wb.audio_hash AND wa.s < wb.e AND wb.s < wa.e)") + """SELECT k.audio_hash, round(coalesce((SELECT sum(sec) FROM pr WHERE pr.audio_hash = k.audio_hash), 0), 6) AS shared_sec, """ + ", ".join(f"(SELECT count(*) FILTER ({cond}) FROM {w} LEFT JOIN (SELECT audio_hash AS h, {c}, count(*) AS met FROM pr GROUP BY ALL) ON h = {w}.audio_hash AND {c} = {w}.n WHERE {w}.audio_hash = k.audio_hash) AS {name}" for name, w, c, cond in (("left_none", "wa", "x", "met IS NULL"), ("left_several", "wa", "x", "met > 1"), ("right_none", "wb", "y", "met IS NULL"), ("right_several", "wb", "y", "met > 1"))) + " FROM (SELECT DISTINCT audio_hash FROM wo WHERE model_key <> 'stutter') k")
def word_overlaps(spark, d):
    return al.word_overlaps(_timed(takes(spark, d)), "plain", "lossy").withColumn("shared_sec", F.round("shared_sec", 6))

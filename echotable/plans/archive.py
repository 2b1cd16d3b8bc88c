"""Queries on catalogs, usage and review, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as ct
from ..operators import review as rv
from ..operators import usage as us
from ..sources.adapters import AUDIT, CATALOGS, REVIEW, SEG, audit, catalog_a, catalog_b, read, review, seg

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


C, A, V = _with(CATALOGS), _with(AUDIT), _with(REVIEW)


@query(C + "SELECT hash, status, artist, seconds, o_orderkey, o_custkey FROM catalog_a UNION ALL SELECT hash, status, artist, seconds, o_orderkey, o_custkey FROM catalog_b b WHERE NOT EXISTS (SELECT 1 FROM catalog_a a WHERE a.hash = b.hash)")
def catalog_merge(spark, d):
    return ct.merge(catalog_a(spark, d), catalog_b(spark, d), [F.col("o_orderkey")])


@query(C + "SELECT hash, coalesce(a.status, b.status) AS status, coalesce(a.artist, b.artist) AS artist, coalesce(a.seconds, b.seconds) AS seconds, a.hash IS NOT NULL AND b.hash IS NOT NULL AS is_actionable FROM catalog_a a FULL JOIN catalog_b b USING (hash)")
def catalog_projection(spark, d):
    return ct.project(catalog_a(spark, d), catalog_b(spark, d)).select("hash", "status", "artist", "seconds", "is_actionable")


@query(C + "SELECT hash, 'missing' AS side FROM (SELECT hash FROM catalog_a EXCEPT SELECT hash FROM catalog_b) UNION ALL SELECT hash, 'stale' FROM (SELECT hash FROM catalog_b EXCEPT SELECT hash FROM catalog_a)")
def catalog_difference(spark, d):
    return ct.difference(catalog_a(spark, d), catalog_b(spark, d), "hash")


@query(C + "SELECT hash FROM catalog_a INTERSECT SELECT hash FROM catalog_b")
def catalog_intersection(spark, d):
    return catalog_a(spark, d).select("hash").intersect(catalog_b(spark, d).select("hash"))


@query(C + "SELECT hash FROM catalog_a UNION SELECT hash FROM catalog_b")
def catalog_key_union(spark, d):
    return catalog_a(spark, d).select("hash").union(catalog_b(spark, d).select("hash")).distinct()


@query(C + "SELECT hash, CASE WHEN b.hash IS NULL THEN 'added' WHEN a.hash IS NULL THEN 'removed' WHEN sha256(a.status || a.seconds::INT) <> sha256(b.status || CASE WHEN b.o_orderkey % 4 = 0 THEN '' ELSE 'x' END || a.seconds::INT) THEN 'updated' ELSE 'unchanged' END AS change FROM catalog_a a FULL JOIN catalog_b b USING (hash)")
def source_state_diff(spark, d):
    now = catalog_a(spark, d).withColumn("fp", F.sha2("status", 256))
    was = catalog_b(spark, d).withColumn("fp", F.sha2(F.concat("status", F.when(F.col("o_orderkey") % 4 == 0, "").otherwise("x")), 256))
    return ct.classify(now, was, "hash", "fp")


@query(C + "SELECT hash, status, o_orderkey FROM catalog_a WHERE hash NOT IN (SELECT hash FROM catalog_b) UNION ALL SELECT hash, status, o_orderkey FROM catalog_b")
def replace_chunks_by_hash(spark, d):
    cols = ["hash", "status", "o_orderkey"]
    return ct.replace_by_key(catalog_a(spark, d).select(cols), catalog_b(spark, d).select(cols), "hash")


@query("SELECT o_custkey, count(*) AS files, max(o_totalprice) * (count(*) - 1) AS savings FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return ct.duplicates(read(spark, d, "orders"), "o_custkey", "o_totalprice")


@query(C + ", r AS (SELECT hash, seconds FROM catalog_a UNION ALL SELECT hash, seconds FROM catalog_b) SELECT hash, count(*) AS n, min(seconds) AS least, max(seconds) AS most, count(*) >= 2 AND max(seconds) - min(seconds) > 2.0 AS differs FROM r WHERE seconds > 0 GROUP BY hash")
def duration_reconciliation(spark, d):
    return ct.reconcile({"a": catalog_a(spark, d), "b": catalog_b(spark, d)}, 2.0)


@query(C + ", c AS (SELECT hash FROM catalog_b WHERE o_orderkey % 5 <> 0) SELECT 'normalized' AS stage, count(b.hash) AS present, count(*) FILTER (b.hash IS NULL) AS missing, count(*) FILTER (a.hash IS NULL) AS orphans FROM (SELECT DISTINCT hash FROM catalog_a) a FULL JOIN (SELECT DISTINCT hash FROM catalog_b) b USING (hash) UNION ALL SELECT 'transcribed', count(c.hash), count(*) FILTER (c.hash IS NULL), count(*) FILTER (b.hash IS NULL) FROM catalog_b b FULL JOIN c USING (hash)")
def catalog_chain(spark, d):
    b = catalog_b(spark, d)
    return ct.chain([("metadata", catalog_a(spark, d)), ("normalized", b), ("transcribed", b.where("o_orderkey % 5 <> 0"))])


@query(C + "SELECT hash, o_orderkey, CASE WHEN hash IN (SELECT hash FROM catalog_b) THEN 'keep_shared' ELSE 'remove' END AS action FROM catalog_a WHERE status = 'F'")
def removal_plan(spark, d):
    return ct.removal_plan(catalog_a(spark, d).where("status = 'F'").select("hash", "o_orderkey"), catalog_b(spark, d), "hash")


@query(C + ", l AS (SELECT o_custkey AS event, hash, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS is_primary FROM catalog_a), k AS (SELECT * FROM l WHERE hash IN (SELECT hash FROM catalog_b)) SELECT event, hash, CASE WHEN max(is_primary::INT) OVER (PARTITION BY event) = 1 THEN is_primary ELSE row_number() OVER (PARTITION BY event ORDER BY o_orderkey) = 1 END AS is_primary FROM k")
def primary_election(spark, d):
    from pyspark.sql import Window

    a = catalog_a(spark, d).select(F.col("o_custkey").alias("event"), "hash", "o_orderkey")
    links = a.withColumn("is_primary", F.row_number().over(Window.partitionBy("event").orderBy("o_orderkey")) == 1)
    return ct.elect(links, catalog_b(spark, d), "event", "hash", [F.col("o_orderkey")]).select("event", "hash", "is_primary")


@query(C + "SELECT a.hash, a.o_orderkey, c.c_mktsegment AS location, n.n_name AS recorder FROM catalog_a a LEFT JOIN customer c ON c.c_custkey = a.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE a.status = 'F' AND contains(lower(a.artist), 'high')")
def catalog_filtered_display(spark, d):
    a = ct.filtered(catalog_a(spark, d), status="F", artist="HIGH")
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    return a.join(c, a.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").select("hash", "o_orderkey", F.col("c_mktsegment").alias("location"), F.col("n_name").alias("recorder"))


@query("SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT') OR NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def visible_or_unlinked(spark, d):
    c, o = read(spark, d, "customer").select("c_custkey", "c_name"), read(spark, d, "orders")
    linked = o.groupBy(F.col("o_custkey").alias("k")).agg(F.max(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    return c.join(linked, F.col("c_custkey") == F.col("k"), "left").where(F.coalesce("urgent", F.lit(True))).select("c_custkey", "c_name")


@query("SELECT o_custkey, count(*) AS recordings, count(*) FILTER (o_orderstatus = 'F') AS verified FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0 JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE n.n_regionkey IN (1, 2) GROUP BY o_custkey")
def listener_visibility(spark, d):
    o, c, n = (read(spark, d, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, (o.o_custkey == c.c_custkey) & (c.c_acctbal > 0)).join(n.where(F.col("n_regionkey").isin(1, 2)), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("o_custkey").agg(F.count("*").alias("recordings"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("verified"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def unassigned_recordings(spark, d):
    c, o = read(spark, d, "customer"), read(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1997-06-01' OR (o_orderdate = TIMESTAMP '1997-06-01' AND o_orderkey > 100) ORDER BY o_orderdate DESC, o_orderkey LIMIT 26")
def keyset_page(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return ct.keyset_page(o, [("o_orderdate", False), ("o_orderkey", True)], (F.lit("1997-06-01").cast("timestamp"), 100), 25)


@query("WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS nth, count(*) OVER () AS n FROM orders) SELECT o_orderkey, nth FROM n WHERE nth IN (SELECT round_even(i * ((SELECT count(*) FROM orders) - 1) / 19.0, 0)::BIGINT FROM range(20) r(i))")
def uniform_sample(spark, d):
    return ct.uniform_sample(read(spark, d, "orders").select("o_orderkey"), [F.col("o_orderkey")], 20).select("o_orderkey", "nth")


@query("SELECT c_nationkey, sha256(string_agg(r, chr(10) ORDER BY r)) AS fingerprint FROM (SELECT c_nationkey, '{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}' AS r FROM customer) GROUP BY c_nationkey")
def rows_fingerprint(spark, d):
    return ct.fingerprint(read(spark, d, "customer"), ["c_nationkey"], ["c_custkey", "c_name"])


@query("SELECT o_orderkey, (y * 10000 + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE m END * 100 + CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN 0 ELSE dd END)::BIGINT AS sort_key, ((o_orderkey % 24) * 3600 + (o_orderkey % 60) * 60 + o_orderkey % 60)::DOUBLE AS seconds FROM (SELECT *, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd FROM orders)")
def partial_dates_and_durations(spark, d):
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    text = F.format_string("%02d:%02d:%02d", k % 24, k % 60, k % 60)
    m, dd = F.when(k % 3 != 0, F.month("o_orderdate")), F.when((k % 2 != 0) & (k % 3 != 0), F.day("o_orderdate"))
    return o.select(k, ct.partial_date(F.year("o_orderdate"), m, dd).cast("long").alias("sort_key"), ct.seconds_of(text).alias("seconds"))


PLAYS = "p AS (SELECT * FROM (SELECT *, lag(resource_id) OVER (PARTITION BY user_id ORDER BY created_at, event_id) AS b FROM {of}) WHERE b IS NULL OR b <> resource_id)"


@query(_with(AUDIT, PLAYS.format(of="audit")) + "SELECT user_id, count(*) AS plays, min(created_at) AS first_at, max(created_at) AS last_at FROM p GROUP BY user_id")
def plays(spark, d):
    return us.plays(audit(spark, d)).groupBy("user_id").agg(F.count("*").alias("plays"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


@query(A + "SELECT date_trunc('day', created_at)::TIMESTAMP AS bucket, count(*) AS n, count(DISTINCT user_id) AS users FROM audit GROUP BY ALL")
def daily_buckets(spark, d):
    return us.buckets(audit(spark, d), "day")


@query(A + "SELECT date_trunc('hour', created_at)::TIMESTAMP AS bucket, count(*) AS n, count(DISTINCT user_id) AS users FROM audit GROUP BY ALL")
def hourly_buckets(spark, d):
    return us.buckets(audit(spark, d), "hour")


@query(_with(AUDIT, PLAYS.format(of="audit WHERE resource_id = 'view'"), "u AS (SELECT created_at, user_id, 'play' AS action FROM p UNION ALL SELECT created_at, user_id, resource_id FROM audit WHERE resource_id <> 'view')") + "SELECT date_trunc('day', created_at)::TIMESTAMP AS bucket, action, count(*) AS n, count(DISTINCT user_id) AS users FROM u GROUP BY ALL")
def audit_actions(spark, d):
    return us.actions(audit(spark, d), "day", "view")


@query(A + "SELECT user_id, arg_max(resource_id, event_id) AS resource_id, max(event_id) AS event_id FROM audit GROUP BY user_id")
def latest_per_user(spark, d):
    return us.latest(audit(spark, d), ["user_id"], ["event_id"], ["resource_id", "event_id"])


@query(A + "SELECT DISTINCT ON (user_id, date_trunc('day', created_at)) user_id, date_trunc('day', created_at)::TIMESTAMP AS day, event_id, resource_id FROM audit ORDER BY user_id, date_trunc('day', created_at), created_at DESC, event_id DESC")
def latest_per_user_day(spark, d):
    a = audit(spark, d).withColumn("day", F.date_trunc("day", "created_at"))
    return us.latest(a, ["user_id", "day"], ["created_at", "event_id"], ["event_id", "resource_id"])


@query(A + "SELECT resource_id, count(*) AS calls, count(DISTINCT user_id) AS users, count(*) FILTER (k >= 50) AS successes, round(sum(value * k) / nullif(sum(k), 0), 6) AS mean_value FROM audit GROUP BY resource_id")
def usage_summary(spark, d):
    return us.summary(audit(spark, d), ["resource_id"], F.col("k") >= 50, F.col("k")).withColumn("mean_value", F.round("mean_value", 6))


@query(A + "SELECT user_id, count(*) AS calls FROM audit GROUP BY user_id ORDER BY calls DESC, user_id LIMIT 20")
def usage_top_users(spark, d):
    return us.top(audit(spark, d).groupBy("user_id").agg(F.count("*").alias("calls")), "calls", ["user_id"], 20)


@query(A + "SELECT date_trunc('day', created_at)::TIMESTAMP AS day, user_id, resource_id, count(*) AS n, round(sum(value), 6) AS total, min(created_at) AS first_at, max(created_at) AS last_at FROM audit WHERE created_at < TIMESTAMP '2024-01-20' GROUP BY ALL")
def usage_rollup(spark, d):
    a = audit(spark, d)
    empty, rest = us.rollup(spark.createDataFrame([], "day timestamp, user_id long, resource_id string, n long, total double, first_at timestamp, last_at timestamp"), a, F.lit("2024-01-10").cast("timestamp"))
    daily, _ = us.rollup(empty, rest, F.lit("2024-01-20").cast("timestamp"))
    return daily.withColumn("total", F.round("total", 6))


@query(_with(AUDIT, "r AS (SELECT date_trunc('day', created_at)::TIMESTAMP AS day, coalesce(CASE WHEN k < 90 THEN 'v' || k % 9 END, 'unknown') AS version, user_id FROM audit)", "t AS (SELECT version FROM r WHERE version <> 'unknown' GROUP BY version ORDER BY count(DISTINCT user_id) DESC, version LIMIT 6)", "f AS (SELECT day, CASE WHEN version = 'unknown' OR version IN (SELECT version FROM t) THEN version ELSE 'other' END AS version, user_id FROM r)", "g AS (SELECT d.day, v.version FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) AS day) d CROSS JOIN (SELECT DISTINCT version FROM f) v)") + "SELECT g.day, g.version, count(DISTINCT user_id) AS users FROM g LEFT JOIN f ON f.day = g.day AND f.version = g.version GROUP BY ALL")
def version_series(spark, d):
    version = F.when(F.col("k") < 90, F.concat(F.lit("v"), (F.col("k") % 9).cast("string")))
    return us.series(audit(spark, d), version, "2024-01-01", "2024-02-05", 6)


@query(A + ", b AS (SELECT *, created_at BETWEEN TIMESTAMP '2024-01-16' AND TIMESTAMP '2024-01-30' AS c, created_at >= TIMESTAMP '2024-01-02' AND created_at < TIMESTAMP '2024-01-16' AS p FROM audit) SELECT " + ", ".join(f"count(*) FILTER ({x}) AS events_{n}, count(DISTINCT user_id) FILTER ({x}) AS users_{n}, count(*) FILTER ({x} AND resource_id = 'error') AS errors_{n}" for x, n in (("c", "now"), ("p", "before"))) + " FROM b")
def period_comparison(spark, d):
    return us.periods(audit(spark, d), "2024-01-16", "2024-01-30")


@query(A + "SELECT user_id, count(*) AS logins, round(count(*) / nullif(count(DISTINCT resource_id), 0), 6) AS per_kind FROM audit GROUP BY user_id HAVING count(*) > 60")
def health_checks(spark, d):
    g = audit(spark, d).groupBy("user_id").agg(F.count("*").alias("logins"), F.count_distinct("resource_id").alias("kinds")).where("logins > 60")
    return g.select("user_id", "logins", F.round(F.col("logins") / F.nullif(F.col("kinds"), F.lit(0)), 6).alias("per_kind"))


LAST = "l AS (SELECT span_id, actor_key, arg_max(kind, sequence) AS kind, arg_max(heard, sequence) AS heard, arg_max(flagged, sequence) AS flagged FROM review GROUP BY ALL)"


@query(_with(REVIEW, LAST, "s AS (SELECT span_id, coalesce(string_agg(actor_key::VARCHAR, ',' ORDER BY actor_key) FILTER (kind = 'APPROVE'), '') AS approvers, coalesce(string_agg(actor_key::VARCHAR, ',' ORDER BY actor_key) FILTER (kind = 'DISAPPROVE'), '') AS disapprovers FROM l GROUP BY span_id)") + "SELECT *, CASE WHEN approvers <> '' AND disapprovers <> '' THEN 'disputed' WHEN approvers <> '' THEN 'approved' WHEN disapprovers <> '' THEN 'rejected' ELSE 'open' END AS state FROM s")
def span_states(spark, d):
    s = rv.span_states(review(spark, d))
    return s.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("approvers", "disapprovers")})


@query(V + "SELECT span_id, true AS flagged FROM review GROUP BY span_id HAVING arg_max(flagged, sequence)")
def current_flags(spark, d):
    return rv.current_flags(review(spark, d))


@query(_with(REVIEW, LAST, "s AS (SELECT span_id, bool_and(kind = 'APPROVE') AS done, bool_or(flagged) AS flagged, min(heard) FILTER (kind = 'APPROVE') AS heard FROM l GROUP BY span_id)") + "SELECT span_id // 10 AS chunk_id, count(*) AS spans, concat_ws(',', CASE WHEN bool_or(flagged) THEN 'flagged' END, CASE WHEN bool_or(NOT done) THEN 'not_done' END, CASE WHEN bool_or(heard < 0.2) THEN 'not_heard' END) AS reasons, NOT (bool_or(flagged) OR bool_or(NOT done) OR coalesce(bool_or(heard < 0.2), false)) AS eligible FROM s GROUP BY ALL")
def training_eligibility(spark, d):
    e = rv.eligibility(review(spark, d), F.floor(F.col("span_id") / 10), 0.2)
    return e.withColumn("reasons", F.array_join("reasons", ","))


@query(_with(REVIEW, LAST, "s AS (SELECT span_id, bool_or(kind = 'DISAPPROVE') AS bad FROM l GROUP BY span_id)") + "SELECT span_id FROM s WHERE bad ORDER BY span_id <= 40, span_id LIMIT 1")
def next_open_span(spark, d):
    return rv.next_open(rv.span_states(review(spark, d)), 40).select("span_id")


@query(_with(SEG, "u AS (SELECT *, sum(new) OVER (PARTITION BY kind, audit_key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT *, CASE WHEN max(e) OVER w >= s THEN 0 ELSE 1 END AS new FROM (SELECT CASE WHEN model_key = 'user' THEN 'p' ELSE 's' END AS kind, audio_hash AS audit_key, start_sec AS s, end_sec AS e FROM seg WHERE end_sec > start_sec) WINDOW w AS (PARTITION BY kind, audit_key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))", "m AS (SELECT kind, audit_key, min(s) AS s, max(e) AS e FROM u GROUP BY kind, audit_key, isl)", "h AS (SELECT a.audit_key, sum(greatest(0, least(a.e, b.e) - greatest(a.s, b.s))) AS heard FROM m a JOIN m b ON a.audit_key = b.audit_key AND a.kind = 's' AND b.kind = 'p' GROUP BY ALL)") + "SELECT m.audit_key AS audio_hash, round(coalesce(any_value(heard), 0) / sum(e - s), 6) AS share FROM m LEFT JOIN h USING (audit_key) WHERE kind = 's' GROUP BY ALL")
def played_share(spark, d):
    s = seg(spark, d)
    return rv.played_share(s.where("model_key = 'user'"), s.where("model_key <> 'user'"), ["audio_hash"]).withColumn("share", F.round("share", 6))


@query(_with(AUDIT, "t AS (SELECT user_id AS player, event_id AS tick, (event_id % 100) / 10.0::DOUBLE + k / 50.0 AS position, 1.0 + (k % 2) AS rate FROM audit)", "n AS (SELECT *, CASE WHEN position - lag(position) OVER w >= 0 AND position - lag(position) OVER w <= 1.5 * greatest(1.0, rate) AND rate = lag(rate) OVER w THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY player ORDER BY tick))", "r AS (SELECT *, sum(new) OVER (PARTITION BY player ORDER BY tick ROWS UNBOUNDED PRECEDING) AS run FROM n)") + "SELECT player, round(min(position), 6) AS start_sec, round(max(position), 6) AS end_sec, count(*) AS ticks FROM r GROUP BY player, run")
def playback_steps(spark, d):
    a = audit(spark, d)
    ticks = a.select(F.col("user_id").alias("player"), F.col("event_id").alias("at"), ((F.col("event_id") % 100) / 10.0 + F.col("k") / 50.0).alias("position"), (1.0 + F.col("k") % 2).alias("rate"))
    return rv.playback_steps(ticks).withColumns({c: F.round(c, 6) for c in ("start_sec", "end_sec")})

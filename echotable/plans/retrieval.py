"""Queries on retrieval and speakers, each with its SQL for DuckDB where that can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as sr
from ..operators import speakers as sp
from ..sources.adapters import SPEAKER_VEC, TOKEN, read, speaker_vec, token
from ..sources.sinks import stored

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


TERMS = ["thing", "shere", "ouest", "eat", "la"]
IN = "('thing', 'shere', 'ouest', 'eat', 'la')"
T = _with(TOKEN)
POSTINGS = "po AS (SELECT term, doc_id, count(*) AS tf FROM token GROUP BY ALL), ln AS (SELECT doc_id, count(*) AS length FROM token GROUP BY ALL)"


@query(T + "SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM token GROUP BY term")
def inverted_index(spark, d):
    return sr.index(token(spark, d), "doc_id").groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


BM = "b AS (SELECT h.doc_id, round(-sum(ln((n.n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / n.mean))), 6) AS score, count(*) AS found FROM po h JOIN (SELECT term, count(*)::DOUBLE AS df FROM po GROUP BY term) USING (term) JOIN ln USING (doc_id) CROSS JOIN (SELECT count(*)::DOUBLE AS n, avg(length) AS mean FROM ln) n WHERE term IN " + IN + " GROUP BY ALL)"


@query(_with(TOKEN, POSTINGS, BM) + "SELECT * FROM b")
def lexical_bm25(spark, d):
    t = token(spark, d)
    return sr.bm25(sr.index(t, "doc_id"), sr.lengths(t, "doc_id"), TERMS, "doc_id").withColumn("score", F.round("score", 6))


@query(_with(TOKEN, POSTINGS, BM, "r AS (SELECT doc_id, doc_id % 7 AS audio, score, row_number() OVER (PARTITION BY doc_id % 7 ORDER BY score, doc_id) AS nth FROM b)") + "SELECT * FROM r WHERE nth <= 3")
def lexical_capped(spark, d):
    hits = lexical_bm25(spark, d).select("doc_id", (F.col("doc_id") % 7).alias("audio"), "score")
    return sr.capped(hits, "audio", [F.col("score"), F.col("doc_id")], 3).withColumn("nth", F.col("nth").cast("long"))


@query(T + f"SELECT DISTINCT doc_id FROM token WHERE term IN {IN}")
def lexical_any(spark, d):
    return sr.any_of(sr.index(token(spark, d), "doc_id"), TERMS, "doc_id")


@query(T + "SELECT doc_id FROM token WHERE term IN ('the', 'and', 'thing') GROUP BY doc_id HAVING count(DISTINCT term) = 3")
def lexical_all(spark, d):
    return sr.all_of(sr.index(token(spark, d), "doc_id"), ["the", "and", "thing"], "doc_id")


@query(T + "SELECT doc_id FROM token GROUP BY doc_id HAVING bool_or(starts_with(term, 'thin')) AND bool_or(starts_with(term, 'eat'))")
def lexical_prefix(spark, d):
    return sr.prefix(sr.index(token(spark, d), "doc_id"), ["thin", "eat"], "doc_id")


@query(T + "SELECT DISTINCT a.doc_id FROM token a JOIN token b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 AND b.term = 'the' WHERE a.term = 'of'")
def lexical_phrase(spark, d):
    return sr.phrase(token(spark, d), ["of", "the"], "doc_id")


@query(_with(TOKEN, POSTINGS, BM, "p AS (SELECT doc_id, -score AS goodness FROM b)") + "SELECT doc_id, goodness FROM p, (SELECT max(goodness) AS best FROM p) WHERE goodness >= best - abs(best) * 0.4")
def relative_cutoff(spark, d):
    return sr.relative_cutoff(lexical_bm25(spark, d).select("doc_id", (-F.col("score")).alias("goodness")), "goodness", 0.6)


@query("SELECT conv_id, turn::BIGINT AS turn, a.anchor FROM conversations JOIN (SELECT conv_id AS c, 2 AS anchor FROM conversations WHERE turn = 2) a ON conv_id = c AND turn BETWEEN anchor - 1 AND anchor + 1")
def chunk_neighbours(spark, d):
    t = read(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"))
    anchors = t.where("turn = 2").select("conv_id", F.lit(2).alias("at"))
    return sr.neighbours(t, anchors, "conv_id", "turn", 1).withColumnRenamed("at", "anchor")


@query(_with(SPEAKER_VEC, "q AS (SELECT vec_id % 3 AS question, vec_id AS q_nth, vector AS qv FROM speaker_vec WHERE vec_id % 50 = 0)", "m AS (SELECT question, q_nth, file_id, max(list_dot_product(qv, vector)) AS m FROM speaker_vec CROSS JOIN q GROUP BY ALL)") + "SELECT question, file_id, round(sum(m), 5) AS score FROM m GROUP BY ALL")
def dense_max_sim(spark, d):
    v = speaker_vec(spark, d)
    q = v.where("vec_id % 50 = 0").select((F.col("vec_id") % 3).alias("question"), F.col("vec_id").alias("q_nth"), "vector")
    return sr.max_sim(q, v, "question", "file_id").withColumn("score", F.round("score", 5))


@query(_with(SPEAKER_VEC, "q AS (SELECT vec_id AS question, vector AS qv, speaker AS target FROM speaker_vec WHERE vec_id % 50 = 0)", "r AS (SELECT question, target, speaker, row_number() OVER (PARTITION BY question ORDER BY round(list_dot_product(qv, vector), 9) DESC, vec_id) AS rk FROM speaker_vec JOIN q ON vec_id <> question)", "b AS (SELECT question, min(rk) FILTER (speaker = target) AS rk FROM r WHERE rk <= 10 GROUP BY question)") + "SELECT k, count(*) AS questions, round(avg(CASE WHEN rk <= k THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(CASE WHEN rk <= k THEN 1.0 / rk ELSE 0.0 END), 6) AS mrr FROM b CROSS JOIN (SELECT unnest([1, 5, 10]) AS k) GROUP BY k")
def retrieval_evaluation(spark, d):
    v = speaker_vec(spark, d)
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("question"), F.col("vector").alias("qv"), F.col("speaker").alias("target"))
    hits = sr.nearest(q.select("question", "qv"), v.select("vec_id", "speaker", "vector"), "question", "vec_id", 10).withColumn("score", F.round("score", 9))
    top = sr.capped(hits, "question", [F.desc("score"), F.col("vec_id")], 10).select("question", F.col("nth").alias("rank"), F.col("speaker").alias("doc"))
    return sr.evaluate(top, q.select("question", F.col("target").alias("doc")), [1, 5, 10]).withColumns({c: F.round(c, 6) for c in ("recall", "mrr")})


NORMED = "e AS (SELECT speaker, file_id, weight, generate_subscripts(vector, 1) - 1 AS d, unnest(vector) / (sqrt(list_dot_product(vector, vector)) + 1e-12) AS x FROM speaker_vec), m AS (SELECT speaker, file_id, d, sum(x * weight) / sum(weight) AS m FROM e GROUP BY ALL), z AS (SELECT speaker, file_id, sqrt(sum(m * m)) + 1e-12 AS n FROM m GROUP BY ALL), pool AS (SELECT speaker, file_id, list(m / n ORDER BY d) AS vector FROM m JOIN z USING (speaker, file_id) GROUP BY ALL)"


@query(_with(SPEAKER_VEC, NORMED) + "SELECT speaker, file_id, i::INT AS d, round(vector[i + 1], 5) AS x FROM pool, (SELECT unnest(range(64)) AS i)")
def speaker_pooling(spark, d):
    p = sp.pool(speaker_vec(spark, d), ["speaker", "file_id"])
    return p.select("speaker", "file_id", F.posexplode("vector").alias("d", "x")).withColumn("x", F.round("x", 5))


@query(_with(SPEAKER_VEC, NORMED) + "SELECT a.file_id AS a_file, a.speaker AS a_speaker, b.file_id AS b_file, b.speaker AS b_speaker, round(1 - list_dot_product(a.vector, b.vector), 5) AS distance FROM pool a JOIN pool b ON a.file_id < b.file_id")
def speaker_pairs(spark, d):
    return sp.pairs(sp.pool(speaker_vec(spark, d), ["speaker", "file_id"]), 0.35).drop("close").withColumn("distance", F.round("distance", 5))


@query()
def speaker_clusters(spark, d):
    p = sp.pool(speaker_vec(spark, d), ["speaker", "file_id"]).withColumn("scope", F.col("file_id") % 2)
    return sp.clusters(p, "scope", cut=0.8)


@query()
def speaker_cluster_spread(spark, d):
    p = stored(sp.pool(speaker_vec(spark, d), ["speaker", "file_id"]))
    c = sp.clusters(p.withColumn("scope", F.lit(0).cast("long")), "scope", cut=0.8).drop("scope")
    return sp.spread(p.join(c, ["file_id", "speaker"]), ["cluster"]).withColumns({x: F.round(x, 5) for x in ("least", "mean", "most")})


# searches for many queries: the first words of the turns of every fiftieth conversation, in the four modes, over all turns

TURN = r"""turns AS (SELECT conv_id * 1000 + turn AS chunk_id, conv_id, turn::BIGINT AS turn, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM conversations),
 tok AS (SELECT chunk_id, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos FROM turns),
 qs AS (SELECT chunk_id AS query, ['all', 'any', 'prefix', 'phrase'][1 + turn % 4] AS mode, CASE WHEN turn % 4 = 2 THEN [x[1:3] for x in ws[1:2] if length(x) >= 2] ELSE ws[1:2] END AS terms FROM turns WHERE conv_id % 50 = 0),
 qt AS (SELECT query, mode, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS i FROM qs),
 un AS (SELECT query, i AS unit, chunk_id, count(*) AS tf FROM qt JOIN tok ON CASE WHEN mode = 'prefix' THEN starts_with(tok.term, qt.term) ELSE tok.term = qt.term END WHERE mode <> 'phrase' GROUP BY ALL
  UNION ALL SELECT query, 0, chunk_id, count(*) FROM (SELECT query, chunk_id, pos - i AS start, count(*) AS met FROM qt JOIN tok ON tok.term = qt.term WHERE mode = 'phrase' GROUP BY ALL) r JOIN (SELECT query AS q, count(*) AS n FROM qt GROUP BY query) k ON q = query AND met = n GROUP BY query, chunk_id),
 wh AS (SELECT count(*)::DOUBLE AS docs, avg(n) AS mean FROM (SELECT count(*) AS n FROM tok GROUP BY chunk_id)),
 sz AS (SELECT chunk_id, count(*) AS length FROM tok GROUP BY chunk_id),
 df AS (SELECT query, unit, count(*) AS df FROM un GROUP BY ALL),
 sc AS (SELECT query, chunk_id, -sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score, count(*) AS met FROM un JOIN df USING (query, unit) JOIN sz USING (chunk_id) CROSS JOIN wh WHERE chunk_id % 5 <> 0 GROUP BY query, chunk_id),
 fd AS (SELECT query, chunk_id, round(score, 6) AS score, count(*) OVER (PARTITION BY query) AS total FROM sc JOIN (SELECT query, mode, count(*) AS n FROM qt GROUP BY ALL) USING (query) WHERE met >= CASE WHEN mode IN ('any', 'phrase') THEN 1 ELSE n END)"""


def _asked(spark, d):
    """Queries, tokens, turns that may be found, all turns."""
    t = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), "conv_id", F.col("turn").cast("long").alias("turn"), "text")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    tokens = t.select("chunk_id", F.posexplode(words).alias("pos", "term"))
    some = F.slice(words, 1, 2)
    mode = F.element_at(F.array(*map(F.lit, sr.MODES)), (F.col("turn") % 4 + 1).cast("int"))
    queries = t.where("conv_id % 50 = 0").select(F.col("chunk_id").alias("query"), mode.alias("mode"), F.array_join(F.when(F.col("turn") % 4 == 2, F.transform(some, lambda x: F.substring(x, 1, 3))).otherwise(some), " ").alias("text"))
    return queries, tokens, t.where("chunk_id % 5 <> 0"), t


@query(_with(TURN) + "SELECT * FROM fd")
def lexical_search(spark, d):
    queries, tokens, eligible, _ = _asked(spark, d)
    return sr.found(queries, tokens, "chunk_id", eligible)


CONTEXT = "cx AS (SELECT query, s.chunk_id, s.total, nth, string_agg(t.text, chr(10) || chr(10) ORDER BY t.turn) FILTER (trim(t.text) <> '') AS context, count(*) - 1 AS neighbours FROM sel s JOIN turns o ON o.chunk_id = s.chunk_id JOIN turns t ON t.conv_id = o.conv_id AND t.turn BETWEEN o.turn - 1 AND o.turn + 1 GROUP BY ALL)"


@query(_with(TURN, "cp AS (SELECT *, row_number() OVER (PARTITION BY query, chunk_id // 1000 ORDER BY score, chunk_id) AS mine FROM fd)", "rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score, chunk_id) AS nth FROM cp WHERE mine <= 2)", "sel AS (SELECT * FROM rk WHERE nth <= 5)", CONTEXT) + "SELECT query, chunk_id, total, nth, sha256(coalesce(context, '')) AS context_sha256, neighbours FROM cx")
def lexical_results(spark, d):
    queries, tokens, eligible, turns = _asked(spark, d)
    conv = F.floor(F.col("chunk_id") / 1000)
    best = sr.best_found(queries, tokens, "chunk_id", 5, eligible, conv, 2).withColumns({"conv_id": conv, "turn": F.col("chunk_id") % 1000})
    out = sr.in_context(best, turns, "conv_id", "turn", "text", 1)
    return out.select("query", "chunk_id", "total", F.col("nth").cast("long").alias("nth"), F.sha2("context", 256).alias("context_sha256"), "neighbours")


@query(_with(SPEAKER_VEC, "q AS (SELECT vec_id AS query, vector AS qv FROM speaker_vec WHERE vec_id % 50 = 0)", "s AS (SELECT query, vec_id, speaker, round(list_dot_product(qv, vector), 9) AS score FROM speaker_vec JOIN q ON vec_id <> query)", "r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s)", "c AS (SELECT query, count(*) FILTER (speaker % 4 = 1 AND rank <= 8) AS a, count(*) FILTER (speaker % 4 = 1 AND rank <= 16) AS b, count(*) FILTER (speaker % 4 = 1 AND rank <= 32) AS c, count(*) AS n FROM r GROUP BY query)", "f AS (SELECT query, CASE WHEN a >= 5 OR n < 8 THEN 8 WHEN b >= 5 OR n < 16 THEN 16 ELSE 32 END::BIGINT AS fetched, c >= 5 OR n < 32 AS complete FROM c)", "g AS (SELECT r.query, vec_id, rank, fetched, complete, row_number() OVER (PARTITION BY r.query ORDER BY rank) AS nth FROM r JOIN f ON f.query = r.query WHERE rank <= fetched AND speaker % 4 = 1)") + "SELECT query, vec_id, rank, fetched, complete, nth FROM g WHERE nth <= 5")
def filtered_search(spark, d):
    v = speaker_vec(spark, d)
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("vector").alias("qv"))
    hits = sr.nearest(q, v.select("vec_id", "speaker", "vector"), "query", "vec_id", 32).withColumn("score", F.round("score", 9))  # four times the first eight
    out = sr.fetched(hits, F.col("speaker") % 4 == 1, [F.desc("score"), F.col("vec_id")], 5, 8)
    return out.select("query", "vec_id", F.col("rank").cast("long").alias("rank"), F.col("fetched").cast("long").alias("fetched"), "complete", F.col("nth").cast("long").alias("nth"))


@query(_with(TURN, "rk AS (SELECT query, chunk_id, row_number() OVER (PARTITION BY query ORDER BY score, chunk_id) AS rank FROM fd)", "h AS (SELECT query AS question, rank, chunk_id, chunk_id // 1000 AS conv, (chunk_id % 1000) * 5.0::DOUBLE AS s, (chunk_id % 1000) * 5.0::DOUBLE + 7 AS e FROM rk WHERE rank <= 20)", "t AS (SELECT query AS question, CASE WHEN query % 3 = 0 THEN query + 1 END AS t_chunk, CASE WHEN query % 3 <> 0 THEN query // 1000 END AS t_conv, CASE WHEN query % 3 = 1 THEN 4.0::DOUBLE END AS ts, CASE WHEN query % 3 = 1 THEN 8.0::DOUBLE END AS te FROM qs)") + "SELECT t.question, min(rank) FILTER (chunk_id = t_chunk OR (conv = t_conv AND (ts IS NULL OR least(e, te) > greatest(s, ts)))) AS exact, min(rank) FILTER (conv = t_conv) AS audio FROM t LEFT JOIN h ON h.question = t.question GROUP BY t.question")
def target_ranks(spark, d):
    queries, tokens, eligible, turns = _asked(spark, d)
    turn, c = F.col("chunk_id") % 1000, F.col("chunk_id")
    h = sr.best_found(queries, tokens, "chunk_id", 20, eligible).select(F.col("query").alias("question"), F.col("nth").cast("long").alias("rank"), "chunk_id", F.floor(c / 1000).alias("audio_hash"), (turn * 5.0).alias("start_sec"), (turn * 5.0 + 7).alias("end_sec"))
    t = turns.where("conv_id % 50 = 0").select(c.alias("question"), F.when(c % 3 == 0, c + 1).alias("chunk_id"), F.when(c % 3 != 0, F.col("conv_id")).alias("audio_hash"), F.when(c % 3 == 1, 4.0).alias("start_sec"), F.when(c % 3 == 1, 8.0).alias("end_sec"))
    return sr.target_rank(h, t)

"""Steps that held back larger tables: how they are planned, and that they still give what plain versions give."""

import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotable.operators import alignment as al
from echotable.operators import kernels
from echotable.operators import repeats as rp
from echotable.operators import search as sr
from echotable.operators import speakers as sp
from echotable.plans import registry

WORDS = "audio_hash string, model_key string, word string, word_start double, word_end double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def words(spark):
    text = spark.createDataFrame([("r", m, "a b a c", s) for m, s in (("x", 0.0), ("y", 0.05))], "audio_hash string, model_key string, text string, at double")
    w = text.select("audio_hash", "model_key", "at", F.posexplode(F.split("text", " ")).alias("i", "word"))
    return w.select("audio_hash", "model_key", "word", (F.col("at") + F.col("i")).alias("word_start"), (F.col("at") + F.col("i") + 1).alias("word_end"))


def test_matched_words_are_not_broadcast(spark):
    df = al.word_matches(words(spark), "x", "y", 0.1)
    assert "Broadcast" not in plan(df) and "Broadcast" not in plan(al.candidates(words(spark), ["audio_hash"], "x", "y", 0.1))
    assert [tuple(r) for r in df.collect()] == [("r", 4, 4, 4, 4)]


def test_words_are_matched_without_shuffling_them(spark, tmp_path):
    rows = [(1, 0, "user", "so it was\nso it was"), (1, 1, "assistant", "it was so"), (None, 0, "user", "so it was"), (2, None, "user", "so it"), (3, 9, "user", " "), (4, 0, "user", None), (5, 5, "user", "once")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    df = registry.queries()["word_match_pairs"](spark, str(tmp_path))
    shuffles = re.findall(r"Exchange hashpartitioning.*", plan(df))
    assert len(shuffles) == 2 and "REPARTITION" in shuffles[1] and "MapInArrow" in plan(df)  # counts of recordings, segments
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(duck.sql(registry.oracle_sql()["word_match_pairs"]).fetchall())


def test_words_that_come_in_many_batches(spark):
    rng = np.random.default_rng(8)
    rows = []
    for rec in ("p", "q", "r", None, "s"):
        for model in "xyz":
            for _ in range({"r": 0, "s": 300}.get(rec, 90) if model == "y" else 120):
                s = float(rng.choice([rng.uniform(0, 6), rng.integers(0, 24) / 4]))
                rows.append((rec, model, str(rng.choice(["so", "So,", "it"])), s, s + float(rng.choice([0.1, 0.25]))))
    rows += [("q", "x", "so", None, 1.0), ("q", "y", None, 1.0, 1.2), ("t", "z", "so", 0.0, 1.0), ("u", "y", "so", 0.0, 1.0)]
    df = spark.createDataFrame(rows, WORDS)
    every, pairs, counts = [], [], []
    tolerance = 0.2
    for rec in {r[0] for r in rows} - {"t"}:
        a, b = (sorted((s, e, w or "") for r, m, w, s, e in rows if (r, m) == (rec, model) and s is not None) for model in "xy")
        used, j, same = set(), 0, 0
        for i, (s, e, w) in enumerate(a):
            while j < len(b) and b[j][0] < s - tolerance:
                j += 1
            near = [(abs(s - b[k][0]) + abs(e - b[k][1]), k) for k in (j - 1, j, j + 1) if 0 <= k < len(b) and abs(s - b[k][0]) <= tolerance and abs(e - b[k][1]) <= tolerance]
            every += [(rec, i, k) for _, k in near]
            if free := [x for x in near if x[1] not in used]:
                used.add(min(free)[1])
                pairs.append((rec, i, *min(free)[::-1]))
                same += w.lower().strip(",") == b[min(free)[1]][2].lower().strip(",")
        counts.append((rec, len(a), len(b), len(used), same))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        order = lambda found: sorted(found, key=str)
        assert order(map(tuple, al.candidates(df, ["audio_hash"], "x", "y", tolerance).select("audio_hash", "a_nth", "b_nth").collect())) == order(every)
        assert order(map(tuple, al.matched(df, ["audio_hash"], "x", "y", tolerance).select("audio_hash", "a_nth", "b_nth", "score").collect())) == order(pairs) and len(pairs) > 100
        assert order(map(tuple, al.word_matches(df, "x", "y", tolerance).collect())) == order(counts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_few_words_of_a_long_recording_are_held():
    start = np.arange(20000) * 0.1
    for of_b in (np.zeros(20000, bool), np.ones(20000, bool), np.arange(20000) % 5 == 0):
        t = pa.table({"of_b": of_b, "word_start": start, "word_end": start, "plain": ["so"] * 20000, "at": start - ~of_b * 0.2, "nth": np.arange(1, 20001), "b_early": np.cumsum(of_b)})
        sizes = [(len(x[0]), len(x[3])) for x in al._settled(iter(t.to_batches(100)), 0.2)]
        assert max(n for n, _ in sizes) < 120 and sum(n for _, n in sizes) == (~of_b).sum()


def test_overlapping_words_are_not_broadcast(spark):
    df = al.word_overlaps(words(spark), "x", "y")
    assert "Broadcast" not in plan(df)
    assert [(r["left_none"], r["left_several"], r["right_none"], r["right_several"]) for r in df.collect()] == [(0, 3, 0, 3)]


def vectors(spark, n=400):
    rng = np.random.default_rng(1)
    made = [[float(x) for x in rng.normal(size=8)] for _ in range(n)]
    for i in range(100, 180):  # copies
        made[i] = made[50]
    made[7], made[150], made[151], made[152], made[153] = None, [1.0] * 7, [None] + [1.0] * 7, [float("inf")] * 8, [float("nan")] * 8
    rows = [(i, i % 3, v) for i, v in enumerate(made)]
    return spark.createDataFrame(rows, "vec_id long, file_id int, vector array<double>")


def test_nearest_equals_all_pairs(spark):
    v = vectors(spark)
    q = v.where("vec_id % 50 = 0 OR vec_id = 7").select(F.col("vec_id").alias("query"), F.col("vector").alias("qv"))
    every = q.crossJoin(v).where("vec_id <> query").withColumn("score", sp.dot("qv", "vector"))
    found = sr.nearest(q, v, "query", "vec_id", 6)
    assert "applyInArrow" in plan(found) or "FlatMapCoGroupsInArrow" in plan(found)
    assert found.count() < every.count()
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "vec_id")
    top = lambda df: sorted(map(str, df.withColumn("nth", F.row_number().over(w)).where("nth <= 6").select("query", "nth", "vec_id", "file_id", "score").collect()))
    assert top(found) == top(every)


def test_max_sim_equals_all_pairs(spark):
    v = vectors(spark)
    q = v.where("vec_id % 50 = 0 OR vec_id = 7").select((F.col("vec_id") % 3).alias("question"), F.col("vec_id").alias("q_nth"), "vector")
    for c in (v, v.where("vec_id < 150")):
        m = q.withColumnRenamed("vector", "qv").crossJoin(c).groupBy("question", "q_nth", "file_id").agg(F.max(sp.dot("qv", "vector")).alias("m"))
        want = m.groupBy("question", "file_id").agg(F.sum("m").alias("score"))
        found = sr.max_sim(q, c, "question", "file_id")
        assert "CoGroupsInArrow" in plan(found)
        rows = lambda df: sorted(map(str, df.withColumn("score", F.round("score", 9)).select("question", "file_id", "score").collect()))
        assert rows(found) == rows(want)


def test_findings_leave_a_task_in_small_tables():
    class Texts:
        """Runs the kernel on one batch, as a task would."""

        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
        select = lambda self, *names: self
        mapInPandas = lambda self, kernel, schema: [len(p) for p in kernel(iter([pd.DataFrame({"doc_id": range(6000), "text": ["so so on and on and on"] * 6000})]))]

    sizes = kernels.repetitions(Texts())
    assert sum(sizes) >= 6000 and max(sizes) < kernels.ROWS + 10


def test_repeats_equal_a_plain_search():
    def plain(items, size):
        out, at = [], 0
        while at + 2 * size <= len(items):
            times = 1
            while items[at : at + size] == items[at + times * size : at + (times + 1) * size]:
                times += 1
            out += [(at, times)] if times > 1 else []
            at += times * size if times > 1 else 1
        return out

    rng = np.random.default_rng(2)
    for n in range(300):
        items = rng.integers(0, 1 + n % 3, n % 50).tolist()
        for size in range(1, 9):
            assert kernels.repeats(items, size) == kernels.repeats(np.array(items, np.int32), size) == plain(items, size)


def test_hits_of_many_queries(spark):
    docs = [(1000 * k + t, " ".join(f"w{(k * t + j) % 7}" for j in range(t % 5 + 1))) for k in range(1, 12) for t in range(9)]
    tokens = spark.createDataFrame(docs, "doc long, text string").select("doc", F.posexplode(F.split("text", " ")).alias("pos", "term"))
    asked = [(k, sr.MODES[k % 4], f"w{k % 7} w{(k + 1) % 7}") for k in range(40)]
    queries, eligible = spark.createDataFrame(asked, "query long, mode string, text string"), tokens.where("doc % 3 <> 0").select("doc")
    texts, n = [(d, t.split()) for d, t in docs], len(docs)
    mean = sum(len(w) for _, w in texts) / n
    want = []
    for query, mode, text in asked:
        terms = text.split()
        count = {"prefix": lambda w, u: sum(x.startswith(u) for x in w), "phrase": lambda w, u: sum(w[i : i + 2] == terms for i in range(len(w)))}.get(mode, lambda w, u: w.count(u))
        units, hits = [0] if mode == "phrase" else terms, []
        tf = {u: {d: c for d, w in texts if (c := count(w, u))} for u in units}
        for d, w in texts:
            met = [u for u in units if d in tf[u]]
            if d % 3 and len(met) >= (1 if mode == "any" else len(units)):
                hits.append((round(-sum(max(np.log((n - len(tf[u]) + 0.5) / (len(tf[u]) + 0.5)), 1e-6) * tf[u][d] * 2.2 / (tf[u][d] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for u in met), 6), d))
        want += [(query, d, s, len(hits)) for s, d in sorted(hits)]
    got = sr.found(queries, tokens, "doc", eligible)
    assert [tuple(r) for r in got.orderBy("query", "score", "doc").collect()] == want
    assert "Window" not in plan(got) and "CoGroupsInArrow" in plan(got)
    # the best, at most two of a group
    best, seen, taken = [], {}, {}
    for q, d, s, total in want:
        g = q, d // 1000
        seen[g] = seen.get(g, 0) + 1
        if seen[g] <= 2 and taken.get(q, 0) < 3:
            taken[q] = taken.get(q, 0) + 1
            best.append((q, d, s, total, taken[q]))
    top = sr.best_found(queries, tokens, "doc", 3, eligible, F.floor(F.col("doc") / 1000), 2)
    assert [tuple(r) for r in top.orderBy("query", "nth").select("query", "doc", "score", "total", "nth").collect()] == best


def test_doubled_words_and_their_confidences(spark):
    texts = {0: "a a  b", 1: "b c c c", 2: None, 3: " ", 4: "c d", 5: "d"}
    s = spark.createDataFrame([("r", k, float(k), k + 1.0, t) for k, t in texts.items()], "rec string, seg_idx long, start_sec double, end_sec double, text string")
    found = rp.doubled_words(s, ["rec"])
    whole = "\n".join(t or "" for t in texts.values())
    places = [m.span() for m in re.finditer(r"\S+", whole)]
    want = [("r", a, d) for (a, b), (c, d) in zip(places, places[1:]) if whole[a:b] == whole[c:d]]
    assert sorted(map(tuple, found.collect())) == want

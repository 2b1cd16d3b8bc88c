"""Corpora, reports, schedules and means of frames."""

import hashlib
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotable.functions import time as tm
from echotable.operators import asr, corpus, silence


def test_corpus_counts_what_it_leaves_out(spark):
    h = lambda c: c * 64
    schema = "audio_hash string, path string, segments array<struct<start:double,end:double,text:string>>"
    said = [(0.0, 2.0, "one two three."), (2.0, 1.0, "four"), (3.0, 4.0, " "), (4.0, 5.0, "five six")]
    rows = [(h("a"), "p1", said), (h("b"), "p2", None), ("short", "p3", said), (None, "p4", said), (h("c"), "p5", [])]
    chunks, report = corpus.build(spark.createDataFrame(rows, schema), "g", "b@lang-cs", "v1", least=2, most=5, overlap=0)
    got = chunks.orderBy("chunk_ordinal").collect()
    assert [(r["text"], r["token_count"], r["start_sec"], r["end_sec"], r["path"]) for r in got] == [("one two three. four", 5, 0.0, 2.0, "p1"), ("five six", 2, 4.0, 5.0, "p1")]
    assert got[0]["chunk_id"] == hashlib.sha256(f"g|b@lang-cs|{h('a')}|0|2000|v1".encode()).hexdigest()
    assert tuple(report.select("transcripts", "skipped", "chunks").first()) == (5, 3, 2)
    assert {r["path"]: r["reason"] for r in corpus.sources(spark.createDataFrame(rows, schema))[1].collect()} == {"p2": "unreadable", "p3": "not a whole hash", "p4": "not a whole hash"}
    with pytest.raises(Exception, match="several transcripts"):
        corpus.build(spark.createDataFrame([*rows, (h("a"), "p6", said)], schema), "g", "b", "v1")[0].collect()
    assert tuple(corpus.build(spark.createDataFrame([], schema), "g", "b", "v1")[1].select("transcripts", "skipped", "chunks").first()) == (0, 0, 0)


def test_reports_are_compared_on_the_same_rows_only(spark):
    schema = "audio string, text string, machine_text string, duration double, good string, bad string"
    rows = [("a", "one two three", "one two", 3600.0, "one two three", "one"), ("b", "four", None, 1800.0, "four", "for")]
    df = spark.createDataFrame(rows, schema)
    good, bad = asr.report(df, "good", "good"), asr.report(df, "bad", "bad")
    assert tuple(good.select("rows", "hours", "rows_without_machine_text").first()) == (2, 1.5, 1)
    table = [tuple(r) for r in asr.compared(good.unionByName(bad)).collect()]
    assert [t[:5] for t in table] == [(0, "machine", 1.0, 3.0, 0.3333), (1, "bad", 2.0, 4.0, 0.75), (1, "good", 2.0, 4.0, 0.0)]
    other = asr.report(spark.createDataFrame(rows[:1], schema), "good", "good")
    with pytest.raises(Exception, match="different rows"):
        asr.compared(bad.unionByName(other)).collect()
    assert asr.report(df, "none").first()["system_rows"] is None


def test_schedules_and_periods(spark):
    keys = [f"workspace {k}" for k in range(30)]
    df = spark.createDataFrame([(k, date(2024, 2, 1 + n)) for k in keys for n in range(20)], "k string, d date")
    for every in (1, 7, 2**31 - 1):
        got = {(r["k"], r["d"]) for r in df.where(tm.due(F.col("k"), every, F.col("d"))).collect()}
        assert got == {(k, d) for k in keys for d in (date(2024, 2, 1 + n) for n in range(20)) if every <= 1 or d.toordinal() % every == int(hashlib.sha256(k.encode()).hexdigest(), 16) % every}
    now = spark.createDataFrame([(datetime(2024, 2, 29, 13, 5),)], "n timestamp")
    want = {"24h": datetime(2024, 2, 28, 13, 5), "7d": datetime(2024, 2, 22, 13, 5), "30d": datetime(2024, 1, 30, 13, 5), "12m": datetime(2023, 2, 28)}
    assert {p: now.select(tm.period_start(p, F.col("n")).cast("string")).first()[0] for p in tm.PERIODS} == {p: str(v) for p, v in want.items()}


def test_frame_means_and_texts(spark):
    rng = np.random.default_rng(3)
    probs = [float(x) for x in rng.random(50)]
    rows = [(probs, 0.1, float(s), float(s + e)) for s, e in zip(rng.uniform(0, 6, 40), rng.uniform(0, 2, 40), strict=True)]
    got = [r[0] for r in spark.createDataFrame(rows, "p array<double>, u double, s double, e double").select(tm.frame_mean(F.col("p"), F.col("u"), F.col("s"), F.col("e"))).collect()]
    pauses = silence.Pauses(np.array(probs), 0.1, 0.3, 0.2)
    assert all(abs(g - pauses.mean(r[2], r[3])) < 1e-9 for g, r in zip(got, rows, strict=True))
    t = spark.createDataFrame([(" Žluťoučký\tKŮŇ ", "kun"), (None, "x"), ("abc", "d")], "t string, w string")
    assert [tuple(r) for r in t.select(tm.comparable(F.col("t")), tm.has_word(F.col("t"), F.col("w"))).collect()] == [("žluťoučký kůň", True), ("", None), ("abc", False)]

"""Fingerprints, order of names, corrections and integrity against Python's own forms."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from echotable.operators import canonical, integrity
from echotable.sources import corrections


def test_fingerprints_equal_pythons(spark):
    odd = [0.0, -0.0, 1e-7, 5e-7, 1.5e-6, 0.0000125, 1e-5, 0.1 + 0.2, 2.675, 1e7, 123456789.123456789, 1e15, 1e16, 1.7976931348623157e308, 2.5e-6, 1.0000005, 33.3333335]
    said = ['plain "quoted" \\ back', "line\nbreak\ttab\r\x00\x1f\x7f", "é 😀 \u2028", "", None]
    rows = [("h1", i, v, odd[-1 - i], said[i % 5]) for i, v in enumerate(odd)] + [("é\"", 0, None, float("inf"), "x"), ("é\"", 1, 1.0, float("nan"), "y")]
    df = spark.createDataFrame(rows, "audio_hash string, seg_idx long, start_sec double, end_sec double, text string").repartition(4)
    got = {r["audio_hash"]: r["fingerprint"] for r in canonical.transcript_fingerprint(df, ["audio_hash"]).collect()}
    number = lambda v: None if v is None or v != v else v if v == float("inf") else round(v, 6)
    for h in ("h1", "é\""):
        body = {"audio_hash": h, "segments": [{"start": number(s), "end": number(e), "text": t} for k, _, s, e, t in rows if k == h]}
        assert got[h] == hashlib.sha256(json.dumps(body, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert canonical.settings_fingerprint({"b": 1, "a": "é"}) == canonical.settings_fingerprint({"a": "é", "b": 1}) == hashlib.sha256('{"a":"é","b":1}'.encode()).hexdigest()


def test_names_in_order(spark):
    names = ["Track 10", "track 2", "Track 02b", "Émile", "emil", "Zebra", "äpfel", "Apfel 1", "apfel 1a", "track 2a", "10", "9", "100"]
    want = ["9", "10", "100", "Apfel 1", "apfel 1a", "äpfel", "emil", "Émile", "track 2", "track 2a", "Track 02b", "Track 10", "Zebra"]
    df = spark.createDataFrame([(n,) for n in [*names, None, ""]], "name string")
    order = lambda **how: [r["name"] for r in canonical.in_order(df, "name", **how).collect()]
    up = order()
    # "Apfel 1" and "äpfel": a blank before the end of the word
    assert [n for n in up if n] == sorted(want, key=lambda n: [n for n in up if n].index(n)) and up[:3] == ["9", "10", "100"] and up[-3] == "Zebra" and set(up[-2:]) == {None, ""}
    place = {n: i for i, n in enumerate(up)}
    assert place["track 2"] < place["track 2a"] < place["Track 02b"] < place["Track 10"] and place["emil"] < place["Émile"] < place["track 2"] and place["äpfel"] < place["emil"]
    assert set(order(nulls_first=True)[:2]) == {None, ""} and order(down=True)[0] == "Zebra" and set(order(down=True)[-2:]) == {None, ""}
    numbers = spark.createDataFrame([(2,), (None,), (10,)], "n int")
    assert [r["n"] for r in canonical.in_order(numbers, "n", nulls_first=True).collect()] == [None, 2, 10]
    albums = spark.createDataFrame([(n,) for n in [" B 10", "b 9", "B 10 ", " ", None, "a"]], "album string")
    assert [(r["nth"], r["album"]) for r in canonical.distinct_in_order(albums, "album").orderBy("nth").collect()] == [(1, "a"), (2, "b 9"), (3, "B 10")]


def test_corrections_replace_or_stop(spark, tmp_path):
    (tmp_path / "pointers").mkdir()
    (tmp_path / "texts/w").mkdir(parents=True)
    (tmp_path / "texts/w/t.json").write_text("right")
    good = {"workflow_group_id": "g", "audio_hash": "A" * 64, "publication_id": "p", "state": "active", "transcript_path": "w/t.json", "artifact_sha256": hashlib.sha256(b"right").hexdigest()}
    bad = {"unknown state": {"state": "retired"}, "another catalog": {"workflow_group_id": "h"}, "incomplete": {"artifact_sha256": " "}, "not a whole hash": {"audio_hash": "abc"}, "outside of the corrections": {"transcript_path": "../t.json"}, "no transcript": {"transcript_path": "w/u.json"}, "other bytes": {"artifact_sha256": "0" * 64}}
    for name, change in {"": {}, **bad}.items():
        (tmp_path / f"pointers/{name or 'good'}.json").write_text(json.dumps({**good, **change}))
    (tmp_path / "pointers/broken.json").write_text("{")
    found = corrections.checked(corrections.pointers(spark, f"{tmp_path}/pointers"), corrections.contents(spark, f"{tmp_path}/texts"), "g")
    said = {r["path"].rsplit("/", 1)[1][:-5].replace("%20", " "): r["problem"] for r in found.collect()}
    assert said == {"good": None, "broken": "unknown state", **{k: k for k in bad}}
    machine = spark.createDataFrame([("a" * 64, "m1"), ("b" * 64, "m2")], "audio_hash string, transcript_path string")
    ok = found.where("problem IS NULL")
    assert sorted(map(tuple, corrections.effective(machine, ok).select("audio_hash", "transcript_path", "origin").collect())) == [("a" * 64, "w/t.json", "correction"), ("b" * 64, "m2", "machine")]
    assert corrections.effective(machine.limit(0), ok).count() == 1
    with pytest.raises(Exception, match="correction pointer"):
        corrections.effective(machine, found).collect()


def test_texts_of_spans():
    assert integrity.texts("so, it is  here now", ["so,", "it", "is", "here"], [0, 0, 1, 1], 2) == ["so, it", "is here now"]
    assert integrity.texts("(x) one two", ["one", "two"], [1, 2], 4) == ["", "(x) one", "two", ""]
    assert integrity.texts("one two", ["two", "one"], [0, 1], 2) == ["two", "one"]  # not in order
    assert integrity.texts("one two", ["one", "two"], [1, 0], 2) == ["two", "one"]
    assert integrity.texts(" only  text ", [], [], 2) == ["only text", ""] and integrity.texts("", ["", " "], [0, 1], 2) == ["", ""]
    assert integrity.collapsed(" e\u0301\xa0\ufeffx\x85 ") == "é x\x85"
    assert integrity.texts("a a a", ["a", "a", "a"], [0, 1, 1], 2) == ["a", "a a"]


def test_differences_and_problems(spark):
    rows = lambda r: spark.createDataFrame(r, "w int, a int, b string")
    got = integrity.differences(rows([(1, 1, "x"), (1, 1, "x"), (1, 2, None), (2, 5, "e")]), rows([(1, 1, "x"), (1, 2, None), (1, 3, "z"), (2, 5, "e")]), ["w"], ["a", "b"])
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 1, "x", "unexpected", 1), (1, 3, "z", "missing", 1)]
    w = spark.createDataFrame([(1, "v1", 5, 5), (2, "v2", 5, None)], "workspace int, version string, size int, now int")
    got = integrity.problems(w, segmentation_version=F.col("version") == "v1", staged_audio_size=F.col("size") == F.col("now"))
    assert sorted(map(tuple, got.collect())) == [(2, "segmentation version"), (2, "staged audio size")]
    t = spark.createDataFrame([("so it is", ["so", "it", "is"], [0, 0, 1], 2), (None, None, None, 1)], "t string, w array<string>, o array<int>, n int")
    assert [r[0] for r in t.select(integrity.span_texts("t", "w", "o", "n")).collect()] == [["so it", "is"], [""]]

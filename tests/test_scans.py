"""Scans of small files, and audio by byte ranges, read back as written."""

import csv
import hashlib
import json
import os
import random
import wave

import pytest
from pyspark.sql import functions as F

from echotable.sources import audio, scans

H = "a" * 64


def test_joined_manifest(spark, tmp_path):
    row = dict.fromkeys(scans.JOINED, "") | {"Source Order": "1", "Source Count": "2", "Source Hash": H, "Output Hash": "b" * 64, "Source Title": 'a "title", with\nmore'}

    def written(name, rows, columns=scans.JOINED):
        with open(tmp_path / name, "w", newline="") as f:
            w = csv.DictWriter(f, columns)
            w.writeheader()
            w.writerows(rows)
        return scans.joined_manifest(spark, f"{tmp_path}/{name}")

    good = written("good.csv", [row, {**row, "Source Order": "2"}]).collect()
    assert len(good) == 2 and good[0]["Source Title"] == row["Source Title"] and good[0]["Fades"] == ""
    for n, change in enumerate([{"Source Order": "3"}, {"Source Order": "0"}, {"Source Count": "x"}, {"Source Hash": H.upper()}, {"Output Hash": ""}]):
        with pytest.raises(Exception, match="isn't|exceeds"):
            written(f"bad{n}.csv", [row, {**row, **change}]).collect()
    (tmp_path / "short.csv").write_text(",".join(scans.JOINED) + "\n1," + H + "\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        scans.joined_manifest(spark, f"{tmp_path}/short.csv").collect()
    with pytest.raises(ValueError, match="header"):
        written("other.csv", [], [*scans.JOINED[1:], "Source Order"])


def test_sidecars(spark, tmp_path):
    def said(name, body, old=False):
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_bytes(b"sound")
        (tmp_path / f"{name}.audiohash").write_text(body)
        if old:
            os.utime(tmp_path / f"{name}.audiohash", (1, 1))

    sha = hashlib.sha256(b"sound").hexdigest()
    good = f"{H.upper()}  x\nalgorithm v1\nsource-sha256 {sha}\n"
    for name, body, old in [("a.wav", good, False), ("b.wav", good, True), ("c.wav", H, False), ("d.wav", good.replace("v1", "v0"), False), ("e.wav", good.replace(sha, "0" * 64), False), ("f.wav", good + f"source-sha256 {sha}\n", False), ("._g.wav", good, False), ("@eaDir/h.wav", good, False), ("i.wav", "", False)]:
        said(name, body, old)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(str(tmp_path))
    sources = files.select("path", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
    got = scans.sidecars(spark, str(tmp_path), "v1", sources).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["audio_hash"]) for r in got] == [("a.wav", H)]


def test_questions(spark, tmp_path):
    span = {"audio_hash": H.upper(), "start_sec": 1, "end_sec": 2.5}
    records = [
        {"question": " why? ", "targets": [{"chunk_id": "c"}, span]},
        {"question": "how", "targets": [{"chunk_id": "c"}, {}]},
        {"query": "x", "targets": [{"chunk_id": "c"}]},
        {"question": 3, "targets": [{"chunk_id": "c"}]},
        {"question": "x", "targets": []},
        {"question": "x", "targets": [{"chunk_id": " "}]},
        {"question": "x", "targets": [{"audio_hash": "abc"}]},
        {"question": "x", "targets": [{"chunk_id": "c", "start_sec": 1, "end_sec": 2}]},
        {"question": "x", "targets": [{**span, "end_sec": "2"}]},
        {"question": "x", "targets": [{**span, "end_sec": 1}]},
        {"question": "x", "targets": [{"audio_hash": H, "start_sec": 1}]},
        7,
    ]
    (tmp_path / "q.json").write_text(json.dumps(records))
    targets, errors = scans.questions(spark, f"{tmp_path}/q.json")
    assert sorted(tuple(r) for r in targets.collect()) == [(0, "why?", 0, "c", None, None, None), (0, "why?", 1, None, H, 1.0, 2.5)]
    assert {r["nth"]: r["error"] for r in errors.collect()} == {1: "target 1: neither chunk_id nor audio_hash", 2: "retired field query", 3: "no question", 4: "no target", 5: "target 0: chunk_id must be a text", 6: "target 0: audio_hash isn't whole", 7: "target 0: times without audio_hash", 8: "target 0: times must be numbers", 9: "target 0: times out of order", 10: "target 0: one end of a time span", 11: "not an object"}


def test_recordings_and_backends(spark, tmp_path):
    def listed(doc):
        (tmp_path / "list.json").write_text(json.dumps(doc))
        return [r[0] for r in scans.recordings(spark, f"{tmp_path}/list.json").collect()]

    assert listed({"version": 1, "audio_hashes": [H, f" {H} ", ""]}) == [H]
    for doc in ({"version": 2, "audio_hashes": []}, {"version": "1", "audio_hashes": []}, {"version": 1}, {"version": 1, "audio_hashes": ["x"]}, []):
        with pytest.raises(Exception, match="list.json"):
            listed(doc)
    root = tmp_path / "t"
    for place in ("w/one@lang-cs", "w/two@lang-en", "w/other"):
        (root / place / H).mkdir(parents=True)
    for h in (H, "b" * 64):
        (root / "w/one@lang-cs" / h).mkdir(exist_ok=True)
        (root / "w/one@lang-cs" / h / "transcript.json").write_text("{}")
    assert sorted(map(tuple, scans.backends(spark, str(root)).collect())) == [("w", "one@lang-cs", 2), ("w", "two@lang-en", 0)]
    os.utime(root / "w/one@lang-cs" / H / "transcript.json", (10**9, 10**9))
    assert [r["path"].split("/")[-2] for r in scans.recent(spark, str(root), "2020-01-01T00:00:00").collect()] == ["b" * 64]
    records = spark.createDataFrame([(H, "m2", "p2"), (H, "m1", "p1"), (H, "m3", "p0"), ("b" * 64, "m1", "p0")], "audio_hash string, model_key string, path string")
    assert sorted((r["model_key"], r["path"]) for r in scans.samples(records).collect()) == [("m1", "p0"), ("m2", "p2"), ("m3", "p0")]
    order = {r["model_key"]: r["nth"] for r in scans.by_priority(records, {"m3": 1, "m2": 5}).where(F.col("audio_hash") == H).collect()}
    assert order == {"m2": 1, "m3": 2, "m1": 3} and scans.by_priority(records, {}).count() == 4
    assert {r["audio_hash"]: r["models"] for r in scans.grouped(records).collect()}[H] == ["m1", "m2", "m3"]


def sound(path, frames, channels=1, width=2, extra=False):
    data = random.Random(str(path)).randbytes(frames * channels * width)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(16000)
        w.writeframes(data)
    if extra:  # a chunk of odd length before the format
        raw = path.read_bytes()
        path.write_bytes(raw[:12] + b"LIST\x03\0\0\0abc\0" + raw[12:])
    return data


def test_regions_of_wav_files(spark, tmp_path):
    files = {name: sound(tmp_path / name, 5000, *form) for name, form in {"one.wav": (1, 2), "two.wav": (2, 3), "three.wav": (1, 2, True)}.items()}
    blocks = {"one.wav": 2, "two.wav": 6, "three.wav": 2}
    rng = random.Random(1)
    wanted = [(f"{tmp_path}/{n}", s, s + rng.randrange(200), k) for n in files for k, s in enumerate(rng.sample(range(4800), 30))] + [(f"file://{tmp_path}/one.wav", 0, 5000, 99), (f"{tmp_path}/one.wav", 7, 7, 98)]
    got = audio.regions(spark.createDataFrame(wanted, "path string, start long, end long, nth int"), together=1000).collect()
    assert len(got) == len(wanted)
    for r in got:
        name = r["path"].rsplit("/", 1)[1]
        assert bytes(r["pcm"]) == files[name][r["start"] * blocks[name] : r["end"] * blocks[name]]
    for bad in ((0, 5001), (-1, 5), (9, 8)):
        with pytest.raises(Exception, match="frames"):
            audio.regions(spark.createDataFrame([(f"{tmp_path}/one.wav", *bad)], "path string, start long, end long")).collect()
    (tmp_path / "no.wav").write_bytes(b"no sound")
    with pytest.raises(Exception, match="not a WAV"):
        audio.regions(spark.createDataFrame([(f"{tmp_path}/no.wav", 0, 1)], "path string, start long, end long")).collect()


def test_dataset(spark, tmp_path):
    data = sound(tmp_path / "s.wav", 40000)
    schema = "audio_hash string, workspace_id string, chunk int, eligible boolean, reasons array<string>, path string, regions array<struct<start:long,end:long>>, covered array<struct<start:long,end:long>>, texts array<string>, machine_texts array<string>, revision_ids array<string>, origins array<string>, source_backend string"
    r = [(100, 900), (20000, 36000)]
    one = (H, "w", 3, True, [], f"{tmp_path}/s.wav", r, r, ["So  ehm, it", " is. "], ["so it"], ["r1"], ["manual"], "b")
    rows = [one, (*one[:2], 4, False, ["flagged", "flagged", "not heard"], *one[5:]), (*one[:2], 5, True, [], one[5], r, r[:1], *one[8:])]
    for _ in range(2):  # once more leaves the same
        manifest, reasons = audio.dataset(spark.createDataFrame(rows, schema), f"{tmp_path}/out", test=[H], keep_fillers=False)
    (m,) = manifest.collect()
    assert (m["audio"], m["duration"], m["split"], m["text"], m["origins"]) == (f"audio/{H[:16]}_00003.wav", 1.05, "test", "So it is.", ["manual"])
    with wave.open(f"{tmp_path}/out/{m['audio']}") as w:
        assert w.readframes(w.getnframes()) == data[200:1800] + data[40000:72000] and w.getframerate() == 16000
    assert {r["reason"]: r["chunks"] for r in reasons.collect()} == {"flagged": 1, "not heard": 1, "span coverage": 1}
    assert os.listdir(tmp_path / "out/audio") == [m["audio"].rsplit("/", 1)[1]] or sorted(f for f in os.listdir(tmp_path / "out/audio") if not f.startswith(".")) == [m["audio"].rsplit("/", 1)[1]]

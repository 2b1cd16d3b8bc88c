"""Words in time, silence, playback as a stream and validation against plain versions."""

import json
import math
import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from echotable.operators import alignment, review, silence, validation
from echotable.streaming import events as st
from echotable.streaming import playback


def plain_matches(a, b, tolerance):
    used, out, j = set(), {}, 0
    for i, (s, e, _) in enumerate(a):
        while j < len(b) and b[j][0] < s - tolerance:
            j += 1
        near = [(abs(s - b[k][0]) + abs(e - b[k][1]), k) for k in (j - 1, j, j + 1) if 0 <= k < len(b) and k not in used and abs(s - b[k][0]) <= tolerance and abs(e - b[k][1]) <= tolerance]
        if near:
            out[i] = min(near)[1]
            used.add(out[i])
    return out


def test_words_match_as_one_after_the_other(spark):
    rng = random.Random(4)
    words = []
    for rec in range(12):
        for model in "ab":
            for _ in range(rng.choice([0, 1, 30, 60])):
                s = rng.choice([rng.uniform(0, 12), rng.randrange(48) / 4])
                words.append((f"r{rec}", model, rng.choice(["so", "So,", "it"]), s, s + rng.choice([0.0, 0.25, 0.3, 1.0])))
    df = spark.createDataFrame(words, "audio_hash string, model_key string, word string, word_start double, word_end double")
    for tolerance in (0.1, 0.3, 1.0):
        got, total = {(r["audio_hash"], r["a_nth"]): r["b_nth"] for r in alignment.matched(df, ["audio_hash"], "a", "b", tolerance).collect()}, {}
        for rec in {w[0] for w in words}:
            side = {m: sorted((s, e, w) for r, k, w, s, e in words if (r, k) == (rec, m)) for m in "ab"}
            total |= {(rec, i): k for i, k in plain_matches(side["a"], side["b"], tolerance).items()}
        assert got == total and len(total) > 5


def cuts(start, end, probs, unit, most, threshold, least, digits):
    """By trying every frame."""
    out, at = [], start
    while True:
        to = end
        if end - at > most + 1e-6:
            limit = min(at + most, end)
            to = round(limit, digits)
            low, high = max(0, math.floor(at / unit)), min(len(probs), math.ceil(limit / unit))
            block = max(1, math.ceil(least / unit))
            for stop in range(high, low, -1):
                ends = stop == high or probs[stop] >= threshold
                if ends and stop - low >= block and all(p < threshold for p in probs[stop - block : stop]):
                    to = round(stop * unit if stop * unit > at else limit, digits)
                    break
            to = to if to > at else limit
        at, to = round(at, digits), round(to, digits)
        out.append((at, to))
        if to >= min(end, round(end, digits)) - 1e-6:
            return out
        at = to


def test_cuts_at_pauses_equal_trying_all(spark):
    rng = np.random.default_rng(6)
    frames, segments = [], []
    for rec in range(12):
        n = int(rng.integers(1, 3000))
        speech = np.repeat(rng.random(n // 7 + 1) < 0.6, 7)[:n]
        frames.append((f"r{rec}", 0.02, [float(x) for x in np.where(speech, 0.9, 0.1)]))
        for k in range(4):
            s = float(rng.uniform(0, n * 0.02))
            segments.append((f"r{rec}", k, s, s + float(rng.choice([0.0, 0.5, 4.0, 40.0, 90.0]))))
    got = {}
    frames_df, segments_df = spark.createDataFrame(frames, "audio_hash string, unit double, probs array<double>"), spark.createDataFrame(segments, "audio_hash string, seg_idx long, start_sec double, end_sec double")
    rows = silence.split_at_pauses(segments_df, frames_df, most=5.0, least=0.3).orderBy("piece").collect()
    for r in rows:
        got.setdefault((r["audio_hash"], r["seg_idx"]), []).append((r["start_sec"], r["end_sec"]))
    of = {f[0]: f[2] for f in frames}
    assert got == {(r, k): cuts(s, e, of[r], 0.02, 5.0, 0.35, 0.3, 3) for r, k, s, e in segments if e > s}
    p = rows[0]
    probs = of[p["audio_hash"]]
    low, high = math.floor(p["start_sec"] / 0.02), math.ceil(p["end_sec"] / 0.02)
    assert abs(p["mean_prob"] - (np.mean(probs[low : min(max(low + 1, high), len(probs))]) if low < len(probs) else probs[-1])) < 1e-4
    bare = silence.split_at_pauses(segments_df, frames_df.limit(0), most=5.0).where("seg_idx = 0").collect()
    assert all(r["mean_prob"] == 0 for r in bare) and max(r["end_sec"] - r["start_sec"] for r in bare) <= 5.001


def test_playback_as_a_stream_equals_the_batch(spark, tmp_path):
    rng, start = random.Random(7), datetime(2024, 1, 1)
    rows = []
    for player in range(5):
        position = 0.0
        for tick in range(120):
            position += rng.choice([0.5, 1.0, 1.5, 1.0, 1.0, -3.0, 9.0])
            rows.append((player, start + timedelta(seconds=tick), player * 1000 + tick, position, rng.choice([1.0] * 9 + [2.0])))
    # arrives in files, each shuffled, some ticks a file later than they should
    moved = sorted(rows, key=lambda r: (r[1] + timedelta(seconds=rng.choice([0, 0, 6]))))
    schema = "player long, at timestamp, tick long, position double, rate double"
    out, total = f"{tmp_path}/out", len(moved)
    late = (0, start, -1, 500.0, 1.0)  # far behind the watermark when it comes
    files = [moved[k : k + 100] for k in range(0, total, 100)] + [[(9, start + timedelta(hours=1), 1, 0.0, 1.0)], [late], [(9, start + timedelta(hours=2), 2, 0.0, 1.0)]]
    for k, part in enumerate(files):
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        st.to_parquet(playback.playback_steps(stream, "10 seconds"), out, f"{tmp_path}/state", "update").awaitTermination()
    got = st.latest(spark.read.parquet(out), ["player", "nth"]).where("player < 9").select("player", "start_sec", "end_sec", "ticks").collect()
    want = review.playback_steps(spark.createDataFrame(rows, schema)).select("player", "start_sec", "end_sec", "ticks").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 100


def test_players_share_states(spark, tmp_path):
    """Each player's state and call of pandas took far longer than its ticks. Times are the same in any session time zone; what has no number stays one stretch each."""
    rng, start, rows = random.Random(8), datetime(2024, 1, 1), []
    for player in [None, *range(0, 60 * 2**55, 2**55)]:
        position = 0.0
        for tick in range(40):
            position += rng.choice([0.5, 1.0, 1.5, 1.0, -3.0, 9.0])
            rows.append((player, start + timedelta(seconds=tick), tick + 2**60, rng.choice([None, *[position] * 9]), rng.choice([None, *[1.0] * 9, 2.0])))
    schema, far = "player long, at timestamp, tick long, position double, rate double", [(-1, start + timedelta(days=1), 0, 0.0, 1.0)]
    untimed = [(0, None, 5, 0.0, 1.0)]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        for part in (rows[::2], rows[1::2] + untimed, far):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = playback.playback_steps(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "1 hour", 8)
            q = st.to_parquet(stream, f"{tmp_path}/out", f"{tmp_path}/state", "update")
            q.awaitTermination()
            assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 8
        got = st.latest(spark.read.parquet(f"{tmp_path}/out"), ["player", "nth"]).select("player", "start_sec", "end_sec", "ticks").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    want = review.playback_steps(spark.createDataFrame(rows, schema)).select("player", "start_sec", "end_sec", "ticks").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(r["ticks"] for r in want) == 61 * 40 > len(want)


def test_users_share_states(spark, tmp_path):
    rng, start, rows, want = random.Random(9), datetime(2024, 1, 1), [], {}
    for user in [None, *range(2**60, 2**60 + 40)]:
        last, n = None, 0
        for k in range(30):
            kind = rng.choice(["play", "pause", None])
            rows.append((2**60 + k, start + timedelta(seconds=k // 2), user, kind))
            n += kind is None or kind != last
            last = kind
        want[user] = n
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    for part in (0, 1):
        some = [r for r in rows if (r[0] % 2**60 >= 16) == part]
        rng.shuffle(some)
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = st.to_parquet(st.plays(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 8), f"{tmp_path}/out", f"{tmp_path}/state", "update")
        q.awaitTermination()
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 8
    got = st.latest(spark.read.parquet(f"{tmp_path}/out"), ["user_id"]).collect()
    assert {r["user_id"]: r["plays"] for r in got} == want and len(got) == 41


def test_diarization_files(spark, tmp_path):
    good = {"start": 0, "end": 1.5, "speaker": "A "}
    bodies = {
        "x/one": {"audio_file": "a", "segments": [good, {"start": 1, "end": 2, "speaker": "B"}]},
        "x/two": {"audio_file": "a", "segments": [good, 7, {"start": "1", "end": 2, "speaker": "B"}, {"start": 1, "end": True, "speaker": "B"}, {"start": 1, "end": 2}, {"start": 1, "end": 2, "speaker": " "}, {"start": 2, "end": 2, "speaker": "B"}, {"start": 5, "end": 6, "speaker": "B"}, {"start": 4, "end": 6, "speaker": "B"}, {"start": 4.5, "end": 6, "speaker": "B"}]},
        "y/three": {"audio_file": "a", "segments": []},
        "y/four": {"segments": [good]},
        "y/five": None,
        "y/six": {"audio_file": "a", "segments": "none"},
    }
    for place, body in bodies.items():
        (tmp_path / place).mkdir(parents=True)
        (tmp_path / place / "speakers.json").write_text("{not json" if body is None else json.dumps(body), encoding="utf-8")
    (tmp_path / "y/seven").mkdir()
    (tmp_path / "y/seven/speakers.json").write_bytes(b'{"audio_file": "\xff", "segments": []}')
    files = validation.diarization_files(spark, str(tmp_path))
    ok, errors = validation.loaded(files)
    name = lambda path: "/".join(path.split("/")[-3:-1])
    assert {name(r["path"]) for r in ok.select("path").collect()} == {"x/one", "x/two", "y/three", "y/six"}
    assert {name(r["path"]): r["error"] for r in errors.collect()} == {"y/four": "missing audio_file", "y/five": "invalid JSON", "y/seven": "invalid JSON"}
    faults = {r["idx"]: r["fault"] for r in validation.diarization_segments(files).collect() if name(r["path"]) == "x/two"}
    assert faults == {0: None, 1: "not an object", 2: "start must be a number", 3: "end must be a number", 4: "speaker must be a non-empty string", 5: "speaker must be a non-empty string", 6: "end must be greater than start", 7: None, 8: "start time is out of order", 9: None}
    report = {name(r["path"]): (r["status"], r["segments"], r["speakers"], r["seconds"], r["issues"], r["message"]) for r in validation.diarization_report(files).collect()}
    assert report["x/one"] == ("passed", 2, 2, 2.5, 0, None) and report["x/two"] == ("failed", None, None, None, 7, "segment 1 not an object")
    assert [report[k][5] for k in ("y/three", "y/four", "y/five", "y/six")] == ["missing segments", None, "invalid JSON", "missing segments"]
    totals = {r["backend"]: (r["total"], r["passed"], r["rate"], r["segments_total"]) for r in validation.rollup(validation.diarization_report(files), "backend", ["segments", "seconds"]).collect()}
    assert totals == {"x": (2, 1, 50.0, 2), "y": (5, 1, 20.0, 1)}
    first = validation.ranked(validation.diarization_report(files).withColumn("score", F.col("issues")), "score", "path").first()
    assert first["status"] == "failed"

"""The sequential algorithms, against plain statements of what they should give."""

import difflib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotable.functions import text as tx
from echotable.operators import catalog, chunking, kernels, review, search, speakers
from echotable.operators import intervals as iv
from echotable.operators import transcripts as tr
from echotable.sources import files, sinks


def slow_distance(a, b):
    if not a or not b:
        return len(a) + len(b)
    return min(slow_distance(a[1:], b) + 1, slow_distance(a, b[1:]) + 1, slow_distance(a[1:], b[1:]) + (a[0] != b[0]))


def test_distance():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("ab") for _ in range(r.randint(0, 5))] for _ in range(2))
        assert tx.distance(a, b) == slow_distance(a, b)


def test_repeats_and_suppression():
    assert kernels.repeats(list("abababx"), 2) == [(0, 3)]
    assert kernels.repeats(list("aaab"), 1) == [(0, 3)]
    assert kernels.repeats([], 1) == []
    assert kernels.distinct_findings([(0, 1, 4), (0, 2, 2), (10, 1, 2)]) == [(0, 1, 4), (10, 1, 2)]


def test_pack_regions():
    bins = kernels.pack_regions([(0, 10), (11, 21), (22, 32), (40, 80)], 20)
    assert bins == [[(0, 10), (11, 21)], [(22, 32)], [(40, 80)]]
    assert kernels.pack_regions([]) == [[]] and kernels.pack_regions([(0, 50)]) == [[], [(0, 50)]]


def test_split_at_gaps_covers_all_in_order():
    r = random.Random(2)
    for _ in range(100):
        at, spans = 0.0, []
        for _ in range(r.randint(0, 40)):
            at += r.choice([0.0, 0.2, 1.5])
            spans.append((at, at + r.uniform(0.2, 6)))
            at = spans[-1][1]
        runs = kernels.split_at_gaps(spans)
        assert [k for i, j in runs for k in range(i, j)] == list(range(len(spans)))
        assert all(j - i == 1 or spans[j - 1][1] - spans[i][0] <= 30 for i, j in runs)


def test_sentences():
    assert kernels.sentence_stats([(0, 1, "Hi."), (1, 2, "you"), (4, 5, "there")]) == (3, 3)


def test_split_text_bounds():
    text = "One two three, four five six. Seven eight nine - ten eleven twelve thirteen fourteen"
    parts = chunking.split_text(text, 6)
    assert all(chunking.count_tokens(p) <= 6 for p in parts)
    assert " ".join(parts).replace("- ", "").split() == text.replace("- ", "").split()


def test_retimed():
    assert chunking.retimed(["ab", "cd ef"], 0.0, 6.0) == [(0.0, 2.0, "ab"), (2.0, 6.0, "cd ef")]


def test_windows_advance_and_cover():
    r = random.Random(3)
    for _ in range(100):
        segs = [(i, i + 1, " ".join("w" * r.randint(1, 3) for _ in range(r.randint(1, 12)))) for i in range(r.randint(1, 15))]
        w = chunking.windows(segs, 5, 10, 4)
        assert {k for i, j, _ in w for k in range(i, j)} == set(range(len(segs)))
        assert all(b[0] > a[0] and b[1] > a[1] for a, b in zip(w, w[1:], strict=False))
        assert all(n <= 10 or j - i == 1 for i, j, n in w)


def one_after_the_other(rows, cut):
    """Average linkage by its definition: the two clusters with the least mean distance merge, until it exceeds the cut."""
    vectors = {(f, s): np.array(v) / np.linalg.norm(v) for _, f, s, v in rows}
    far = max(cut + 1, 2.0)
    d = lambda a, b: far if a[0] == b[0] else 1 - vectors[a] @ vectors[b]
    groups = [[k] for k in sorted(vectors)]
    while len(groups) > 1:
        mean, a, b = min((np.mean([d(x, y) for x in groups[a] for y in groups[b]]), a, b) for b in range(len(groups)) for a in range(b))
        if mean > cut:
            break
        groups[a] += groups.pop(b)
    return {(f, s): "{}/{}".format(*min(g)) for g in groups for f, s in g}


def test_clusters(spark):
    schema = "scope long, file_id long, speaker long, vector array<double>"
    r = np.random.default_rng(5)
    rows = []
    for scope in (0, 1):
        centres = r.normal(size=(4, 6))
        rows += [(scope, f, s, (centres[s] + r.normal(size=6) * 0.7).tolist()) for f in range(7) for s in range(4) if r.random() < 0.8]
    rows += [(2, 0, 0, [1.0, 0.0]), (2, 0, 1, [1.0, 0.01]), (3, 0, 0, [1.0, 0.0]), (3, 1, 0, [0.99, 0.05]), (3, 2, 0, [0.0, 1.0]), (3, 3, 0, [1.0, 0.01])]
    for cut in (0.35, 0.8):
        got = {(x["scope"], x["file_id"], x["speaker"]): x["cluster"] for x in speakers.clusters(spark.createDataFrame(rows, schema), "scope", cut).collect()}
        want = {(k, *m): c for k in range(4) for m, c in one_after_the_other([x for x in rows if x[0] == k], cut).items()}
        assert got == want
        # two of one file stay apart
        assert got[2, 0, 0] != got[2, 0, 1]
    assert speakers.clusters(spark.createDataFrame([], schema), "scope").collect() == []


def test_meetings_and_spread(spark):
    r = np.random.default_rng(6)
    rows = [(k % 2, f, s, r.normal(size=3).tolist()) for k, (f, s) in enumerate((f, s) for f in range(8) for s in range(3))]
    df = spark.createDataFrame(rows, "cluster long, file_id long, speaker long, vector array<double>")
    want = {}
    for i, (c, f, s, v) in enumerate(rows):
        for c2, f2, s2, v2 in rows[:i]:
            if c == c2 and f != f2:
                want.setdefault(c, []).append(1 - np.dot(v, v2) / np.linalg.norm(v) / np.linalg.norm(v2))
    for per_block in (2, 1000):
        n = speakers.meetings(df, ["cluster"], per_block).groupBy("cluster").count().collect()
        assert {x[0]: x[1] for x in n} == {c: len(x) for c, x in want.items()}
    for x in speakers.spread(df, ["cluster"]).collect():
        w = want[x["cluster"]]
        assert np.allclose([x["least"], x["mean"], x["most"], x["pairs"]], [min(w), np.mean(w), max(w), len(w)])


def test_union_of_intervals(spark):
    rows = [("a", 0.0, 1.0), ("a", 1.0, 2.0), ("a", 0.2, 0.3), ("a", 5.0, 4.0), ("a", 9.0, 10.0)]
    out = iv.union(spark.createDataFrame(rows, "k string, start_sec double, end_sec double"), ["k"])
    assert sorted((r.start_sec, r.end_sec, r.n_merged) for r in out.collect()) == [(0.0, 2.0, 3), (9.0, 10.0, 1)]


def test_subtitle_times(spark):
    got = spark.createDataFrame([(-1.0,), (3661.0005,), (59.9996,)], "s double").select(tr.timestamp(F.col("s"), ",").alias("t"))
    assert [r.t for r in got.collect()] == ["00:00:00,000", "01:01:01,000", "00:01:00,000"]


def test_subtitles_skip_and_renumber(spark):
    rows = [("h", "m", 0, 0.0, 1.0, "a"), ("h", "m", 1, 1.0, 1.0, "b"), ("h", "m", 2, 2.0, 3.0, " "), ("h", "m", 3, 3.0, 4.0, "c")]
    df = spark.createDataFrame(rows, "audio_hash string, model_key string, seg_idx long, start_sec double, end_sec double, text string")
    assert tr.subtitles(df, "srt").first().body == "1\n00:00:00,000 --> 00:00:01,000\na\n\n2\n00:00:03,000 --> 00:00:04,000\nc\n"


def test_text_functions(spark):
    df = spark.createDataFrame([("  Ehm, well,  so<|x|>it IS . ", "ﬁ Ｓtraße,")], "a string, b string")
    r = df.select(tx.without_fillers(tx.without_control(F.col("a"))).alias("a"), tx.folded("b").alias("b"), tx.word(F.lit("„Hey!>")).alias("c")).first()
    assert (r.a, r.b, r.c) == ("well, so it IS.", "fi strasse", "hey")


def test_similarity(spark):
    df = spark.createDataFrame([("abcd", "bcde"), (None, "")], "a string, b string")
    assert [r[0] for r in df.select(tx.similarity("a", "b")).collect()] == [difflib.SequenceMatcher(None, "abcd", "bcde").ratio(), 1.0]


def test_numbered(spark):
    got = catalog.numbered(spark.range(1000).withColumn("x", F.xxhash64("id")), [F.col("x")]).orderBy("x").collect()
    assert [r.nth for r in got] == list(range(1000))


def test_merge_first_row_wins(spark):
    t = spark.createDataFrame([("a", 1)], "hash string, n int")
    s = spark.createDataFrame([("a", 2), ("b", 4), ("b", 3), (" ", 5), (None, 6)], "hash string, n int")
    assert sorted(tuple(r) for r in catalog.merge(t, s, [F.col("n")]).collect()) == [("a", 1), ("b", 3)]


def test_flag_cleared_later_is_gone(spark):
    log = spark.createDataFrame([(1, 1, "APPROVE", 1, 1.0, True), (1, 1, "APPROVE", 2, 1.0, False), (2, 1, "APPROVE", 3, 1.0, True)], "span_id long, actor_key long, kind string, sequence long, heard double, flagged boolean")
    assert [r.span_id for r in review.current_flags(log).collect()] == [2]


def test_lookup_keeps_order(spark):
    chunks = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, n int")
    assert [r.id for r in search.lookup(chunks, ["c", "x", "a"], "id").collect()] == ["c", "a"]


def test_transcript_scan(spark, tmp_path):
    h = "ab" * 32
    for name, body in ((h, json.dumps({"meta": {"duration": 0}, "segments": [{"start": 0, "end": 2.5, "text": "x", "words": []}]})), ("cd" * 32, "{broken"), ("nothash", "{}")):
        p = tmp_path / "wf" / "model@lang-en" / name
        p.mkdir(parents=True)
        (p / "transcript.json").write_text(body)
    good, bad = files.transcripts(spark, str(tmp_path))
    assert [(r.model_key, r.audio_hash) for r in good.collect()] == [("wf/model@lang-en", h)]
    assert bad.count() == 1
    assert good.select(files.duration()).first()[0] == 2.5
    assert files.segments(good).first().text == "x"
    assert files.chosen(good, prefixes=["abab"]).count() == 1
    with pytest.raises(ValueError):
        files.chosen(good, prefixes=["ab"])


def test_csv_and_rttm(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Hash,Full Path\nx,"a, b"\n')
    assert files.csv(spark, str(tmp_path / "c.csv"), ["hash", "full_path"]).first().full_path == "a, b"
    with pytest.raises(ValueError):
        files.csv(spark, str(tmp_path / "c.csv"), ["album"])
    (tmp_path / "a.rttm").write_text("SPEAKER f 1 0.50 1.25 <NA> <NA> s1 <NA> <NA>\nother\n")
    r = files.rttm(spark, str(tmp_path / "a.rttm")).first()
    assert (r.file_id, r.start_sec, r.end_sec, r.speaker) == ("f", 0.5, 1.75, "s1")


def test_publish_and_guard(spark, tmp_path):
    root = str(tmp_path / "t")
    sinks.publish(spark.range(3), root, "v1")
    sinks.publish(spark.range(4), root, "v2")
    assert sinks.active(spark, root).count() == 4
    with pytest.raises(ValueError):
        sinks.guard_rows(spark.range(1), spark.range(10))


def test_require(spark):
    with pytest.raises(ValueError):
        files.require_unique(spark.createDataFrame([("a",), ("a",)], "h string"), "h")


def test_incremental_rollup(spark, tmp_path):
    from echotable.streaming import events as st

    src = tmp_path / "in"
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in (0, 1):
        batch.where(F.col("event_id") % 2 == part).coalesce(1).write.mode("append").parquet(str(src))
    st.incremental(st.source(spark, str(src), 1), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    last = sorted((tmp_path / "out").glob("v*"))[-1]
    assert spark.read.parquet(str(last)).agg(F.sum("n")).first()[0] == batch.count()


def distance_plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distance_by_the_table():
    import random

    rng = random.Random(3)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 40))] for _ in range(2))
        assert tx.distance(a, b) == distance_plain(a, b)
    long = [str(rng.random()) for _ in range(300)]
    assert tx.distance(long, long[:100] + long[150:]) == 50 and tx.distance([], long) == tx.distance(long, []) == 300


def repeats_plain(items, size):
    out, i = [], 0
    while i < len(items):
        n = 1
        while n * size + size <= len(items) - i and items[i : i + size] == items[i + n * size : i + n * size + size]:
            n += 1
        if n > 1:
            out.append((i, n))
        i += n * size if n > 1 else 1
    return out


def test_repeats_by_comparing_blocks():
    import random

    rng = random.Random(4)
    for _ in range(500):
        items = [rng.choice("ab") for _ in range(rng.randint(0, 30))]
        for size in (1, 2, 3, 4):
            assert kernels.repeats(items, size) == repeats_plain(items, size)


def test_severity_ladder(spark):
    df = spark.createDataFrame([(0, 0.5), (10, 0.09), (2500, 0.04), (10, 0.04), (600, 0.02), (10, 0.02), (1600, 0.006), (10, 0.006), (4000, 0.0), (10, 0.0)], "s long, c double")
    got = [r[0] for r in df.select(kernels.severity(F.col("s"), F.col("c"))).collect()]
    assert got == ["none", "high", "high", "medium", "medium", "low", "medium", "low", "medium", "low"]


def test_word_segments(spark):
    words = [("a", "m", 0, i, w, s, s + 0.4) for i, (w, s) in enumerate([("one", 0.0), ("two", 0.5), ("far", 3.0), ("last", 3.5)])]
    df = spark.createDataFrame(words, "audio_hash string, model_key string, seg_idx long, i long, word string, word_start double, word_end double")
    got = [(r["start_sec"], r["end_sec"], r["text"]) for r in kernels.segments_of_words(df, 1.0, 30.0).orderBy("ordinal").collect()]
    assert got == [(0.0, 0.9, "one two"), (3.0, 3.9, "far last")]


def test_dev_split_counts(spark):
    from echotable.operators import asr

    df = spark.createDataFrame([(i,) for i in range(101)] * 2, "k long")
    rows = asr.split_dev(df, "k", 0.1, 7).collect()
    assert len(rows) == 101 and sum(r["split"] == "dev" for r in rows) == 11
    assert {r["split"] for r in asr.split_dev(df.where("k < 1"), "k", 0.1, 7).collect()} == {"train"}


def test_words_are_counted_once():
    """Before, each text was encoded three times whole, whatever words it shared with others."""
    import public_tokenizers

    rng, calls = random.Random(3), []

    class Counted(chunking.Vocabulary):
        def __call__(self, text):
            calls.append(text)
            return super().__call__(text)

    plain = chunking.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = ["a", "bc", " ", "  ", ".", "'s", "é", "1", "\n", "\t", "\x1c", "\u3000", "😀", " -- ", " <|endoftext|>", "…"]
    for counter in (plain, chunking.count_tokens):
        by = chunking.ByWords(counter)
        for _ in range(2000):
            text = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 20)))
            assert by(text) == counter(text) and by.spaced(text) == counter(" " + text), repr(text)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)]
    by = chunking.ByWords(Counted(plain.path))
    rows = [(float(i), i + 1.0, t) for i, t in enumerate(q for t in texts for q in chunking.split_text(t, 100, by))]
    assert chunking.windows(rows, 180, 260, 40, by) == chunking.windows(rows, 180, 260, 40, plain)
    assert len(calls) <= 2 * len(words)


def test_chunks_of_recordings_in_one_task(spark):
    """Many recordings that lie in one task stay apart, each in order of its time."""
    rows = [(f"r{k % 7}", f"m{k % 2}", k, float(k % 13), k % 13 + 2.0, f"word{k} and {k} more") for k in range(200)]
    df = spark.createDataFrame(rows, "audio_hash string, model_key string, seg_idx long, start_sec double, end_sec double, text string")
    want = set()
    for key in {r[:2] for r in rows}:
        said = [r[3:] for r in sorted((r for r in rows if r[:2] == key), key=lambda r: (r[3], r[2]))]
        want |= {(*key, k, said[i][0], max(r[1] for r in said[i:j]), " ".join(r[2] for r in said[i:j]), n, n > 20) for k, (i, j, n) in enumerate(chunking.windows(said, 12, 20, 5))}
    got = [tuple(r) for r in chunking.chunks(df.coalesce(1), 12, 20, 5).collect()]
    assert set(got) == want and len(got) == len(want) > 14

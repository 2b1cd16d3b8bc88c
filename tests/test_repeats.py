"""Repeats across models against plain versions: hotspots, places of words, replacements; numbering of many rows."""

import difflib
import random
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from echotable.functions.text import plain_word
from echotable.operators import catalog
from echotable.operators import repeats as rp


def test_numbers_of_many_rows_with_several_columns(spark):
    n = 2_000_000
    df = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(700_000)).alias("a"), F.col("id").alias("b"), F.concat(F.lit("row "), F.col("id").cast("string")).alias("c"))
    got = catalog.numbered(df, [F.col("a").asc(), F.col("b").desc()])
    row = got.agg(F.count("*"), F.countDistinct("nth"), F.min("nth"), F.max("nth")).first()
    assert tuple(row) == (n, n, 0, n - 1)
    # each row's predecessor by number comes before it in the order
    pairs = got.select("nth", "a", "b").join(got.select((F.col("nth") + 1).alias("nth"), F.col("a").alias("pa"), F.col("b").alias("pb")), "nth")
    assert pairs.where("pa > a OR (pa = a AND pb <= b)").count() == 0


def some_segments(seed, models=("a", "b", "c"), recordings=6, n=12):
    rng = random.Random(seed)
    rows = []
    for r in range(recordings):
        for m in models:
            at = 0.0
            for k in range(n):
                at += rng.choice([0.0, 0.2, 1.0])
                end = at + rng.choice([0.0, 0.4, 1.5, 4.0])
                rows.append((f"rec {r}", m, k, at, end, rng.choice(["Go on.", "go on.", "the the end", "yes yes yes, yes", "no", "", "  ", "Straße ﬁn fin", "-- --"])))
                at = end
    return rows


SCHEMA = "audio_hash string, model_key string, seg_idx long, start_sec double, end_sec double, text string"


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault((r[0], r[1]), []).append(r)
    return {k: sorted((x for x in v if x[4] > x[3]), key=lambda x: (x[3], x[4], x[2])) for k, v in out.items()}


def plain_spans(segments):
    raw = sorted((a[3], b[4]) for a, b in zip(segments, segments[1:], strict=False) if a[5].strip(" ").lower() and a[5].strip(" ").lower() == b[5].strip(" ").lower())
    merged = []
    for s, e in raw:
        if merged and s <= merged[-1][1] + 1e-3:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return [tuple(x) for x in merged]


def said(segments, s, e):
    return " ".join(x[5].strip(" ") for x in segments if x[4] > s and x[3] < e and x[5].strip(" "))


def repetition(text):
    words, total = [plain_word(w) for w in text.split()], 0
    for size in range(1, 9):
        k = 0
        while k + 2 * size <= len(words):
            times = 1
            while words[k + times * size : k + (times + 1) * size] == words[k : k + size]:
                times += 1
            if times > 1:
                total += times * size * all(words[k : k + size])
            k += times * size if times > 1 else 1
    return total


def test_patch_candidates_equal_the_plain_version(spark):
    found = {}
    rows = some_segments(1)
    keyed = by_key(rows)
    for (rec, model), segments in keyed.items():
        others = {m: s for (r, m), s in keyed.items() if r == rec and m != model and s}
        for s, e in plain_spans(segments):
            source = said(segments, s, e)
            if not repetition(source):
                continue
            rows_of_span = []
            for m, theirs in others.items():
                text = said(theirs, s, e)
                ratio = min(1.0, sum(max(0.0, min(e, x[4]) - max(s, x[3])) for x in theirs) / (e - s))
                if not text or ratio < 0.5:
                    continue
                beside = [t for o, x in others.items() if o != m and (t := said(x, s, e))]
                agree = sum(difflib.SequenceMatcher(None, text, t).ratio() for t in beside) / len(beside) if beside else 0.5
                better = repetition(source) - repetition(text)
                rows_of_span.append((round(0.6 * ratio + 0.3 * agree + 0.1 * max(0.0, min(better / 10, 1.0)), 4), m, text, better, round(ratio, 4)))
            rows_of_span.sort(key=lambda x: (-x[0], x[1]))
            if rows_of_span and rows_of_span[0][3] > 0:
                for nth, (q, m, text, better, ratio) in enumerate(rows_of_span[:3], 1):
                    sure = "high" if q >= 0.8 and better >= 2 and ratio >= 0.8 else "medium" if q >= 0.6 and ratio >= 0.6 else "low"
                    found[rec, model, round(s, 6), nth] = (m, text, q, better, sure)
    got = {(r["audio_hash"], r["source_model"], round(r["lo"], 6), r["nth"]): (r["model_key"], r["said"], r["quality"], r["improvement"], r["confidence"]) for r in rp.patch_candidates(spark.createDataFrame(rows, SCHEMA), ["audio_hash"]).collect()}
    assert got == found and len(found) > 5
    alone = spark.createDataFrame([r for r in rows if r[1] == "a"], SCHEMA)
    assert rp.patch_candidates(alone, ["audio_hash"]).count() == 0


def test_near_matches_equal_all_pairs(spark):
    rng = random.Random(3)
    spans = []
    for r in range(5):
        for _ in range(60):
            s = rng.choice([rng.uniform(0, 200), rng.randrange(200) / 2, rng.uniform(-20, 0)])
            spans.append((f"rec {r}", rng.choice("abc"), s, s + rng.choice([0.0, 1e-7, 0.1, 0.3, 0.9, 3.0, 100.0, -1.0])))
    want = []
    for r, m, s, e in spans:
        for q, n, t, f in spans:
            if r == q and m < n:
                lo, hi = max(s, t), min(e, f)
                if hi <= lo:
                    da, db = max(0.0, e - s), max(0.0, f - t)
                    if abs((s + e) / 2 - (t + f) / 2) > 0.75 or max(da, db) / max(min(da, db), 1e-6) > 3:
                        continue
                    lo, hi = max(s, t) - 0.75, min(e, f) + 0.75
                    if hi <= lo:
                        lo, hi = min(s, t), max(e, f)
                if hi > lo:
                    want.append((r, m, n, round(lo, 6), round(hi, 6)))
    df = spark.createDataFrame(spans, "audio_hash string, model_key string, start_sec double, end_sec double")
    got = [(r[0], r[1], r[2], round(r[3], 6), round(r[4], 6)) for r in rp.near_matches(df, ["audio_hash"]).collect()]
    assert sorted(got) == sorted(want)


def test_words_at_places(spark):
    text = [("r", 0, "so so it is"), ("r", 1, ""), ("r", 2, "it is, is it"), ("r", 3, "no words here"), (None, 0, "null key")]
    words = [(k, i, j, w, 0.5) for k, i, t in text if i != 3 for j, w in enumerate(t.split())]
    flat = {}
    for k, i, t in text:
        flat.setdefault(k, []).append((i, t))
    want = set()
    for k, segments in flat.items():
        at = 0
        for i, t in segments:
            for p in range(at, at + len(t)):
                ws = [w for kk, ii, _, w, _ in words if (kk, ii) == (k, i)]
                covering = [j for j, w in enumerate(ws) if at + t.find(w) <= p < at + t.find(w) + len(w)]
                if ws:
                    want.add((k, p, i, covering[0] if covering else 0))
            at += len(t) + 1
    points = spark.createDataFrame([(k, p) for k in ("r", None) for p in range(-2, 45)], "k string, char_pos long")
    got = rp.words_at(points, spark.createDataFrame(text, "k string, seg_idx long, text string"), spark.createDataFrame(words, "k string, seg_idx long, word_idx int, word string, confidence double"), ["k"], width=5)
    assert {(r["k"], r["char_pos"], r["seg_idx"], r["word_idx"]) for r in got.collect()} == want


def test_words_between_any_white_space(spark):
    text = "a bc\x1c d 　e\n\n 😀f​g "
    got = rp.word_offsets(spark.createDataFrame([(1, text), (2, None), (3, " ")], "id long, text string"), ["id"]).orderBy("nth").collect()
    assert [r["word"] for r in got] == text.split() and all(text[r["char_start"] : r["char_end"]] == r["word"] for r in got)


def test_plain_word():
    assert [plain_word(w) for w in ("ﬁn,", "Straße!", "--", "(Étude)")] == ["fin", "strasse", "", unicodedata.normalize("NFC", "étude")]


def test_nearest_region_equals_trying_all(spark):
    from echotable.operators import records

    rng = random.Random(9)
    place = lambda: rng.choice([rng.uniform(-20, 100), float(rng.randrange(60))])
    regions = [(k, i, s, s + rng.choice([0.0, 1.0, 5.0, 45.0])) for k in range(4) for i in range(rng.choice([0, 1, 12])) for s in [place()]]
    words = [(k, n, s, s + rng.choice([0.0, 0.5, 2.0])) for k in range(5) for n in range(40) for s in [place()]]
    want = {}
    for k, n, s, e in words:
        m = (s + e) / 2
        near = [(round(max(0.0, lo - m, m - hi), 9), i) for q, i, lo, hi in regions if q == k]
        if near:
            want[k, n] = min(near)
    got = records.nearest_region(spark.createDataFrame(words, "k int, n int, word_start double, word_end double"), spark.createDataFrame(regions, "k int, region int, lo double, hi double"), ["k"])
    assert {(r["k"], r["n"]): (round(r["away"], 9), r["region"]) for r in got.collect()} == want and len(want) > 60


def test_scores_take_each_word_once(spark, monkeypatch):
    """The score of texts by the plain version. Before, a text's words were numbered anew for each of eight sizes, and texts that say nothing twice searched as well."""
    from echotable.operators import kernels

    rng, anew = random.Random(5), []
    texts = [" ".join(rng.choice(["so", "So,", "it", "--", "it!", "…"]) for _ in range(rng.randrange(0, 30))) for _ in range(300)] + ["all words differ here", "-- --", "", None]
    want = [float(repetition(t or "")) for t in texts]
    monkeypatch.setattr(kernels.pd, "factorize", lambda *a, **k: anew.append(a))
    assert rp.repetition_score.func(pd.Series(texts)).tolist() == want and not anew and any(want)


def test_fillers_and_tokens(spark):
    import public_tokenizers

    from echotable.functions import text as tx
    from echotable.operators import chunking

    said = {"Ehm? Ano.": "Ano.", "ano, hm?": "ano?", "tak / eee": "tak", "no, ehm, ne": "no, ne", "„hm“ a": "a", "(ehm) dobře": "dobře", "ehmm hm-hm mhm.": "ehmm hm-hm", "Ano,  EHM  !": "Ano!"}
    df = spark.createDataFrame([(k,) for k in said], "t string")
    assert {r["t"]: r["o"] for r in df.select("t", tx.without_fillers(F.col("t")).alias("o")).collect()} == said
    rng, count = random.Random(2), chunking.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["".join(rng.choice(["a", "bc", " ", ".", "'s", "é", "1", "\n", "😀", "-- "]) for _ in range(rng.randrange(1, 30))).strip() or "x" for _ in range(60)]
    for counter in (count, chunking.count_tokens):
        tokens = chunking.joined_counts(texts, counter)
        for _ in range(200):
            i, j = sorted(rng.sample(range(len(texts) + 1), 2))
            assert tokens(i, j) == counter(" ".join(texts[i:j]))
    a, b = "abcdefgh" * 30, "abxdefgh" * 29 + "zz"
    assert spark.createDataFrame([(a, b), (a, a), (None, b), ("", "ab")], "a string, b string").select(tx.char_distance("a", "b")).collect() == spark.createDataFrame([(a, b), (a, a), (None, b), ("", "ab")], "a string, b string").select(F.levenshtein("a", "b").cast("long")).collect()


def test_findings_name_their_places(spark):
    from echotable.operators import kernels

    text = "So it, it IT! is -- -- here\n\nthe end\n The End \nabababab"
    got = [r.asDict() for r in kernels.repetitions(spark.createDataFrame([("a", text), ("b", None), ("c", "nothing twice")], "k string, text string"), key="k").collect()]
    assert {r["k"] for r in got} == {"a"}
    assert all(" ".join(text[r["char_start"] : r["char_end"]].split()) == r["snippet"] for r in got)
    said = {(r["unit"], r["snippet"], r["times"]) for r in got}
    assert {("word", "it, it IT!", 3), ("line", "the end The End", 2), ("char", "abababab", 4)} <= said and not any(r["unit"] == "word" and "--" in r["snippet"] for r in got)
    scored = spark.createDataFrame([("m", 5000, 3, 100, 1000), ("m", None, None, None, 50), ("n", 600, 1, 2, 100), ("n", 1500, 1, 2, None)], "model string, score long, findings long, covered long, chars long")
    totals = {r["model"]: tuple(r)[1:] for r in kernels.model_totals(scored, "model").collect()}
    assert totals == {"m": (2, 5000, 3, 100 / 1050, 1, 0, 0, 1), "n": (2, 2100, 2, 0.04, 0, 0, 2, 0)}

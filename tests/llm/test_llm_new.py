"""Exact dedup, whitening and conversation repair against plain versions, and their edge cases."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
from fixtures import EDGES, frame

from echotable.llm import conversations, exact_dedup, whitening

# exact dedup


def test_filters_count_and_merge_without_loss():
    rng = np.random.default_rng(1)
    for width in (5, 12, 40, 64):
        top = min(1 << width, 1 << 63)
        lists = [rng.integers(0, top, n, np.uint64) if width > 12 else rng.integers(0, top, n).astype(np.uint64) for n in (0, 1, 7, 200, 3000)]
        lists.append(np.repeat(lists[3][:20], 50))
        lists.append(np.arange(max(0, top - 20), top, dtype=np.uint64))  # runs that reach beyond the last quotient
        filters = [exact_dedup.build(*exact_dedup.summed(x, np.ones(len(x), np.int64)), width) for x in lists]
        filters = [exact_dedup.unpacked(exact_dedup.packed(f)) for f in filters]
        want = {}
        for x in np.concatenate(lists).tolist():
            want[x] = want.get(x, 0) + 1
        merged = exact_dedup.merge(filters)
        found, counts = exact_dedup.items(merged)
        assert dict(zip(found.tolist(), counts.tolist(), strict=True)) == want and found.tolist() == sorted(want)
        some = list(want)[:200]
        assert [exact_dedup.count_of(merged, x) for x in some] == [want[x] for x in some]
        assert exact_dedup.count_of(merged, next(x for x in range(top) if x not in want)) == 0 if len(want) < top else True


def by_text(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    low = lambda i: -math.inf if i is None else i
    return {t: (max(ids, key=low), len(ids)) for t, ids in groups.items()}


def test_exact_duplicates_in_many_ranges(spark):
    rng = random.Random(2)
    texts = [f"text {k} " * 3 for k in range(60)]
    rows = [(i, rng.choice(texts) if i % 3 else f"own {i}") for i in range(3000)] + [(None, "hot")] * 5 + [(7000 + i, "hot") for i in range(1500)]
    want = by_text(rows)
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), in_range=100).collect()
    sha = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    assert len(got) == len(rows)
    assert all((r["keep_id"], r["group_size"]) == sha[r["text_sha256"]] for r in got)
    assert sorted(r["text_sha256"] for r in got if r["kept"]) == sorted(sha) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_duplicates_edges(spark):
    got = exact_dedup.exact_duplicates(frame(spark)).collect()
    want = by_text(EDGES)
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((i for i, _ in EDGES), key=str)
    sha = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    assert all((r["keep_id"], r["group_size"]) == sha[r["text_sha256"]] for r in got)
    assert sorted(r["text_sha256"] for r in got if r["kept"]) == sorted(sha)  # one of each, of repeated rows too
    assert exact_dedup.exact_duplicates(frame(spark, [])).collect() == []
    nulls = exact_dedup.exact_duplicates(frame(spark, [(None, None), (None, None), (None, "")])).collect()
    assert [(r["keep_id"], r["group_size"]) for r in nulls] == [(None, 3)] * 3 and sum(r["kept"] for r in nulls) == 1


def test_keep_one_keeps_columns(spark):
    df = frame(spark)
    left = exact_dedup.keep_one(df)
    assert left.columns == df.columns
    assert sorted(r["text"] or "" for r in left.collect()) == sorted({t or "" for _, t in EDGES})


# whitening


def test_gram_is_exact():
    rng = random.Random(3)
    for size in (3, 1 << 19, (1 << 20) - 1, 1 << 33, 1 << 62):
        y = [[rng.randint(-size, size) for _ in range(3)] for _ in range(50)]
        want = [[sum(r[i] * r[j] for r in y) for j in range(3)] for i in range(3)]
        assert whitening.gram(np.array(y, np.int64)).tolist() == want
        assert whitening.gram(np.array(y, object)).tolist() == want
    full = np.full((whitening.BLOCK, 2), (1 << whitening.LIMB) - 1, np.int64)
    assert whitening.gram(full)[0, 1] == whitening.BLOCK * ((1 << whitening.LIMB) - 1) ** 2


def plain_whitening(rows, components=8):
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * np.float64(np.float32(c))) + 100000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    v = np.array([[float(sum(Fraction(n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x) / n**3) for j in range(d)] for i in range(d)])
    e, a = np.linalg.eigh(v)
    order = np.argsort(-e)[:components]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(r, s, strict=True)) for r in x]
    scores = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(r, s, strict=True)] for r in x]) @ a[:, order] / np.sqrt(e[order])
    return rows, deviation, scores, e[order] / np.trace(v)


def test_whitening_equals_the_plain_version(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(300, 12)) * np.linspace(0.1, 3, 12) + 5
    rows = [(i, [float(np.float32(c)) for c in r]) for i, r in enumerate(data)]
    rows += [(1000, None), (1001, [None] * 12), (1002, [math.nan] * 12), (1003, [math.inf] + [0.0] * 11), (1004, [1.0] * 5), (None, rows[0][1]), (3, rows[3][1]), (1005, [])]
    usable = [r for r in rows if r[1] is None or len(r[1]) == 12]
    kept, deviation, scores, explained = plain_whitening(usable)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("1 AS v", "2 AS d", "3 AS n", "*").repartition(5)
    got = whitening.whiten(df).collect()
    assert len(got) == 8 * len(kept) and {r["n"] for r in got} == {len(kept)}
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(deviation)
    for k in range(1, 9):
        ours = {(r["vec_id"], r["deviation"]): r["whitened"] for r in got if r["component"] == k}
        theirs = {(i, dev): scores[j, k - 1] for j, ((i, _), dev) in enumerate(zip(kept, deviation, strict=True))}
        sign = 1 if ours[5, deviation[5]] * theirs[5, deviation[5]] > 0 else -1
        assert ours.keys() == theirs.keys() and all(abs(ours[x] - sign * theirs[x]) < 1e-9 for x in ours)
    assert all(abs(r["explained"] - explained[r["component"] - 1]) < 1e-9 and r["identity_error"] < 1e-9 for r in got)


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [math.nan]), (3, [])], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 4, schema)).collect() == []  # nothing varies
    far = whitening.whiten(spark.createDataFrame([(k, [1e17 * k, float(k % 3)]) for k in range(6)] + [(9, [1e300, 1.0])], schema)).collect()
    x = [[math.floor(1024 * 1e17 * k) + 100000, 1024 * (k % 3) + 100000] for k in range(6)]
    x = [[min(a, 2**63 - 1), b] for a, b in x] + [[2**63 - 1, 1024 + 100000]]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = {str(sum((7 * c - t) ** 2 for c, t in zip(r, s, strict=True))) for r in x}
    assert {r["deviation_exact"] for r in far} == want and {r["deviation"] for r in far} == {None}


# conversations

MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
FILL = {0: 2, 1: 2, 2: 3, 3: 2}


def cheapest(turns):
    """turns (initial, must go, truncated) -> (cost, audit, what is left), by all ways from the front, each state's best."""
    best = {0: (0, "", ())}
    put = lambda now, s, way: now.__setitem__(s, min(way, now[s])) if s in now else now.__setitem__(s, way)

    def filled(now):
        for _ in range(3):
            for s, (c, a, t) in list(now.items()):
                put(now, FILL[s], (c + 2, a + "I", (*t, (FILL[s], None))))
        return now

    for k, (initial, must, late) in enumerate(turns):
        new = {}
        for s, (c, a, t) in filled(best).items():
            put(new, s, (c + 3, a + "D", t))
            if not must:
                if s in MOVES.get(initial, {}):
                    put(new, MOVES[initial][s], (c + late, a + "K", (*t, (0, k))))
                put(new, FILL[s], (c + 2 + late, a + "R", (*t, (FILL[s], k))))
        best = new
    return min(v for s, v in filled(best).items() if s in (0, 3))


def plain_repair(rows, damage):
    low = lambda v: (v is not None, v if v is not None else 0)
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
            mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    told = {}
    for conv, mine in out.items():
        mine.sort(key=lambda r: (low(r[0]), r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        turns, seen, counts = [], set(), [0, 0, 0]
        for _, role, text in mine:
            said = text.rstrip(" \t\n\v\f\r")
            fault = 0 if not said else 1 if (role, text) in seen else 2 if said[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                counts[fault] += 1
            turns.append((role[:1], fault < 2, fault == 2))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        numbers = [t for t, _, _ in mine if t is not None]
        cost, audit, left = cheapest(turns)
        lines = [f"{ {2: 'user', 3: 'assistant'}[s] if s else mine[k][1]}:{mine[k][2] if k is not None else ''}" for s, k in left]
        told[conv] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return told


def some_conversations(seed=5):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(150)]:
        for turn in range(rng.choice([1, 2, 3, 5, 9, 14])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "a"])
            text = rng.choice(["Yes.", "No", "", None, " \t", "What? ", "So\n", "Fine!", f"Turn {turn}.", f"Turn {turn}"])
            rows.append((conv, rng.choice([turn, turn, turn, turn // 2, turn + 3, None]), role, text))
    return rows + [(500, k, ("user", "assistant")[k % 2], f"Word {k}" + "." * (k % 7 > 0)) for k in range(90)]


def test_repair_equals_the_plain_version(spark):
    rows = some_conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("1 AS piece", "2 AS idx", "*", "3 AS kind", "4 AS copy").repartition(6)
    for damage in (True, False):
        want = plain_repair(rows, damage)
        for bits in (1, 3, 12):  # pieces of two turns and of eight: the same as whole conversations
            got = {r[0]: tuple(r)[1:] for r in conversations.repair(df, damage=damage, piece_bits=bits).collect()}
            assert got == want


def test_repair_edges(spark):
    schema = "conv_id long, turn int, role string, text string"
    assert conversations.repair(spark.createDataFrame([], schema), damage=True).collect() == []
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    got = conversations.repair(spark.createDataFrame([(gone, 0, "user", "Hi.")], schema), damage=True).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", nothing)]
    nulls = conversations.repair(spark.createDataFrame([(None, None, None, None)] * 3, schema)).collect()
    assert [tuple(r) for r in nulls] == [(None, 0, 3, 0, 0, 2, 9, "DDD", nothing)]


# repeated rows in bulk


def test_sharding_splits_repeated_rows(spark):
    from echotable.llm import sharding

    rows = [(None, "the same text")] * 3000 + [(k, f"another text {k}") for k in range(1000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    sums, slots = {}, {}
    for r in got:
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(rows) and len(sums) == 16 and max(sums.values()) < 1.15 * sum(sums.values()) / 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_packing_spreads_repeated_rows(spark):
    import public_tokenizers

    from echotable.llm import packing

    rows = [(7, "so it goes on")] * 2000 + [(k, "word " * k) for k in range(1, 300)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["doc_id"] == 7 for r in got) >= 2000
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(o + n == p for (o, n), (p, _) in zip(b, b[1:], strict=False)) and b[-1][0] + b[-1][1] <= 1024
    assert len(bins) <= -(-sum(r["length"] for r in got) // 1024) * 11 // 9 + 1

"""Secrets in texts: fixed patterns, and a battery of randomness tests.

Beside the patterns (assignments, access keys, long hex runs) every run of 16 or more key characters that mixes kinds of
characters is a candidate; shorter ones hold too little evidence to be told from names at any rate. Its encoding is the
smallest alphabet that holds it. Random keys are uniform and independent over their alphabet; names, paths and numbers
are not. Three tests ask for that: chi-squared of the character counts (with its exact mean and variance, as counts are
small), the number of runs above and below a split of the alphabet between kinds of characters, and the correlation of
neighbours. Fisher's method combines them, and the logarithm of its p-value is the evidence against randomness.

What must be controlled is how often a name is called a secret. So the null hypothesis is that a candidate is a name: names
put together from common words and numbers, in the styles of code and paths, give the distribution of the evidence for
names of its length and encoding, and a candidate's p-value is the chance that such a name looks as random. Over all
candidates of the corpus the Benjamini-Hochberg procedure claims secrets at a false-discovery rate of `rate`. Longer candidates carry more
evidence and get more weight (length over mean length, bounded, with mean one). The procedure needs the sorted
p-values only by rank, which a histogram of their logarithms gives; it has a fixed number of bins.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import documents_of, stored

# Fixed patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # the same as AKIA[A-Z0-9]+ of 16 and more: no match can start inside a shorter one
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: In orders that keep kinds of characters together, so that runs and correlation see where kinds follow themselves.
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ+/abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ-_abcdefghijklmnopqrstuvwxyz")
SPLITS = dict(zip(ALPHABETS, (10, 10, 26, 10, 10, 36, 38, 38), strict=True))
_SETS = [frozenset(a) for a in ALPHABETS]
LENGTHS = (16, 20, 24, 32, 48, 80)  # where the lengths' classes begin
# Fixed: common words of names in code, paths and prose.
NAME_WORDS = """get set user account details by id handle incoming request response for maximum number of retries this is a very long class name service
factory main test data list item value key index count total file path source target update delete create insert select order customer product price
date time start end first last next message error event state status config default internal public static model view page content text document version
chapter section the and with from into over under between about world people water history system example report license general information""".split()
BINS = 4000  # hundredths of a power of ten, from 1 down to 1e-40


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and then by kind as listed."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def encoding(token: str) -> str | None:
    """The smallest alphabet that holds the token, if it mixes letters with digits or upper with lower case."""
    used = set(token)
    kinds = sum((any(c.isdigit() for c in used), any(c.islower() for c in used), any(c.isupper() for c in used)))
    if kinds < 2 or len(used) < 6:
        return None
    return next((a for a, s in zip(ALPHABETS, _SETS, strict=True) if used <= s), None)


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str, alphabet: str) -> float:
    """Combined p-value that the token is drawn uniformly and independently from the alphabet."""
    x = np.array([alphabet.index(c) for c in token])
    n, k = len(x), len(alphabet)
    counts = np.bincount(x, minlength=k)
    chi = float((counts.astype(float) ** 2).sum() * k / n - n)
    # a gamma variable with the exact mean and variance, by the cube-root normal approximation
    mean, var = k - 1, 2 * (k - 1) * (n - 1) / n
    shape, scale = mean * mean / var, var / mean
    p_chi = _upper_tail(((max(chi, 1e-9) / (shape * scale)) ** (1 / 3) - (1 - 1 / (9 * shape))) * math.sqrt(9 * shape))
    high = x >= SPLITS[alphabet]  # letters against digits, lower against upper case
    up, low = int(high.sum()), int(n - high.sum())
    if up and low:
        runs = 1 + int(np.count_nonzero(np.diff(high)))
        mean_r = 1 + 2 * up * low / n
        var_r = (mean_r - 1) * (mean_r - 2) / (n - 1)
        p_runs = 2 * _upper_tail(abs(runs - mean_r) / math.sqrt(var_r)) if var_r > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    y = x - x.mean()
    r = float((y[1:] * y[:-1]).sum() / max((y * y).sum(), 1e-9))
    p_serial = 2 * _upper_tail(abs(r + 1 / n) * math.sqrt(n))
    half = -sum(math.log(min(1.0, max(p, 1e-40))) for p in (p_chi, p_runs, p_serial))  # Fisher: chi-squared with six degrees
    return min(1.0, math.exp(-half) * (1 + half + half * half / 2))


def evidence(token: str, alphabet: str) -> float:
    """The square root of minus the logarithm of the battery's p-value: near 1 for random keys, the larger the more structure."""
    return math.sqrt(-math.log(max(battery(token, alphabet), 1e-300)))


def length_class(n: int) -> int:
    return bisect_right(LENGTHS, n) - 1


STYLES, REFUTED = 8, 1e-4


def names(count: int = 6000) -> Iterator[str]:
    """Names as people make them, always the same ones."""
    rng = random.Random(20)
    for i in range(count):
        words = [rng.choice(NAME_WORDS) for _ in range(rng.randint(3, 14))]
        number = str(rng.choice((rng.randint(0, 9), rng.randint(10, 999), rng.randint(1990, 2030), rng.randint(10**5, 10**9))))
        if i % 3 == 0:
            words.insert(rng.randint(1, len(words)), number)
        style = i % STYLES
        if style == 0:
            yield words[0] + "".join(w.capitalize() for w in words[1:])
        elif style == 1:
            yield "".join(w.capitalize() for w in words)
        elif style in (2, 3):
            yield "-_"[style - 2].join([*words, number])
        elif style == 4:
            yield "/".join(w.capitalize() if rng.random() < 0.3 else w for w in words) + "/" + number
        elif style == 5:
            yield "".join(words[:8]) + number
        elif style == 6:
            yield "_".join(words).upper() + number
        else:  # dates and numbers with a few letters
            yield "".join(rng.choice((str(rng.randint(1990, 2030)) + f"{rng.randint(1, 12):02d}{rng.randint(1, 28):02d}", f"{rng.randint(0, 10**4):06d}", "abcdef"[rng.randint(0, 5)], "000")) for _ in range(rng.randint(4, 9)))


@lru_cache(1)
def name_evidence() -> dict[tuple[int, int], list[tuple[float, float]]]:
    """(size of the alphabet, class of length) -> mean and deviation of the evidence of each style of names; alphabet 0 is all of them."""
    found: dict[tuple[int, int, int], list[float]] = defaultdict(list)
    for i, name in enumerate(names()):
        if alphabet := encoding(name):
            x = evidence(name, alphabet)
            for k in (len(alphabet), 0):
                found[k, length_class(len(name)), i % STYLES].append(x)
    out: dict[tuple[int, int], list[tuple[float, float]]] = defaultdict(list)
    for (k, c, _), v in sorted(found.items()):
        if len(v) >= 20:
            out[k, c].append((float(np.mean(v)), max(float(np.std(v)), 0.3)))
    return dict(out)


def chance(token: str, alphabet: str, known: dict[tuple[int, int], list[tuple[float, float]]]) -> float:
    """How likely a name of this length and alphabet looks at least as random as the token, in the style in which that is likeliest.

    1 for a token that the battery refutes as random by itself, at REFUTED: it can't be a key.
    """
    c = length_class(len(token))
    x = evidence(token, alphabet)
    if x * x > -math.log(REFUTED):
        return 1.0
    return max(1e-40, *(_upper_tail((mean - x) / deviation) for mean, deviation in known.get((len(alphabet), c)) or known[0, c]))


def candidates(text: str, base: list[tuple[int, int, str]], known: dict[tuple[int, int], list[tuple[float, float]]]) -> list[tuple[int, int, float]]:
    """(start, end, p) of the candidates that touch no base span; base is sorted by start."""
    out, at, taken = [], 0, 0
    for m in CANDIDATE.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            taken = max(taken, base[at][1])
            at += 1
        token = m[0].rstrip("=")
        if taken <= m.start() and (alphabet := encoding(token)):
            out.append((m.start(), m.end(), chance(token, alphabet, known)))
    return out


def _bin(p: F.Column) -> F.Column:
    return F.least(F.lit(BINS), F.floor(-F.log10(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-40))) * 100)).cast("int")


def claimed_from(histogram: dict[int, int], rate: float) -> int:
    """The first bin, from small p on the last one, whose candidates Benjamini-Hochberg claims as secrets."""
    total, below = sum(histogram.values()), 0
    first = BINS + 1
    for b in sorted(histogram, reverse=True):
        below += histogram[b]
        if 10 ** (-b / 100) <= rate * below / total:  # the largest p that the bin may hold
            first = b
    return first


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined), n_random, of every document.

    Spans count code points, ends exclusive; those of an assignment take in its name. A null text has none. Rows with
    a null or repeated id are rows like any other. An empty table gives no rows.
    """
    docs = documents_of(docs, id_col, text_col)
    known = name_evidence()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("nth", pa.int32()), ("end", pa.int64())])
        tested = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])
        for batch in batches:
            bases, digests, tests = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                bases.append([{"start": i, "nth": KINDS.index(k), "end": j} for i, j, k in base])
                digests.append(hashlib.sha256(",".join(f"{k}:{i}:{j}" for i, j, k in base).encode()).hexdigest())
                tests.append([{"start": i, "end": j, "p": p} for i, j, p in candidates(text, base, known)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, pa.list_(span)), pa.array(digests, pa.string()), pa.array(tests, pa.list_(tested))], ["doc_id", "base", "base_sha256", "tested"])

    found = stored(docs.mapInArrow(read, "doc_id long, base array<struct<start:long,nth:int,end:long>>, base_sha256 string, tested array<struct<start:long,end:long,p:double>>"))
    each = found.select(F.explode("tested").alias("t")).select((F.col("t.end") - F.col("t.start")).alias("n"), "t.p")
    mean = each.agg(F.coalesce(F.avg("n"), F.lit(1.0))).first()[0]

    def share(n: F.Column) -> F.Column:
        return F.greatest(F.lit(0.25), F.least(F.lit(4.0), n / F.lit(mean)))

    unit = each.agg(F.coalesce(F.avg(share(F.col("n"))), F.lit(1.0))).first()[0]  # makes the weights' mean one

    def weighted(p: F.Column, n: F.Column) -> F.Column:
        return p * F.lit(unit) / share(n)

    histogram = {r[0]: r[1] for r in each.groupBy(_bin(weighted(F.col("p"), F.col("n"))).alias("bin")).count().collect()}
    first = claimed_from(histogram, rate)
    claimed = F.filter("tested", lambda t: _bin(weighted(t["p"], t["end"] - t["start"])) >= F.lit(first))
    spans = F.array_sort(F.concat("base", F.transform(claimed, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("nth"), t["end"].alias("end")))))
    kinds = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["nth"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda i: F.size(F.filter("base", lambda s: s["nth"] == i)).cast("long")
    return found.select("doc_id", *[number(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])], "base_sha256", text.alias("spans"), F.size(claimed).cast("long").alias("n_random"))

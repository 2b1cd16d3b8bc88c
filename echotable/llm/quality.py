"""Quality from weak labels.

Heuristic labellers vote good, bad or nothing on each document. No labeller is right always and none is trusted
beforehand: expectation-maximisation over the votes of all documents estimates how accurate each is (a two-class
Dawid-Skene model in which silence carries no weight). It needs only how many documents have each pattern of votes, a
table bounded by the labellers. The posterior of its pattern is a document's weak label.

Posterior labels train a linear scorer over hashed features, word shapes and their pairs, so that documents
on which the labellers are silent are judged by what they look like. It is fitted on a sample of bounded size,
drawn by a hash of id and features, and scores every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import documents_of, stored

DIMENSIONS = 2048
_KINDS = str.maketrans({**{c: "9" for c in "0123456789"}})
_LETTERS = re.compile(r"[^\W\d_]+")


def votes(text: str, words: list[str]) -> list[int]:
    """1 good, -1 bad, 0 nothing, from each labeller."""
    n, size = len(words), max(len(text), 1)
    letters = sum(map(str.isalpha, text)) / size
    upper = sum(map(str.isupper, text)) / max(sum(map(str.isalpha, text)), 1)
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    common = Counter(words).most_common(1)[0][1] / n if n else 1.0
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(n - 1, 1)
    ends = sum(x[-1] in ".!?\"”»" for x in lines) / max(len(lines), 1)
    mean = sum(map(len, words)) / max(n, 1)
    odd = sum(text.count(c) for c in "%&$#*|<>{}=~^\\") / max(n, 1)
    repeated = 1 - len(set(lines)) / max(len(lines), 1)

    def vote(bad: bool, good: bool) -> int:
        return -1 if bad else int(good)

    return [
        vote(letters < 0.7, letters > 0.77),
        vote(upper > 0.3, upper < 0.12),
        vote(n >= 10 and common > 0.2, n >= 30 and common < 0.12),
        vote(doubled > 0.1, n >= 30 and doubled < 0.03),
        vote(ends < 0.3, ends > 0.7),
        vote(mean > 12 or n > 0 and mean < 2.5, 3.5 < mean < 8.5),
        vote(odd > 0.15, odd < 0.01),
        vote(repeated > 0.3, len(lines) >= 3 and repeated < 0.05),
    ]


LABELLERS = 8


def shape(word: str) -> str:
    """Runs of letters by case, of digits, and other characters as they are, each at most twice."""
    out = []
    for c in word[:32]:
        k = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if len(out) < 2 or out[-1] != k or out[-2] != k:
            out.append(k)
    return "".join(out)


class Features:
    """Hashed counts of word shapes, of pairs of them, and of how neighbouring words relate; scaled to length one."""

    def __init__(self) -> None:
        self.shapes: dict[str, str] = {}

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.shapes) > 200_000:
            self.shapes.clear()
        shapes = [self.shapes.get(w) or self.shapes.setdefault(w, shape(w)) for w in words]
        found = Counter(shapes)
        found.update(Counter(zip(shapes, shapes[1:], strict=False)))
        same = sum(a == b for a, b in zip(words, words[1:], strict=False))
        found["same"] = same
        slots = np.fromiter((xxhash.xxh3_64_intdigest(repr(k).encode("utf-8", "surrogatepass")) % DIMENSIONS for k in found), np.int32, len(found))
        values = np.sqrt(np.fromiter(found.values(), np.float64, len(found)))
        norm = np.sqrt((values**2).sum())
        return slots, (values / norm if norm else values)


def estimate(patterns: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], np.ndarray, float]:
    """EM over vote patterns ("1,-1,0,...": documents) -> posterior of good by pattern, accuracies, prior of good."""
    names = sorted(patterns)
    if not names:
        return {}, np.full(LABELLERS, 0.7), 0.5
    v = np.array([[int(x) for x in p.split(",")] for p in names])
    n = np.array([patterns[p] for p in names], float)
    good, bad = (v == 1).astype(float), (v == -1).astype(float)
    # share of good votes among a labeller's votes, in either class; a labeller is better than chance to start with
    right = np.tile(np.array([[0.8], [0.2]]), (1, v.shape[1]))
    prior = 0.8
    for _ in range(rounds):
        log = np.stack([good @ np.log(right[c]) + bad @ np.log(1 - right[c]) + np.log([prior, 1 - prior][c]) for c in (0, 1)])
        post = 1 / (1 + np.exp(np.clip(log[1] - log[0], -50, 50)))
        for c, w in enumerate((n * post, n * (1 - post))):
            # two votes of prior on each side keep rates off 0 and 1
            right[c] = (w @ good + [1.6, 0.4][c]) / (w @ good + w @ bad + 2)
        prior = float(np.clip((n @ post) / n.sum(), 0.01, 0.99))
    accuracy = prior * right[0] + (1 - prior) * (1 - right[1])
    return dict(zip(names, post.tolist(), strict=True)), accuracy, prior


def fit(rows: list, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels: rows of (slots, values, posterior)."""
    if not rows:
        return np.zeros(DIMENSIONS), 0.0
    x = np.zeros((len(rows), DIMENSIONS), np.float32)
    for i, (slots, values, _) in enumerate(rows):
        np.add.at(x[i], np.asarray(slots), np.asarray(values, np.float32))
    y = np.array([r[2] for r in rows], np.float32)
    w, b, vw, vb = np.zeros(DIMENSIONS, np.float32), np.float32(0), np.zeros(DIMENSIONS, np.float32), np.float32(0)
    for _ in range(rounds):  # gradient steps with momentum
        p = 1 / (1 + np.exp(-(x @ w + b)))
        d = (p - y) / len(y)
        vw, vb = 0.9 * vw - 2.0 * (x.T @ d + 1e-5 * w), 0.9 * vb - 2.0 * d.sum()
        w, b = w + vw, b + vb
    return w.astype(float), float(b)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 6000) -> DataFrame:
    """doc_id, score (0 to 1, of being good), keep (score >= 0.5), posterior (of the votes alone), pattern.

    Labels are made by the labellers; none are read. Null and empty texts get votes as any other, which makes them bad. Rows with a
    null or repeated id are scored like any others. Equal texts get equal scores. An empty table gives no rows. `sample` bounds
    the rows of the fit, whatever ids or texts repeat.
    """
    docs = documents_of(docs, id_col, text_col)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            patterns, slots, values = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                words = text.split()
                patterns.append(",".join(map(str, votes(text, words))))
                s, x = features.of(words)
                slots.append(s)
                values.append(x.astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(patterns), pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["doc_id", "pattern", "slots", "values"])

    seen = stored(docs.mapInArrow(read, "doc_id long, pattern string, slots array<int>, values array<float>"))
    patterns = {r[0]: r[1] for r in seen.groupBy("pattern").count().collect()}  # at most 3 ** LABELLERS
    posterior, _, _ = estimate(patterns)
    # the rows with the least hashes of id and features, never more than `sample`, whatever repeats
    drawn = seen.select("slots", "values", "pattern").orderBy(F.xxhash64(F.lit("fit"), "doc_id", "slots", "values"), F.hash("slots")).limit(sample).collect()
    weights, bias = fit([(r[0], r[1], posterior[r[2]]) for r in drawn])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [bias + float(weights[s] @ x) if len(s) else -20.0 for s, x in ((np.asarray(a.values), np.asarray(b.values)) for a, b in zip(batch.column("slots"), batch.column("values"), strict=True))]
            found = batch.column("pattern").to_pylist()
            p = 1 / (1 + np.exp(-np.clip(np.array(scores, float), -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(p >= 0.5), pa.array([posterior[x] for x in found], pa.float64()), batch.column("pattern")], ["doc_id", "score", "keep", "posterior", "pattern"])

    return seen.mapInArrow(score, "doc_id long, score double, keep boolean, posterior double, pattern string")

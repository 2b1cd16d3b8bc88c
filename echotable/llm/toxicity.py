"""Toxicity by a weighted finite-state grammar over clauses.

Lexicon. Words and word beginnings that tell toxic from other documents are learned from labelled documents as weighted
arcs: the weight is the smoothed log ratio of how often toxic and other documents have them. Arcs pass
a likelihood-ratio test with false-discovery control over all that were counted, and an arc that another one
contains is left out. A short list of insults starts the lexicon; what is learned of them replaces it.

Grammar. A clause is read as a string of word classes: insult, threat, target, negation, reported speech, other. Five
transducers are composed into one: each reads what the one before writes. Negation marks insults and threats shortly
after a negation, reported speech those after a verb of saying, the insult transducer lets through only insults that
stand with another word, the threat transducer only threats, and the target transducer gives the factor of a match: an insult
counts more with a target near by, a threat only with one. A clause scores the sum of its matches in the log semiring, in
which two like ones add little to one, and nothing without a match: an insult alone says nothing. What a document
says is the sum over its clauses.

Calibration. Two numbers map that sum to a score, by logistic regression on a histogram of the labelled documents' sums.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import rows_of, stored, text_hash, without_ids

# Fixed word lists: English, French, German, Spanish.
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting imbecile imbécile crétin connard ordure idiota estúpido imbécil basura dummkopf trottel abschaum arschloch".split()
THREATS = "kill hurt destroy punish murder tuer frapper détruire töten umbringen zerstören matar golpear destruir".split()
TARGETS = "you your yours they them he she him her these those tu te vous toi votre ils elles du dich dir ihr euch sie usted ustedes ellos ellas".split()
NEGATIONS = "not never no without isn't aren't don't doesn't wasn't pas jamais sans nicht nie kein keine ohne nunca jamás sin".split()
REPORTS = "said says say called calls wrote writes quoted quotes claimed claims dit disait écrit sagte sagt schrieb dijo dice escribió".split()

#: Symbols of the grammar: I insult, H threat, T target, N negation, R reported speech, O other.
_CLASSES = {w: c for c, words in (("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("H", THREATS)) for w in words}
CLAUSE = re.compile(r"[.!?;:\n]+")
CLAUSE_END = re.compile(r"[.!?;:\n\s]*$")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
STEMS = (4, 5, 6)

Symbol = tuple[str, bool, bool]  # what it is, negated, reported


class Transducer:
    """arcs[state][symbol] = (next state, symbol written, factor), from state 0."""

    def __init__(self, arcs: list[dict]):
        self.arcs = arcs

    @classmethod
    def of(cls, symbols: list, start, step: Callable) -> Transducer:
        """All that step(state, symbol) -> (state, symbol written, factor) reaches from start."""
        numbers, arcs, todo = {start: 0}, [], [start]
        for state in todo:  # grows
            row = {}
            for symbol in symbols:
                to, out, factor = step(state, symbol)
                if to not in numbers:
                    numbers[to] = len(numbers)
                    todo.append(to)
                row[symbol] = (numbers[to], out, factor)
            arcs.append(row)
        return cls(arcs)

    def compose(self, other: Transducer) -> Transducer:
        """The other reads what this one writes; factors multiply."""

        def step(pair, symbol):
            s, middle, x = self.arcs[pair[0]][symbol]
            t, out, y = other.arcs[pair[1]][middle]
            return (s, t), out, x * y

        return Transducer.of(list(self.arcs[0]), (0, 0), step)


def grammar() -> Transducer:
    """Reads word classes; the factor of a position, if not 0, matches the last insult or threat up to there."""
    strong = [(k, n, r) for k in "IH" for n in (False, True) for r in (False, True)]
    plain = [(k, False, False) for k in "OTNR"]
    words = plain + strong

    def negation(left, symbol):  # a negation reaches three words
        k, n, r = symbol
        return (3 if k == "N" else max(0, left - 1)), (k, n or (k in "IH" and left > 0), r), 1.0

    def report(said, symbol):  # a verb of saying reaches to the end of the clause
        k, n, r = symbol
        return said or k == "R", (k, n, r or (k in "IH" and said)), 1.0

    def insult(state, symbol):  # "" at the start of a clause, "w" after a word, or the insult that waits for one
        k = symbol[0]
        if state not in ("", "w"):  # the first word was an insult: with this one it's a match
            return "w", ("IT" if k == "T" else "I", *state[1:]) if k != "H" else symbol, 1.0
        if k == "I":
            return (symbol, ("O", False, False), 1.0) if state == "" else ("w", symbol, 1.0)
        return "w", symbol, 1.0

    def threat(_, symbol):  # threats and insults alike go on as matches; negations and verbs of saying have done their work
        return 0, (("O", False, False) if symbol[0] in "NR" else symbol), 1.0

    def target(state, symbol):  # words since a target, what waits for one and for how many words
        (near, waits, left), (k, n, r) = state, symbol
        factor = (0.35 if n else 1.0) * (0.5 if r else 1.0)
        seen = 6 if "T" in k else max(0, near - 1)
        if k == "I" and not seen:
            return (seen, (1.25, factor), 2), "m", factor
        if k in ("I", "IT"):
            return (seen, None, 0), "m", 1.25 * factor
        if k == "H":
            return ((seen, None, 0), "m", factor) if seen else ((0, (1.0, factor), 4), "", 0.0)
        if k == "T" and waits:
            return (seen, None, 0), "m", waits[0] * waits[1]
        return (seen, waits if left > 1 else None, max(0, left - 1)), "", 0.0

    heard = [(k, n, r) for k in ("I", "IT", "H") for n in (False, True) for r in (False, True)] + [(k, False, False) for k in "OT"]
    machine = Transducer.of(plain + [(k, False, False) for k in "IH"], 0, negation).compose(Transducer.of(words, False, report))
    machine = machine.compose(Transducer.of(words, "", insult)).compose(Transducer.of(heard + [s for s in plain if s[0] in "NR"], 0, threat))
    return machine.compose(Transducer.of(heard, (0, None, 0), target))


def arcs_of(text: str) -> dict[str, int]:
    """The words (=word) and beginnings (stem-) of a text that may become arcs, each with a hash of the words around its first place."""
    words = WORD.findall(text.lower())
    out: dict[str, int] = {}
    seen = set()
    for i, w in enumerate(words):
        if len(w) >= 3 and w not in seen:
            seen.add(w)
            around = xxhash.xxh3_64_intdigest(" ".join(words[max(0, i - 1) : i + 2])) >> 1
            for arc in (f"={w}", *[f"{w[:k]}-" for k in STEMS if len(w) > k]):
                out.setdefault(arc, around)
    return out


def learn(docs: DataFrame, labelled: DataFrame, sample: int, rate: float = 0.001) -> dict[str, float]:
    """Weighted arcs from docs (doc_id, text) and labelled (id, toxic), at most about `sample` documents of them, chosen by a hash of the id."""
    part = min(1.0, sample / max(labelled.count(), 1))
    chosen = labelled.where(F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1 << 20)) < F.lit(part * (1 << 20)))
    read = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean: Counter = Counter()
            arcs, around = [], []
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text"), strict=True):
                found = arcs_of(text.as_py() or "")
                if toxic:
                    arcs += found
                    around += found.values()
                else:
                    clean.update(found.keys())
            yield pa.RecordBatch.from_arrays([pa.array([*arcs, *clean], pa.string()), pa.array(around + [None] * len(clean), pa.int64()), pa.array([0] * len(arcs) + list(clean.values()), pa.int64())], ["arc", "around", "n0"])

    n0, n1 = (chosen.where(F.col("toxic") == x).count() for x in (0, 1))
    # copies of one toxic text would make any of its words an insult: occurrences between the same words count once
    counts = read.mapInArrow(count, "arc string, around long, n0 long").groupBy("arc").agg(F.count_distinct("around").alias("n1"), F.sum("n0").alias("n0")).where("n1 >= 3")
    weight = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0))
    # twice the log likelihood ratio against one common share
    log = lambda k, p: F.when(k > 0, k * F.log(p)).otherwise(0.0)
    a, b = F.col("n1"), F.col("n0")
    p, p1, p0 = (a + b) / F.lit(float(n1 + n0 or 1)), a / F.lit(float(n1 or 1)), b / F.lit(float(n0 or 1))
    g = 2 * (log(a, p1) + log(n1 - a, 1 - p1) + log(b, p0) + log(n0 - b, 1 - p0) - log(a + b, p) - log(n1 + n0 - a - b, 1 - p))
    counts = stored(counts.select("arc", "n1", "n0", weight.alias("weight"), g.alias("g")))
    tested = counts.count()
    # an arc must make a document toxic rather than not by four to one; below `least` no arc can pass the procedure at its rate
    least = max(0.0, 2 * -math.log(rate) - 8)
    strong = counts.where("n1 + 0.5 >= 4 * (n0 + 0.5) AND weight > 0").where(F.col("g") >= least).orderBy(F.desc("g"), "arc").collect()  # bounded by the sample
    kept = 0
    for i, r in enumerate(strong, 1):  # Benjamini-Hochberg; the tail of chi-squared with one degree
        if math.erfc(math.sqrt(max(r["g"], 0) / 2)) <= rate * i / max(tested, 1):
            kept = i
    arcs: dict[str, float] = {w: 2.5 for w in (f"={w}" for w in INSULTS)}
    arcs |= widest({r["arc"]: (r["n1"], r["weight"]) for r in strong[:kept]})
    for r in counts.where(F.col("arc").isin([f"={w}" for w in INSULTS])).collect():  # what was learned of the first words
        arcs[r["arc"]] = r["weight"]
    return {a: w for a, w in arcs.items() if w > 0}


def widest(found: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Of arcs with (documents, weight), a beginning instead of all that start with it where it is in clearly more documents, else those."""
    out = {a: v for a, v in found.items() if a[0] == "="}
    for k in sorted(STEMS, reverse=True):
        for arc in (a for a in found if a[-1] == "-" and len(a) == k + 1):
            under = [a for a in out if a.strip("=-").startswith(arc[:-1])]
            if found[arc][0] > 1.1 * max((out[a][0] for a in under), default=0) + 1:
                for a in under:
                    del out[a]
                out[arc] = found[arc]
    return {a: w for a, (_, w) in out.items()}


class Scorer:
    def __init__(self, arcs: dict[str, float]):
        self.arcs = grammar().arcs
        self.words = {a[1:]: w for a, w in arcs.items() if a[0] == "="}
        self.stems = {a[:-1]: w for a, w in arcs.items() if a[-1] == "-"}
        threats = [re.escape(w) for w in THREATS]
        heads = [re.escape(w) + r"\b" for w in sorted(self.words)] + [re.escape(s) for s in sorted(self.stems)] + [w + r"\b" for w in threats]
        self.any = re.compile(r"\b(?:" + "|".join(heads) + ")")

    def _read(self, word: str) -> tuple[Symbol, float]:
        weight = self.words.get(word) or max((self.stems.get(word[:k], 0.0) for k in STEMS if len(word) > k), default=0.0)
        kind = _CLASSES.get(word, "O")
        if kind == "H":
            return ("H", False, False), weight or 2.0
        return ("I" if weight else kind, False, False), weight

    def clause(self, words: list[str]) -> float:
        """The sum, in the log semiring, over the insults and threats that match, each by its best path; 0 without a match."""
        state, held, place, found = 0, 0.0, -1, {}
        for i, word in enumerate(words):
            symbol, weight = self._read(word)
            if weight:
                held, place = weight, i
            state, _, factor = self.arcs[state][symbol]
            if factor:  # for this word, or where it's neither insult nor threat for the last one
                found[place] = max(found.get(place, 0.0), held * factor)
        if not found:
            return 0.0
        most = max(found.values())
        return most + math.log(sum(math.exp(x - most) for x in found.values()))

    def text(self, text: str | None) -> float:
        """The sum over clauses. A single word between marks is no clause of its own but the end of the one before."""
        text = (text or "").lower()
        total, done, start, scored = 0.0, 0, 0, 0.0
        for m in self.any.finditer(text):  # only clauses with an insult or threat weigh anything
            if m.start() < done:
                continue
            first = self._start(text, m.start())
            end = CLAUSE.search(text, m.start())
            stop = end.start() if end else len(text)
            words = WORD.findall(text[first:stop])
            while len(words) == 1 and first > 0:
                first = self._start(text, CLAUSE_END.search(text[max(0, first - 200) : first]).start() + max(0, first - 200))
                words = WORD.findall(text[first:stop])
            best = self.clause(words)
            again = done and first >= start and first < done  # takes in what was scored
            total += max(0.0, best - scored) if again else best
            done, start, scored = stop, first, max(best, scored) if again else best
        return total

    @staticmethod
    def _start(text: str, at: int) -> int:
        return max(text.rfind(c, 0, at) for c in ".!?;:\n") + 1


def calibrate(histogram: list[tuple[int, int, int]]) -> tuple[float, float]:
    """Intercept and slope of a ridge logistic regression on rows (half units of evidence, label, documents)."""
    theta, start = np.array([-3.0, 1.0]), np.array([-3.0, 1.0])
    if not histogram:
        return -3.0, 1.0
    x = np.array([[1.0, min(b, 40) / 2] for b, _, _ in histogram])
    y, n = np.array([r[1] for r in histogram], float), np.array([r[2] for r in histogram], float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (n * (p - y)) + 0.5 * (theta - start)
        hessian = (x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.5 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta = theta - np.clip(step, -2, 2)
    return float(theta[0]), max(0.05, float(theta[1]))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def judged(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """docs (doc_id, text, row) -> doc_id, row, held_out, score, predicted, evidence."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)")
    known = known.where(~held_out("id")).groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    known = stored(known)
    scorer = Scorer(learn(docs, known, sample))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([scorer.text(t.as_py()) for t in batch.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), found], ["doc_id", "row", "evidence"])

    weighed = stored(docs.mapInArrow(score, "doc_id long, row long, evidence double"))
    seen = weighed.join(known, F.col("doc_id") == F.col("id")).groupBy(F.least(F.floor(F.col("evidence") * 2), F.lit(40)).cast("int").alias("b"), "toxic").count()
    intercept, slope = calibrate([tuple(r) for r in seen.orderBy("b", "toxic").collect()])
    p = 1 / (1 + F.exp(-(F.lit(intercept) + F.lit(slope) * F.least("evidence", F.lit(40.0)))))
    return weighed.select("doc_id", "row", held_out().alias("held_out"), p.alias("score"), F.when(p >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 40_000) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of every document.

    labels (doc_id, toxic 0/1) of documents whose crc32(doc_id as text) mod 5 is 0 are not used; of the others at most
    about `sample`, a bound of the fit alone. Null and empty texts have evidence 0 and the score of that; a row with a
    null id is scored and not held out; a label that is null or repeated otherwise is left out. Rows that repeat an id are scored each by
    its text. Without labels the first words and fixed numbers score. An empty table gives no rows.
    """
    return judged(rows_of(docs, id_col, text_col), labels, sample).drop("row")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 40_000) -> DataFrame:
    """docs without the rows predicted toxic by their own text, also where an id repeats.

    Rows with a null id stay, as do null and empty texts. An empty table stays empty; without labels the first words alone judge.
    """
    names = [f"{c}_{uuid.uuid4().hex}" for c in ("id", "row")]  # whatever columns docs has
    keyed = docs.withColumns({names[0]: docs[id_col].cast("long"), names[1]: text_hash(text_col)})
    found = judged(rows_of(docs, id_col, text_col), labels, sample)
    gone = stored(found.where("predicted = 1 AND doc_id IS NOT NULL").select("doc_id", "row").distinct())
    return without_ids(keyed, names, gone).select(docs.columns)

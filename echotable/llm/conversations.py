"""Repair of conversations whose roles should alternate: (system?, then (user, assistant) at least once) or nothing.

The grammar has four states: at the start, behind a system turn, behind a user's and behind an assistant's. Going through
the turns from the last to the first, a bitset for each cost says from which states the rest can be made right at no more than
that cost, as approximate matching by bitsets does: an edit of cost c moves the bits of the layers below by c. The layers of a turn
differ little, so they are nibbles of one integer above the least cost. The first layer that holds the start gives the cost, and
the bits tell at each turn which edits keep to it; the least letter of those is taken.

A conversation may have any length. Rows are put in order over all conversations by range partitioning and cut into pieces.
For each piece and each state at its end the layers give the least costs from the states at its beginning: four by four
numbers. One pass over these from the last piece to the first gives what each piece may end with; pieces are then traced on their own from each
state, and a pass from the first piece to the last picks the trace. Only the digest reads a conversation's texts in one
task, as a digest must, one row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import stored

# fixed values: costs of edits, and the blanks that the contract names
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
#: state -> state that a role of the initial leads to.
MOVES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: state -> state behind the only role of the two that may be put in there.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
LAYERS = 16  # costs of the states differ by less, if a state can be repaired at all
ONES = int("1" * LAYERS, 16)
FULL = (1 << (4 * LAYERS)) - 1
PIECE_BITS = 12

# a turn's code: bits 0 and 1 its initial (s, u, a, other), 4 truncated, 8 to be deleted, 16 blank (with 8; duplicate without 16)
_INITIAL = "sua"


def before(bits: int, moves: dict[int, int]) -> int:
    """In each nibble the states that `moves` leads to a state of it."""
    out = 0
    for origin, target in moves.items():
        out |= ((bits >> target) & ONES) << origin
    return out


def layers(codes: bytes, least: int, bits: int, open_end: bool) -> list[tuple[int, int]]:
    """(least, bits) for each place before a turn and the end: nibble k of bits has the states whose rest costs at most least + k.

    The last is given; if open_end, turns may be put in behind the last one too.
    """

    def closed(least: int, bits: int) -> tuple[int, int]:
        for _ in range(2):  # at most two turns are put in at a place
            bits |= (before(bits, NEXT) << (4 * INSERT)) & FULL
        while bits and not bits & 15:
            least, bits = least + 1, (bits >> 4) | (bits >> (4 * LAYERS - 4) << (4 * LAYERS - 4))
        return least, bits

    out = [closed(least, bits) if open_end else (least, bits)]
    for code in reversed(codes):
        least, bits = out[-1]
        found = bits << (4 * DELETE)
        if not code & 8:
            late = 4 if code & 4 else 0
            if code & 3 < 3:
                found |= before(bits, MOVES[_INITIAL[code & 3]]) << late
            found |= before(bits, NEXT) << (4 * REROLE + late)
        # what the top layer holds costs no more in any layer above it
        found &= FULL
        out.append(closed(least, found))
    out.reverse()
    return out


def cost_of(layer: tuple[int, int], state: int) -> int | None:
    least, bits = layer
    held = (bits >> state) & ONES
    return None if not held else least + ((held & -held).bit_length() - 1) // 4


def layer_of(costs: list[int | None]) -> tuple[int, int]:
    """The layer in which each state has its cost; states too dear for it can't be on a cheapest way."""
    least = min(c for c in costs if c is not None)
    bits = 0
    for state, c in enumerate(costs):
        if c is not None:
            bits |= ((ONES << (4 * (c - least))) & FULL) << state
    return least, bits & FULL


def matrix(codes: bytes) -> list[int | None]:
    """Least costs of a piece from each state at its beginning (rows) to each at its end; turns are put in before turns only."""
    ends = [layers(codes, *layer_of([0 if s == end else None for s in range(4)]), False)[0] for end in range(4)]
    return [cost_of(ends[end], state) for state in range(4) for end in range(4)]


def traced(codes: bytes, found: list[tuple[int, int]], state: int, last: bool) -> tuple[str, int]:
    """(letters of the edits, state at the end) of the cheapest repair from a state, the least by its letters; `found` as by layers."""
    out, at, cost = [], 0, cost_of(found[0], state)
    while at < len(codes) or (last and cost > 0):
        code = codes[at] if at < len(codes) else None
        then = NEXT[state]
        late = TRUNCATED if code is not None and code & 4 else 0
        if code is not None and cost_of(found[at + 1], state) == cost - DELETE:
            out.append("D")
            at, cost = at + 1, cost - DELETE
        elif (last or code is not None) and cost_of(found[at], then) == cost - INSERT:
            out.append("I")
            state, cost = then, cost - INSERT
        else:
            kept = MOVES[_INITIAL[code & 3]].get(state) if code & 11 < 3 else None
            if kept is not None and cost_of(found[at + 1], kept) == cost - late:
                out.append("K")
                state, cost = kept, cost - late
            else:
                out.append("R")
                state, cost = then, cost - REROLE - late
            at += 1
    return "".join(out), state


def _by(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in by the checksum of `conv_id:turn`: one in twenty each is dropped, emptied, robbed of its full stops, doubled, or the user's."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    out = rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def _ordered(rows: DataFrame) -> DataFrame:
    """rows with idx, rising in the order of conversations and turns, the first digest of role and text, and the code of all but duplicates."""
    said = F.rtrim("text", F.lit(BLANKS))
    blank = said == ""
    initial = F.substring("role", 1, 1)
    letter = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    truncated = ~blank & ~F.substring(said, -1, 1).isin(".", "!", "?")
    code = letter + F.when(blank, 24).when(truncated, 4).otherwise(0)
    rows = rows.withColumns({"said": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), "initial": initial, "code": code.cast("int"), "nth": F.monotonically_increasing_id()})
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("said").asc(), F.col("nth").asc()]
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("idx", F.monotonically_increasing_id()).drop("nth", "copy"))


def _pieces(ordered: DataFrame, piece_bits: int) -> DataFrame:
    """conv_id, piece, codes, costs: the turns of each piece as codes, duplicates told by being no first of their text."""
    piece = F.shiftright("idx", piece_bits).alias("piece")
    light = ordered.select("conv_id", piece, "idx", F.lit(1).alias("first"), "code")
    firsts = ordered.where("code < 8").groupBy("conv_id", "said").agg(F.min("idx").alias("idx")).select("conv_id", piece, "idx", F.lit(0).alias("first"), F.lit(0).alias("code"))
    both = light.unionByName(firsts).repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "idx", "first")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, codes, first_at, done = None, bytearray(), None, []

        def batch_of(done: list) -> pa.RecordBatch:
            conv, piece, codes, costs = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(piece, pa.int64()), pa.array(codes, pa.binary()), pa.array(costs, pa.list_(pa.int64()))], ["conv_id", "piece", "codes", "costs"])

        for conv, piece, idx, first, code in _by(batches, ["conv_id", "piece", "idx", "first", "code"]):
            if key != (conv, piece):
                if key is not None:
                    done.append((*key, bytes(codes), matrix(bytes(codes))))
                    if len(done) >= 1000:
                        yield batch_of(done)
                        done = []
                key, codes = (conv, piece), bytearray()
            if not first:
                first_at = idx
            else:
                codes.append(code if code & 8 or first_at == idx else code & 3 | 8)
        if key is not None:
            yield batch_of([*done, (*key, bytes(codes), matrix(bytes(codes)))])

    return stored(both.mapInArrow(read, "conv_id long, piece long, codes binary, costs array<long>"))


def _ends(pieces: DataFrame) -> DataFrame:
    """conv_id, piece, last, ends: what the rest of the conversation costs from each state at the end of a piece."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ends = None, None
        for batch in batches:
            rows = []
            for conv, piece, costs in zip(batch.column("conv_id").to_pylist(), batch.column("piece").to_pylist(), batch.column("costs").to_pylist(), strict=True):
                last = now != (conv,)
                if last:
                    now, least, bits = (conv,), *layers(b"", *layer_of([0, None, None, 0]), True)[0]
                    ends = [cost_of((least, bits), s) for s in range(4)]
                rows.append((conv, piece, last, ends))
                ends = [min((c + e for c, e in zip(costs[4 * s : 4 * s + 4], ends, strict=True) if c is not None and e is not None), default=None) for s in range(4)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())), strict=True)], ["c", "p", "last", "ends"])

    ordered = pieces.select("conv_id", "piece", "costs").repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("piece").desc())
    return ordered.mapInArrow(read, "c long, p long, last boolean, ends array<long>")


def _traces(pieces: DataFrame) -> DataFrame:
    """conv_id, piece, codes, audits and states (from each state at the beginning), cost (from the start)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, piece, codes, last, ends in _by([batch], ["conv_id", "piece", "codes", "last", "ends"]):
                found = layers(codes, *layer_of([0, None, None, 0] if last else ends), last)
                ways = [traced(codes, found, s, last) if cost_of(found[0], s) is not None else (None, None) for s in range(4)]
                rows.append((conv, piece, codes, [a for a, _ in ways], [s for _, s in ways], cost_of(found[0], START)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "piece", "codes", "audits", "states", "cost"])

    both = pieces.join(_ends(pieces), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p"))).select("conv_id", "piece", "codes", "last", "ends")
    return stored(both.mapInArrow(read, "conv_id long, piece long, codes binary, audits array<string>, states array<int>, cost long"))


def _starts(traces: DataFrame) -> DataFrame:
    """c, p, state, total: the state at the beginning of each piece, and for a first piece what the whole conversation costs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, START
        for batch in batches:
            rows = []
            for conv, piece, states, cost in _by([batch], ["conv_id", "piece", "states", "cost"]):
                first = now != (conv,)
                if first:
                    now, state = (conv,), START
                rows.append((conv, piece, state, cost if first else None))
                state = states[state]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["c", "p", "state", "total"])

    ordered = traces.select("conv_id", "piece", "states", "cost").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return ordered.mapInArrow(read, "c long, p long, state int, total long")


class _Report:
    """Reads the rows of one conversation in order, with the edits of each piece before its rows."""

    def __init__(self, conv: int | None):
        self.conv, self.cost, self.audit, self.sha, self.any = conv, 0, [], hashlib.sha256(), False
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.previous = self.initial = None
        self.edits, self.codes, self.state = iter(()), iter(()), START

    def say(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.any = True

    def step(self) -> str | None:
        """The next edit, after those that put turns in."""
        for edit in self.edits:
            if edit != "I":
                return edit
            self.state = NEXT[self.state]
            self.say(NAMES[self.state], "")
        return None

    def piece(self, codes: bytes, audit: str, state: int, total: int | None) -> None:
        self.step()
        self.edits, self.codes, self.state = iter(audit), iter(codes), state
        self.audit.append(audit)
        self.cost += total or 0

    def row(self, turn: int | None, initial: str, role: str, text: str) -> None:
        code, edit = next(self.codes), self.step()
        self.blank, self.duplicate, self.truncated = self.blank + (code & 24 == 24), self.duplicate + (code & 24 == 8), self.truncated + (code & 4 == 4)
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        if turn is not None:
            self.turns += turn != self.previous
            self.least, self.most, self.previous = turn if self.least is None else self.least, turn, turn
        if edit == "K":
            self.state = MOVES[_INITIAL[code & 3]][self.state]
            self.say(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self.say(NAMES[self.state], text)

    def result(self) -> tuple:
        self.step()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage: bool = False, piece_bits: int = PIECE_BITS) -> DataFrame:
    """A row for each conversation: REPORT. With damage, rows are damaged as by `damaged` before.

    gaps are turn numbers that lack between the first and the last; blank, duplicate and truncated rows count by the first of these
    that holds; illegal are neighbours whose roles may not follow each other. audit has the initials of the cheapest edits in
    order (Keep, Rerole, Delete, Insert), the least text of several; blank and duplicate rows must go, an undeleted truncated one costs 1 more.
    repaired_sha256 is the digest of the lines `role:text` of what is left.

    A null role or text is one space, so that such a text is blank and such a role no role; a null turn comes first and is no gap; rows of a null id are
    a conversation. Rows of one turn are ordered by role, then by a digest of role and text; rows that repeat are duplicates. A conversation
    that lost all rows has zeros, an empty audit and the digest of nothing. An empty table gives no rows.
    """
    plain = rows.select(rows[conv_id].cast("long").alias("conv_id"), rows[turn].cast("long").alias("turn"), rows[role].cast("string").alias("role"), rows[text].cast("string").alias("text"))
    every = plain.select("conv_id").distinct()
    plain = damaged(plain) if damage else plain.withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" ")), "copy": F.lit(1)})
    ordered = _ordered(plain)
    traces = _traces(_pieces(ordered, piece_bits))
    edits = traces.join(_starts(traces), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p")))

    def records(df: DataFrame, kind: int, **columns: Column) -> DataFrame:
        types = {"conv_id": "long", "piece": "long", "idx": "long", "turn": "long", "initial": "string", "role": "string", "text": "string", "codes": "binary", "audit": "string", "state": "int", "total": "long"}
        return df.select(F.lit(kind).alias("kind"), *[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()])

    c = F.col
    told = records(every, 0, conv_id=c("conv_id"))
    told = told.unionByName(records(edits, 1, conv_id=c("conv_id"), piece=c("piece"), codes=c("codes"), audit=c("audits")[c("state")], state=c("state"), total=c("total")))
    told = told.unionByName(records(ordered, 2, conv_id=c("conv_id"), piece=F.shiftright("idx", piece_bits), idx=c("idx"), turn=c("turn"), initial=c("initial"), role=c("role"), text=c("text")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report, done = None, []

        def batch_of(done: list) -> pa.RecordBatch:
            types = [pa.int64()] * 7 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done, strict=True), types, strict=True)], [x.split()[0] for x in REPORT.split(", ")])

        for batch in batches:
            for kind, conv, turn, initial, role, text, codes, audit, state, total in _by([batch], ["kind", "conv_id", "turn", "initial", "role", "text", "codes", "audit", "state", "total"]):
                if report is None or report.conv != conv:
                    if report is not None:
                        done.append(report.result())
                    report = _Report(conv)
                if kind == 1:
                    report.piece(codes, audit, state, total)
                elif kind == 2:
                    report.row(turn, initial, role, text)
            if len(done) >= 1000:
                yield batch_of(done)
                done = []
        if report is not None:
            yield batch_of([*done, report.result()])

    whole = told.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "kind", "idx")
    return whole.mapInArrow(read, REPORT)

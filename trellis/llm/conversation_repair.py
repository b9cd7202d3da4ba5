"""Conversation repair: a forward Viterbi pass over the turns of each conversation, and the cheapest edits that make them follow a grammar.

The grammar of role initials is `(s?(ua)+)?`. A pass keeps, for each of its four states, the minimum (cost, audit string) of all edits so
far. A turn extends every state by Keep, Rerole and Delete; its layer is closed by at most two Inserts. Two audits of the same turns and the
same cost never continue each other (the longer one would have more Inserts, which cost), so the least string stays least whatever follows.

Turns are sorted by ranges of (conversation, turn, role, text), and a pass runs in each partition. A conversation that lies within one
partition is done there. One that crosses partitions, or is longer than SEGMENT turns, is passed in segments, from each of the four states:
a segment is then a 4 x 4 table of (cost, audit), and the tables of a conversation are put together in order. No task holds more than one
segment's turns, whatever the length of a conversation.

Equal rows of a conversation are counted before the sort, so that copies of one row are one row. Nulls in role or text are one space; rows
of a null conversation are one conversation; null turns come first; rows of one turn are ordered by role and text. Columns other than
conv_id, turn, role and text are not read. An empty table has no conversations.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import stored
from .common import in_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn; a conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_NEXT = (USER, USER, ASSISTANT, USER)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {"su", "ua", "au"}
#: Longest segment in turns and in characters of text.
SEGMENT, SEGMENT_CHARS = 2_048, 4 << 20
BLANK, DUPLICATE, CUT = 1, 2, 3

TURNS = "array<struct<role:string,text:string,edit:string>>"
_ROWS = "array<struct<role:string,text:string,fault:int,copies:bigint>>"
_COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


@dataclass
class Repaired:
    """`report`: conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit, a row for each conversation that has turns.
    `segments`: conv_id, whole (the segment is a conversation of its own), place (order within the conversation) and `turns`, the repaired ones."""

    report: DataFrame
    segments: DataFrame

    def turns(self) -> DataFrame:
        """(conv_id, place, at, role, text, edit): one row per repaired turn, in order of place and at; an inserted one has the edit I."""
        return self.segments.select("conv_id", "place", F.posexplode("turns").alias("at", "t")).select("conv_id", "place", "at", "t.*")


def repair(turns: DataFrame) -> Repaired:
    """Repair `turns` (conv_id, turn, role, text). Blank and duplicate turns are deleted, truncated ones cost more unless they are."""
    rows = _faults(turns)
    kind = rows.schema["conv_id"].dataType
    kinds = f"conv_id {kind.simpleString()}, place bigint, whole boolean, first_turn bigint, last_turn bigint, n_turns bigint, first_role string, last_role string, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
    kinds += f", costs array<bigint>, audits array<string>, rows {_ROWS}, turns {TURNS}"
    order = F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "copies", "fault")
    passed = stored(in_batches(ranged, _segments, T.StructType.fromDDL(kinds)), "segments")
    whole, parts = passed.filter("whole"), passed.filter("not whole")
    report = whole.select(
        "conv_id", F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal",
        F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"),
    )
    # the segments of one conversation meet in order, without their turns
    light = parts.drop("whole", "rows", "turns").repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "place")
    joined = stored(in_batches(light, _joined, T.StructType.fromDDL(f"conv_id {kind.simpleString()}, place bigint, entry int, path string, report struct<{_COUNTS.replace(' ', ':').replace(',:', ',')}>")), "paths")
    report = report.unionByName(joined.filter("report is not null").select("conv_id", "report.*"))
    todo = parts.select("place", "conv_id", "rows").join(joined.select("place", "entry", "path"), "place").select("conv_id", "place", "rows", "entry", "path")
    redone = in_batches(todo, _replayed, T.StructType.fromDDL(f"conv_id {kind.simpleString()}, whole boolean, place bigint, turns {TURNS}"))
    return Repaired(report, whole.select("conv_id", "whole", "place", "turns").unionByName(redone))


def _faults(turns: DataFrame) -> DataFrame:
    """Distinct (conv_id, turn, role, text) with their number of copies and the first fault of the first copy (0: none)."""
    space = F.lit(" ")
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("said", F.sha2(F.concat_ws("\n", "role", "text"), 256))
    # only what is said at more than one turn is looked up
    again = rows.groupBy("conv_id", "said").agg(F.count("*").alias("n"), F.min(F.struct(F.col("turn").isNotNull().alias("late"), "turn")).alias("first")).filter("n > 1")
    again = again.select(F.col("conv_id").alias("again_conv"), F.col("said").alias("again_said"), "first")
    rows = rows.join(again, (F.col("said") == F.col("again_said")) & F.col("conv_id").eqNullSafe(F.col("again_conv")), "left")
    last = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    later = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    fault = F.when(last == "", BLANK).when(later, DUPLICATE).when(~last.isin(".", "!", "?"), CUT).otherwise(0)
    return rows.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def _closed(layer: dict) -> dict:
    """A layer with what Inserts reach: a user turn from any state but its own, then an assistant turn."""
    for p in (START, SYSTEM, ASSISTANT):
        if p in layer:
            _offer(layer, USER, layer[p][0] + INSERT, layer[p][1] + "I")
    if USER in layer:
        _offer(layer, ASSISTANT, layer[USER][0] + INSERT, layer[USER][1] + "I")
    return layer


def _offer(layer: dict, state: int, cost: int, audit: str) -> None:
    if state not in layer or (cost, audit) < layer[state]:
        layer[state] = (cost, audit)


def _stepped(layer: dict, role: str, fault: int, copies: int) -> dict:
    """The next layer after `copies` equal turns: the later copies are duplicates, or as blank as the first."""
    if fault in (BLANK, DUPLICATE):
        return _closed({q: (c + DELETE * copies, a + "D" * copies) for q, (c, a) in layer.items()})
    more, new = TRUNCATED if fault == CUT else 0, {}
    for q, (c, a) in layer.items():
        _offer(new, q, c + DELETE, a + "D")
        to = _KEPT.get((q, role[:1]))
        if to is not None:
            _offer(new, to, c + KEEP + more, a + "K")
        _offer(new, _NEXT[q], c + REROLE + more, a + "R")
    new = _closed(new)
    return _stepped(new, role, DUPLICATE, copies - 1) if copies > 1 else new


def _replay(rows: list[tuple], state: int, audit: str) -> list[dict]:
    """The turns (role, text, edit) that edits from a state leave: the audit and the turns tell every state."""
    out, edits = [], iter(audit)

    def inserts(e):
        nonlocal state
        while e == "I":
            state = _NEXT[state]
            out.append({"role": _NAMES[state], "text": "", "edit": "I"})
            e = next(edits, None)
        return e

    for role, text, _, copies in rows:
        for _ in range(copies):
            e = inserts(next(edits, None))
            if e != "D":
                state = _KEPT[state, role[:1]] if e == "K" else _NEXT[state]
                out.append({"role": role if e == "K" else _NAMES[state], "text": text, "edit": e})
    inserts(next(edits, None))
    return out


def _best(layer: dict) -> tuple[int, str]:
    return min(layer[q] for q in FINAL if q in layer)


class _Segment:
    """Turns of one conversation in order, with the counts that need no pass."""

    def __init__(self, conv):
        self.conv, self.rows, self.chars = conv, [], 0
        self.first_turn = self.last_turn = self.last_role = None
        self.n_turns = self.illegal = 0
        self.faults = [0, 0, 0, 0]

    def add(self, turn, role, text, copies, fault):
        if turn is not None and turn != self.last_turn:
            self.n_turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.illegal += copies - 1 + (bool(self.rows) and self.last_role + role[:1] not in _LEGAL)
        self.last_role = role[:1]
        self.faults[fault] += 1
        self.faults[BLANK if fault == BLANK else DUPLICATE] += copies - 1
        self.rows.append((role, text, fault, copies))
        self.chars += len(text) + copies

    def full(self):
        return len(self.rows) >= SEGMENT or self.chars >= SEGMENT_CHARS

    def passed(self, whole: bool, place: int) -> dict:
        out = {
            "conv_id": self.conv, "place": place, "whole": whole, "first_turn": self.first_turn, "last_turn": self.last_turn, "n_turns": self.n_turns, "first_role": self.rows[0][0][:1],
            "last_role": self.last_role, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[CUT], "illegal": self.illegal, "rows": None, "turns": None,
        }
        layers = []
        for start in [START] if whole else range(4):
            layer = _closed({start: (0, "")})
            for role, _, fault, copies in self.rows:
                layer = _stepped(layer, role, fault, copies)
            layers.append(layer)
        if whole:
            cost, audit = _best(layers[0])
            return out | {"costs": [cost], "audits": [audit], "turns": _replay(self.rows, START, audit)}
        cells = [layer.get(q, (None, None)) for layer in layers for q in range(4)]
        rows = [{"role": r, "text": t, "fault": f, "copies": n} for r, t, f, n in self.rows]
        return out | {"costs": [c for c, _ in cells], "audits": [a for _, a in cells], "rows": rows}


def _batched(rows: Iterator[dict], schema: pa.Schema, most: int = 256, chars: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 1_000 + sum(len(t["text"]) + 40 for t in row.get("rows") or row.get("turns") or [])
        if len(held) >= most or size >= chars:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


_TURN = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = next(batches, None)
    if first is None:
        return
    longs = ["first_turn", "last_turn", "n_turns", "first_role", "last_role", "blank", "duplicate", "truncated", "illegal"]
    row = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("fault", pa.int32()), ("copies", pa.int64())]))
    schema = pa.schema([first.schema.field("conv_id").with_nullable(True), ("place", pa.int64()), ("whole", pa.bool_()), *((k, pa.string() if "role" in k else pa.int64()) for k in longs), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("rows", row), ("turns", _TURN)])

    def found():
        place = TaskContext.get().partitionId() << 32
        held, edge = None, True  # edge: the conversation may have begun before this partition, or in an earlier segment of it
        for conv, turn, role, text, copies, fault in _tuples(_chained(first, batches)):
            if held is not None and (held.conv != conv or held.full()):
                more = held.conv == conv
                yield held.passed(not edge and not more, place)
                place, edge, held = place + 1, more, None
            if held is None:
                held = _Segment(conv)
            held.add(turn, role, text, copies, fault)
        yield held.passed(False, place)

    yield from _batched(found(), schema)


def _chained(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tables of segments, in order, to each conversation's report and the path through each of its segments.

    What the four audits so far have in common is set aside, so that a step costs the length of one segment."""
    first = next(batches, None)
    if first is None:
        return
    report = pa.struct([(k, pa.string() if k == "audit" else pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")])
    schema = pa.schema([first.schema.field("conv_id").with_nullable(True), ("place", pa.int64()), ("entry", pa.int32()), ("path", pa.string()), ("report", report)])
    names = [f.name for f in first.schema]

    def ended(conv, best, shared, seen):
        cost, audit, last = min((best[q] for q in FINAL if q in best), key=lambda x: x[:2])
        paths = []
        while last is not None:
            last, *path = last
            paths.append(path)
        gaps = seen["last_turn"] - seen["first_turn"] + 1 - seen["n_turns"] if seen["n_turns"] else 0
        top = {"gaps": gaps, **{k: seen[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": "".join(shared) + audit}
        for i, (place, entry, path) in enumerate(reversed(paths)):
            yield {"conv_id": conv, "place": place, "entry": entry, "path": path, "report": None if i else top}

    def found():
        seen = None
        for values in _tuples(_chained(first, batches)):
            x = dict(zip(names, values, strict=True))
            if seen is not None and seen["conv_id"] != x["conv_id"]:
                yield from ended(seen["conv_id"], best, shared, seen)
                seen = None
            if seen is None:
                seen, best, shared = x, {START: (0, "", None)}, []
            else:
                again = x["first_turn"] is not None and x["first_turn"] == seen["last_turn"]
                seen["n_turns"] += x["n_turns"] - again
                seen["first_turn"] = x["first_turn"] if seen["first_turn"] is None else seen["first_turn"]
                seen["last_turn"] = seen["last_turn"] if x["last_turn"] is None else x["last_turn"]
                seen["illegal"] += x["illegal"] + (seen["last_role"] + x["first_role"] not in _LEGAL)
                seen["last_role"] = x["last_role"]
                for k in ("blank", "duplicate", "truncated"):
                    seen[k] += x[k]
            new: dict = {}
            for q, (c, a, last) in best.items():
                for r in range(4):
                    cost, audit = x["costs"][4 * q + r], x["audits"][4 * q + r]
                    if cost is not None and (r not in new or (c + cost, a + audit) < new[r][:2]):
                        new[r] = (c + cost, a + audit, (last, x["place"], q, audit))
            common = os.path.commonprefix([a for _, a, _ in new.values()])
            shared.append(common)
            best = {q: (c, a[len(common) :], last) for q, (c, a, last) in new.items()}
        yield from ended(seen["conv_id"], best, shared, seen)

    yield from _batched(found(), schema)


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        schema = pa.schema([batch.schema.field("conv_id").with_nullable(True), ("whole", pa.bool_()), ("place", pa.int64()), ("turns", _TURN)])
        rows = ({"conv_id": c, "whole": False, "place": p, "turns": _replay([tuple(r.values()) for r in rows], entry, path)} for c, p, rows, entry, path in _tuples([batch]))
        yield from _batched(rows, schema)


def digests(made: Repaired) -> DataFrame:
    """(conv_id, repaired_sha256): the digest of `role:text` of a conversation's repaired turns, newline-joined.

    A digest is made from first to last byte, so a conversation of many segments streams through one task; it is not held there."""
    kind = made.segments.schema["conv_id"].dataType.simpleString()
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    whole = made.segments.filter("whole").select("conv_id", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    rest = made.segments.filter("not whole").select("conv_id", "place", F.size("turns").alias("n"), F.array_join(lines, "\n").alias("said"))
    rest = rest.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "place")
    return whole.unionByName(in_batches(rest, _hashed, T.StructType.fromDDL(f"conv_id {kind}, repaired_sha256 string")))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = next(batches, None)
    if first is None:
        return
    schema = pa.schema([first.schema.field("conv_id").with_nullable(True), ("repaired_sha256", pa.string())])

    def found():
        now, digest, begun = None, None, False
        for conv, _, n, said in _tuples(_chained(first, batches)):
            if digest is not None and conv != now:
                yield {"conv_id": now, "repaired_sha256": digest.hexdigest()}
                digest = None
            if digest is None:
                now, digest, begun = conv, hashlib.sha256(), False
            if n:
                digest.update((b"\n" if begun else b"") + said.encode("utf-8", "surrogatepass"))
                begun = True
        yield {"conv_id": now, "repaired_sha256": digest.hexdigest()}

    yield from _batched(found(), schema)

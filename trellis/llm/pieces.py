"""Subword pieces: encoding with an Aho-Corasick automaton and one Viterbi pass, and exact decoding.

The vocabulary is a public SentencePiece model file. An Aho-Corasick automaton over its pieces runs once over the
text; at each position it reports, along its output links, every piece that ends there, and each relaxes the best
score of its end. Characters that no piece covers become byte pieces. As pieces hold the space mark at their
start only (or are runs of it), the pass may be cut before a space mark; what lies between cuts is looked up in a memo first.

The model is a merge model whose scores are merge ranks; as sums of ranks make no sense, a piece of rank r gets the
Zipf log probability -ln(r + 2).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches

SPACE = "▁"
#: Entries of each of a memo's two generations: for words, and for their parts.
MEMO, SHORT_MEMO = 150_000, 30_000
_UNITS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def read_vocabulary(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, byte) of each id; byte is 0-255 for byte pieces, -1 for others, -2 for control and unknown ones."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = []
    for i in range(model.get_piece_size()):
        kind = int(model.id_to_piece(i)[3:5], 16) if model.is_byte(i) else -2 if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else -1
        found.append((model.id_to_piece(i), model.get_score(i), kind))
    return found


def texts_of(vocabulary: list[tuple[str, float, int]]) -> list[bytes]:
    """What each id says."""
    return [bytes([kind]) if kind >= 0 else b"" if kind == -2 else p.replace(SPACE, " ").encode() for p, _, kind in vocabulary]


class _Memo:
    """Paths by unit in two generations: what is looked up passes from the old to the young one, and the old one is dropped when that is full."""

    def __init__(self, size: int):
        self.size = size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, unit: str) -> bytes | None:
        found = self.young.get(unit)
        if found is None:
            found = self.old.get(unit)
            if found is not None:
                self.put(unit, found)
        return found

    def put(self, unit: str, path: bytes) -> bytes:
        if len(unit) <= 64:
            if len(self.young) >= self.size:
                self.old, self.young = self.young, {}
            self.young[unit] = path
        return path


class Pieces:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float, int]]):
        self.vocabulary = vocabulary
        ordinary = [(i, p, s) for i, (p, s, kind) in enumerate(vocabulary) if kind == -1 and p]
        ranks = {i: r for r, (_, _, i) in enumerate(sorted((-s, p, i) for i, p, s in ordinary))}
        self.automaton = ahocorasick.Automaton()
        for i, piece, _ in ordinary:
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"texts are cut before space marks, but piece {piece!r} has one inside: this vocabulary cannot be used")
            self.automaton.add_word(piece, (len(piece), i, -math.log(ranks[i] + 2)))
        self.automaton.make_automaton()
        self.bytes = {kind: i for i, (_, _, kind) in enumerate(vocabulary) if kind >= 0}
        # worse than any way through pieces
        self.fallback = -2.0 * math.log(len(vocabulary) + 2)
        self.texts = texts_of(vocabulary)
        # characters that are pieces themselves: byte pieces are never better for them
        self.covered = frozenset(p for _, p, _ in ordinary if len(p) == 1)
        # of words after one space, and of parts between safe cuts
        self.memo, self.short_memo = _Memo(MEMO), _Memo(SHORT_MEMO)
        self.short = self._short_units([p for _, p, _ in ordinary])

    @staticmethod
    def _short_units(texts: list[str]) -> re.Pattern:
        """What cuts a unit further: between a letter and another character, and before a letter unless some piece joins it to the character before.

        A letter that some piece continues with another character counts as such a character itself.
        """
        pairs = {(a, b) for p in texts for a, b in zip(p, p[1:], strict=False)}
        plain, odd = re.compile(r"[^\W\d_]"), set()
        is_letter = lambda c: c not in odd and plain.match(c)
        while more := {a for a, b in pairs if is_letter(a) and not is_letter(b)}:
            odd |= more
        odd_ = "".join(map(re.escape, sorted(odd)))
        before = "".join(map(re.escape, sorted({a for a, b in pairs if is_letter(b) and not is_letter(a) and a != SPACE})))
        letter, other = rf"[^\W\d_{odd_}]", rf"(?!{SPACE})[\W\d_{odd_}]"
        joined = rf"(?:(?:{other})*[{before}])?" if before else ""
        return re.compile(rf"{SPACE}*{joined}{letter}+|{SPACE}*(?:{other})+|{SPACE}+")

    def path(self, unit: str) -> bytes:
        """The best path of a unit as packed ids, put together from those of its parts between safe cuts."""
        memo, ids = self.short_memo, []
        for part in self.short.findall(unit):
            found = memo.get(part)
            if found is None:
                found = memo.put(part, np.array(self.best_path(part), dtype=np.int32).tobytes())
            ids.append(found)
        return b"".join(ids)

    def best_path(self, unit: str) -> tuple[int, ...]:
        """The ids of the best way through a unit; of equal ways the one whose last piece is longer.

        As texts are cut into units, ways through a text whose scores are the same, or differ in rounding only, may be told apart otherwise than by one
        uncut pass; the same unit always has the same way.
        """
        n = len(unit)
        best: list[float] = [-math.inf] * (n + 1)
        back: list[tuple] = [(1, -1)] * (n + 1)
        best[0] = 0.0
        if self.covered.issuperset(unit):
            # matches come by their ends, at one end the longest first
            for end, match in self.automaton.iter(unit):
                value = best[end + 1 - match[0]] + match[2]
                if value > best[end + 1]:
                    best[end + 1] = value
                    back[end + 1] = match
        else:
            matches = self.automaton.iter(unit)
            last, match = next(matches, (n, None))
            for end in range(n):
                # byte pieces for one character
                best[end + 1] = best[end] + self.fallback * len(unit[end].encode("utf-8", "surrogatepass"))
                while last == end:
                    value = best[end + 1 - match[0]] + match[2]
                    if value > best[end + 1]:
                        best[end + 1] = value
                        back[end + 1] = match
                    last, match = next(matches, (n, None))
        ids: list[int] = []
        while n:
            size, i = back[n][:2]
            ids += [i] if i >= 0 else [self.bytes[b] for b in reversed(unit[n - 1].encode("utf-8", "surrogatepass"))]
            n -= size
        return tuple(reversed(ids))

    def packed(self, text: str) -> bytes:
        """Ids of a text as packed 32-bit numbers. A space mark in the text itself is spelled in bytes."""
        if SPACE in text:
            mark = np.array([self.bytes[b] for b in SPACE.encode()], dtype=np.int32).tobytes()
            return mark.join(map(self.packed, text.split(SPACE)))
        if "  " in text:  # a run of spaces is one unit with what follows it
            return b"".join(map(self.path, _UNITS.findall(text.replace(" ", SPACE))))
        first, *rest = text.split(" ")
        memo = self.memo
        paths = list(map(memo.young.get, rest))
        at = -1
        for _ in range(paths.count(None)):
            at = paths.index(None, at + 1)
            word = rest[at]
            found = memo.young.get(word) or memo.old.get(word)
            if found is None:
                found = np.array(self.best_path(SPACE + word), dtype=np.int32).tobytes() if word.isalpha() else self.path(SPACE + word)
            paths[at] = memo.put(word, found)
        return self.path(first) + b"".join(paths)

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        return np.frombuffer(self.packed(text), dtype=np.int32).tolist()

    def decode(self, ids) -> str:
        """The text whose ids these are; control ids say nothing. Exact for every encoded text."""
        texts = self.texts
        return b"".join([texts[i] for i in ids]).decode("utf-8", "surrogatepass")


def _pieces(holder: dict) -> Pieces:
    """The encoder of a broadcast vocabulary; it stays with the broadcast, for all tasks of a worker."""
    if "pieces" not in holder:
        holder["pieces"] = Pieces(holder["vocabulary"])
    return holder["pieces"]


def encode_texts(docs: DataFrame, vocabulary: list[tuple[str, float, int]], text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """`docs` with the column `ids` (array<int>): the pieces of each text. A null text counts as empty and has none.

    With `decoded`, a column of that name has what the ids say, decoded by the same worker; it may be the text's own. Other columns stay as they are; an
    empty table gives no rows. Pieces are made text by text, at any length.
    """
    shipped = docs.sparkSession.sparkContext.broadcast({"vocabulary": vocabulary})
    rows = docs.drop(ids)
    added = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    if decoded and decoded not in rows.columns:
        added.append(T.StructField(decoded, T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):  # lists of ids are larger than the texts
                part = batch.slice(at, 250)
                made = [pieces.packed(x or "") for x in part.column(part.schema.get_field_index(text)).to_pylist()]
                columns = dict(zip(part.schema.names, part.columns, strict=True))
                columns[ids] = pa.ListArray.from_arrays(np.cumsum([0, *(len(x) // 4 for x in made)], dtype=np.int32), np.frombuffer(b"".join(made), dtype=np.int32))
                if decoded:
                    columns[decoded] = pa.array([pieces.decode(np.frombuffer(x, dtype=np.int32).tolist()) for x in made], pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return in_batches(rows, run, T.StructType([*rows.schema.fields, *added]))


def decode_texts(docs: DataFrame, vocabulary: list[tuple[str, float, int]], ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`docs` with the column `text`: what the pieces in `ids` say. Null ids give a null."""
    shipped = docs.sparkSession.sparkContext.broadcast({"vocabulary": vocabulary})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = texts_of(shipped.value["vocabulary"])
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                said = [None if x is None else b"".join([texts[i] for i in x]).decode("utf-8", "surrogatepass") for x in part.column(part.schema.get_field_index(ids)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(said, pa.string())], names=[*part.schema.names, text])

    rows = docs.drop(text) if text in docs.columns else docs
    return in_batches(rows, run, T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())]))


def ids_as_text(ids: Column) -> Column:
    """Ids as decimal numbers with commas, for digests."""
    return F.array_join(ids.cast("array<string>"), ",")

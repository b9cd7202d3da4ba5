"""Alignment of two tokenizers over a corpus: a dictionary of distinct token groups, whose links are expanded once.

The byte ends that both tokenizations of a text share cut it into groups of A ids and B ids; every A token of a group is linked with every B
token of it. Groups recur, as words do, so they are interned: a pass over the texts turns each chunk of about CHUNK tokens into its distinct
groups, and each text into numbers into that list. The groups of all chunks meet in one dictionary, with the number of documents that hold
each. Its links are expanded once per distinct group and multiplied by those documents; what several groups of one document have in
common is counted there and taken off, so that an id pair's count is its number of documents. Figures of the groups go back to each chunk
that has them, once, and are summed up for its documents.

Exchanges: distinct groups of chunks (to the dictionary and back), links of distinct groups, and packed chunks. No row of them belongs to a
single occurrence, so a word that is everywhere has one row a chunk. The best counts by A id are broadcast: there are no more than A has ids.

Texts are cut before a single space between two other characters, where both tokenizers always cut (A's pattern, and no piece of B has a
space mark after another character; `Pair` checks this); what lies between is encoded once and kept in a memo of bounded size. Null and
empty texts, and those that either tokenizer changes, have no tokens. Null or repeated doc_ids keep their rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..runtime import stored
from .common import in_batches, pack, unpack

#: Tokens of a chunk, about; links that a step of a chunk holds at once.
CHUNK, LINKS = 1_500_000, 4_000_000
#: Units of each of a memo's two generations, and the longest that are kept.
MEMO, MEMO_CHARS = 200_000, 48
_UNITS = re.compile(r"(?<=\S) (?=\S)")


class Pair:
    """Two tokenizers, from their files: byte-level merges (JSON) and pieces with a space mark. Made in each task; only paths travel."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        import tiktoken

        with open(byte_level, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        alphabet = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in alphabet} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in alphabet)}
        special = {t["content"] for t in file.get("added_tokens", [])}
        self.a = {i: bytes(byte_of[c] for c in t) for t, i in model["vocab"].items() if t not in special}
        made = [self.a_id(m, model["vocab"]) for m in model["merges"]]
        if made != sorted(made):
            raise ValueError("merges must be in the order of their ids")
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self._a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={t: i for i, t in self.a.items()}, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.b = {}
        for i in range(self._b.get_piece_size()):
            piece = self._b.id_to_piece(i)
            self.b[i] = bytes([int(piece[3:5], 16)]) if self._b.is_byte(i) else piece.replace("▁", " ").encode()
            if " " in self.b[i].decode("utf-8", "replace").lstrip(" ") and not self._b.is_control(i):
                raise ValueError("a piece has a space mark after another character")
        self.size_a, self.name_a = [len(self.a.get(i, b"")) for i in range(max(self.a) + 1)], [str(i) for i in range(max(self.a) + 1)]
        self.size_b, self.name_b = [len(self.b[i]) for i in range(len(self.b))], [str(i) for i in range(len(self.b))]
        self.made: dict[str, str] = {}
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    @staticmethod
    def a_id(merge, vocab: dict[str, int]) -> int:
        return vocab["".join(merge if isinstance(merge, list) else merge.split(" "))]

    def groups(self, units: list[str]) -> list[tuple[str, ...] | None]:
        """For each unit the groups `a1,a2|b1` of a space and it; None where B changes it (A keeps every byte)."""
        size_a, size_b, name_a, name_b, say_b, made = self.size_a, self.size_b, self.name_a, self.name_b, self.b, self.made
        if len(made) > MEMO:
            made.clear()
        out = []
        for unit, ids_b in zip(units, self._b.encode(units, num_threads=1), strict=True):
            if b"".join([say_b[b] for b in ids_b]) != (" " + unit).encode():
                out.append(None)
                continue
            found, j, end_a, end_b, said_a, said_b = [], 0, 0, 0, "", ""
            for a in self._a.encode_ordinary(" " + unit):
                end_a += size_a[a]
                said_a = said_a + "," + name_a[a] if said_a else name_a[a]
                while end_b < end_a:
                    b = ids_b[j]
                    j += 1
                    end_b += size_b[b]
                    said_b = said_b + "," + name_b[b] if said_b else name_b[b]
                if end_a == end_b:
                    group = said_a + "|" + said_b
                    found.append(made.setdefault(group, group))
                    said_a = said_b = ""
            out.append(tuple(found))
        return out

    def units(self, text: str) -> list[tuple[str, ...]] | None:
        """The groups of a whole text by unit, or None."""
        units = _UNITS.split(text)
        young, old = self.young, self.old
        found = [young.get(u, 0) for u in units]
        if 0 in found:
            missing = {u for u, f in zip(units, found, strict=True) if f == 0}
            again = {u: old[u] for u in missing if u in old}
            new = [u for u in missing if u not in again]
            again |= zip(new, self.groups(new), strict=True)
            found = [again[u] if f == 0 else f for u, f in zip(units, found, strict=True)]
            young.update((u, f) for u, f in again.items() if len(u) <= MEMO_CHARS)
            if len(young) >= MEMO:
                self.old, self.young = young, {}
        return None if None in found else found


_CHUNK = (
    "chunk bigint, n_docs int, groups array<string>, holding array<bigint>, cells binary, freqs binary, counts binary, repeat_a array<int>, repeat_b array<int>, repeat_n array<bigint>, "
    "docs array<struct<doc_id:{kind},n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,sha:string>>"
)


class _Chunk:
    """Documents so far, as numbers into the list of distinct groups."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.of_a: list[int] = []
        self.of_b: list[int] = []
        self.docs, self.cells, self.freqs, self.tokens = [], [], [], 0

    def add(self, doc_id, units: list[tuple[str, ...]] | None) -> None:
        row = {"doc_id": doc_id, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "sha": ""}
        cells, freqs = np.empty(0, np.int32), np.empty(0, np.int64)
        if units:
            digest = hashlib.sha256()
            for k in range(0, len(units), 100_000):
                digest.update((";" * (k > 0) + ";".join(map(";".join, units[k : k + 100_000]))).encode())
            seen = Counter(chain.from_iterable(units))
            known = self.known
            for g in seen.keys() - known.keys():
                known[g] = len(self.of_a)
                a, b = g.split("|")
                self.of_a.append(a.count(",") + 1)
                self.of_b.append(b.count(",") + 1)
            cells, freqs = np.fromiter(map(known.__getitem__, seen), np.int32, len(seen)), np.fromiter(seen.values(), np.int64, len(seen))
            order = np.argsort(cells)
            cells, freqs = cells[order], freqs[order]
            of_a, of_b = (np.fromiter(map(x.__getitem__, cells.tolist()), np.int64, len(cells)) for x in (self.of_a, self.of_b))
            n_a, n_b = int(freqs @ of_a), int(freqs @ of_b)
            row |= {"n_a": n_a, "n_b": n_b, "n_groups": int(freqs.sum()), "n_links": int(freqs @ (of_a * of_b)), "sha": digest.hexdigest()}
            self.tokens += n_a + n_b
        self.tokens += 50
        self.docs.append(row)
        self.cells.append(cells)
        self.freqs.append(freqs)

    def row(self, chunk: int) -> dict:
        cells = np.concatenate(self.cells)
        counts = np.array([len(c) for c in self.cells], np.int32)
        names = [""] * len(self.of_a)
        for g, i in self.known.items():
            names[i] = g
        a, b, n = _repeats(names, cells, counts)
        holding = np.bincount(cells, minlength=len(names))
        return {
            "chunk": chunk, "n_docs": len(self.docs), "groups": names, "holding": holding.tolist(), "cells": pack(cells), "freqs": pack(np.concatenate(self.freqs)), "counts": pack(counts),
            "repeat_a": a, "repeat_b": b, "repeat_n": n, "docs": self.docs,
        }


def _distinct(group: str) -> tuple[dict[int, int], dict[int, int]]:
    a, b = group.split("|")
    return Counter(map(int, a.split(","))), Counter(map(int, b.split(",")))


def _repeats(groups: list[str], cells: np.ndarray, counts: np.ndarray) -> tuple[list, list, list]:
    """(a, b, n): for each id pair that several groups of one document have, how often it would be counted too many.

    Pairs of one A id meet in one step; a step holds about LINKS pairs of groups, or of documents, at once."""
    sides = [_distinct(g) for g in groups]
    of_a = np.array([a for x, _ in sides for a in x], np.int64)
    group_a = np.repeat(np.arange(len(sides)), [len(x) for x, _ in sides])
    n_b = np.array([len(y) for _, y in sides], np.int64)
    from_b = np.concatenate([[0], np.cumsum(n_b)])
    of_b = np.array([b for _, y in sides for b in y], np.int64)
    doc_of = np.repeat(np.arange(len(counts)), counts)
    by_group = np.argsort(cells, kind="stable")
    docs_of, held = doc_of[by_group], np.bincount(cells, minlength=len(groups))
    from_doc = np.concatenate([[0], np.cumsum(held)])
    order = np.argsort(of_a, kind="stable")
    of_a, group_a = of_a[order], group_a[order]
    total = np.cumsum(n_b[group_a])
    out_a, out_b, out_n = [], [], []
    at = 0
    while at < len(of_a):
        stop = int(np.searchsorted(total, (total[at - 1] if at else 0) + LINKS, "right"))
        stop = max(stop, at + 1)
        while stop < len(of_a) and of_a[stop] == of_a[stop - 1]:
            stop += 1
        g = group_a[at:stop]
        which, b_at = _spread(n_b[g], from_b[g])
        pair, group = of_a[at:stop][which] << 32 | of_b[b_at], g[which]
        keys, inverse, often = np.unique(pair, return_inverse=True, return_counts=True)
        shared = often[inverse] > 1
        number, group = inverse[shared], group[shared]
        by = np.argsort(number, kind="stable")
        number, group = number[by], group[by]
        load = np.cumsum(held[group])
        i = 0
        while i < len(number):
            j = max(int(np.searchsorted(load, (load[i - 1] if i else 0) + LINKS, "right")), i + 1)
            while j < len(number) and number[j] == number[j - 1]:
                j += 1
            which, d_at = _spread(held[group[i:j]], from_doc[group[i:j]])
            seen, times = np.unique(number[i:j][which] * len(counts) + docs_of[d_at], return_counts=True)
            more = times > 1
            if more.any():
                extra = np.bincount(seen[more] // len(counts), weights=times[more] - 1)
                found = np.flatnonzero(extra)
                out_a += (keys[found] >> 32).tolist()
                out_b += (keys[found] & 0xFFFFFFFF).tolist()
                out_n += extra[found].astype(np.int64).tolist()
            i = j
        at = stop
    return out_a, out_b, out_n


def _spread(sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of `sizes` from `starts`: the number of the range, and the place, of each member."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


def _chunks(byte_level: str, pieces: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, chunk, number = None, _Chunk(), TaskContext.get().partitionId() << 32
        for batch in batches:
            pair = pair or Pair(byte_level, pieces)
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, doc_id in enumerate(ids):
                text = texts[i].as_py()
                chunk.add(doc_id, pair.units(text) if text else None)
                if chunk.tokens >= CHUNK:
                    yield pa.RecordBatch.from_pylist([chunk.row(number)], schema)
                    chunk, number = _Chunk(), number + 1
        if chunk.docs:
            yield pa.RecordBatch.from_pylist([chunk.row(number)], schema)

    return run


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, docs) to (group, a, b, n, docs): distinct id pairs of each group with the number of their links, at most 100,000 rows a batch."""
    schema = pa.schema([("group", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()), ("docs", pa.int64())])

    def rows():
        for batch in batches:
            for group, docs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = _distinct(group)
                for a, n in x.items():
                    for b, m in y.items():
                        yield group, a, b, n * m, docs

    held = []
    for row in rows():
        held.append(row)
        if len(held) == 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _summed(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = {f.name: batch.column(i)[k] for i, f in enumerate(batch.schema)}
                cells, freqs, counts = unpack(x["cells"].as_py(), np.int32), unpack(x["freqs"].as_py(), np.int64), unpack(x["counts"].as_py(), np.int32)
                docs = x["docs"].values
                begins = np.cumsum(counts) - counts
                sums = {}
                back = x["back"].values
                at = None if back is None else back.field("at").to_numpy(zero_copy_only=False)
                for name in ("n_best", "count_sum"):
                    each = np.zeros(0 if at is None else len(at), np.int64)
                    if at is not None:
                        each[at] = back.field(name).to_numpy(zero_copy_only=False)
                    run_ = np.concatenate([[0], np.cumsum(each[cells] * freqs)])
                    sums[name] = run_[begins + counts] - run_[begins]
                cols = [docs.field(n) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [pa.array(sums["n_best"]), pa.array(sums["count_sum"]), docs.field("sha")]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def align(docs: DataFrame, byte_level: str, pieces: str) -> tuple[DataFrame, DataFrame]:
    """For `docs` (doc_id, text): per document n_a, n_b, n_groups, n_links, n_best (links whose count is their A id's highest), count_sum (of
    counts over links) and groups_sha256; and the table (a, b, count, best) of linked id pairs with their documents, `best` telling the highest of an a.
    `byte_level` and `pieces` are paths of the two tokenizers' files, which every executor must have."""
    kind = docs.schema["doc_id"].dataType
    out = T.StructType.fromDDL(_CHUNK.format(kind=kind.simpleString()))
    made = stored(in_batches(docs.select("doc_id", "text"), _chunks(byte_level, pieces, to_arrow_schema(out)), out), "chunks")
    groups = made.select(F.explode(F.arrays_zip("groups", "holding")).alias("g")).groupBy(F.col("g.groups").alias("group")).agg(F.sum("g.holding").alias("docs"))
    links = stored(in_batches(groups, _links, "group string, a int, b int, n bigint, docs bigint"), "links")
    more = made.select(F.explode(F.arrays_zip("repeat_a", "repeat_b", "repeat_n")).alias("r")).select(F.col("r.repeat_a").alias("a"), F.col("r.repeat_b").alias("b"), (-F.col("r.repeat_n")).alias("docs"))
    pairs = links.select("a", "b", "docs").unionByName(more).groupBy("a", "b").agg(F.sum("docs").alias("count"))
    pairs = stored(pairs, "pairs")
    # one row for each id of A at most
    best = pairs.groupBy("a").agg(F.max("count").alias("highest"))
    pairs = pairs.join(F.broadcast(best), "a").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))
    valued = links.select("group", "a", "b", "n").join(pairs, ["a", "b"])
    values = valued.groupBy("group").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    asked = made.select("chunk", F.posexplode("groups").alias("at", "group"))
    back = asked.join(values, "group").groupBy("chunk").agg(F.collect_list(F.struct("at", "n_best", "count_sum")).alias("back"))
    packed = made.select("chunk", "cells", "freqs", "counts", "docs").join(back, "chunk", "left").drop("chunk")
    result = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())])
    return in_batches(packed, _summed(to_arrow_schema(result)), result), pairs

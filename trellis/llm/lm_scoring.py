"""Language-model scores by deleted interpolation.

The model is a bigram model: P(w|v) = l2(b) c(v,w)/c(v) + l1(b) c(w)/N + l0(b)/(V+1), where b is the bucket of the
context's frequency c(v) and the weights of each bucket come from expectation-maximisation on the counts of a fold
that is deleted from the training counts. The last fold returns to the counts before texts are scored. The first
word's context is the end token, as if the texts stood one after another.

How it runs. Texts become chunks of a few million tokens, each a row with the sorted hashes of its distinct words and
its tokens as indexes into them, stored once. A chunk sends its distinct words and bigrams, as sorted 64-bit hashes
with counts, in blocks, one for each range of the hashes; a range's task adds up what all chunks sent and answers each
block with totals in the same order. A chunk that has its answers can score its texts. No table is broadcast and
nothing but sums and a fixed grid of counts reaches the driver. A frequent word is one entry per chunk, so no range is
hot, and the number of ranges follows the number of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stored
from .common import in_batches, pack, unpack, words_of

#: Roles of a text: scored only, counted, counted but deleted while the weights are learned.
SCORED, CORE, DELETED = 0, 1, 2
BUCKETS = 64
#: Grid steps for one unit of the natural logarithm, for the counts that the weights are learned from.
GRID = 8
NONE = -10_000
END = b" "

_CHUNK = "chunk long, n_tokens long, words binary, tokens binary, doc_ids array<bigint>, sizes array<int>, roles array<int>"
_SENT = "kind int, bucket int, chunk long, keys binary, core binary, deleted binary"
_TOTAL = "kind int, bucket int, chunk long, core binary, deleted binary, n_core long, n_deleted long, v_core long, v_all long"
_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class _Index(dict):
    """Numbers new keys in order."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def _chunker(chunk_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.int64()), ("n_tokens", pa.int64()), ("words", pa.binary()), ("tokens", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("roles", pa.list_(pa.int32()))])
        part, made = TaskContext.get().partitionId(), 0
        # texts of the deleted fold have chunks of their own (odd numbers), so that they can be read alone
        open_: list = [None, None]

        def close(odd: int) -> pa.RecordBatch:
            nonlocal made
            index, ids, docs = open_[odd]
            open_[odd] = None
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in index), dtype=np.uint64, count=len(index))
            order = np.argsort(hashes)
            place = np.empty(len(order), dtype=np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            tokens = place[np.concatenate(ids)]
            number = (((part << 24) + made) << 1) + odd
            made += 1
            return pa.record_batch([[number], [len(tokens)], [pack(hashes[order])], [pack(tokens)], [[d[0] for d in docs]], [[d[1] for d in docs]], [[d[2] for d in docs]]], schema=schema)

        size = [0, 0]
        for batch in batches:
            for doc_id, text, role in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "role")), strict=True):
                odd = int(role == DELETED)
                if open_[odd] is None:
                    open_[odd], size[odd] = (_Index({END: 0}), [], []), 0
                index, ids, docs = open_[odd]
                words = words_of(text)
                words.append(END)
                ids.append(np.fromiter(map(index.__getitem__, words), dtype=np.int32, count=len(words)))
                docs.append((doc_id, len(words), role))
                size[odd] += len(words)
                if size[odd] >= chunk_tokens:
                    yield close(odd)
        for odd in (0, 1):
            if open_[odd] is not None:
                yield close(odd)

    return run


class _Chunk:
    """A stored chunk: hashes of words, tokens, and the distinct bigrams in the order of their hashes."""

    def __init__(self, row: dict):
        self.words = unpack(row["words"], np.uint64)
        self.tokens = unpack(row["tokens"], np.int32)
        self.sizes = np.asarray(row["sizes"], dtype=np.int64)
        self.roles = np.asarray(row["roles"], dtype=np.int64)
        self.doc_ids = list(row["doc_ids"])
        end = self.tokens[-1]
        self.context = np.concatenate([[end], self.tokens[:-1]]).astype(np.int32)
        pair = self.context.astype(np.int64) * len(self.words) + self.tokens
        distinct, self.bigram = np.unique(pair, return_inverse=True)
        left, right = self.words[distinct // len(self.words)], self.words[distinct % len(self.words)]
        key = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (left >> np.uint64(29))
        key = (key ^ right) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(31)
        key *= np.uint64(0x94D049BB133111EB)
        order = np.argsort(key, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.bigrams, self.bigram = key[order], place[self.bigram]

    def keys(self, kind: int):
        return (self.words, self.tokens) if kind == 0 else (self.bigrams, self.bigram)


def _bounds(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of the sorted keys begins, and the end."""
    edges = np.array([(i << 64) // ranges for i in range(1, ranges)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences of as many bytes as the largest needs."""
    if not len(keys):
        return b""
    steps = np.diff(keys, prepend=np.uint64(0))
    wide = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([wide]) + steps.view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def _unpack_keys(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, dtype=np.uint64)
    raw = np.frombuffer(blob, dtype=np.uint8, offset=1).reshape(-1, blob[0])
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, : blob[0]] = raw
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts in the narrowest of four types, compressed; the first byte says which."""
    top = int(counts.max()) if len(counts) else 0
    wide = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    return bytes([wide]) + pack(counts.astype(f"u{wide}"))


def _unpack_counts(blob: bytes) -> np.ndarray:
    return unpack(blob[1:], f"u{blob[0]}").astype(np.int64)


def _sender(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk, rows = _Chunk(row), []
                role = np.repeat(chunk.roles, chunk.sizes)
                for kind in (0, 1):
                    keys, at = chunk.keys(kind)
                    core = np.bincount(at[role == CORE], minlength=len(keys))
                    deleted = np.bincount(at[role == DELETED], minlength=len(keys))
                    bounds = _bounds(keys, ranges)
                    rows += [(kind, b, row["chunk"], _pack_keys(keys[i:j]), _pack_counts(core[i:j]), _pack_counts(deleted[i:j])) for b, (i, j) in enumerate(zip(bounds, bounds[1:], strict=False)) if j > i]
                names = ("kind", "bucket", "chunk", "keys", "core", "deleted")
                types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))

    return run


def _add_up(blocks: pd.DataFrame) -> pd.DataFrame:
    """Totals for each block of one range of the hashes, and what the range adds to the sums of the corpus."""
    keys = [_unpack_keys(k) for k in blocks["keys"]]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    core = np.bincount(at, np.concatenate([_unpack_counts(c) for c in blocks["core"]]), len(distinct)).astype(np.int64)
    deleted = np.bincount(at, np.concatenate([_unpack_counts(c) for c in blocks["deleted"]]), len(distinct)).astype(np.int64)
    kind, bucket, out, i = blocks["kind"].iloc[0], blocks["bucket"].iloc[0], [], 0
    for chunk, own in zip(blocks["chunk"], keys, strict=True):
        places = at[i : i + len(own)]
        out.append((kind, bucket, chunk, _pack_counts(core[places]), _pack_counts(deleted[places]), 0, 0, 0, 0))
        i += len(own)
    out.append((kind, bucket, -1, b"", b"", int(core.sum()), int(deleted.sum()), int((core > 0).sum()), int((core + deleted > 0).sum())))
    return pd.DataFrame(out, columns=["kind", "bucket", "chunk", "core", "deleted", "n_core", "n_deleted", "v_core", "v_all"])


def _answered(state: pd.DataFrame, totals: pd.DataFrame):
    """A chunk with the corpus's counts of its words and bigrams: (core, deleted) for each kind."""
    chunk = _Chunk(state.iloc[0].to_dict())
    counts = []
    for kind in (0, 1):
        own = totals[totals["kind"] == kind].sort_values("bucket")
        counts.append(tuple(np.concatenate([_unpack_counts(b) for b in own[k]]) for k in ("core", "deleted")))
    return chunk, counts


def _bucket(context_count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then one bucket for each power of two."""
    return np.minimum(np.frexp(np.maximum(context_count, 0).astype(np.float64))[1].astype(np.int64), BUCKETS - 1)


def _gridder(n_core: int):
    def run(_key: tuple, state: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        if state.empty:
            return pd.DataFrame({"bucket": [], "q2": [], "q1": [], "n": []}).astype("int64")
        chunk, ((uni, _), (bi, _)) = _answered(state, totals)
        cv, cw, cvw = uni[chunk.context], uni[chunk.tokens], bi[chunk.bigram]
        step = lambda p: np.where(p > 0, np.rint(GRID * np.log(np.where(p > 0, p, 1))), NONE).astype(np.int64)
        cells, n = np.unique(np.stack([_bucket(cv), step(cvw / np.maximum(cv, 1)), step(cw / max(n_core, 1))], axis=1), axis=0, return_counts=True)
        return pd.DataFrame({"bucket": cells[:, 0], "q2": cells[:, 1], "q1": cells[:, 2], "n": n})

    return run


def learn_weights(cells: list[tuple[int, int, int, int]], vocabulary: int, rounds: int = 60) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each bucket by expectation-maximisation on counts of the deleted fold."""
    weights = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    weights[0] = (0.0, 0.9, 0.1)
    data = np.array(cells, dtype=np.int64).reshape(-1, 4)
    for b in range(BUCKETS):
        own = data[data[:, 0] == b]
        if not len(own):
            continue
        value = lambda q: np.where(q == NONE, 0.0, np.exp(q / GRID))
        p = np.stack([value(own[:, 1]), value(own[:, 2]), np.full(len(own), 1 / (vocabulary + 1))], axis=1)
        w = weights[b]
        for _ in range(rounds):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * own[:, 3:4]).sum(axis=0) / own[:, 3].sum()
        # no weight is quite zero: what the deleted fold never showed stays possible
        w = np.maximum(w, 1e-6)
        weights[b] = w / w.sum()
    weights[0, 1] += weights[0, 0]
    weights[0, 0] = 0.0
    return weights


def _scorer(n: int, v: int, weights: np.ndarray):
    def run(_key: tuple, state: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        if state.empty:
            return pd.DataFrame({c.split()[0]: [] for c in _SCORE.split(", ")})
        chunk, ((u1, u2), (b1, b2)) = _answered(state, totals)
        uni, bi = u1 + u2, b1 + b2
        cv, cw, cvw = uni[chunk.context], uni[chunk.tokens], bi[chunk.bigram]
        w = weights[_bucket(cv)]
        p = w[:, 0] * cvw / np.maximum(cv, 1) + w[:, 1] * cw / max(n, 1) + w[:, 2] / (v + 1)
        at = np.cumsum(chunk.sizes) - chunk.sizes
        add = lambda x: np.add.reduceat(x, at)
        return pd.DataFrame({
            "doc_id": pd.array(chunk.doc_ids, dtype="Int64"),
            "held_out": chunk.roles == SCORED,
            "n_tokens": chunk.sizes,
            "n_known": add((cw > 0).astype(np.int64)),
            "train_tokens": n,
            "base_score": add(np.log10((cw + 1) / (n + v + 1))),
            "score": add(np.log10(p)),
        })

    return run


def score_texts(docs: DataFrame, held_out, deleted, chunk_tokens: int = 1_500_000, range_tokens: int = 2_000_000) -> DataFrame:
    """Score every text of `docs` (doc_id, text) with a model of those for which `held_out` is not true.

    `held_out` and `deleted` are boolean columns or expressions over `docs`: texts that are only scored, and texts of
    the training part that the weights are learned from. A null text counts as empty, and an empty text has one token, the
    end. A null flag is false. Repeated rows are counted and scored as often as they stand there. Other columns are
    ignored. With no rows the result is empty; with no training texts all mass is uniform.
    """
    held_out, deleted = (F.coalesce(F.expr(x) if isinstance(x, str) else x, F.lit(False)) for x in (held_out, deleted))
    role = F.when(held_out, SCORED).when(deleted, DELETED).otherwise(CORE)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", role.cast("int").alias("role"))
    chunks = stored(in_batches(rows, _chunker(chunk_tokens), _CHUNK), "lm-chunks")
    total = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // range_tokens))
    sent = in_batches(chunks, _sender(ranges), _SENT)
    totals = stored(sent.groupBy("kind", "bucket").applyInPandas(_add_up, _TOTAL), "lm-totals")
    sums = totals.filter("chunk = -1 and kind = 0").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_core", "n_deleted", "v_core", "v_all"))).first()
    answers = totals.filter("chunk >= 0").select("kind", "bucket", "chunk", "core", "deleted")
    meet = lambda odd: chunks.filter(odd).groupBy("chunk").cogroup(answers.filter(odd).groupBy("chunk"))
    cells = meet("chunk % 2 = 1").applyInPandas(_gridder(sums[0]), "bucket long, q2 long, q1 long, n long")
    # at most BUCKETS x a few hundred x a few hundred cells, whatever the corpus
    cells = [tuple(r) for r in cells.groupBy("bucket", "q2", "q1").agg(F.sum("n")).collect()]
    weights = learn_weights(cells, sums[2])
    return meet("true").applyInPandas(_scorer(sums[0] + sums[1], sums[3], weights), _SCORE)

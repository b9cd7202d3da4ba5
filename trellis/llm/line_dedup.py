"""Lines that many documents share, found with two Bloom filters.

Each task notes the hashes of its lines in a once-seen and a twice-seen filter; filters are merged segment by segment,
and what two once-seen filters have in common joins the twice-seen one. Only lines that the twice-seen filter has are
shuffled, as 128-bit digests, to be counted exactly and to find their first occurrence. The filters have a fixed
largest size: on a corpus that fills them, more lines are shuffled and the result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stored
from .common import LOWER_ASCII, in_batches, pack, unpack

SEGMENT_BITS = 1 << 20
BITS_PER_LINE = 16
MOST_BITS = 1 << 31
#: Up to so many frequent lines (20 bytes each and a little more) are broadcast; beyond it they are joined.
BROADCAST_LINES = 200_000
_BLANK = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """A line as it is compared: stripped of white space, A-Z in lower case."""
    return line.strip(_BLANK).translate(LOWER_ASCII)


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def _positions(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each hash, and its three bits there."""
    segment = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    mask = np.uint64(SEGMENT_BITS - 1)
    return segment.astype(np.int64), np.stack([mixed & mask, (mixed >> np.uint64(20)) & mask, (mixed >> np.uint64(40)) & mask]).astype(np.int64)


def _noter(segments: int, flush: int = 2_000_000):
    def rows(hashes: list[int]) -> pa.RecordBatch:
        distinct, times = np.unique(np.array(hashes, dtype=np.uint64), return_counts=True)
        out: list[tuple] = []
        segment, bits = _positions(distinct, segments)
        order = np.argsort(segment, kind="stable")
        bounds = np.searchsorted(segment[order], np.arange(segments + 1))
        for k in range(segments):
            own = order[bounds[k] : bounds[k + 1]]
            if len(own):
                once, twice = np.zeros(SEGMENT_BITS, dtype=bool), np.zeros(SEGMENT_BITS, dtype=bool)
                once[bits[:, own].ravel()] = True
                twice[bits[:, own[times[own] > 1]].ravel()] = True
                out.append((k, pack(np.packbits(once)), pack(np.packbits(twice))))
        return pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["segment", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[int] = []
        for batch in batches:
            for text in batch.column("text").to_pylist():
                hashes.extend(xxhash.xxh64_intdigest(k) for k in {line_key(x) for x in _lines(text)} if k)
                if len(hashes) >= flush:
                    yield rows(hashes)
                    hashes = []
        if hashes:
            yield rows(hashes)

    return run


def _merge(own: pd.DataFrame) -> pd.DataFrame:
    once = twice = np.zeros(SEGMENT_BITS // 8, dtype=np.uint8)
    for a, b in zip(own["once"], own["twice"], strict=True):
        a, b = unpack(a, np.uint8), unpack(b, np.uint8)
        twice = twice | b | (once & a)
        once = once | a
    return pd.DataFrame({"segment": [own["segment"].iloc[0]], "twice": [pack(twice)]})


def _suspect(filters, segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = {k: unpack(v, np.uint8) for k, v in filters.value.items()}
        for batch in batches:
            digests, numbers, rows, hashes, keys = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                seen = {}
                for n, line in enumerate(_lines(text)):
                    key = line_key(line)
                    if key:
                        seen.setdefault(key, n)
                for key, n in seen.items():
                    keys.append(key)
                    hashes.append(xxhash.xxh64_intdigest(key))
                    numbers.append(n)
                    rows.append(i)
            if not keys:
                continue
            segment, at = _positions(np.array(hashes, dtype=np.uint64), segments)
            hit = np.zeros(len(keys), dtype=bool)
            for k in np.unique(segment):
                own = np.flatnonzero(segment == k)
                if k in bits:
                    hit[own] = ((bits[k][at[:, own] >> 3] >> (7 - (at[:, own] & 7)).astype(np.uint8)) & 1).all(axis=0)
            chosen = np.flatnonzero(hit)
            digests = [_digest(keys[i]) for i in chosen]
            where = pa.array([rows[i] for i in chosen], pa.int64())
            yield pa.record_batch(
                [pa.array(digests, pa.binary()), batch.column("doc_id").take(where), batch.column("row_key").take(where), pa.array([numbers[i] for i in chosen], pa.int32())],
                names=["digest", "doc_id", "row_key", "line"],
            )

    return run


def _rewrite(text: str | None, row_key: int, found: dict, keep_first: bool) -> tuple[str, int, int]:
    """The text without its repeated lines, its lines, and how many went. `found`: digest to (row, line) of the first occurrence."""
    lines, kept = _lines(text), []
    for n, line in enumerate(lines):
        key = line_key(line)
        first = found.get(_digest(key)) if key else None
        if first is None or (keep_first and first == (row_key, n)):
            kept.append(line)
    return b"\n".join(kept).decode("utf-8", "surrogatepass"), len(lines), len(lines) - len(kept)


def _rewriter(lookup, keep_first: bool):
    """`lookup`: a broadcast dictionary, or None where each row brings its own found lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("found").to_pylist() if lookup is None else None
            out = []
            for i, (text, row_key) in enumerate(zip(batch.column("text").to_pylist(), batch.column("row_key").to_pylist(), strict=True)):
                found = lookup.value if lookup is not None else {f["digest"]: (f["first_row"], f["first_line"]) for f in own[i] or ()}
                out.append(_rewrite(text, row_key, found, keep_first))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)] if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64())]
            yield pa.record_batch([batch.column("doc_id"), batch.column("kept"), *columns], names=["doc_id", "kept", "text", "n_lines", "n_dropped"])

    return run


def repeated_lines(rows: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """(suspects, frequent) for `rows` (doc_id, text, row_key): where suspected lines stand, and the lines that `min_docs` rows or more have, with their first occurrence."""
    spark = rows.sparkSession
    lines = rows.agg(F.coalesce(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "\n"))), F.lit(0))).first()[0]
    segments = max(1, min(MOST_BITS, lines * BITS_PER_LINE) // SEGMENT_BITS)
    noted = in_batches(rows.select("text"), _noter(segments), "segment int, once binary, twice binary")
    merged = noted.groupBy("segment").applyInPandas(_merge, "segment int, twice binary")
    # at most MOST_BITS in all
    filters = spark.sparkContext.broadcast({r["segment"]: bytes(r["twice"]) for r in merged.collect()})
    suspects = in_batches(rows.select("doc_id", "text", "row_key"), _suspect(filters, segments), "digest binary, doc_id long, row_key long, line int")
    frequent = suspects.groupBy("digest").agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", "row_key", "line")).alias("first"))
    frequent = frequent.filter(F.col("docs") >= min_docs)
    return suspects, frequent.select("digest", F.col("first.row_key").alias("first_row"), F.col("first.line").alias("first_line"))


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """`docs` (doc_id, text, others) without the lines whose key at least `min_docs` documents have, and with n_lines and n_dropped.

    A key is the line stripped of `[\\x20\\x09-\\x0D]` with A-Z in lower case; lines with an empty key stay. With `keep_first`, the
    occurrence in the first document by doc_id, nulls first, stays (in each of its rows, if the same row is there more than once). Every row counts as a document, repeated rows too. A
    null or empty text is one empty line. Kept lines keep their form. Other columns stay as they are, but ones
    named n_lines or n_dropped are replaced; an empty table gives no rows.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_dropped")]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in others)).alias("kept"),
        F.xxhash64("doc_id", "text").alias("row_key"),
    )
    suspects, frequent = repeated_lines(rows, min_docs)
    frequent = stored(frequent, "lines")
    kind = rows.schema["kept"].dataType.simpleString()
    out = f"doc_id long, kept {kind}, text string, n_lines long, n_dropped long"
    if frequent.count() <= broadcast_lines:
        lookup = rows.sparkSession.sparkContext.broadcast({bytes(r[0]): (r[1], r[2]) for r in frequent.collect()})
        done = in_batches(rows, _rewriter(lookup, keep_first), out)
    else:
        found = suspects.join(frequent, "digest").groupBy("row_key").agg(F.collect_set(F.struct("digest", "first_row", "first_line")).alias("found"))
        done = in_batches(rows.join(found, "row_key", "left"), _rewriter(None, keep_first), out)
    return done.select("doc_id", "text", *(F.col("kept")[c].alias(c) for c in others), "n_lines", "n_dropped")

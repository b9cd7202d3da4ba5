"""Near-duplicate documents by SimHash, with pigeonring filtering.

Fingerprints of 64 bits lie on a ring of M segments. If two differ in at most T bits, then from some segment on, every
chain of l consecutive segments differs in at most l * T / M bits. Chains whose budget is below one bit must be equal: they are the key by
which candidates meet. Of those that meet, pairs whose longer chains leave their budgets are dropped before the
full Hamming check.

Copies are grouped first, so all this runs on distinct fingerprints. The ring has more segments the more of them there are, as keys
are 24 bits wide with 8 segments, 28 with 16 and 30 with 32. A key that more than LIMIT fingerprints share all the same is
not compared pairwise: its members are linked through all fingerprints that differ from them in one bit, which finds just the
pairs within two bits, in linear space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..runtime import looked_up, removed, stored
from .common import in_batches, words_of

SHINGLE = 3
DISTANCE = 2
LIMIT = 64
#: Segments of the ring, and up to how many distinct fingerprints: at most 16 or so share a key by chance.
RINGS = ((8, 1 << 28), (16, 1 << 32), (32, 1 << 62))
SEED = 42


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text: a bit is set if over half of the shingles' hashes have it. No words: zero."""
    words = words_of(text)
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -shingle] + 1]).tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)])
    return majority(np.frombuffer(hashes, dtype=">u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of some big-endian 64-bit `hashes` have."""
    rows = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(rows), 65_536):
        counts += np.unpackbits(rows[at : at + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(rows)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Columns doc_id, fingerprint (long, the 64 bits) for `docs` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_signed(simhash(x, shingle)) for x in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(made, pa.int64())], names=["doc_id", "fingerprint"])

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fingerprint long")


def _chain_mask(start: int, length: int, segments: int) -> int:
    """The bits of `length` consecutive segments of the ring from `start` on."""
    width = 64 // segments
    return _signed(sum(((1 << width) - 1) << (width * ((start + k) % segments)) for k in range(length)))


def segments_for(n_prints: int) -> int:
    """How many segments the ring has for so many distinct fingerprints."""
    return next(segments for segments, most in RINGS if n_prints <= most)


def link(prints: DataFrame, distance: int = DISTANCE, segments: int | None = None, limit: int = LIMIT) -> DataFrame:
    """Edges (src, dst) that connect just the distinct `fingerprint`s of `prints` within `distance` bits.

    Without `segments` their number follows that of the fingerprints. Keys of up to `limit` members give each of their pairs that is within the
    distance, at most limit / 2 a member; members of larger keys (for a distance of two) are linked through their neighbours at one bit, 64 a member.
    The result is stored.
    """
    n_prints = prints.count()
    segments = segments or segments_for(n_prints)
    equal = (segments - 1) // distance
    chains = F.array(*(F.struct(F.lit(i).alias("start"), F.col("fingerprint").bitwiseAND(F.lit(_chain_mask(i, equal, segments))).alias("chain")) for i in range(segments)))
    keys = prints.select("fingerprint", F.explode(chains).alias("k")).select("fingerprint", F.struct("k.start", "k.chain").alias("k"))
    sizes = keys.groupBy("k").agg(F.count("*").alias("members")).filter("members > 1")
    shared = stored(looked_up(keys, sizes, "k", "inner").select("fingerprint", "k.start", "k.chain", "members"), "ring")
    few = shared.filter(F.col("members") <= limit)
    a, b = few.select("start", "chain", F.col("fingerprint").alias("src")), few.select("start", "chain", F.col("fingerprint").alias("dst"))
    differ = F.col("src").bitwiseXOR(F.col("dst"))
    near = F.col("src") < F.col("dst")
    # longer chains from the same start must stay within their budgets; the last of them is the whole ring
    for length in range(equal + 1, segments + 1):
        mask = F.get(F.array(*(F.lit(_chain_mask(i, length, segments)) for i in range(segments))), F.col("a.start"))
        near = near & (F.bit_count(differ.bitwiseAND(mask)) <= length * distance // segments)
    a, b = a.alias("a"), b.alias("b")
    pairs = a.join(b, (F.col("a.start") == F.col("b.start")) & (F.col("a.chain") == F.col("b.chain")) & near).select("src", "dst")
    crowded = shared.filter(F.col("members") > limit).select("fingerprint").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << b)) for b in range(64)))
    around = crowded.select("fingerprint", F.explode(F.transform(flips, lambda m: F.col("fingerprint").bitwiseXOR(m))).alias("centre"))
    stars = around.groupBy("centre").agg(F.min("fingerprint").alias("src"), F.collect_set("fingerprint").alias("all"))  # at most 65 members
    stars = stars.select("src", F.explode("all").alias("dst")).filter("src <> dst")
    links = stored(pairs.union(stars).distinct(), "links")
    removed(shared)
    return links


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, segments: int | None = None, limit: int = LIMIT) -> DataFrame:
    """Columns doc_id, fingerprint (long), component_id for `docs` (doc_id, text), one row per row.

    Documents with equal fingerprints, or with ones that differ in at most `distance` bits, are linked; component_id is the smallest
    doc_id of the component. Texts without words, nulls too, have fingerprint zero and are linked like others. A null doc_id
    is never the smallest unless all are null. Other columns are ignored; an empty table gives no rows.
    """
    if distance != 2:
        raise ValueError("keys shared by many are linked through neighbours at one bit, which is exact for a distance of 2")
    prints = stored(fingerprints(docs, shingle), "simhash")
    distinct = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "prints")
    links = link(distinct, distance, segments, limit)
    parts = connected_components(links)
    # the component of a fingerprint, by its smallest; then the smallest document of all its fingerprints
    grouped = distinct.join(parts.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    first = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    of_print = stored(looked_up(grouped, first, "component", "inner").select("fingerprint", "component_id"), "components")
    removed(links, distinct)
    return looked_up(prints, of_print, "fingerprint", "inner").select("doc_id", "fingerprint", "component_id")

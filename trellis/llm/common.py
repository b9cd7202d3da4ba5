"""Small pieces that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Arrow batches are bounded by bytes, whatever the length of texts, so that tasks need little memory beside the JVM's.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2_000

#: A Bloom filter of longs: bits for each, and at most (more longs pass more others; nothing is lost).
BITS, MOST_BITS, SEGMENT_BITS = 16, 1 << 27, 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: A-Z to a-z, every other byte as it is.
LOWER_ASCII = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with small batches; a session that has settings of its own for them keeps those."""
    conf, own = df.sparkSession.conf, df.sparkSession.sparkContext.getConf()
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        if not own.contains(key):
            conf.set(key, str(value))
    return df.mapInArrow(run, schema)


def words_of(text: str | None) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, A-Z in lower case, as UTF-8. bytes.split() splits at just these bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split()


def pack(array) -> bytes:
    """A numpy array as compressed bytes."""
    return zstandard.ZstdCompressor(level=1).compress(array.tobytes())


def unpack(blob: bytes, dtype):
    """The array that pack() was given."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=dtype)


def bloom_bits(longs: DataFrame) -> np.ndarray:
    """Packed bits of a Bloom filter, a power of two long, of the one column of `longs`, which is stored."""
    name = longs.columns[0]
    bits = 1 << max(SEGMENT_BITS.bit_length() - 1, min(MOST_BITS.bit_length() - 1, (longs.count() * BITS).bit_length()))

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.concatenate([np.zeros(0, dtype=np.int64), *(_places(b.column(name).to_numpy(), bits) for b in batches)])
        for segment in np.unique(at // SEGMENT_BITS).tolist():
            own = np.zeros(SEGMENT_BITS, dtype=bool)
            own[at[at // SEGMENT_BITS == segment] % SEGMENT_BITS] = True
            yield pa.record_batch([pa.array([segment], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], names=["segment", "bits"])

    def merge(own: pd.DataFrame) -> pd.DataFrame:
        both = np.bitwise_or.reduce([np.frombuffer(b, dtype=np.uint8) for b in own["bits"]])
        return pd.DataFrame({"segment": own["segment"].iloc[:1], "bits": [both.tobytes()]})

    out = np.zeros(bits // 8, dtype=np.uint8)
    # at most MOST_BITS in all
    for segment, part in longs.mapInArrow(note, "segment int, bits binary").groupBy("segment").applyInPandas(merge, "segment int, bits binary").collect():
        out[segment * SEGMENT_BITS // 8 : (segment + 1) * SEGMENT_BITS // 8] = np.frombuffer(part, dtype=np.uint8)
    return out


def _places(longs: np.ndarray, bits: int) -> np.ndarray:
    return ((longs.view(np.uint64) * _MIX) >> np.uint64(33)).astype(np.int64) & (bits - 1)


def in_bloom(bits: np.ndarray, longs: np.ndarray) -> np.ndarray:
    """Which of the longs the filter may have."""
    at = _places(longs, len(bits) * 8)
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)


def maybe_among(longs: DataFrame) -> Callable[[Column], Column]:
    """A test of a long column without nulls: true for every value that `longs`, a stored frame of one column, has, and for few others.

    Wide rows that fail it need no join with `longs`, and so no shuffle.
    """
    bits = longs.sparkSession.sparkContext.broadcast(bloom_bits(longs))

    @F.pandas_udf("boolean")
    def among(values: pd.Series) -> pd.Series:
        return pd.Series(in_bloom(bits.value, values.to_numpy()))

    return among

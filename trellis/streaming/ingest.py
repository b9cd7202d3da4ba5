"""Streaming ingest: new triples are counted per edge as they arrive, and fused in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.fusion import fuse
from ..sources.files import with_defaults


def triple_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Raw triples from JSON-lines files that arrive in a folder, with defaults for missing fields. A malformed line stops the stream."""
    rows = spark.readStream.schema(schemas.RAW_TRIPLE).option("mode", "FAILFAST").option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return with_defaults(rows.filter("head is not null and tail is not null"))


def counts_by_window(stream: DataFrame, time: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, relation, n) of a stream with a time column: tumbling windows, closed once the watermark has passed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), "relation").agg(F.count("*").alias("n"))


def ingest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's sums per (head, relation, tail, source) to `path`, laid out by batch, so a replayed batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("head", "relation", "tail", "source").agg(F.count("*").alias("n"), F.sum("confidence").alias("total"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fused_so_far(spark: SparkSession, path: str) -> DataFrame:
    """The fused edges of all that was ingested: sums are added up and fused like the triples themselves."""
    sums = spark.read.parquet(path).groupBy("head", "relation", "tail", "source").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return fuse(sums)

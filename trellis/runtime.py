"""Session helpers shared by every operator: where to cut lineage, how, and joins on keys that few rows or very many may have."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: `spark.checkpoint.dir`. Only a local session may do without; it gets a fresh folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stamped(now: str | None) -> Column:
    """A given time, or that of the query."""
    return F.current_timestamp() if now is None else F.lit(now).cast("timestamp")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back: cut lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/trellis-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def removed(*frames: DataFrame) -> None:
    """Delete the files of frames that stored() gave, once all that was made of them is stored itself. Any other frame is left alone."""
    for df in frames:
        path = vars(df).get("stored_at")
        if path:
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def freed(spark: SparkSession) -> None:
    """Have the shuffle files of frames that nothing refers to deleted: Spark deletes them when the driver collects its garbage, which may be long after."""
    for _ in range(2):  # what Python has let go of is let go of by Spark a little later
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


#: Rows of an iterative algorithm's frame that one partition has at least.
ROWS_A_PARTITION = 100_000


def checkpointed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A small frame of an iterative algorithm, stored, so that the next step's plan starts from a file of known size.

    (A checkpoint() keeps the estimated size of the plan it cuts. Joins multiply estimates, so after some ten rounds they are numbers of
    millions of digits, and planning never ends.) With `rows`, a bound of their number, a frame of many small partitions is put into as few as its size needs.
    """
    if rows is not None:
        df = df.coalesce(rows // ROWS_A_PARTITION + 1)
    return stored(df, "step")


def looked_up(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """`rows` joined with `table`, which has each `key` once, however many rows share one.

    One plan for every size: Spark broadcasts a table whose bytes it has measured to be few, and splits what the exchange of a key that very many rows
    have would bring to one task (adaptive execution). What stands above the join must not need the rows of a key together, or Spark does not split.
    """
    return rows.join(table, key, how)


def spread(rows: DataFrame) -> DataFrame:
    """Small `rows` dealt to as many partitions as the session's shuffles have, four for each core at least: for work that costs far more than reading, as files of few
    bytes are few partitions."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))

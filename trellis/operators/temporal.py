"""Reads in time: the graph as it was, the last row before each of many, and pairs of intervals that overlap.

No join here compares all pairs of a key. A lookup of the last row goes by time bins: what a bin's rows cannot answer is what the bins before
it ended with. Of two intervals that overlap the later one begins within the earlier one: a key's rows are cut, in the order of their starts, into
blocks of whole bins, and an interval goes to the blocks that it reaches into. So it is sent once, and once more for each block's worth of rows
that it overlaps, however long it is. A key with very many rows is split by its bins and blocks alike. Times are timestamps; intervals begin with
their start and end before their end, a null end being open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one key that one block of starts has, about.
BLOCK = 128
_EDGE = ["src_label", "src", "rel_type", "dst_label", "dst"]


def valid_at(edges: DataFrame, time: str | Column) -> DataFrame:
    """The edges that are valid at a time, the last revision of each. An edge without valid_from is valid from its creation, without either always."""
    at = F.lit(time).cast("timestamp") if isinstance(time, str) else time
    begun = F.coalesce("valid_from", "created_at") if "created_at" in edges.columns else F.col("valid_from")
    rows = edges.filter((begun.isNull() | (begun <= at)) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
    newest = F.max_by(F.struct(*(c for c in edges.columns if c not in _EDGE)), F.struct(F.coalesce("revision", F.lit(0)), begun, F.coalesce("change_id", F.lit(""))))
    return rows.groupBy(*_EDGE).agg(newest.alias("w")).select(*_EDGE, "w.*").select(*edges.columns)


def _micros(df: DataFrame, column: str) -> Column:
    """Microseconds from 1970, in an order that no time zone's clock change disturbs."""
    if df.select(column).schema[0].dataType.typeName() == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column))
    return F.unix_micros(F.col(column))


def _length(interval: str) -> Column:
    return F.expr(f"CAST(unix_micros(timestamp'1970-01-02 00:00:00 UTC' + interval {interval}) - unix_micros(timestamp'1970-01-02 00:00:00 UTC') AS BIGINT)")


def last_before(rows: DataFrame, table: DataFrame, keys: list[str], time: str, table_time: str, width: str = "1 day") -> DataFrame:
    """`rows` with `found`: the columns of the last row of `table` of the same keys at or before `time` (of several at one time the largest), or null.

    Each key's rows of one bin of `width` are in one task, beside the number of its bins. Rows with a null key or time find nothing.
    Columns of `table` must be orderable; `found`, `bin_`, `at_` and `row_` are names that `rows` may not have."""
    bin_ = lambda df, c: F.floor(_micros(df, c) / _length(width))
    own = [c for c in table.columns if c not in keys]
    left = rows.select(*keys, bin_(rows, time).alias("bin_"), F.col(time).alias("at_"), F.struct(*rows.columns).alias("row_"))
    left = left.withColumn("found", F.lit(None).cast(table.select(F.struct(*own)).schema[0].dataType))
    right = table.filter(F.col(table_time).isNotNull()).select(*keys, bin_(table, table_time).alias("bin_"), F.col(table_time).alias("at_"), F.struct(*own).alias("found"))
    right = right.withColumn("row_", F.lit(None).cast(left.schema["row_"].dataType))
    both = left.unionByName(right)
    ends = both.groupBy(*keys, "bin_").agg(F.max(F.when(F.col("row_").isNull(), F.struct("at_", "found"))).alias("last"))
    earlier = Window.partitionBy(*keys).orderBy("bin_").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "bin_", F.max("last").over(earlier).alias("before"))
    so_far = Window.partitionBy(*keys, "bin_").orderBy("at_", F.col("row_").isNotNull(), "found").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("inside", F.last("found", ignorenulls=True).over(so_far)).filter("row_ is not null")
    return seen.join(ends, [*keys, "bin_"], "left").select("row_.*", F.coalesce("inside", F.col("before.found")).alias("found"))


def _bounds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bounds): the bins that a key's blocks begin with, in order. A block has about BLOCK rows, of very many rows the square root; rows of one bin stay together."""
    bins, own = rows.groupBy(*keys, "low_").agg(F.count("*").alias("n")), Window.partitionBy(*keys)
    before = F.coalesce(F.sum("n").over(own.orderBy("low_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    block = F.floor(before / F.greatest(F.lit(float(BLOCK)), F.sqrt(F.sum("n").over(own))))
    firsts = bins.select(*keys, "low_", block.alias("block_")).groupBy(*keys, "block_").agg(F.min("low_").alias("low_"))
    return firsts.groupBy(*keys).agg(F.sort_array(F.collect_list("low_")).alias("bounds_"))


def _block(bin_: str) -> Column:
    """The block that a bin lies in, -1 before the first one."""
    return F.size(F.filter("bounds_", lambda b: b <= F.col(bin_))) - 1


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], start: str = "valid_from", end: str = "valid_to", grain: str = "1 hour") -> DataFrame:
    """Pairs (keys, l, r) of rows with the same keys whose intervals overlap, as structs of their other columns; each pair once, checked exactly.

    `grain` is the smallest bin: take about the length of a short interval. Empty intervals, and those without a start or a key, overlap nothing."""

    def shaped(df: DataFrame, name: str) -> DataFrame:
        rows = df.filter(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start))))
        low, high = F.floor(_micros(df, start) / _length(grain)), F.floor((_micros(df, end) - 1) / _length(grain))
        return rows.select(*keys, F.struct(*(c for c in df.columns if c not in keys)).alias(name), low.alias("low_"), high.alias("high_"))

    def met(a: DataFrame, b: DataFrame, span: str, instant: str) -> DataFrame:
        """Rows of `a` beside those of `b` that begin in a block that they reach into."""
        bounds = _bounds(b, keys)
        last = F.when(F.col("high_").isNull(), F.size("bounds_") - 1).otherwise(_block("high_"))
        spans = a.join(bounds, keys).select(*keys, span, F.greatest(_block("low_"), F.lit(0)).alias("first_"), last.alias("last_")).filter("last_ >= first_")
        spans = spans.select(*keys, span, F.explode(F.sequence("first_", "last_")).alias("block_"))
        return spans.join(b.join(bounds, keys).select(*keys, instant, _block("low_").alias("block_")), [*keys, "block_"])

    a, b = shaped(left, "l"), shaped(right, "r")
    within = lambda p, i: F.col(f"{i}.{end}").isNull() | (F.col(f"{p}.{start}") < F.col(f"{i}.{end}"))
    # of two that overlap, the later one begins within the earlier one
    first = met(a, b, "l", "r").filter((F.col(f"r.{start}") >= F.col(f"l.{start}")) & within("r", "l"))
    second = met(b, a, "r", "l").filter((F.col(f"l.{start}") > F.col(f"r.{start}")) & within("l", "r"))
    return first.select(*keys, "l", "r").unionByName(second.select(*keys, "l", "r"))

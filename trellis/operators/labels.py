"""Sequence labels: normalizing, spans, and span scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# The entity types of the label scheme.
ENTITY_TYPES = ["dis", "sym", "dru", "equ", "pro", "bod", "ite", "mic", "dep"]


def normalize_label(label: Column, types: list[str] = ENTITY_TYPES) -> Column:
    """B- or I- with a known type, in upper and lower case each; anything else is O."""
    x = strip(label)
    prefix, kind = F.upper(F.substring_index(x, "-", 1)), F.lower(F.regexp_replace(x, "(?s)^[^-]*-", ""))
    good = x.contains("-") & prefix.isin("B", "I") & kind.isin(*types)
    return F.when(F.coalesce(good, F.lit(False)), F.concat_ws("-", prefix, kind)).otherwise("O")


def normalize_labels(labels: Column) -> Column:
    return F.transform(labels, lambda x: normalize_label(x))


def bio_spans(rows: DataFrame) -> DataFrame:
    """(key, start, end, type) of `rows` (key, pos, label): islands of one type, a B opening a new one; `end` is inside."""
    by = Window.partitionBy("key").orderBy("pos")
    kind = F.when(F.col("label").contains("-"), F.regexp_replace("label", "(?s)^[^-]*-", ""))
    rows = rows.select("key", "pos", kind.alias("type"), F.col("label").startswith("B-").alias("opens"))
    opens = F.col("opens") | F.lag("type").over(by).isNull() | (F.lag("type").over(by) != F.col("type")) | (F.lag("pos").over(by) != F.col("pos") - 1)
    rows = rows.withColumn("opens", opens & F.col("type").isNotNull())
    rows = rows.withColumn("island", F.sum(F.col("opens").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))).filter("type is not null")
    return rows.groupBy("key", "island", "type").agg(F.min("pos").alias("start"), F.max("pos").alias("end")).select("key", "start", "end", "type")


def span_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row (precision, recall, f1) over all spans (key, start, end, type), each counted once."""
    g, p = gold.distinct(), predicted.distinct()
    n = g.agg(F.count("*").alias("g")).crossJoin(p.agg(F.count("*").alias("p"))).crossJoin(g.join(p, ["key", "start", "end", "type"]).agg(F.count("*").alias("c")))
    precision, recall = (F.when(F.col(x) > 0, F.col("c") / F.col(x)).otherwise(0.0) for x in ("p", "g"))
    return n.select(precision.alias("precision"), recall.alias("recall")).withColumn(
        "f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    )


def split_rows(rows: DataFrame, key: str, valid_share: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, valid): floor(n * (1 - valid_share)) rows train, the others validate, by a hash of the key and the seed. All rows train if the
    share is not between 0 and 1, or if a side would be empty.

    Rows are counted by ranges of the hash; only the range that the border falls into is put in order.
    """
    n = rows.count() if 0 < valid_share < 1 else 0
    train = int(n * (1.0 - valid_share)) if n >= 2 else 0
    if not 0 < train < n:
        return rows, rows.limit(0)
    spot = F.xxhash64(F.lit(seed), F.col(key))
    placed = rows.withColumns({"spot_": spot, "range_": F.shiftrightunsigned(spot, 48)})
    sizes = placed.groupBy("range_").agg(F.count("*").alias("size_"))  # at most 65,536 rows
    sizes = sizes.select("range_", (F.sum("size_").over(Window.orderBy("range_")) - F.col("size_")).alias("before_"), "size_")
    placed = placed.join(F.broadcast(sizes), "range_")
    border = placed.filter(f"before_ < {train} and before_ + size_ > {train}")
    order = Window.partitionBy("range_").orderBy("spot_", key, F.xxhash64(*rows.columns))
    border = border.withColumn("valid_", F.col("before_") + F.row_number().over(order) > train)
    clear = placed.filter(f"not (before_ < {train} and before_ + size_ > {train})").withColumn("valid_", F.col("before_") >= train)
    split = clear.unionByName(border)
    return split.filter("not valid_").select(*rows.columns), split.filter("valid_").select(*rows.columns)

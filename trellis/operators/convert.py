"""Two table shapes to typed triples: entity-predicate-value rows, and one row per entity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import list_literal, strip, typed_name
from .counters import Counters

COLUMNS = ["head", "head_type", "relation", "tail", "tail_type", "source", "confidence", "is_property", "seq"]


def _table(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def eav_triples(rows: DataFrame, source: str = "CM3KG_DiseaseCSV", counters: Counters | None = None) -> DataFrame:
    """Triples of (entity, predicate, value, seq). The predicate decides: a property, a relation, a reversed relation, or nothing.

    Relations of some predicates have several values, parted by blanks. Reversed ones swap head and tail.
    `counters` get eav_read (with the rows whose predicate is unknown) and eav_triples (with the properties among them).
    """
    if counters is not None:
        known = [*schemas.EAV_PROPERTIES, *schemas.EAV_RELATIONS, *schemas.EAV_REVERSED]
        rows = counters.count("eav_read", rows, unknown=~F.coalesce(strip(F.col("predicate")).isin(*known), F.lit(False)))
    kinds = [(k, 0, f"PROP_{v.upper()}", "Text", None, False) for k, v in schemas.EAV_PROPERTIES.items()]
    kinds += [(k, 1, rel, tail, None, k in schemas.EAV_MULTI) for k, (rel, tail) in schemas.EAV_RELATIONS.items() if k not in schemas.EAV_PROPERTIES]
    kinds += [(k, 2, rel, tail, head, False) for k, (rel, tail, head) in schemas.EAV_REVERSED.items()]
    kinds = _table(rows, kinds, "predicate string, kind int, relation string, tail_type string, reverse_head string, many boolean")
    rows = rows.select(typed_name(F.col("entity")).alias("e"), strip(F.col("predicate")).alias("predicate"), F.coalesce("value", F.lit("")).alias("value"), "seq").filter("e.name <> ''")
    rows = rows.join(kinds, "predicate")
    values = F.when(F.col("many"), F.filter(F.split("value", r"(?U)[\s\x1c-\x1f]+"), lambda v: v != "")).otherwise(F.array(strip(F.col("value"))))
    rows = rows.select("*", F.posexplode(values).alias("place", "item"))
    back = typed_name(F.col("item"))["name"]
    swapped = F.col("kind") == 2
    made = _first_wins(rows.select(
        F.when(swapped, back).otherwise(F.col("e.name")).alias("head"), F.when(swapped, F.col("reverse_head")).otherwise(F.col("e.type")).alias("head_type"),
        "relation", F.when(swapped, F.col("e.name")).otherwise(F.col("item")).alias("tail"), "tail_type", F.lit(source).alias("source"), F.lit(1.0).alias("confidence"),
        (F.col("kind") == 0).alias("is_property"), F.struct(F.lit(0).alias("file"), "seq", F.lit(0).alias("column"), "place").alias("seq"),
    ))
    return made if counters is None else counters.count("eav_triples", made, properties=F.col("is_property"))


def wide_triples(rows: DataFrame, source: str = "CM3KG_MedicalCSV", counters: Counters | None = None) -> DataFrame:
    """Triples of one row per entity: its list columns are unpivoted and exploded, its text columns become properties.

    `counters` get wide_read (with the rows without a name) and wide_triples (with the properties among them)."""
    if counters is not None:
        rows = counters.count("wide_read", rows, nameless=F.coalesce(strip(F.col("name")), F.lit("")) == "")
    have = set(rows.columns)
    lists = [F.struct(F.lit(i).alias("column"), F.lit(rel).alias("relation"), F.lit(kind).alias("tail_type"), F.lit(False).alias("is_property"), list_literal(F.col(c)).alias("items"))
             for i, (c, (rel, kind)) in enumerate(schemas.WIDE_LISTS.items()) if c in have]
    texts = [F.struct(F.lit(100 + i).alias("column"), F.lit(f"PROP_{c.upper()}").alias("relation"), F.lit("Text").alias("tail_type"), F.lit(True).alias("is_property"), F.array(strip(F.col(c))).alias("items"))
             for i, c in enumerate(schemas.WIDE_PROPERTIES) if c in have]
    rows = rows.withColumn("head", strip(F.col("name"))).filter("head <> ''")
    rows = rows.select("head", "seq", F.explode(F.array(*lists, *texts)).alias("c")).select("head", "seq", "c.*").select("*", F.posexplode("items").alias("place", "tail"))
    made = _first_wins(rows.select(
        "head", F.lit("Disease").alias("head_type"), "relation", "tail", "tail_type", F.lit(source).alias("source"), F.lit(1.0).alias("confidence"), "is_property",
        F.struct(F.lit(1).alias("file"), "seq", "column", "place").alias("seq"),
    ))
    return made if counters is None else counters.count("wide_triples", made, properties=F.col("is_property"))


def _first_wins(rows: DataFrame) -> DataFrame:
    """Triples without empty parts; of equal ones the first in order, of properties the first per entity and name."""
    rows = rows.filter("head <> '' and tail <> '' and relation <> ''")
    key = [F.col("head"), F.col("relation"), F.when(F.col("is_property"), F.lit(None)).otherwise(F.col("tail"))]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key, "is_property").orderBy("seq"))).filter("rank = 1").drop("rank")


def union_first_wins(parts: list[DataFrame], limit: int = 0, properties: bool = True) -> DataFrame:
    """All parts' triples, deduplicated across them in order; `limit` bounds the triples, not the properties (0: no limit)."""
    rows = _first_wins(reduce(DataFrame.unionByName, parts))
    if not properties:
        rows = rows.filter("not is_property")
    if limit:
        rows = rows.filter("not is_property").orderBy("seq").limit(limit).unionByName(rows.filter("is_property"))
    return rows

"""Evidence from many sources to scored edges, with conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import MULTI_VALUED, SOURCE_WEIGHTS


def conflicting_rows(triples: DataFrame, allow_multi: list[str] = MULTI_VALUED) -> DataFrame:
    """(head, relation, tail, sources) of groups with several tails, unless the relation may have many: one row per tail, whatever their number.

    Triples are made distinct first; groups with several tails are then looked up, so that a head with most of all rows is in no one task."""
    rows = triples.filter(~F.upper("relation").isin(*allow_multi)) if allow_multi else triples
    rows = rows.groupBy("head", "relation", "tail").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    return rows.join(_several(rows), ["head", "relation"], "left_semi")


def _several(rows: DataFrame) -> DataFrame:
    """(head, relation) of distinct triples with more than one tail; counted in each task first."""
    return rows.groupBy("head", "relation").agg(F.count("*").alias("tails")).filter("tails > 1").select("head", "relation")


def conflicts(triples: DataFrame, allow_multi: list[str] = MULTI_VALUED) -> DataFrame:
    """(head, relation, tails, sources) of groups with several tails, unless the relation may have many. A row lists all tails of its group: where
    groups are large, take `conflicting_rows`."""
    rows = conflicting_rows(triples, allow_multi).groupBy("head", "relation")
    return rows.agg(F.sort_array(F.collect_list("tail")).alias("tails"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))


def source_weight(source: Column, weights: dict[str, float] = SOURCE_WEIGHTS) -> Column:
    known = F.create_map(*[F.lit(v) for k, w in weights.items() for v in (k, float(w))])
    return F.coalesce(F.element_at(known, source), F.lit(float(weights.get("default", 1.0))))


def fuse(
    triples: DataFrame,
    weights: dict[str, float] = SOURCE_WEIGHTS,
    allow_multi: list[str] = MULTI_VALUED,
    frequency_weight: float = 0.3,
    source_weight_: float = 0.3,
    confidence_weight: float = 0.4,
    keep_types: bool = False,
) -> DataFrame:
    """One row per (head, relation, tail): frequency, mean weight of its distinct sources, mean confidence, score, conflict flag, sources.

    Triples may be summed up already, with `n` and the `total` of their confidences instead of a confidence. `seq` orders the edges by
    score, the best first; of equal scores the edge whose first triple (by its own seq, if there is one) came first, then by names.
    With `keep_types`, head_type and tail_type stay: those of the first triple that has them. One shuffle by (head, relation, tail) for the aggregate;
    groups with several tails are counted and looked up by (head, relation), which hot heads split, and only for relations that may not have many.
    """
    if "n" not in triples.columns:
        triples = triples.withColumns({"n": F.lit(1), "total": F.col("confidence")})
    first = F.min("seq") if "seq" in triples.columns else F.lit(None).cast("long")
    order = F.struct(F.col("seq") if "seq" in triples.columns else F.lit(0), "source")
    kinds = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("head_type", "tail_type")] if keep_types else []
    edges = triples.groupBy("head", "relation", "tail").agg(
        F.sum("n").cast("int").alias("frequency"), (F.sum("total") / F.sum("n")).alias("confidence"), F.sort_array(F.collect_set("source")).alias("sources"), first.alias("first"), *kinds
    )
    total = F.aggregate(F.transform("sources", lambda s: source_weight(s, weights)), F.lit(0.0), lambda x, y: x + y)
    top = edges.agg(F.max("frequency").alias("max_frequency"))
    edges = edges.withColumn("source_score", total / F.size("sources")).crossJoin(F.broadcast(top))
    raw = frequency_weight * F.col("frequency") / F.col("max_frequency") + source_weight_ * F.least("source_score", F.lit(1.0)) + confidence_weight * F.col("confidence")
    # each row is a distinct tail here, so a count of rows is one of tails
    single = edges.filter(~F.upper("relation").isin(*allow_multi)) if allow_multi else edges
    edges = edges.join(_several(single).withColumn("several", F.lit(True)), ["head", "relation"], "left")
    flag = F.coalesce("several", F.lit(False))
    score = F.round(raw, 4)
    seq = F.struct((-score).alias("rank"), "first", "relation", "tail")
    return edges.select("head", "relation", "tail", "frequency", "source_score", "confidence", score.alias("edge_score"), raw.alias("edge_score_raw"), flag.alias("conflict"), "sources", seq.alias("seq"), *(["head_type", "tail_type"] if keep_types else []))

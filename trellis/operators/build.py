"""The whole way from raw triples to a graph: linking, fusion, conflicts, merging."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..runtime import stored
from . import fusion, linking
from .counters import Counters
from .graph import Graph


@dataclass
class Build:
    """What a build gives: names with their canonical ones, conflicts, fused edges, and the graph that holds them."""

    canonical: DataFrame
    conflicts: DataFrame
    fused: DataFrame
    graph: Graph


def empty_graph(spark) -> Graph:
    return Graph(spark.createDataFrame([], schemas.NODES), spark.createDataFrame([], schemas.EDGES))


def build(raw: DataFrame, onto: Graph | None = None, fuzzy: float | None = None, allow_multi: list[str] = schemas.MULTI_VALUED, now: str | None = None, counters: Counters | None = None, relation_names: dict[str, str] | None = None, **scoring) -> Build:
    """Raw triples (head, relation, tail, source, confidence, seq) linked, fused and merged into `onto`, or into an empty graph.

    `fuzzy` also links names of at least that similarity. `scoring` goes to fuse(): the sources' weights and the three parts of a score.
    With keep_types=True the triples' types reach the graph: an edge between known types is labelled by them, not by its relation's name. `relation_names`
    renames relations beforehand, as where a source says RECOMMEND_DRUG and questions ask for RECOMMENDED_DRUG. Edges are merged in the order of their scores, so that of several relations that share a label, the one of the lowest score stays.
    Canonical names and fused edges are stored: both are results, and the graph reads each several times. `counters` have linked (names, with
    those that another name stands for) and fused (edges, with those in conflict) when this returns.
    """
    if relation_names:
        table = F.create_map(*(F.lit(v) for kv in relation_names.items() for v in kv))
        raw = raw.withColumn("relation", F.coalesce(F.element_at(table, F.col("relation")), "relation"))
    counted = (lambda name, rows, **tests: rows) if counters is None else counters.count
    canonical = stored(counted("linked", linking.canonical_names(linking.entity_names(raw), fuzzy), replaced=F.col("name") != F.col("canonical")), "canonical")
    triples = linking.canonicalize(raw, canonical)
    fused = stored(counted("fused", fusion.fuse(triples, allow_multi=allow_multi, **scoring), conflicts=F.col("conflict")), "fused")
    graph = (onto or empty_graph(raw.sparkSession)).upsert_triples(fused, linking.aliases_of(canonical), now)
    return Build(canonical, fusion.conflicts(triples, allow_multi), fused, graph)

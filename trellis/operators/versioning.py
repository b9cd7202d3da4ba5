"""Changesets, audit events, revisions and rollback, as copy-on-write projections of tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..runtime import stamped
from .graph import Graph
from .temporal import valid_at


def next_revisions(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """`rows` (head, relation, tail, seq) with `revision`: on from the largest that the edge has, by seq. Edges without one count as 0."""
    known = edges.groupBy(F.col("src").alias("head"), F.col("rel_type").alias("relation"), F.col("dst").alias("tail")).agg(F.coalesce(F.max("revision"), F.lit(0)).alias("known"))
    number = F.row_number().over(Window.partitionBy("head", "relation", "tail").orderBy("seq"))
    return rows.join(known, ["head", "relation", "tail"], "left").withColumn("revision", (F.coalesce("known", F.lit(0)) + number).cast("int")).drop("known")


@dataclass
class VersionedGraph:
    """A graph with its changesets and audit events."""

    graph: Graph
    changesets: DataFrame
    events: DataFrame

    @classmethod
    def of(cls, graph: Graph) -> VersionedGraph:
        spark = graph.nodes.sparkSession
        return cls(graph, spark.createDataFrame([], schemas.CHANGESETS), spark.createDataFrame([], schemas.AUDIT_EVENTS))

    def begin(self, actor: str, reason: str, source: str = "pipeline", change_id: str | None = None, now: str | None = None) -> tuple[str, VersionedGraph]:
        """A new active changeset; its id must be new."""
        change_id = change_id or str(uuid.uuid4())
        if not self.changesets.filter(F.col("change_id") == change_id).isEmpty():
            raise ValueError(f"changeset exists: {change_id}")
        row = self.changesets.sparkSession.range(1).select(
            F.lit(change_id).alias("change_id"), F.lit(actor).alias("actor"), F.lit(reason).alias("reason"), F.lit(source).alias("source"),
            stamped(now).alias("created_at"), F.lit("active").alias("status"), F.lit(None).cast("timestamp").alias("rolled_back_at"),
        )
        return change_id, replace(self, changesets=self.changesets.unionByName(row))

    def upsert(self, triples: DataFrame, change_id: str, now: str | None = None) -> VersionedGraph:
        """A new edge with the next revision, and an audit event, for every valid triple (head, relation, tail, confidence, source, seq).

        Ends are matched by name alone; a name under several labels gives several edges and events, an unknown one a node without label.
        Relation names other than `[A-Z0-9_]+` are skipped. Triples of an unknown changeset are ignored: no nodes, edges or events come of them.
        """
        stamp = stamped(now)
        rows = triples.filter((F.col("head") != "") & (F.col("tail") != "") & F.col("relation").rlike("(?d)^[A-Z0-9_]+$"))
        known = self.changesets.filter(F.col("change_id") == change_id).select("change_id")
        rows = next_revisions(rows, self.graph.edges).crossJoin(F.broadcast(known))
        names = rows.select(F.col("head").alias("name")).union(rows.select("tail")).distinct()
        fresh = names.join(self.graph.nodes.select("name").distinct(), "name", "left_anti")
        nodes = self.graph.nodes.unionByName(fresh, allowMissingColumns=True)
        ends = nodes.select("label", "name")
        rows = rows.join(ends.select(F.col("label").alias("src_label"), F.col("name").alias("head")), "head").join(ends.select(F.col("label").alias("dst_label"), F.col("name").alias("tail")), "tail")
        edges = rows.select(
            "src_label", F.col("head").alias("src"), F.col("relation").alias("rel_type"), "dst_label", F.col("tail").alias("dst"), "source", F.col("confidence").cast("double").alias("confidence"),
            "change_id", "revision", F.lit(True).alias("active"), stamp.alias("valid_from"),
        )
        events = rows.select("change_id", stamp.alias("timestamp"), F.lit("CREATE").alias("action"), "head", "relation", "tail", "revision", F.lit(None).cast("boolean").alias("rolled_back"))
        return VersionedGraph(Graph(nodes, self.graph.edges.unionByName(edges, allowMissingColumns=True)), self.changesets, self.events.unionByName(events))

    def rollback(self, change_id: str, now: str | None = None) -> tuple[int, VersionedGraph]:
        """(audit events of the changeset, the graph with its edges inactive)."""
        own = F.col("change_id").eqNullSafe(F.lit(change_id))
        stamp = stamped(now)
        known = not self.changesets.filter(own).isEmpty()
        count = self.events.filter(own).count() if known else 0
        changesets = self.changesets.withColumns({"status": F.when(own, "rolled_back").otherwise(F.col("status")), "rolled_back_at": F.when(own, stamp).otherwise(F.col("rolled_back_at"))})
        events = self.events.withColumn("rolled_back", F.when(own, True).otherwise(F.col("rolled_back")))
        edges = self.graph.edges.withColumns({"active": F.when(own, False).otherwise(F.col("active")), "valid_to": F.when(own, stamp).otherwise(F.col("valid_to"))})
        return count, VersionedGraph(Graph(self.graph.nodes, edges), changesets, events)

    def as_of(self, time: str) -> Graph:
        """The graph at a time: edges valid then, in their last revision, what was rolled back later among them; nodes have no times, and all stay."""
        return Graph(self.graph.nodes, valid_at(self.graph.edges, time))

    def list_changesets(self, limit: int = 50) -> DataFrame:
        counts = self.events.groupBy("change_id").agg(F.count("*").alias("event_count"))
        rows = self.changesets.join(counts, "change_id", "left").withColumn("event_count", F.coalesce("event_count", F.lit(0)))
        return rows.select("change_id", "actor", "reason", "source", "created_at", "status", "event_count").orderBy(F.desc("created_at"), "change_id").limit(limit)

    def audit_events(self, change_id: str) -> DataFrame:
        return self.events.filter(F.col("change_id") == change_id).drop("change_id").orderBy("timestamp", "head", "relation", "tail", "revision")

    def history(self, entity: str) -> DataFrame:
        """Versioned edges out of an entity, newest first; one row of nulls for a node without any, none for an unknown name."""
        edges = self.graph.edges.filter("change_id is not null")
        nodes = self.graph.nodes.filter(F.col("name") == entity).select("name", F.col("label").alias("own_label"))
        on = (F.col("name") == F.col("src")) & F.col("own_label").eqNullSafe(F.col("src_label"))
        rows = nodes.join(edges, on, "left").select("change_id", F.col("rel_type").alias("relation"), "revision", "valid_from", "valid_to", "active")
        return rows.orderBy(F.desc_nulls_first("valid_from"), "change_id", "relation", "revision")

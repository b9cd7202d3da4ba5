"""Connected components by randomised contraction of the edge list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpointed, looked_up, removed


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows (node, component) for every node of `edges`; component is the smallest node of its component.

    Each round, a node points to the member of its closed neighbourhood with the smallest hash of that round, and the
    edge list is contracted along these pointers. A constant share of the nodes goes in each round, whatever the
    diameter, so the number of rounds is logarithmic. Hubs and giant components cost no more than their edges: minima
    are combined map-side, and pointers are looked up so that no task gets all nodes of one root (`looked_up`). Self loops make their node a component of one; nulls at either end are ignored.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null")
    size = pairs.count()
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    root = checkpointed(nodes.select("node", F.col("node").alias("root")), 2 * size)
    live = checkpointed(pairs.filter("u <> v").distinct(), size)
    turn = 0
    while left := live.count():
        both = live.union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("n"))
        best = both.groupBy("u").agg(F.min(rank("v")).alias("near"))
        hook = checkpointed(best.select("u", F.least(rank("u"), F.col("near"))["n"].alias("to")), 2 * left)
        met = looked_up(live, hook.withColumnRenamed("to", "nu"), "u", "inner")
        met = looked_up(met, hook.select(F.col("u").alias("v"), F.col("to").alias("nv")), "v", "inner")
        met = met.filter("nu <> nv").select(F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v")).distinct()
        moved = looked_up(root, hook.withColumnRenamed("u", "root"), "root")
        past = live, root, hook
        live = checkpointed(met, left)
        root = checkpointed(moved.select("node", F.coalesce("to", "root").alias("root")), 2 * size)
        removed(*past)
        turn += 1
    smallest = root.groupBy("root").agg(F.min("node").alias("component"))
    return looked_up(root, smallest, "root", "inner").select("node", "component")


@dataclass
class Components:
    """Components that grow: `roots` (node, root) never changes but for new nodes, `moved` (root, component) says where old roots are now.

    `add` looks up the ends of a batch, contracts the batch over their components, and patches `moved`, which has a row for each root that was ever
    joined to another. No pass over all edges or nodes is made; `table` gives (node, component) as `connected_components` of all edges would.
    """

    roots: DataFrame
    moved: DataFrame

    @classmethod
    def of(cls, edges: DataFrame, src: str = "src", dst: str = "dst") -> Components:
        roots = connected_components(edges, src, dst).select("node", F.col("component").alias("root"))
        return cls(checkpointed(roots), roots.limit(0).select("root", F.col("root").alias("component")))

    def add(self, edges: DataFrame, src: str = "src", dst: str = "dst") -> Components:
        """Components with a batch of edges. A self loop makes a new node known; nulls at either end are ignored."""
        batch = checkpointed(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src is not null and dst is not null").distinct())
        nodes = batch.select(F.col("src").alias("node")).union(batch.select("dst")).distinct()
        found = self.roots.join(nodes, "node", "left_semi").join(self.moved, "root", "left").select("node", F.coalesce("component", "root").alias("at"))
        ends = checkpointed(nodes.join(found, "node", "left").select("node", F.coalesce("at", "node").alias("at"), F.col("at").isNull().alias("new")))
        met = looked_up(batch, ends.select(F.col("node").alias("src"), F.col("at").alias("u")), "src", "inner")
        met = looked_up(met, ends.select(F.col("node").alias("dst"), F.col("at").alias("v")), "dst", "inner")
        joined = checkpointed(connected_components(met, "u", "v"))
        fresh = ends.filter("new").join(joined, "node").select("node", F.col("component").alias("root"))
        went = joined.filter("node <> component").join(ends.filter("new").select("node"), "node", "left_anti").select(F.col("node").alias("component"), F.col("component").alias("to"))
        moved = self.moved.join(went, "component", "left").select("root", F.coalesce("to", "component").alias("component"))
        moved = moved.unionByName(went.select(F.col("component").alias("root"), F.col("to").alias("component")))
        out = Components(self.roots.unionByName(checkpointed(fresh)), checkpointed(moved))
        removed(batch, ends, joined)
        return out

    def table(self) -> DataFrame:
        """(node, component) of every node."""
        return looked_up(self.roots, self.moved, "root").select("node", F.coalesce("component", "root").alias("component"))

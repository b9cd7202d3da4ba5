"""The property graph as two tables: labels, upserts, hops, catalogue, search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..runtime import checkpointed, stamped
from ..schemas import LABELS, PROPERTY_NAMES, RELATION_LABELS

ALLOWED = sorted({r for _, r, _ in RELATION_LABELS.values()})


def label_inference(triples: DataFrame) -> DataFrame:
    """`triples` with src_label, rel_type, dst_label: from both types where they are known labels, else from the relation's name.

    Without type columns the name alone decides. An unknown relation becomes RELATED_TO between entities.
    """
    names = [(k, *v) for k, v in RELATION_LABELS.items()]
    lookup = F.broadcast(triples.sparkSession.createDataFrame(names, "relation_key string, h_ string, r_ string, t_ string"))
    rows = triples.join(lookup, F.lower("relation") == F.col("relation_key"), "left")
    typed = F.lit(False)
    if {"head_type", "tail_type"} <= set(triples.columns):
        typed = F.coalesce(F.col("head_type").isin(*LABELS) & F.col("tail_type").isin(*LABELS), F.lit(False))
    else:
        rows = rows.withColumns({"head_type": F.lit(None).cast("string"), "tail_type": F.lit(None).cast("string")})
    known = F.when(F.col("relation").isin(*ALLOWED), F.col("relation")).otherwise("RELATED_TO")
    rows = rows.withColumns({
        "src_label": F.when(typed, F.col("head_type")).otherwise(F.coalesce("h_", F.lit("Entity"))),
        "rel_type": F.when(typed, known).otherwise(F.coalesce("r_", F.lit("RELATED_TO"))),
        "dst_label": F.when(typed, F.col("tail_type")).otherwise(F.coalesce("t_", F.lit("Entity"))),
    })
    return rows.select(*triples.columns, "src_label", "rel_type", "dst_label")


def is_property(relation: Column) -> Column:
    return relation.isin(*(f"PROP_{p.upper()}" for p in PROPERTY_NAMES))


def property_rows(triples: DataFrame) -> DataFrame:
    """(label, name, prop, value, seq) of the property triples; they go to the label of their type, or Entity."""
    label = F.when(F.col("head_type").isin(*LABELS), F.col("head_type")).otherwise("Entity") if "head_type" in triples.columns else F.lit("Entity")
    rows = triples.filter(is_property(F.col("relation")) & (F.col("head") != "") & (F.col("tail") != ""))
    rows = rows.select(label.alias("label"), F.col("head").alias("name"), F.lower(F.substring("relation", 6, 100)).alias("prop"), strip(F.col("tail")).alias("value"), "seq")
    return rows.filter("value <> ''")


def longest_properties(rows: DataFrame) -> DataFrame:
    """One row per (label, name, prop): the longest value; of equally long ones the first by seq."""
    best = F.min_by("value", F.struct(-F.length("value"), F.col("seq")))
    return rows.groupBy("label", "name", "prop").agg(best.alias("value"))


def last_writer(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """One row per key: all attributes of the last writer, nulls too."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("w")).select(*keys, "w.*")


def first_writer(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """One row per key: all attributes of the first writer, nulls too."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("w")).select(*keys, "w.*")


@dataclass
class Graph:
    """A version of the graph. Operations return new versions."""

    nodes: DataFrame
    edges: DataFrame

    def clear(self) -> Graph:
        return Graph(self.nodes.limit(0), self.edges.limit(0))

    def upsert_triples(self, triples: DataFrame, aliases: DataFrame | None = None, now: str | None = None) -> Graph:
        """Merge fused triples into the graph at time `now`, in the order of their `seq`, a number or a struct.

        Properties merge into nodes, the longest value staying. A node keeps the aliases it was created with. An edge
        takes all attributes of its last writer.
        """
        stamp = stamped(now)
        rels = label_inference(triples.filter(~is_property(F.col("relation")) & (F.col("head") != "") & (F.col("tail") != "")))
        new_props = longest_properties(property_rows(triples))
        ends = rels.select(F.col("src_label").alias("label"), F.col("head").alias("name"), F.struct(F.lit(1).alias("phase"), F.col("seq"), F.lit(0).alias("end")).alias("seq"))
        ends = ends.union(rels.select("dst_label", "tail", F.struct(F.lit(1).alias("phase"), F.col("seq"), F.lit(1).alias("end"))))
        if aliases is not None:
            ends = ends.join(aliases.withColumnRenamed("canonical", "name"), "name", "left").withColumn("aliases", F.coalesce("aliases", F.array("name")))
        else:
            ends = ends.withColumn("aliases", F.array("name"))
        # properties are written before edges: a node that they create has no aliases
        made = new_props.select("label", "name", F.struct(F.lit(0).alias("phase"), F.lit(None).cast(rels.schema["seq"].dataType).alias("seq"), F.lit(0).alias("end")).alias("seq"), F.lit(None).cast("array<string>").alias("aliases")).distinct()
        made = first_writer(ends.select("label", "name", "seq", "aliases").union(made), ["label", "name"]).select("label", "name", F.col("aliases").alias("new_aliases"))
        old_props = self.nodes.select("label", "name", F.explode("props").alias("prop", "value")).withColumn("seq", F.lit(-1).cast("long"))
        # of equally long values the one that was there stays
        props = longest_properties(old_props.unionByName(new_props.withColumn("seq", F.lit(0).cast("long"))))
        props = props.groupBy("label", "name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("prop", "value")))).alias("new_props"))
        nodes = self.nodes.withColumn("old", F.lit(True)).join(made.withColumn("touched", F.lit(True)), ["label", "name"], "full").join(props, ["label", "name"], "left")
        nodes = nodes.select(
            "label", "name", F.when(F.col("old"), F.col("aliases")).otherwise(F.col("new_aliases")).alias("aliases"), F.coalesce("new_props", F.create_map().cast("map<string,string>")).alias("props"),
            F.when(F.col("old"), F.col("created_at")).otherwise(stamp).alias("created_at"), F.when(F.col("touched"), stamp).otherwise(F.col("updated_at")).alias("updated_at"),
        )
        source = F.array_join("sources", ",") if "sources" in rels.columns else F.col("source")
        fresh = rels.select("src_label", F.col("head").alias("src"), "rel_type", "dst_label", F.col("tail").alias("dst"), source.alias("source"), "confidence", "frequency", "edge_score", "conflict", F.lit(False).alias("predicted"), stamp.alias("created_at"), "seq")
        keys = ["src_label", "src", "rel_type", "dst_label", "dst"]
        fresh = last_writer(fresh, keys).drop("seq")
        kept = self.edges.join(fresh.select(*keys), keys, "left_anti")
        return Graph(nodes, kept.unionByName(fresh, allowMissingColumns=True))

    def stats(self) -> DataFrame:
        """One row: numbers of nodes and edges."""
        return self.nodes.agg(F.count("*").alias("node_count")).crossJoin(self.edges.agg(F.count("*").alias("relationship_count")))

    def catalog(self) -> DataFrame:
        """(kind, name, n): labels and relation types."""
        labels = self.nodes.filter("label is not null").groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n"))
        types = self.edges.groupBy(F.col("rel_type").alias("name")).agg(F.count("*").alias("n"))
        return labels.select(F.lit("label").alias("kind"), "name", "n").union(types.select(F.lit("relation").alias("kind"), "name", "n"))

    def search(self, name: str, label: str | None = None, limit: int = 10) -> DataFrame:
        """Nodes whose name or an alias contains `name`, exact names first, then shorter ones."""
        q = name.lower()
        nodes = self.nodes.filter(F.col("label") == label) if label else self.nodes
        hit = F.lower("name").contains(q) | F.coalesce(F.exists("aliases", lambda a: F.lower(a).contains(q)), F.lit(False))
        rows = nodes.filter(hit).select("name", "label", "aliases", F.when(F.lower("name") == q, 0).otherwise(1).alias("match_type"), F.length("name").alias("name_len"))
        return rows.orderBy("match_type", "name_len", "name", "label").limit(limit)

    def node(self, name: str, label: str | None = None) -> DataFrame:
        rows = self.nodes.filter(F.col("name") == name)
        return (rows.filter(F.col("label") == label) if label else rows).orderBy("label").limit(1)

    def sample_nodes(self, label: str, limit: int = 50) -> DataFrame:
        return self.nodes.filter(F.col("label") == label).select("name").orderBy("name").limit(limit)

    def sample_relationships(self, rel_type: str, limit: int = 50) -> DataFrame:
        rows = self.edges.filter(F.col("rel_type") == rel_type)
        return rows.select(F.col("src").alias("head"), F.col("rel_type").alias("relation"), F.col("dst").alias("tail"), F.col("edge_score").alias("score"), "source", "conflict").orderBy(F.desc_nulls_first("score"), "head", "tail").limit(limit)

    def drawable_edges(self) -> DataFrame:
        """Edges both of whose ends are nodes."""
        names = self.nodes.select("name").distinct()
        return self.edges.join(names.select(F.col("name").alias("src")), "src", "left_semi").join(names.select(F.col("name").alias("dst")), "dst", "left_semi")


def duplicate_keys(nodes: DataFrame) -> DataFrame:
    """(label, name) pairs that are not unique: empty for a sound graph."""
    return nodes.groupBy("label", "name").agg(F.count("*").alias("n")).filter("n > 1")


def hop(edges: DataFrame, rel_type: str, src_label: str | None = None, dst_label: str | None = None) -> DataFrame:
    """(src, dst) pairs of one relation."""
    rows = edges.filter(F.col("rel_type") == rel_type)
    if src_label:
        rows = rows.filter(F.col("src_label") == src_label)
    if dst_label:
        rows = rows.filter(F.col("dst_label") == dst_label)
    return rows.select("src", "dst")


#: Rows of one side of a hub that one block of a join has, about.
BLOCK = 1_000


def joined_at(left: DataFrame, right: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """The inner join of two frames on `key`, for keys that may have very many rows on either side.

    The rows of a hub are dealt into blocks of about `block` on each side, and each block of one side meets each of the other under a key of
    its own, so that no key of the join has more than block x block pairs. Rows of other keys have one block, and are sent once."""
    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > block).select(key, F.ceil(F.col("n") / block).cast("int").alias(name))

    one = F.lit(1)
    hubs = checkpointed(sizes(left, "l_").join(sizes(right, "r_"), key, "full").select(key, F.coalesce("l_", one).alias("l_"), F.coalesce("r_", one).alias("r_")))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        n = F.coalesce(own, one)
        rows = df.join(hubs, key, "left").withColumn(f"{own}at", F.pmod(F.hash(*(F.col(c) for c in df.columns if c != key)), n))
        return rows.withColumn(f"{other}at", F.explode(F.sequence(F.lit(0), F.coalesce(other, one) - 1))).drop("l_", "r_")

    return dealt(left, "l_", "r_").join(dealt(right, "r_", "l_"), [key, "l_at", "r_at"]).drop("l_at", "r_at")


def undirected(pairs: DataFrame) -> DataFrame:
    """Each pair in both directions, a self loop once."""
    return pairs.union(pairs.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def without(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows (head, tail, ...) whose pair is not among `existing` (src, dst)."""
    return rows.join(existing.select(F.col("src").alias("head"), F.col("dst").alias("tail")), ["head", "tail"], "left_anti")


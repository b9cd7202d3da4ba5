"""Inference rules: joins over the edge table that propose edges.

A rule's frame has head, relation, tail, confidence, and via where one exists. Rules run once; inferred edges have the type INFERRED,
which no rule reads.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import freed, looked_up, removed, stamped, stored
from .counters import Counters
from .graph import Graph, hop, joined_at, undirected, without


@dataclass
class Rule:
    """A rule: SQL over the views `nodes` and `edges`, or a function of a Graph."""

    rule_id: str
    plan: str | Callable[[Graph], DataFrame]
    target_relation: str

    def apply(self, graph: Graph) -> DataFrame:
        if callable(self.plan):
            rows = self.plan(graph)
        else:
            rows = graph.edges.sparkSession.sql(self.plan, nodes=graph.nodes, edges=graph.edges) if "{edges}" in self.plan or "{nodes}" in self.plan else self._over_views(graph)
        add = {"relation": F.lit(self.target_relation), "via": F.lit(None).cast("string"), "confidence": F.lit(0.5)}
        rows = rows.withColumns({k: v for k, v in add.items() if k not in rows.columns})
        return rows.select("head", "relation", "tail", F.col("confidence").cast("double").alias("confidence"), "via", F.lit(self.rule_id).alias("rule_id"))

    def _over_views(self, graph: Graph) -> DataFrame:
        """SQL that names `nodes` and `edges` as tables sees this graph's, in common table expressions: views of the session stay as they are."""
        plan = self.plan.strip().replace("{", "{{").replace("}", "}}")
        more = f", {plan[4:]}" if re.match(r"(?is)with\s", plan) and not re.match(r"(?is)with\s+recursive\s", plan) else f" {plan}"
        return graph.edges.sparkSession.sql(f"WITH nodes AS (SELECT * FROM {{nodes_}}), edges AS (SELECT * FROM {{edges_}}){more}", nodes_=graph.nodes, edges_=graph.edges)


def star(left: DataFrame, right: DataFrame, existing: DataFrame, distinct: bool = False) -> DataFrame:
    """(head, tail, via): right's target for left's target over a shared source, unless the pair is there already. With `distinct`, each (head, tail) once, without via."""
    rows = joined_at(left.select(F.col("src").alias("via"), F.col("dst").alias("tail")), right.select(F.col("src").alias("via"), F.col("dst").alias("head")), "via")
    return without(rows.select("head", "tail").distinct() if distinct else rows.select("head", "tail", "via"), existing)


#: Sources of one target that one block of the co-occurrence join has, about.
BLOCK = 1000
#: Paths between sources that one pass sends through an exchange, and that one of its tasks counts, about.
PASS, TASK = 500_000_000, 2_000_000


def cooccurrence(pairs: DataFrame, least: int, block: int = BLOCK) -> DataFrame:
    """(head, tail, evidence_count): sources that share targets, head < tail, at least `least` paths.

    Sources are numbered, those of few pairs first. A source is sent, for each of its targets, the list of the target's sources with higher numbers, four bytes each,
    and counts what is in its lists: a path is no row of an exchange, and a source of very many pairs gets those of its like only. Targets with one source make no path.
    The sources of a target of very many are dealt into blocks of about `block`, and each block's sources get the lists of every block. Paths beyond PASS go in
    passes, each over a part of the sources, so that disk is bounded whatever their number.
    """
    spark = pairs.sparkSession
    pairs = stored(pairs.select("src", "dst").filter("src is not null and dst is not null"), "pairs")
    freed(spark)
    numbers = _numbered(pairs.groupBy("src").agg(F.count("*").alias("n")))
    met = pairs.join(numbers.select("src", "id"), "src").select("dst", "id")
    sizes = met.groupBy("dst").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("dst", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    sizes = stored(sizes, "hubs")
    met = looked_up(met, sizes, "dst").select("dst", "id", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    lists = met.groupBy("dst", "blocks", F.pmod(F.hash("id"), F.col("blocks")).alias("at")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    lists = stored(lists.filter("blocks > 1 or size(ids) > 1"), "lists")
    removed(pairs, sizes)
    del met
    freed(spark)
    few, hubs = lists.filter("blocks = 1"), lists.filter("blocks > 1")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = hubs.select("dst", F.col("at").alias("i"), every.alias("j"), F.col("ids").alias("own"))
    b = hubs.select("dst", every.alias("i"), F.col("at").alias("j"), "ids")
    n = F.size("ids").cast("long")
    total = (few.agg(F.sum(n * (n - 1) / 2)).first()[0] or 0) + (hubs.groupBy("dst").agg(F.sum(n).alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0)
    passes, rows = int(total // PASS) + 1, None
    tasks = max(int(total / passes // TASK) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for k in range(passes):
        now = lambda c: F.pmod(F.xxhash64(c), F.lit(passes)) == k  # noqa: B023, E731 - used in this turn
        sent = few.select("ids", F.posexplode("ids").alias("pos", "one")).filter(now("one")).select("one", F.slice("ids", F.col("pos") + 2, F.size("ids")).alias("others"))
        dealt = a.join(b, ["dst", "i", "j"]).select("ids", F.explode("own").alias("one")).filter(now("one"))
        sent = sent.union(dealt.select("one", F.filter("ids", lambda x: x > F.col("one")))).filter("size(others) > 0")
        # counted where the lists of a source are: no second exchange
        counts = sent.repartition(tasks, "one").select("one", F.explode("others").alias("other")).groupBy("one", "other").agg(F.count("*").alias("evidence_count"))
        found = stored(counts.filter((F.col("evidence_count") >= least) & (F.col("one") != F.col("other"))), "counted")
        rows = found if rows is None else rows.union(found)
        if passes > 1:
            del sent, dealt, counts
            freed(spark)
    removed(lists)
    for end in ("one", "other"):
        rows = rows.join(numbers.select(F.col("src").alias(f"{end}_src"), F.col("id").alias(end)), end)
    return rows.select(F.least("one_src", "other_src").alias("head"), F.greatest("one_src", "other_src").alias("tail"), "evidence_count")


def _numbered(degrees: DataFrame) -> DataFrame:
    """(src, n, id) of sources with their numbers of pairs: ids from 0 on without gaps, in the order of n."""
    rows = stored(degrees.orderBy("n", "src").withColumn("at", F.monotonically_increasing_id()), "degrees")
    # monotonic ids have the task's number above 33 bits
    task, before, starts = F.shiftright("at", 33), 0, {}
    for r in rows.groupBy(task.alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect():
        starts[r["task"]], before = before, before + r["n"]
    start = F.element_at(F.create_map(*(F.lit(v) for kv in starts.items() for v in kv)), task) if starts else F.lit(0)
    return rows.select("src", "n", (start + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast("int" if before < 1 << 31 else "long").alias("id"))


def chain(first: DataFrame, second: DataFrame, existing: DataFrame) -> DataFrame:
    """(head, tail, via): two hops, unless the ends are joined already."""
    rows = joined_at(first.select(F.col("src").alias("head"), F.col("dst").alias("via")), second.select(F.col("src").alias("via"), F.col("dst").alias("tail")), "via")
    return without(rows.select("head", "tail", "via"), existing)


def propagation(targets: DataFrame, related: DataFrame, existing: DataFrame) -> DataFrame:
    """(head, tail, via): what holds for one end of an undirected relation, for the other end, unless it holds there already."""
    rows = joined_at(targets.select(F.col("src").alias("head"), F.col("dst").alias("via")), undirected(related).select(F.col("src").alias("via"), F.col("dst").alias("tail")), "via")
    return without(rows.select("head", "tail", "via"), existing)


def _r1(g: Graph) -> DataFrame:
    rows = star(hop(g.edges, "HAS_SYMPTOM", "Disease", "Symptom"), hop(g.edges, "RECOMMENDED_DRUG", "Disease", "Drug"), hop(g.edges, "RELIEVES"))
    return rows.withColumn("confidence", F.lit(0.6))


def _r2(g: Graph) -> DataFrame:
    return cooccurrence(hop(g.edges, "HAS_SYMPTOM", "Disease", "Symptom"), 3).withColumn("confidence", F.lit(0.5))


def _r3(g: Graph) -> DataFrame:
    rows = chain(hop(g.edges, "NEEDS_EXAM", "Disease", "Exam"), hop(g.edges, "HAS_INDICATOR", "Exam", "Indicator"), hop(g.edges, "MONITORS_INDICATOR"))
    return rows.withColumn("confidence", F.lit(0.7))


def _r4(g: Graph) -> DataFrame:
    rows = propagation(hop(g.edges, "CONTRAINDICATED_FOR", "Drug", "Disease"), hop(g.edges, "RELATED_DISEASE", "Disease", "Disease"), hop(g.edges, "CONTRAINDICATED_FOR"))
    return rows.withColumn("confidence", F.lit(0.4))


MEDICAL_RULES = [
    Rule("r1_symptom_drug", _r1, "RELIEVES"),
    Rule("r2_disease_cooccurrence", _r2, "RELATED_DISEASE"),
    Rule("r3_exam_chain", _r3, "MONITORS_INDICATOR"),
    Rule("r4_contraindication_propagation", _r4, "POSSIBLE_CONTRAINDICATION"),
]


def run_rules(
    graph: Graph, rules: list[Rule] = MEDICAL_RULES, max_inferences: int = 1000, active_only: bool = False, failed: dict[str, Exception] | None = None, counters: Counters | None = None
) -> DataFrame:
    """All rules' inferences with rule_order, up to and with the rule that reaches `max_inferences`: rules are kept whole or not at all.

    With `active_only`, edges of rolled-back changesets are not read. Given a dict `failed`, each rule is run and stored by itself: one that fails, be it in
    planning (a column that is not there, SQL that cannot be read) or in a task, is left out and named there, and the others run; without one it is an
    error of the whole. `counters` get the inferences of each rule under its id.
    """
    if active_only:
        graph = Graph(graph.nodes, graph.edges.filter(F.coalesce("active", F.lit(True))))
    rows = None
    for order, rule in enumerate(rules):
        try:
            own = rule.apply(graph).withColumn("rule_order", F.lit(order))
            own = own if counters is None else counters.count(rule.rule_id, own)
            own = own if failed is None else stored(own, "rule")
        except Exception as error:  # noqa: BLE001 - whatever a rule raises, the others run
            if failed is None:
                raise
            failed[rule.rule_id] = error
            continue
        rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        rows = graph.edges.sparkSession.createDataFrame([], "head string, relation string, tail string, confidence double, via string, rule_id string, rule_order int")
    return capped(rows, max_inferences)


def capped(rows: DataFrame, most: int) -> DataFrame:
    """Rows of the rules before which fewer than `most` inferences were made. They are stored, as they are counted and read: each rule runs once."""
    rows = stored(rows, "inferences")
    counts = rows.groupBy("rule_order").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("rule_order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = counts.withColumn("before", before).filter(F.col("before") < most).select("rule_order")  # one row per rule
    return rows.join(F.broadcast(kept), "rule_order", "left_semi")


def write_predictions(graph: Graph, inferences: DataFrame, change_id: str | None = None, now: str | None = None) -> Graph:
    """Merge inferences as INFERRED edges on (head, tail, relation): the last by (rule_order, via) wins.

    Ends are matched by name alone, so a name under several labels gives several edges; unknown names give none.
    """
    best = inferences.groupBy("head", "relation", "tail").agg(F.max_by(F.struct("confidence", "rule_id", "via"), F.struct("rule_order", "via")).alias("w"))
    ends = graph.nodes.select("label", "name")
    rows = best.join(ends.select(F.col("label").alias("src_label"), F.col("name").alias("head")), "head").join(ends.select(F.col("label").alias("dst_label"), F.col("name").alias("tail")), "tail")
    fresh = rows.select(
        "src_label", F.col("head").alias("src"), F.lit("INFERRED").alias("rel_type"), "dst_label", F.col("tail").alias("dst"), F.col("relation").alias("relation_type"), "w.confidence", "w.rule_id", "w.via",
        F.lit(True).alias("predicted"), F.lit(change_id).cast("string").alias("change_id"), stamped(now).alias("created_at"),
    )
    keys = ["src_label", "src", "rel_type", "dst_label", "dst", "relation_type"]
    match = None
    new = fresh.select(*(F.col(k).alias(f"n_{k}") for k in keys))
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"n_{k}"))
        match = test if match is None else match & test
    return Graph(graph.nodes, graph.edges.join(new, match, "left_anti").unionByName(fresh, allowMissingColumns=True))


def inferred_for(graph: Graph, entity: str, top_k: int = 10) -> DataFrame:
    """The `top_k` most confident inferred edges from an entity, and as many to it, without repeated rows."""
    rows = graph.edges.filter("rel_type = 'INFERRED'")
    columns = lambda end: [F.col(end).alias("answer"), F.col("relation_type").alias("relation"), F.col("confidence").alias("score"), "rule_id", "via"]
    order = [F.desc_nulls_first("score"), "answer", "relation", "via"]
    out = rows.filter(F.col("src") == entity).select(*columns("dst")).orderBy(*order).limit(top_k)
    into = rows.filter(F.col("dst") == entity).select(*columns("src")).orderBy(*order).limit(top_k)
    return out.union(into).distinct()

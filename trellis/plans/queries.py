"""The registered queries over the star-schema graph, and their SQL twins for other engines."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import build, components, convert, evaluate, extract, fusion, graph, labels, linking, qa, rules, search_index, temporal, vectors, versioning
from ..runtime import shared_folder, spread, stored
from ..schemas import EDGES, NODES
from ..sources.store import GraphStore
from . import file_queries  # noqa: F401 - registers its queries
from .registry import ORACLE, QUERIES, query
from .stargraph import Star, pairs

#: Weights of the sources of SUPPLIES for the weighted query.
FLAG_WEIGHTS = {"default": 1.0, "flag_A": 1.2, "flag_R": 0.8}
#: What the graph queries ask for: a supplier, and a part of parts' names.
SUPPLIER, PART_WORDS = "Supplier#000000003", "small widget"
SHARED_PARTS = 4


def _fused(s: Star) -> DataFrame:
    return fusion.fuse(s.supply_sums(), allow_multi=["SUPPLIES"])


def _edges(s: Star) -> DataFrame:
    """SUPPLIES as graph edges, scored without rounding."""
    rows = _fused(s)
    return rows.select(
        F.lit("Supplier").alias("src_label"), F.col("head").alias("src"), F.col("relation").alias("rel_type"), F.lit("Part").alias("dst_label"), F.col("tail").alias("dst"),
        F.array_join("sources", ",").alias("source"), "confidence", F.round("edge_score_raw", 6).alias("edge_score"), "conflict", F.lit(None).cast("boolean").alias("active"),
    )


def _nodes(s: Star) -> DataFrame:
    """Suppliers, parts and customers; a part's alias is its brand."""
    none = F.lit(None).cast("array<string>")
    nodes = s.table("supplier").select(F.lit("Supplier").alias("label"), F.col("s_name").alias("name"), none.alias("aliases"))
    nodes = nodes.union(s.parts().select(F.lit("Part"), "part", F.array("p_brand"))).union(s.table("customer").select(F.lit("Customer"), "c_name", none))
    return nodes.withColumn("props", F.create_map().cast("map<string,string>"))


def _graph(s: Star) -> graph.Graph:
    return graph.Graph(_nodes(s), _edges(s))


# --- triples and fusion


@query("""SELECT relation, count(*) AS n, count(DISTINCT head) AS heads, count(DISTINCT tail) AS tails FROM (
    SELECT 'SUPPLIES' AS relation, head, tail FROM supplies UNION ALL SELECT 'ORDERED', head, tail FROM ordered UNION ALL SELECT 'HAS_TYPE', head, tail FROM types
    UNION ALL SELECT 'LOCATED_IN', head, tail FROM located UNION ALL SELECT 'BASED_IN', head, tail FROM based UNION ALL SELECT 'HAS_BRAND', head, tail FROM branded
    UNION ALL SELECT 'PART_OF', n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'IN_SEGMENT', c_name, c_mktsegment FROM customer) GROUP BY relation""")
def triples_raw_counts(s: Star) -> DataFrame:
    rows = s.supplies().select("relation", "head", "tail").union(s.ordered().select("relation", "head", "tail")).union(s.types().select("relation", "head", "tail")).union(s.dimensions().select("relation", "head", "tail"))
    return rows.groupBy("relation").agg(F.count("*").alias("n"), F.countDistinct("head").alias("heads"), F.countDistinct("tail").alias("tails"))


@query("SELECT head, tail, source, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY head, tail ORDER BY seq, source, confidence) AS r FROM supplies) WHERE r = 1")
def dedup_first_wins(s: Star) -> DataFrame:
    rows = s.supplies().withColumn("at", F.struct("seq", "source", "confidence"))
    return graph.first_writer(rows.select("head", "tail", "source", "confidence", "at"), ["head", "tail"], "at").select("head", "tail", "source", F.round("confidence", 6).alias("confidence"))


@query("SELECT head, tail, frequency, 1.0 AS source_score, round(confidence, 6) AS confidence, round(score, 6) AS score, sources FROM scored")
def fuse_edges(s: Star) -> DataFrame:
    rows = _fused(s)
    return rows.select("head", "tail", F.col("frequency").cast("long").alias("frequency"), "source_score", F.round("confidence", 6).alias("confidence"), F.round("edge_score_raw", 6).alias("score"), F.array_join("sources", ",").alias("sources"))


@query("""SELECT head, tail, round(avg(CASE source WHEN 'flag_A' THEN 1.2 WHEN 'flag_R' THEN 0.8 ELSE 1.0 END), 6) AS source_score
    FROM (SELECT DISTINCT head, tail, source FROM supplies) GROUP BY head, tail""")
def source_weighting(s: Star) -> DataFrame:
    return fusion.fuse(s.supplies(), FLAG_WEIGHTS).select("head", "tail", F.round("source_score", 6).alias("source_score"))


@query("SELECT head, string_agg(DISTINCT tail, ',' ORDER BY tail) AS tails, 'catalog' AS sources FROM types GROUP BY head HAVING count(DISTINCT tail) > 1")
def conflict_report(s: Star) -> DataFrame:
    return fusion.conflicts(s.types(), []).select("head", F.array_join("tails", ",").alias("tails"), F.array_join("sources", ",").alias("sources"))


@query("SELECT head, tail, count(DISTINCT tail) OVER (PARTITION BY head) > 1 AS conflict FROM (SELECT DISTINCT head, tail FROM types)")
def conflict_flag(s: Star) -> DataFrame:
    return fusion.fuse(s.types(), allow_multi=[]).select("head", "tail", "conflict")


@query("SELECT head AS name FROM supplies UNION SELECT tail FROM supplies UNION SELECT head FROM branded UNION SELECT tail FROM branded")
def entity_dim(s: Star) -> DataFrame:
    rows = s.supplies().select("head", "tail").union(s.dimensions().filter("relation = 'HAS_BRAND'").select("head", "tail"))
    return linking.entity_names(rows)


_NAMES = ["Has_Symptom", "TREATS", "治疗", "LOCATED_IN", "common_drug", "", "HAS_INDICATOR"]


@query(f"""WITH named AS (SELECT c_name AS head, [{", ".join(repr(n) for n in _NAMES)}][c_custkey % {len(_NAMES)} + 1] AS relation,
    CASE WHEN c_nationkey % 2 = 0 THEN 'Disease' END AS head_type, CASE WHEN c_nationkey % 3 = 0 THEN 'Drug' ELSE 'Planet' END AS tail_type FROM customer),
    known AS (SELECT * FROM (VALUES ('has_symptom', 'Disease', 'HAS_SYMPTOM', 'Symptom'), ('treats', 'Drug', 'TREATS', 'Disease'), ('治疗', 'Drug', 'TREATS', 'Disease'),
      ('common_drug', 'Disease', 'COMMON_DRUG', 'Drug'), ('has_indicator', 'Exam', 'HAS_INDICATOR', 'Indicator')) AS k(name, h, r, t))
    SELECT head, CASE WHEN typed THEN head_type ELSE coalesce(h, 'Entity') END AS src_label,
      CASE WHEN typed THEN CASE WHEN relation IN ('TREATS', 'HAS_INDICATOR') THEN relation ELSE 'RELATED_TO' END ELSE coalesce(r, 'RELATED_TO') END AS rel_type,
      CASE WHEN typed THEN tail_type ELSE coalesce(t, 'Entity') END AS dst_label
    FROM (SELECT *, coalesce(head_type = 'Disease' AND tail_type = 'Drug', false) AS typed FROM named LEFT JOIN known ON lower(relation) = name)""")
def label_inference(s: Star) -> DataFrame:
    rows = s.table("customer").select(
        F.col("c_name").alias("head"), F.get(F.array(*map(F.lit, _NAMES)), (F.col("c_custkey") % len(_NAMES)).cast("int")).alias("relation"),
        F.when(F.col("c_nationkey") % 2 == 0, "Disease").alias("head_type"), F.when(F.col("c_nationkey") % 3 == 0, "Drug").otherwise("Planet").alias("tail_type"),
    )
    return graph.label_inference(rows).select("head", "src_label", "rel_type", "dst_label")


@query("SELECT p_brand AS name, arg_max(p_name, (length(p_name), -p_partkey)) AS value FROM part GROUP BY p_brand", families=False)
def property_longest_wins(s: Star) -> DataFrame:
    rows = s.table("part").select(F.lit("Brand").alias("label"), F.col("p_brand").alias("name"), F.lit("title").alias("prop"), F.col("p_name").alias("value"), F.col("p_partkey").alias("seq"))
    return graph.longest_properties(rows).select("name", "value")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1", families=False)
def edge_last_writer(s: Star) -> DataFrame:
    rows = s.table("events").select("user_id", "event_type", "event_id", "value", F.struct("ts", "event_id").alias("at"))
    return graph.last_writer(rows, ["user_id", "event_type"], "at").drop("at")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1", families=False)
def node_first_writer(s: Star) -> DataFrame:
    rows = s.table("events").select("user_id", "event_type", "event_id", "value", F.struct("ts", "event_id").alias("at"))
    return graph.first_writer(rows, ["user_id", "event_type"], "at").drop("at")


# --- questions


#: The star graph's own questions.
STAR_INTENTS = {"supplier_to_part": ("SUPPLIES", "Supplier", "Part", False), "part_to_supplier": ("SUPPLIES", "Part", "Supplier", True)}


@query(f"""SELECT answer, score, key FROM (SELECT tail AS answer, round(score, 6) AS score, head AS key FROM scored WHERE contains(lower(head), lower('{SUPPLIER}')))
    ORDER BY score DESC NULLS FIRST, answer, key LIMIT 10""")
def qa_topk(s: Star) -> DataFrame:
    return qa.answers(_graph(s), "supplier_to_part", SUPPLIER, 10, intents=STAR_INTENTS).select("answer", "score", "key")


@query(f"""SELECT answer, score, key FROM (SELECT head AS answer, round(score, 6) AS score, tail AS key FROM scored WHERE contains(lower(tail), '{PART_WORDS}'))
    ORDER BY score DESC NULLS FIRST, answer, key LIMIT 10""")
def qa_topk_reverse(s: Star) -> DataFrame:
    return qa.answers(_graph(s), "part_to_supplier", PART_WORDS, 10, intents=STAR_INTENTS).select("answer", "score", "key")


@query("""SELECT name, label, match_type, name_len FROM (SELECT name, label, CASE WHEN lower(name) = 'brand#1' THEN 0 ELSE 1 END AS match_type, length(name) AS name_len FROM (
    SELECT p_name || '#' || p_partkey AS name, 'Part' AS label, p_brand AS alias FROM part UNION ALL SELECT s_name, 'Supplier', NULL FROM supplier UNION ALL SELECT c_name, 'Customer', NULL FROM customer)
    WHERE contains(lower(name), 'brand#1') OR coalesce(contains(lower(alias), 'brand#1'), false)) ORDER BY match_type, name_len, name, label LIMIT 10""", families=False)
def entity_search(s: Star) -> DataFrame:
    return graph.Graph(_nodes(s), _nodes(s).limit(0)).search("Brand#1").select("name", "label", F.col("match_type").cast("long").alias("match_type"), F.col("name_len").cast("long").alias("name_len"))


_CALLED = """called AS (SELECT p_name || '#' || p_partkey AS name, 'Part' AS label, p_brand AS alias FROM part UNION ALL SELECT s_name, 'Supplier', NULL FROM supplier UNION ALL SELECT c_name, 'Customer', NULL FROM customer),
    asked AS (SELECT p_brand AS asked FROM part UNION SELECT p_name FROM part UNION SELECT p_name || '#' || p_partkey FROM part WHERE p_size = 1 UNION SELECT right(s_name, 4) FROM supplier UNION SELECT substr(c_mktsegment, 1, 2) FROM customer)"""


@query(f"""WITH {_CALLED} SELECT asked, name, label, match_type, name_len FROM (
    SELECT asked, name, label, CASE WHEN lower(name) = lower(asked) THEN 0 ELSE 1 END AS match_type, length(name) AS name_len,
      row_number() OVER (PARTITION BY asked ORDER BY CASE WHEN lower(name) = lower(asked) THEN 0 ELSE 1 END, length(name), name, label) AS r
    FROM asked JOIN called ON contains(lower(name), lower(asked)) OR coalesce(contains(lower(alias), lower(asked)), false)) WHERE r <= 10""", families=False)
def entity_search_index(s: Star) -> DataFrame:
    """Batch search in a stored gram index of two segments: the ranked top ten of each question, as a scan of all nodes gives them."""
    index = search_index.SearchIndex(s.spark, f"{shared_folder(s.spark).rstrip('/')}/trellis-index-{uuid.uuid4().hex}")
    index.add(_nodes(s).filter("label <> 'Customer'"))
    index.add(_nodes(s).filter("label = 'Customer'"))
    part = s.table("part")
    asked = part.select("p_brand").union(part.select("p_name")).union(s.parts().filter("p_size = 1").select("part")).union(s.table("supplier").select(F.expr("right(s_name, 4)"))).union(s.table("customer").select(F.substring("c_mktsegment", 1, 2)))
    return index.search_batch(asked.toDF("asked")).select("asked", "name", "label", F.col("match_type").cast("long").alias("match_type"), F.col("name_len").cast("long").alias("name_len"))


@query("""SELECT head AS entity, string_agg(tail, '|' ORDER BY r) AS predicted FROM (
    SELECT head, tail, row_number() OVER (PARTITION BY head ORDER BY round(score, 6) DESC NULLS FIRST, tail) AS r FROM scored) WHERE r <= 3 GROUP BY head""")
def ask_batch_topk(s: Star) -> DataFrame:
    questions = s.table("supplier").select(F.col("s_name").alias("question_id"), F.lit("supplier_to_part").alias("intent"), F.col("s_name").alias("entity"))
    return qa.ask_batch(_graph(s), questions, 3, intents=STAR_INTENTS).filter(F.size("predicted") > 0).select("entity", F.array_join("predicted", "|").alias("predicted"))


@query(f"""SELECT name AS answer, 'Part' AS label FROM (SELECT p_name || '#' || p_partkey AS name FROM part) WHERE contains(lower(name), '{PART_WORDS}') ORDER BY length(name), name LIMIT 1""", families=False)
def entity_definition(s: Star) -> DataFrame:
    return qa.answers(graph.Graph(_nodes(s), _nodes(s).limit(0)), "entity_definition", PART_WORDS).select("answer", "label")


@query("SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) AS node_count, (SELECT count(*) FROM fused) AS relationship_count")
def graph_stats(s: Star) -> DataFrame:
    return _graph(s).stats()


@query("""SELECT 'label' AS kind, 'Part' AS name, count(*) AS n FROM part UNION ALL SELECT 'label', 'Supplier', count(*) FROM supplier UNION ALL SELECT 'label', 'Customer', count(*) FROM customer
    UNION ALL SELECT 'relation', 'SUPPLIES', count(*) FROM fused""")
def graph_catalog(s: Star) -> DataFrame:
    return _graph(s).catalog()


@query("SELECT head, tail, round(score, 6) AS score FROM scored WHERE head IN (SELECT s_name FROM supplier WHERE s_acctbal > 0) AND tail IN (SELECT p_name || '#' || p_partkey FROM part WHERE p_size > 25)")
def drawable_edges(s: Star) -> DataFrame:
    names = s.table("supplier").filter("s_acctbal > 0").select(F.col("s_name").alias("name")).union(s.parts().filter("p_size > 25").select("part"))
    rows = graph.Graph(names, _edges(s)).drawable_edges()
    return rows.select(F.col("src").alias("head"), F.col("dst").alias("tail"), F.col("edge_score").alias("score"))


@query("""WITH given AS (SELECT c_name AS head, 'LIVES' AS relation, n_name AS tail, c_custkey AS seq FROM customer JOIN nation ON c_nationkey = n_nationkey
      UNION ALL SELECT c_name, 'TREATS', c_mktsegment, c_custkey + 1000000 FROM customer UNION ALL SELECT c_name, 'VISITS', n_name, c_custkey + 2000000 FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT CASE relation WHEN 'TREATS' THEN 'Drug' ELSE 'Entity' END AS src_label, head AS src, CASE relation WHEN 'TREATS' THEN 'TREATS' ELSE 'RELATED_TO' END AS rel_type,
      tail AS dst, lower(relation) AS source FROM given WHERE relation <> 'LIVES'""", families=False)
def graph_upsert(s: Star) -> DataFrame:
    """Edges after two loads of the same triples: relations without a type of their own share one edge, and its last writer wins."""
    customer = s.table("customer").join(s.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    triple = lambda relation, tail, shift: customer.select(
        F.col("c_name").alias("head"), F.lit(relation).alias("relation"), F.col(tail).alias("tail"), F.array(F.lit(relation.lower())).alias("sources"), F.lit(1.0).alias("confidence"), F.lit(1).alias("frequency"),
        F.lit(0.5).alias("edge_score"), F.lit(False).alias("conflict"), (F.col("c_custkey") + shift).alias("seq"),
    )
    rows = triple("LIVES", "n_name", 0).union(triple("TREATS", "c_mktsegment", 1_000_000)).union(triple("VISITS", "n_name", 2_000_000))
    empty = graph.Graph(s.spark.createDataFrame([], NODES), s.spark.createDataFrame([], EDGES))
    return empty.upsert_triples(rows).upsert_triples(rows).edges.select("src_label", "src", "rel_type", "dst", "source")


# --- rules

_STAR_RULE = """SELECT DISTINCT l.tail AS head, o.tail AS tail FROM located l JOIN ordered o ON l.head = o.head
    WHERE NOT EXISTS (SELECT 1 FROM based b JOIN supplies x ON b.head = x.head WHERE b.tail = l.tail AND x.tail = o.tail)"""


def _located(s: Star, relation: str) -> DataFrame:
    return pairs(s.dimensions().filter(F.col("relation") == relation))


@query(_STAR_RULE)
def rule_star_anti(s: Star) -> DataFrame:
    """A nation consumes a part that its customers ordered, unless a supplier of the nation has it."""
    existing = _located(s, "BASED_IN").withColumnRenamed("src", "via").join(pairs(s.supplies()).withColumnRenamed("src", "via").withColumnRenamed("dst", "part"), "via").select(F.col("dst").alias("src"), F.col("part").alias("dst")).distinct()
    return rules.star(pairs(s.ordered()), _located(s, "LOCATED_IN"), existing, distinct=True)


_RELATED = f"""related AS (SELECT a.head AS head, b.head AS tail, count(*) AS evidence_count FROM (SELECT DISTINCT head, tail FROM ordered) a
    JOIN (SELECT DISTINCT head, tail FROM ordered) b ON a.tail = b.tail AND a.head < b.head GROUP BY 1, 2 HAVING count(*) >= {SHARED_PARTS})"""


def _related(s: Star) -> DataFrame:
    """Customers that ordered the same parts: counted by keys, named at the end."""
    keys, names = s.ordered_keys()
    rows = rules.cooccurrence(keys, SHARED_PARTS)
    for end in ("head", "tail"):
        rows = rows.join(names.select(F.col("src").alias(end), F.col("name").alias(f"{end}_name")), end)
    return rows.select(F.least("head_name", "tail_name").alias("head"), F.greatest("head_name", "tail_name").alias("tail"), "evidence_count")


@query(f"WITH {_RELATED} SELECT * FROM related")
def rule_cooccurrence(s: Star) -> DataFrame:
    return _related(s)


@query("""SELECT DISTINCT o.head AS head, b.tail AS tail FROM ordered o JOIN branded b ON o.tail = b.head
    WHERE NOT EXISTS (SELECT 1 FROM ordered r JOIN branded x ON r.tail = x.head WHERE r.l_returnflag = 'R' AND r.head = o.head AND x.tail = b.tail)""")
def rule_chain(s: Star) -> DataFrame:
    brands, ordered = _located(s, "HAS_BRAND"), s.ordered()
    returned = pairs(ordered.filter("l_returnflag = 'R'")).withColumnRenamed("dst", "via").join(brands.withColumnRenamed("src", "via"), "via").select("src", "dst").distinct()
    return rules.chain(pairs(ordered), brands, returned).select("head", "tail").distinct()


@query(f"""WITH {_RELATED}, returned AS (SELECT DISTINCT tail AS head, head AS tail FROM ordered WHERE l_returnflag = 'R'),
    ways AS (SELECT head, tail FROM related UNION ALL SELECT tail, head FROM related)
    SELECT DISTINCT r.head AS head, b.tail AS tail FROM returned r JOIN ways b ON r.tail = b.head WHERE NOT EXISTS (SELECT 1 FROM returned x WHERE x.head = r.head AND x.tail = b.tail)""")
def rule_undirected(s: Star) -> DataFrame:
    # both are read several times: for hubs, and for either side of a join
    related = stored(_related(s).select(F.col("head").alias("src"), F.col("tail").alias("dst")), "related")
    returned = stored(pairs(s.ordered().filter("l_returnflag = 'R'")).select(F.col("dst").alias("src"), F.col("src").alias("dst")), "returned")
    return rules.propagation(returned, related, returned).select("head", "tail").distinct()


@query(f"""WITH {_RELATED}, center AS (SELECT min(head) AS name FROM related)
    SELECT DISTINCT * FROM ((SELECT tail AS answer, evidence_count / 100.0 AS score FROM related, center WHERE head = name ORDER BY score DESC, answer LIMIT 5)
    UNION (SELECT head AS answer, evidence_count / 100.0 AS score FROM related, center WHERE tail = name ORDER BY score DESC, answer LIMIT 5))""")
def inferred_topk_union(s: Star) -> DataFrame:
    rows = _related(s).select(F.col("head").alias("src"), F.col("tail").alias("dst"), F.lit("INFERRED").alias("rel_type"), F.lit("RELATED").alias("relation_type"), (F.col("evidence_count") / 100).alias("confidence"), F.lit("r2").alias("rule_id"), F.lit(None).cast("string").alias("via"))
    rows = stored(rows, "inferred")  # read three times: for the entity, and for its edges either way
    name = rows.agg(F.min("src")).first()[0] or ""
    return rules.inferred_for(graph.Graph(rows, rows), name, 5).select("answer", "score")


@query(f"""WITH {_RELATED}, per_rule AS (SELECT evidence_count % 3 AS rule_order, count(*) AS n FROM related GROUP BY 1),
    running AS (SELECT *, coalesce(sum(n) OVER (ORDER BY rule_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM per_rule)
    SELECT rule_order, n FROM running WHERE before < 1000""")
def inference_cap(s: Star) -> DataFrame:
    rows = _related(s).withColumn("rule_order", F.col("evidence_count") % 3)
    return rules.capped(rows, 1000).groupBy("rule_order").agg(F.count("*").alias("n"))


# --- versions


def _event_triples(s: Star) -> DataFrame:
    """Events as versioned edges: user, event type, and the key in props."""
    key = F.get_json_object("props", "$.k")
    return s.table("events").select(F.concat(F.lit("user"), "user_id").alias("head"), F.upper("event_type").alias("relation"), F.concat(F.lit("k"), key).alias("tail"), "ts", "event_id", F.struct("ts", "event_id").alias("seq"))


_EVENT_SQL = """edge AS (SELECT 'user' || user_id AS head, upper(event_type) AS relation, 'k' || json_extract_string(props, '$.k') AS tail, ts, event_id, event_id % 20 AS change_id FROM events),
    versioned AS (SELECT *, row_number() OVER (PARTITION BY head, relation, tail ORDER BY ts, event_id) AS revision FROM edge)"""


def _versioned(s: Star) -> versioning.VersionedGraph:
    rows = versioning.next_revisions(_event_triples(s), s.spark.createDataFrame([], "src string, rel_type string, dst string, revision int")).withColumn("change_id", (F.col("event_id") % 20).cast("string"))
    edges = rows.select(F.lit("User").alias("src_label"), F.col("head").alias("src"), F.col("relation").alias("rel_type"), F.lit("Key").alias("dst_label"), F.col("tail").alias("dst"), "change_id", "revision", F.lit(True).alias("active"), F.col("ts").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    events = rows.select("change_id", F.col("ts").alias("timestamp"), F.lit("CREATE").alias("action"), "head", "relation", "tail", "revision", F.lit(None).cast("boolean").alias("rolled_back"))
    sets = rows.groupBy("change_id").agg(F.min("ts").alias("created_at"))
    # one changeset without events
    sets = sets.union(s.spark.sql("select '99' as change_id, timestamp '2000-01-01 00:00:00' as created_at"))
    sets = sets.select("change_id", F.lit("ops").alias("actor"), F.lit("load").alias("reason"), F.lit("events").alias("source"), "created_at", F.lit("active").alias("status"), F.lit(None).cast("timestamp").alias("rolled_back_at"))
    nodes = rows.select("head").distinct().select(F.lit("User").alias("label"), F.col("head").alias("name")).union(s.spark.sql("select 'User', 'user-none'"))
    return versioning.VersionedGraph(graph.Graph(nodes, edges), sets, events)


@query(f"WITH {_EVENT_SQL} SELECT event_id, head, relation, tail, revision FROM versioned", families=False)
def revision_numbering(s: Star) -> DataFrame:
    rows = versioning.next_revisions(_event_triples(s), s.spark.createDataFrame([], "src string, rel_type string, dst string, revision int"))
    return rows.select("event_id", "head", "relation", "tail", F.col("revision").cast("long").alias("revision"))


@query(f"""WITH {_EVENT_SQL} SELECT CAST(change_id AS VARCHAR) AS change_id, 'active' AS status, count(*) AS event_count FROM versioned GROUP BY 1 UNION ALL SELECT '99', 'active', 0""", families=False)
def changeset_list(s: Star) -> DataFrame:
    return _versioned(s).list_changesets().select("change_id", "status", "event_count")


@query(f"WITH {_EVENT_SQL} SELECT head, relation, tail, revision, ts AS timestamp FROM versioned WHERE change_id = 7", families=False)
def audit_events(s: Star) -> DataFrame:
    return _versioned(s).audit_events("7").select("head", "relation", "tail", F.col("revision").cast("long").alias("revision"), "timestamp")


@query(f"WITH {_EVENT_SQL} SELECT CAST(change_id AS VARCHAR) AS change_id, relation, revision, ts AS valid_from FROM versioned WHERE head = 'user3'", families=False)
def entity_history(s: Star) -> DataFrame:
    return _versioned(s).history("user3").select("change_id", "relation", F.col("revision").cast("long").alias("revision"), "valid_from")


@query("SELECT CAST(NULL AS VARCHAR) AS change_id, CAST(NULL AS VARCHAR) AS relation", families=False)
def entity_history_empty(s: Star) -> DataFrame:
    return _versioned(s).history("user-none").select("change_id", "relation")


@query(f"WITH {_EVENT_SQL} SELECT head, relation, count(*) FILTER (change_id = 7) AS inactive, count(*) AS n FROM versioned GROUP BY 1, 2", families=False)
def rollback_effect(s: Star) -> DataFrame:
    _, after = _versioned(s).rollback("7")
    rows = after.graph.edges.groupBy(F.col("src").alias("head"), F.col("rel_type").alias("relation"))
    return rows.agg(F.count_if(~F.col("active")).alias("inactive"), F.count("*").alias("n"))


@query(f"""WITH {_EVENT_SQL} SELECT head, relation, tail, max(revision) AS revision FROM versioned WHERE ts <= TIMESTAMP '2024-01-20 06:00:00' AND change_id <> 7 GROUP BY 1, 2, 3""", families=False)
def graph_as_of(s: Star) -> DataFrame:
    """The graph at a time after the rollback of one changeset: the last revision that is valid then."""
    _, after = _versioned(s).rollback("7", "2024-01-15 00:00:00")
    rows = after.as_of("2024-01-20 06:00:00").edges
    # edges that the changeset made after its rollback had begun when they had ended, and never are valid
    return rows.select(F.col("src").alias("head"), F.col("rel_type").alias("relation"), F.col("dst").alias("tail"), F.col("revision").cast("long").alias("revision"))


_INTERVALS = "spans AS (SELECT head, relation, tail, revision, ts, lead(ts) OVER (PARTITION BY head, relation, tail ORDER BY ts, event_id) AS until FROM versioned)"


def _intervals(s: Star) -> DataFrame:
    """Versioned edges with the time until which each revision is valid."""
    rows = _versioned(s).graph.edges
    until = F.lead("valid_from").over(Window.partitionBy("src", "rel_type", "dst").orderBy("revision"))
    return rows.select(F.col("src").alias("head"), F.col("rel_type").alias("relation"), F.col("dst").alias("tail"), "revision", "valid_from", until.alias("valid_to"))


@query(f"""WITH {_EVENT_SQL}, {_INTERVALS} SELECT a.head, a.relation, a.tail AS tail_1, a.revision AS revision_1, b.tail AS tail_2, b.revision AS revision_2 FROM spans a JOIN spans b ON a.head = b.head AND a.relation = b.relation AND a.tail < b.tail
    WHERE a.ts < coalesce(b.until, TIMESTAMP '9999-01-01') AND b.ts < coalesce(a.until, TIMESTAMP '9999-01-01')""", families=False)
def edges_overlapping(s: Star) -> DataFrame:
    """Revisions of different edges of one user and relation that were valid at once."""
    spans = stored(_intervals(s), "intervals")  # read six times: for the blocks, and as either side of two joins
    rows = temporal.overlapping(spans, spans, ["head", "relation"]).filter("l.tail < r.tail")
    return rows.select("head", "relation", F.col("l.tail").alias("tail_1"), F.col("l.revision").cast("long").alias("revision_1"), F.col("r.tail").alias("tail_2"), F.col("r.revision").cast("long").alias("revision_2"))


@query("""WITH views AS (SELECT user_id, event_id AS view_id, ts AS viewed FROM events WHERE event_type = 'view')
    SELECT event_id, e.user_id AS user_id, view_id FROM (SELECT * FROM events WHERE event_type <> 'view') e ASOF LEFT JOIN views v ON e.user_id = v.user_id AND e.ts >= v.viewed""", families=False)
def last_view_before(s: Star) -> DataFrame:
    """Each event with its user's last view before it."""
    events = s.table("events").select("event_id", "user_id", "event_type", "ts")
    views = events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("viewed"), F.col("event_id").alias("view_id"))
    rows = temporal.last_before(events.filter("event_type <> 'view'"), views, ["user_id"], "ts", "viewed")
    return rows.select("event_id", "user_id", F.col("found.view_id").alias("view_id"))


def _stored_triples(s: Star, part: str, confidence: float) -> DataFrame:
    """Customers' segments and nations as fused triples."""
    customer = s.table("customer").join(s.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).filter(part)
    triple = lambda relation, tail, shift: customer.select(
        F.col("c_name").alias("head"), F.lit(relation).alias("relation"), F.col(tail).alias("tail"), F.array(F.lit("crm")).alias("sources"), F.lit(confidence).alias("confidence"), F.lit(1).alias("frequency"),
        F.lit(0.5).alias("edge_score"), F.lit(False).alias("conflict"), (F.col("c_custkey") + shift).alias("seq"),
    )
    return triple("TREATS", "c_mktsegment", 0).union(triple("HAS_SYMPTOM", "n_name", 1_000_000))


@query("""SELECT src_label, src, rel_type, dst, CASE WHEN c_custkey % 50 = 7 THEN 0.9 ELSE 0.4 END AS confidence, 3 AS versions, old FROM (
    SELECT c_custkey, 'Drug' AS src_label, c_name AS src, 'TREATS' AS rel_type, c_mktsegment AS dst, 0.4 AS old FROM customer UNION ALL SELECT c_custkey, 'Disease', c_name, 'HAS_SYMPTOM', n_name, 0.4 FROM customer JOIN nation ON c_nationkey = n_nationkey)""", families=False)
def graph_store_merge(s: Star) -> DataFrame:
    """A graph in a store: loaded, then some customers' edges merged into what was read from it; beside each edge its confidence in the version before."""
    store = GraphStore.create(s.spark, f"{shared_folder(s.spark).rstrip('/')}/trellis-store-{uuid.uuid4().hex}", buckets=16)
    store.merge(_stored_triples(s, "true", 0.4))
    store.merge(_stored_triples(s, "c_custkey % 50 = 7", 0.9))
    keys = ["src_label", "src", "rel_type", "dst"]
    old = store.read(1).edges.select(*keys, F.col("confidence").alias("old"))
    return store.read().edges.join(old, keys, "left").select(*keys, "confidence", F.lit(len(store.versions())).alias("versions"), "old")


# --- evaluation

_RESULTS = """answers AS (SELECT o_orderkey, list(DISTINCT p_brand ORDER BY p_brand) AS gold, list(DISTINCT p_brand ORDER BY p_brand) FILTER (l_returnflag <> 'R') AS predicted
      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey),
    results AS (SELECT a.o_orderkey AS question, o_orderpriority AS intent, gold, coalesce(predicted, []) AS predicted, o_orderstatus <> 'P' AS executable, CAST(floor(o_totalprice) AS BIGINT) % 997 AS latency_ms,
      len(list_intersect(gold, coalesce(predicted, []))) AS common FROM answers a JOIN orders USING (o_orderkey)),
    metrics AS (SELECT *, CASE WHEN len(predicted) = 0 THEN 0.0 ELSE common / len(predicted) END AS "precision", common / len(gold) AS recall,
      CASE WHEN common = 0 THEN 0.0 ELSE 2.0 * common / (len(predicted) + len(gold)) END AS f1, len(predicted) > 0 AND list_contains(gold, predicted[1]) AS exact_match FROM results)"""


def _results(s: Star) -> DataFrame:
    """Orders as evaluated questions: gold brands, and those of lines that were kept as answers."""
    lines = s.table("lineitem").select("l_orderkey", "l_partkey", "l_returnflag").join(s.table("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    sets = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set("p_brand")).alias("gold_answers"), F.sort_array(F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("p_brand")))).alias("predicted"))
    rows = sets.join(s.table("orders"), "o_orderkey")
    rows = rows.select(F.col("o_orderkey").alias("question"), F.col("o_orderpriority").alias("intent"), "gold_answers", "predicted", (F.col("o_orderstatus") != "P").alias("executable"), (F.floor("o_totalprice") % 997).alias("latency_ms"))
    return evaluate.with_set_metrics(rows)


@query(f'WITH {_RESULTS} SELECT question, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM metrics', families=False)
def set_metrics(s: Star) -> DataFrame:
    return _results(s).select("question", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"WITH {_RESULTS} SELECT question, exact_match FROM metrics", families=False)
def accuracy_at_1(s: Star) -> DataFrame:
    return _results(s).select("question", "exact_match")


@query(f"""WITH {_RESULTS} SELECT count(*) AS total_samples, count(*) FILTER (executable) AS executable_count, round(avg(CAST(executable AS DOUBLE)), 6) AS executable_rate, round(avg(CAST(exact_match AS DOUBLE)), 6) AS accuracy_at_1,
    round(avg("precision"), 6) AS avg_precision, round(avg(recall), 6) AS avg_recall, round(avg(f1), 6) AS avg_f1, round(avg(CAST(executable AND len(predicted) > 0 AS DOUBLE)), 6) AS coverage FROM metrics""", families=False)
def eval_overall(s: Star) -> DataFrame:
    rows = evaluate.overall(_results(s))
    return rows.select("total_samples", "executable_count", *(F.round(c, 6).alias(c) for c in rows.columns[2:]))


@query(f"""WITH {_RESULTS} SELECT intent, count(*) AS total, round(avg(CAST(executable AS DOUBLE)), 6) AS executable_rate, round(avg(CAST(executable AND len(predicted) > 0 AS DOUBLE)), 6) AS coverage,
    round(avg(f1), 6) AS avg_f1, round(avg(CAST(exact_match AS DOUBLE)), 6) AS accuracy_at_1 FROM metrics GROUP BY intent""", families=False)
def eval_per_intent(s: Star) -> DataFrame:
    rows = evaluate.per_intent(_results(s))
    return rows.select("intent", "total", *(F.round(c, 6).alias(c) for c in rows.columns[2:]))


@query(f"""WITH {_RESULTS}, ranked AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS i, count(*) OVER () AS n FROM metrics)
    SELECT max(latency_ms) FILTER (i = floor(n * 0.5)) AS latency_p50, max(latency_ms) FILTER (i = least(floor(n * 0.95), n - 1)) AS latency_p95 FROM ranked""", families=False)
def latency_index_percentiles(s: Star) -> DataFrame:
    return evaluate.latency_percentiles(_results(s))


_TOTALS = """count(*) AS total, count(*) FILTER (executable) AS executable_count, round(avg(CAST(executable AS DOUBLE)), 6) AS executable_rate, round(avg(CAST(exact_match AS DOUBLE)), 6) AS accuracy_at_1,
    round(avg("precision"), 6) AS avg_precision, round(avg(recall), 6) AS avg_recall, round(avg(f1), 6) AS avg_f1, round(avg(CAST(executable AND len(predicted) > 0 AS DOUBLE)), 6) AS coverage"""


@query(f"""WITH {_RESULTS} SELECT grouping(intent) = 0 AS by_intent, grouping(executable) = 0 AS by_executable, intent, executable, {_TOTALS} FROM metrics
    GROUP BY GROUPING SETS ((), (intent), (executable), (intent, executable))""", families=False)
def eval_cube(s: Star) -> DataFrame:
    """All totals of an evaluation in one pass."""
    rows = evaluate.cube(_results(s))
    return rows.select("by_intent", "by_executable", "intent", "executable", "total", "executable_count", *(F.round(c, 6).alias(c) for c in rows.columns if c[:4] == "avg_" or c in ("executable_rate", "accuracy_at_1", "coverage")))


_SKETCH_BASE = (1 + evaluate.SKETCH_ERROR) / (1 - evaluate.SKETCH_ERROR)


@query(f"""WITH {_RESULTS}, ranked AS (SELECT intent, latency_ms, row_number() OVER (PARTITION BY intent ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY intent) AS n FROM metrics),
    found AS (SELECT intent, max(n) AS n, max(latency_ms) FILTER (i = floor(n * 0.5)) AS p50, max(latency_ms) FILTER (i = least(floor(n * 0.95), n - 1)) AS p95 FROM ranked GROUP BY intent)
    SELECT intent, n, round(CASE WHEN p50 < 1 THEN 0 ELSE pow({_SKETCH_BASE!r}, floor(ln(p50) / ln({_SKETCH_BASE!r}))) * 2 * {_SKETCH_BASE!r} / (1 + {_SKETCH_BASE!r}) END, 4) AS latency_p50,
      round(CASE WHEN p95 < 1 THEN 0 ELSE pow({_SKETCH_BASE!r}, floor(ln(p95) / ln({_SKETCH_BASE!r}))) * 2 * {_SKETCH_BASE!r} / (1 + {_SKETCH_BASE!r}) END, 4) AS latency_p95, true AS distinct_near FROM found""", families=False)
def latency_sketch(s: Star) -> DataFrame:
    """Percentiles and distinct questions of each intent from sketches of finer groups that are merged: values within one hundredth of the exact ones."""
    fine = evaluate.latency_sketches(_results(s), ["intent", "executable"])
    rows = evaluate.sketched(evaluate.merged_sketches(fine, ["intent"]), {"latency_p50": 0.5, "latency_p95": 0.95})
    return rows.select("intent", "n", F.round("latency_p50", 4).alias("latency_p50"), F.round("latency_p95", 4).alias("latency_p95"), (F.abs(F.col("distinct") - F.col("n")) <= 0.07 * F.col("n")).alias("distinct_near"))


@query(f"WITH {_RESULTS} SELECT question, executable FROM metrics WHERE NOT executable OR len(predicted) = 0", families=False)
def failed_samples(s: Star) -> DataFrame:
    return evaluate.failed(_results(s)).select("question", "executable")


@query(f"WITH {_RESULTS} SELECT question, latency_ms FROM metrics ORDER BY latency_ms DESC, question LIMIT 10", families=False)
def slowest_samples(s: Star) -> DataFrame:
    return evaluate.slowest(_results(s)).select("question", "latency_ms")


# --- text and conversion


@query("""SELECT head, relation, tail FROM (SELECT c_name AS head, 'PROP_DESC' AS relation, c_mktsegment AS tail FROM customer UNION ALL SELECT c_name, 'PROP_COST_MONEY', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 3 <> 0)""", families=False)
def unpivot_properties(s: Star) -> DataFrame:
    rows = s.table("customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("desc"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey").cast("string")).otherwise("  ").alias("cost_money"), F.col("c_custkey").alias("seq"))
    return convert.wide_triples(rows).select("head", "relation", "tail")


@query("SELECT head, 'COMMON_DRUG' AS relation, tail FROM (SELECT s_name AS head, unnest(['x' || s_nationkey, 'y', 'z' || s_suppkey % 2]) AS tail FROM supplier)", families=False)
def explode_multivalue(s: Star) -> DataFrame:
    rows = s.table("supplier").select(F.col("s_name").alias("entity"), F.lit(" 常用药品 ").alias("predicate"), F.concat(F.lit("x"), "s_nationkey", F.lit(" y \t z"), F.col("s_suppkey") % 2).alias("value"), F.col("s_suppkey").alias("seq"))
    return convert.eav_triples(rows).select("head", "relation", "tail")


@query("SELECT p_partkey, p_name AS name, CASE WHEN p_size % 4 = 0 THEN 'Disease' ELSE 'Entity' END AS type FROM part", families=False)
def typed_name_parse(s: Star) -> DataFrame:
    kind = F.when(F.col("p_size") % 4 == 0, "[疾病]").when(F.col("p_size") % 4 == 1, "[?]").otherwise("")
    rows = s.table("part").select("p_partkey", text.typed_name(F.concat(F.lit(" "), "p_name", kind, F.lit("\t"))).alias("t"))
    return rows.select("p_partkey", "t.name", "t.type")


@query("SELECT p_partkey, lower(p_name) AS name, lower(p_brand) || '|' || lower(p_type) AS aliases FROM part", families=False)
def alias_brackets(s: Star) -> DataFrame:
    name = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")（"), "p_type", F.lit("）"))
    return s.table("part").select("p_partkey", text.normalize_folded(text.main_name(name)).alias("name"), F.array_join(F.transform(text.bracketed(name), text.normalize_folded), "|").alias("aliases"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT lower(s_name) AS a, 'g' || s_suppkey % 7 || '.' || s_suppkey // 40 AS b FROM supplier),
    link AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e),
    reach AS (SELECT a AS name, b AS other FROM link UNION SELECT r.name, l.b FROM reach r JOIN link l ON r.other = l.a)
    SELECT name, arg_min(other, (length(other), other)) AS canonical FROM reach GROUP BY name""", families=False)
def alias_components(s: Star) -> DataFrame:
    alias = F.concat(F.lit("G"), F.col("s_suppkey") % 7, F.lit("."), F.floor(F.col("s_suppkey") / 40))
    return linking.canonical_names(s.table("supplier").select(F.concat("s_name", F.lit(" ("), alias, F.lit(")")).alias("name")))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT lower(s_name) AS a, 'g' || s_suppkey % 7 || '.' || s_suppkey // 40 AS b FROM supplier UNION SELECT 'g' || k || '.0', 'g' || k || '.1' FROM (SELECT unnest([1, 3]) AS k)),
    link AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e),
    reach AS (SELECT a AS name, b AS other FROM link UNION SELECT r.name, l.b FROM reach r JOIN link l ON r.other = l.a)
    SELECT name AS node, min(other) AS component FROM reach GROUP BY name""", families=False)
def alias_components_incremental(s: Star) -> DataFrame:
    """Components of aliases that come in three batches, the last of which joins groups of the first ones."""
    alias = F.concat(F.lit("G"), F.col("s_suppkey") % 7, F.lit("."), F.floor(F.col("s_suppkey") / 40))
    names = s.table("supplier").select("s_suppkey", F.concat("s_name", F.lit(" ("), alias, F.lit(")")).alias("name"))
    made = components.Components.of(linking.alias_edges(names.filter("s_suppkey % 3 > 0")))
    made = made.add(linking.alias_edges(names.filter("s_suppkey % 3 = 0")))
    late = s.spark.range(1).select(F.explode(F.array(F.lit(1), F.lit(3))).alias("k")).select(F.concat(F.lit("g"), "k", F.lit(".0")).alias("src"), F.concat(F.lit("g"), "k", F.lit(".1")).alias("dst"))
    return made.add(late).table()


@query(r"""SELECT doc_id, trim(regexp_replace(lower(regexp_replace(text, '[^\t-\r -~]', '', 'g')), '[\t-\r ]+', ' ', 'g')) AS name FROM documents""", families=False)
def normalize_ascii(s: Star) -> DataFrame:
    rows = s.table("documents").select("doc_id", F.regexp_replace("text", r"[^\t-\r -~]", "").alias("t"))
    return rows.select("doc_id", text.fold_blanks(F.lower("t")).alias("name"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", families=False)
def json_props(s: Star) -> DataFrame:
    return s.table("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events), m AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id, event_type ORDER BY pos) AS g FROM o)
    SELECT user_id AS key, min(pos) AS start, max(pos) AS "end", event_type AS type FROM m GROUP BY user_id, event_type, g""", families=False)
def bio_islands(s: Star) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = s.table("events").select(F.col("user_id").alias("key"), at.cast("long").alias("pos"), F.concat(F.lit("I-"), "event_type").alias("label"))
    return labels.bio_spans(rows)


#: Two labels' names. No end of a name begins another of its label, so SQL's one scan, the longest name first, finds the same spans.
DICTIONARY = {"Article": ["the", "la", "der"], "Join": ["and", "und", "y", "the th"]}
_WORDS = "the th|the|der|and|und|la|y"
_SPANS_SQL = f"""SELECT doc_id, CAST(len(found) AS INTEGER) AS n, array_to_string(found, '|') AS names, length(text) - length(rest[-1]) AS last_end FROM (
    SELECT doc_id, text, regexp_extract_all(text, '{_WORDS}') AS found, string_split_regex(text, '{_WORDS}') AS rest FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))"""


def _spans(rows: DataFrame) -> DataFrame:
    end = F.coalesce(F.get("spans", F.size("spans") - 1)["end"], F.lit(0)).cast("long")
    return rows.select("doc_id", F.size("spans").alias("n"), F.array_join(F.transform("spans", lambda x: x["text"]), "|").alias("names"), end.alias("last_end"))


@query(_SPANS_SQL, families=False)
def dictionary_ner(s: Star) -> DataFrame:
    return _spans(s.table("documents").select("doc_id", extract.dictionary_spans(F.col("text"), DICTIONARY).alias("spans")))


@query(_SPANS_SQL, families=False)
def dictionary_join(s: Star) -> DataFrame:
    """The same search for a dictionary of any size, by a join."""
    words = s.spark.createDataFrame([(label, w) for label, names in DICTIONARY.items() for w in names], "label string, name string")
    return _spans(extract.joined_spans(s.table("documents").select("doc_id", "text"), words, "doc_id"))


_LINE_SPANS = """spans AS (SELECT l_orderkey AS key, l_partkey % 30 AS start, l_partkey % 30 + 1 + CAST(l_quantity AS BIGINT) % 8 AS stop, l_returnflag AS label,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 30, -(CAST(l_quantity AS BIGINT) % 8), l_returnflag, l_linenumber) AS i FROM lineitem)"""


def _line_spans(s: Star) -> DataFrame:
    """Orders as texts: each line a span of its part's place and its quantity's length, labelled by its flag."""
    start = (F.col("l_partkey") % 30).cast("int")
    stop = start + 1 + (F.col("l_quantity").cast("int") % 8)
    span = F.struct(F.col("l_returnflag").alias("text"), start.alias("start"), stop.alias("end"), F.col("l_returnflag").alias("label"), (start / 32).alias("score"))
    return s.table("lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.collect_list(span).alias("spans"))


@query(f"""WITH RECURSIVE {_LINE_SPANS}, kept AS (SELECT key, start, stop, label, i FROM spans WHERE i = 1
      UNION ALL SELECT * FROM (SELECT DISTINCT ON (s.key) s.key, s.start, s.stop, s.label, s.i FROM kept k JOIN spans s ON s.key = k.key AND s.i > k.i AND s.start >= k.stop ORDER BY s.key, s.i))
    SELECT key, start, stop, label FROM kept""", families=False)
def overlap_removal(s: Star) -> DataFrame:
    rows = _line_spans(s).select("key", F.explode(extract.remove_overlaps(F.col("spans"), [])).alias("s"))
    return rows.select("key", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("stop"), "s.label")


@query("""WITH RECURSIVE spans AS (SELECT l_orderkey AS key, l_partkey % 30 AS start, l_partkey % 30 + 1 + CAST(l_quantity AS BIGINT) % 8 AS stop, l_returnflag AS label, (l_partkey % 30) / 32 AS score,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 30, CAST(l_quantity AS BIGINT) % 8, l_returnflag, l_linenumber) AS i FROM lineitem),
    fold AS (SELECT key, i, label AS text, start, stop, label, score, 1 AS part FROM spans WHERE i = 1
      UNION ALL SELECT s.key, s.i, CASE WHEN near THEN f.text || s.label ELSE s.label END, CASE WHEN near THEN f.start ELSE s.start END, s.stop, s.label, CASE WHEN near THEN (f.score + s.score) / 2 ELSE s.score END,
        CASE WHEN near THEN part ELSE part + 1 END FROM (SELECT f.*, s.label = f.label AND s.start <= f.stop + 1 AS near FROM fold f JOIN spans s ON s.key = f.key AND s.i = f.i + 1) f JOIN spans s ON s.key = f.key AND s.i = f.i + 1)
    SELECT key, text, start, stop, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY key, part ORDER BY i DESC) AS r FROM fold) WHERE r = 1""", families=False)
def adjacent_merge(s: Star) -> DataFrame:
    order = F.array_sort("spans", lambda a, b: F.when((a["start"] == b["start"]) & (a["end"] == b["end"]), F.when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0)).when((a["start"] < b["start"]) | (a["start"] == b["start"]) & (a["end"] < b["end"]), -1).otherwise(1))
    rows = _line_spans(s).select("key", order.alias("spans")).select("key", F.explode(extract.merge_adjacent(F.col("spans"))).alias("s"))
    return rows.select("key", "s.text", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("stop"), F.round("s.score", 6).alias("score"))


@query("""WITH gold AS (SELECT DISTINCT l_orderkey, l_partkey % 30 AS a, l_returnflag AS t FROM lineitem), found AS (SELECT DISTINCT l_orderkey, l_partkey % 30 AS a, CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'R' END AS t FROM lineitem WHERE l_linenumber < 5),
    n AS (SELECT (SELECT count(*) FROM gold) AS g, (SELECT count(*) FROM found) AS p, (SELECT count(*) FROM gold JOIN found USING (l_orderkey, a, t)) AS c)
    SELECT round(c / p, 6) AS "precision", round(c / g, 6) AS recall, round(2.0 * c / (p + g), 6) AS f1 FROM n""", families=False)
def span_metrics(s: Star) -> DataFrame:
    at = (F.col("l_partkey") % 30).cast("int")
    lines = s.table("lineitem").select(F.col("l_orderkey").alias("key"), at.alias("start"), at.alias("end"), "l_returnflag", "l_linestatus", "l_linenumber")
    gold = lines.select("key", "start", "end", F.col("l_returnflag").alias("type"))
    found = lines.filter("l_linenumber < 5").select("key", "start", "end", F.when(F.col("l_linestatus") == "O", "N").otherwise("R").alias("type"))
    return labels.span_scores(gold, found).select(*(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"""SELECT doc_id, n, round(n * {extract.DICTIONARY_SCORE}, 6) AS score FROM (
    SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '(?:th|er|on)(?:(?s:.)?(?:th|er|on))*')) AS INTEGER) AS n FROM documents)""", families=False)
def span_merge(s: Star) -> DataFrame:
    rows = s.table("documents").select("doc_id", extract.merge_adjacent(extract.dictionary_spans(F.col("text"), {"Join": ["th", "er", "on"]})).alias("spans"))
    return rows.select("doc_id", F.size("spans").alias("n"), F.round(F.aggregate("spans", F.lit(0.0), lambda a, x: a + x["score"]), 6).alias("score"))


@query(_SPANS_SQL.replace("array_to_string(found, '|') AS names", "array_to_string(list_sort(found), '|') AS names"), families=False)
def extractor_function(s: Star) -> DataFrame:
    """Dictionary spans by a table function that SQL calls for each text."""
    extract.register_extractor(s.spark, "dictionary_spans_of", extract.dictionary_spans_of(DICTIONARY))
    docs = s.table("documents")
    # an outer lateral join would join texts with texts, each span carrying its own; texts without spans come by their ids instead
    rows = s.spark.sql("SELECT d.doc_id, x.span, x.end FROM {docs} d, LATERAL dictionary_spans_of(d.text, 'span, end') x", docs=docs)
    rows = rows.union(docs.select("doc_id", F.lit(None).cast("string"), F.lit(None).cast("int")))
    # a span's repeats are counted before they are listed
    names = rows.groupBy("doc_id", "span").agg(F.count("span").cast("int").alias("n"), F.max("end").alias("end"))
    listed = F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct("span", "n")))), lambda x: F.array_repeat(x["span"], x["n"])))
    return names.groupBy("doc_id").agg(F.sum("n").cast("int").alias("n"), F.array_join(listed, "|").alias("names"), F.coalesce(F.max("end"), F.lit(0)).cast("long").alias("last_end"))


def _rule_texts(s: Star) -> DataFrame:
    """Customers as nodes whose description is a text in words."""
    text = F.concat(F.lit("糖尿病的症状有"), "c_name", F.lit("、"), "c_mktsegment", F.lit("。"))
    return spread(s.table("customer").select("c_name", "c_mktsegment")).select(F.lit("Customer").alias("label"), F.col("c_name").alias("name"), F.create_map(F.lit("desc"), text).alias("props"))


def _pattern_sql(i: int, pattern: str, relation: str, head_type: str, tail_type: str) -> str:
    """What one pattern finds: heads and tails are the first and the second group, a third one counting instead of the second."""
    groups = pattern.replace("(?:", "").count("(")
    return f"""SELECT source, {i} AS p, unnest(range(len(heads))) AS m, unnest(heads) AS head, unnest(tails) AS tail, '{relation}' AS relation, '{head_type}' AS head_type, '{tail_type}' AS tail_type
      FROM (SELECT source, regexp_extract_all(text, '{pattern}', 1) AS heads, regexp_extract_all(text, '{pattern}', {groups}) AS tails FROM texts)"""


@query("""WITH texts AS (SELECT c_name AS source, '糖尿病的症状有' || c_name || '、' || c_mktsegment || '。' AS text FROM customer),
    found AS (""" + " UNION ALL ".join(_pattern_sql(i, *p) for i, p in enumerate(extract.RELATION_PATTERNS)) + f"""),
    items AS (SELECT source, p, m, trim(head) AS head, relation, head_type, tail_type, unnest(string_split_regex(trim(tail), '[,，、;；]')) AS item, generate_subscripts(string_split_regex(trim(tail), '[,，、;；]'), 1) AS i FROM found),
    good AS (SELECT *, trim(item) AS tail, row_number() OVER (PARTITION BY source, head, relation, trim(item) ORDER BY p, m, i) AS r FROM items WHERE trim(item) <> '' AND length(trim(item)) <= {extract.LONGEST_TAIL})
    SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY p, m, i) - 1 AS INTEGER) AS place, head, relation, tail, head_type, tail_type, {extract.RULE_SCORE}::DOUBLE AS confidence FROM good WHERE r = 1""", families=False)
def rule_relations(s: Star) -> DataFrame:
    texts = spread(s.table("customer").select("c_name", "c_mktsegment")).select(F.col("c_name").alias("source"), F.concat(F.lit("糖尿病的症状有"), "c_name", F.lit("、"), "c_mktsegment", F.lit("。")).alias("text"))
    return extract.extracted_triples(texts).select("source", "place", "head", "relation", "tail", "head_type", "tail_type", "confidence")


@query("SELECT '糖尿病' AS head, 'HAS_SYMPTOM' AS relation, unnest([c_name, c_mktsegment || '。']) AS tail, 0.7 AS confidence, c_name AS via FROM customer", families=False)
def rule_with_extractor(s: Star) -> DataFrame:
    """A rule in SQL that calls an extractor on the nodes' descriptions."""
    extract.register_extractor(s.spark, "relations_of", extract.rule_relations_of, extract.RELATION_ROW)
    rule = rules.Rule("described", "SELECT r.head, r.tail, r.confidence, n.name AS via FROM nodes n, LATERAL relations_of(n.props['desc']) r WHERE r.relation = 'HAS_SYMPTOM'", "HAS_SYMPTOM")
    rows = rules.run_rules(graph.Graph(_rule_texts(s), s.spark.range(0).selectExpr("'' AS src", "'' AS rel_type", "'' AS dst")), [rule], max_inferences=1)
    return rows.select("head", "relation", "tail", "confidence", "via")


@query("""WITH names AS (SELECT DISTINCT lower(p_name || ' ' || p_brand || ' ' || p_type) AS name FROM part),
    n AS (SELECT name, string_split(name, '') AS cs, list_transform(string_split(' abcdefghijklmnopqrstuvwxyz0123456789#', ''), lambda c: length(name) - length(replace(name, c, ''))) AS had FROM names),
    near AS (SELECT a.name AS src, b.name AS dst, a.cs AS x, b.cs AS y FROM n a JOIN n b ON a.name < b.name
      AND 2 * list_sum(list_transform(range(1, len(a.had) + 1), lambda i: least(a.had[i], b.had[i]))) >= 0.9 * (len(a.cs) + len(b.cs)) - 1e-9),
    bits AS (SELECT src, dst, x, y, map_from_entries(list_transform(list_distinct(x), lambda c: {'k': c, 'v': CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN x[i] = c THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END)) AS BIGINT)})) AS masks FROM near),
    steps AS (SELECT src, dst, len(x) AS m, len(y) AS n, list_reduce(list_prepend((CAST(1 AS BIGINT) << len(x)) - 1, list_transform(y, lambda c: coalesce(masks[c], 0))), lambda v, mask: ((v + (v & mask)) | (v - (v & mask))) & ((CAST(1 AS BIGINT) << len(x)) - 1)) AS row FROM bits)
    SELECT src, dst FROM steps WHERE 200.0 * (m - bit_count(row)) / (m + n) >= 90""", families=False)
def fuzzy_link(s: Star) -> DataFrame:
    return linking.similar_edges(s.table("part").select(F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("name")), 90.0)


@query()
def sample_entities(s: Star) -> DataFrame:
    return evaluate.sample_names(s.table("customer").select(F.col("c_name").alias("name")), 50)


_FRAMES = [("哪些疾病会出现{}的症状？", "symptom_to_disease"), ("{}有哪些症状？", "disease_to_symptom"), ("{}吃什么药？", "disease_to_drug"), ("{}需要做哪些检查？", "disease_to_exam"), ("介绍一下{}", "entity_definition"), ("hello {}", "unknown")]


def _framed(name: Column, number: Column, frames: list[str]) -> Column:
    return F.replace(F.get(F.array(*map(F.lit, frames)), (number % len(frames)).cast("int")), F.lit("{}"), name)


@query(f"""SELECT c_custkey, intent, CASE WHEN intent = 'unknown' THEN '' ELSE c_name END AS entity, list_filter(words, lambda w: length(w) = list_max(list_transform(words, lambda x: length(x))))[1] AS longest FROM (
    SELECT c_custkey, c_name, [{", ".join(repr(i) for _, i in _FRAMES)}][c_custkey % {len(_FRAMES)} + 1] AS intent,
      regexp_extract_all(replace([{", ".join(repr(f) for f, _ in _FRAMES)}][c_custkey % {len(_FRAMES)} + 1], '{{}}', c_name), '[一-龥a-zA-Z0-9]+') AS words FROM customer)""", families=False)
def intent_patterns(s: Star) -> DataFrame:
    question = _framed(F.col("c_name"), F.col("c_custkey"), [f for f, _ in _FRAMES])
    return s.table("customer").select("c_custkey", qa.intent_of(question).alias("i"), qa.longest_token(question).alias("longest")).select("c_custkey", "i.intent", "i.entity", "longest")


@query()
def vector_neighbours(s: Star) -> DataFrame:
    """The ten most similar embeddings of every twentieth one, among all of them. These vectors have no clusters: half of the cells are probed for a recall over 0.9."""
    rows = s.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index = vectors.index_vectors(rows, cells=64)
    near = index.neighbours(rows.filter("id % 20 = 0"), 10, probes=32)
    return near.select(F.col("query").alias("vec_id"), F.col("id").alias("neighbour"), "rank", F.round("similarity", 6).alias("similarity"))


@query("SELECT node, min(other) OVER (PARTITION BY k) AS component FROM (SELECT c_custkey AS node, c_custkey AS other, c_custkey % 97 AS k FROM customer WHERE c_custkey >= 0)", families=False)
def chain_components(s: Star) -> DataFrame:
    """Long chains: customers 97 apart are joined."""
    keys = s.table("customer").select("c_custkey")
    return components.connected_components(keys.select(F.col("c_custkey").alias("src"), F.greatest(F.col("c_custkey") - 97, F.col("c_custkey") % 97).alias("dst")))


# --- whole chains

_RECORDS = """orders_of AS (SELECT 'acct' || c_custkey AS head, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'treats' WHEN '2' THEN 'visits' ELSE 'likes' END AS relation, 'status ' || lower(o_orderstatus) AS tail, o_orderkey
      FROM orders JOIN customer ON o_custkey = c_custkey),
    summed AS (SELECT head, relation, tail, count(*) AS frequency, min(o_orderkey) AS first FROM orders_of GROUP BY ALL),
    flagged AS (SELECT *, relation <> 'treats' AND count(*) OVER (PARTITION BY head, relation) > 1 AS conflict FROM summed)"""


def _records(s: Star) -> DataFrame:
    """Raw triples of customers: each is named in full with its account in brackets once, and by its name alone elsewhere; half of them have two descriptions."""
    customer = s.table("customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    triple = lambda df, head, relation, tail, source, seq: df.select(head.alias("head"), relation.alias("relation"), tail.alias("tail"), F.lit(source).alias("source"), F.lit(1.0).alias("confidence"), seq.alias("seq"))
    full = F.concat("c_name", F.lit(" (Acct"), "c_custkey", F.lit(")"))
    rows = triple(customer, full, F.lit("HAS_SYMPTOM"), F.col("c_mktsegment"), "crm", F.col("c_custkey"))
    texts = F.array(F.concat("c_mktsegment", F.lit(" customer")), F.concat(F.lit("Segment "), "c_mktsegment", F.lit(" of "), "c_nationkey"))
    described = customer.filter("c_custkey % 2 = 0").select("*", F.posexplode(texts).alias("i", "text"))
    rows = rows.union(triple(described, F.col("c_name"), F.lit("PROP_DESC"), F.col("text"), "crm", F.col("c_custkey") * 2 + F.col("i") + 10**12))
    first = F.substring("o_orderpriority", 1, 1)
    relation = F.when(first == "1", "treats").when(first == "2", "visits").otherwise("likes")
    orders = s.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.union(triple(orders, F.col("c_name"), relation, F.concat(F.lit("Status "), "o_orderstatus"), "orders", F.col("o_orderkey") + 2 * 10**12))


@query(f"""WITH {_RECORDS}, related AS (SELECT *, row_number() OVER (PARTITION BY head, tail ORDER BY frequency, first DESC) AS r FROM flagged WHERE relation <> 'treats')
    SELECT 'Disease' AS src_label, lower(c_name) || ' (acct' || c_custkey || ')' AS src, 'HAS_SYMPTOM' AS rel_type, 'Symptom' AS dst_label, lower(c_mktsegment) AS dst, 'crm' AS source, CAST(1 AS INTEGER) AS frequency, false AS conflict FROM customer
    UNION ALL SELECT 'Drug', head, 'TREATS', 'Disease', tail, 'orders', CAST(frequency AS INTEGER), conflict FROM flagged WHERE relation = 'treats'
    UNION ALL SELECT 'Entity', head, 'RELATED_TO', 'Entity', tail, 'orders', CAST(frequency AS INTEGER), conflict FROM related WHERE r = 1""", families=False)
def graph_build_edges(s: Star) -> DataFrame:
    """Edges of a build: relations without a label of their own share an edge, which the lowest score keeps."""
    return build.build(_records(s)).graph.edges.select("src_label", "src", "rel_type", "dst_label", "dst", "source", "frequency", "conflict")


@query(f"""WITH {_RECORDS}, half AS (SELECT 'acct' || c_custkey AS name, lower('Segment ' || c_mktsegment || ' of ' || c_nationkey) AS description FROM customer WHERE c_custkey % 2 = 0),
    both_names AS (SELECT 'acct' || c_custkey AS name, 'acct' || c_custkey || '|' || lower(c_name) AS aliases FROM customer)
    SELECT 'Disease' AS label, lower(c_name) || ' (acct' || c_custkey || ')' AS name, lower(c_name) || ' (acct' || c_custkey || ')' AS aliases, NULL AS description FROM customer
    UNION ALL SELECT DISTINCT 'Symptom', lower(c_mktsegment), lower(c_mktsegment), NULL FROM customer
    UNION ALL SELECT 'Drug', name, aliases, NULL FROM both_names WHERE name IN (SELECT head FROM flagged WHERE relation = 'treats')
    UNION ALL SELECT DISTINCT 'Disease', tail, tail, NULL FROM flagged WHERE relation = 'treats'
    UNION ALL SELECT 'Entity', name, NULL, description FROM half
    UNION ALL SELECT 'Entity', name, aliases, NULL FROM both_names WHERE name IN (SELECT head FROM flagged WHERE relation <> 'treats') AND name NOT IN (SELECT name FROM half)
    UNION ALL SELECT DISTINCT 'Entity', tail, tail, NULL FROM flagged WHERE relation <> 'treats'""", families=False)
def graph_build_nodes(s: Star) -> DataFrame:
    """Nodes of a build: names with their aliases, none for nodes that a property made; the longest description."""
    return build.build(_records(s)).graph.nodes.select("label", "name", F.array_join("aliases", "|").alias("aliases"), F.element_at("props", F.lit("desc")).alias("description"))


@query("""WITH ends AS (SELECT n_name AS name, 'Nation' AS label FROM nation UNION ALL SELECT n_name, 'Place' FROM nation WHERE n_nationkey % 2 = 0)
    SELECT 'Customer' AS src_label, c_name AS src, label AS dst_label, n_name AS dst, CASE WHEN c_custkey % 3 = 0 THEN 0.4 ELSE 0.6 END AS confidence, CASE WHEN c_custkey % 3 = 0 THEN 'second' ELSE 'first' END AS rule_id
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN ends ON n_name = name""", families=False)
def prediction_write(s: Star) -> DataFrame:
    """Inferred edges matched to nodes by name: the last rule wins, earlier predictions are replaced, a name under two labels has two edges."""
    nation = s.table("nation")
    customer = s.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    nodes = nation.select(F.lit("Nation").alias("label"), F.col("n_name").alias("name")).union(nation.filter("n_nationkey % 2 = 0").select(F.lit("Place"), "n_name")).union(customer.select(F.lit("Customer"), "c_name"))
    found = lambda rows, rule, order, confidence: rows.select(F.col("c_name").alias("head"), F.lit("LIVES").alias("relation"), F.col("n_name").alias("tail"), F.lit(confidence).alias("confidence"), F.lit(rule).alias("rule_id"), F.lit(rule).alias("via"), F.lit(order).alias("rule_order"))
    empty = graph.Graph(nodes, s.spark.createDataFrame([], EDGES))
    before = rules.write_predictions(empty, found(customer.filter("c_custkey % 5 = 0"), "old", 0, 0.1))
    after = rules.write_predictions(before, found(customer, "first", 0, 0.6).union(found(customer.filter("c_custkey % 3 = 0"), "second", 1, 0.4)))
    return after.edges.select("src_label", "src", "dst_label", "dst", "confidence", "rule_id")


@query("SELECT DISTINCT c_mktsegment AS head, 'Disease' AS head_type, 'HAS_SYMPTOM' AS relation, c_name AS tail, 'Symptom' AS tail_type FROM customer", families=False)
def reversed_relation(s: Star) -> DataFrame:
    rows = s.table("customer").select(F.concat("c_name", F.lit("[症状]")).alias("entity"), F.lit("可能疾病").alias("predicate"), F.concat(F.lit(" "), "c_mktsegment", F.lit("[疾病]")).alias("value"), F.col("c_custkey").alias("seq"))
    return convert.eav_triples(rows).select("head", "head_type", "relation", "tail", "tail_type")


_LIST_SQL = "SELECT s_name AS head, 'HAS_SYMPTOM' AS relation, unnest(['sign ' || s_nationkey, 'it''s so']) AS tail, s_suppkey FROM supplier UNION ALL SELECT s_name, 'DO_EAT', 'rice', s_suppkey FROM supplier WHERE s_suppkey % 2 = 0"


def _wide_suppliers(s: Star) -> DataFrame:
    signs = F.concat(F.lit("['sign "), "s_nationkey", F.lit("', 3, ' ', \"it's so\", 'sign "), "s_nationkey", F.lit("']"))
    return s.table("supplier").select(F.col("s_name").alias("name"), signs.alias("symptom"), F.when(F.col("s_suppkey") % 2 == 0, "['rice']").otherwise("[oops").alias("do_eat"), F.col("s_suppkey").alias("seq"))


@query(f"SELECT head, relation, tail FROM ({_LIST_SQL})", families=False)
def list_unpivot(s: Star) -> DataFrame:
    """List literals: strings only, blank ones and lists that cannot be read left out."""
    return convert.wide_triples(_wide_suppliers(s)).select("head", "relation", "tail")


@query(f"SELECT head, relation, tail FROM ({_LIST_SQL}) ORDER BY s_suppkey, relation DESC, tail DESC LIMIT 25", families=False)
def triple_limit(s: Star) -> DataFrame:
    return convert.union_first_wins([convert.wide_triples(_wide_suppliers(s))], limit=25).select("head", "relation", "tail")


_ASKED = """asked AS (SELECT s_name || '有哪些症状？' AS question, 'disease_to_symptom' AS intent, [n_name] AS gold, [n_name] AS predicted FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT '哪些疾病会出现' || n_name || '的症状？', 'symptom_to_disease', list(s_name ORDER BY s_name), list(s_name ORDER BY s_name)[:3] FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name
    UNION ALL SELECT c_name || '?', 'unknown', [c_name], [] FROM customer)"""


@query(f"""WITH {_ASKED} SELECT question, array_to_string(predicted, '|') AS predicted, len(predicted) > 0 AS executable, CASE WHEN len(predicted) = 0 THEN 0.0 ELSE 1.0 END AS "precision", round(len(predicted) / len(gold), 6) AS recall FROM asked""", families=False)
def eval_run(s: Star) -> DataFrame:
    """Questions understood from their text, answered from the graph and measured, all in one plan."""
    located = s.table("supplier").join(s.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    edges = located.select(F.lit("Disease").alias("src_label"), F.col("s_name").alias("src"), F.lit("HAS_SYMPTOM").alias("rel_type"), F.lit("Symptom").alias("dst_label"), F.col("n_name").alias("dst"), F.lit("dim").alias("source"), F.lit(0.5).alias("edge_score"), F.lit(False).alias("conflict"))
    none = F.lit(None).cast("array<string>")
    nodes = s.table("supplier").select(F.lit("Disease").alias("label"), F.col("s_name").alias("name"), none.alias("aliases")).union(s.table("nation").select(F.lit("Symptom"), "n_name", none))
    of = located.select(F.concat("s_name", F.lit("有哪些症状？")).alias("question"), F.lit("disease_to_symptom").alias("intent"), F.array("n_name").alias("gold_answers"))
    to = located.groupBy("n_name").agg(F.sort_array(F.collect_list("s_name")).alias("gold_answers")).select(F.concat(F.lit("哪些疾病会出现"), "n_name", F.lit("的症状？")), F.lit("symptom_to_disease"), "gold_answers")
    odd = s.table("customer").select(F.concat("c_name", F.lit("?")), F.lit("unknown"), F.array("c_name"))
    samples = of.union(to).union(odd).withColumn("question_id", F.col("question"))
    return evaluate.run(graph.Graph(nodes, edges), samples, 3).select("question", F.array_join("predicted", "|").alias("predicted"), "executable", "precision", F.round("recall", 6).alias("recall"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(t, '^ *[-·•] *', ''), ' *[-·•] *$', '') AS name FROM (
    SELECT doc_id, translate(trim(regexp_replace(lower(nfc_normalize(coalesce(text, ''))), '[\s\x0b\x1c-\x1f]+', ' ', 'g')), '【】。、', '[].,') AS t FROM documents)""", families=False)
def normalize_texts(s: Star) -> DataFrame:
    """Whole texts as names are normalized."""
    return s.table("documents").select("doc_id", text.normalize(F.col("text")).alias("name"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def run(spark: SparkSession, name: str, folder: str) -> DataFrame:
    return QUERIES[name](spark, folder)

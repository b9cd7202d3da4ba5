"""Registered queries through files, models, samples and changesets: what is written is read again, and what comes out is compared with SQL over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import convert, evaluate, extract, fusion, graph, labels, linking, versioning
from ..runtime import freed, removed, shared_folder, stored
from ..schemas import EDGES, NODES
from ..sources import files
from .registry import query
from .stargraph import Star, pairs


def _folder(s: Star, name: str) -> str:
    return f"{shared_folder(s.spark).rstrip('/')}/trellis-files-{uuid.uuid4().hex}/{name}"


def _plain(s: Star) -> DataFrame:
    """Customers' segments as raw triples, some without a source or a number for their confidence."""
    customer = s.table("customer")
    return customer.select(
        F.col("c_name").alias("head"), F.lit("IN_SEGMENT").alias("relation"), F.concat("c_mktsegment", F.lit(" \"x\",\ny")).alias("tail"), F.when(F.col("c_custkey") % 3 > 0, "crm").alias("source"),
        F.when(F.col("c_custkey") % 4 == 1, "many").when(F.col("c_custkey") % 4 == 2, " 0.5 ").when(F.col("c_custkey") % 4 == 3, "0.25").alias("confidence"),
    )


_PLAIN_SQL = """SELECT c_name AS head, 'IN_SEGMENT' AS relation, c_mktsegment || ' "x",' || chr(10) || 'y' AS tail, CASE WHEN c_custkey % 3 > 0 THEN 'crm' ELSE 'unknown' END AS source,
    CASE c_custkey % 4 WHEN 2 THEN 0.5 WHEN 3 THEN 0.25 ELSE 1.0 END AS confidence FROM customer"""


@query(_PLAIN_SQL, families=False)
def triples_from_lines(s: Star) -> DataFrame:
    """Raw triples written as JSON lines and read with defaults."""
    path = _folder(s, "t.jsonl")
    files.write_triples(_plain(s), path)
    return files.read_triples(s.spark, path).select("head", "relation", "tail", "source", "confidence")


@query(_PLAIN_SQL, families=False)
def triples_from_arrays(s: Star) -> DataFrame:
    """Raw triples in JSON files of one array each, one file for each segment, and a file of one object."""
    path, rows = _folder(s, "t"), _plain(s)
    one = F.to_json(F.struct("head", "relation", "tail", "source", "confidence"))
    first = rows.filter("tail like 'AUTO%'").agg(F.min("head")).first()[0] or ""
    arrays = rows.filter(F.col("head") != first).groupBy("tail").agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ",\n"), F.lit("]")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(f"{path}.json")
    rows.filter(F.col("head") == first).select(one).coalesce(1).write.text(f"{path}-1.json")
    both = files.read_triples(s.spark, f"{path}.json").unionByName(files.read_triples(s.spark, f"{path}-1.json", strict=False))
    return both.select("head", "relation", "tail", "source", "confidence")


@query(_PLAIN_SQL, families=False)
def triples_from_csv(s: Star) -> DataFrame:
    """Raw triples from CSV with a header, quotes and line breaks inside values; a file of an unknown kind gives no rows when readers are lenient."""
    path = _folder(s, "t.csv")
    _plain(s).write.option("header", True).option("escape", '"').option("quoteAll", True).option("nullValue", None).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    rows = files.read_triples(s.spark, path).unionByName(files.read_triples(s.spark, f"{path}.unknown", strict=False))
    return rows.select("head", "relation", "tail", "source", "confidence")


@query("""SELECT head, 'SUPPLIES' AS relation, tail, CAST(frequency AS INTEGER) AS frequency, sources, false AS conflict, row_number() OVER (PARTITION BY head ORDER BY round(score, 4) DESC, tail) AS place FROM scored""")
def fused_from_lines(s: Star) -> DataFrame:
    """Fused triples exported as JSON lines and read again, in the order of their scores."""
    path = _folder(s, "fused")
    # stored, so that what the fusion shuffled is gone when the sort shuffles, and that when the window does
    fused = stored(fusion.fuse(s.supply_sums(), allow_multi=["SUPPLIES"]), "fused")
    freed(s.spark)
    files.write_fused(fused, path, "2024-01-01 00:00:00", compression="gzip")
    removed(fused)
    freed(s.spark)
    rows = files.read_fused(s.spark, path)
    place = F.row_number().over(Window.partitionBy("head").orderBy("seq"))
    return rows.select("head", "relation", "tail", "frequency", F.array_join("sources", ",").alias("sources"), "conflict", place.alias("place"))


@query("SELECT head, 'COMMON_DRUG' AS relation, tail, 'CM3KG_DiseaseCSV' AS source FROM (SELECT s_name AS head, unnest(['药' || s_nationkey, 'y', 'z' || s_suppkey % 2]) AS tail FROM supplier)", families=False)
def converted_eav_file(s: Star) -> DataFrame:
    """A headerless file of entity, predicate and value, whose encoding is found by trial, with rows that are too short."""
    path = _folder(s, "eav")
    rows = s.table("supplier").select("s_name", F.lit("常用药品"), F.concat(F.lit("药"), "s_nationkey", F.lit(" y \t z"), F.col("s_suppkey") % 2))
    short = s.table("supplier").select("s_name", F.lit("常用药品"), F.lit(None).cast("string"))
    rows.union(short).write.option("escape", '"').csv(path)
    return convert.eav_triples(files.read_eav(s.spark, path)).select("head", "relation", "tail", "source")


@query("""SELECT s_name AS head, 'HAS_SYMPTOM' AS relation, unnest(['sign ' || s_nationkey, 'it''s so']) AS tail, 'Symptom' AS tail_type FROM supplier
    UNION ALL SELECT s_name, 'PROP_DESC', 'two' || chr(10) || 'lines', 'Text' FROM supplier""", families=False)
def converted_wide_file(s: Star) -> DataFrame:
    """A file with a header, one entity a row, lists as literals and texts of two lines."""
    path = _folder(s, "wide")
    signs = F.concat(F.lit("['sign "), "s_nationkey", F.lit("', 3, \"it's so\"]"))
    s.table("supplier").select(F.col("s_name").alias("name"), signs.alias("symptom"), F.lit("two\nlines").alias("desc")).write.option("header", True).option("escape", '"').csv(path)
    return convert.wide_triples(files.read_wide(s.spark, path)).select("head", "relation", "tail", "tail_type")


@query("SELECT r_name || chr(10) || 'second line' || chr(10) AS text, true AS named FROM region", families=False)
def whole_text_files(s: Star) -> DataFrame:
    """Files as texts, named after themselves."""
    path = _folder(s, "texts")
    s.table("region").select(F.concat("r_name", F.lit("\nsecond line"))).repartition(5).write.option("maxRecordsPerFile", 1).text(path)
    return files.read_texts(s.spark, path).select("text", F.col("source").startswith("part-").alias("named"))


@query("""SELECT 'c' || c_custkey % 10 || '!' AS text, CASE WHEN c_custkey % 4 = 0 THEN 'O,O,O' WHEN c_custkey % 4 = 1 THEN 'B-dis,I-dis,O' ELSE 'O,B-sym,O' END AS labels FROM customer WHERE c_custkey % 5 > 0""", families=False)
def label_sequences(s: Star) -> DataFrame:
    """Texts with a label for each character, labels in several forms; lines that do not fit are left out."""
    path, k = _folder(s, "labels"), F.col("c_custkey")
    given = F.when(k % 4 == 0, '"x O B-unknown"').when(k % 4 == 1, '["b-DIS","i-dis",null]').otherwise('["o"," B-Sym ","E-sym"]')
    line = F.concat(F.lit('{"text": "c'), (k % 10).cast("string"), F.when(k % 5 == 0, "!!").otherwise("!"), F.lit('", "labels": '), given, F.lit("}"))
    s.table("customer").select(line).union(s.spark.range(1).select(F.lit("not json"))).union(s.spark.range(1).select(F.lit(""))).write.text(path)
    return files.read_label_sequences(s.spark, path).select("text", F.array_join("labels", ",").alias("labels"))


@query("""SELECT 'disease_to_symptom' AS intent, s_name AS entity, string_agg(DISTINCT n_name, '|' ORDER BY n_name) AS gold, true AS asked FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY s_name
    UNION ALL SELECT 'symptom_to_disease', n_name, string_agg(DISTINCT s_name, '|' ORDER BY s_name), true FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""", families=False)
def gold_questions(s: Star) -> DataFrame:
    """A question set of all entities with their exact answers, written and read again; every question is one of its intent's templates."""
    path = _folder(s, "gold")
    located = s.table("supplier").join(s.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    edges = located.select(F.lit("Disease").alias("src_label"), F.col("s_name").alias("src"), F.lit("HAS_SYMPTOM").alias("rel_type"), F.lit("Symptom").alias("dst_label"), F.col("n_name").alias("dst"))
    files.write_eval_set(evaluate.gold_set(graph.Graph(edges, edges), 2_000_000_000), path)
    rows = files.read_eval_set(s.spark, path)
    entity = F.col("entity_mentions")[0]
    table = F.create_map(*(F.lit(v) for k, t in evaluate.TEMPLATES.items() for v in (k, "|".join(t))))
    asked = F.array_contains(F.split(F.replace(F.element_at(table, F.col("intent")), F.lit("{entity}"), entity), r"\|"), F.col("question"))
    return rows.select("intent", entity.alias("entity"), F.array_join(F.array_sort("gold_answers"), "|").alias("gold"), asked.alias("asked"))


@query("""SELECT lower(c_mktsegment) AS name, 'g' || c_nationkey || '.' || lower(c_mktsegment) AS canonical, 'x' AS side FROM customer WHERE false
    UNION ALL SELECT DISTINCT lower(s_name), 's' || s_suppkey, 'canonical' FROM supplier UNION ALL SELECT DISTINCT 's' || s_suppkey, 's' || s_suppkey, 'canonical' FROM supplier
    UNION ALL SELECT DISTINCT 's' || s_suppkey || '|' || lower(s_name), 's' || s_suppkey, 'aliases' FROM supplier""", families=False)
def alias_map_file(s: Star) -> DataFrame:
    """Canonical names and the aliases of each, as files; names that several raw names share are registered once."""
    path = _folder(s, "aliases")
    full = F.concat("s_name", F.lit(" (S"), "s_suppkey", F.lit(")"))
    names = s.table("supplier").select(full.alias("name"))
    files.write_alias_map(linking.canonical_names(names), path)
    one = s.spark.read.schema("name string, canonical string").json(f"{path}/canonical_map")
    many = s.spark.read.schema("canonical string, aliases array<string>").json(f"{path}/alias_map")
    return one.select("name", "canonical", F.lit("canonical").alias("side")).union(many.select(F.array_join("aliases", "|"), "canonical", F.lit("aliases")))


@query("SELECT lower(c_mktsegment) AS src, lower(c_mktsegment) AS dst FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment || c_custkey % 2) > 1", families=False)
def shared_names(s: Star) -> DataFrame:
    """Normalized names that several raw names have."""
    name = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.concat(F.lower("c_mktsegment"), F.lit(" ")))
    return linking.duplicate_edges(s.table("customer").select(name.alias("name")).distinct())


@query("SELECT head, 'HAS_TYPE' AS relation, string_agg(DISTINCT tail, '|' ORDER BY tail) AS tails, 'catalog' AS sources FROM types GROUP BY head HAVING count(DISTINCT tail) > 1")
def conflict_file(s: Star) -> DataFrame:
    """The conflict report as a file."""
    path = _folder(s, "conflicts")
    files.write_conflicts(fusion.conflicts(s.types(), []), path)
    rows = s.spark.read.schema("head string, relation string, tails array<string>, sources array<string>").json(path)
    return rows.select("head", "relation", F.array_join("tails", "|").alias("tails"), F.array_join("sources", "|").alias("sources"))


# --- models


def _first_and_last(texts: list[str]) -> list[list[dict]]:
    """A model that knows the first letter and the last three characters of a text, surer of longer texts."""
    return [[{"word": t[0], "start": 0, "end": 1, "label": "B-kind", "score": 0.9}, {"word": "##" + t[-3:], "start": len(t) - 3, "end": len(t), "label": "number", "score": len(t) % 4 / 4}] for t in texts]


_SPANS_OF = """found AS (SELECT p_name || '#' || p_partkey AS t FROM part)"""


def _named_parts(s: Star) -> DataFrame:
    return s.parts().select(F.col("part").alias("source"), F.col("part").alias("text"))


@query(f"""WITH {_SPANS_OF} SELECT t AS source, substr(t, 1, 1) AS text, 0 AS start, 1 AS stop, 'Disease' AS label, 0.9 AS score FROM found
    UNION ALL SELECT t, right(t, 3), CAST(length(t) - 3 AS INTEGER), CAST(length(t) AS INTEGER), 'Entity', length(t) % 4 / 4.0 FROM found WHERE length(t) % 4 >= 2""", families=False)
def model_entity_spans(s: Star) -> DataFrame:
    """Spans of a model, those below the threshold left out, labels mapped by the model's and the ontology's names, marks of word pieces removed."""
    extractor = extract.model_spans(_first_and_last, lambda x: extract.map_label(x, {"kind": "Disease"}, {}), 0.5)
    rows = extract.with_spans(_named_parts(s), extractor).select("source", F.explode("spans").alias("x"))
    return rows.select("source", "x.text", "x.start", F.col("x.end").alias("stop"), "x.label", "x.score")


def _alike(texts: list[str]) -> list[tuple[str, float]]:
    """A model that relates what it is asked about by the length of the question."""
    return [(("treats", "causes", "none")[len(t) % 3], len(t) % 5 / 5) for t in texts]


@query(f"""WITH {_SPANS_OF}, asked AS (SELECT t, substr(t, 1, 1) AS head, right(t, 3) AS tail, length(substr(t, 1, 1) || '[SEP]' || right(t, 3) || '[SEP]' || t) AS n FROM found WHERE length(t) % 4 >= 2)
    SELECT t AS source, head, CASE n % 3 WHEN 0 THEN 'TREATS' ELSE 'causes' END AS relation, tail, 'Disease' AS head_type, 'Entity' AS tail_type, n % 5 / 5.0 AS confidence FROM asked WHERE n % 3 < 2 AND n % 5 / 5.0 >= 0.5""", families=False)
def model_relations(s: Star) -> DataFrame:
    """Pairs of a text's spans asked of a model: unsure answers and relations without a name left out."""
    ner = extract.model_spans(_first_and_last, lambda x: extract.map_label(x, {"kind": "Disease"}, {}), 0.5)
    rows = extract.model_triples(_named_parts(s), ner, _alike, {"treats": "TREATS", "cause": "causes"}, 0.5)
    return rows.select("source", "head", "relation", "tail", "head_type", "tail_type", "confidence")


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'Drug' WHEN 'view' THEN 'Symptom' WHEN 'error' THEN 'Exam' ELSE 'Entity' END AS label,
    CASE event_type WHEN 'click' THEN 'TREATS' WHEN 'view' THEN 'CAUSES' END AS relation FROM events""", families=False)
def mapped_labels(s: Star) -> DataFrame:
    """Labels and relations of models by name: prefixes removed, the model's own names first, then the ontology's, names that are canonical already kept."""
    kind = F.col("event_type")
    label = F.when(kind == "click", "B-PILL").when(kind == "view", "s-Sign").when(kind == "error", "检查").otherwise(kind)
    relation = F.when(kind == "click", "heals").when(kind == "view", "CAUSES").otherwise(kind)
    return s.table("events").select("event_id", extract.map_label(label, {"pill": "Drug"}, {"SIGN": "Symptom", "检查": "Exam"}).alias("label"), extract.map_relation(relation, {"heals": "TREATS", "brings": "CAUSES"}).alias("relation"))


@query("""SELECT c_name AS head, 'HAS_SYMPTOM' AS relation, c_mktsegment AS tail, 'crm' AS source, c_custkey AS place FROM customer
    UNION ALL SELECT '糖尿病', 'HAS_SYMPTOM', c_mktsegment, c_name, (SELECT count(*) FROM customer) + row_number() OVER (ORDER BY c_name) - 1 FROM customer""", families=False)
def appended_extracted(s: Star) -> DataFrame:
    """Triples that one pattern finds in texts after raw ones, in one order."""
    customer = s.table("customer")
    raw = customer.select(F.col("c_name").alias("head"), F.lit("HAS_SYMPTOM").alias("relation"), F.col("c_mktsegment").alias("tail"), F.lit("crm").alias("source"), F.lit(1.0).alias("confidence"), F.col("c_custkey").alias("seq"))
    texts = customer.select(F.col("c_name").alias("source"), F.concat(F.lit("糖尿病的症状有"), "c_mktsegment").alias("text"))
    rows = extract.appended(raw, extract.extracted_triples(texts, lambda t: extract.rule_relations(t, extract.RELATION_PATTERNS[:1])))
    # a place in the whole is asked for here, so the whole is put in order
    return rows.select("head", "relation", "tail", "source", (F.row_number().over(Window.orderBy("seq")) - 1).cast("long").alias("place"))


# --- samples, splits, single nodes


@query("""SELECT 'node' AS kind, name AS head, NULL AS tail, NULL AS score FROM (SELECT p_name || '#' || p_partkey AS name FROM part ORDER BY 1 LIMIT 50)
    UNION ALL SELECT * FROM (SELECT 'edge', head, tail, round(score, 6) AS s FROM scored ORDER BY s DESC NULLS FIRST, head, tail LIMIT 20)
    UNION ALL SELECT 'named', s_name, NULL, NULL FROM supplier WHERE s_name = 'Supplier#000000003'""")
def graph_samples(s: Star) -> DataFrame:
    """First nodes of a label, best edges of a relation, a node by its name."""
    rows = fusion.fuse(s.supply_sums(), allow_multi=["SUPPLIES"])
    edges = rows.select(F.lit("Supplier").alias("src_label"), F.col("head").alias("src"), F.col("relation").alias("rel_type"), F.lit("Part").alias("dst_label"), F.col("tail").alias("dst"), F.array_join("sources", ",").alias("source"), F.round("edge_score_raw", 6).alias("edge_score"), "conflict")
    nodes = s.table("supplier").select(F.lit("Supplier").alias("label"), F.col("s_name").alias("name")).union(s.parts().select(F.lit("Part"), "part"))
    g, none = graph.Graph(nodes, edges), F.lit(None)
    out = g.sample_nodes("Part", 50).select(F.lit("node").alias("kind"), F.col("name").alias("head"), none.cast("string").alias("tail"), none.cast("double").alias("score"))
    out = out.union(g.sample_relationships("SUPPLIES", 20).select(F.lit("edge"), "head", "tail", "score"))
    return out.union(g.node("Supplier#000000003", "Supplier").select(F.lit("named"), "name", none.cast("string"), none.cast("double")))


@query("SELECT count(*) AS n, CAST(floor(count(*) * 0.9) AS BIGINT) AS train, count(*) - CAST(floor(count(*) * 0.9) AS BIGINT) AS valid, CAST(0 AS BIGINT) AS shared FROM customer", families=False)
def split_sizes(s: Star) -> DataFrame:
    """A split into training and validation rows: exact sizes, nothing in both, nothing lost."""
    train, valid = labels.split_rows(s.table("customer").select("c_custkey"), "c_custkey", 0.1)
    both = train.select("c_custkey", F.lit(1).alias("t"), F.lit(0).alias("v")).union(valid.select("c_custkey", F.lit(0), F.lit(1)))
    rows = both.groupBy("c_custkey").agg(F.sum("t").alias("t"), F.sum("v").alias("v"))
    return rows.agg(F.count("*").alias("n"), F.sum("t").alias("train"), F.sum("v").alias("valid"), F.count_if((F.col("t") > 0) & (F.col("v") > 0)).alias("shared"))


@query("SELECT n_name AS name, 'Nation' AS label, count(*) AS n FROM (SELECT n_name FROM nation UNION ALL SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 10 = 0) GROUP BY n_name HAVING count(*) > 1", families=False)
def repeated_nodes(s: Star) -> DataFrame:
    """Keys of nodes that are not unique; none are left after everything is cleared."""
    nodes = s.table("nation").select("n_name").union(s.table("supplier").filter("s_suppkey % 10 = 0").join(s.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name"))
    g = graph.Graph(nodes.select(F.lit("Nation").alias("label"), F.col("n_name").alias("name")), pairs(s.dimensions()))
    left = graph.duplicate_keys(g.clear().nodes)
    return graph.duplicate_keys(g.nodes).union(left).select("name", "label", "n")


# --- changesets


@query("""WITH given AS (SELECT c_name AS head, CASE c_custkey % 3 WHEN 0 THEN 'BUYS_FROM' WHEN 1 THEN 'VISITS' ELSE 'not valid' END AS relation, n_name AS tail FROM customer JOIN nation ON c_nationkey = n_nationkey),
    kept AS (SELECT * FROM given WHERE relation <> 'not valid')
    SELECT change_id, head, relation, tail, revision, src_label, event FROM (
      SELECT 'first' AS change_id, head, relation, tail, 1 AS revision, CAST(NULL AS VARCHAR) AS src_label, unnest([false, true]) AS event FROM kept WHERE relation = 'VISITS'
      UNION ALL SELECT 'second', head, relation, tail, CASE relation WHEN 'VISITS' THEN 2 ELSE 1 END, NULL, unnest([false, true]) FROM kept)""", families=False)
def changes_of_edges(s: Star) -> DataFrame:
    """Two changesets: each triple with a valid relation name is a new edge with the next revision and an audit event; an unknown changeset changes nothing."""
    customer = s.table("customer").join(s.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    relation = F.when(F.col("c_custkey") % 3 == 0, "BUYS_FROM").when(F.col("c_custkey") % 3 == 1, "VISITS").otherwise("not valid")
    rows = customer.select(F.col("c_name").alias("head"), relation.alias("relation"), F.col("n_name").alias("tail"), F.lit("crm").alias("source"), F.lit(1.0).alias("confidence"), F.col("c_custkey").alias("seq"))
    empty = lambda schema: s.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
    graph_ = versioning.VersionedGraph.of(graph.Graph(empty(NODES), empty(EDGES)))
    _, graph_ = graph_.begin("ops", "load", change_id="first")
    graph_ = graph_.upsert(rows.filter("relation = 'VISITS'"), "first")
    _, graph_ = graph_.begin("ops", "again", change_id="second")
    graph_ = graph_.upsert(rows, "second").upsert(rows, "unknown")
    edges = graph_.graph.edges.select("change_id", F.col("src").alias("head"), F.col("rel_type").alias("relation"), F.col("dst").alias("tail"), "revision", "src_label", F.lit(False).alias("event"))
    return edges.union(graph_.events.select("change_id", "head", "relation", "tail", "revision", F.lit(None).cast("string"), F.lit(True)))


@query("""SELECT label, name, aliases, seen FROM (SELECT 'Drug' AS label, c_name AS name, c_name || '|old ' || c_custkey AS aliases, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS seen FROM customer
    UNION ALL SELECT DISTINCT 'Disease', c_mktsegment, c_mktsegment, 2 FROM customer)""", families=False)
def nodes_of_a_second_load(s: Star) -> DataFrame:
    """Nodes after two loads: the aliases of the first one stay, the time of the last one that had a node is its update."""
    customer, none = s.table("customer"), F.lit(0.5)
    rows = customer.select(F.col("c_name").alias("head"), F.lit("TREATS").alias("relation"), F.col("c_mktsegment").alias("tail"), F.array(F.lit("crm")).alias("sources"), none.alias("confidence"), F.lit(1).alias("frequency"), none.alias("edge_score"), F.lit(False).alias("conflict"), F.col("c_custkey").alias("seq"))
    aliases = lambda word: customer.select(F.col("c_name").alias("canonical"), F.array("c_name", F.concat(F.lit(word), "c_custkey")).alias("aliases"))
    empty = lambda schema: s.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
    made = graph.Graph(empty(NODES), empty(EDGES)).upsert_triples(rows, aliases("old "), "2024-01-01 00:00:00").upsert_triples(rows.filter("seq % 2 = 0"), aliases("new "), "2024-02-01 00:00:00")
    return made.nodes.select("label", "name", F.array_join("aliases", "|").alias("aliases"), F.month("updated_at").alias("seen"))

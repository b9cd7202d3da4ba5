"""Template questions to ranked graph answers, singly or in batch."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..runtime import removed, stored
from .graph import Graph

# Question patterns in their order of precedence, and words that are no entity.
INTENT_PATTERNS = [
    ("哪些疾病会出现(.+?)的症状", "symptom_to_disease"),
    ("(哪些|什么)(疾病|病).*?症状.*?(.+)", "symptom_to_disease"),
    ("(.+?)可能是什么(病|疾病)", "symptom_to_disease"),
    ("(.+?)是.*?症状", "symptom_to_disease"),
    ("(.+?)有(哪些|什么)(症状|表现)", "disease_to_symptom"),
    ("(.+?)的症状", "disease_to_symptom"),
    ("(.+?)吃(什么|哪些)药", "disease_to_drug"),
    ("(.+?)的(治疗|用)药", "disease_to_drug"),
    ("(什么|哪些)药.*?(治疗|治)(.+)", "drug_to_disease"),
    ("(.+?)需要(做|哪些)(什么|哪些)?检查", "disease_to_exam"),
    ("(.+?)的检查(项目)?", "disease_to_exam"),
    ("(.+?)检查.*?(指标|项目)", "exam_to_indicator"),
    ("(.+?)是什么", "entity_definition"),
    ("介绍一下(.+)", "entity_definition"),
]
STOP_WORDS = ["哪些", "什么", "疾病", "病", "治疗", "治", "做", "需要"]
#: Intent to (relation, label of the named end, label of the answer, whether the named end is the edge's target).
INTENTS = {
    "disease_to_symptom": ("HAS_SYMPTOM", "Disease", "Symptom", False),
    "symptom_to_disease": ("HAS_SYMPTOM", "Symptom", "Disease", True),
    "disease_to_drug": ("RECOMMENDED_DRUG", "Disease", "Drug", False),
    "drug_to_disease": ("TREATS", "Drug", "Disease", False),
    "disease_to_exam": ("NEEDS_EXAM", "Disease", "Exam", False),
    "exam_to_indicator": ("HAS_INDICATOR", "Exam", "Indicator", False),
}


def intent_of(question: Column) -> Column:
    """struct(intent, entity): the first pattern that matches; the entity is its first group that is no stop word."""
    found = []
    for pattern, intent in INTENT_PATTERNS:
        pattern = "(?d)" + pattern
        groups = F.array(*(F.regexp_extract(question, pattern, i + 1) for i in range(pattern.count("(") - 1)))
        picked = F.filter(groups, lambda g: (g != "") & ~g.isin(*STOP_WORDS))
        found.append(F.when(question.rlike(pattern), F.struct(F.lit(intent).alias("intent"), strip(F.coalesce(F.get(picked, 0), F.lit(""))).alias("entity"))))
    return F.coalesce(*found, F.struct(F.lit("unknown").alias("intent"), F.lit("").alias("entity")))


def longest_token(question: Column) -> Column:
    """The first of the longest runs of letters, digits and Han characters; empty if there is none."""
    words = F.regexp_extract_all(question, F.lit("([一-龥a-zA-Z0-9]+)"), F.lit(1))
    return F.aggregate(words, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))


def named(name: Column, aliases: Column, entity: Column) -> Column:
    """Whether a node is meant: its name is or contains the entity, or an alias is it, whatever the case."""
    e = F.lower(entity)
    return F.lower(name).contains(e) | F.coalesce(F.exists(aliases, lambda a: F.lower(a) == e), F.lit(False))


def _hops(edges: DataFrame, intents: dict[str, tuple], active_only: bool) -> DataFrame:
    """(intent, key_label, key, answer, relation, score, source, conflict) of the relations that intents ask for: one scan of the edges.

    A relation that several intents ask for, from either end, gives a row for each.
    """
    table = [(name, relation, key, answer, back) for name, (relation, key, answer, back) in intents.items()]
    kinds = edges.sparkSession.createDataFrame(table, "intent string, rel_type string, key_label string, answer_label string, back boolean")
    rows = edges.filter(F.col("rel_type").isin(*sorted({v[0] for v in intents.values()})))
    if active_only:
        rows = rows.filter(F.coalesce("active", F.lit(True)))
    rows = rows.join(F.broadcast(kinds), "rel_type")
    end = lambda forward, backward: F.when(F.col("back"), F.col(backward)).otherwise(F.col(forward))
    rows = rows.filter((end("src_label", "dst_label") == F.col("key_label")) & (end("dst_label", "src_label") == F.col("answer_label")))
    return rows.select("intent", "key_label", end("src", "dst").alias("key"), end("dst", "src").alias("answer"), F.col("rel_type").alias("relation"), F.col("edge_score").alias("score"), "source", "conflict")


def answers(graph: Graph, intent: str, entity: str, top_k: int = 10, active_only: bool = False, intents: dict[str, tuple] = INTENTS) -> DataFrame:
    """The top answers for one entity: exactly named ones first, then by score, unknown scores first, then by name."""
    if intent == "entity_definition":
        rows = graph.nodes.filter(named(F.col("name"), F.col("aliases"), F.lit(entity)))
        exact = F.when(F.lower("name") == entity.lower(), 0).otherwise(1)
        return rows.select(F.col("name").alias("answer"), "label", "aliases", exact.alias("match")).orderBy("match", F.length("answer"), "answer", "label").limit(1).drop("match")
    hops = _hops(graph.edges, {intent: intents[intent]}, active_only).drop("intent")
    nodes = graph.nodes.select(F.col("name").alias("key"), F.col("label").alias("key_label"), "aliases").filter(named(F.col("key"), F.col("aliases"), F.lit(entity)))
    rows = hops.join(nodes, ["key", "key_label"]).withColumn("match", F.when(F.lower("key") == entity.lower(), 0).otherwise(1))
    rows = rows.orderBy("match", F.desc_nulls_first("score"), "answer", "key").limit(top_k)
    shaped = [F.coalesce("score", F.lit(1.0)).alias("score"), F.split(F.coalesce("source", F.lit("")), ",").alias("sources"), F.coalesce("conflict", F.lit(False)).alias("conflict")]
    return rows.select("answer", *shaped, F.col("key"), "relation")


@dataclass
class Reply:
    """An answered question: what was understood, the answers, and the subgraph they form."""

    intent: str
    entity: str
    answers: list[dict] = field(default_factory=list)
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)


def ask(graph: Graph, question: str, top_k: int = 10, active_only: bool = False, intents: dict[str, tuple] = INTENTS) -> Reply:
    """Answer one question. The entity is resolved to the best node of its label, or taken as it stands."""
    spark = graph.nodes.sparkSession
    row = spark.range(1).select(intent_of(F.lit(question)).alias("i"), longest_token(F.lit(question)).alias("longest")).first()
    intent, entity = row["i"]["intent"], row["i"]["entity"] or row["longest"]
    if intent == "unknown" or not entity:
        return Reply(intent, entity)
    best = graph.search(entity, intents[intent][1] if intent in intents else None, 1).first()
    entity = best["name"] if best else entity
    found = [r.asDict() for r in answers(graph, intent, entity, top_k, active_only, intents).collect()]
    reply = Reply(intent, entity, found)
    seen: set[str] = set()
    for r in found:
        head = entity if intent in intents and intents[intent][3] else r.get("key", entity)
        for name in (head, r["answer"]):
            if name not in seen:
                seen.add(name)
                reply.nodes.append({"id": name, "label": name})
        reply.edges.append({"source": head, "target": r["answer"], "relation": r.get("relation", "RELATED_TO")})
    return reply


GRAM = 3


def nodes_meant(entities: DataFrame, nodes: DataFrame, inside_aliases: bool = False) -> DataFrame:
    """(entity, key_label, key): for distinct `entities` (entity, key_label) the `nodes` (key, key_label, aliases) that `named` holds for.

    With `inside_aliases` an alias may also contain the entity, as in a search. An alias meets its entity by an equi-join. A name that contains an entity has all its grams of three characters (or fewer for shorter
    entities): each entity looks for its rarest gram among the names' grams, and candidates are verified.
    """
    e = entities.filter("entity <> ''").select("entity", "key_label", F.lower("entity").alias("e"))
    by_alias = nodes.select("key", "key_label", F.explode("aliases").alias("alias")).select("key", "key_label", F.lower("alias").alias("e"))
    found = e.join(by_alias, ["key_label", "e"]).select("entity", "key_label", "key")
    grams = lambda text, size: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size)))
    names = nodes.select("key", "key_label", F.lower("key").alias("name"))
    if inside_aliases:
        names = names.union(nodes.select("key", "key_label", F.explode("aliases").alias("alias")).select("key", "key_label", F.lower("alias")))
    names = names.distinct()
    sized = F.flatten(F.array(*(F.when(F.length("name") >= n, grams(F.col("name"), F.lit(n))).otherwise(F.array().cast("array<string>")) for n in range(1, GRAM + 1))))
    postings = names.select("key", "key_label", "name", F.explode(sized).alias("gram"))
    wanted = e.select("entity", "key_label", "e", F.explode(grams(F.col("e"), F.least(F.length("e"), F.lit(GRAM)))).alias("gram"))
    frequency = postings.groupBy("key_label", "gram").agg(F.count("*").alias("df"))
    rarest = wanted.join(frequency, ["key_label", "gram"], "left").groupBy("entity", "key_label", "e").agg(F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)), "gram")).alias("gram"))
    within = rarest.join(postings, ["key_label", "gram"]).filter(F.col("name").contains(F.col("e"))).select("entity", "key_label", "key")
    return found.union(within).distinct()


#: The label that stands for any, where an intent asks for a node of whatever kind.
ANY = "*"


def _keyed(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes as (key, key_label, label, aliases), once under their own label and once under ANY, as far as `labels` (key_label) ask for either."""
    rows = nodes.select(F.col("name").alias("key"), "label", "aliases", F.explode(F.array(F.col("label"), F.lit(ANY))).alias("key_label"))
    return rows.join(F.broadcast(labels), "key_label", "left_semi")


def _kinds(questions: DataFrame, intents: dict[str, tuple]) -> DataFrame:
    table = [(k, v[1]) for k, v in intents.items()] + [("entity_definition", ANY)]
    return F.broadcast(questions.sparkSession.createDataFrame(table, "intent string, key_label string"))


def understood(graph: Graph, questions: DataFrame, intents: dict[str, tuple] = INTENTS) -> DataFrame:
    """`questions` (question_id, question) with intent and entity: the name of the best node that a search finds, else the words asked for.

    The best node has the words as its name, else the shortest name, then the first. Unknown questions keep an entity, but no node is looked for.
    The rows are stored, as each of the many joins that answer them reads them again.
    """
    asked = questions.withColumn("i_", intent_of(F.col("question")))
    words = F.when(F.col("i_.entity") != "", F.col("i_.entity")).otherwise(longest_token(F.col("question")))
    asked = stored(asked.withColumns({"intent": F.col("i_.intent"), "words_": words}).drop("i_"), "asked")
    wanted = asked.join(_kinds(questions, intents), "intent").select("intent", F.col("words_").alias("entity"), "key_label").distinct()
    nodes = _keyed(graph.nodes, wanted.select("key_label").distinct())
    found = nodes_meant(wanted.select("entity", "key_label").distinct(), nodes.select("key", "key_label", "aliases"), inside_aliases=True)
    order = F.struct(F.when(F.lower("key") == F.lower("entity"), 0).otherwise(1), F.length("key"), F.col("key"))
    best = found.groupBy("entity", "key_label").agg(F.min_by("key", order).alias("best"))
    best = wanted.join(best, ["entity", "key_label"]).select("intent", F.col("entity").alias("words_"), "best")
    rows = asked.join(best, ["intent", "words_"], "left").withColumn("entity", F.coalesce("best", "words_")).select(*questions.columns, "intent", "entity")
    rows = stored(rows, "understood")
    removed(asked)
    return rows


def ask_batch(graph: Graph, questions: DataFrame, top_k: int = 10, active_only: bool = False, intents: dict[str, tuple] = INTENTS) -> DataFrame:
    """`questions` (question_id, intent, entity) with `predicted`: the ranked answers to all, in one plan.

    Node names and aliases are matched once per distinct entity and label, by equi-joins; edges are read once and joined by name.
    A definition is answered by the one node that is meant.
    """
    wanted = questions.select("question_id", "intent", "entity").join(_kinds(questions, intents), "intent")
    distinct = wanted.select("entity", "key_label").distinct()
    nodes = _keyed(graph.nodes, distinct.select("key_label").distinct())
    meant = wanted.join(nodes_meant(distinct, nodes.select("key", "key_label", "aliases")), ["entity", "key_label"])
    exact = F.when(F.lower("key") == F.lower("entity"), 0).otherwise(1)
    rows = meant.join(_hops(graph.edges, intents, active_only), ["intent", "key_label", "key"])
    order = [exact, F.desc_nulls_first("score"), F.col("answer"), F.col("key")]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).filter(F.col("rank") <= top_k)
    found = rows.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "answer"))), lambda r: r["answer"]).alias("predicted"))
    defined = meant.filter("intent = 'entity_definition'").groupBy("question_id").agg(F.array(F.min_by("key", F.struct(exact, F.length("key"), F.col("key")))).alias("predicted"))
    return questions.join(found.unionByName(defined), "question_id", "left").withColumn("predicted", F.coalesce("predicted", F.array().cast("array<string>")))

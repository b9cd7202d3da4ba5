"""Question sets from the graph, and how well answers match them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..runtime import removed, stored
from .graph import Graph
from .qa import INTENTS, ask_batch, understood

# Question templates.
TEMPLATES = {
    "disease_to_symptom": ["{entity}有哪些症状？", "{entity}的症状是什么？", "{entity}有什么表现？"],
    "symptom_to_disease": ["哪些疾病会出现{entity}的症状？", "{entity}可能是什么病？"],
    "disease_to_drug": ["{entity}吃什么药？", "{entity}的治疗药物有哪些？"],
    "disease_to_exam": ["{entity}需要做哪些检查？", "{entity}的检查项目有哪些？"],
}


def sample_names(names: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """`n` distinct names by a seeded hash: the same in any order of rows."""
    return names.distinct().orderBy(F.xxhash64(F.lit(seed), "name"), "name").limit(n)


def gold_set(graph: Graph, samples: int = 50, seed: int = 42) -> DataFrame:
    """(question_id, question, intent, entity, gold_answers): sampled entities of four intents with all their exact answers."""
    rows = None
    for intent, templates in TEMPLATES.items():
        relation, key_label, answer_label, backwards = INTENTS[intent]
        key, answer = ("dst", "src") if backwards else ("src", "dst")
        edges = graph.edges.filter((F.col("rel_type") == relation) & (F.col(f"{key}_label") == key_label) & (F.col(f"{answer}_label") == answer_label))
        edges = edges.select(F.col(key).alias("name"), F.col(answer).alias("answer"))
        gold = edges.join(sample_names(edges.select("name"), samples, seed), "name").groupBy("name").agg(F.sort_array(F.collect_set("answer")).alias("gold_answers"))
        pick = F.element_at(F.array(*map(F.lit, templates)), (F.pmod(F.xxhash64("name", F.lit(seed)), F.lit(len(templates))) + 1).cast("int"))
        own = gold.select(F.concat_ws("|", F.lit(intent), "name").alias("question_id"), F.replace(pick, F.lit("{entity}"), F.col("name")).alias("question"), F.lit(intent).alias("intent"), F.col("name").alias("entity"), "gold_answers")
        rows = own if rows is None else rows.unionByName(own)
    return rows


def _clean(items: Column) -> Column:
    return F.array_distinct(F.transform(items, lambda x: strip(F.lower(x))))


def with_set_metrics(rows: DataFrame, gold: str = "gold_answers", predicted: str = "predicted") -> DataFrame:
    """`rows` with precision, recall, f1 and exact_match (the first answer is gold), on lower-cased stripped items."""
    g, p = _clean(F.col(gold)), _clean(F.col(predicted))
    rows = rows.withColumns({"g_": g, "p_": p})
    common = F.size(F.array_intersect("g_", "p_"))
    none = (F.size("g_") == 0) & (F.size("p_") == 0)
    ratio = lambda n: F.when(none, 1.0).when((F.size("g_") == 0) | (F.size("p_") == 0), 0.0).otherwise(common / F.size(n))
    rows = rows.withColumns({"precision": ratio("p_"), "recall": ratio("g_")})
    total = F.col("precision") + F.col("recall")
    rows = rows.withColumns({"f1": F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0), "exact_match": F.coalesce(F.array_contains("g_", F.get("p_", 0)), F.lit(False))})
    return rows.drop("g_", "p_")


def _share(test: Column) -> Column:
    return F.coalesce(F.avg(test.cast("double")), F.lit(0.0))


def overall(results: DataFrame) -> DataFrame:
    """One row of metrics over results (executable, predicted, exact_match, precision, recall, f1)."""
    answered = F.col("executable") & (F.size("predicted") > 0)
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return results.agg(
        F.count("*").alias("total_samples"), F.coalesce(F.sum(F.col("executable").cast("long")), F.lit(0)).alias("executable_count"), _share(F.col("executable")).alias("executable_rate"),
        _share(F.col("exact_match")).alias("accuracy_at_1"), mean("precision").alias("avg_precision"), mean("recall").alias("avg_recall"), mean("f1").alias("avg_f1"), _share(answered).alias("coverage"),
    )


def per_intent(results: DataFrame) -> DataFrame:
    answered = F.col("executable") & (F.size("predicted") > 0)
    return results.groupBy("intent").agg(F.count("*").alias("total"), _share(F.col("executable")).alias("executable_rate"), _share(answered).alias("coverage"), F.avg("f1").alias("avg_f1"), _share(F.col("exact_match")).alias("accuracy_at_1"))


def run(graph: Graph, samples: DataFrame, top_k: int = 10) -> DataFrame:
    """Results of evaluation samples (question_id, question, intent, gold_answers): every question understood from its text, answered, and measured.

    A sample is executable if its question has a known intent and an entity. All questions share one plan, so none has a time of its own:
    `latency_ms` is the samples' own where they have one, else 0.
    """
    latency = F.col("latency_ms") if "latency_ms" in samples.columns else F.lit(0).cast("long").alias("latency_ms")
    asked = understood(graph, samples.select("question_id", "question"))
    asked = ask_batch(graph, asked, top_k).withColumn("executable", (F.col("intent") != "unknown") & (F.col("entity") != ""))
    rows = samples.select("question_id", "question", "intent", "gold_answers", latency).join(asked.select("question_id", "predicted", "executable"), "question_id")
    return with_set_metrics(rows)


#: Ranges that values are counted by before the exact percentiles are looked for within one of them.
RANGES = 1024
#: Relative error of quantiles from sketches.
SKETCH_ERROR = 0.01


def latency_percentiles(results: DataFrame, column: str = "latency_ms") -> DataFrame:
    """One row (latency_p50, latency_p95): the values at index floor(n * q) of the ascending list, 0 without rows.

    Values are counted by ranges first; only the values of the range that an index falls into are then counted one by one.
    """
    rows = results.filter(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    ends = F.broadcast(rows.agg(F.min("v").alias("low"), F.max("v").alias("high")))
    spread = F.col("high") - F.col("low")
    place = F.when(spread > 0, F.least(F.floor((F.col("v") - F.col("low")) / spread * RANGES), F.lit(RANGES - 1))).otherwise(F.lit(0).cast("long"))
    placed = rows.crossJoin(ends).select("v", place.alias("range"))
    sizes = placed.groupBy("range").agg(F.count("*").alias("n"))  # at most RANGES rows
    sizes = sizes.select("range", F.sum("n").over(Window.orderBy("range")).alias("upto"), (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.least(F.floor(F.col("all") * q), F.col("all") - 1).alias("index")) for name, q in (("p50", 0.5), ("p95", 0.95)))))
    hit = sizes.select("range", "before", "upto", asked.alias("a")).select("range", "before", "upto", "a.*").filter("before <= index and index < upto")
    counts = placed.join(F.broadcast(hit.select("range", "before", "index", "name")), "range").groupBy("name", "before", "index", "v").agg(F.count("*").alias("n"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("name").orderBy("v"))
    found = counts.withColumn("upto", upto).filter("upto > index").groupBy("name").agg(F.min("v").alias("v"))
    at = lambda name: F.coalesce(F.max(F.when(F.col("name") == name, F.col("v"))), F.lit(0))
    return found.agg(at("p50").alias("latency_p50"), at("p95").alias("latency_p95"))


def failed(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("executable") | (F.size("predicted") == 0))


def slowest(results: DataFrame, n: int = 10) -> DataFrame:
    return results.orderBy(F.desc("latency_ms"), "question").limit(n)


#: The report's tables: heading, and for each column its title, its metric and its format.
OVERALL = [("samples", "total_samples", "d"), ("executable", "executable_rate", ".2%"), ("coverage", "coverage", ".2%"), ("accuracy@1", "accuracy_at_1", ".2%"),
           ("precision", "avg_precision", ".4f"), ("recall", "avg_recall", ".4f"), ("F1", "avg_f1", ".4f"), ("latency p50, ms", "latency_p50", ".0f"), ("latency p95, ms", "latency_p95", ".0f")]
PER_INTENT = [("intent", "intent", ""), ("samples", "total", "d"), ("executable", "executable_rate", ".2%"), ("coverage", "coverage", ".2%"), ("accuracy@1", "accuracy_at_1", ".2%"), ("F1", "avg_f1", ".4f")]
SLOWEST = [("question", "question", ".40"), ("intent", "intent", ""), ("ms", "latency_ms", "d")]
FAILED = [("question", "question", ".40"), ("intent", "intent", ""), ("why", "why", "")]


def _markdown(rows: list, columns: list[tuple[str, str, str]]) -> str:
    """A Markdown table of rows; a bar inside a value is escaped."""
    cells = [[title for title, _, _ in columns], ["---"] * len(columns)]
    cells += [[format(r[name], spec).replace("|", "\\|") for _, name, spec in columns] for r in rows]
    return "\n".join("| " + " | ".join(row) + " |" for row in cells)


def cube(results: DataFrame) -> DataFrame:
    """All totals in one pass: (by_intent, by_executable, intent, executable, total, executable_count, executable_rate, accuracy_at_1, avg_precision,
    avg_recall, avg_f1, coverage) over the grouping sets (), (intent), (executable) and (intent, executable); by_ tells what a row is grouped by. Without results there are no rows."""
    answered = F.col("executable") & (F.size("predicted") > 0)
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    rows = results.select("intent", "executable", "predicted", "exact_match", "precision", "recall", "f1", F.col("executable").alias("could"), answered.alias("answered"))
    sets = rows.groupingSets([[], ["intent"], ["executable"], ["intent", "executable"]], "intent", "executable")
    return sets.agg(
        (F.grouping("intent") == 0).alias("by_intent"), (F.grouping("executable") == 0).alias("by_executable"), F.count("*").alias("total"), F.coalesce(F.sum(F.col("could").cast("long")), F.lit(0)).alias("executable_count"),
        _share(F.col("could")).alias("executable_rate"), _share(F.col("exact_match")).alias("accuracy_at_1"), mean("precision").alias("avg_precision"), mean("recall").alias("avg_recall"), mean("f1").alias("avg_f1"),
        _share(F.col("answered")).alias("coverage"),
    )


def latency_sketches(results: DataFrame, keys: list[str], error: float = SKETCH_ERROR) -> DataFrame:
    """(keys, n, sketch, questions): for each group a histogram of latencies and a HyperLogLog sketch of its distinct questions.

    The histogram counts values by the power of (1 + error) / (1 - error) that they lie under, so that a quantile is off by a factor of `error` at most; it has some
    hundred bins whatever the number of rows. Sketches of batches, days or intents are merged by `merged_sketches`, and no result is read twice."""
    bins = F.map_from_entries(F.sort_array(F.collect_list(F.struct("bin", "n"))))
    rows = results.filter("latency_ms is not null").select(*keys, _bin(F.col("latency_ms"), error).alias("bin"), "question")
    counts = rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.hll_sketch_agg(F.col("question").cast("string"), F.lit(12)).alias("questions"))
    return counts.groupBy(*keys).agg(F.sum("n").alias("n"), bins.alias("sketch"), F.hll_union_agg("questions").alias("questions"))


def _bin(value: Column, error: float) -> Column:
    """0 for values under 1, else the number of the power that a value lies under."""
    return F.when(value < 1, 0).otherwise(F.floor(F.log(value.cast("double")) / math.log((1 + error) / (1 - error))).cast("int") + 1)


def merged_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches (n, sketch, questions) of finer groups, or of other batches, as those of `keys`."""
    own = sketches.select(*keys, F.explode("sketch").alias("bin", "m"))
    bins = own.groupBy(*keys, "bin").agg(F.sum("m").alias("m")).groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("bin", "m")))).alias("sketch"))
    rest = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("questions").alias("questions"))
    if not keys:
        return rest.crossJoin(bins).select("n", "sketch", "questions")  # one row each
    return rest.join(bins, keys).select(*keys, "n", "sketch", "questions")


def sketched(sketches: DataFrame, quantiles: dict[str, float], error: float = SKETCH_ERROR) -> DataFrame:
    """`sketches` with the values at index floor(n * q) of the ascending list for each name of `quantiles`, off by a factor of `error` at most (values
    under 1 are 0), and `distinct`, the number of distinct questions, off by 1.6 % (one standard deviation)."""
    base = (1 + error) / (1 - error)
    ordered = F.array_sort(F.map_entries("sketch"))
    out = sketches
    for name, q in quantiles.items():
        index = F.least(F.floor(F.col("n") * q), F.col("n") - 1)
        start = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(-1).alias("bin"))
        found = F.aggregate(ordered, start, _to_index(index))["bin"]
        out = out.withColumn(name, F.when(found == 0, 0.0).otherwise(F.pow(F.lit(base), found - 1) * 2 * base / (1 + base)))
    return out.withColumn("distinct", F.hll_sketch_estimate("questions"))


def _to_index(index: Column):
    return lambda a, x: F.struct((a["upto"] + x["value"]).alias("upto"), F.when((a["bin"] < 0) & (a["upto"] + x["value"] > index), x["key"]).otherwise(a["bin"]).alias("bin"))


def report(results: DataFrame, made_at: str, failures: int = 20) -> str:
    """A Markdown report of overall metrics, intents, the slowest ten questions and the first `failures` failed ones. Results are made once and stored
    for it; only these few rows leave Spark."""
    results = stored(results, "results")
    totals = cube(results).filter("not by_executable").collect()
    over = next((r.asDict() for r in totals if not r["by_intent"]), {})
    first = {name: over.get("total" if name == "total_samples" else name, 0) for _, name, _ in OVERALL} | latency_percentiles(results).first().asDict()
    bad = failed(results).withColumn("why", F.when(F.col("executable"), "no result").otherwise("not executable")).orderBy("question")
    parts = {
        f"Evaluation of {made_at}": ([first], OVERALL),
        "By intent": (sorted((r for r in totals if r["by_intent"]), key=lambda r: (r["intent"] is not None, r["intent"])), PER_INTENT),
        "Slowest": (slowest(results).collect(), SLOWEST),
        f"Failed: {failed(results).count()}": (bad.limit(failures).collect(), FAILED),
    }
    removed(results)
    return "\n\n".join(f"## {heading}\n\n{_markdown(rows, columns)}" for heading, (rows, columns) in parts.items()) + "\n"

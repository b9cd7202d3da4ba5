"""Counters, rules that fail while they run, one-pass totals and mergeable sketches."""

import random

import pytest
from pyspark.sql import functions as F

from trellis.operators import build, convert, evaluate, graph, rules
from trellis.operators.counters import Counters
from trellis.schemas import EDGES, NODES


def edge(src_label, src, rel, dst_label, dst):
    return (src_label, src, rel, dst_label, dst)


@pytest.fixture(scope="module")
def small(spark):
    rows = [edge("Disease", f"d{i}", "HAS_SYMPTOM", "Symptom", f"s{i % 3}") for i in range(9)] + [edge("Disease", f"d{i}", "RECOMMENDED_DRUG", "Drug", f"m{i % 4}") for i in range(9)]
    edges = spark.createDataFrame(rows, "src_label string, src string, rel_type string, dst_label string, dst string").withColumn("active", F.lit(True))
    return graph.Graph(spark.createDataFrame([], NODES), edges)


def test_conversion_counts(spark):
    c = Counters()
    rows = spark.createDataFrame([("a[疾病]", "症状", "b", 1), ("a[疾病]", "简介", "text", 2), ("a[疾病]", "nothing", "x", 3), ("a[疾病]", "常用药品", "m n m", 4), ("a", None, "x", 5)], "entity string, predicate string, value string, seq long")
    made = convert.eav_triples(rows, counters=c).collect()
    assert c.read() == {"eav_read": {"rows": 5, "unknown": 2}, "eav_triples": {"rows": len(made), "properties": 1}} and len(made) == 4
    wide = spark.createDataFrame([("a", "['x', 'y']", "text", 1), (" ", "['z']", None, 2)], "name string, symptom string, desc string, seq long")
    made = convert.wide_triples(wide, counters=c).collect()
    assert c.read("wide_read", "wide_triples") == {"wide_read": {"rows": 2, "nameless": 1}, "wide_triples": {"rows": 3, "properties": 1}} and len(made) == 3
    with pytest.raises(ValueError, match="already"):
        c.count("wide_read", wide)


def test_build_counts(spark):
    c = Counters()
    raw = spark.createDataFrame([("A (B)", "likes", "x", "s", 1.0, 1), ("a", "likes", "y", "s", 1.0, 2), ("a", "treats", "y", "s", 1.0, 3)], "head string, relation string, tail string, source string, confidence double, seq long")
    made = build.build(raw, counters=c)
    assert c.read("fused")["fused"] == {"rows": made.fused.count(), "conflicts": made.fused.filter("conflict").count()}
    assert c.read("linked")["linked"] == {"rows": made.canonical.count(), "replaced": made.canonical.filter("name <> canonical").count()}


def test_rules_that_fail_while_they_run(spark, small):
    # this one is planned well; it fails in its tasks
    bad = rules.Rule("bad", "SELECT src AS head, dst AS tail, CAST(raise_error('broken rule') AS DOUBLE) AS confidence FROM edges", "X")
    worse = rules.Rule("worse", lambda g: 1 / 0, "X")
    good = rules.Rule("good", "WITH a AS (SELECT * FROM edges WHERE dst = 's1') SELECT src AS head, dst AS tail FROM a WHERE '{' <> '}'", "X")
    spark.range(3).createOrReplaceTempView("edges")
    failed, c = {}, Counters()
    rows = rules.run_rules(small, [bad, worse, good, *rules.MEDICAL_RULES], failed=failed, counters=c)
    got = {r["rule_id"]: r["count"] for r in rows.groupBy("rule_id").count().collect()}
    assert set(failed) == {"bad", "worse"} and got["good"] == 3 and got["r1_symptom_drug"] == 9
    assert c.read("good", "r1_symptom_drug") == {"good": {"rows": 3}, "r1_symptom_drug": {"rows": 9}}
    # a view of the session with the same name is as it was
    assert spark.table("edges").columns == ["id"]
    spark.catalog.dropTempView("edges")
    with pytest.raises(ZeroDivisionError):
        rules.run_rules(small, [worse])


def results(spark, n, seed=5):
    rng = random.Random(seed)
    rows = [(f"q{i % max(1, n * 9 // 10)}", rng.choice(["a", "b", None]), rng.random() < 0.8, ["x"] if rng.random() < 0.7 else [], ["x"], int(rng.lognormvariate(4, 2)) if rng.random() < 0.98 else None) for i in range(n)]
    return evaluate.with_set_metrics(spark.createDataFrame(rows, "question string, intent string, executable boolean, predicted array<string>, gold_answers array<string>, latency_ms long"))


def test_cube_is_the_two_reports(spark):
    rows = results(spark, 300)
    made = {(r["by_intent"], r["by_executable"], r["intent"], r["executable"]): r for r in evaluate.cube(rows).collect()}
    top, whole = made[False, False, None, None], evaluate.overall(rows).first()
    assert top["total"] == whole["total_samples"] and all(top[k] == pytest.approx(whole[k]) for k in whole.asDict() if k != "total_samples")
    for r in evaluate.per_intent(rows).collect():
        own = made[True, False, r["intent"], None]
        assert all(own[k] == pytest.approx(r[k]) for k in r.asDict())
    assert sum(r["total"] for k, r in made.items() if k[:2] == (True, True)) == 300
    assert evaluate.cube(rows.limit(0)).count() == 0


def test_report_makes_its_results_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(_):
        calls.add(1)
        return True

    text = evaluate.report(results(spark, 50).withColumn("executable", seen.asNondeterministic()("question")), "now")
    assert calls.value == 50 and "| samples |" in text and "## Slowest" in text
    assert "| 0 |" in evaluate.report(results(spark, 1).limit(0), "now")


@pytest.mark.parametrize("error", [0.01, 0.1])
def test_sketches_of_batches_are_merged(spark, error):
    first, second = results(spark, 2_000, 1), results(spark, 3_000, 2)
    parts = evaluate.latency_sketches(first, ["intent"], error).unionByName(evaluate.latency_sketches(second, ["intent"], error))
    whole = evaluate.sketched(evaluate.merged_sketches(parts, []), {"p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}, error).first()
    values = sorted(r[0] for r in first.select("latency_ms").union(second.select("latency_ms")).collect() if r[0] is not None)
    assert whole["n"] == len(values)
    for name, q in (("p50", 0.5), ("p95", 0.95), ("p0", 0.0), ("p100", 1.0)):
        exact = values[min(int(len(values) * q), len(values) - 1)]
        assert abs(whole[name] - exact) <= error * exact * 1.0001 if exact >= 1 else whole[name] == 0
    distinct = first.filter("latency_ms is not null").select("question").union(second.filter("latency_ms is not null").select("question")).distinct().count()
    assert abs(whole["distinct"] - distinct) < 0.06 * distinct
    by = {r["intent"]: r["n"] for r in evaluate.merged_sketches(parts, ["intent"]).filter("intent is not null").collect()}
    assert set(by) == {"a", "b"}
    assert len(whole["sketch"]) < 2_000 / (1 if error < 0.05 else 10)


def test_store_edges_schema(spark):
    assert {"valid_from", "valid_to"} <= {f.name for f in EDGES}

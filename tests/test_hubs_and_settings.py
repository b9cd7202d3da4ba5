"""Hot heads and hubs, types through a build, whole settings files, times."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trellis.operators import build, evaluate, fusion, graph, rules
from trellis.operators.versioning import VersionedGraph
from trellis.sources import files
from trellis.sources.store import GraphStore

RAW = "head string, relation string, tail string, source string, confidence double, seq long"


@pytest.mark.parametrize("block", [1_000, 7])
def test_joins_at_hubs(spark, block):
    """One key has nine rows of ten on both sides; repeated rows and nulls as in any join."""
    left = spark.createDataFrame([("hub", i % 50) for i in range(90)] + [(f"k{i}", i) for i in range(10)] + [(None, 1), ("only", 3)], "via string, a int")
    right = spark.createDataFrame([("hub", f"r{i % 40}") for i in range(60)] + [(f"k{i}", "x") for i in range(5)] + [(None, "n")], "via string, b string")
    got = graph.joined_at(left, right, "via", block)
    assert got.columns == ["via", "a", "b"] and Counter(map(tuple, got.collect())) == Counter(map(tuple, left.join(right, "via").collect()))
    assert graph.joined_at(left.limit(0), right, "via", block).count() == 0


def test_no_task_has_a_hub(spark):
    """The join of a hub goes to many keys: none has more than a block's pairs."""
    left = spark.range(2_000).selectExpr("'hub' AS via", "id AS a")
    right = spark.range(30).selectExpr("'hub' AS via", "id AS b")
    plan = graph.joined_at(left, right, "via", 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_at" in plan and "r_at" in plan
    assert graph.joined_at(left, right, "via", 100).count() == 60_000
    existing = spark.createDataFrame([], "src string, dst string")
    star = rules.star(left.selectExpr("via AS src", "CAST(a AS STRING) AS dst"), right.selectExpr("via AS src", "CAST(b AS STRING) AS dst"), existing)
    assert star.count() == 60_000


def test_conflicts_of_a_hot_head(spark):
    rows = spark.range(5_000).selectExpr("'hot' AS head", "'likes' AS relation", "CONCAT('t', id % 300) AS tail", "CONCAT('s', id % 2) AS source", "1.0D AS confidence", "id AS seq")
    rows = rows.union(spark.createDataFrame([("one", "likes", "x", "s", 1.0, 1), ("one", "likes", "x", "t", 1.0, 2), ("two", "HAS_SYMPTOM", "x", "s", 1.0, 3), ("two", "has_symptom", "y", "s", 1.0, 4)], RAW))
    long = fusion.conflicting_rows(rows).collect()
    assert len(long) == 300 and {r["head"] for r in long} == {"hot"} and all(len(r["sources"]) in (1, 2) for r in long)
    listed = fusion.conflicts(rows).collect()
    assert [(r["head"], len(r["tails"]), r["sources"]) for r in listed] == [("hot", 300, ["s0", "s1"])] and listed[0]["tails"] == sorted(listed[0]["tails"])
    flags = {(r["head"], r["conflict"]) for r in fusion.fuse(rows).collect()}
    assert flags == {("hot", True), ("one", False), ("two", False)}
    # a window would bring all rows of a head together
    assert "Window" not in fusion.fuse(rows)._jdf.queryExecution().optimizedPlan().toString()


def test_types_reach_the_graph(spark):
    raw = spark.createDataFrame(
        [("Aspirin", "Drug", "odd", "Cold", "Disease", "s", 1.0, 1), ("aspirin", None, "odd", "cold", None, "t", 1.0, 0), ("flu", "Disease", "RECOMMEND_DRUG", "aspirin", "Drug", "s", 1.0, 2), ("x", None, "likes", "y", None, "s", 1.0, 3)],
        "head string, head_type string, relation string, tail string, tail_type string, source string, confidence double, seq long",
    )

    def edges(**how):
        return {(e["src_label"], e["src"], e["rel_type"], e["dst_label"], e["dst"]) for e in build.build(raw, **how).graph.edges.collect()}

    assert edges() == {("Entity", "aspirin", "RELATED_TO", "Entity", "cold"), ("Disease", "flu", "RECOMMEND_DRUG", "Drug", "aspirin"), ("Entity", "x", "RELATED_TO", "Entity", "y")}
    assert edges(keep_types=True, relation_names={"RECOMMEND_DRUG": "RECOMMENDED_DRUG"}) == {("Drug", "aspirin", "RELATED_TO", "Disease", "cold"), ("Disease", "flu", "RECOMMENDED_DRUG", "Drug", "aspirin"), ("Entity", "x", "RELATED_TO", "Entity", "y")}


@pytest.mark.parametrize("suffix", ["json", "yaml"])
def test_a_whole_settings_file(spark, tmp_path, suffix):
    yaml = pytest.importorskip("yaml")
    given = {
        "fusion": {"enable_fuzzy": True, "fuzzy_threshold": 95, "source_weights": {"default": 1.0, "s": 0.5}, "scoring": {"source_weight": 0.2}}, "reasoning": {"enabled": False, "max_inferences": 7},
        "nlp": {"ner": {"min_score": 0.6}, "relation": None}, "eval": {"samples_per_type": 3, "random_seed": 9, "output_dir": "out"}, "api": {"default_top_k": 4}, "schema": {"path": "o.json"},
    }
    path = tmp_path / f"s.{suffix}"
    path.write_text(json.dumps(given) if suffix == "json" else yaml.safe_dump(given))
    got = files.read_configuration(str(path))
    assert got.build == {"fuzzy": 95.0, "weights": {"default": 1.0, "s": 0.5}, "source_weight_": 0.2} == files.read_settings(str(path))
    assert (got.rules, got.rules_enabled, got.spans, got.relations, got.samples, got.answers, got.ontology, got.reports) == ({"max_inferences": 7}, False, {"least": 0.6}, {}, {"samples": 3, "seed": 9}, {"top_k": 4}, "o.json", "out")
    raw = spark.createDataFrame([("a", "HAS_SYMPTOM", "b", "s", 1.0, 1)], RAW)
    made = build.build(raw, **got.build)
    assert made.fused.first()["source_score"] == 0.5
    assert evaluate.gold_set(made.graph, **got.samples).count() == 2 and rules.run_rules(made.graph, **got.rules).count() == 0
    path.write_text("{}")
    empty = files.read_configuration(str(path))
    assert empty.build == empty.rules == {} and empty.rules_enabled


def test_files_without_line_breaks_are_split(spark, tmp_path):
    rows = "".join(f"entity {i},症状,value {i}\n" for i in range(2_000))
    (tmp_path / "eav.csv").write_text(rows, encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        whole, parts = (files.read_eav(spark, str(tmp_path / "eav.csv"), line_breaks=b) for b in (True, False))
        assert whole.rdd.getNumPartitions() == 1 < parts.rdd.getNumPartitions()
        assert sorted(map(tuple, whole.drop("seq").collect())) == sorted(map(tuple, parts.drop("seq").collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_the_time_is_that_of_the_query(spark, tmp_path):
    raw = spark.createDataFrame([("a", "HAS_SYMPTOM", "b", "s", 1.0, 1)], RAW)
    made = build.build(raw).graph
    now = F.current_timestamp() - F.expr("interval 10 minutes")
    assert made.edges.filter(F.col("created_at") > now).count() == 1 and made.nodes.filter(F.col("created_at") > now).count() == 2
    _, versioned = VersionedGraph.of(made).begin("me", "why")
    assert versioned.changesets.filter(F.col("created_at") > now).count() == 1
    assert GraphStore.create(spark, str(tmp_path / "g")).manifest()["at"] > "2024"

"""Rows of table functions are no batches of their own, rules run once, and small tables are dealt out before Python work."""

from trellis.operators import extract, rules
from trellis.operators.graph import Graph
from trellis.plans import queries
from trellis.runtime import spread

SF = "/root/testdata/sf0.001"


def test_small_tables_are_dealt_out(spark):
    want = 4 * spark.sparkContext.defaultParallelism
    assert spread(spark.range(5).coalesce(1)).rdd.getNumPartitions() >= want
    for rows in (queries.rule_relations, queries._rule_texts):
        assert rows(queries.Star(spark, SF)).rdd.getNumPartitions() >= want


def test_a_table_function_gives_the_columns_types(spark):
    extract.register_extractor(spark, "odd_numbers", lambda texts: [[(1, 2, None)] for _ in texts], "n int, x double, s string")
    assert [tuple(r) for r in spark.sql("SELECT r.* FROM VALUES ('a') AS t(x), LATERAL odd_numbers(t.x) r").collect()] == [(1, 2.0, None)]


def test_a_rule_runs_once(spark):
    ran = spark.sparkContext.accumulator(0)

    def found(texts):
        ran.add(len(texts))
        return [[("h", "R", t, "", "", 0.5)] for t in texts]

    extract.register_extractor(spark, "counted", found, extract.RELATION_ROW)
    graph = Graph(spark.range(7).selectExpr("'L' as label", "string(id) as name", "map('desc', string(id)) as props"), spark.range(0).selectExpr("'' AS src", "'' AS rel_type", "'' AS dst"))
    rule = rules.Rule("once", "SELECT r.head, r.tail FROM nodes n, LATERAL counted(n.props['desc']) r", "R")
    assert rules.run_rules(graph, [rule]).count() == 7 and ran.value == 7


def test_texts_do_not_meet_texts(spark):
    df = queries.QUERIES["extractor_function"](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and len(df.collect()) == spark.read.parquet(f"{SF}/documents.parquet").count()

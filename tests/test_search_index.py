"""The stored search index against scans of all nodes."""

import random

import pytest

from trellis.operators.graph import Graph
from trellis.operators.search_index import SearchIndex
from trellis.schemas import NODES
from trellis.sources.store import GraphStore

NODE = "label string, name string, aliases array<string>"
TRIPLE = "head string, relation string, tail string, sources array<string>, confidence double, frequency int, edge_score double, conflict boolean, seq long"


@pytest.fixture(scope="module")
def nodes(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd 东é") for _ in range(rng.randint(1, 9)))
    rows = {(rng.choice("XYZ"), word().strip() or "a"): [word() for _ in range(rng.randint(0, 2))] or None for _ in range(400)}
    rows |= {("X", "abcd abcd abcd"): ["ab", "AB", None], (None, "ab"): None, ("Y", "AB"): ["abc"]}
    return spark.createDataFrame([(a, b, c) for (a, b), c in rows.items()], NODE).repartition(3).cache()


def test_same_answers_as_a_scan(spark, nodes, tmp_path):
    index, graph = SearchIndex(spark, str(tmp_path / "i"), block=4), Graph(nodes, nodes)
    index.add(nodes.filter("label = 'X'"))
    index.add(nodes.filter("label <> 'X' or label is null"))
    asked = ["a", "ab", "AB", "abc", "东", "é", "bcd a", "abcd abcd abcd", "zzz", "d", " "]
    got = index.search_batch(spark.createDataFrame([(a,) for a in [*asked, "", None, "ab"]], "asked string"), 7)
    rows = {}
    for r in sorted(got.collect(), key=lambda r: (r["match_type"], r["name_len"], r["name"], r["label"] or "")):
        rows.setdefault(r["asked"], []).append(tuple(r)[1:])
    for a in asked:
        assert rows.get(a, []) == [(r["name"], r["label"], r["match_type"], r["name_len"]) for r in graph.search(a, limit=7).collect()], a
    assert [tuple(r)[:2] for r in index.search("ab", 5, "Y").collect()] == [tuple(r)[:2] for r in graph.search("ab", "Y", 5).collect()]


def test_reads_a_part_of_the_postings(spark, tmp_path):
    rows = [("X", f"name {i} of the list{'s' * (i % 40)}", None) for i in range(20_000)]
    index = SearchIndex(spark, str(tmp_path / "i"))
    index.add(spark.createDataFrame(rows, NODE))
    total = index.blocks().filter("gram = 'lis'").selectExpr("sum(n)").first()[0]
    assert index.search("list", 10).count() == 10 and index.search("lists", 3).count() == 3
    assert total == 20_000 and 0 < index.read_entries < 0.2 * total


def test_follows_a_store(spark, tmp_path):
    def triples(names):
        return spark.createDataFrame([(n, "TREATS", "cold", ["s"], 1.0, 1, 0.5, False, i) for i, n in enumerate(names)], TRIPLE)

    store, index = GraphStore.create(spark, str(tmp_path / "g"), buckets=8), SearchIndex(spark, str(tmp_path / "i"))
    store.merge(triples(["aspirin", "aspirin plus"]))
    index.follow(store)
    store.merge(triples(["aspirin", "new aspirin"]))
    store.merge(triples(["other"]))
    assert index.search("aspirin").count() == 2
    assert index.follow(store) == index.follow(store) == 3
    assert [r["name"] for r in index.search("aspirin").collect()] == ["aspirin", "new aspirin", "aspirin plus"]
    assert index.blocks().filter("file = 1 and gram = 'asp'").selectExpr("sum(n)").first()[0] == 1


def test_an_empty_index(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "i"))
    assert index.search("a").count() == 0
    index.add(spark.createDataFrame([], NODES))
    assert index.search("a").count() == 0

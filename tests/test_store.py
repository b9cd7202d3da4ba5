"""Versions of a graph in a folder: merges into what was read, killed and concurrent writes, past versions, rewritten files."""

import os

import pytest
from pyspark.sql import functions as F

from trellis.operators.graph import Graph
from trellis.sources import store as stores
from trellis.sources.store import ConcurrentWrite, GraphStore

TRIPLE = "head string, relation string, tail string, sources array<string>, confidence double, frequency int, edge_score double, conflict boolean, seq long"


def triples(spark, rows):
    return spark.createDataFrame([(h, r, t, ["s"], c, 1, 0.5, False, i) for i, (h, r, t, c) in enumerate(rows)], TRIPLE)


def edges_of(graph):
    return {(e["src"], e["rel_type"], e["dst"]): e["confidence"] for e in graph.edges.collect()}


def files_under(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_merge_equals_upserts_of_frames(spark, tmp_path):
    made = GraphStore.create(spark, str(tmp_path / "g"), buckets=8)
    first = triples(spark, [(f"d{i}", "HAS_SYMPTOM", f"s{i % 5}", 0.1) for i in range(40)] + [("d1", "PROP_DESC", "a text", 1.0), ("d2", "odd", "x", 0.3)])
    second = triples(spark, [("d1", "HAS_SYMPTOM", "s1", 0.9), ("d99", "TREATS", "d1", 0.8), ("d1", "PROP_DESC", "a longer text", 1.0), ("d2", "stranger", "x", 0.4)])
    assert made.merge(first, now="2024-01-01 00:00:00") == 1
    assert made.merge(second, now="2024-02-01 00:00:00") == 2
    plain = Graph(made.read(0).nodes, made.read(0).edges).upsert_triples(first, now="2024-01-01 00:00:00").upsert_triples(second, now="2024-02-01 00:00:00")
    for table in ("nodes", "edges"):
        got, want = (sorted(map(repr, getattr(g, table).select(*sorted(getattr(g, table).columns)).collect())) for g in (made.read(), plain))
        assert got == want
    assert edges_of(made.read(1))["d1", "HAS_SYMPTOM", "s1"] == 0.1
    assert len(edges_of(made.read_at("2024-01-15 00:00:00"))) == 41
    assert [h["operation"] for h in made.history()] == ["merge", "merge", "create"]


def test_a_small_merge_rewrites_few_files(spark, tmp_path):
    made = GraphStore.create(spark, str(tmp_path), buckets=32)
    made.merge(triples(spark, [(f"d{i}", "HAS_SYMPTOM", f"s{i}", 0.1) for i in range(600)]))
    before, old = files_under(tmp_path), made.manifest()
    made.merge(triples(spark, [("d7", "HAS_SYMPTOM", "s7", 0.5)]))
    new, after = made.manifest(), files_under(tmp_path)
    assert {t: len(b) for t, b in new["rewritten"].items()} == {"nodes": 2, "edges": 1} or len(new["rewritten"]["nodes"]) == 1
    assert sum(new["tables"]["edges"][b] != w for b, w in old["tables"]["edges"].items()) == 1
    # old files are as they were; a file was written for each touched bucket, no more
    assert {f: after[f] for f in before} == before
    assert len(after) - len(before) == sum(map(len, new["rewritten"].values()))
    assert edges_of(made.read())["d7", "HAS_SYMPTOM", "s7"] == 0.5 and len(edges_of(made.read())) == 600


def test_a_write_that_dies_leaves_the_last_version(spark, tmp_path, monkeypatch):
    made = GraphStore.create(spark, str(tmp_path), buckets=4)
    made.merge(triples(spark, [("a", "TREATS", "b", 0.1)]))
    # it dies in its tasks, or after its files are written and before its manifest is
    broken = triples(spark, [("a", "TREATS", "b", 0.2)]).withColumn("confidence", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        made.merge(broken)
    with monkeypatch.context() as m:
        m.setattr(stores.Files, "put_new", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            made.merge(triples(spark, [("a", "TREATS", "b", 0.3), ("c", "TREATS", "b", 0.3)]))
    again = GraphStore(spark, str(tmp_path))
    assert again.versions() == [0, 1] and edges_of(again.read()) == {("a", "TREATS", "b"): 0.1}
    assert again.merge(triples(spark, [("a", "TREATS", "b", 0.4)])) == 2
    assert edges_of(again.read()) == {("a", "TREATS", "b"): 0.4}
    # what the dead write left is deleted, what the kept versions name is not
    assert again.vacuum(keep=2) and edges_of(again.read(1)) == {("a", "TREATS", "b"): 0.1}
    again.vacuum()
    assert again.versions() == [2] and edges_of(again.read()) == {("a", "TREATS", "b"): 0.4}
    with pytest.raises(ValueError, match="version"):
        again.read(1)


def test_two_writers(spark, tmp_path):
    made = GraphStore.create(spark, str(tmp_path), buckets=4)
    base = made.manifest()
    made.merge(triples(spark, [("a", "TREATS", "b", 0.1)]), base=base)
    with pytest.raises(ConcurrentWrite):
        made.merge(triples(spark, [("c", "TREATS", "d", 0.1)]), base=base)
    made.merge(triples(spark, [("c", "TREATS", "d", 0.1)]))
    assert len(edges_of(made.read())) == 2
    with pytest.raises(ValueError, match="already"):
        GraphStore.create(spark, str(tmp_path))


def test_a_graph_goes_back_to_where_it_was_read(spark, tmp_path):
    made = GraphStore.create(spark, str(tmp_path), buckets=4, tasks_a_bucket=2)
    made.merge(triples(spark, [("a", "TREATS", "b", 0.1), ("c", "TREATS", "b", 0.2)]))
    graph = made.read()
    made.overwrite(Graph(graph.nodes, graph.edges.withColumn("active", F.col("src") != "c")))
    assert {e["src"]: e["active"] for e in made.read().edges.collect()} == {"a": True, "c": False}
    made.delete_edges(made.read().edges.filter("src = 'c'"))
    assert set(edges_of(made.read())) == {("a", "TREATS", "b")}
    made.clear()
    assert made.read().nodes.count() == 0 and made.read().edges.columns == graph.edges.columns
    assert made.read(1).edges.count() == 2
    assert 0 <= made.node_bucket("Drug", "a") < 4
    assert made.merge(triples(spark, [])) == 5

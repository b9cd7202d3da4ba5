"""Hand-derived cases of the graph operators."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trellis import runtime, schemas
from trellis.functions import text
from trellis.operators import build, components, convert, evaluate, extract, fusion, graph, labels, linking, qa, rules, versioning
from trellis.sources import files
from trellis.streaming import ingest


def col(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def edges_of(spark, rows):
    """(src_label, src, rel_type, dst_label, dst, edge_score) rows as full edges."""
    df = spark.createDataFrame(rows, "src_label string, src string, rel_type string, dst_label string, dst string, edge_score double")
    return spark.createDataFrame([], schemas.EDGES).unionByName(df, allowMissingColumns=True)


def nodes_of(spark, rows):
    df = spark.createDataFrame(rows, "label string, name string, aliases array<string>")
    return spark.createDataFrame([], schemas.NODES).unionByName(df.withColumn("props", F.create_map().cast("map<string,string>")), allowMissingColumns=True)


@pytest.mark.parametrize(
    ("raw", "expected"), [("【Ａ】、b。", "[a],b."), ("  - Foo　 Bar • ", "foo bar"), (None, ""), ("", ""), ("A\tB\nC", "a b c"), ("“x”", "“x”"), ("--x", "-x")]
)
def test_normalize(spark, raw, expected):
    assert col(spark, raw, text.normalize) == expected


@pytest.mark.parametrize(("raw", "expected"), [("感冒[疾病]", ("感冒", "Disease")), ("感冒", ("感冒", "Entity")), ("a[b][症状] ", ("a[b]", "Symptom")), ("x[?]", ("x", "Entity"))])
def test_typed_name(spark, raw, expected):
    assert tuple(col(spark, raw, text.typed_name)) == expected


@pytest.mark.parametrize(("raw", "expected"), [("['a', 1, ' ', 'b']", ["a", "b"]), ("nonsense", None), ("('a',)", None), ("", None), (None, None), ("[None, 'x\\'y']", ["x'y"])])
def test_list_literal(spark, raw, expected):
    assert col(spark, raw, text.list_literal) == expected


@pytest.mark.parametrize(("raw", "expected"), [("abc", 1.0), (None, 1.0), (" 0.25 ", 0.25), ("", 1.0)])
def test_confidence(spark, raw, expected):
    assert col(spark, raw, text.confidence) == expected


def test_scores(spark):
    rows = spark.createDataFrame([("A", "R", "B", "x", 1.0), ("A", "R", "B", "y", 0.5), ("A", "R", "C", "x", 1.0)], "head string, relation string, tail string, source string, confidence double")
    got = {r["tail"]: r for r in fusion.fuse(rows, {"x": 1.2, "default": 1.0}, allow_multi=["S"]).collect()}
    b, c = got["B"], got["C"]
    assert (b["frequency"], b["source_score"], b["confidence"], b["edge_score"], b["conflict"], b["sources"]) == (2, pytest.approx(1.1), 0.75, 0.9, True, ["x", "y"])
    assert (c["frequency"], c["source_score"], c["edge_score"], c["conflict"]) == (1, 1.2, 0.85, True)
    assert not any(r["conflict"] for r in fusion.fuse(rows, allow_multi=["R"]).collect())
    assert [tuple(r) for r in fusion.conflicts(rows, []).collect()] == [("A", "R", ["B", "C"], ["x", "y"])]


def test_alias_linking(spark):
    names = spark.createDataFrame([("糖尿病(DM)",), ("糖尿病",), ("DM",)], "name string")
    canonical = linking.canonical_names(names)
    assert {r["name"]: r["canonical"] for r in canonical.collect()} == {"糖尿病": "dm", "dm": "dm"}
    rows = spark.createDataFrame([("糖尿病", "R", "糖尿病(DM)"), ("", "R", "x")], "head string, relation string, tail string")
    # the bracketed name itself is not registered, so it stays
    assert [(r["head"], r["tail"]) for r in linking.canonicalize(rows, canonical).collect()] == [("dm", "糖尿病(dm)")]


def test_fuzzy_linking_matches_all_pairs(spark):
    import random

    rng = random.Random(1)
    names = set()
    for _ in range(25):
        base = "".join(rng.choice("abcdefg ") for _ in range(rng.randint(1, 24))).strip()
        for _ in range(4):
            s = list(base)
            for _ in range(rng.randint(0, 2)):
                s.insert(rng.randint(0, len(s)), rng.choice("abcdefg"))
            names.add(" ".join("".join(s).split()))
    names = sorted(n for n in names if n)
    for t in (80.0, 90.0, 100.0):
        got = {tuple(r) for r in linking.similar_edges(spark.createDataFrame([(n,) for n in names], "name string"), t).collect()}
        assert got == {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if text.indel_ratio(a, b) >= t}


def test_indel_ratio():
    assert text.indel_ratio("kitten", "sitting") == pytest.approx(200 * 4 / 13) and text.indel_ratio("", "") == 100 and text.indel_ratio("abc", "") == 0


def test_giant_components(spark):
    """A star, a chain and a bush of 100,000 nodes in all."""
    star = spark.range(1, 40_000).selectExpr("0L AS src", "id AS dst")
    chain = spark.range(50_000, 80_000).selectExpr("id + 1 AS src", "id AS dst")
    bush = spark.range(100_001, 130_000).selectExpr("id AS src", "100000 + (id - 100000) div 7 AS dst")
    edges = star.union(chain).union(bush)
    got = components.connected_components(edges).groupBy("component").count().collect()
    assert {tuple(r) for r in got} == {(0, 40_000), (50_000, 30_001), (100_000, 30_000)}


def test_lookups(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2] * 3 + [3, None])], "k long, i long")
    table = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k long, v string")
    for how in ("left", "inner"):
        got = {(r["k"], r["i"], r["v"]) for r in runtime.looked_up(rows, table, "k", how).collect()}
        names = {1: "a", 2: "b"}
        assert got == {(r["k"], r["i"], names.get(r["k"])) for r in rows.collect() if how == "left" or r["k"] in names}


def test_a_key_of_most_rows_is_split(spark):
    """The lookup of a key that nine rows of ten have is done by more than one task."""
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 40_000, 1, 8).selectExpr("CASE WHEN id % 10 = 0 THEN id ELSE 7 END AS k", "id")
        table = spark.range(0, 40_000, 10).selectExpr("id AS k", "id AS v").union(spark.range(7, 8).selectExpr("id", "id"))
        done = runtime.looked_up(rows, table, "k", "left").select("k", "v", F.spark_partition_id().alias("task"))
        hot = {r["task"]: r["count"] for r in done.filter("k = 7").groupBy("task").count().collect()}
        assert sum(hot.values()) == 36_000 and len(hot) > 1
        assert done.filter("v is null").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_stored_frames_can_be_removed(spark):
    one = runtime.stored(spark.range(3), "x")
    path = Path(one.stored_at.removeprefix("file://"))
    assert path.is_dir() and one.count() == 3
    runtime.removed(one, spark.range(1))
    assert not path.exists()


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 3)]
    got = dict(tuple(r) for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 160)} == {100} and got[200] == 200
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_conversion(spark, tmp_path):
    (tmp_path / "d.csv").write_text('感冒[疾病],症状,"咳嗽, 痰"\n感冒[疾病],常用药品, 甲 乙  甲\n头痛[症状],可能疾病,感冒[疾病]\n感冒[疾病],简介,第一\n感冒[疾病],简介,第二\nx,y\n感冒,未知,z\n', encoding="gb18030")
    (tmp_path / "m.csv").write_text("﻿name,symptom,desc,check\n感冒,\"['发热', '', 3]\",说明,\n,\"['a']\",b,\n感冒,\"['头痛']\",,[oops\n", encoding="utf-8")
    assert files.detect_encoding(spark, str(tmp_path / "d.csv")) == "gb18030"
    eav = convert.eav_triples(files.read_eav(spark, str(tmp_path / "d.csv")))
    got = {(r["head"], r["relation"], r["tail"], r["head_type"], r["tail_type"]) for r in eav.collect()}
    assert got == {("感冒", "HAS_SYMPTOM", "咳嗽, 痰", "Disease", "Symptom"), ("感冒", "COMMON_DRUG", "甲", "Disease", "Drug"), ("感冒", "COMMON_DRUG", "乙", "Disease", "Drug"), ("感冒", "HAS_SYMPTOM", "头痛", "Disease", "Symptom"), ("感冒", "PROP_DESC", "第一", "Disease", "Text")}
    wide = convert.wide_triples(files.read_wide(spark, str(tmp_path / "m.csv")))
    assert {(r["relation"], r["tail"]) for r in wide.collect()} == {("HAS_SYMPTOM", "发热"), ("PROP_DESC", "说明"), ("HAS_SYMPTOM", "头痛")}
    both = convert.union_first_wins([eav, wide]).collect()
    assert len(both) == 6 and [r["source"] for r in both if r["tail"] == "头痛"] == ["CM3KG_DiseaseCSV"] and [r["tail"] for r in both if r["is_property"]] == ["第一"]
    assert convert.union_first_wins([eav, wide], limit=2).filter("not is_property").count() == 2


def test_triple_readers(spark, tmp_path):
    row = {"head": "a", "relation": "R", "tail": "b", "confidence": "abc"}
    (tmp_path / "t.jsonl").write_text(json.dumps(row) + "\n\n" + json.dumps({"head": "c", "tail": "d"}) + "\n")
    (tmp_path / "t.json").write_text(json.dumps(row))
    (tmp_path / "t.csv").write_text("head,tail,confidence\nx,y,0.5\n")
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    got = files.read_triples(spark, str(tmp_path / "t.jsonl")).orderBy("seq").collect()
    assert [(r["head"], r["relation"], r["source"], r["confidence"]) for r in got] == [("a", "R", "unknown", 1.0), ("c", "RELATED_TO", "unknown", 1.0)]
    assert files.read_triples(spark, str(tmp_path / "t.json")).count() == 1
    assert files.read_triples(spark, str(tmp_path / "t.csv")).first()["confidence"] == 0.5
    with pytest.raises(ValueError):
        files.read_triples(spark, str(tmp_path / "t.xml"))
    assert files.read_triples(spark, str(tmp_path / "t.xml"), strict=False).count() == 0
    with pytest.raises(Exception):  # noqa: B017
        files.read_triples(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "my doc.txt").write_text("one\ntwo")
    assert tuple(files.read_texts(spark, str(tmp_path / "my doc.txt")).first()) == ("my doc", "one\ntwo")
    (tmp_path / "labels.jsonl").write_text('{"text": "ab", "labels": ["B-DIS", "i-dis"]}\n{"text": "ab", "labels": "O  x-y"}\n{"text": "abc", "labels": ["O"]}\nnope\n{"text": "", "labels": []}\n')
    assert [r["labels"] for r in files.read_label_sequences(spark, str(tmp_path / "labels.jsonl")).collect()] == [["B-dis", "I-dis"], ["O", "O"]]
    (tmp_path / "eval.jsonl").write_text('{"question": "q", "intent": "i", "gold_answers": ["a"]}\n{"question": "q"}\nnope\n')
    assert files.read_eval_set(spark, str(tmp_path / "eval.jsonl")).count() == 1


def test_label_inference_default(spark):
    row = graph.label_inference(spark.createDataFrame([("a", "COMPLICATION", "b")], "head string, relation string, tail string")).first()
    assert (row["src_label"], row["rel_type"], row["dst_label"]) == ("Entity", "RELATED_TO", "Entity")


def test_upsert(spark, tmp_path):
    fused = "head string, relation string, tail string, sources array<string>, confidence double, frequency int, edge_score double, conflict boolean, seq long"
    rows = [("d", "HAS_SYMPTOM", "s", ["x", "y"], 1.0, 2, 0.9, False, 0), ("d", "WEIRD", "s", ["x"], 1.0, 1, 0.5, False, 1), ("d", "OTHER", "s", ["z"], 0.5, 1, 0.4, False, 2),
            ("d", "PROP_DESC", "ab", ["x"], 1.0, 1, 0.1, False, 3), ("d", "PROP_DESC", "abcd", ["x"], 1.0, 1, 0.1, False, 4), ("d", "PROP_DESC", "wxyz", ["x"], 1.0, 1, 0.1, False, 5), ("", "WEIRD", "s", ["x"], 1.0, 1, 0.1, False, 6)]
    empty = graph.Graph(spark.createDataFrame([], schemas.NODES), spark.createDataFrame([], schemas.EDGES))
    once = empty.upsert_triples(spark.createDataFrame(rows, fused), spark.createDataFrame([("d", ["d", "dd"])], "canonical string, aliases array<string>"), now="2024-01-01 00:00:00")
    nodes = {(r["label"], r["name"]): r for r in once.nodes.collect()}
    assert set(nodes) == {("Disease", "d"), ("Symptom", "s"), ("Entity", "d"), ("Entity", "s")}
    # a property creates its node first, without aliases
    assert nodes["Entity", "d"]["props"] == {"desc": "abcd"} and nodes["Entity", "d"]["aliases"] is None and nodes["Disease", "d"]["aliases"] == ["d", "dd"] and nodes["Symptom", "s"]["aliases"] == ["s"]
    edges = {r["rel_type"]: r for r in once.edges.collect()}
    assert set(edges) == {"HAS_SYMPTOM", "RELATED_TO"} and edges["RELATED_TO"]["source"] == "z" and edges["HAS_SYMPTOM"]["source"] == "x,y" and edges["HAS_SYMPTOM"]["predicted"] is False
    twice = once.upsert_triples(spark.createDataFrame(rows, fused), now="2024-02-01 00:00:00")
    assert twice.nodes.count() == 4 and twice.edges.count() == 2 and graph.duplicate_keys(twice.nodes).count() == 0
    again = {(r["label"], r["name"]): r for r in twice.nodes.collect()}
    assert again["Disease", "d"]["aliases"] == ["d", "dd"] and again["Disease", "d"]["created_at"].month == 1 and again["Disease", "d"]["updated_at"].month == 2 and again["Entity", "d"]["props"] == {"desc": "abcd"}
    files.write_report(spark, "# one\ntwo", str(tmp_path / "reports"), "1")
    assert files.read_texts(spark, str(tmp_path / "reports" / "latest_report")).first()["text"].strip() == "# one\ntwo"
    files.write_graph(twice.nodes, twice.edges, str(tmp_path / "g"))
    nodes_, edges_ = files.read_graph(spark, str(tmp_path / "g"))
    assert (nodes_.count(), edges_.count()) == (4, 2)
    assert twice.clear().nodes.count() == 0 and tuple(twice.stats().first()) == (4, 2)


def test_search_order(spark):
    g = graph.Graph(nodes_of(spark, [("D", n, None) for n in ("xa", "a", "xya")] + [("D", "zzz", ["bA"])]), edges_of(spark, []))
    assert [r["name"] for r in g.search("A").collect()] == ["a", "xa", "xya", "zzz"]
    assert g.node("xa").first()["name"] == "xa" and g.search("A", "Other").count() == 0


@pytest.fixture(scope="module")
def medical(spark):
    edges = [("Disease", d, "HAS_SYMPTOM", "Symptom", x, 0.5) for d, xs in (("d1", "abc"), ("d2", "abcx"), ("d3", "ab")) for x in xs]
    edges += [("Disease", "d1", "RECOMMENDED_DRUG", "Drug", "m", None), ("Disease", "d1", "NEEDS_EXAM", "Exam", "e", 0.1), ("Exam", "e", "HAS_INDICATOR", "Indicator", "i", 0.1), ("Exam", "e", "HAS_INDICATOR", "Indicator", "j", 0.1)]
    edges += [(None, "m", "RELIEVES", None, "a", None), (None, "d1", "MONITORS_INDICATOR", None, "j", None), ("Drug", "m", "CONTRAINDICATED_FOR", "Disease", "d1", 0.3), ("Disease", "d2", "RELATED_DISEASE", "Disease", "d1", None)]
    names = {(e[0], e[1]) for e in edges if e[0]} | {(e[3], e[4]) for e in edges if e[3]}
    return graph.Graph(nodes_of(spark, [(k, n, ["D-ONE"] if n == "d1" else None) for k, n in sorted(names)]), edges_of(spark, edges))


def test_rules(spark, medical):
    got = {(r["rule_id"][:2], r["head"], r["relation"], r["tail"], r["via"], r["confidence"]) for r in rules.run_rules(medical).collect()}
    assert got == {
        ("r1", "m", "RELIEVES", "b", "d1", 0.6), ("r1", "m", "RELIEVES", "c", "d1", 0.6), ("r2", "d1", "RELATED_DISEASE", "d2", None, 0.5),
        ("r3", "d1", "MONITORS_INDICATOR", "i", "e", 0.7), ("r4", "m", "POSSIBLE_CONTRAINDICATION", "d2", "d1", 0.4),
    }
    assert {r["rule_id"][:2] for r in rules.run_rules(medical, max_inferences=2).collect()} == {"r1"}
    own = rules.Rule("mine", "SELECT src AS head, dst AS tail FROM edges WHERE rel_type = 'RELIEVES'", "HELPS")
    assert [(r["relation"], r["confidence"]) for r in rules.run_rules(medical, [own]).collect()] == [("HELPS", 0.5)]
    written = rules.write_predictions(medical, rules.run_rules(medical), "c1")
    again = rules.write_predictions(written, rules.run_rules(medical), "c2")
    assert written.edges.filter("predicted").count() == again.edges.filter("predicted and change_id = 'c2'").count() == again.edges.filter("predicted").count()
    assert {r["answer"] for r in rules.inferred_for(written, "d1").collect()} == {"d2", "i"}


def test_questions(spark, medical):
    assert tuple(col(spark, "糖尿病有哪些症状？", qa.intent_of)) == ("disease_to_symptom", "糖尿病")
    assert tuple(col(spark, "什么是冠心病？", qa.intent_of)) == ("unknown", "")
    assert tuple(col(spark, "什么药可以治疗感冒", qa.intent_of)) == ("drug_to_disease", "感冒")
    assert col(spark, "？？ ab 糖尿病1 xyz!", qa.longest_token) == "糖尿病1"
    reply = qa.ask(medical, "d1有哪些症状？")
    assert (reply.intent, reply.entity, [a["answer"] for a in reply.answers]) == ("disease_to_symptom", "d1", ["a", "b", "c"])
    assert len(reply.nodes) == 4 and reply.edges[0] == {"source": "d1", "target": "a", "relation": "HAS_SYMPTOM"}
    assert [a["score"] for a in qa.ask(medical, "d-one吃什么药？").answers] == [1.0]
    assert qa.ask(medical, "什么是冠心病？").answers == []
    gold = evaluate.gold_set(medical, 50)
    results = qa.ask_batch(medical, gold, 10)
    scored = evaluate.with_set_metrics(results.withColumn("executable", F.lit(True)).withColumn("latency_ms", F.lit(3)))
    o = evaluate.overall(scored).first()
    assert o["total_samples"] == gold.count() > 5 and o["coverage"] == o["accuracy_at_1"] == o["avg_f1"] == 1.0
    assert "| samples |" in evaluate.report(scored, "now")


def test_nodes_meant_are_those_named(spark):
    import random

    rng = random.Random(2)
    name = lambda n: "".join(rng.choice("abAB 病") for _ in range(n))
    nodes = [(name(rng.randint(1, 7)), rng.choice("XY"), [name(2)] if rng.random() < 0.5 else None) for _ in range(150)]
    entities = sorted({(name(rng.randint(1, 4)), rng.choice("XY")) for _ in range(60)})
    n, e = spark.createDataFrame(nodes, "key string, key_label string, aliases array<string>"), spark.createDataFrame(entities, "entity string, key_label string")
    plain = e.join(n, "key_label").filter(qa.named(F.col("key"), F.col("aliases"), F.col("entity"))).select("entity", "key_label", "key").distinct()
    assert sorted(map(tuple, qa.nodes_meant(e, n).collect())) == sorted(map(tuple, plain.collect())) != []


def test_versions(spark, medical):
    v = versioning.VersionedGraph.of(medical)
    change, v = v.begin("me", "why", change_id="c1", now="2024-01-01 00:00:00")
    with pytest.raises(ValueError):
        v.begin("me", "again", change_id="c1")
    triple = "head string, relation string, tail string, confidence double, source string, seq long"
    rows = [("d1", "HAS_SYMPTOM", "a", 1.0, "x", 0), ("d1", "HAS_SYMPTOM", "a", 0.5, "x", 1), ("new", "LIKES", "d1", 1.0, "x", 2), ("d1", "bad name", "a", 1.0, "x", 3), ("", "LIKES", "a", 1.0, "x", 4)]
    v = v.upsert(spark.createDataFrame(rows, triple), change, now="2024-01-02 00:00:00")
    own = v.graph.edges.filter("change_id = 'c1'")
    assert sorted((r["src"], r["revision"]) for r in own.collect()) == [("d1", 1), ("d1", 2), ("new", 1)]
    assert v.graph.nodes.filter("label is null").count() == 1 and v.audit_events("c1").count() == 3
    nothing = v.upsert(spark.createDataFrame(rows, triple), "unknown")
    assert nothing.graph.edges.count() == v.graph.edges.count() and nothing.graph.nodes.count() == v.graph.nodes.count()
    assert [(r["change_id"], r["event_count"]) for r in v.list_changesets().collect()] == [("c1", 3)]
    count, after = v.rollback("c1", now="2024-01-03 00:00:00")
    assert count == 3 and after.graph.edges.filter("change_id = 'c1' and active").count() == 0 and after.changesets.first()["status"] == "rolled_back"
    assert after.events.filter("rolled_back").count() == 3 and v.rollback("none")[0] == 0
    assert [r["revision"] for r in after.history("d1").collect()] == [1, 2]
    assert after.history("i").collect()[0]["change_id"] is None and after.history("nobody").count() == 0


@pytest.mark.parametrize(
    ("gold", "predicted", "expected"),
    [(["a", "b"], ["A", "c"], (0.5, 0.5, 0.5, True)), ([], [], (1, 1, 1, False)), ([], ["a"], (0, 0, 0, False)), (["a"], [], (0, 0, 0, False)), (["a", "a"], ["b", " a "], (0.5, 1.0, 2 / 3, False))],
)
def test_set_metrics(spark, gold, predicted, expected):
    row = evaluate.with_set_metrics(spark.createDataFrame([(gold, predicted)], "gold_answers array<string>, predicted array<string>")).first()
    assert (row["precision"], row["recall"], row["f1"], row["exact_match"]) == (pytest.approx(expected[0]), pytest.approx(expected[1]), pytest.approx(expected[2]), expected[3])


@pytest.mark.parametrize(("latencies", "expected"), [([1, 2, 3, 4], (3, 4)), ([5], (5, 5)), ([], (0, 0)), (list(range(100)), (50, 95))])
def test_percentiles(spark, latencies, expected):
    assert tuple(evaluate.latency_percentiles(spark.createDataFrame([(x,) for x in latencies], "latency_ms long")).first()) == expected


def test_label_spans(spark):
    sequence = "B-dis I-dis O I-sym B-sym I-dis".split()
    rows = spark.createDataFrame([("k", i, x) for i, x in enumerate(sequence)], "key string, pos long, label string")
    spans = labels.bio_spans(rows)
    assert sorted(tuple(r)[1:] for r in spans.collect()) == [(0, 1, "dis"), (3, 3, "sym"), (4, 4, "sym"), (5, 5, "dis")]
    half = spans.filter("start < 4")
    assert tuple(labels.span_scores(spans, half).first()) == (1.0, 0.5, pytest.approx(2 / 3))
    assert [col(spark, x, labels.normalize_label) for x in ("b-DIS", "X-dis", "B-none", None, "O", "dis")] == ["B-dis", "O", "O", "O", "O", "O"]
    train, valid = labels.split_rows(rows, "label", 0.5)
    assert train.count() + valid.count() == 6 and labels.split_rows(rows, "label", 0)[1].count() == 0


def test_spans(spark):
    kind = "spans array<struct<text:string,start:int,end:int,label:string,score:double>>"
    rows = spark.createDataFrame([([("abc", 0, 3, "Disease", 1.0), ("a", 0, 1, "Body", 1.0), ("de", 3, 5, "Symptom", 1.0)],)], kind)
    assert [s["label"] for s in rows.select(extract.remove_overlaps(F.col("spans"), ["Disease", "Body", "Symptom"])).first()[0]] == ["Disease", "Symptom"]
    rows = spark.createDataFrame([([("cd", 3, 4, "X", 0.6), ("ab", 0, 2, "X", 0.8)],)], kind)
    assert [tuple(s) for s in rows.select(extract.merge_adjacent(F.col("spans"))).first()[0]] == [("abcd", 0, 4, "X", pytest.approx(0.7))]
    found = spark.createDataFrame([("糖尿病人发热咳嗽",), (None,)], "text string")
    words = {"Disease": ["糖尿", "糖尿病"], "Symptom": ["发热", "咳嗽"]}
    got = found.select(extract.dictionary_spans(F.col("text"), words)).collect()
    assert [(s["text"], s["start"], s["label"]) for s in got[0][0]] == [("糖尿病", 0, "Disease"), ("发热", 4, "Symptom"), ("咳嗽", 6, "Symptom")] and got[1][0] == []
    table = spark.createDataFrame([(k, n) for k, ns in words.items() for n in ns], "label string, name string")
    joined = extract.joined_spans(found.filter("text is not null").withColumn("text_id", F.lit(1)), table).first()["spans"]
    assert [tuple(s) for s in joined] == [tuple(s) for s in got[0][0]]
    pairs = found.select(extract.label_pairs(extract.dictionary_spans(F.col("text"), words))).first()[0]
    assert [(p["first"]["text"], p["second"]["text"]) for p in pairs] == [("糖尿病", "发热"), ("糖尿病", "咳嗽")]


def test_relations(spark):
    texts = spark.createDataFrame([("f", "糖尿病的症状有多饮、多尿")], "source string, text string")
    got = {(r["head"], r["relation"], r["tail"]) for r in extract.extracted_triples(texts).collect()}
    assert {("糖尿病", "HAS_SYMPTOM", "有多饮"), ("糖尿病", "HAS_SYMPTOM", "多尿")} <= got or {("糖尿病", "HAS_SYMPTOM", "多饮"), ("糖尿病", "HAS_SYMPTOM", "多尿")} <= got
    names = {"症状": "HAS_SYMPTOM"}
    assert [col(spark, x, lambda c: extract.map_relation(c, names)) for x in ("症状", "HAS_SYMPTOM", "else")] == ["HAS_SYMPTOM", "HAS_SYMPTOM", None]
    assert [col(spark, x, lambda c: extract.map_label(c, {"dis": "Disease"}, {"DRUG": "Drug"})) for x in ("B-dis", "I-drug", "?")] == ["Disease", "Drug", "Entity"]


def test_streaming_ingest(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps({"head": "A", "relation": "R", "tail": t, "source": s, "confidence": c}) for t, s, c in (("B", "x", "1.0"), ("B", "y", "0.5"), ("C", "x", "1.0"))))
    run = lambda: ingest.ingest(ingest.triple_stream(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    run()
    (folder / "b.json").write_text(json.dumps({"head": "A", "relation": "R", "tail": "C", "source": "x", "confidence": "0.5"}))
    run()
    got = {r["tail"]: (r["frequency"], r["confidence"]) for r in ingest.fused_so_far(spark, str(tmp_path / "out")).collect()}
    assert got == {"B": (2, 0.75), "C": (2, 0.75)}


TRIPLE = "head string, relation string, tail string, source string, confidence double, seq long"


def test_build_and_fused_files(spark, tmp_path):
    """Edges come in the order of scores, the lowest last; a re-read file gives the same graph; a second build merges into the first."""
    rows = [("糖尿病(DM)", "HAS_SYMPTOM", "多尿", "x", 1.0, 0), ("糖尿病", "CAUSES", "肾病", "x", 1.0, 1), ("DM", "CAUSES", "肾病", "y", 1.0, 2), ("糖尿病", "AFFECTS_BODY", "肾病", "x", 0.5, 3), ("糖尿病", "PROP_DESC", "ab", "x", 1.0, 4), ("dm", "PROP_DESC", "abcd", "x", 1.0, 5)]
    made = build.build(spark.createDataFrame(rows, TRIPLE))
    order = [r["relation"] for r in made.fused.filter("tail = '肾病'").orderBy("seq").collect()]
    assert order == ["CAUSES", "AFFECTS_BODY"]
    edges = {(r["src"], r["rel_type"], r["dst"]): r["frequency"] for r in made.graph.edges.collect()}
    assert edges == {("糖尿病(dm)", "HAS_SYMPTOM", "多尿"): 1, ("dm", "RELATED_TO", "肾病"): 1}
    nodes = {(r["label"], r["name"]): (r["aliases"], r["props"]) for r in made.graph.nodes.collect()}
    assert nodes["Entity", "dm"] == (None, {"desc": "abcd"}) and nodes["Disease", "糖尿病(dm)"] == (["糖尿病(dm)"], {}) and nodes["Entity", "肾病"][0] == ["肾病"]
    files.write_fused(made.fused, str(tmp_path / "fused"), "2024-01-01")
    again = build.empty_graph(spark).upsert_triples(files.read_fused(spark, str(tmp_path / "fused")))
    assert {(r["src"], r["rel_type"], r["dst"], r["edge_score"]) for r in again.edges.collect()} == {(r["src"], r["rel_type"], r["dst"], r["edge_score"]) for r in made.graph.edges.collect()}
    more = build.build(spark.createDataFrame([("dm", "CAUSES", "肾病", "z", 0.1, 0)], TRIPLE), onto=made.graph)
    assert more.graph.edges.count() == 2 and {r["source"] for r in more.graph.edges.filter("dst = '肾病'").collect()} == {"z"}


def test_writers(spark, tmp_path):
    raw = spark.createDataFrame([("a", "R", "b", "x", 0.5, 0), ("a", "R", "c", "y", 1.0, 1)], TRIPLE)
    files.write_triples(raw, str(tmp_path / "raw.jsonl"))
    assert {(r["head"], r["tail"], r["confidence"]) for r in files.read_triples(spark, str(tmp_path / "raw.jsonl")).collect()} == {("a", "b", 0.5), ("a", "c", 1.0)}
    files.write_conflicts(fusion.conflicts(raw, []), str(tmp_path / "conflicts"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "conflicts")).select("head", "relation", "tails", "sources").collect()] == [("a", "R", ["b", "c"], ["x", "y"])]
    files.write_eval_set(spark.createDataFrame([("q?", "i", "e", ["g"])], "question string, intent string, entity string, gold_answers array<string>"), str(tmp_path / "eval"))
    assert [tuple(r) for r in files.read_eval_set(spark, str(tmp_path / "eval")).collect()] == [("q?", "i", ["e"], ["g"])]


def test_ontology_and_settings(tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"entity_types": [{"id": "Disease", "aliases": ["d", "病"]}], "relation_types": [{"id": "TREATS", "aliases": ["治"]}]}), encoding="utf-8")
    assert files.read_ontology(str(tmp_path / "o.json")) == ({"d": "Disease", "D": "Disease", "病": "Disease"}, {"治": "TREATS"})
    assert files.read_ontology(str(tmp_path / "none.json")) == ({}, {})
    (tmp_path / "s.json").write_text(json.dumps({"fusion": {"enable_fuzzy": False, "fuzzy_threshold": 80, "source_weights": {"x": 2.0}, "scoring": {"source_weight": 0.1}}}))
    assert files.read_settings(str(tmp_path / "s.json")) == {"weights": {"x": 2.0}, "source_weight_": 0.1}


def test_models_with_thresholds_and_fallbacks(spark):
    def ner(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError
        return [[{"word": "##感", "start": 0, "end": 1, "label": "B-DIS", "score": 0.9}, {"word": "冒", "start": 1, "end": 2, "label": "I-DIS", "score": 0.7}, {"word": "咳", "start": 4, "end": 5, "label": "B-SYM", "score": 0.8}, {"word": "x", "start": 9, "end": 10, "label": "B-SYM", "score": 0.2}] for _ in texts]

    names = {"DIS": "Disease", "SYM": "Symptom"}
    spans = extract.model_spans(ner, lambda x: extract.map_label(x, {}, names), 0.5, lambda t: extract.dictionary_spans(t, {"Drug": ["bad"]}))
    texts = spark.createDataFrame([("s1", "感冒引起咳"), ("s2", "a bad text"), ("s3", "")], "source string, text string").repartition(3, "source")
    got = {r["source"]: [tuple(s) for s in r["spans"]] for r in extract.with_spans(texts, spans).collect()}
    if len(got["s1"]) == 2:  # texts in one batch share its fate
        assert got["s1"] == [("感冒", 0, 2, "Disease", pytest.approx(0.8)), ("咳", 4, 5, "Symptom", 0.8)]
    assert got["s2"] == [("bad", 2, 5, "Drug", 0.85)] and got["s3"] == []
    one = texts.filter("source = 's1'")
    triples = extract.model_triples(one, spans, lambda asked: [("引起", 0.6 if a == "感冒[SEP]咳[SEP]感冒引起咳" else 0.1) for a in asked], {"引起": "CAUSES"})
    assert [(r["head"], r["relation"], r["tail"], r["head_type"], r["confidence"], r["source"]) for r in triples.collect()] == [("感冒", "CAUSES", "咳", "Disease", 0.6, "s1")]
    assert extract.model_triples(one, spans, lambda asked: [("引起", 0.4)] * len(asked), {"引起": "CAUSES"}).count() == 0
    raw = spark.createDataFrame([("感冒", "CAUSES", "咳", "t", 1.0, 0)], TRIPLE)
    both = extract.appended(raw, triples)
    assert [r["source"] for r in both.orderBy("seq").collect()] == ["t", "s1"] and fusion.fuse(both).first()["frequency"] == 2


def test_failing_rules_are_left_out(spark):
    edges = edges_of(spark, [("Disease", "d1", "R", "Symptom", "s1", 1.0)])
    own = [rules.Rule("good", "select src as head, dst as tail from {edges}", "X"), rules.Rule("bad", "select nothing as head from {edges}", "Y")]
    failed = {}
    assert [r["rule_id"] for r in rules.run_rules(graph.Graph(nodes_of(spark, []), edges), own, failed=failed).collect()] == ["good"] and list(failed) == ["bad"]
    assert rules.run_rules(graph.Graph(nodes_of(spark, []), edges), own[1:], failed={}).count() == 0
    with pytest.raises(Exception, match="nothing"):
        rules.run_rules(graph.Graph(nodes_of(spark, []), edges), own)


def test_cooccurrence_in_blocks(spark):
    pairs = spark.createDataFrame([(f"s{i}", d) for i in range(23) for d in ("a", "b") if d == "a" or i % 2], "src string, dst string")
    wanted = {tuple(r) for r in rules.cooccurrence(pairs, 1).collect()}
    assert len(wanted) == 23 * 22 // 2 and {tuple(r) for r in rules.cooccurrence(pairs, 1, block=4).collect()} == wanted
    assert rules.cooccurrence(pairs, 2, block=3).count() == 11 * 10 // 2


def test_percentiles_of_any_values(spark):
    import random

    rng = random.Random(3)
    for values in ([1, 2, 3, 4], [7] * 9, [5], [rng.randint(-5, 10**6) for _ in range(500)], [0] * 50 + [10**9] * 3 + [1]):
        rows = spark.createDataFrame([(v,) for v in values], "latency_ms long")
        ranked = sorted(values)
        at = lambda q: ranked[min(int(len(ranked) * q), len(ranked) - 1)]
        assert tuple(evaluate.latency_percentiles(rows).first()) == (at(0.5), at(0.95))
    assert tuple(evaluate.latency_percentiles(spark.createDataFrame([], "latency_ms long")).first()) == (0, 0)


def test_exact_split(spark):
    rows = spark.range(101).withColumn("x", F.lit("a"))
    train, valid = labels.split_rows(rows, "id", 0.2)
    assert train.columns == rows.columns and train.count() == 80 and valid.count() == 21
    assert {r["id"] for r in train.collect()} | {r["id"] for r in valid.collect()} == set(range(101))
    for n, share in ((1, 0.5), (3, 0.01), (5, 0.0), (5, 1.0)):
        train, valid = labels.split_rows(spark.range(n), "id", share)
        assert (train.count(), valid.count()) == ((n, 0) if n < 2 or share in (0.0, 1.0) else (int(n * (1 - share)), n - int(n * (1 - share))))


def test_definitions_in_batch(spark):
    nodes = nodes_of(spark, [("Disease", "感冒", ["伤风"]), ("Drug", "感冒灵", None), ("Symptom", "咳嗽", None)])
    edges = edges_of(spark, [("Disease", "感冒", "HAS_SYMPTOM", "Symptom", "咳嗽", 0.5)])
    g = graph.Graph(nodes, edges)
    asked = spark.createDataFrame([(1, "介绍一下感冒"), (2, "伤风有哪些症状？"), (3, "哪些疾病会出现咳嗽的症状？"), (4, "hello")], "question_id long, question string")
    got = {r["question_id"]: (r["intent"], r["entity"], r["predicted"]) for r in qa.ask_batch(g, qa.understood(g, asked)).collect()}
    assert got == {1: ("entity_definition", "感冒", ["感冒"]), 2: ("disease_to_symptom", "感冒", ["咳嗽"]), 3: ("symptom_to_disease", "咳嗽", ["感冒"]), 4: ("unknown", "hello", [])}


def test_plans(spark, tmp_path):
    """One scan of the edges for a batch of questions."""
    edges_of(spark, [("Disease", "a", "HAS_SYMPTOM", "Symptom", "b", 1.0)]).write.parquet(str(tmp_path / "edges"))
    g = graph.Graph(nodes_of(spark, [("Disease", "a", None)]), spark.read.parquet(str(tmp_path / "edges")))
    asked = spark.createDataFrame([(1, "disease_to_symptom", "a")], "question_id long, intent string, entity string")
    plan = qa.ask_batch(g, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("edge_score#") > 0 and plan.count("parquet") == 1

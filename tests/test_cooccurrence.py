"""Sources that share targets: against all pairs, for hubs on either side, in passes; and what goes through exchanges."""

import random
from collections import Counter
from itertools import combinations

import pytest

from trellis.operators import rules


def expected(pairs, least):
    by_target = {}
    for s, d in pairs:
        if s is not None and d is not None:
            by_target.setdefault(d, []).append(s)
    counts = Counter(tuple(sorted(p)) for members in by_target.values() for p in combinations(members, 2) if p[0] != p[1])
    return sorted((*p, n) for p, n in counts.items() if n >= least)


@pytest.mark.parametrize(("kind", "block", "most"), [("string", 1000, 10**9), ("long", 4, 500)])
def test_all_pairs(spark, monkeypatch, kind, block, most):
    monkeypatch.setattr(rules, "PASS", most)
    rng = random.Random(block)
    # a hub of targets, a source with nearly all targets, repeated rows and nulls
    pairs = [(s, d) for s in range(30) for d in range(12) if d == 0 or s == 7 or rng.random() < 0.3] + [(1, 0), (2, 0), (2, 0), (None, 0), (3, None), (99, 98)]
    if kind == "string":
        pairs = [(None if s is None else f"s{s}", None if d is None else f"d{d}") for s, d in pairs]
    frame = spark.createDataFrame(pairs, f"src {kind}, dst {kind}")
    for least in (1, 3):
        assert sorted(map(tuple, rules.cooccurrence(frame, least, block).collect())) == expected(pairs, least)


def test_none(spark):
    assert rules.cooccurrence(spark.createDataFrame([], "src string, dst string"), 1).count() == 0
    assert rules.cooccurrence(spark.createDataFrame([("a", "x"), ("b", "y")], "src string, dst string"), 1).count() == 0


def test_a_path_is_no_row_of_an_exchange(spark, monkeypatch):
    plans = []

    def noted(df, label, put=rules.stored):
        plans.extend([df._jdf.queryExecution().executedPlan().toString()] if label == "counted" else [])
        return put(df, label)

    monkeypatch.setattr(rules, "stored", noted)
    pairs = spark.createDataFrame([(f"s{s}", f"d{d}") for d in range(20) for s in range(60)], "src string, dst string")
    assert rules.cooccurrence(pairs, 1).count() == 60 * 59 // 2
    # lists are sent by their source and counted there; each path was a row of an exchange by both ends before
    assert [p.count("Exchange hashpartitioning(one#") for p in plans] == [1] and "Exchange hashpartitioning(least" not in plans[0] and plans[0].count("other#") > 0

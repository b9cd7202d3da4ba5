"""Overlapping intervals: against all pairs, and how often a row is sent."""

import datetime
import random

import pytest

from trellis.operators import temporal

DAY = datetime.datetime(2024, 1, 1)
SCHEMA = "k string, id int, valid_from timestamp, valid_to timestamp"


def rows_of(seed, n, keys):
    rng, out = random.Random(seed), []
    for i in range(n):
        start = DAY + datetime.timedelta(minutes=rng.randrange(-2000, 20_000))
        end = rng.choice([None, start, start + datetime.timedelta(minutes=1), start + datetime.timedelta(minutes=rng.randrange(1, 9000)), start - datetime.timedelta(minutes=5)])
        out.append((rng.choice(keys), i, rng.choice([start, start, start, None]), end))
    return out


def made_by_generators(df):
    """Rows that the explodes of a plan made when it ran."""
    df.collect()

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        own = node.metrics().apply("numOutputRows").value() if name == "Generate" else 0
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize(("block", "keys"), [(1, ["a"]), (3, ["a", "b", None]), (128, ["a", "b"])])
def test_all_pairs(spark, monkeypatch, block, keys):
    monkeypatch.setattr(temporal, "BLOCK", block)
    left, right = rows_of(1, 150, keys), rows_of(2, 120, [*keys, "other"])
    got = temporal.overlapping(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["k"]).select("k", "l.id", "r.id").collect()
    good = lambda r: r[0] is not None and r[2] is not None and (r[3] is None or r[3] > r[2])
    end = lambda r: r[3] or datetime.datetime.max
    expected = [(a[0], a[1], b[1]) for a in filter(good, left) for b in filter(good, right) if a[0] == b[0] and a[2] < end(b) and b[2] < end(a)]
    assert sorted(map(tuple, got)) == sorted(expected) and expected


def test_an_open_interval_is_sent_once_for_each_block(spark):
    rows = spark.createDataFrame([(str(k), i, DAY + datetime.timedelta(hours=7 * i), None) for k in range(20) for i in range(10)], SCHEMA)
    pairs = temporal.overlapping(rows, rows, ["k"])
    assert made_by_generators(pairs) <= 2 * 200 and pairs.count() == 20 * 100

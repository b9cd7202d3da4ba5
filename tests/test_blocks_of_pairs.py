"""in_blocks gives every pair of different members of a key, once, however members are dealt."""

from itertools import combinations

import pytest

from trellis.operators.linking import in_blocks


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_every_pair_once(spark, block):
    members = {k: range(n) for k, n in (("alone", 1), ("two", 2), ("some", 9), ("many", 40))}
    rows = spark.createDataFrame([(k, m, m * 10) for k, ms in members.items() for m in ms], "key string, member int, more int")
    got = in_blocks(rows, "key", "member", block, ["more"]).select("key", "a.member", "a.more", "b.member", "b.more").collect()
    assert sorted((k, *sorted((a, b))) for k, a, _, b, _ in got) == sorted((k, *p) for k, ms in members.items() for p in combinations(ms, 2))
    assert all(x == 10 * a and y == 10 * b for _, a, x, b, y in got)

"""What rules and caps read several times is stored: the tables are not joined again."""

import pytest

from trellis.plans import queries


@pytest.mark.parametrize("name", ["rule_undirected", "inference_cap", "inferred_topk_union"])
def test_tables_are_read_once(spark, name):
    read = queries.QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()
    assert read and not [f for f in read if "/testdata/" in f]

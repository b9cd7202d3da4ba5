"""Neighbours from the inverted file against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.operators import vectors
from trellis.plans import queries

SF = "/root/testdata/sf0.01"


def best(ids, x, asked, k):
    """For each query the similarity of its k-th neighbour."""
    like = x[asked] @ x.T
    like[np.arange(len(asked)), asked] = -9
    return {ids[i]: np.sort(row)[-k] for i, row in zip(asked, like, strict=True)}


def test_recall_of_the_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    least = best(ids, x, [i for i, v in enumerate(ids) if v % 20 == 0], 10)
    got = queries.QUERIES["vector_neighbours"](spark, SF).collect()
    good = sum(r["similarity"] >= least[r["vec_id"]] - 2e-6 for r in got)
    assert good / (10 * len(least)) >= 0.9
    at = {v: i for i, v in enumerate(ids)}
    for r in got[:50]:
        assert r["similarity"] == pytest.approx(float(x[at[r["vec_id"]]] @ x[at[r["neighbour"]]]), abs=2e-6) and r["vec_id"] != r["neighbour"]


def test_all_cells_are_exact_and_hot_cells_are_split(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    x[100:200] = x[100]  # copies: a hot cell
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, [0.0] * 5), (901, None)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    index = vectors.index_vectors(df, cells=8, part=10)
    assert index.parts.agg(F.max("parts")).first()[0] >= 10
    got = {}
    for r in index.neighbours(df.filter("id % 10 = 0 or id > 899"), 6, probes=8, part=3).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["id"])
    x = x.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = x.astype(np.float32).astype(float)
    like = x @ x.T
    assert set(got) == set(range(0, 300, 10))
    for i, found in got.items():
        others = sorted((j for j in range(300) if j != i), key=lambda j: (-round(like[i, j], 6), j))[:6]
        assert [round(like[i, j], 6) for j in found] == [round(like[i, j], 6) for j in others]
    assert sorted(got[110]) == [100, 101, 102, 103, 104, 105]


def test_few_and_no_vectors(spark):
    one = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<float>")
    assert vectors.index_vectors(one).neighbours(one).count() == 0
    assert vectors.index_vectors(one.limit(0)).neighbours(one.limit(0)).count() == 0

"""Nearest neighbours of vectors: an inverted file over learned centroids, exact distances within the cells that are probed.

Centroids are fitted on a bounded sample of the rows (`sample`, the smallest hashes of ids); every row is assigned to its nearest centroid
and lies in that cell. A query looks into its `probes` nearest cells and ranks all their rows by exact cosine distance. Both sides of a cell
are dealt into parts of at most about `part` rows, each part of queries meeting each part of rows, so neither a hot cell nor copies of one
vector make a large group; each meeting gives the first k of each query, and these are ranked at last. Only centroids, `cells` x dimensions
numbers, are sent to all tasks.

Vectors of zeros and null vectors have no direction: they are no one's neighbours and have none. A row is not its own neighbour; its copies
are. Ties are ranked by id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stored

#: Rows that centroids are fitted on, at most; rows of one part of a cell, about.
SAMPLE, PART = 20_000, 4_096


def _unit(v: Column) -> Column:
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(size > 0, F.transform(v, lambda x: (x / size).cast("float")))


@dataclass
class VectorIndex:
    """`rows` (id, unit, cell, part) of all vectors with a direction, and `parts` (cell, parts); `centroids` by number of cell."""

    rows: DataFrame
    parts: DataFrame
    centroids: np.ndarray

    def neighbours(self, queries: DataFrame, k: int = 10, probes: int = 8, part: int = PART) -> DataFrame:
        """(query, id, rank, similarity) for queries (id, vector): the k rows of most similar direction among the nearest `probes` cells."""
        asked = queries.select(F.col("id").alias("query"), _unit(F.col("vector")).alias("unit")).filter("unit is not null")
        asked = stored(asked.withColumn("cell", F.explode(_cells(self.centroids, probes)(F.col("unit")))), "queries")
        sizes = asked.groupBy("cell").agg(F.ceil(F.count("*") / part).cast("int").alias("asked_parts"))
        asked = asked.join(self.parts, "cell").join(sizes, "cell").withColumn("own", F.pmod(F.hash("query"), F.col("asked_parts")))
        asked = asked.select("query", "unit", "cell", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        rows = self.rows.join(sizes, "cell").select("id", "unit", "cell", F.explode(F.sequence(F.lit(0), F.col("asked_parts") - 1)).alias("own"), "part")
        kind = self.rows.schema["id"].dataType.simpleString()
        query_kind = asked.schema["query"].dataType.simpleString()
        near = asked.groupBy("cell", "part", "own").cogroup(rows.groupBy("cell", "part", "own")).applyInPandas(_first(k), f"query {query_kind}, id {kind}, similarity double")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
        return near.withColumn("rank", place).filter(F.col("rank") <= k).select("query", "id", "rank", "similarity")


def _cells(centroids: np.ndarray, n: int):
    """The n nearest cells of unit vectors, the nearest first."""
    lengths = (centroids * centroids).sum(1)

    @F.pandas_udf("array<int>")
    def nearest(units: pd.Series) -> pd.Series:
        if not len(units):
            return pd.Series([], dtype=object)
        far = lengths - 2 * np.stack(units.to_numpy()).astype(np.float64) @ centroids.T
        return pd.Series(list(np.argsort(far, axis=1, kind="stable")[:, :n].astype(np.int32)))

    return nearest


def _first(k: int):
    def run(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(rows):
            return pd.DataFrame({"query": asked["query"][:0], "id": rows["id"][:0], "similarity": np.empty(0)})
        rows = rows.sort_values("id", kind="stable")
        ids, x = rows["id"].to_numpy(), np.stack(rows["unit"].to_numpy()).astype(np.float64)
        found = []
        for at in range(0, len(asked), 512):
            own = asked["query"].to_numpy()[at : at + 512]
            like = np.stack(asked["unit"].to_numpy()[at : at + 512]).astype(np.float64) @ x.T
            like[own[:, None] == ids[None, :]] = -np.inf
            best = np.argsort(-like, axis=1, kind="stable")[:, :k]
            good = np.take_along_axis(like, best, 1)
            found.append(pd.DataFrame({"query": np.repeat(own, best.shape[1]), "id": ids[best.ravel()], "similarity": good.ravel()}))
        found = pd.concat(found)
        return found[found["similarity"] > -np.inf]

    return run


def index_vectors(vectors: DataFrame, cells: int = 256, sample: int = SAMPLE, part: int = PART, seed: int = 1) -> VectorIndex:
    """An index of `vectors` (id, vector); ids are distinct, vectors of one length."""
    rows = vectors.select("id", _unit(F.col("vector")).alias("unit")).filter("id is not null and unit is not null")
    few = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select(array_to_vector("unit").alias("features"))
    few = stored(few.withColumn("at", F.spark_partition_id()), "sample")
    n = few.count()
    if not n:
        empty = rows.select("id", "unit", F.lit(0).alias("cell"), F.lit(0).alias("part")).limit(0)
        return VectorIndex(empty, empty.select("cell", F.lit(1).alias("parts")), np.zeros((1, 1)))
    model = KMeans(k=max(2, min(cells, n)), seed=seed, maxIter=12, initSteps=1).fit(few) if n > 1 else None
    centroids = np.array(model.clusterCenters()) if model else np.array([r.features.toArray() for r in few.collect()])
    rows = stored(rows.withColumn("cell", _cells(centroids, 1)(F.col("unit"))[0]), "cells")
    parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))  # one row for each cell at most
    rows = rows.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.hash("id"), F.col("parts"))).drop("parts")
    return VectorIndex(rows, stored(parts, "parts"), centroids)

"""Approximate search: inverted lists over k-means cells, and random-hyperplane hashing.

Both can be asked for a recall: how much is probed is then read from a recall curve that
is measured against exact search on sampled rows, in one pass over the collection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import vectors as V

from . import search

#: Rows that the cells are fitted on at most; every row is assigned.
FIT_ROWS = 100_000
#: What approximate search is to find of the true neighbours.
RECALL = 0.9
#: Rows that a recall curve is measured on, and what it must exceed a stated recall by: few queries scatter.
SAMPLE, MARGIN = 200, 0.04


def sampled_truth(rows: DataFrame, k: int, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Sampled rows (id, vector) as queries (query, vector), and their exact (query, id)."""
    sample = rows.where(F.size("vector") > 0).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).select(F.col("id").alias("query"), "vector").toArrow()
    queries = rows.sparkSession.createDataFrame(sample)  # SAMPLE rows
    return queries, search.top_k(rows, queries, k).select("query", "id")


def least_effort(needed: list[float], least: int, most: int, recall: float) -> int | None:
    """The least effort, from least to most, that finds the recall and MARGIN of pairs which need the given ones."""
    needed = np.array(needed, float)
    wanted = min(1.0, recall + MARGIN)
    return next((e for e in range(least, most + 1) if not len(needed) or (needed <= e).mean() >= wanted), None)


class Cells:
    """Inverted lists: vectors by their nearest of n cells.

    save writes the rows in a folder for each cell, and the centres; load reads them, and a
    search of few queries then reads the folders of the probed cells only.
    """

    def __init__(self, rows: DataFrame | None, cells: int = 0, seed: int = 7, id_col: str = "id", vector_col: str = "vector", fit_rows: int = FIT_ROWS):
        if rows is None:
            return
        unit = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), V.normalized(F.col(vector_col)).alias("u")).where("u IS NOT NULL")
        fit_on = unit.select("id", array_to_vector("u").alias("features")).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(fit_rows)
        self.centres = np.array(KMeans(k=cells, seed=seed, maxIter=15).fit(fit_on).clusterCenters())
        self.rows = self._assigned(unit.select("id", "vector"))

    def _assigned(self, rows: DataFrame) -> DataFrame:
        """(id, vector, cell): each vector with the nearest cell of its direction."""
        centres = self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.array(b.column(1).flatten(), float).reshape(b.num_rows, -1)
                u = x / np.sqrt((x * x).sum(1, keepdims=True))
                cell = ((centres * centres).sum(1) - 2 * u @ centres.T).argmin(1) if b.num_rows else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32())], ["id", "vector", "cell"])

        kinds = dict(rows.dtypes)
        return rows.mapInArrow(run, f"id {kinds['id']}, vector {kinds['vector']}, cell int")

    def save(self, path: str) -> None:
        spark = self.rows.sparkSession
        self.rows.repartition(min(len(self.centres), 512), "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(self.centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Cells:
        out = cls(None)
        out.centres = np.array([r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()])  # a bounded number of cells
        out.rows = spark.read.parquet(f"{path}/rows").select("id", "vector", F.col("cell").cast("int").alias("cell"))
        return out

    def _order(self, q: np.ndarray) -> np.ndarray:
        """(queries x cells): cells from the nearest on."""
        c = self.centres
        with np.errstate(all="ignore"):
            cos = np.nan_to_num((q @ c.T) / np.sqrt((q * q).sum(1))[:, None] / np.sqrt((c * c).sum(1)))
        return np.argsort(-cos, axis=1, kind="stable")

    def probes_for(self, k: int, recall: float, least: int = 1) -> int:
        """The least number of cells, `least` or more, that reaches the recall on sampled rows."""
        cells = len(self.centres)
        queries, truth = sampled_truth(self.rows.select("id", "vector"), k)
        held = truth.join(self.rows.select("id", "cell"), "id").select("query", "cell").collect()  # SAMPLE x k rows
        names, q = search.query_matrix(queries, "query", "vector")
        place = {n: np.argsort(o) for n, o in zip(names.to_pylist(), self._order(q))}
        return least_effort([int(place[r["query"]][r["cell"]]) + 1 for r in held], min(least, cells), cells, recall) or cells

    def top_k(self, queries: DataFrame, k: int, probe: int, recall: float | None = None, rows: DataFrame | None = None) -> DataFrame:
        """(query, id, score, rank) of queries (query, vector): the nearest `probe` cells of each are scanned, more where a stated recall needs it.

        rows: a part of the index's rows (id, vector, cell) to search instead of all.
        """
        if recall is not None:
            probe = self.probes_for(k, recall, probe)
        kept = self.rows if rows is None else rows

        def one(names: pa.Array, q: np.ndarray, kind: str) -> DataFrame:
            near = np.zeros((len(q), len(self.centres)), bool)
            np.put_along_axis(near, self._order(q)[:, :probe], True, axis=1)
            some = near.any(0)
            part = kept if some.all() else kept.where(F.col("cell").isin(*map(int, np.flatnonzero(some))))
            # the cell rides along as the vector's last number
            part = part.select("id", F.concat("vector", F.array(F.col("cell").cast("double"))).alias("vector"))

            def scorer(x):
                cell, x = x[:, -1].astype(int), np.ascontiguousarray(x[:, :-1])
                return lambda a, z: search.scored_where(near[a:z, cell], q[a:z], x)

            return search.block_top_k(part, names, kind, scorer, q.shape[1] + 1, k)

        return search.in_blocks(kept, queries, "id", "query", "vector", k, one)


def _planes(dimension: int, n: int, seed: int = 11) -> list[list[float]]:
    import random

    r = random.Random(seed)
    return [[r.gauss(0, 1) for _ in range(dimension)] for _ in range(n)]


def flips_for(rows: DataFrame, k: int, dimension: int, tables: int, bits: int, recall: float) -> int | None:
    """The least number of neighbour buckets that reaches the recall on sampled rows (id, vector); None where all do not."""
    queries, truth = sampled_truth(rows, k)
    pairs = truth.join(F.broadcast(queries.withColumnRenamed("vector", "qv")), "query").join(rows, "id").select("qv", "vector").collect()  # SAMPLE x k rows
    planes = np.array(_planes(dimension, tables * bits)).T
    needed = []
    for p in pairs:
        mine = np.array(p["qv"], float) @ planes
        differs = ((mine > 0) != (np.array(p["vector"], float) @ planes > 0)).reshape(tables, bits)
        place = np.argsort(np.argsort(np.abs(mine), kind="stable")).reshape(tables, bits) + 1
        n = differs.sum(1)
        needed.append(0 if (n == 0).any() else min(place[differs & (n == 1)[:, None]], default=np.inf))
    return least_effort(needed, 0, tables * bits, recall)


def lsh_top_k(rows: DataFrame, queries: DataFrame, k: int, dimension: int, tables: int = 12, bits: int = 4, id_col: str = "id", vector_col: str = "vector", recall: float | None = None) -> DataFrame:
    """(query, id, score, rank): rows that share a bucket with the query in some table, ranked exactly.

    For a stated recall, buckets beyond the hyperplanes nearest to the query are probed
    too, as many as the recall curve asks for; where all are not enough, search is exact.
    Buckets are computed tile by tile; a row that is no query's candidate is not scored.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    flips = 0 if recall is None else flips_for(rows, k, dimension, tables, bits, recall)
    if flips is None:
        return search.top_k(rows, queries, k)
    planes = np.array(_planes(dimension, tables * bits)).T
    weight = 1 << np.arange(bits)

    def buckets(sides: np.ndarray) -> np.ndarray:
        return ((sides > 0).reshape(len(sides), tables, bits) * weight).sum(2)

    def one(names: pa.Array, q: np.ndarray, kind: str) -> DataFrame:
        sides = q @ planes
        own = buckets(sides)
        probed = np.zeros((len(q), tables, 1 << bits), bool)
        each = np.arange(len(q))
        for t in range(tables):
            probed[each, t, own[:, t]] = True
        for f in np.argsort(np.abs(sides), axis=1, kind="stable")[:, :flips].T:  # the f-th nearest plane of each query
            probed[each, f // bits, own[each, f // bits] ^ (1 << (f % bits))] = True

        def scorer(x):
            b = buckets(x @ planes)

            def part(a, z):
                counts = np.zeros((z - a, len(x)), bool)
                for t in range(tables):
                    counts |= probed[a:z, t][:, b[:, t]]
                return search.scored_where(counts, q[a:z], x)

            return part

        return search.block_top_k(rows, names, kind, scorer, dimension, k)

    return search.in_blocks(rows, queries, "id", "query", "vector", k, one)

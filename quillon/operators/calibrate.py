"""Calibration of the sign-bit threshold, and drift of its skip rate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_STEPS = 64


@dataclass(frozen=True)
class Plan:
    recall: float = 0.99
    precision: float = 0.005
    queries: int = 50
    k: int = 10
    seed: int = 42


def probes(rows: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """n rows as queries, in a seeded order: reruns agree, and only the best n of each partition are sorted."""
    return rows.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(n)


def spread(distances: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(query, hamming) of the k best rows of each query and (hamming, n) of all pairs, from (query, id, hamming, score) of all pairs.

    quantize.bq1_spread takes both from vectors, without the pairs.
    """
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    truth = distances.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "hamming")
    return truth, distances.groupBy("hamming").agg(F.count(F.lit(1)).alias("n"))  # one row for each distance


def curve(truth: DataFrame, bins: DataFrame, thresholds: list[float], dimension: int) -> DataFrame:
    """(threshold, recall, skip_rate) from a spread.

    A row is skipped at a threshold if its Hamming distance exceeds threshold * dimension.
    """
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    # a true row is found at a threshold unless skipped: closer rows can't push it out of the top k
    found = truth.select("query", "hamming", t).withColumn("hit", (F.col("hamming") <= F.col("threshold") * dimension).cast("int"))
    per_query = found.groupBy("threshold", "query").agg((F.sum("hit") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("r"))
    recall = per_query.groupBy("threshold").agg(F.round(F.avg("r"), 6).alias("recall"))
    skipped = bins.select("hamming", "n", t).groupBy("threshold").agg(F.round(F.sum(F.when(F.col("hamming") > F.col("threshold") * dimension, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("skip_rate"))
    return recall.join(skipped, "threshold")


def calibrated(distances: DataFrame, dimension: int, plan: Plan = Plan()) -> dict:
    """The least threshold from (query, id, hamming, score) of all pairs."""
    return calibrated_on(*spread(distances, plan.k), dimension, plan)


def calibrated_on(truth: DataFrame, bins: DataFrame, dimension: int, plan: Plan = Plan()) -> dict:
    """The least threshold, to the plan's precision, that reaches its recall; 1.0 if none does.

    Both parts of the spread are taken once, as a row for each distance and number of true
    rows of a query, and the binary search runs over them.
    """
    each = truth.groupBy("query", "hamming").agg(F.count(F.lit(1)).alias("n"))
    sizes = truth.groupBy("query").agg(F.count(F.lit(1)).alias("of"))
    held = each.join(sizes, "query").groupBy("hamming", "of").agg(F.sum("n").alias("n")).collect()  # (dimension + 1) x plan.k rows at most
    bins = bins.collect()
    queries = round(sum(r["n"] / r["of"] for r in held))

    def recall(t: float) -> float:
        return round(sum(r["n"] / r["of"] for r in held if r["hamming"] <= t * dimension) / queries, 6) if queries else 1.0

    lo, hi, steps = 0.0, 1.0, 0
    while hi - lo > plan.precision and steps < MOST_STEPS:
        mid, steps = (lo + hi) / 2, steps + 1
        if recall(mid) >= plan.recall:
            hi = mid
        else:
            lo = mid
    total = sum(r["n"] for r in bins)
    skipped = sum(r["n"] for r in bins if r["hamming"] > hi * dimension)
    return {"threshold": hi, "recall": recall(hi), "skipRate": round(skipped / total, 6) if total else 0.0, "steps": steps, "feasible": recall(hi) >= plan.recall}


#: Smoothing of the skip rate, least samples and distance of a drift, samples between two saves.
ALPHA, LEAST_SAMPLES, DRIFT, SAVE_EVERY = 0.1, 10, 0.15, 50


def smoothed(rows: DataFrame, key: str, value: str, order: list[str], alpha: float = ALPHA) -> DataFrame:
    """(key, samples, ema): each key's exponential average in order, begun at its first value.

    A fold over a key's own ordered samples.
    """
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_v"))))
    g = rows.groupBy(key).agg(ordered.alias("s"))
    fold = F.aggregate(F.slice("s", F.lit(2), F.size("s")), F.get("s", F.lit(0))["_v"], lambda a, x: x["_v"] * alpha + a * (1 - alpha))
    return g.select(key, F.size("s").alias("samples"), fold.alias("ema"))


def drifted(skip_rate: Column, ema: Column, samples: Column) -> Column:
    return (samples >= LEAST_SAMPLES) & (F.abs(skip_rate - ema) > DRIFT)

"""Embedding cache: lookup, misses, least-recently-used eviction, routing of batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import ids


def keyed(texts: DataFrame, namespace: str, text_col: str = "text") -> DataFrame:
    return texts.withColumn("cache_key", ids.cache_key(F.lit(namespace), F.col(text_col)))


def lookup(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """texts (with cache_key) with the cached vector, null for misses."""
    return texts.join(cache.select("cache_key", "vector"), "cache_key", "left")


def filled(texts: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(texts with vectors, new cache rows): each missing text is embedded once."""
    misses = texts.join(cache, "cache_key", "left_anti").dropDuplicates(["cache_key"])
    new = embed(misses).select("cache_key", "vector")
    return lookup(texts, cache.select("cache_key", "vector").unionByName(new)), new


CACHE = "cache_key string, vector array<float>, size_bytes bigint, last_accessed_ms bigint"


def through(spark: SparkSession, rows: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame], namespace: str, text_col: str = "content") -> DataFrame:
    """rows with `vector`: from the cache in a folder, where misses are embedded once each and appended before."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    known = spark.read.schema(CACHE).parquet(path) if there else spark.createDataFrame([], CACHE)
    texts = rows.withColumn("cache_key", ids.cache_key(F.lit(namespace), F.coalesce(F.col(text_col), F.lit(""))))
    misses = texts.select("cache_key", text_col).join(known.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])
    new = embed(misses).select("cache_key", F.col("vector").cast("array<float>").alias("vector"), (4 * F.size("vector")).cast("bigint").alias("size_bytes"), F.unix_millis(F.current_timestamp()).alias("last_accessed_ms"))
    new.write.mode("append").parquet(path)
    held = spark.read.schema(CACHE).parquet(path).dropDuplicates(["cache_key"])  # another run may have embedded a text too
    return lookup(texts, held).drop("cache_key")


def kept_by_lru(cache: DataFrame, most_bytes: int, buckets: int = 4096) -> DataFrame:
    """Rows that stay: the most recently used whose sizes sum up to at most `most_bytes`.

    Sizes are summed by time ranges first; only rows of the range at the edge are put in
    order, so that no task sorts the whole cache.
    """
    span = cache.agg(F.min("last_accessed_ms").alias("lo"), F.max("last_accessed_ms").alias("hi")).first()
    if span["lo"] is None:
        return cache
    width = max(1, -(-(span["hi"] - span["lo"] + 1) // buckets))
    rows = cache.withColumn("_b", F.floor((F.lit(span["hi"]) - F.col("last_accessed_ms")) / width))
    sums = rows.groupBy("_b").agg(F.sum("size_bytes").alias("size"))
    by = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("size").over(by), F.lit(0)))
    rows = rows.join(F.broadcast(sums.select(F.col("_b").alias("_c"), "before", "size")), F.col("_b") == F.col("_c"))  # at most `buckets` rows
    whole = rows.where(F.col("before") + F.col("size") <= most_bytes).select(cache.columns)
    edge = rows.where((F.col("before") <= most_bytes) & (F.col("before") + F.col("size") > most_bytes))
    order = Window.partitionBy("_b").orderBy(F.desc("last_accessed_ms"), "cache_key").rowsBetween(Window.unboundedPreceding, 0)
    # once a row passes the limit, the rows used before it go too
    edge = edge.withColumn("_upto", F.col("before") + F.sum("size_bytes").over(order)).where(F.col("_upto") <= most_bytes)
    return whole.unionByName(edge.select(cache.columns))


def routed(batch: Column, remote_batches: int) -> Column:
    """The first batches go to the remote provider, the rest to the local one."""
    return F.when(batch <= remote_batches, F.lit("remote")).otherwise(F.lit("local"))

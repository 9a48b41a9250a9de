"""The driver's tables as the engine's inputs, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("rs", "py", "ts", "md", "go")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, relativePath, content) of documents; the extension turns with the id."""
    d = read(spark, sf_dir, "documents")
    ext = F.get(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS)).cast("int"))
    return d.select("doc_id", F.concat("source", F.lit("/doc_"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit("."), ext).alias("relativePath"), F.col("text").alias("content"))


FILES_SQL = f"files AS (SELECT doc_id, source || '/doc_' || lpad(doc_id::VARCHAR, 6, '0') || '.' || [{', '.join(repr(e) for e in EXTENSIONS)}][doc_id % {len(EXTENSIONS)} + 1] AS relativePath, text AS content FROM documents)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector, label) of embeddings; label is missing for every seventh id."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.when(F.col("vec_id") % 7 != 0, F.col("label").cast("string")).alias("label"))


VECTORS_SQL = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vector, CASE WHEN vec_id % 7 <> 0 THEN label::VARCHAR END AS label FROM embeddings)"


def probes(spark: SparkSession, sf_dir: str, one: bool = False) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50; or the first alone."""
    rows = read(spark, sf_dir, "embeddings").where("vec_id = 0" if one else "vec_id % 50 = 0")
    return rows.select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


SCORE_SQL = "round(greatest(0, list_cosine_similarity(v.vector, q.vector)), 6)"


def ranked_sql(pairs: str, k: int, more: str = "") -> str:
    """The k best of (query, id, score) pairs of each query."""
    return f"SELECT query, id, score, rank::INT AS rank FROM (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM ({pairs})) WHERE rank <= {k}{more}"

"""Line-based records: sidecars, snapshots, insert logs, batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.errors import EngineError

METADATA = "struct<relativePath:string,language:string,fileExtension:string,span:struct<startLine:int,endLine:int>,fragmentStartByte:int,fragmentEndByte:int,nodeKind:string>"
DOCUMENT = f"struct<id:string,vector:array<float>,content:string,metadata:{METADATA}>"
LOG = f"sequence bigint, documents array<{DOCUMENT}>"
HEADER = "version int, dimension int, indexMode string, count bigint, checkpointSequence bigint"
QUERY = "query string, topK int, threshold double, queryVector array<float>, returnQueryVector boolean"


def _flat(rows: DataFrame, doc: str = "d") -> DataFrame:
    m = f"{doc}.metadata"
    return rows.select(*[c for c in rows.columns if c != doc], f"{doc}.id", f"{doc}.vector", f"{doc}.content", f"{m}.relativePath", f"{m}.language", f"{m}.fileExtension", f"{m}.span.startLine", f"{m}.span.endLine", f"{m}.fragmentStartByte", f"{m}.fragmentEndByte", f"{m}.nodeKind")


def insert_log(spark: SparkSession, path: str) -> DataFrame:
    """(sequence, pos, document fields) of a log; blank lines and CRLF are taken."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "\r$", "")).alias("v")).where("v <> ''")
    rows = lines.select(F.from_json("v", LOG, {"mode": "FAILFAST"}).alias("r")).select("r.sequence", F.posexplode("r.documents").alias("pos", "d"))
    return _flat(rows)


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a one-object JSON snapshot."""
    schema = f"{HEADER}, records array<{DOCUMENT}>"
    return _flat(spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("records").alias("pos", "d")))


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a sidecar: a header line, then one record a line. Doubles and wrong counts are refused."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    head = lines.select(F.from_json("value", HEADER).alias("h")).where("h.version IS NOT NULL").select("h.*").first()
    rows = lines.select(F.from_json("value", f"id string, content string, metadata {METADATA}").alias("d")).where("d.id IS NOT NULL")
    twice = rows.groupBy("d.id").count().where("count > 1").first()
    if head is None or twice or rows.count() != head["count"]:
        raise EngineError("snapshot:invalid_sidecar", f"doubled id {twice[0]}" if twice else "header and rows differ")
    return rows.select("d.id", "d.content", "d.metadata.*")


def batch_queries(spark: SparkSession, path: str, top_k: int = 5, threshold: float = 0.0) -> DataFrame:
    """(query_no, query, topK, threshold, queryVector, returnQueryVector) from NDJSON, with defaults."""
    rows = spark.read.schema(QUERY).json(path)
    return rows.select(F.monotonically_increasing_id().alias("query_no"), "query", F.coalesce("topK", F.lit(top_k)).alias("topK"), F.coalesce("threshold", F.lit(threshold)).alias("threshold"), "queryVector", F.coalesce("returnQueryVector", F.lit(False)).alias("returnQueryVector"))


def results_ndjson(results: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are left out."""
    results.select(F.to_json(F.struct(*results.columns)).alias("value")).write.mode("overwrite").text(path)


def reordered(responses: DataFrame, n: int, index: str = "index") -> DataFrame:
    """A provider's responses in the order of their requests 0..n-1; doubled, missing and unknown ones are refused."""
    seen = responses.agg(F.count(F.lit(1)).alias("all"), F.countDistinct(index).alias("each"), F.count_if(~F.coalesce(F.col(index).between(0, n - 1), F.lit(False))).alias("odd")).first()
    if seen["odd"] or seen["all"] != seen["each"] or seen["all"] != n:
        raise EngineError("embedding:invalid_response", f"{seen['all']} responses with {seen['each']} places, {seen['odd']} of them unknown, for {n} texts")
    return responses.orderBy(index)

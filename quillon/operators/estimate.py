"""Storage estimates from corpus totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the estimate.
USE_PERCENT, CHUNK_OVERHEAD, LEAST_BYTES = 88, 1000, 128 * 1024 * 1024
INDEX_FACTOR = {"dense": (3, 2), "hybrid": (8, 5)}
SAFETY = {False: (2, 1), True: (5, 4)}


def ceil_div(a: Column, b: int) -> Column:
    """In whole numbers: no double is rounded on the way."""
    return F.call_function("div", a + (b - 1), F.lit(b))


def totals(files: DataFrame, text_col: str = "content") -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.char_length(text_col)), F.lit(0)).alias("chars"))


def estimated(total: DataFrame, max_chunk_chars: int, dimension_low: int, dimension_high: int, mode: str = "dense", tight: bool = False) -> DataFrame:
    """(estimated_chunks, estimated_bytes_low, estimated_bytes_high, required_free_bytes) from (chars)."""
    per_chunk = max(1, max_chunk_chars * USE_PERCENT // 100)
    num, den = INDEX_FACTOR[mode]
    out = total.withColumn("estimated_chunks", ceil_div(F.col("chars"), per_chunk))
    for name, d in (("low", dimension_low), ("high", dimension_high)):
        out = out.withColumn(f"estimated_bytes_{name}", ceil_div(F.col("estimated_chunks") * (4 * d + CHUNK_OVERHEAD) * num, den))
    num, den = SAFETY[tight]
    return out.withColumn("required_free_bytes", ceil_div(F.greatest("estimated_bytes_high", F.lit(LEAST_BYTES)) * num, den))


def status(available: int | None, required: int) -> str:
    return "unknown" if available is None else "pass" if available >= required else "fail"

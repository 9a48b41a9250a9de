"""The engine's functions for SQL sessions, as SQL functions without user code."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name: (parameters, type, body). Bodies are the expressions of the column functions.
FUNCTIONS = {
    "dot_score": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "cosine_score": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
        "greatest(0D, least(1D, coalesce(try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x),"
        " sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x))), 0D)))",
    ),
    "hamming": ("a ARRAY<BIGINT>, b ARRAY<BIGINT>", "INT", "aggregate(zip_with(a, b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"),
    "sq8_quantize": (
        "v ARRAY<DOUBLE>, zero ARRAY<DOUBLE>, scale ARRAY<DOUBLE>", "ARRAY<INT>",
        "transform(v, (x, i) -> cast(floor(least(255D, greatest(0D, (x - get(zero, i)) / get(scale, i))) + 0.5D) AS INT))",
    ),
    "sq8_dequantize": ("code ARRAY<INT>, zero ARRAY<DOUBLE>, scale ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "transform(code, (x, i) -> x * get(scale, i) + get(zero, i))"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL; returns their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return sorted(FUNCTIONS)

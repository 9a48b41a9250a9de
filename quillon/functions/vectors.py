"""Vector columns in built-in functions: products, cosine, sign bits, 8-bit codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least squared norm of a vector that can be compared by cosine.
LEAST_NORM2 = 1e-30


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm2(a: Column) -> Column:
    return _sum(F.transform(a, lambda x: x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """Clamped to [0, 1] below, 1 for degenerate vectors."""
    size = F.sqrt(norm2(a) * norm2(b))
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), size)))
    return F.when(size > 0, F.greatest(F.lit(0.0), 1 - cos)).otherwise(F.lit(1.0))


def score(a: Column, b: Column) -> Column:
    """Cosine, 0 for opposite vectors."""
    return F.greatest(F.lit(0.0), 1 - cosine_distance(a, b))


def normalized(a: Column) -> Column:
    """Null for vectors without a direction."""
    size = F.sqrt(norm2(a))
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size))


def valid(a: Column, dimension: int) -> Column:
    """Right dimension, finite components, a norm that can be divided by."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(a) == dimension) & finite & (norm2(a) >= LEAST_NORM2), F.lit(False))


def sign_words(a: Column) -> Column:
    """Sign bits packed in 64-bit words."""
    n = F.size(a)

    def word(w: Column) -> Column:
        part = F.slice(a, w * 64 + 1, F.lit(64))
        return F.aggregate(part, F.struct(F.lit(0).cast("bigint").alias("v"), F.lit(0).alias("i")), lambda acc, x: F.struct(acc["v"].bitwiseOR(F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), acc["i"])).otherwise(F.lit(0).cast("bigint"))).alias("v"), (acc["i"] + 1).alias("i")), lambda acc: acc["v"])

    return F.transform(F.sequence(F.lit(0), F.ceil(n / 64).cast("int") - 1), word)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two packed sign vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def sq8_quantize(a: Column, zero: Sequence[float], scale: Sequence[float]) -> Column:
    """One code of 0..255 for each dimension; ties round up."""
    z, s = F.array(*map(F.lit, zero)), F.array(*map(F.lit, scale))
    return F.transform(a, lambda x, i: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (x.cast("double") - F.get(z, i)) / F.get(s, i))) + 0.5).cast("int"))


def sq8_dequantize(code: Column, zero: Sequence[float], scale: Sequence[float]) -> Column:
    z, s = F.array(*map(F.lit, zero)), F.array(*map(F.lit, scale))
    return F.transform(code, lambda x, i: x.cast("double") * F.get(s, i) + F.get(z, i))


def mean_pooled(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask isn't 0; null if none is."""
    chosen = F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: x["m"] != 0), lambda x: x["t"])
    n = F.size(chosen)
    total = F.aggregate(F.slice(chosen, 2, F.greatest(n - 1, F.lit(0))), F.transform(F.get(chosen, F.lit(0)), lambda x: x.cast("double")), lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    return F.when(n > 0, F.transform(total, lambda x: x / n))

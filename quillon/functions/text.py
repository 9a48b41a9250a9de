"""Labels, codes and redaction."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of keys whose values are never shown (fixed values).
SECRET_MARKS = ("KEY", "TOKEN", "SECRET", "PASSWORD", "CREDENTIAL", "AUTH")
REDACTED = "[REDACTED]"


def is_secret(key: Column) -> Column:
    return F.upper(key).rlike("|".join(SECRET_MARKS))


def redacted(key: Column, value: Column) -> Column:
    return F.when(is_secret(key), F.lit(REDACTED)).otherwise(value)


def error_code(namespace: Column, code: Column) -> Column:
    part = lambda c: F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", "_"))
    return F.concat(F.lit("ERR_"), part(namespace), F.lit("_"), part(code))


def progress_percent(current: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0)).otherwise(F.floor(F.least(current, total) * 100 / total)).cast("int")


def stage_of(phase: Column) -> Column:
    p = F.lower(phase)
    has = lambda *words: p.rlike("|".join(words))
    return F.when(has("scan"), "scan").when(has("process", "chunk"), "chunk").when(has("prewarm", "finaliz", "publish"), "publish").when(has("collection"), "prepare").otherwise("index")


def embedding_text(text: Column) -> Column:
    """What is embedded for a text: a space for an empty one."""
    return F.when(text == "", F.lit(" ")).otherwise(text)


def quoted(value: Column) -> Column:
    """A value as a double-quoted string literal of a filter: backslashes and quotes are escaped."""
    plain = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), plain, F.lit('"'))


def merged_metadata(base: Column, more: Column) -> Column:
    """Two flat JSON objects of texts as one; fields of the second win. What is no such object counts as empty."""
    none = F.create_map().cast("map<string,string>")
    a, b = (F.coalesce(F.from_json(x, "map<string,string>"), none) for x in (base, more))
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b))


def backoff_ms(attempt: int, base_ms: int = 150, most_ms: int = 10_000, jitter: float = 0.2, seed: int | None = None) -> int:
    """Wait before the attempt after `attempt` (from 0): doubled each time up to a limit, give or take the jitter."""
    wait = min(most_ms, base_ms * 2**attempt)
    return max(0, round(wait * (1 + jitter * (2 * random.Random(seed).random() - 1))))

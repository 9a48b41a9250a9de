"""Content-addressed identifiers and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunk_id(path: Column, start: Column, end: Column, content: Column, fragment_start: Column | None = None, fragment_end: Column | None = None) -> Column:
    """chunk_ and 16 hex digits over path, lines, fragment bytes (if there are any) and content."""
    s = lambda c: c.cast("string")
    middle = F.lit("")
    if fragment_start is not None:
        middle = F.when(fragment_start.isNotNull() & fragment_end.isNotNull(), F.concat(s(fragment_start), F.lit(":"), s(fragment_end), F.lit(":"))).otherwise(F.lit(""))
    return F.concat(F.lit("chunk_"), F.left(F.sha2(F.concat(path, F.lit(":"), s(start), F.lit(":"), s(end), F.lit(":"), middle, content), 256), F.lit(16)))


def collection_name(root: Column, hybrid: bool = False) -> Column:
    return F.concat(F.lit("hybrid_code_chunks_" if hybrid else "code_chunks_"), F.left(F.md5(root), F.lit(8)))


def codebase_id(root: Column) -> Column:
    return F.concat(F.lit("codebase_"), F.left(F.md5(root), F.lit(12)))


def cache_key(namespace: Column, text: Column) -> Column:
    return F.sha2(F.concat(namespace.cast("binary"), F.lit(b"\x00"), text.cast("binary")), 256)


def hash_embedding(text: Column, dimension: int) -> Column:
    """Deterministic vector: bytes of SHA-256 over text, a colon and a little-endian counter, over 255."""
    blocks = []
    for k in range(-(-dimension // 32)):
        digest = F.sha2(F.concat(text.cast("binary"), F.lit(b":" + k.to_bytes(8, "little"))), 256)
        blocks.append(_byte_values(digest, min(32, dimension - 32 * k)))
    return F.concat(*blocks)


def _byte_values(digest: Column, n: int) -> Column:
    return F.get(F.transform(F.array(digest), lambda d: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.conv(F.substr(d, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255).cast("float"))), F.lit(0))


def merkle_root(path: Column, digest: Column) -> Column:
    """Aggregate: the hash of all files' hashes in path order."""
    ordered = F.array_sort(F.collect_list(F.struct(path.alias("p"), digest.alias("h"))))
    return F.sha2(F.concat(F.lit("root:"), F.array_join(F.transform(ordered, lambda x: x["h"]), "")), 256)

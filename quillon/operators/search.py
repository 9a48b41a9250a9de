"""Vector search over a collection: exact top k for many queries, filters, thresholds, orders.

A stated set of queries (its size is checked) is shipped to the partitions of the
collection; vectors meet them in matrix products of tiles of bounded size, and a partition
hands on its best k rows for each query only. What is shuffled so grows with queries
and partitions, not with the collection.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.errors import EngineError

#: Numbers of a block of queries, with what is held of their best rows: 64 MB as doubles.
QUERY_NUMBERS = 8_000_000
#: Rows and queries of a tile: its scores are 8 MB as doubles, whatever the numbers of rows and queries.
TILE = 1024
#: Decimal places of scores: ties are decided on rounded scores, then by id.
PLACES = 6

_AMONG = re.compile(r"""\s*id\s+in\s+(\[.*\])\s*""", re.S)
_FILTER = re.compile(r"""\s*([A-Za-z_][A-Za-z0-9_]*)\s+(==|!=)\s*(?:'([^'\n]+)'|"([^"\n]+)")\s*""")


def parsed_filter(text: str | None, fields: dict[str, str] | list[str]) -> Column | None:
    """One comparison, field == 'value' or field != 'value', or id in ["a", "b"]; blank text means none.

    A missing value differs from every value: != holds for null.
    """
    if text is None or not text.strip():
        return None
    if m := _AMONG.fullmatch(text):
        try:
            listed = json.loads(m[1])
        except ValueError:
            listed = None
        if not listed or not all(isinstance(x, str) for x in listed):
            raise EngineError("vector:invalid_filter_expr", f"not a list of ids: {text!r}")
        return F.coalesce(F.col("id").cast("string").isin(*listed), F.lit(False))
    m = _FILTER.fullmatch(text)
    if not m or "\n" in text or m[1] not in fields:
        raise EngineError("vector:invalid_filter_expr", f"not a filter: {text!r}")
    c, value = F.col(m[1]), m[3] or m[4]
    return F.coalesce(c == value, F.lit(False)) if m[2] == "==" else ~c.eqNullSafe(F.lit(value))


def checked_query(vector, dimension: int) -> np.ndarray:
    v = np.asarray(vector, float)
    if v.shape != (dimension,):
        raise EngineError("vector:dimension_mismatch", f"expected {dimension} numbers, not {v.shape}")
    if not np.isfinite(v).all() or v @ v < 1e-30:
        raise EngineError("vector:invalid_query", "not finite, or without direction")
    return v


def query_matrix(queries: DataFrame, id_col: str, vector_col: str) -> tuple[pa.Array, np.ndarray]:
    """A block of a stated query set on the driver, sorted by id."""
    rows = queries.select(id_col, vector_col).orderBy(id_col).toArrow()
    if rows.num_rows == 0:
        return pa.array([]), np.zeros((0, 0))
    return rows.column(0).combine_chunks(), np.array(rows.column(1).to_pylist(), float)


def query_blocks(queries: DataFrame, id_col: str = "query", vector_col: str = "vector", limit: int = QUERY_NUMBERS, more: int = 0) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """A stated query set in blocks of `limit` numbers on average, of which `more` come to each query's own; each block is one pass over the collection."""
    n = queries.agg(F.coalesce(F.sum(F.size(vector_col) + more), F.lit(0))).first()[0]
    blocks = max(1, -(-n // limit))
    for b in range(blocks):
        yield query_matrix(queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(blocks)) == b), id_col, vector_col)


#: What is taken from at most TILE rows once, and then scores them for queries a to z: (z - a, rows), -inf where a row is no candidate.
Scorer = Callable[[np.ndarray], Callable[[int, int], np.ndarray]]


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Clamped to [0, 1]; 0 for vectors without direction."""
    with np.errstate(all="ignore"):
        s = q @ x.T
        s /= np.sqrt((q * q).sum(1))[:, None]
        s /= np.sqrt((x * x).sum(1))
        if not np.isfinite(s.sum()):
            np.nan_to_num(s, copy=False, nan=0.0, posinf=0.0, neginf=0.0)
    return np.clip(s, 0, 1, out=s)


def scored_where(counts: np.ndarray, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of the pairs that count, -inf for others; rows that count for no query are not scored."""
    hit = np.flatnonzero(counts.any(0))
    if len(hit) == len(x):
        s = cosines(q, x)
    else:
        s = np.full(counts.shape, -np.inf)
        s[:, hit] = cosines(q, x[hit])
    s[~counts] = -np.inf
    return s


def row_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and vectors of at most TILE rows (id, vector) at a time."""
    for b in batches:
        for at in range(0, b.num_rows, TILE):
            part = b.slice(at, TILE)
            yield part.column(0), np.array(part.column(1).flatten(), float).reshape(part.num_rows, -1)


def query_tiles(n: int) -> list[tuple[int, int]]:
    return [(a, min(n, a + TILE)) for a in range(0, n, TILE)]


def _after(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether an id is no less than another; null ids come first."""
    if a.dtype != object and b.dtype != object:
        return a >= b
    return np.array([y is None or (x is not None and x >= y) for x, y in zip(a, b)], bool)


class _TileBest:
    """The k best (score, id) of each of n queries, as arrays: at most n * k, and as many that wait to be ranked, beside one tile's."""

    def __init__(self, n: int, k: int, threshold: float):
        self.n, self.k = n, k
        self.line = np.full(n, max(threshold, np.finfo(float).min))  # the least score that still counts
        self.full, self.last = np.zeros(n, bool), np.zeros(n, np.int64)  # last: of k rows found, the id at the line
        self.query, self.score, self.id = np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int64)
        self.waiting: list[tuple] = []

    def add(self, s: np.ndarray, ids: np.ndarray) -> None:
        counts = s >= self.line[:, None]
        many = np.flatnonzero(np.count_nonzero(counts, axis=1) > self.k)
        if len(many):
            some = s[many]
            some[~counts[many]] = -np.inf  # NaN would rank above all
            kth = np.partition(some, -self.k, axis=1)[:, -self.k]
            counts[many] = some >= kth[:, None]
        q, r = np.nonzero(counts)
        score, found = s[q, r], ids[r]
        tied = np.flatnonzero(self.full[q] & (score == self.line[q]))
        if len(tied):  # among equals the lesser ids stay
            late = tied[_after(found[tied], self.last[q[tied]])]
            q, score, found = (np.delete(x, late) for x in (q, score, found))
        if len(q):
            self.waiting.append((q.astype(np.int32), score, found))
            if sum(len(x[0]) for x in self.waiting) >= self.n * self.k:
                self.rank()

    def rank(self) -> None:
        q, s, i = (np.concatenate(x) for x in zip((self.query, self.score, self.id), *self.waiting)) if self.waiting else (self.query, self.score, self.id)
        self.waiting = []
        if i.dtype == object:
            self.last, place = self.last.astype(object), {x: n for n, x in enumerate(sorted(set(i) - {None}))}
        order = np.lexsort((i if i.dtype != object else np.array([place.get(x, -1) for x in i], int), -s, q))
        q, s, i = q[order], s[order], i[order]
        at = np.arange(len(q))
        place = at - np.maximum.accumulate(np.where(np.r_[True, q[1:] != q[:-1]], at, 0)) if len(q) else at
        kth = place == self.k - 1
        self.full[q[kth]], self.line[q[kth]], self.last[q[kth]] = True, s[kth], i[kth]
        self.query, self.score, self.id = (x[place < self.k] for x in (q, s, i))


class Best:
    """The k best rows of each named query in what is added, tile by tile."""

    def __init__(self, names: pa.Array, k: int, threshold: float = -np.inf):
        self.names, self.kind = names, None
        self.tiles = [(a, z, _TileBest(z - a, k, threshold)) for a, z in query_tiles(len(names))]

    def add(self, ids: pa.Array, part: Callable[[int, int], np.ndarray]) -> None:
        """Ids of rows, and their scores for queries a to z, which may be overwritten."""
        self.kind = ids.type
        ids = ids.to_numpy(zero_copy_only=False) if pa.types.is_integer(self.kind) and not ids.null_count else np.array([*ids.to_pylist(), None], object)[:-1]
        for a, z, best in self.tiles:
            s = part(a, z)
            best.add(np.round(s, PLACES, out=s), ids)

    def found(self) -> Iterator[pa.RecordBatch]:
        """(query, id, score), unordered."""
        for a, _, best in self.tiles:
            best.rank()
            if len(best.query):
                yield pa.RecordBatch.from_arrays([self.names.take(pa.array(best.query + a)), pa.array(best.id, self.kind), pa.array(best.score)], ["query", "id", "score"])


def block_top_k(rows: DataFrame, names: pa.Array, kind: str, scorer: Scorer, dimension: int, k: int, threshold: float = -np.inf, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query, id, score, rank): the k best rows for each named query, by a scorer of tiles.

    Each partition hands on its best k for each query only; a worker holds these, and a tile's scores.
    """
    schema = f"query {kind}, id {dict(rows.dtypes)[id_col]}, score double"
    shared = rows.sparkSession.sparkContext.broadcast((names, cloudpickle.dumps(scorer)))  # bounded by a block of queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, scorer = shared.value[0], cloudpickle.loads(shared.value[1])
        best = Best(names, k, threshold)
        for ids, x in row_tiles(batches):
            best.add(ids, scorer(x))
        yield from best.found()

    fit = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where((F.size("vector") == dimension) & ~F.exists("vector", lambda x: x.isNull()))
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return fit.mapInArrow(run, schema).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)


def in_blocks(rows: DataFrame, queries: DataFrame, id_col: str, query_id: str, query_vector: str, k: int, one: Callable[[pa.Array, np.ndarray, str], DataFrame]) -> DataFrame:
    """The union of `one` over the blocks of a query set; an empty set gives no rows."""
    kind = dict(queries.dtypes)[query_id]
    found = [one(names, q, kind) for names, q in query_blocks(queries, query_id, query_vector, more=4 * k) if len(names)]  # k best and k that wait, each with an id
    if not found:
        return rows.sparkSession.createDataFrame([], f"query {kind}, id {dict(rows.dtypes)[id_col]}, score double, rank int")
    return functools.reduce(DataFrame.unionAll, found)


def top_k(collection: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.0, where: Column | None = None, id_col: str = "id", vector_col: str = "vector", query_id: str = "query", query_vector: str = "vector", metric: str = "cosine") -> DataFrame:
    """(query, id, score, rank): the k best of the collection for each query.

    The filter comes before the ranking, so that k rows come out wherever k rows fit.
    Scores below the threshold are left out; ties go to the lesser id.
    """
    rows = collection if where is None else collection.where(where)

    def one(names: pa.Array, q: np.ndarray, kind: str) -> DataFrame:
        def scorer(x):
            return lambda a, z: cosines(q[a:z], x) if metric == "cosine" else q[a:z] @ x.T

        return block_top_k(rows, names, kind, scorer, q.shape[1], k, threshold, id_col, vector_col)

    return in_blocks(rows, queries, id_col, query_id, query_vector, k, one)


def all_scores(collection: DataFrame, queries: DataFrame, id_col: str = "id", vector_col: str = "vector", query_id: str = "query", query_vector: str = "vector", metric: str = "cosine") -> DataFrame:
    """(query, id, score) of a stated query set and every row, in tiles: no join, the report is as long as both together make it."""
    kinds = f"query {dict(queries.dtypes)[query_id]}, id {dict(collection.dtypes)[id_col]}, score double"

    def one(names: pa.Array, q: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, x in row_tiles(batches):
                for a, z in query_tiles(len(names)):
                    s = np.round(cosines(q[a:z], x) if metric == "cosine" else q[a:z] @ x.T, PLACES)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(np.arange(a, z), len(ids)))), ids.take(pa.array(np.tile(np.arange(len(ids)), z - a))), pa.array(s.ravel())], ["query", "id", "score"])

        return collection.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(F.size("vector") == q.shape[1]).mapInArrow(run, kinds)

    found = [one(*b) for b in query_blocks(queries, query_id, query_vector) if len(b[0])]
    return functools.reduce(DataFrame.unionAll, found) if found else collection.sparkSession.createDataFrame([], kinds)


def ordered(results: DataFrame) -> DataFrame:
    """The order of search results: best first, then by path and lines."""
    return results.orderBy(F.desc("score"), "relativePath", "startLine", "endLine")


def scalar_query(collection: DataFrame, where: str | None, fields: list[str], limit: int) -> DataFrame:
    """Rows that fit a filter, in id order; unknown fields are left out."""
    c = parsed_filter(where, collection.columns)
    rows = collection if c is None else collection.where(c)
    known = [f for f in fields if f in collection.columns]
    return rows.orderBy("id").limit(limit).select(*known)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query, recall): the part of the true ids that were found; 0 true ids count as 1."""
    t = truth.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    hits = truth.join(found.select("query", "id"), ["query", "id"], "left_semi").groupBy("query").agg(F.count(F.lit(1)).alias("hits"))
    return t.join(hits, "query", "left").select("query", (F.coalesce("hits", F.lit(0)) / F.greatest("n", F.lit(1))).alias("recall"))

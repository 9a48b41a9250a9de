"""The engine's verbs: init, index, search, reindex, clear, status, estimate, calibrate."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import ids, paths, text
from quillon.operators import ann, calibrate, chunking, collection, embcache, estimate, hybrid, quantize, search, sync
from quillon.sources import config, files

Embedder = Callable[[DataFrame], DataFrame]


def hash_embedder(dimension: int) -> Embedder:
    """Deterministic vectors for tests and dry runs: (content) -> (content, vector)."""
    return lambda rows: rows.withColumn("vector", ids.hash_embedding(text.embedding_text(F.col("content")), dimension))


class Engine:
    """Collections of chunked, embedded files below a root folder.

    embed adds a `vector` column to rows with `content`; a model is used by passing a
    function that applies an Arrow user function. cache: folder of an embedding cache.
    """

    def __init__(self, spark: SparkSession, root: str, settings: dict | None = None, embed: Embedder | None = None, cache: str | None = None):
        self.spark, self.settings = spark, settings or config.load(env={})
        self.store = collection.Store(spark, root)
        self.dimension = self.settings["embedding"]["dimension"]
        self.embed = embed or hash_embedder(self.dimension)
        self.cache, self.stats = cache, {}

    def _rows(self, tree: DataFrame) -> DataFrame:
        s = self.settings["splitter"]
        chunks = chunking.chunked(tree, s["lines"], s["overlap"], s["maxChunkBytes"], "path", "content")
        ext = paths.extension(F.col("relativePath"))
        rows = chunks.drop("pos").withColumn("fileExtension", ext).withColumn("language", paths.language(F.coalesce(ext, F.lit(""))))
        return self._embedded(rows).withColumn("nodeKind", F.lit(None).cast("string"))

    def _embedded(self, rows: DataFrame) -> DataFrame:
        """rows with vectors: known texts from the cache, others embedded once each and kept there."""
        if self.cache is None:
            return self.embed(rows)
        return embcache.through(self.spark, rows, self.cache, self.embed, f"{self.dimension}")

    def _tree(self, root: str) -> DataFrame:
        s = self.settings["scan"]
        return files.scan(self.spark, root, files.ignore_patterns(self.spark, root, s["ignore"]), s["extensions"], s["maxFileSizeBytes"])

    def init(self, name: str) -> None:
        self.store.create(name, self.dimension, self.settings["vectorDb"]["indexMode"])

    def index(self, name: str, root: str, chunk_limit: int | None = None) -> int:
        """Index a tree as a new generation, with its file hashes. stats then has the counts, the time and whether the limit was reached."""
        self.init(name)
        began, tree = time.time(), self._tree(root)
        rows = self._rows(tree)
        if chunk_limit is not None:
            rows = rows.orderBy("relativePath", "startLine", "id").limit(chunk_limit)
        g = self.store.publish(name, rows.withColumn("origin", F.monotonically_increasing_id()), sync.hashed(tree))
        self.prepare(name)
        found = self.status(name)
        over = chunk_limit is not None and found["chunks"] >= chunk_limit
        self.stats = {"files": found["files"], "chunks": found["chunks"], "ms": int(1000 * (time.time() - began)), "status": "limitReached" if over else "completed"}
        return g

    def reindex(self, name: str, root: str) -> dict[str, int]:
        self.init(name)
        before = self.store.active(name)
        counts = sync.reindex(self.store, name, self._tree(root), self._rows)
        if self.store.active(name) != before:
            self.prepare(name)
        return counts

    def prepare(self, name: str) -> None:
        """Fit what the configured strategy searches with, once for the active generation, beside its rows."""
        strategy, top = self.settings["vectorDb"]["strategy"], self.store.place(name)
        if top is None or strategy == "exact":
            return
        rows = self.store.read(name)
        if not rows.head(1):
            return
        if strategy == "ivf" and not self.store.place(name, "ivf"):
            cells = ann.Cells(rows, max(2, int(rows.count() ** 0.5)))
            cells.save(f"{top}/ivf")
            probe = ann.Cells.load(self.spark, f"{top}/ivf").probes_for(10, ann.RECALL)
            self.spark.createDataFrame([(probe,)], "probe int").coalesce(1).write.mode("overwrite").parquet(f"{top}/ivf/probe")
        elif strategy == "sq8" and not self.store.place(name, "sq8"):
            quantize.sq8_params(rows, unit=True).coalesce(1).write.mode("overwrite").parquet(f"{top}/sq8")
        elif strategy == "bq1" and not self.store.place(name, "bq1"):
            self.calibrate(name)

    def search(self, name: str, query: str | None = None, top_k: int | None = None, threshold: float | None = None, where: str | None = None, include_content: bool = True, mode: str = "dense", strategy: str | None = None, vector: list[float] | None = None) -> DataFrame:
        """Ranked chunks; a collection that doesn't exist has none. mode: dense, or hybrid (dense and BM25 by rank fusion).

        A query is a text, or a vector of the collection's dimension. strategy: exact, or
        sq8, ivf, bq1 with what prepare has fitted for the active generation.
        """
        r = config.search_request(query if vector is None else query or "vector", top_k, threshold)
        if not self.store.has(name):
            return self.spark.createDataFrame([], "relativePath string, startLine int, endLine int, language string, content string, score double")
        rows = self.store.read(name)
        c = search.parsed_filter(where, rows.columns)
        rows = rows if c is None else rows.where(c)
        if vector is None:
            q = self.embed(self.spark.createDataFrame([(0, query)], "query int, content string")).select("query", "vector")
            vector = q.first()["vector"]
        v = [float(x) for x in search.checked_query(vector, self.store.manifest(name)["dimension"])]
        q = self.spark.createDataFrame([(0, v)], "query int, vector array<double>")
        k = r["topK"]
        strategy = strategy or self.settings["vectorDb"]["strategy"]
        if mode == "hybrid":
            dense = search.top_k(rows, q, k)
            sparse = hybrid.bm25_top_k(rows, self.spark.createDataFrame([(0, query)], "query int, text string"), k)
            found = hybrid.rrf([dense, sparse], k)
        elif strategy == "exact":
            found = search.top_k(rows, q, k, r["threshold"])
        elif strategy == "sq8":
            at = self.store.place(name, "sq8")
            params = quantize.params_lists(self.spark.read.parquet(at)) if at else None
            found = quantize.sq8_rerank(rows, q, k, rows.count(), params=params)
        elif strategy == "ivf":
            if at := self.store.place(name, "ivf"):
                cells, probe, recall = ann.Cells.load(self.spark, at), self.spark.read.parquet(f"{at}/probe").first()["probe"], None
                part = cells.rows if c is None else cells.rows.join(rows.select("id"), "id", "left_semi")
            else:
                n = max(2, int(rows.count() ** 0.5))
                cells, probe, recall, part = ann.Cells(rows, n), 1, ann.RECALL, None
            found = cells.top_k(q, k, probe, recall, part)
        elif strategy == "bq1":
            found = quantize.bq1_top_k(rows, q, k, self._threshold(name), len(v))
        else:
            raise config.EngineError("search:unknown_strategy", strategy)
        if strategy != "exact" and mode != "hybrid":
            found = found.where(F.col("score") >= r["threshold"])
        out = rows.join(F.broadcast(found.select("id", "score")), "id")  # top_k rows
        fields = ["relativePath", "startLine", "endLine", "language", *(["content"] if include_content else []), "score"]
        return search.ordered(out.select(*fields))

    def _threshold(self, name: str) -> float:
        """The calibrated share of sign bits that may differ, if it was found for this generation and dimension; else all."""
        at = self.store.place(name, "bq1")
        kept = self.spark.read.parquet(at).first() if at else None
        return kept["threshold"] if kept and kept["dimension"] == self.store.manifest(name)["dimension"] else 1.0

    def search_batch(self, name: str, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """(query, id, score, rank) of queries (query, content)."""
        return search.top_k(self.store.read(name), self.embed(queries), top_k)

    def clear(self, name: str) -> None:
        self.store.drop(name)

    def status(self, name: str) -> dict:
        if not self.store.has(name):
            return {"collection": name, "state": "missing"}
        rows = self.store.read(name).agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("relativePath").alias("files")).first()
        return self.store.manifest(name) | {"state": "ready" if self.store.active(name) else "empty", "generation": self.store.active(name), "chunks": rows["chunks"], "files": rows["files"]}

    def estimate(self, root: str, tight: bool = False) -> dict:
        out = estimate.estimated(estimate.totals(self._tree(root)), self.settings["splitter"]["maxChunkBytes"], self.dimension, self.dimension, self.settings["vectorDb"]["indexMode"], tight)
        return json.loads(out.toJSON().first())

    def calibrate(self, name: str, plan: calibrate.Plan = calibrate.Plan()) -> dict:
        rows = self.store.read(name)
        q = calibrate.probes(rows, plan.queries, plan.seed).select(F.col("id").alias("query"), "vector")
        out = calibrate.calibrated_on(*quantize.bq1_spread(rows, q, plan.k), self.dimension, plan)
        if top := self.store.place(name):  # kept with the generation that it holds for
            kept = [(out["threshold"], out["recall"], out["skipRate"], self.dimension)]
            self.spark.createDataFrame(kept, "threshold double, recall double, skipRate double, dimension int").coalesce(1).write.mode("overwrite").parquet(f"{top}/bq1")
        return out

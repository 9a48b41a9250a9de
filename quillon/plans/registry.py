"""All queries over the driver's tables, with their DuckDB equivalents."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import ids, paths, text
from quillon.functions import sql as functions
from quillon.functions import vectors as V
from quillon.operators import ann, calibrate, chunking, collection, embcache, estimate, hybrid, quantize, search, sync
from quillon.sources import files as sources
from quillon.streaming import ema, wal

from .tables import FILES_SQL, SCORE_SQL, VECTORS_SQL, files, probes, ranked_sql, read, vectors

QUERIES: dict = {}
ORACLE_SQL: dict = {}
DIM = 64


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _pairs_sql(where: str = "", probes: str = "id % 50 = 0") -> str:
    return f"SELECT q.id AS query, v.id, {SCORE_SQL} AS score FROM v, (SELECT * FROM v WHERE {probes}) q {where}"




# Vector search


@query(f"WITH {VECTORS_SQL} SELECT query, id, score, rank FROM ({ranked_sql(_pairs_sql(), 10)}) WHERE query <> id")
def knn_exact_top10(spark: SparkSession, d: str) -> DataFrame:
    """The ten best of each query, itself left out of the report."""
    return search.top_k(vectors(spark, d), probes(spark, d), 10).where("query <> id")


@query(f"WITH {VECTORS_SQL} {ranked_sql(_pairs_sql(), 10)}")
def knn_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.top_k(vectors(spark, d), probes(spark, d), 10)


@query(f"WITH {VECTORS_SQL} {ranked_sql(f'SELECT * FROM ({_pairs_sql()}) WHERE score >= 0.2', 50)}")
def knn_threshold(spark: SparkSession, d: str) -> DataFrame:
    return search.top_k(vectors(spark, d), probes(spark, d), 50, threshold=0.2)


@query(f"""WITH {VECTORS_SQL} {ranked_sql(_pairs_sql("WHERE v.label = '3'"), 10)}""")
def knn_label_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    return search.top_k(rows, probes(spark, d), 10, where=search.parsed_filter("label == '3'", rows.columns))


@query(f"""WITH {VECTORS_SQL} {ranked_sql(_pairs_sql("WHERE v.label IS DISTINCT FROM '3'"), 10)}""")
def knn_not_equal_null(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    return search.top_k(rows, probes(spark, d), 10, where=search.parsed_filter("label != '3'", rows.columns))


@query(f"WITH {VECTORS_SQL} SELECT q.id AS query, v.id, round(list_inner_product(v.vector, q.vector), 6) AS score FROM v, (SELECT * FROM v WHERE id % 50 = 0) q")
def dot_scores(spark: SparkSession, d: str) -> DataFrame:
    return search.all_scores(vectors(spark, d), probes(spark, d), metric="dot")


@query(f"WITH {VECTORS_SQL} SELECT id, len(vector) = {DIM} AND list_inner_product(vector, vector) >= 1e-30 AS valid, round(list_inner_product(vector, vector), 6) AS norm2 FROM v")
def vector_validity(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("id", V.valid(F.col("vector"), DIM).alias("valid"), F.round(V.norm2(F.col("vector")), 6).alias("norm2"))


_FOUND = f"f AS ({ranked_sql(_pairs_sql(), 40)}), p AS (SELECT query, id, round(score, 1) AS score, 'src' || (id % 3) AS relativePath, (id % 5 + 1)::INT AS startLine, (id % 5 + 10)::INT AS endLine FROM f)"


@query(f"WITH {VECTORS_SQL}, {_FOUND} SELECT query, id, score, relativePath, startLine, endLine, row_number() OVER (PARTITION BY query ORDER BY score DESC, relativePath, startLine, endLine, id)::INT AS place FROM p")
def result_order_tiebreak(spark: SparkSession, d: str) -> DataFrame:
    rows = search.top_k(vectors(spark, d), probes(spark, d), 40)
    rows = rows.select("query", "id", F.round("score", 1).alias("score"), F.concat(F.lit("src"), F.col("id") % 3).alias("relativePath"), (F.col("id") % 5 + 1).cast("int").alias("startLine"), (F.col("id") % 5 + 10).cast("int").alias("endLine"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "relativePath", "startLine", "endLine", "id")))


@query(f"WITH {VECTORS_SQL} SELECT id, label FROM v WHERE label IS DISTINCT FROM '2' ORDER BY id LIMIT 25")
def query_projection_limit(spark: SparkSession, d: str) -> DataFrame:
    return search.scalar_query(vectors(spark, d), "label != '2'", ["id", "label", "nosuch"], 25)


@query(f"WITH {VECTORS_SQL}, r AS ({ranked_sql(_pairs_sql(), 50)}) SELECT id, max(score) AS score FROM r GROUP BY id ORDER BY score DESC, id LIMIT 10")
def max_score_merge(spark: SparkSession, d: str) -> DataFrame:
    found = search.top_k(vectors(spark, d), probes(spark, d), 50)
    return hybrid.max_merge([found], 10)


@query()
def ivf_topk(spark: SparkSession, d: str) -> DataFrame:
    return ann.Cells(vectors(spark, d), 16).top_k(probes(spark, d), 10, 8, ann.RECALL)


@query()
def lsh_topk(spark: SparkSession, d: str) -> DataFrame:
    return ann.lsh_top_k(vectors(spark, d), probes(spark, d), 10, DIM, recall=ann.RECALL)


def _reached(spark: SparkSession, d: str, found: DataFrame) -> DataFrame:
    """(queries, reached): whether the mean recall of the stated queries is what approximate search promises."""
    truth = search.top_k(vectors(spark, d), probes(spark, d), 10).select("query", "id")
    return search.recall(found, truth).agg(F.count(F.lit(1)).alias("queries"), (F.avg("recall") >= ann.RECALL).alias("reached"))


_REACHED = "SELECT count(*) AS queries, TRUE AS reached FROM embeddings WHERE vec_id % 50 = 0"


@query(_REACHED)
def ivf_recall(spark: SparkSession, d: str) -> DataFrame:
    return _reached(spark, d, ivf_topk(spark, d))


@query(_REACHED)
def lsh_recall(spark: SparkSession, d: str) -> DataFrame:
    return _reached(spark, d, lsh_topk(spark, d))


# Quantization

_DIMS = f"x AS (SELECT id, unnest(vector) AS x, generate_subscripts(vector, 1) - 1 AS dim FROM v)"
_PARAMS = "p AS (SELECT dim, min(x) AS zero, CASE WHEN max(x) - min(x) <= 1.1920928955078125e-07 THEN 1.0 ELSE (max(x) - min(x)) / 255.0 END AS scale FROM x GROUP BY dim)"
_CODES = "c AS (SELECT id, dim, x, zero, scale, floor(least(255, greatest(0, (x - zero) / scale)) + 0.5)::INT AS code FROM x JOIN p USING (dim))"


@query(f"WITH {VECTORS_SQL}, {_DIMS}, {_PARAMS} SELECT dim::INT AS dim, round(zero, 9) AS zero, round(scale, 9) AS scale FROM p")
def sq8_params(spark: SparkSession, d: str) -> DataFrame:
    return quantize.sq8_params(vectors(spark, d)).select("dim", F.round("zero", 9).alias("zero"), F.round("scale", 9).alias("scale"))


@query(f"WITH {VECTORS_SQL}, {_DIMS}, {_PARAMS}, {_CODES} SELECT id, dim::INT AS dim, code FROM c")
def sq8_quantize(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    return rows.select("id", F.posexplode(V.sq8_quantize(F.col("vector"), *quantize.params_lists(quantize.sq8_params(rows)))).alias("dim", "code"))


@query(f"WITH {VECTORS_SQL}, {_DIMS}, {_PARAMS}, {_CODES} SELECT id, dim::INT AS dim, round(code * scale + zero, 6) AS value FROM c")
def sq8_dequantize(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    how = quantize.params_lists(quantize.sq8_params(rows))
    return rows.select("id", F.posexplode(V.sq8_dequantize(V.sq8_quantize(F.col("vector"), *how), *how)).alias("dim", "x")).select("id", "dim", F.round("x", 6).alias("value"))


_UNIT = "u AS (SELECT id, list_transform(vector, lambda z: z / sqrt(list_inner_product(vector, vector))) AS vector FROM v), x AS (SELECT id, unnest(vector) AS x, generate_subscripts(vector, 1) - 1 AS dim FROM u)"
_CODE_SCORE = "s AS (SELECT b.id AS query, a.id, round(greatest(0, sum(a.code * b.code)::DOUBLE / sqrt(sum(a.code * a.code)::DOUBLE * sum(b.code * b.code)::DOUBLE)), 6) AS score FROM c a JOIN c b ON a.dim = b.dim AND b.id % 50 = 0 GROUP BY a.id, b.id)"


@query(f"WITH {VECTORS_SQL}, {_UNIT}, {_PARAMS}, {_CODES}, {_CODE_SCORE} {ranked_sql('SELECT * FROM s', 10)}")
def sq8_exact_topk(spark: SparkSession, d: str) -> DataFrame:
    return quantize.sq8_top_k(vectors(spark, d), probes(spark, d), 10)


@query(f"WITH {VECTORS_SQL}, {_UNIT}, {_PARAMS}, {_CODES}, {_CODE_SCORE}, k AS ({ranked_sql('SELECT * FROM s', 40)}), f AS (SELECT k.query, v.id, {SCORE_SQL} AS score FROM k JOIN v USING (id) JOIN v q ON q.id = k.query) {ranked_sql('SELECT * FROM f', 10)}")
def sq8_rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    return quantize.sq8_rerank(rows, probes(spark, d), 10, rows.count())


_HAMMING = "h AS (SELECT q.id AS query, v.id, list_sum(list_transform(list_zip(v.vector, q.vector), lambda z: ((z[1] > 0) <> (z[2] > 0))::INT))::INT AS hamming, " + SCORE_SQL + " AS score FROM v, (SELECT * FROM v WHERE id % 50 = 0) q)"


@query(f"WITH {VECTORS_SQL}, {_HAMMING} SELECT query, id, hamming, score FROM h")
def bq1_hamming(spark: SparkSession, d: str) -> DataFrame:
    return quantize.bq1_distances(vectors(spark, d), probes(spark, d))


@query(f"WITH {VECTORS_SQL}, {_HAMMING} {ranked_sql(f'SELECT * FROM h WHERE hamming <= 0.45 * {DIM}', 10)}")
def bq1_prefilter_rerank(spark: SparkSession, d: str) -> DataFrame:
    return quantize.bq1_top_k(vectors(spark, d), probes(spark, d), 10, 0.45, DIM)


_TOP = ranked_sql("SELECT query, id, score FROM h", 10)


@query(f"WITH {VECTORS_SQL}, {_HAMMING}, t AS ({_TOP}), b AS ({ranked_sql(f'SELECT * FROM h WHERE hamming <= 0.4 * {DIM}', 10)}) SELECT t.query, round(count(b.id) / greatest(count(*), 1), 6) AS recall FROM t LEFT JOIN b USING (query, id) GROUP BY t.query")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    rows, q = vectors(spark, d), probes(spark, d)
    return search.recall(quantize.bq1_top_k(rows, q, 10, 0.4, DIM), search.top_k(rows, q, 10)).select("query", F.round("recall", 6).alias("recall"))


THRESHOLDS = [k / 20 for k in range(21)]


@query(f"""WITH {VECTORS_SQL}, {_HAMMING}, t AS (SELECT h.query, h.id, hamming FROM h JOIN ({_TOP}) USING (query, id)),
 k AS (SELECT unnest([{', '.join(map(str, THRESHOLDS))}])::DOUBLE AS threshold),
 r AS (SELECT threshold, query, sum((hamming <= threshold * {DIM})::INT) / count(*) AS r FROM t, k GROUP BY ALL)
 SELECT threshold, round(avg(r), 6) AS recall, (SELECT round(sum((hamming > r.threshold * {DIM})::INT) / count(*), 6) FROM h) AS skip_rate FROM r GROUP BY threshold""")
def calibrate_curve(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.curve(*quantize.bq1_spread(vectors(spark, d), probes(spark, d), 10), THRESHOLDS, DIM)


@query(f"""WITH {VECTORS_SQL}, {_HAMMING}, t AS (SELECT h.query, h.id, hamming FROM h JOIN ({_TOP}) USING (query, id)),
 k AS (SELECT unnest(range(1, 257)) / 256.0 AS threshold), r AS (SELECT threshold, query, sum((hamming <= threshold * {DIM})::INT) / count(*) AS r FROM t, k GROUP BY ALL)
 SELECT min(threshold)::DOUBLE AS threshold FROM (SELECT threshold FROM r GROUP BY threshold HAVING round(avg(r), 6) >= 0.99)""")
def calibrated_threshold(spark: SparkSession, d: str) -> DataFrame:
    """What eight halvings find: the least 256th of the dimension with the recall."""
    found = calibrate.calibrated_on(*quantize.bq1_spread(vectors(spark, d), probes(spark, d), calibrate.Plan.k), DIM)
    return spark.createDataFrame([(found["threshold"],)], "threshold double")


# Sparse scoring and fusion

_TOKENS = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda t: t <> '')"
_BM25 = f"""w AS (SELECT doc_id AS id, {_TOKENS.format('text')} AS w FROM documents), a AS (SELECT count(*) AS n, avg(len(w)) AS l FROM w),
 t AS (SELECT id, len(w) AS len, unnest(w) AS term FROM w), tf AS (SELECT id, len, term, count(*) AS tf FROM t GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 qt AS (SELECT item_id AS query, unnest(list_distinct({_TOKENS.format('text')})) AS term FROM benchmark),
 s AS (SELECT query, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / l))), 6) AS score FROM qt JOIN df USING (term) JOIN tf USING (term), a GROUP BY ALL),
 sparse AS ({ranked_sql('SELECT * FROM s', 10)})"""


def _sparse(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    q = read(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    return hybrid.bm25_top_k(docs, q, 10)


@query(f"WITH {_BM25} SELECT query, id, score, rank FROM sparse")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _sparse(spark, d)


_DENSE10 = f"dense AS ({ranked_sql(f'SELECT query // 50 AS query, id, score FROM ({_pairs_sql()})', 10)})"


def _dense(spark: SparkSession, d: str) -> DataFrame:
    """Ranked vectors, with their queries numbered like the texts of the benchmark."""
    return search.top_k(vectors(spark, d), probes(spark, d), 10).withColumn("query", F.expr("query div 50"))


@query(f"WITH {VECTORS_SQL}, {_BM25}, {_DENSE10}, f AS (SELECT query, id, round(sum(1.0 / (100 + rank)), 9) AS score FROM (SELECT query, id, rank FROM sparse UNION ALL SELECT query, id, rank FROM dense) GROUP BY ALL) {ranked_sql('SELECT * FROM f', 10)}")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.rrf([_dense(spark, d), _sparse(spark, d)], 10)


def _scaled(t: str, w: float) -> str:
    return f"SELECT query, id, {w} * CASE WHEN max(score) OVER q > min(score) OVER q THEN (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) ELSE 1.0 END AS part FROM {t} WINDOW q AS (PARTITION BY query)"


@query(f"WITH {VECTORS_SQL}, {_BM25}, {_DENSE10}, f AS (SELECT query, id, round(sum(part), 6) AS score FROM ({_scaled('dense', 0.7)} UNION ALL {_scaled('sparse', 0.3)}) GROUP BY ALL) {ranked_sql('SELECT * FROM f', 10)}")
def weighted_fusion(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.weighted([(_dense(spark, d), 0.7), (_sparse(spark, d), 0.3)], 10)


# Paths

IGNORE = ["blog.*", "de/", "fr/1", "*.html"]
_URL_PATH = "regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g')"
_PATH = f"p AS (SELECT page_id, {_URL_PATH} AS path FROM pages)"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", paths.slashes(F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1)).alias("path"))


@query(f"WITH {_PATH} SELECT page_id, path, regexp_matches('/' || trim(path, '/') || '/', '/(de|fr/1|[^/]*\\.html)/') AS ignored FROM p")
def ignore_match(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("page_id", "path", paths.ignored(F.col("path"), IGNORE).alias("ignored"))


@query(f"WITH {FILES_SQL} SELECT relativePath FROM files WHERE regexp_matches(relativePath, '[.](rs|go)$')")
def ext_allowlist(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).where(paths.allowed_extension(F.col("relativePath"), [".RS", "go "])).select("relativePath")


@query(f"WITH {_PATH} SELECT page_id, CASE WHEN regexp_matches(path, '[.][^./]+$') THEN lower(regexp_extract(path, '[.]([^./]+)$', 1)) END AS ext FROM p")
def ext_of_path(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("page_id", paths.extension(F.col("path")).alias("ext"))


@query(f"WITH {FILES_SQL} SELECT relativePath, CASE string_split(relativePath, '.')[-1] WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'md' THEN 'markdown' ELSE 'go' END AS language FROM files")
def lang_from_ext(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("relativePath", paths.language(paths.extension(F.col("relativePath"))).alias("language"))


@query(r"SELECT page_id, CASE WHEN x = '' THEN '.' ELSE x END AS path FROM (SELECT page_id, regexp_replace(replace(replace(url, '/', '\'), '\', '/'), '/+', '/', 'g') AS x FROM pages)")
def norm_path(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", paths.normalized(F.replace("url", F.lit("/"), F.lit("\\"))).alias("path"))


@query(f"""WITH {_PATH}, q AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN path WHEN 1 THEN './' || substr(path, 2) WHEN 2 THEN '..' || path ELSE 'a' || path END AS path FROM p)
 SELECT page_id, CASE WHEN starts_with(path, '/') OR contains('/' || trim(regexp_replace(path, '^([.]/)+', ''), '/') || '/', '/../') THEN NULL WHEN trim(regexp_replace(path, '^([.]/)+', ''), '/') = '' THEN '.' ELSE trim(regexp_replace(path, '^([.]/)+', ''), '/') END AS safe FROM q""")
def safe_path(spark: SparkSession, d: str) -> DataFrame:
    k, p = F.col("page_id") % 4, F.col("path")
    made = F.when(k == 0, p).when(k == 1, F.concat(F.lit("./"), F.substring(p, 2, 1 << 20))).when(k == 2, F.concat(F.lit(".."), p)).otherwise(F.concat(F.lit("a"), p))
    return _paths(spark, d).select("page_id", paths.safe(made).alias("safe"))


@query(f"WITH {_PATH} SELECT page_id, ltrim(path, '/') AS path, ltrim(path, '/') = 'de' OR starts_with(ltrim(path, '/'), 'de/') OR ltrim(path, '/') = '.context' AS reserved FROM p")
def reserved_dir(spark: SparkSession, d: str) -> DataFrame:
    """The state folder's test, with the pages' folder `de` in its place."""
    p = _paths(spark, d).select("page_id", F.ltrim("path", F.lit("/")).alias("path"))
    moved = F.regexp_replace("path", "^de(/|$)", paths.STATE_DIR + "$1")
    return p.select("page_id", "path", paths.reserved(moved).alias("reserved"))


@query(f"WITH {FILES_SQL} SELECT relativePath FROM files WHERE relativePath IN (SELECT source || '/doc_' || lpad(doc_id::VARCHAR, 6, '0') || '.py' FROM documents WHERE doc_id % 5 = 1)")
def file_list(spark: SparkSession, d: str) -> DataFrame:
    """Files of a list whose paths have backslashes and doubled slashes."""
    every = files(spark, d).select(F.col("relativePath").alias("path"), "content")
    listed = [r[0] for r in every.where("path LIKE '%.py'").select(F.replace("path", F.lit("/"), F.lit("\\\\"))).collect()]
    return sources.restricted(every, [*listed, "nosuch.py"]).select(F.col("path").alias("relativePath"))


# Chunks

SIZE, OVERLAP, BYTES = 5, 2, 500
_LINES = "l AS (SELECT doc_id, i, CASE WHEN i < n THEN p || chr(10) ELSE p END AS line FROM (SELECT doc_id, unnest(string_split(content, chr(10))) AS p, generate_subscripts(string_split(content, chr(10)), 1) AS i, len(string_split(content, chr(10))) AS n FROM files) WHERE NOT (i = n AND n > 1 AND p = ''))"
_COUNT = "n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)"


def _window_sql(overlap: int) -> str:
    return f"r AS (SELECT doc_id, k AS pos, greatest(1, k * {SIZE} + 1 - CASE WHEN k > 0 THEN {overlap} ELSE 0 END) AS s, least(n, (k + 1) * {SIZE}) AS e FROM (SELECT doc_id, n, unnest(range(ceil(n / {SIZE})::BIGINT)) AS k FROM n))"


def _ranges(spark: SparkSession, d: str, overlap: int) -> DataFrame:
    rows = files(spark, d).select("doc_id", F.posexplode(chunking.windows(chunking.line_count(F.col("content")), SIZE, overlap)).alias("pos", "r"))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("r.s").cast("bigint").alias("s"), F.col("r.e").cast("bigint").alias("e"))


@query(f"WITH {FILES_SQL}, {_LINES}, {_COUNT}, {_window_sql(0)} SELECT doc_id, pos, s, e FROM r")
def chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    return _ranges(spark, d, 0)


@query(f"WITH {FILES_SQL}, {_LINES}, {_COUNT}, {_window_sql(OVERLAP)} SELECT doc_id, pos, s, e FROM r")
def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _ranges(spark, d, OVERLAP)


@query(f"WITH {FILES_SQL}, {_LINES}, {_COUNT}, {_window_sql(0)}, t AS (SELECT doc_id, pos, s, e FROM r UNION ALL SELECT doc_id, pos + 1000, s, e FROM r) SELECT doc_id AS doc, min(pos) AS pos, s, e FROM t GROUP BY doc_id, s, e")
def chunk_dedupe(spark: SparkSession, d: str) -> DataFrame:
    r = _ranges(spark, d, 0).withColumnRenamed("doc_id", "doc")
    return chunking.deduped(r.unionAll(r.withColumn("pos", F.col("pos") + 1000)))


_BYTES = f"""f AS (SELECT r.doc_id, r.pos, r.s, r.e, l.i, strlen(l.line) AS z, row_number() OVER (PARTITION BY r.doc_id, r.pos ORDER BY l.i) AS k FROM r JOIN l ON l.doc_id = r.doc_id AND l.i BETWEEN r.s AND r.e),
 g AS (SELECT doc_id, pos, k, i, z, z AS size, 1 AS part, z > {BYTES} AS alone FROM f WHERE k = 1
  UNION ALL SELECT f.doc_id, f.pos, f.k, f.i, f.z, CASE WHEN f.z > {BYTES} OR g.alone OR (g.size > 0 AND g.size + f.z > {BYTES}) THEN f.z ELSE g.size + f.z END,
   CASE WHEN f.z > {BYTES} OR g.alone OR (g.size > 0 AND g.size + f.z > {BYTES}) THEN g.part + 1 ELSE g.part END, f.z > {BYTES}
  FROM g JOIN f ON f.doc_id = g.doc_id AND f.pos = g.pos AND f.k = g.k + 1),
 b AS (SELECT doc_id, pos, part, min(i) AS s, max(i) AS e FROM g GROUP BY ALL HAVING sum(z) > 0)"""


@query(f"WITH RECURSIVE {FILES_SQL}, {_LINES}, {_COUNT}, {_window_sql(0)}, {_BYTES} SELECT doc_id, s, e FROM b")
def chunk_bytelimit(spark: SparkSession, d: str) -> DataFrame:
    def cut(l):
        return chunking.byte_limited(chunking.windows(F.size(l), SIZE), F.transform(l, lambda x: F.octet_length(x)), BYTES)

    rows = files(spark, d).select("doc_id", F.explode(chunking._bind(chunking.lines_of(F.col("content")), cut)).alias("r"))
    return rows.select("doc_id", F.col("r.s").cast("bigint").alias("s"), F.col("r.e").cast("bigint").alias("e"))


_CONTENT = f"c AS (SELECT r.doc_id, r.s, r.e, string_agg(l.line, '' ORDER BY l.i) AS content FROM r JOIN l ON l.doc_id = r.doc_id AND l.i BETWEEN r.s AND r.e GROUP BY ALL)"


@query(f"WITH {FILES_SQL}, {_LINES}, {_COUNT}, {_window_sql(OVERLAP)}, {_CONTENT} SELECT relativePath, s AS startLine, e AS endLine, 'chunk_' || left(sha256(relativePath || ':' || s || ':' || e || ':' || c.content), 16) AS id FROM c JOIN files USING (doc_id)")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    out = chunking.chunked(files(spark, d), SIZE, OVERLAP, 1 << 30)
    return out.select("relativePath", F.col("startLine").cast("bigint").alias("startLine"), F.col("endLine").cast("bigint").alias("endLine"), "id")


@query(f"WITH {FILES_SQL}, {_LINES}, {_COUNT}, {_window_sql(0)} SELECT relativePath, s AS startLine, e AS endLine FROM r JOIN files USING (doc_id) ORDER BY relativePath, pos LIMIT 300")
def chunk_limit(spark: SparkSession, d: str) -> DataFrame:
    return chunking.limited(chunking.chunked(files(spark, d), SIZE, 0, 1 << 30), 300).select("relativePath", F.col("startLine").cast("bigint").alias("startLine"), F.col("endLine").cast("bigint").alias("endLine"))


@query()
def chunk_fragments(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunked(files(spark, d), 40, 8, 400).select("relativePath", "startLine", "endLine", "fragmentStartByte", "fragmentEndByte", "id")


@query()
def ast_chunks(spark: SparkSession, d: str) -> DataFrame:
    code = F.concat(F.lit("import os\n\n\nclass A:\n    def f(self):\n        return "), F.col("doc_id").cast("string"), F.lit("\n\n    @cached\n    def g(self):\n        return 2\n\n\nx = 1\n"))
    return chunking.syntax_chunks(files(spark, d).select("relativePath", code.alias("content"), F.lit("python").alias("language")), 4)


# Identifiers


@query("SELECT DISTINCT source, 'code_chunks_' || left(md5('/data/' || source), 8) AS dense, 'hybrid_code_chunks_' || left(md5('/data/' || source), 8) AS hybrid, 'codebase_' || left(md5('/data/' || source), 12) AS codebase FROM documents")
def collection_name(spark: SparkSession, d: str) -> DataFrame:
    root = F.concat(F.lit("/data/"), F.col("source"))
    return read(spark, d, "documents").select("source").distinct().select("source", ids.collection_name(root).alias("dense"), ids.collection_name(root, True).alias("hybrid"), ids.codebase_id(root).alias("codebase"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def file_hash(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


@query("SELECT conv_id, turn, sha256(encode('ns') || '\\x00'::BLOB || encode(text)) AS cache_key FROM conversations")
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", ids.cache_key(F.lit("ns"), F.col("text")).alias("cache_key"))


@query("""WITH h AS (SELECT doc_id, sha256(encode(text) || '\\x3A\\x00\\x00\\x00\\x00\\x00\\x00\\x00\\x00'::BLOB) AS a, sha256(encode(text) || '\\x3A\\x01\\x00\\x00\\x00\\x00\\x00\\x00\\x00'::BLOB) AS b FROM documents),
 i AS (SELECT doc_id, a || b AS h, unnest(range(48)) AS dim FROM h) SELECT doc_id, dim::INT AS dim, round((('0x' || substr(h, 2 * dim + 1, 2))::INT / 255.0)::FLOAT::DOUBLE, 6) AS value FROM i""")
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.posexplode(ids.hash_embedding(F.col("text"), 48)).alias("dim", "x")).select("doc_id", "dim", F.round(F.col("x").cast("double"), 6).alias("value"))


@query(f"WITH {FILES_SQL} SELECT sha256('root:' || string_agg(sha256(content), '' ORDER BY relativePath)) AS root FROM files")
def merkle_root(spark: SparkSession, d: str) -> DataFrame:
    return sync.hashed(files(spark, d), "relativePath").agg(ids.merkle_root(F.col("path"), F.col("hash")).alias("root"))


# Collections and change detection


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f, k = files(spark, d), F.col("doc_id") % 10
    old = f.where(k != 0)
    new = f.where(k != 1).withColumn("content", F.when(k == 2, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return old, new


_CHANGES = f"{FILES_SQL}, ch AS (SELECT doc_id, relativePath AS path, CASE doc_id % 10 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'modified' END AS change FROM files WHERE doc_id % 10 < 3)"


@query(f"WITH {_CHANGES} SELECT path, change FROM ch")
def file_diff(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return sync.changes(sync.hashed(old, "relativePath"), sync.hashed(new, "relativePath"))


@query(f"WITH {_CHANGES} SELECT change, count(*) AS n FROM ch GROUP BY change")
def change_counts(spark: SparkSession, d: str) -> DataFrame:
    return file_diff(spark, d).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CHANGES} SELECT path FROM ch WHERE change <> 'removed'")
def paths_to_index(spark: SparkSession, d: str) -> DataFrame:
    return sync.to_index(file_diff(spark, d))


@query(f"WITH {_CHANGES} SELECT relativePath, sha256(CASE WHEN doc_id % 10 = 2 THEN content || '!' ELSE content END) AS hash FROM files WHERE doc_id % 10 <> 1")
def reindex_apply(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    changed = sync.changes(sync.hashed(old, "relativePath"), sync.hashed(new, "relativePath"))
    h = F.sha2(F.col("content").cast("binary"), 256).alias("hash")
    fresh = new.join(sync.to_index(changed), F.col("relativePath") == F.col("path"), "left_semi").select("relativePath", h)
    return sync.applied(old.select("relativePath", h), changed, fresh)


@query("SELECT user_id::VARCHAR AS id, event_id AS sequence, 0 AS pos, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("sequence"), F.lit(0).alias("pos"), "value")
    return collection.last_writes(rows)


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 3 <> 0")
def delete_anti(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).select("id")
    return collection.without_ids(rows, rows.where("id % 3 = 0").unionAll(spark.range(-3, 0)))


@query(f"WITH {FILES_SQL} SELECT doc_id AS id, relativePath FROM files WHERE doc_id % 5 <> 2")
def delete_by_path(spark: SparkSession, d: str) -> DataFrame:
    rows = files(spark, d).select(F.col("doc_id").alias("id"), "relativePath")
    return collection.without_ids(rows, rows.where("id % 5 = 2").unionAll(spark.createDataFrame([(-1, "nosuch")], rows.schema)), "relativePath")


_TWICE = "t AS (SELECT vec_id % 400 AS id, vec_id AS origin FROM embeddings)"


@query(f"WITH {_TWICE} SELECT id, count(*) AS n, list(origin ORDER BY origin)::VARCHAR AS origins FROM t GROUP BY id HAVING count(*) > 1")
def duplicate_report(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).select((F.col("id") % 400).alias("id"), F.col("id").alias("origin"))
    return collection.duplicates(rows).withColumn("origins", F.concat(F.lit("["), F.array_join("origins", ", "), F.lit("]")))


@query("SELECT doc_id % 700 AS id, count(*) AS n, min(left(text, 80)) AS sample FROM documents GROUP BY 1 HAVING count(*) > 1")
def sidecar_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return collection.sidecar_duplicates(read(spark, d, "documents").select((F.col("doc_id") % 700).alias("id"), F.col("text").alias("content")))


# Cache, routing, estimates

_CACHE = "c AS (SELECT sha256(encode('ns') || '\\x00'::BLOB || encode(text)) AS cache_key, strlen(text) AS size_bytes, doc_id * 37 % 1000 AS last_accessed_ms FROM documents )"


def _cache(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents")
    return rows.select(ids.cache_key(F.lit("ns"), F.col("text")).alias("cache_key"), F.octet_length("text").cast("bigint").alias("size_bytes"), (F.col("doc_id") * 37 % 1000).alias("last_accessed_ms"))


@query(f"WITH {_CACHE}, k AS (SELECT DISTINCT cache_key FROM c WHERE last_accessed_ms < 500) SELECT doc_id, k.cache_key IS NOT NULL AS hit FROM documents d LEFT JOIN k ON k.cache_key = sha256(encode('ns') || '\\x00'::BLOB || encode(d.text))")
def cache_lookup_split(spark: SparkSession, d: str) -> DataFrame:
    texts = embcache.keyed(read(spark, d, "documents").select("doc_id", "text"), "ns")
    known = _cache(spark, d).where("last_accessed_ms < 500").select("cache_key").distinct().withColumn("vector", F.lit(1))
    return embcache.lookup(texts, known).select("doc_id", F.col("vector").isNotNull().alias("hit"))


MOST_CACHED = 400_000


@query(f"WITH {_CACHE}, u AS (SELECT cache_key, min(size_bytes) AS size_bytes, max(last_accessed_ms) AS last_accessed_ms FROM c GROUP BY 1) SELECT cache_key, size_bytes, last_accessed_ms FROM (SELECT *, sum(size_bytes) OVER (ORDER BY last_accessed_ms DESC, cache_key ROWS UNBOUNDED PRECEDING) AS s FROM u) WHERE s <= {MOST_CACHED}")
def cache_evict_lru(spark: SparkSession, d: str) -> DataFrame:
    rows = _cache(spark, d).groupBy("cache_key").agg(F.min("size_bytes").alias("size_bytes"), F.max("last_accessed_ms").alias("last_accessed_ms"))
    return embcache.kept_by_lru(rows, MOST_CACHED)


@query("SELECT doc_id, doc_id // 32 + 1 AS batch, CASE WHEN doc_id // 32 + 1 <= 5 THEN 'remote' ELSE 'local' END AS route FROM documents")
def route_split(spark: SparkSession, d: str) -> DataFrame:
    batch = F.floor(F.col("doc_id") / 32) + 1
    return read(spark, d, "documents").select("doc_id", batch.alias("batch"), embcache.routed(batch, 5).alias("route"))


@query("SELECT count(*) AS files, sum(strlen(text))::BIGINT AS bytes, sum(length(text))::BIGINT AS chars FROM documents")
def corpus_totals(spark: SparkSession, d: str) -> DataFrame:
    return estimate.totals(files(spark, d)).select("files", "bytes", "chars")


@query("""WITH t AS (SELECT sum(length(text))::BIGINT AS chars FROM documents), c AS (SELECT chars, (chars + 2199) // 2200 AS estimated_chunks FROM t),
 b AS (SELECT *, (estimated_chunks * (4 * 384 + 1000) * 3 + 1) // 2 AS estimated_bytes_low, (estimated_chunks * (4 * 1024 + 1000) * 3 + 1) // 2 AS estimated_bytes_high FROM c)
 SELECT chars, estimated_chunks, estimated_bytes_low, estimated_bytes_high, greatest(estimated_bytes_high, 134217728) * 2 AS required_free_bytes FROM b""")
def storage_estimate(spark: SparkSession, d: str) -> DataFrame:
    return estimate.estimated(estimate.totals(files(spark, d)).select("chars"), 2500, 384, 1024)


# Logs and telemetry

_LOG = "g AS (SELECT event_type AS part, event_id AS place, CASE WHEN event_id % 50 = 7 THEN event_id - 60 ELSE event_id END AS sequence FROM events)"


@query(f"WITH {_LOG} SELECT part, place, sequence, before FROM (SELECT *, lag(sequence) OVER (PARTITION BY part ORDER BY place) AS before FROM g) WHERE before >= sequence")
def wal_sequence_check(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("event_type").alias("part"), F.col("event_id").alias("place"), F.when(F.col("event_id") % 50 == 7, F.col("event_id") - 60).otherwise(F.col("event_id")).alias("sequence"))
    return wal.out_of_order(e)


@query("SELECT event_id AS sequence, user_id FROM events WHERE event_id > 5000")
def wal_compact(spark: SparkSession, d: str) -> DataFrame:
    return wal.compacted(read(spark, d, "events").select(F.col("event_id").alias("sequence"), "user_id"), 5000)


_EMA = """o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 m AS (SELECT user_id, k, value, value AS ema FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, o.value, 0.1 * o.value + 0.9 * m.ema FROM m JOIN o ON o.user_id = m.user_id AND o.k = m.k + 1),
 z AS (SELECT user_id, max(k) AS samples, arg_max(ema, k) AS ema FROM m GROUP BY user_id)"""


@query(f"WITH RECURSIVE {_EMA} SELECT user_id, samples::INT AS samples, round(ema, 6) AS ema FROM z")
def ema_skip_rate(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.smoothed(read(spark, d, "events"), "user_id", "value", ["ts", "event_id"]).select("user_id", "samples", F.round("ema", 6).alias("ema"))


@query(f"WITH RECURSIVE {_EMA} SELECT e.event_id, z.samples >= 10 AND abs(e.value - round(z.ema, 6)) > 0.15 AS drift FROM events e JOIN z USING (user_id)")
def drift_flag(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "user_id", "value").join(ema_skip_rate(spark, d), "user_id")
    return e.select("event_id", calibrate.drifted(F.col("value"), F.col("ema"), F.col("samples")).alias("drift"))


@query(f"WITH RECURSIVE {_EMA.replace('ts, event_id', 'event_id')} SELECT user_id, samples::INT AS samples, round(ema, 6) AS ema FROM z")
def stream_ema(spark: SparkSession, d: str) -> DataFrame:
    """The same averages from a stream, in one micro-batch, as rows of its sink."""
    schema = read(spark, d, "events").schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(d)
    rows = ema.smoothed(src, "user_id", "value", "event_id")
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them see")
        top = tempfile.mkdtemp()
    out = f"{top}/ema-{uuid.uuid4().hex}"
    run = rows.writeStream.outputMode("update").foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{out}/rows/epoch={k}")).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("user_id", F.col("samples").cast("int").alias("samples"), F.round("ema", 6).alias("ema"))


@query(f"WITH {_LOG} SELECT min(event_id) AS start, max(event_id) AS end, count(*) AS n FROM events WHERE event_id > 100")
def wal_gaps(spark: SparkSession, d: str) -> DataFrame:
    return wal.gaps(read(spark, d, "events").select(F.col("event_id").alias("sequence")), 100)


# Labels and redaction


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN ' ' ELSE text END AS text FROM conversations")
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    made = F.when(F.col("turn") % 3 == 0, F.lit("")).otherwise(F.col("text"))
    return read(spark, d, "conversations").select("conv_id", "turn", text.embedding_text(made).alias("text"))


@query("""WITH k AS (SELECT event_id, ['api_key', 'path', 'authToken', 'level', 'PassWord'][event_id % 5 + 1] AS k FROM events)
 SELECT event_id, k AS key, CASE WHEN regexp_matches(upper(k), 'KEY|TOKEN|SECRET|PASSWORD|CREDENTIAL|AUTH') THEN '[REDACTED]' ELSE event_id::VARCHAR END AS value FROM k""")
def redact_fields(spark: SparkSession, d: str) -> DataFrame:
    key = F.get(F.array(*map(F.lit, ("api_key", "path", "authToken", "level", "PassWord"))), (F.col("event_id") % 5).cast("int"))
    return read(spark, d, "events").select("event_id", key.alias("key")).withColumn("value", text.redacted(F.col("key"), F.col("event_id").cast("string")))


@query("SELECT DISTINCT event_type, 'ERR_VECTOR_' || upper(regexp_replace(event_type || '-x.y', '[^A-Za-z0-9]', '_', 'g')) AS code FROM events")
def error_code_map(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_type").distinct().withColumn("code", text.error_code(F.lit("vector"), F.concat("event_type", F.lit("-x.y"))))


@query("SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 0 ELSE least(event_id % 13, user_id % 10) * 100 // (user_id % 10) END::INT AS pct FROM events")
def progress_pct(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", text.progress_percent(F.col("event_id") % 13, F.col("user_id") % 10).alias("pct"))


@query("""WITH p AS (SELECT event_id, ['Scanning files', 'processing', 'chunk 3', 'Finalizing', 'prewarm', 'create collection', 'embedding'][event_id % 7 + 1] AS phase FROM events)
 SELECT event_id, phase, ['scan', 'chunk', 'chunk', 'publish', 'publish', 'prepare', 'index'][event_id % 7 + 1] AS stage FROM p""")
def stage_label(spark: SparkSession, d: str) -> DataFrame:
    phase = F.get(F.array(*map(F.lit, ("Scanning files", "processing", "chunk 3", "Finalizing", "prewarm", "create collection", "embedding"))), (F.col("event_id") % 7).cast("int"))
    return read(spark, d, "events").select("event_id", phase.alias("phase")).withColumn("stage", text.stage_of(F.col("phase")))


@query(r"""SELECT conv_id, turn, '"' || replace(replace(text, '\', '\\'), '"', '\"') || '"' AS quoted FROM conversations""")
def filter_quote(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", text.quoted(F.col("text")).alias("quoted"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '{"kind":"' || event_type || '","user":"' || user_id || '"}'
 ELSE '{"kind":"' || event_type || '","user":"u","turn":"' || event_id % 4 || '"}' END AS metadata FROM events""")
def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the second object win; every fourth is no object."""
    base = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("user")))
    more = F.when(F.col("event_id") % 4 != 0, F.to_json(F.struct(F.lit("u").alias("user"), (F.col("event_id") % 4).cast("string").alias("turn")))).otherwise(F.lit("[1"))
    return read(spark, d, "events").select("event_id", text.merged_metadata(base, more).alias("metadata"))


# Vectors by row


@query("""WITH t AS (SELECT vec_id, unnest(range(16)) AS i, embedding AS e FROM embeddings), p AS (
 SELECT vec_id, j, avg(e[i * 4 + j + 1]::DOUBLE) AS x FROM t, (SELECT unnest(range(4)) AS j) WHERE (i + vec_id) % 3 <> 0 GROUP BY ALL)
 SELECT vec_id, j::INT AS j, round(x, 6) AS x FROM p""")
def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    """Each embedding as 16 tokens of 4 numbers, a third of them masked."""
    places = F.sequence(F.lit(0), F.lit(15))
    tokens = F.transform(places, lambda i: F.slice("embedding", i * 4 + 1, F.lit(4)))
    mask = F.transform(places, lambda i: ((i + F.col("vec_id")) % 3).cast("int"))
    pooled = read(spark, d, "embeddings").select("vec_id", F.posexplode(V.mean_pooled(tokens, mask)).alias("j", "x"))
    return pooled.select("vec_id", "j", F.round("x", 6).alias("x"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS a, list_reverse(embedding)::DOUBLE[] AS b FROM embeddings)
 SELECT vec_id, round(list_dot_product(a, b), 6) AS dot, round(greatest(0, list_cosine_similarity(a, b)), 6) AS cosine FROM v""")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The functions as a SQL session calls them, on each vector and its mirror image."""
    functions.register(spark)
    v = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    return v.selectExpr("vec_id", "round(dot_score(a, reverse(a)), 6) AS dot", "round(cosine_score(a, reverse(a)), 6) AS cosine")

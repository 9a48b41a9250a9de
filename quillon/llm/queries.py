"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, line_dedup, mixing, ngram_join, pii, quality, toxicity, url_filter
from .common import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer(path: str | None = None) -> bytes:
    """Content of the vocabulary file, read on the driver; the default is the public 50k one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Path(path).read_bytes()


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer())
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quality")
    rows = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", *[q[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


_W = "[^ \\t\\n\\x0B\\x0C\\r]+"
QUALITY_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '{_W}') AS w FROM d),
t AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM t),
rep AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep WHERE n > 1) GROUP BY r),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup FROM ln WHERE regexp_matches(l, '{_W}') GROUP BY r),
m AS (SELECT d.doc_id, len(w.w)::BIGINT AS n_words,
 coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
 (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
 coalesce(lines.dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
 coalesce(lines.n_lines, 0) AS n_lines,
 len(list_filter(w.w, lambda x: lower(x) IN ({', '.join(f"'{x}'" for x in quality.STOP_WORDS)}))) AS n_stop
 FROM d JOIN w USING (r) LEFT JOIN cov USING (r) LEFT JOIN lines USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR word_chars::DOUBLE / n_words < 2 OR word_chars::DOUBLE / n_words > 20
  OR n_symbols::DOUBLE / word_chars > 0.05 OR n_stop::DOUBLE / n_words < 0.02
  OR n_dup_lines::DOUBLE / n_lines > 0.6) AS kept
FROM b
"""
ORACLE_SQL["op3_quality"] = QUALITY_SQL


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "epochs")


ORACLE_SQL["op5_mixing"] = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_W}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1)::INT AS place FROM s),
w AS (SELECT *, [{', '.join(f'{float(x)}::DOUBLE' for x in mixing.WEIGHTS)}][place % {len(mixing.WEIGHTS)} + 1] AS weight, source_size::DOUBLE * {mixing.EPOCHS} AS cap, sum(source_size) OVER ()::DOUBLE * {mixing.BUDGET}::DOUBLE AS total FROM p),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
o AS (SELECT level FROM l WHERE level * weight < cap ORDER BY cap / weight, place LIMIT 1),
f AS (SELECT *, least(cap, coalesce((SELECT level FROM o) * weight, cap)) AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM f),
r AS (SELECT *, target - whole * source_size AS rest FROM g),
i AS (SELECT source, doc_id, ('0x' || left(md5(doc_id::VARCHAR || ':{mixing.SEED}'), 15))::BIGINT AS draw, sum(size) AS size FROM d GROUP BY ALL),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id) - size / 2.0 AS middle FROM i),
e AS (SELECT c.source, doc_id, rest > 0 AND max(middle) OVER (PARTITION BY c.source ORDER BY draw, doc_id) <= rest AS extra FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source)
SELECT d.doc_id, d.size, r.source_size, r.target, (r.whole + e.extra::INT) * d.size AS taken, (r.whole + e.extra::INT)::INT AS epochs
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN e ON e.source IS NOT DISTINCT FROM d.source AND e.doc_id = d.doc_id
"""


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def _glob_sql(g: str) -> str:
    """A glob as a pattern over host + path; stars before the first slash stay in the host."""
    out, slash = "", False
    for k, c in enumerate(g):
        slash |= c == "/"
        if c == "*":
            out += ".*" if slash or k == len(g) - 1 or g.startswith("*/") else "[^/]*"
        else:
            out += "[.]" if c == "." else c
    return f"regexp_full_match(host || path, '{out}', 's')"


_FITS = " ".join(f"WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'" for r in sorted(url_filter.HOST_RULES, key=lambda r: -len(r.name)))
_SAYS = " ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in url_filter.HOST_RULES)
ORACLE_SQL["op6_url_filter"] = f"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, CASE {_FITS} END AS rule FROM c)
SELECT page_id, host, path, rule, CASE {_SAYS} WHEN {' OR '.join(_glob_sql(g.glob) for g in url_filter.GLOB_RULES)} THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.grouped(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL["op9_exact_dedup"] = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
 doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans' counts and digest, and all spans; n_spans: base and added ones, secrets included."""
    rows = pii.spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def counted(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [counted(k) for k in pii.KINDS]
    return rows.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", (~toxicity.in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("sentences").alias("n_sentences"))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.cleaned(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_chunks", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


ORACLE_SQL["op4_line_dedup"] = """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d WHERE text IS NOT NULL),
h AS (SELECT *, ('0x' || substr(md5(l), 1, 7))::BIGINT AS h FROM l),
b AS (SELECT *, (h + 257 * coalesce(lag(h, 1) OVER w, 0) + 66049 * coalesce(lag(h, 2) OVER w, 0)) % 2147483647 % 4 = 0 AS ends FROM h WINDOW w AS (PARTITION BY r ORDER BY i)),
c AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM b),
g AS (SELECT r, doc_id, k, count(*) AS n, string_agg(l, chr(10) ORDER BY i) AS t FROM c GROUP BY r, doc_id, k),
f AS (SELECT *, n >= 2 AND row_number() OVER (PARTITION BY t, n >= 2 ORDER BY doc_id, k) > 1 AS gone FROM g)
SELECT d.doc_id, coalesce(sum(n), 0)::INT AS n_lines, count(f.k)::INT AS n_chunks, (count(*) FILTER (WHERE gone))::INT AS n_removed,
 sha256(coalesce(string_agg(t, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM d LEFT JOIN f USING (r) GROUP BY d.r, d.doc_id
"""


@query
def op4_line_dedup_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_line_dedup and beyond it every repeated run of line_dedup.LEAST_WORDS words or more."""
    rows = line_dedup.cleaned_runs(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_gone", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


@query
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


ORACLE_SQL["op10_chat"] = """
SELECT conv_id, turn AS at_turn, 0 AS level, turn, 0 AS idx, 'message' AS kind, NULL AS call_id, NULL::BOOLEAN AS linked, NULL::BOOLEAN AS valid,
 json_object('content', coalesce(text, ''), 'role', role, 'turn', turn)::VARCHAR AS json
FROM conversations
"""


@query
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


_FIVE = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(ngram_join.WORDS))
ORACLE_SQL["op7_ngram_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, {_FIVE} AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {ngram_join.WORDS - 2})) AS i FROM d WHERE len(w) >= {ngram_join.WORDS})
  UNION ALL SELECT doc_id, array_to_string(w, ' ') AS g FROM d WHERE len(w) BETWEEN 1 AND {ngram_join.WORDS - 1}),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {ngram_join.OUT_OF} * c >= {ngram_join.SIMILAR} * (x.n + y.n - c)),
r AS (SELECT doc_id AS doc, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.root AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc, min(root) AS root FROM r GROUP BY doc) m ON m.doc = d.doc_id
"""

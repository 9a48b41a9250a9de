import hashlib
import math

from pyspark.sql import functions as F

from quillon.functions import ids, paths, text
from quillon.functions import vectors as V


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_ignore_patterns(spark):
    cases = [
        (["node_modules/", "target/"], "src/node_modules/pkg/index.js", True),
        (["src/generated"], "src/generated/code.rs", True),
        (["*.ipynb"], "docs/report.ipynb", True),
        ([".env"], "config/.env", True),
        ([".env"], "config/production.env", False),
        (["target/"], "target\\out\\file.txt", True),
        (["a/c"], "a/b/c", False),
        (["  ", ""], "a/b", False),
    ]
    for patterns, path, want in cases:
        assert one(spark, paths.ignored(F.col("p"), patterns), p=path) is want, (patterns, path)


def test_paths(spark):
    for p, ext in [("a/b.RS", "rs"), (".env", "env"), ("a.b/c", None), ("x.", None), ("a/b.tar.gz", "gz")]:
        assert one(spark, paths.extension(F.col("p")), p=p) == ext
    for e, lang in [(".ts", "typescript"), ("jsx", "javascript"), ("rs", "rust"), ("", "text"), ("h", "c"), ("hpp", "cpp"), ("zzz", "text")]:
        assert one(spark, paths.language(F.col("e")), e=e) == lang
    for p, safe in [(" ./a//b/ ", "a/b"), ("/a", None), ("C:/x", None), ("a/../b", None), ("", "."), ("a\\b", "a/b"), ("..", None), ("a..b", "a..b")]:
        assert one(spark, paths.safe(F.col("p")), p=p) == safe
    assert one(spark, paths.normalized(F.col("p")), p="a\\\\b//c") == "a/b/c"
    assert one(spark, paths.reserved(F.col("p")), p=".context/x") and not one(spark, paths.reserved(F.col("p")), p=".contextual")


def test_ids(spark):
    args = [F.col("p"), F.col("s"), F.col("e"), F.col("c")]
    want = "chunk_" + hashlib.sha256(b"a.rs:1:2:xy").hexdigest()[:16]
    assert one(spark, ids.chunk_id(*args), p="a.rs", s=1, e=2, c="xy") == want
    a = one(spark, ids.chunk_id(*args, F.lit(0), F.lit(8)), p="src/repeated.rs", s=10, e=20, c="xxxxxxxx")
    b = one(spark, ids.chunk_id(*args, F.lit(8), F.lit(16)), p="src/repeated.rs", s=10, e=20, c="xxxxxxxx")
    assert a != b
    v = one(spark, ids.hash_embedding(F.col("t"), 40), t="hé")
    raw = b"".join(hashlib.sha256("hé:".encode() + k.to_bytes(8, "little")).digest() for k in range(2))[:40]
    assert len(v) == 40 and all(abs(x - b / 255) < 1e-6 for x, b in zip(v, raw))


def test_cosine(spark):
    for a, b, want in [([255, 0], [255, 0], 0), ([255, 0], [0, 255], 1), ([255, 255], [255, 0], 1 - 1 / math.sqrt(2)), ([1, 0], [-1, 0], 2), ([0, 0], [1, 0], 1)]:
        got = one(spark, V.cosine_distance(F.col("a"), F.col("b")), a=[float(x) for x in a], b=[float(x) for x in b])
        assert abs(got - want) < 1e-12


def test_sign_words_and_hamming(spark):
    a = [1.0 if k % 3 else -1.0 for k in range(130)]
    b = [1.0 if k % 2 else -1.0 for k in range(130)]
    got = one(spark, V.hamming(V.sign_words(F.col("a")), V.sign_words(F.col("b"))), a=a, b=b)
    assert got == sum((x > 0) != (y > 0) for x, y in zip(a, b))


def test_sq8_bounds(spark):
    from quillon.operators import quantize

    rows = spark.createDataFrame([(k, [float((k * 37 + j * 11) % 1000 - 500) for j in range(4)]) for k in range(31)], "id int, vector array<double>")
    zero, scale = quantize.params_lists(quantize.sq8_params(rows))
    for r in rows.select("vector", V.sq8_dequantize(V.sq8_quantize(F.col("vector"), zero, scale), zero, scale).alias("d")).collect():
        assert all(abs(x - y) <= s / 2 + 1e-4 for x, y, s in zip(r.vector, r.d, scale))
    flat = spark.createDataFrame([(1, [2.0]), (2, [2.0])], "id int, vector array<double>")
    assert quantize.params_lists(quantize.sq8_params(flat)) == ([2.0], [1.0])


def test_validity(spark):
    for v, ok in [([1.0, 0.0], True), ([0.0, 0.0], False), ([1.0], False), ([float("nan"), 1.0], False), ([float("inf"), 1.0], False)]:
        assert one(spark, V.valid(F.col("v"), 2), v=v) is ok


def test_labels(spark):
    assert one(spark, text.redacted(F.col("k"), F.col("v")), k="API_KEY", v="sk") == "[REDACTED]"
    assert one(spark, text.redacted(F.col("k"), F.col("v")), k="LOG_LEVEL", v="debug") == "debug"
    assert [one(spark, text.progress_percent(F.col("a"), F.col("b")), a=a, b=b) for a, b in [(0, 0), (5, 10), (20, 10), (1, 3)]] == [0, 50, 100, 33]
    assert one(spark, text.stage_of(F.col("p")), p="Finalizing index") == "publish"
    assert one(spark, text.error_code(F.col("a"), F.col("b")), a="vector", b="invalid-filter") == "ERR_VECTOR_INVALID_FILTER"


def test_sql_functions(spark):
    from quillon.functions import sql

    assert "cosine_score" in sql.register(spark)
    got = spark.sql("SELECT cosine_score(array(1D, 0D), array(1D, 1D)) AS c, cosine_score(array(0D), array(1D)) AS z, cosine_score(array(-1D), array(1D)) AS o, hamming(array(5L), array(6L)) AS h, sq8_quantize(array(0.5D, 9D), array(0D, 0D), array(0.1D, 0.01D)) AS q, sq8_dequantize(array(5), array(1D), array(2D)) AS d, dot_score(array(2D), array(3D)) AS p").first()
    assert abs(got.c - 0.5**0.5) < 1e-12 and got.z == 0 and got.o == 0 and got.h == 2 and got.q == [5, 255] and got.d == [11.0] and got.p == 6


def test_zero_vectors_pooling_and_text(spark):
    from quillon.functions import text
    from quillon.functions import vectors as V

    rows = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r[0] for r in rows.select(V.normalized(F.col("v"))).collect()] == [None, [0.6, 0.8]]
    tokens = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 1.0]], [0])], "t array<array<float>>, m array<int>")
    assert [r[0] for r in tokens.select(V.mean_pooled(F.col("t"), F.col("m"))).collect()] == [[2.0, 3.0], None]
    said = spark.createDataFrame([('a"b\\c', '{"x":"1","y":"2"}', '{"y":"3"}'), ("", "no", None)], "v string, a string, b string")
    got = said.select(text.quoted(F.col("v")).alias("q"), text.merged_metadata(F.col("a"), F.col("b")).alias("m")).collect()
    assert [r.q for r in got] == ['"a\\"b\\\\c"', '""'] and [r.m for r in got] == ['{"x":"1","y":"3"}', "{}"]
    waits = [text.backoff_ms(k, 100, 1000, 0.2, 1) for k in range(6)]
    assert all(0.8 * min(1000, 100 * 2**k) <= w <= 1.2 * min(1000, 100 * 2**k) for k, w in enumerate(waits))

import pytest
from pyspark.sql import functions as F

from quillon.errors import EngineError
from quillon.operators import calibrate, chunking, embcache, hybrid, search


def spans(rows):
    return [(r.startLine, r.endLine) for r in rows]


def chunks(spark, text, **how):
    return chunking.chunked(spark.createDataFrame([("f", text)], "relativePath string, content string"), **how).orderBy("pos").collect()


def test_line_windows(spark):
    assert spans(chunks(spark, "a\nb\nc\nd\n", lines=2, overlap=1, most_bytes=100)) == [(1, 2), (2, 4)]
    assert chunks(spark, "", lines=2, overlap=0, most_bytes=100) == []


def test_byte_limit(spark):
    got = spark.range(1).select(chunking.byte_limited(F.array(F.struct(F.lit(1).alias("s"), F.lit(3).alias("e"))), F.array(F.lit(3), F.lit(3), F.lit(3)), 6).alias("r")).first().r
    assert [(x.s, x.e) for x in got] == [(1, 2), (3, 3)]


def test_long_line_is_cut_into_fragments(spark):
    got = chunks(spark, "a" * 123, lines=2, overlap=0, most_bytes=50)
    assert [(r.fragmentStartByte, r.fragmentEndByte, len(r.content)) for r in got] == [(0, 50, 50), (50, 100, 50), (100, 123, 23)]
    assert len({r.id for r in got}) == 3


def test_fragments_end_between_characters(spark):
    got = chunks(spark, "é" * 5, lines=2, overlap=0, most_bytes=3)
    assert [(r.content, r.fragmentStartByte, r.fragmentEndByte) for r in got] == [("é", 2 * k, 2 * k + 2) for k in range(5)]


def test_chunks_cover_all_lines(spark):
    text = "".join(f"line {k} " + "x" * (k * 7 % 90) + "\n" for k in range(200))
    got = chunks(spark, text, lines=9, overlap=3, most_bytes=300)
    seen = {n for r in got for n in range(r.startLine, r.endLine + 1)}
    assert seen == set(range(1, 201)) and len({r.id for r in got}) == len(got)
    assert all(len(r.content.encode()) <= 300 for r in got)
    with pytest.raises(EngineError):
        chunking.checked(2, 2)


def test_syntax_ranges():
    assert chunking.syntax_ranges([(5, 7)], 10, 12) == [(1, 4), (5, 7), (8, 12)]
    code = "import os\n\n@deco\ndef a():\n    return 1\n\nclass B:\n    def c(self):\n        def inner():\n            pass\n"
    assert chunking.python_spans(code) == [(3, 5), (8, 10)]
    assert chunking.brace_spans("use x;\nfn a(b: i32) -> i32 {\n  if b { 1 } else { 2 }\n}\nstruct S { a: i32 }\nimpl S {\n  fn g(&self) {\n  }\n}\n") == [(2, 4), (7, 8)]
    assert chunking.python_spans("def (") == []


def test_filters():
    fields = ["relativePath", "language", "fileExtension"]
    for good in ("relativePath == 'src/lib.rs'", 'language != "rust"', "fileExtension == 'rs'"):
        assert search.parsed_filter(good, fields) is not None
    assert search.parsed_filter("  ", fields) is None
    for bad in ("score > 0.5", "language == ''", "language=='rs'", "x == 'y'", "language == 'a' AND language == 'b'", "language ==\n'a'"):
        with pytest.raises(EngineError) as e:
            search.parsed_filter(bad, fields)
        assert e.value.code == "vector:invalid_filter_expr"


def test_result_order(spark):
    rows = spark.createDataFrame([("a", "b.ts", 1, 2, 0.9), ("b", "a.ts", 1, 2, 0.9), ("c", "a.ts", 5, 10, 0.9), ("d", "a.ts", 1, 2, 0.95)], "id string, relativePath string, startLine int, endLine int, score double")
    assert [r.id for r in search.ordered(rows).collect()] == ["d", "b", "c", "a"]


def test_top_k_ties_filter_and_empty(spark):
    rows = spark.createDataFrame([(k, [1.0, 0.0] if k % 2 else [0.0, 1.0], str(k % 3)) for k in range(20)], "id int, vector array<double>, tag string")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query int, vector array<double>")
    assert [r.id for r in search.top_k(rows, q, 3).orderBy("rank").collect()] == [1, 3, 5]
    assert [r.id for r in search.top_k(rows, q, 2, where=F.col("tag") == "0").orderBy("rank").collect()] == [3, 9]
    assert search.top_k(rows.limit(0), q, 3).count() == 0 and search.top_k(rows, q.limit(0), 3).count() == 0
    with pytest.raises(EngineError):
        search.checked_query([0.0, 0.0], 2)


def test_max_merge_and_rrf(spark):
    a = spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 0.5, 2)], "query int, id int, score double, rank int")
    b = spark.createDataFrame([(0, 2, 0.8, 1)], "query int, id int, score double, rank int")
    assert [(r.id, r.score) for r in hybrid.max_merge([a, b], 5).collect()] == [(1, 0.9), (2, 0.8)]
    assert [r.id for r in hybrid.rrf([a, b], 5).orderBy("rank").collect()] == [2, 1]


def test_lru(spark):
    rows = spark.createDataFrame([(f"k{k}", 10, k * 13 % 50) for k in range(50)], "cache_key string, size_bytes long, last_accessed_ms long")
    kept = {r.last_accessed_ms for r in embcache.kept_by_lru(rows, 105).collect()}
    assert kept == set(range(40, 50))
    assert embcache.kept_by_lru(rows.limit(0), 5).count() == 0


def test_calibration(spark):
    pairs = spark.createDataFrame([(0, k, k, 1.0 - k / 100) for k in range(40)], "query int, id int, hamming int, score double")
    got = calibrate.calibrated(pairs, 64, calibrate.Plan(recall=1.0, precision=0.005, k=10))
    assert got["feasible"] and abs(got["threshold"] - 9 / 64) < 0.01 and got["recall"] == 1.0


def test_ivf_recall(spark):
    import random

    from quillon.operators import ann

    r = random.Random(1)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = spark.createDataFrame([(k, [c + r.gauss(0, 0.2) for c in centres[k % 6]]) for k in range(300)], "id int, vector array<double>")
    q = rows.where("id % 50 = 0").select(F.col("id").alias("query"), "vector")
    truth = search.top_k(rows, q, 10)
    assert search.recall(ann.Cells(rows, 6).top_k(q, 10, 3), truth).agg(F.avg("recall")).first()[0] >= 0.9
    assert search.recall(ann.lsh_top_k(rows, q, 10, 8), truth).agg(F.avg("recall")).first()[0] >= 0.9


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
@pytest.mark.parametrize("name", ["ivf_topk", "lsh_topk"])
def test_registered_recall(spark, name, sf):
    from quillon.plans import registry

    d = f"/root/testdata/{sf}"
    truth = registry.QUERIES["knn_batch_topk"](spark, d)
    got = search.recall(registry.QUERIES[name](spark, d), truth).agg(F.avg("recall"), F.count("*")).first()
    assert got[0] >= 0.9 and got[1] == truth.select("query").distinct().count()
    print(name, sf, got[0])


def test_scores_come_in_tiles(spark):
    """Neither more rows nor more queries make a worker hold more than a tile of scores; ties beyond a tile go to the lesser id."""
    import numpy as np
    import pyarrow as pa

    n, m, k, tile = 2500, 1100, 3, 1024
    x = np.array([[(7 * j) % 13, 1.0] for j in range(n)])
    q = np.array([[1.0, (5 * j) % 11] for j in range(m)])
    rows = spark.createDataFrame([(f"r{(j * 997) % n:04d}", x[j].tolist()) for j in range(n)], "id string, vector array<double>").coalesce(1)

    def scorer(x):
        assert len(x) <= tile

        def part(a, z):
            assert z - a <= tile
            return q[a:z] @ x.T

        return part

    got = search.block_top_k(rows, pa.array(range(m)), "bigint", scorer, 2, k)
    s, ids = q @ x.T, np.array([f"r{(j * 997) % n:04d}" for j in range(n)])
    want = [(j, ids[i]) for j in range(m) for i in np.lexsort((ids, -s[j]))[:k]]
    assert [(r.query, r.id) for r in got.orderBy("query", "rank").collect()] == want


@pytest.mark.parametrize("name", ["sq8_rerank_topk", "ivf_topk", "lsh_topk", "bq1_prefilter_rerank", "knn_threshold"])
def test_searches_score_tiles(spark, tmp_path, monkeypatch, name):
    """Of each registered search, the step that scores is given a tile of rows, and asked for a tile of queries, at a time."""
    import numpy as np

    from quillon.plans import registry

    r = np.random.default_rng(5)
    spark.createDataFrame([(j, r.normal(size=64).tolist(), j % 10) for j in range(1500)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    held = search.block_top_k

    def watched(rows, names, kind, scorer, *more, **how):
        def checked(x):
            assert len(x) <= 1024
            part = scorer(x)

            def few(a, z):
                s = part(a, z)
                assert s.shape == (z - a, len(x)), s.shape
                return s

            return few

        return held(rows, names, kind, checked, *more, **how)

    monkeypatch.setattr(search, "block_top_k", watched)
    assert registry.QUERIES[name](spark, str(tmp_path)).where("rank = 1").count() == 30


def test_bm25_shuffles_no_words(spark, monkeypatch):
    """Scores as by definition, odd texts included; only the best rows of a partition meet in a shuffle, for one block of queries or several."""
    import math
    import re

    texts = ["", None, "!!", "K\u212aelvin \u0130st a b", *(" ".join(f"w{(j * i) % 17}" for i in range(1, j % 23 + 2)) for j in range(60)), *["w1 w2 w2"] * 5]
    asked = [(0, "w1 w2 w1"), (1, "w3 nosuch w16"), (2, "kkelvin i st"), (2, "st W5"), (3, ""), (4, "nosuch")]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    queries = spark.createDataFrame(asked, "query int, text string")

    def words(t):
        return re.findall("[a-z0-9]+", t.lower())

    held = {j: words(t) for j, t in enumerate(texts) if t is not None}
    mean = sum(map(len, held.values())) / len(held)
    scores = {}
    for q, t in asked:
        for w in set(words(t)):
            df = sum(w in x for x in held.values())
            for j, x in held.items():
                if n := x.count(w):
                    scores[q, j] = scores.get((q, j), 0) + math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(x) / mean))
    want = [(q, j, round(scores[q, j], 6)) for q in range(5) for j in sorted((j for p, j in scores if p == q), key=lambda j: (-round(scores[q, j], 6), j))[:4]]
    for terms in (200_000, 3):
        monkeypatch.setattr(hybrid, "QUERY_TERMS", terms, raising=False)
        out = hybrid.bm25_top_k(docs, queries, 4)
        got = [(r.query, r.id, round(r.score, 6)) for r in out.orderBy("query", "rank").collect()]
        assert [x[:2] for x in got] == [x[:2] for x in want] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want))
        assert out._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1


ODD_TEXTS = ["", None, "\n", "\n\n", "a", "a\n", "a\nb", "\na\n\n", "é\r\nü\n", "x\n" * 12]


def test_windows_split_a_text_once(spark):
    """A text is cut into lines, and its lines are counted, once, not once more for each line or window."""

    def plan(c):
        return spark.createDataFrame([("a",)], "t string").select(c.alias("c"))._jdf.queryExecution().analyzed().toString()

    assert plan(chunking.lines_of(F.col("t"))).count("split(") == 1
    assert plan(chunking.windows(F.size(F.split("t", "\n")), 5, 2)).count("split(") == 1
    rows = spark.createDataFrame([(j, t) for j, t in enumerate(ODD_TEXTS)], "j int, t string")
    n = F.size(chunking.lines_of(F.col("t"))).alias("n")
    got = rows.select("j", n, chunking.line_count(F.col("t")).alias("m")).orderBy("j").collect()
    assert [r.m for r in got] == [r.n for r in got] == [1, None, 1, 2, 1, 1, 2, 3, 2, 12]
    long = spark.createDataFrame([("".join(f"{j}\n" for j in range(30_000)),)], "t string")
    assert long.select(F.size(chunking.windows(F.size(chunking.lines_of(F.col("t"))), 5, 2))).first()[0] == 6000


def test_deduped_ranges_need_no_window(spark):
    """The least place of each range stays; doubles are met before the shuffle, so no range is sorted by its place."""
    rows = spark.createDataFrame([(1, 5, 1, 2), (1, 2, 1, 2), (1, 2, 3, 4), (2, 9, 1, 2), (1, 7, 1, 2)], "doc long, pos long, s long, e long")
    out = chunking.deduped(rows)
    assert sorted(map(tuple, out.collect())) == [(1, 2, 1, 2), (1, 2, 3, 4), (2, 9, 1, 2)]
    assert "Window" not in out._jdf.queryExecution().toString()


def test_calibration_writes_no_pairs(spark):
    """The spread that is taken from vectors, without pairs, is that of all pairs."""
    import numpy as np

    from quillon.operators import quantize

    r = np.random.default_rng(3)
    rows = spark.createDataFrame([(j, r.normal(size=70).tolist()) for j in range(300)] + [(300, [0.0] * 70), (301, [1.0])], "id long, vector array<double>")
    q = rows.where("id % 50 = 0 AND id < 300").select(F.col("id").alias("query"), "vector")
    truth, bins = quantize.bq1_spread(rows, q, 5)
    pairs_truth, pairs_bins = calibrate.spread(quantize.bq1_distances(rows, q), 5)
    assert sorted(map(tuple, truth.collect())) == sorted(map(tuple, pairs_truth.collect()))
    assert sorted(map(tuple, bins.collect())) == sorted(map(tuple, pairs_bins.collect()))
    plan = calibrate.Plan(recall=0.9, k=5)
    assert calibrate.calibrated_on(truth, bins, 70, plan) == calibrate.calibrated(quantize.bq1_distances(rows, q), 70, plan)

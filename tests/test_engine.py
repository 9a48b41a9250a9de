import json

import pytest
from pyspark.sql import functions as F

from quillon.engine import Engine
from quillon.errors import EngineError
from quillon.operators.collection import Store
from quillon.sources import config, records
from quillon.streaming import ema, wal


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "code"
    (root / "src").mkdir(parents=True)
    (root / "target").mkdir()
    (root / "src/main.rs").write_text("fn main() {}\n")
    (root / "src/lib.rs").write_text("pub fn lib() {}\n")
    (root / "target/x.rs").write_text("no\n")
    (root / "src/raw.rs").write_bytes(b"\xff\xfe")
    (root / ".contextignore").write_text("# none\ntarget/\n")
    return root


def test_index_search_reindex_clear(spark, tmp_path, tree):
    e = Engine(spark, str(tmp_path / "store"))
    assert e.search("code", "x").count() == 0 and e.status("code")["state"] == "missing"
    e.index("code", str(tree))
    assert e.status("code")["files"] == 2
    best = e.search("code", "fn main() {}\n", 2).collect()
    assert best[0].relativePath == "src/main.rs" and best[0].score == 1.0
    assert {r.relativePath for r in e.search("code", "q", where="relativePath != 'src/lib.rs'").collect()} == {"src/main.rs"}
    assert e.reindex("code", str(tree)) == {"added": 0, "removed": 0, "modified": 0}
    (tree / "src/main.rs").unlink()
    (tree / "src/lib.rs").write_text("pub fn lib() { 1 }\n")
    (tree / "src/new.rs").write_text("fn new() {}\n")
    assert e.reindex("code", str(tree)) == {"added": 1, "removed": 1, "modified": 1}
    assert {r.relativePath for r in e.store.read("code").collect()} == {"src/lib.rs", "src/new.rs"}
    for how in ({"strategy": "sq8"}, {"strategy": "ivf"}, {"mode": "hybrid"}):
        assert e.search("code", "fn new() {}\n", 1, **how).first().relativePath == "src/new.rs"
    assert e.estimate(str(tree))["estimated_chunks"] >= 1
    e.clear("code")
    assert not e.store.has("code")


def test_store_rules(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    with pytest.raises(EngineError):
        s.create("1bad", 2)
    s.create("a", 2)
    s.create("b", 2, "hybrid")
    assert s.names() == ["a", "b"]
    row = "id string, vector array<float>, content string, relativePath string, origin long"
    with pytest.raises(EngineError) as e:
        s.publish("a", spark.createDataFrame([("x", [1.0, 0.0], "", "p", 0), ("x", [1.0, 0.0], "", "p", 1)], row))
    assert e.value.code == "collection:duplicate_ids" and s.active("a") is None
    with pytest.raises(EngineError):
        s.publish("a", spark.createDataFrame([("x", [0.0, 0.0], "", "p", 0)], row))
    new = row.replace(", origin long", "")
    s.upsert("a", spark.createDataFrame([("x", [1.0, 0.0], "1", "p"), ("y", [1.0, 0.0], "1", "q")], new))
    s.upsert("a", spark.createDataFrame([("x", [0.0, 1.0], "2", "p")], new))
    assert {(r.id, r.content) for r in s.read("a").collect()} == {("x", "2"), ("y", "1")}
    s.delete("a", spark.createDataFrame([("y",), ("z",)], "id string"))
    assert [r.id for r in s.read("a").collect()] == ["x"]
    s.delete_paths("a", spark.createDataFrame([("p",)], "relativePath string"))
    assert s.read("a").count() == 0


def _log(path, *sequences, start=0):
    path.mkdir(exist_ok=True)
    lines = [json.dumps({"sequence": k, "documents": [{"id": f"d{k % 3}", "vector": [1.0, float(k)], "content": str(k), "metadata": {"relativePath": "p", "span": {"startLine": 1, "endLine": 1}}}]}) for k in sequences]
    (path / f"log-{start}.jsonl").write_text("\r\n\n".join(lines) + "\n")


def test_wal(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.create("w", 2)
    _log(tmp_path / "log", 1, 2, 3, 4)
    log = records.insert_log(spark, str(tmp_path / "log"))
    assert wal.replay(s, "w", log, 0) == 4
    assert {(r.id, r.content) for r in s.read("w").collect()} == {("d1", "4"), ("d2", "2"), ("d0", "3")}
    assert wal.replay(s, "w", log, 4) == 4
    _log(tmp_path / "log", 7, start=5)
    with pytest.raises(EngineError) as e:
        wal.replay(s, "w", records.insert_log(spark, str(tmp_path / "log")), 4)
    assert e.value.code == "vector:wal_replay_sequence_gap"
    assert wal.checkpoint_due(10, 2) and not wal.checkpoint_due(10, 1) and wal.checkpoint_due(10, 0, True)


def test_stream_ingest(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.create("w", 2)
    _log(tmp_path / "log", 1, 2, 3, 4)
    for _ in range(2):  # the second run finds nothing new
        wal.ingest(spark, str(tmp_path / "log"), s, "w", str(tmp_path / "ck")).awaitTermination()
    assert {(r.id, r.content) for r in s.read("w").collect()} == {("d1", "4"), ("d2", "2"), ("d0", "3")}


def test_stream_ema(spark, tmp_path):
    rows = [(k % 2, k, float(k * 7 % 5)) for k in range(30)]
    for part in (rows[:10], rows[10:]):
        spark.createDataFrame(part, "key int, n int, x double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("key int, n int, x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    last = {}

    def keep(batch, k):
        for r in batch.collect():
            last[r.key] = (r.samples, r.ema)

    ema.smoothed(src, "key", "x", "n").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    for key in (0, 1):
        want = None
        for k, _, x in rows:
            if k == key:
                want = x if want is None else 0.1 * x + 0.9 * want
        assert last[key][0] == 15 and abs(last[key][1] - want) < 1e-9


def test_records(spark, tmp_path):
    (tmp_path / "side.jsonl").write_text('{"version":1,"dimension":2,"indexMode":"dense","count":1}\n{"id":"a","content":"x","metadata":{"relativePath":"p"}}\n')
    assert records.sidecar(spark, str(tmp_path / "side.jsonl")).first().relativePath == "p"
    (tmp_path / "side.jsonl").write_text('{"version":1,"dimension":2,"indexMode":"dense","count":2}\n{"id":"a","content":"x"}\n{"id":"a","content":"y"}\n')
    with pytest.raises(EngineError):
        records.sidecar(spark, str(tmp_path / "side.jsonl"))
    (tmp_path / "snap.json").write_text(json.dumps({"version": 1, "dimension": 1, "records": [{"id": "a", "vector": [1.0], "content": "c", "metadata": {"relativePath": "p"}}]}))
    assert records.snapshot(spark, str(tmp_path / "snap.json")).first().id == "a"
    (tmp_path / "q.ndjson").write_text('{"query":"a"}\n{"query":"b","topK":3,"threshold":0.5}\n')
    assert [(r.query, r.topK, r.threshold) for r in records.batch_queries(spark, str(tmp_path / "q.ndjson")).orderBy("query").collect()] == [("a", 5, 0.0), ("b", 3, 0.5)]


def test_config(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text("[splitter]\nlines = 50\n")
    got = config.load(str(p), '{"search": {"topK": 7}}', {"QUILLON_SEARCH__THRESHOLD": "0.25", "HOME": "x"})
    assert got["splitter"]["lines"] == 50 and got["search"] == {"topK": 7, "threshold": 0.25}
    with pytest.raises(EngineError):
        config.load(overrides='{"nosuch": 1}', env={})
    assert config.search_request("q")["topK"] == 5
    for bad in ({"query": " "}, {"query": "q", "top_k": 51}, {"query": "q", "threshold": 2}, {"query": "q", "root": "https://x"}, {"query": "a\0"}, {"query": "q", "x": 1}):
        with pytest.raises(EngineError):
            config.search_request(**bad)
    assert F is not None


def test_scan_hidden_files_and_repeated_names(spark, tmp_path):
    """A path that holds the root's own path again, hidden files, quotes, and the cut by level."""
    from quillon.sources import files

    root = tmp_path / "d'1"
    inner = root / str(tmp_path).lstrip("/") / "d'1"
    inner.mkdir(parents=True)
    (inner / "x.rs").write_text("inner")
    (root / "x.rs").write_text("outer")
    (root / ".github").mkdir()
    (root / ".github/ci.yml").write_text("ci")
    (root / "_private.py").write_text("p")
    (root / ".context").mkdir()
    (root / ".context/state").write_text("no")
    got = {r.path: r.content for r in files.scan(spark, str(root)).collect()}
    deep = str(inner / "x.rs")[len(str(root)) + 1 :]
    assert got == {"x.rs": "outer", deep: "inner", ".github/ci.yml": "ci", "_private.py": "p"}
    assert [r.path for r in files.scan(spark, str(root), max_files=2).collect()] == ["_private.py", "x.rs"]
    assert [r.path for r in files.scan(spark, str(root), extensions=["yml"]).collect()] == [".github/ci.yml"]
    assert files.scan(spark, str(root), max_bytes=1).count() == 1


def _log_rows(spark, *ids):
    doc = f"struct<d:{records.DOCUMENT}>"
    meta = ("p", None, None, None, None, None, None)
    return spark.createDataFrame([((i, [1.0, v], "c", meta),) for i, v in ids], doc).select("d.*")


def test_ingest_refuses_gaps_and_old_records(spark, tmp_path):
    s, log = Store(spark, str(tmp_path / "s")), str(tmp_path / "log")
    s.create("a", 2)
    assert wal.append(spark, log, _log_rows(spark, ("x", 1.0)), 1) == 2
    wal.append(spark, log, _log_rows(spark, ("x", 2.0), ("y", 1.0)), 2)
    wal.ingest(spark, log, s, "a", str(tmp_path / "c")).awaitTermination()
    assert s.sequence("a") == 2 and {r.id: r.vector[1] for r in s.read("a").collect()} == {"x": 2.0, "y": 1.0}
    wal.ingest(spark, log, s, "a", str(tmp_path / "c2")).awaitTermination()  # all records again
    assert s.sequence("a") == 2 and s.active("a") == 1
    wal.append(spark, log, _log_rows(spark, ("x", 9.0)), 9)
    wal.append(spark, log, _log_rows(spark, ("x", 5.0)), 5)
    with pytest.raises(Exception, match="wal_replay_sequence_gap"):
        wal.ingest(spark, log, s, "a", str(tmp_path / "c3")).awaitTermination()
    assert {r.id: r.vector[1] for r in s.read("a").collect()} == {"x": 2.0, "y": 1.0}


def test_second_publisher_fails_and_old_generations_go(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "s"))
    s.create("a", 2)
    row = lambda v: spark.createDataFrame([("x", [1.0, v])], "id string, vector array<double>")
    for k in range(5):
        s.publish("a", row(float(k)))
    assert s.active("a") == 5 and s.read("a").first().vector[1] == 4.0
    assert len(s._children("a", "generations")) == 3
    other = Store(spark, s.root)
    monkeypatch.setattr(other, "_folder", lambda name: (4, "seen before"))
    with pytest.raises(EngineError) as e:
        other.publish("a", row(8.0))
    assert e.value.code == "collection:publish_conflict" and s.read("a").first().vector[1] == 4.0


def test_engine_strategies_cache_and_queries(spark, tmp_path, tree):
    embedded = []

    def embed(rows):
        from quillon.engine import hash_embedder

        embedded.append(1)
        return hash_embedder(16)(rows)

    for strategy in ("ivf", "sq8", "bq1"):
        settings = config.load(overrides=json.dumps({"vectorDb": {"strategy": strategy}, "embedding": {"dimension": 16}}), env={})
        e = Engine(spark, str(tmp_path / strategy), settings, embed, cache=str(tmp_path / "cache"))
        e.index("code", str(tree))
        assert e.store.place("code", strategy) and e.stats["status"] == "completed" and e.stats["chunks"] == 2
        assert e.search("code", "fn main() {}\n", 1).first().relativePath == "src/main.rs"
        assert e.search("code", "fn main() {}\n", 1, where="relativePath == 'src/lib.rs'").first().relativePath == "src/lib.rs"
    held = spark.read.parquet(str(tmp_path / "cache"))
    assert held.count() == held.select("cache_key").distinct().count() == 2
    v = [float(x) for x in e.store.read("code").where("relativePath = 'src/lib.rs'").first().vector]
    assert e.search("code", vector=v, top_k=1).first().relativePath == "src/lib.rs"
    for bad in ([0.0] * 16, [1.0] * 3, [float("nan")] * 16):
        with pytest.raises(EngineError):
            e.search("code", vector=bad)
    ids = [r.id for r in e.store.read("code").collect()]
    assert e.search("code", "q", where=f"id in {json.dumps(ids[:1])}").count() == 1
    e.index("code", str(tree), chunk_limit=1)
    assert e.stats["status"] == "limitReached"


def test_reordered(spark):
    rows = lambda *k: spark.createDataFrame([(i, "v") for i in k], "index int, v string")
    assert [r[0] for r in records.reordered(rows(2, 0, 1), 3).collect()] == [0, 1, 2]
    for bad in ((0, 0, 1), (0, 1), (0, 1, 3), (0, 1, None)):
        with pytest.raises(EngineError):
            records.reordered(rows(*bad), 3)

"""The stages on small tables: what they keep, and what they return."""

import hashlib

import corpus_pipeline


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark):
    clean = [" ".join(f"w{(k * 31 + j * j) % 997}" + (" the of" if j % 9 == 0 else "") for j in range(120)) for k in range(8)]
    near = clean[0].replace("w0 ", "changed ", 1)
    docs = frame(spark, [*clean, clean[1].upper(), near, None, "", "short text", "### $$$ " * 60])
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_copies", "near_copies", "mix", "tokens"]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != "tokens":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept.append({r.doc_id for r in docs.collect()})
    assert kept[0] == set(range(10))  # junk, short and empty texts go; clean ones stay
    assert kept[1] == set(range(10)) - {1}  # the largest id of equal texts stays
    assert kept[2] == kept[1] - {9}  # of near copies, the least id
    assert kept[3] <= kept[2]
    for r in docs.collect():
        assert r.n_tokens == len(r.ids) // 4 and r.decoded_sha256 == hashlib.sha256((clean[1].upper() if r.doc_id == 8 else clean[r.doc_id]).encode()).hexdigest()


def test_empty_table(spark):
    docs = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0

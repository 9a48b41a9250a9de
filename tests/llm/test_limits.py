"""What operators move between tasks and keep in memory."""

import random

import pytest

from quillon.llm import ngram_join
from quillon.llm.common import stored, texts_to_python


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_links_move_only_the_sets_in_pairs(spark, no_broadcast, tmp_path):
    r = random.Random(4)
    rows = [(r.randbytes(16), 500, 500, r.randbytes(32), b"".join(sorted(r.randbytes(10) for _ in range(500)))) for _ in range(2000)]
    rows[1] = (rows[1][0], *rows[0][1:])
    sets = stored(spark.createDataFrame(rows, "digest binary, n long, shared long, sketch binary, items binary"), str(tmp_path / "sets"))
    pairs = stored(spark.createDataFrame([(rows[0][0], rows[1][0])], "pivot binary, member binary"), str(tmp_path / "pairs"))
    before = shuffled(spark)
    links = ngram_join.linked(pairs, sets).collect()
    assert [(bytes(x.a), bytes(x.b)) for x in links] == [(rows[0][0], rows[1][0])]
    assert shuffled(spark) - before < 1_000_000  # all sets: 10 MB


def test_key_filter_keeps_all_keys(spark):
    from quillon.llm.common import key_filter, maybe_among

    rows = spark.range(20_000).selectExpr("unhex(md5(cast(id as string))) k", "id")
    keys = key_filter(rows.where("id % 40 = 0").select("k"))
    got = {x.id for x in maybe_among(rows, "k", keys).collect()}
    assert set(range(0, 20_000, 40)) <= got and len(got) < 520
    none = key_filter(rows.where("id < 0").select("k"))
    assert maybe_among(rows, "k", none).count() == 0


def test_batches_of_texts_are_small(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.unset(name)
    try:
        texts_to_python(spark)

        def run(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

        texts = spark.range(0, 4000, 1, 1).selectExpr("repeat(cast(id % 10 as string), 4000) text")
        sizes = [x.n for x in texts.mapInArrow(run, "n long").collect()]
        assert sum(sizes) > 16_000_000 and max(sizes) < 3_000_000
    finally:
        spark.conf.set(name, before)

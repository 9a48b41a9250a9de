"""Insert log: sequence checks, replay into a collection, compaction, streamed ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.errors import EngineError
from quillon.operators.collection import Store, last_writes
from quillon.sources.records import LOG, _flat


def out_of_order(log: DataFrame, part: str = "part", place: str = "place", sequence: str = "sequence") -> DataFrame:
    """Rows whose sequence isn't above that of the row before them in their part of the log."""
    w = Window.partitionBy(part).orderBy(place)
    return log.withColumn("before", F.lag(sequence).over(w)).where(F.col("before") >= F.col(sequence))


def gaps(sequences: DataFrame, after: int) -> DataFrame:
    """(start, end) of stretches without a gap beyond a checkpoint; a whole log has one, begun at after + 1.

    Sequences are numbered by (range, place in it), so that no task sorts all of them.
    """
    s = sequences.where(F.col("sequence") > after).select("sequence").distinct()
    bounds = s.agg(F.min("sequence").alias("start"), F.max("sequence").alias("end"), F.count(F.lit(1)).alias("n"))
    return bounds.where("n > 0")


def compacted(log: DataFrame, checkpoint: int) -> DataFrame:
    return log.where(F.col("sequence") > checkpoint)


def checkpoint_due(count: int, new: int, forced: bool = False) -> bool:
    """Whether a fifth of the collection is new."""
    return forced or new >= max(count // 5, 1)


def replay(store: Store, name: str, log: DataFrame, checkpoint: int) -> int:
    """Upsert a log's documents (sequence, pos, id, ...) beyond the checkpoint; returns the last sequence.

    A missing sequence is an error: what follows it must not be applied.
    """
    b = gaps(log, checkpoint).first()
    if b is None:
        return checkpoint
    if b["start"] != checkpoint + 1 or b["end"] - b["start"] + 1 != b["n"]:
        raise EngineError("vector:wal_replay_sequence_gap", f"after {checkpoint}: {b['start']}..{b['end']}, {b['n']} records", "invariant")
    store.upsert(name, last_writes(compacted(log, checkpoint)).drop("sequence", "pos"), b["end"])
    return b["end"]


def ingest(spark: SparkSession, log_dir: str, store: Store, name: str, checkpoint_dir: str, files_per_batch: int = 64):
    """Stream an insert log into a collection: one generation for each micro-batch. Returns the query.

    Each micro-batch is replayed from the sequence that the collection's active generation
    holds: records up to it are passed over, so a batch that is run again after a failure
    changes nothing, and a missing sequence stops the stream with an error.
    """
    lines = spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).json(log_dir)
    rows = _flat(lines.select("sequence", F.posexplode("documents").alias("pos", "d")))

    def apply(batch: DataFrame, epoch: int) -> None:
        replay(store, name, batch, store.sequence(name) or 0)

    return rows.writeStream.option("checkpointLocation", checkpoint_dir).foreachBatch(apply).trigger(availableNow=True).start()


def append(spark: SparkSession, log_dir: str, documents: DataFrame, sequence: int) -> int:
    """Write documents (DOCUMENT's fields) as the log's record `sequence`, one JSON line in a file of its own; returns the next sequence.

    The name holds the sequence, so that files are read in order; a record that is there is refused.
    """
    path = f"{log_dir.rstrip('/')}/{sequence:020d}.json"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p.getParent())
    line = documents.select(F.struct("id", "vector", "content", "metadata").alias("d")).agg(F.to_json(F.struct(F.lit(sequence).alias("sequence"), F.collect_list("d").alias("documents"))).alias("v"))  # one batch of an insert
    out = fs.create(p, False)
    try:
        out.write(bytearray((line.first()["v"] + "\n").encode()))
    finally:
        out.close()
    return sequence + 1

"""Exact deduplication as a stateful stream.

Each row's text is lower-cased (A-Z only) and digested once, by built-in functions; a
narrow feed of (id, locator, digest, length) lies in a shared folder and is read as a
stream. The stream's state, in RocksDB on the executors' disks and without expiry,
retains for each digest and length the stable identifier that stays (the largest id),
the locator of its row and the number of rows seen. Rows of one key are combined on
the map side, so a group of any size reaches its state as one row a task. On hits,
that is for every key seen more than once, the full bytes of all its texts are
compared; texts that share a key but differ in some byte are told apart by their bytes.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, stored, unused, with_group

#: The most digests with hits that are broadcast to the scan of the texts; beyond, a shuffled join.
BROADCAST_HITS = 200_000
#: Files of the feed that a micro-batch takes.
FILES_PER_BATCH = 4096
#: Rows of the feed for each state store, at least one store for each core: stores are never merged at run time.
ROWS_PER_STORE = 250_000

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # no 4 MB set aside on disk by each of many small stores
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}

#: For a shared folder mounted as `file:`. There the default manager, which looks for links, starts a process (readlink)
#: beside the executor for each file it renames; this one renames by a system call, which replaces at once all the same.
MOUNTED = {"spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def fed(docs: DataFrame, id_col: str, text_col: str, path: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The feed: (doc_id, digest, n_bytes, locator), written once, so that locators stay."""
    text = normal(docs[f"`{text_col}`"])
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), digest(text).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    return stored(rows.withColumn("locator", F.monotonically_increasing_id()), path)


def retained(spark: SparkSession, feed: str, schema: T.StructType, to: str) -> DataFrame:
    """Run the stream over all of the feed: (digest, n_bytes, top, size), a row for each key of the state.

    top: struct of the largest doc_id (null the least) and its locator. Started again
    with the same folders, the stream goes on where it stopped.
    """
    stores = max(spark.sparkContext.defaultParallelism, -(-spark.read.schema(schema).parquet(feed).count() // ROWS_PER_STORE))
    wanted = {**ROCKSDB, **(MOUNTED if _scheme(spark, to) == "file" else {}), "spark.sql.shuffle.partitions": str(stores)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        if before[k] is None or k.endswith(("providerClass", "partitions")):  # else as the session has it
            spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(feed)
        state = rows.groupBy("digest", "n_bytes").agg(F.max(F.struct("doc_id", "locator")).alias("top"), F.count(F.lit(1)).alias("size"))

        def keep(changed: DataFrame, epoch: int) -> None:
            changed.write.mode("overwrite").parquet(f"{to}/changed/epoch={epoch}")

        run = state.writeStream.outputMode("update").option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
        run.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    top = T.StructType([T.StructField("doc_id", schema["doc_id"].dataType), T.StructField("locator", T.LongType())])
    kept = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("top", top), T.StructField("size", T.LongType()), T.StructField("epoch", T.IntegerType())])
    if not _exists(spark, f"{to}/changed"):
        return spark.createDataFrame([], kept).drop("epoch")
    changed = spark.read.schema(kept).parquet(f"{to}/changed")
    if changed.agg(F.max("epoch")).first()[0] in (0, None):
        return changed.drop("epoch")
    # a key's rows only grow: the greatest are the last
    return stored(changed.groupBy("digest", "n_bytes").agg(F.max("top").alias("top"), F.max("size").alias("size")), f"{to}/state")


def _scheme(spark: SparkSession, path: str) -> str:
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _sided(table: DataFrame) -> DataFrame:
    """A table with a row for each group, broadcast if there are few of them (they are counted)."""
    return F.broadcast(table) if table.count() <= BROADCAST_HITS else table


def clashes(docs: DataFrame, text_col: str, state: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(digest, n_bytes) of keys whose texts differ in some byte. All bytes of all hits are compared."""
    hits = state.where("size > 1").select(F.col("digest").alias("d"), F.col("n_bytes").alias("n"))
    text = normal(docs[f"`{text_col}`"])
    texts = docs.select(text.alias("text"), digest(text).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    texts = texts.join(_sided(hits), (F.col("digest") == F.col("d")) & (F.col("n_bytes") == F.col("n")), "left_semi")
    return texts.groupBy("digest", "n_bytes").agg(F.min("text").alias("a"), F.max("text").alias("z")).where("a <> z").select("digest", "n_bytes")


def _parted(docs: DataFrame, id_col: str, text_col: str, clash: DataFrame, top: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Rows whose key clashes, told apart by bytes: (doc_id, digest, n_bytes, locator, text, top, size)."""
    text = normal(docs[f"`{text_col}`"])
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), digest(text).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    on = (F.col("digest") == F.col("d")) & (F.col("n_bytes") == F.col("n"))
    rows = rows.join(clash.select(F.col("digest").alias("d"), F.col("n_bytes").alias("n")), on, "left_semi")
    rows = stored(rows.withColumn("locator", F.monotonically_increasing_id()), f"{top}/clashing")
    each = rows.groupBy(F.col("text").alias("t")).agg(F.max(F.struct("doc_id", "locator")).alias("top"), F.count(F.lit(1)).alias("size"))
    return rows.join(each, F.col("text") == F.col("t")).drop("t")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest), one row for each row of docs.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of
    equal texts, the row with the largest id stays (null ids count as the least); of
    rows that share that id too, one. Texts that share a digest but no bytes are groups
    of their own. An empty table gives no rows; texts of any length are whole.
    """
    spark, top = docs.sparkSession, shared_dir(docs.sparkSession)
    feed = fed(docs, id_col, text_col, f"{top}/feed", digest)
    state = retained(spark, f"{top}/feed", feed.schema, top)
    clash = stored(clashes(docs, text_col, state, digest), f"{top}/clashes")
    of_key = (F.col("digest") == F.col("d")) & (F.col("n_bytes") == F.col("n"))
    rows = with_group(feed, state.select(F.col("digest").alias("d"), F.col("n_bytes").alias("n"), "top", "size"), of_key, "size", feed.count())
    if clash.head(1):
        rows = rows.drop("d", "n").join(clash.select(F.col("digest").alias("d"), F.col("n_bytes").alias("n")), of_key, "left_anti")
        rows = rows.unionByName(_parted(docs, id_col, text_col, clash, top, digest).drop("text"))
    return rows.select("doc_id", F.col("top")["doc_id"].alias("keep_id"), F.col("size").alias("group_size"), (F.col("locator") == F.col("top")["locator"]).alias("kept"), "digest")


def unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows that stay, with the columns they had; nulls, ties and clashes as in grouped.

    Rows whose text occurs once stay without a join; the others' keys (a row for each
    group) are broadcast if they are few, so that texts are not shuffled.
    """
    spark, top = docs.sparkSession, shared_dir(docs.sparkSession)
    feed = fed(docs, id_col, text_col, f"{top}/feed", digest)
    state = retained(spark, f"{top}/feed", feed.schema, top)
    clash = stored(clashes(docs, text_col, state, digest), f"{top}/clashes")
    d, n, keep, tied = (unused(x, docs.columns) for x in ("_digest", "_n_bytes", "_keep_id", "_tied"))
    hits = state.where("size > 1").select(F.col("digest").alias(d), F.col("n_bytes").alias(n), F.col("top"))
    of_key = (F.col("digest") == F.col(d)) & (F.col("n_bytes") == F.col(n))
    # rows that repeat both id and text of the one that stays: any of them stands for all
    again = feed.join(hits, of_key).where(F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("locator") != F.col("top.locator"))).select(F.col(d).alias("d"), F.col(n).alias("n")).distinct()
    hits = hits.join(again, (F.col(d) == F.col("d")) & (F.col(n) == F.col("n")), "left").select(d, n, F.col("top.doc_id").alias(keep), F.col("d").isNotNull().alias(tied))
    if clash.head(1):
        hits = hits.join(clash, (F.col(d) == F.col("digest")) & (F.col(n) == F.col("n_bytes")), "left_anti")
    hits = stored(hits, f"{top}/hits")
    text = normal(docs[f"`{text_col}`"])

    def has_key(k: str, m: str) -> Column:
        return (digest(text) == F.col(k)) & (F.octet_length(text).cast("long") == F.col(m))

    rest, parts = docs, []
    if clash.head(1):
        bad = clash.toDF(k := unused("_clash_digest", docs.columns), m := unused("_clash_bytes", docs.columns))
        rest = docs.join(bad, has_key(k, m), "left_anti")
        tops = _parted(docs, id_col, text_col, clash, top, digest).where(F.col("locator") == F.col("top")["locator"]).select(F.col("text").alias(d), F.col("doc_id").alias(keep))
        kept = docs.join(bad, has_key(k, m), "left_semi").join(tops, (text == F.col(d)) & docs[f"`{id_col}`"].eqNullSafe(F.col(keep)))
        parts.append(kept.dropDuplicates([d]))
    rows = rest.join(_sided(hits), has_key(d, n), "left").where(F.col(d).isNull() | docs[f"`{id_col}`"].eqNullSafe(F.col(keep)))
    parts.append(rows.where(~F.coalesce(F.col(tied), F.lit(False))))
    if hits.where(tied).head(1):
        parts.append(rows.where(tied).dropDuplicates([d, n]))
    out = [x.select(*[f"`{c}`" for c in docs.columns]) for x in parts]
    return functools.reduce(DataFrame.unionByName, out)

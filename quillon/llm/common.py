"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The same class for SQL engines whose patterns take no Python escapes.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders taken inside scratch(), by nesting.
_taken: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see.

    It lies in ``spark.checkpoint.dir``; only where that is unset, on a local master, in
    a temporary folder of this machine. It stays as long as results may depend on it:
    whoever stores them takes them inside scratch().
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them see")
        top = os.path.join(tempfile.gettempdir(), "quillon-shared")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(top)
    path = f"{top.rstrip('/')}/quillon-{uuid.uuid4().hex}"
    if _taken:
        _taken[-1].append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that operators take inside are deleted at the end: what they return must be stored elsewhere by then."""
    _taken.append([])
    try:
        yield
    finally:
        for path in _taken.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Spark drops an execution's shuffle files at its end, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write a frame to a shared folder and read it again, which cuts its lineage; its shuffle files go."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Most bytes of a batch of whole texts that is sent to Python. The executor's buffers for it are up to twice as large.
TEXT_BATCH = 2 << 20


def texts_to_python(spark: SparkSession) -> None:
    """Let the session send whole texts to Python in batches of TEXT_BATCH at most.

    The setting is read when a plan runs, so it stays set; a smaller one is kept. What a
    batch holds lies in memory at least twice, in the executor and in its worker.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(name).rstrip("bB"))
    if now < 0 or now > TEXT_BATCH:
        spark.conf.set(name, f"{TEXT_BATCH}b")


#: A group is hot if it holds more than this part of all rows: there are fewer such groups than this.
HOT_GROUPS = 4096


def with_group(rows: DataFrame, groups: DataFrame, on: Column, size: str, total: int) -> DataFrame:
    """rows joined with groups, a row for each key with the number of its rows in `size`; inner.

    total: the number of rows, or more. Hot groups are broadcast, the others shuffled:
    no task gets more than total / HOT_GROUPS rows of one key, however large its group.
    """
    least = total // HOT_GROUPS
    hot, rest = F.broadcast(groups.where(F.col(size) > least)), groups.where(F.col(size) <= least)
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(rest, on))


#: Bits of a key filter: 4 MB to broadcast at most, however many keys.
FILTER_BITS = 1 << 25


def _filter_bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1


def key_filter(keys: DataFrame) -> DataFrame:
    """(bucket, bits): a bitmap of the hashes of a column of keys."""
    bit = _filter_bit(F.col(keys.columns[0]))
    bits = keys.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("at")).distinct()
    return bits.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def maybe_among(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """All rows whose key is in a key filter, and a few whose hash only is; rows are not shuffled."""
    bit = _filter_bit(F.col(key))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    found = rows.join(F.broadcast(keys), F.bitmap_bucket_number(bit) == F.col("bucket"))
    return found.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def unused(name: str, taken: list[str]) -> str:
    """A column name that no column of the input has, whatever its case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name

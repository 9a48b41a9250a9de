"""File trees as tables."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import paths

IGNORE_FILE = ".contextignore"


def ignore_patterns(spark: SparkSession, root: str, configured: Sequence[str] = ()) -> list[str]:
    """Configured patterns, the ignore file itself and its lines that are no comments; sorted, each once."""
    listed = set(configured) | {IGNORE_FILE}
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{IGNORE_FILE}")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p):  # Spark's readers pass over hidden files
        opened = fs.open(p)
        try:
            text = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(opened)).decode()
        finally:
            opened.close()
        listed |= {x for line in text.splitlines() if (x := line.strip()) and not x.startswith("#")}
    return sorted(x.strip() for x in listed if x.strip())


ENTRY = "path string, rel string, folder boolean, size bigint, modified timestamp"


def _listed(folders: DataFrame) -> DataFrame:
    """(path, rel, folder, size, modified) of what lies in folders (path, rel), hidden entries included, links followed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, rel in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, at = pafs.FileSystem.from_uri(path)
                found = [x for x in fs.get_file_info(pafs.FileSelector(at)) if x.type in (pafs.FileType.File, pafs.FileType.Directory)]
                scheme = path[: len(path) - len(at)] if path.endswith(at) else "file://"
                columns = ([scheme + x.path for x in found], [f"{rel}/{x.base_name}".lstrip("/") for x in found], [x.type == pafs.FileType.Directory for x in found], [x.size or 0 for x in found], [x.mtime for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC")))], ["path", "rel", "folder", "size", "modified"])

    return folders.select("path", "rel").mapInArrow(run, ENTRY)


def entries(spark: SparkSession, root: str, ignore: Sequence[str] = (), extensions: Sequence[str] = (), max_files: int | None = None) -> DataFrame:
    """(path, rel, size, modified) of a tree's files, a level of folders after the other, each level listed in parallel.

    Ignored folders are not entered. With max_files no level is listed beyond the one that
    reaches it; files come by level, then by folder and name.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri()
    uri = f"file://{full.getPath()}" if full.getScheme() == "file" else full.toString()
    level, found, seen = spark.createDataFrame([(uri.rstrip("/") or "file:///", "")], "path string, rel string"), [], 0
    while True:
        here = _listed(level.repartition(max(1, min(level.count(), 4096)), "path")).where(~paths.ignored(F.col("rel"), ignore) & ~paths.reserved(F.col("rel"))).persist()
        files = here.where(~F.col("folder") & paths.allowed_extension(F.col("rel"), extensions)).drop("folder")
        found.append(files)
        seen += files.count()
        level = here.where("folder").select("path", "rel")
        if not level.head(1) or max_files is not None and seen >= max_files:
            out = functools.reduce(DataFrame.unionAll, found)
            return out if max_files is None else out.orderBy(F.size(F.split("rel", "/")), F.split("rel", "/")).limit(max_files)


def scan(spark: SparkSession, root: str, ignore: Sequence[str] = (), extensions: Sequence[str] = (), max_bytes: int | None = None, max_files: int | None = None) -> DataFrame:
    """(path, size, modified, content) of a tree, in path order; hidden files are files like others.

    Paths are relative to the root. Ignored folders, other extensions and files beyond
    max_bytes are left out before contents are read; so are files that aren't UTF-8.
    max_files takes the first by level, then by folder and name.
    """
    rows = entries(spark, root, ignore, extensions, max_files)
    if max_bytes is not None:
        rows = rows.where(F.col("size") <= max_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, path in enumerate(b.column(0).to_pylist()):  # one file at a time is held
                fs, at = pafs.FileSystem.from_uri(path)
                try:
                    with fs.open_input_stream(at) as f:
                        content = f.read().decode("utf-8")
                except (UnicodeDecodeError, FileNotFoundError):  # no text, or gone since it was listed
                    continue
                one = b.slice(k, 1)
                yield pa.RecordBatch.from_arrays([one.column(1), one.column(2), one.column(3), pa.array([content], pa.string())], ["path", "size", "modified", "content"])

    rows = rows.select("path", paths.normalized(F.col("rel")).alias("rel"), "size", "modified")
    spread = rows.repartition(max(1, spark.sparkContext.defaultParallelism), "rel")
    return spread.mapInArrow(run, "path string, size bigint, modified timestamp, content string").orderBy("path")


def restricted(files: DataFrame, listed: Sequence[str]) -> DataFrame:
    """Files of an explicit list, normalised like paths."""
    spark = files.sparkSession
    want = spark.createDataFrame([(p,) for p in listed], "p string").select(paths.normalized(F.col("p")).alias("path")).distinct()
    return files.join(want, "path", "left_semi")

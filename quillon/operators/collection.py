"""Collections: versioned rows in generations, each published by a file of its own.

A generation is a Parquet folder with the rows and, beside it, the file hashes that
it was built from, indexes, and the last log sequence that it holds. ACTIVE.<n> names
the folder of generation n; it is made only once and never replaced, and readers take
the greatest. So a failed run leaves the old state whole, a reader finds the old or the
new one and never none, and of two publishers of one generation the second fails.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillon.errors import EngineError
from quillon.functions import vectors as V
from quillon.functions.text import backoff_ms

SCHEMA = "id string, origin bigint, vector array<float>, norm double, content string, relativePath string, language string, fileExtension string, startLine int, endLine int, fragmentStartByte int, fragmentEndByte int, nodeKind string"
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_]*")


def checked_name(name: str) -> str:
    name = name.strip()
    if not _NAME.fullmatch(name):
        raise EngineError("collection:invalid_name", f"not a collection name: {name!r}")
    return name


def last_writes(rows: DataFrame, key: str = "id", order: tuple[str, ...] = ("sequence", "pos")) -> DataFrame:
    """One row for each key: the last written. A max over structs, so that a key's rows are combined before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(key, "_row.*").select(*rows.columns)


def without_ids(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key isn't among the deleted; unknown keys make no difference."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def duplicates(rows: DataFrame, key: str = "id", by: str = "origin") -> DataFrame:
    """(id, n, origins) of ids that stand more than once, in id order."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(by)).alias("origins")).where("n > 1").orderBy(key)


def sidecar_duplicates(rows: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """(id, n, sample): the same, with 80 characters of the least content."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(F.left(F.col(content), F.lit(80))).alias("sample")).where("n > 1")


def invalid_rows(rows: DataFrame, dimension: int) -> Column:
    return ~V.valid(F.col("vector"), dimension)


class Store:
    """Collections below a root folder; every path goes through Spark's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # files
    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        p = self._path()
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, *parts: str) -> str | None:
        fs, p = self._fs(), self._path(*parts)
        if not fs.exists(p):
            return None
        opened = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(opened)).decode()
        finally:
            opened.close()

    def _write(self, text: str, *parts: str) -> bool:
        """Make a file that isn't there yet; False if it is."""
        fs, p = self._fs(), self._path(*parts)
        fs.mkdirs(p.getParent())
        if fs.exists(p):
            return False
        try:
            out = fs.create(p, False)
        except Py4JJavaError as e:
            if fs.exists(p):  # another one was faster
                return False
            raise e
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def _children(self, *parts: str) -> list[str]:
        fs, p = self._fs(), self._path(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    # catalogue
    def names(self) -> list[str]:
        fs = self._fs()
        return [x for x in self._children() if fs.exists(self._path(x, "manifest.json"))]

    def has(self, name: str) -> bool:
        return self._read(checked_name(name), "manifest.json") is not None

    def manifest(self, name: str) -> dict:
        text = self._read(checked_name(name), "manifest.json")
        if text is None:
            raise EngineError("collection:not_found", name)
        return json.loads(text)

    def create(self, name: str, dimension: int, mode: str = "dense") -> None:
        if mode not in ("dense", "hybrid") or dimension <= 0:
            raise EngineError("collection:invalid", f"{mode}, {dimension}")
        if not self.has(name):
            self._write(json.dumps({"schemaVersion": 1, "collection": checked_name(name), "mode": mode, "dimension": dimension, "createdAtMs": int(time.time() * 1000)}, sort_keys=True), name, "manifest.json")

    def drop(self, name: str, attempts: int = 5, wait_ms: int = 150) -> None:
        for k in range(attempts):
            if not self._fs().exists(self._path(checked_name(name))) or self._fs().delete(self._path(name), True):
                return
            time.sleep(backoff_ms(k, wait_ms) / 1000)
        raise EngineError("collection:drop_failed", name, "unexpected")

    # rows
    def active(self, name: str) -> int | None:
        """The number of the generation that readers take."""
        found = self._folder(name)
        return found[0] if found else None

    def _folder(self, name: str) -> tuple[int, str] | None:
        made = sorted((int(x[7:]) for x in self._children(checked_name(name)) if re.fullmatch(r"ACTIVE\.[0-9]+", x)), reverse=True)
        for n in made:
            if folder := self._read(name, f"ACTIVE.{n}"):  # empty while it is being written
                return n, folder
        return None

    def place(self, name: str, *parts: str) -> str | None:
        """The path of something in the active generation; None if there is none."""
        found = self._folder(name)
        if found and self._fs().exists(self._path(name, "generations", found[1], *parts)):
            return "/".join([self.root, name, "generations", found[1], *parts])
        return None

    def read(self, name: str) -> DataFrame:
        self.manifest(name)
        at = self.place(name, "rows")
        return self.spark.read.schema(SCHEMA).parquet(at) if at else self.spark.createDataFrame([], SCHEMA)

    def file_hashes(self, name: str) -> DataFrame:
        at = self.place(name, "files")
        return self.spark.read.schema("path string, hash string").parquet(at) if at else self.spark.createDataFrame([], "path string, hash string")

    def sequence(self, name: str) -> int | None:
        """The last log sequence that the active generation holds."""
        found = self._folder(name)
        text = found and self._read(name, "generations", found[1], "sequence")
        return int(text) if text else None

    def publish(self, name: str, rows: DataFrame, files: DataFrame | None = None, sequence: int | None = None, keep: int = 3) -> int:
        """Write a generation, check it and make it the active one; older ones than the last `keep` go.

        What is read back must have as many rows as were written, no id twice and only
        valid vectors.
        """
        made, before, last = self.manifest(name), self._folder(name), self.sequence(name)
        g = (before[0] if before else 0) + 1
        folder = f"{g:08d}-{uuid.uuid4().hex[:8]}"
        at = f"{self.root}/{name}/generations/{folder}"
        if "norm" not in rows.columns:
            rows = rows.withColumn("norm", F.sqrt(V.norm2(F.col("vector"))))
        shape = [F.col(f.split()[0]).cast(f.split()[1]) if f.split()[0] in rows.columns else F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in SCHEMA.split(", ")]
        written = Observation()
        rows.select(*shape).observe(written, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{at}/rows")
        new = self.spark.read.schema(SCHEMA).parquet(f"{at}/rows")
        doubled, bad = duplicates(new).head(1), new.where(invalid_rows(new, made["dimension"])).head(1)
        fault = ("collection:duplicate_ids", doubled[0]["id"]) if doubled else ("vector:invalid_vector", bad[0]["id"]) if bad else None
        if fault is None and (found := new.count()) != written.get["n"]:
            fault = ("collection:row_count_mismatch", f"{found} of {written.get['n']} rows")
        if fault is None:
            if files is not None:
                files.select("path", "hash").write.mode("overwrite").parquet(f"{at}/files")
            if (upto := sequence if sequence is not None else last) is not None:
                self._write(str(upto), name, "generations", folder, "sequence")
            if not self._write(folder, name, f"ACTIVE.{g}"):
                fault = ("collection:publish_conflict", f"generation {g} of {name} was published by another")
        if fault:
            self._fs().delete(self._path(name, "generations", folder), True)
            raise EngineError(fault[0], str(fault[1]))
        for old in self._children(name, "generations"):
            if int(old[:8]) <= g - keep:
                self._fs().delete(self._path(name, "generations", old), True)
                self._fs().delete(self._path(name, f"ACTIVE.{int(old[:8])}"), False)
        return g

    def upsert(self, name: str, rows: DataFrame, sequence: int | None = None) -> int:
        """Insert rows; of equal ids the last written stays. Origins go on from the greatest. sequence: of the log, as far as rows hold it."""
        old = self.read(name)
        top = old.agg(F.coalesce(F.max("origin"), F.lit(-1))).first()[0]
        new = rows if "origin" in rows.columns else rows.withColumn("origin", F.monotonically_increasing_id() + top + 1)
        both = old.drop("norm").unionByName(new.drop("norm"), allowMissingColumns=True)
        return self.publish(name, last_writes(both, order=("origin",)), self.file_hashes(name), sequence)

    def delete(self, name: str, ids: DataFrame) -> int:
        return self.publish(name, without_ids(self.read(name), ids), self.file_hashes(name))

    def delete_paths(self, name: str, paths: DataFrame) -> int:
        """One anti join for all files at once."""
        return self.publish(name, without_ids(self.read(name), paths, "relativePath"), self.file_hashes(name))

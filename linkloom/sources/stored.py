"""Tables that are replaced and edited, and results that are kept until their inputs change.

A stored table is a folder of versions and a pointer file. A load writes a new version and then renames a new pointer over the old one, so
readers see the old rows or the new ones, and a load that fails leaves the table as it was. The version before the current one
is kept for readers that have begun; older ones go. One writer at a time.

A cached result is a folder named by the fingerprint of its input files (path, length, time of change) and of what was asked. It is
computed beside and renamed into place; a result whose inputs changed, or that is too old, is computed again and the older ones go.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Files:
    """Small operations on the file system that a path is on."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(self.conf)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def names(self, p: str) -> list[str]:
        return [str(x.getPath().getName()) for x in self.fs.listStatus(self.path(p))] if self.exists(p) else []

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)

    def read(self, p: str) -> str:
        s = self.fs.open(self.path(p))
        try:
            return bytes(s.readAllBytes()).decode()
        finally:
            s.close()

    def write(self, p: str, text: str) -> None:
        s = self.fs.create(self.path(p), True)
        s.write(bytearray(text.encode()))
        s.close()

    def replace(self, old: str, new: str) -> None:
        """Renames over what is there, in one step where the file system can."""
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        how = SparkContext._gateway.new_array(options, 1)
        how[0] = options.OVERWRITE
        context.rename(self.path(old), self.path(new), how)

    def inputs(self, p: str) -> list[tuple[str, int, int]]:
        """(path, length, time of change) of every file under p."""
        at = self.fs.listFiles(self.path(p), True)
        out = []
        while at.hasNext():
            f = at.next()
            out.append((str(f.getPath()), f.getLen(), f.getModificationTime()))
        return sorted(out)


class StoredTable:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.root, self.schema, self.files = spark, path.rstrip("/"), schema, Files(spark, path)

    def version(self) -> str | None:
        pointer = f"{self.root}/CURRENT"
        return self.files.read(pointer) if self.files.exists(pointer) else None

    def read(self) -> DataFrame:
        v = self.version()
        return self.spark.createDataFrame([], self.schema) if v is None else self.spark.read.schema(self.schema).parquet(f"{self.root}/{v}")

    def load(self, rows: DataFrame) -> None:
        """Replaces all rows."""
        before, new = self.version(), f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        wanted = self.spark.createDataFrame([], self.schema).schema
        try:
            rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted.fields]).write.parquet(f"{self.root}/{new}")
        except Exception:
            self.files.delete(f"{self.root}/{new}")
            raise
        self.files.write(f"{self.root}/CURRENT.new", new)
        self.files.replace(f"{self.root}/CURRENT.new", f"{self.root}/CURRENT")
        for name in self.files.names(self.root):
            if name.startswith("v-") and name not in (before, new):
                self.files.delete(f"{self.root}/{name}")

    def upsert(self, rows: DataFrame, key: list[str]) -> None:
        """Rows take the place of those with their key; others are added. Keys that repeat in `rows` are all kept."""
        self.load(self.read().join(rows.select(*key).distinct(), key, "left_anti").select(*self.read().columns).unionByName(rows.select(*self.read().columns)))

    def remove(self, keys: DataFrame) -> None:
        """Deletes the rows whose key (the columns of `keys`) is named."""
        now = self.read()
        self.load(now.join(keys.distinct(), keys.columns, "left_anti").select(*now.columns))

    def flag(self, keys: DataFrame, column: str, value) -> None:
        """Sets a column of the rows whose key is named."""
        now = self.read()
        told = keys.distinct().withColumn("told_", F.lit(True))
        changed = now.join(told, keys.columns, "left").withColumn(column, F.when(F.col("told_"), F.lit(value)).otherwise(F.col(column)))
        self.load(changed.select(*now.columns))


def cached(spark: SparkSession, folder: str, name: str, inputs: list[str], compute: Callable[[], DataFrame], asked: str = "", max_age: float | None = None) -> DataFrame:
    """compute(), or what it gave while the files under `inputs` and `asked` were the same, at most max_age seconds ago."""
    print_ = hashlib.sha256(repr([Files(spark, p).inputs(p) for p in inputs] + [asked]).encode()).hexdigest()[:32]
    files, root = Files(spark, folder), f"{folder.rstrip('/')}/{name}"
    fresh = []
    for found in files.names(root):
        made, _, of = found.partition("-")
        if of == print_ and (max_age is None or time.time() - int(made) / 1e9 <= max_age):
            fresh.append(found)
    if not fresh:
        new = f"{time.time_ns():020d}-{print_}"
        compute().write.parquet(f"{root}/.{new}")
        files.fs.rename(files.path(f"{root}/.{new}"), files.path(f"{root}/{new}"))
        for old in files.names(root):
            if old != new and not old.startswith("."):
                files.delete(f"{root}/{old}")
        fresh = [new]
    return spark.read.parquet(f"{root}/{max(fresh)}")


def drop_cached(spark: SparkSession, folder: str, name: str) -> None:
    """Forgets a result whatever its inputs."""
    Files(spark, folder).delete(f"{folder.rstrip('/')}/{name}")

"""Shared plumbing: scratch tables in the cluster's shared folder, size-checked joins, ordinals."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only when its counted rows, at the stated width, fit in this many bytes.
BROADCAST_BYTES = 24 << 20

TEXT_WORD_GAP = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir of the session.

    Only where that is unset and all runs in one process (tests) a temporary folder is made and set; a cluster is refused.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = getattr(spark.sparkContext, "_linkloom_shared", None)
    if made is None:
        made = "file://" + tempfile.mkdtemp(prefix="linkloom-")
        spark.sparkContext._linkloom_shared = made
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/linkloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: cuts the lineage and
    survives the loss of executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(_nullable(df.schema)).parquet(path)
    out._linkloom_path = path
    return out


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def discard(df: DataFrame | None) -> None:
    """Deletes a table of materialize() that no later plan reads."""
    path = getattr(df, "_linkloom_path", None)
    if path:
        delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_enough(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Counts df (a materialized or cheap table) and says if it may be broadcast."""
    return df.count() * row_bytes <= limit


def join_checked(big: DataFrame, small: DataFrame, on, how: str, row_bytes: int) -> DataFrame:
    """Joins with a broadcast of `small` if its counted size is within BROADCAST_BYTES, else with a
    shuffle (sort-merge, which adaptive execution splits where a key is hot)."""
    return big.join(F.broadcast(small) if small_enough(small, row_bytes) else small.hint("merge"), on, how)


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def plain_name(df: DataFrame, base: str) -> str:
    """A column name like `base` that df does not have yet (case-insensitively)."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def match_ids(docs: DataFrame, ids: DataFrame, id_col: str, how: str = "left_anti", row_bytes: int = 24) -> DataFrame:
    """The rows of docs whose id is not (left_anti) or is (left_semi) in the one-column table `ids`; nulls
    match nulls. All columns of docs and no others come back."""
    name = plain_name(docs, "match_id")
    ids = ids.toDF(name)
    return join_checked(docs, ids, F.expr(f"`{id_col}` <=> `{name}`"), how, row_bytes)


def null_mark(id_: Column, *by: Column) -> Column:
    """What tells rows with a null id apart: a hash of the columns that a verdict rests on; null where there is an id."""
    parts = [F.coalesce(F.sha2(c.cast("string"), 256), F.lit("")) for c in by]
    return F.when(id_.isNull(), F.sha2(F.concat_ws(",", *parts), 256))


def drop_rejected(docs: DataFrame, bad: DataFrame, id_col: str, mark: Column) -> DataFrame:
    """The rows of docs that `bad` (id, mark of null_mark(); materialized) does not name: all rows of a rejected
    id go, rows with a null id only where their mark is rejected."""
    id_, ids, marks = F.col(f"`{id_col}`"), bad.where("mark is null").select("id"), bad.where("mark is not null").select("mark").distinct()
    if marks.isEmpty():
        return docs if ids.isEmpty() else match_ids(docs, ids, id_col)
    name = plain_name(docs, "mark")
    unnamed = match_ids(docs.where(id_.isNull()).withColumn(name, mark), marks, name, row_bytes=80).drop(name)
    return match_ids(docs.where(id_.isNotNull()), ids, id_col).unionAll(unnamed)


def ordinals(df: DataFrame, *order: Column, name: str = "ordinal") -> DataFrame:
    """df with its rows' positions (from 0) in the given order: ranges are numbered apart and shifted by
    the counts of the ranges before, so no task sees all rows."""
    part = materialize(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "ordinals")
    counts = sorted((r["part_"], r["n"]) for r in part.groupBy("part_").agg(F.count("*").alias("n")).collect())  # a row for each partition
    at, total = [], 0
    for p, n in counts:
        at.append((p, total))
        total += n
    shift = df.sparkSession.createDataFrame(at or [(0, 0)], "part_ int, at_ long")
    rn = F.row_number().over(Window.partitionBy("part_").orderBy(*order)) - 1
    return part.withColumn("rn_", rn).join(F.broadcast(shift), "part_").withColumn(name, F.col("rn_") + F.col("at_")).drop("part_", "rn_", "at_")

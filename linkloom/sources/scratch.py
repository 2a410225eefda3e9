"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset and all runs in one process, a temporary folder. Without it a cluster is refused."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not hasattr(spark.sparkContext, "_linkloom_tables"):
        spark.sparkContext._linkloom_tables = "file://" + tempfile.mkdtemp(prefix="linkloom-tables-")
    return spark.sparkContext._linkloom_tables


def written(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: its lineage is cut and it outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/linkloom-tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._linkloom_table = path
    return out


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """df as a table in the shared folder, bucketed by key: joins on it with tables bucketed alike need no shuffle."""
    spark, name = df.sparkSession, f"linkloom_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/linkloom-tables/{name}"
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._linkloom_table, out._linkloom_name = path, name
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() and bucketed() that no later plan reads."""
    for df in tables:
        path = getattr(df, "_linkloom_table", None)
        if getattr(df, "_linkloom_name", None):
            df.sparkSession.sql(f"drop table if exists {df._linkloom_name}")
        if path:
            p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

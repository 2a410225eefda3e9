"""The link index kept up to date: changed posts stream in, and only the buckets they fall into are rewritten.

Layout: `<path>/links/bucket=<k>/`, k from a hash of the post's id. A post has a head row (n = -1) with the version it was indexed at, which stays
as a mark when the post is deleted, and a row for each link. So a bucket that was touched is never without rows, and a change that is
not newer than what is indexed does nothing, whenever and however often it arrives.

A batch is applied in two steps. The new rows of the touched buckets are first written to `<path>/pending/<batch>`; then they
replace these buckets by dynamic partition overwrite. If a run dies in between, the batch comes again, finds its rows
complete, and only replaces the buckets once more; they are not computed from a half replaced index.

A change is id, html, url, version, deleted. Null ids take no part. Of several changes of a post in a batch the newest counts; of equal
versions a deletion, then the greater html.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.links import build_index

CHANGE = "id long, html string, url string, version long, deleted boolean"
BUCKETS = 64
HEAD = -1
COLUMNS = ["src", "n", "url", "anchor", "host", "type", "version", "deleted", "bucket"]
SCHEMA = "src long, n int, url string, anchor string, host string, type string, version long, deleted boolean, bucket int"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, f"{path}/links"):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(f"{path}/links").select(*COLUMNS)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(src, n, url, anchor, host, type) of all posts that are there."""
    return _stored(spark, path).where(F.col("n") > HEAD).select(*COLUMNS[:6])


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(src, version, deleted) of every post that was ever indexed."""
    return _stored(spark, path).where(F.col("n") == HEAD).select("src", "version", "deleted")


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("src"), F.lit(buckets)).cast("int")


def pending_rows(changes: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame | None:
    """The rows of every bucket that these changes touch, as they are afterwards; None if nothing is new."""
    spark = changes.sparkSession
    last = F.max(F.struct("version", F.coalesce("deleted", F.lit(False)).alias("deleted"), "html", "url")).alias("x")
    newest = changes.where("id is not null").groupBy(F.col("id").alias("src")).agg(last).select("src", "x.*").withColumn("bucket", _bucket(buckets))
    touched = [r["bucket"] for r in newest.select("bucket").distinct().collect()]  # at most `buckets` numbers
    if not touched:
        return None
    old = _stored(spark, path).where(F.col("bucket").isin(touched))
    known = old.where(F.col("n") == HEAD).select("src", F.col("version").alias("known"))
    fresh = newest.join(known, "src", "left").where("known is null or version > known").drop("known")
    kept = old.join(fresh.select("src"), "src", "left_anti").select(*COLUMNS)
    none = F.lit(None).cast("string")
    heads = fresh.select("src", F.lit(HEAD).alias("n"), none.alias("url"), none.alias("anchor"), none.alias("host"), none.alias("type"), "version", "deleted", "bucket")
    links = build_index(fresh.where("not deleted").select(F.col("src").alias("id"), "html", "url")).withColumns({"version": F.lit(None).cast("long"), "deleted": F.lit(False), "bucket": _bucket(buckets)})
    return kept.unionByName(heads).unionByName(links.select(*COLUMNS))


def apply_changes(changes: DataFrame, path: str, batch: int, buckets: int = BUCKETS) -> None:
    """Applies one batch. Safe to repeat, also after a run that died half way."""
    spark, stage = changes.sparkSession, f"{path}/pending/{batch}"
    if not _exists(spark, f"{stage}/_SUCCESS"):
        rows = pending_rows(changes, path, buckets)
        if rows is None:
            return
        # one task a bucket, and so one file
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(stage)
    ready = spark.read.schema(SCHEMA).parquet(stage).select(*COLUMNS)
    ready.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/links")
    _delete(spark, f"{path}/pending/{batch - 1}")  # the batch before is committed; this one's rows stay until the next


def maintain(spark: SparkSession, source: str, path: str, checkpoint: str, max_files: int | None = None, buckets: int = BUCKETS) -> None:
    """Applies all changes that have come into the folder `source` since the last call."""
    r = spark.readStream.schema(CHANGE)
    changes = (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(source)
    changes.writeStream.foreachBatch(lambda df, k: apply_changes(df, path, k, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

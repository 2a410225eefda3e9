"""Long scans of a site's posts that can be stopped, resumed and watched, and the scheduled run built on them.

A scan is a stream over the files of a folder. Each micro-batch takes `files` of them, the file sink commits its rows once, and the checkpoint
knows what has been read; a scan that was stopped or died goes on with the first batch that was not committed. A listener writes a
row of progress for each batch (posts scanned, rows found), under the batch's number, so a repeated batch replaces its row.

A scan with a time budget ends after the batch that exceeds it. The scheduled run gives a scan its budget; once all posts are scanned
it records the day: a reading, the keys it compares by, and the digest against the day before, each in a partition of the
date, so that running it again the same day writes the same again. Readings beyond the retention are deleted.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from linkloom.operators import feedback
from linkloom.operators.links import build_index, resolve
from linkloom.streaming.index import _delete, _exists

POST = "id long, html string, url string"
KEEP_DAYS = 365


class Progress(StreamingQueryListener):
    """Writes each batch's counts to a table and says when the budget is spent."""

    def __init__(self, spark: SparkSession, path: str, job: str, budget: float | None):
        self.spark, self.path, self.job = spark, path, job
        self.deadline = None if budget is None else time.monotonic() + budget
        self.spent, self.ended = threading.Event(), threading.Event()
        self.run = None

    def _mine(self, event) -> bool:
        return self.run is None or str(event.runId) == self.run

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if str(p.runId) != self.run and self.run is not None:
            return
        seen = p.observedMetrics
        if "posts" in seen and seen["posts"]["n"]:
            row = [(self.job, int(p.batchId), int(seen["posts"]["n"]), int(seen["rows"]["n"]) if "rows" in seen else 0)]
            self.spark.createDataFrame(row, "job string, batch long, scanned long, found long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{self.job}-{p.batchId}")
        if self.deadline is not None and time.monotonic() > self.deadline:
            self.spent.set()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self._mine(event):
            self.ended.set()


def scan(spark: SparkSession, posts: str, state: str, job: str = "links", work: Callable[[DataFrame], DataFrame] = build_index, files: int = 1, budget: float | None = None) -> bool:
    """Runs `work` over the posts in a folder of Parquet files that no earlier call has scanned; returns whether all have been. work: from
    (id, html, url) to rows, without a shuffle."""
    rows = spark.readStream.schema(POST).option("maxFilesPerTrigger", files).parquet(posts).observe("posts", F.count(F.lit(1)).alias("n"))
    found = work(rows).observe("rows", F.count(F.lit(1)).alias("n"))
    listener = Progress(spark, f"{state}/progress", job, budget)
    spark.streams.addListener(listener)
    try:
        q = found.writeStream.format("parquet").option("path", f"{state}/{job}").option("checkpointLocation", f"{state}/checkpoint-{job}").trigger(availableNow=True).start()
        listener.run = str(q.runId)
        while not q.awaitTermination(0.05):
            if listener.spent.is_set():
                q.stop()  # what the next batch has begun is not committed and comes again
                break
        listener.ended.wait(60)
    finally:
        spark.streams.removeListener(listener)
    at = progress(spark, posts, state, job).first()
    return at["scanned"] >= at["total"]


def results(spark: SparkSession, state: str, job: str = "links") -> DataFrame:
    """What the committed batches have found."""
    return spark.read.parquet(f"{state}/{job}")


def progress(spark: SparkSession, posts: str, state: str, job: str = "links") -> DataFrame:
    """One row: job, scanned, found, total."""
    total = spark.read.schema(POST).parquet(posts).agg(F.count("*").alias("total"))
    if not _exists(spark, f"{state}/progress"):
        done = spark.createDataFrame([(0, 0)], "scanned long, found long")
    else:
        each = spark.read.schema("job string, batch long, scanned long, found long").option("recursiveFileLookup", "true").parquet(f"{state}/progress")
        done = each.where(F.col("job") == job).agg(F.coalesce(F.sum("scanned"), F.lit(0)).alias("scanned"), F.coalesce(F.sum("found"), F.lit(0)).alias("found"))
    return done.crossJoin(total).select(F.lit(job).alias("job"), "scanned", "found", "total")  # one row each


def _day(spark: SparkSession, state: str, name: str, day: date) -> str:
    return f"{state}/{name}/day={day.isoformat()}"


def _days(spark: SparkSession, state: str, name: str) -> list[date]:
    """The dates of a table's partitions, from its folder's listing."""
    if not _exists(spark, f"{state}/{name}"):
        return []
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state}/{name}")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return sorted(date.fromisoformat(str(f.getPath().getName())[4:]) for f in found if str(f.getPath().getName()).startswith("day="))


def record_day(spark: SparkSession, posts: DataFrame, links: DataFrame, state: str, day: date, site: str, opportunities: int = 0, keep_days: int = KEEP_DAYS) -> DataFrame:
    """Writes the day's reading, keys and digest and returns the digest. posts: id, url; links: as the index has them."""
    named = resolve(links, posts, site, "url")
    dead = named.where("type = 'internal' and target = 0").select(F.md5(F.concat_ws("|", F.col("src").cast("string"), "url")).alias("key")).distinct()
    orphans = posts.select("id").join(named.where("target > 0 and target <> src").select(F.col("target").alias("id")).distinct(), "id", "left_anti")
    dead.write.mode("overwrite").parquet(_day(spark, state, "dead", day))
    orphans.write.mode("overwrite").parquet(_day(spark, state, "orphans", day))
    now_dead, now_orphans = spark.read.parquet(_day(spark, state, "dead", day)), spark.read.parquet(_day(spark, state, "orphans", day))
    counts = links.agg(F.count_if(F.col("type") == "internal").alias("internal"), F.count_if(F.col("type") == "external").alias("external"))
    reading = posts.agg(F.count("*").alias("posts")).crossJoin(counts).crossJoin(now_orphans.agg(F.count("*").alias("orphaned"))).crossJoin(now_dead.agg(F.count("*").alias("broken")))  # one row each
    reading.withColumn("opportunities", F.lit(opportunities)).coalesce(1).write.mode("overwrite").parquet(_day(spark, state, "history", day))
    before = [d for d in _days(spark, state, "history") if d < day]
    if before:
        last = before[-1]
        old = spark.read.parquet(_day(spark, state, "history", last)).first()["opportunities"]
        digest = feedback.digest(spark.read.parquet(_day(spark, state, "dead", last)), now_dead, spark.read.parquet(_day(spark, state, "orphans", last)), now_orphans, old, opportunities)
    else:
        digest = feedback.digest(None, now_dead, None, now_orphans, 0, opportunities)
    digest.coalesce(1).write.mode("overwrite").parquet(_day(spark, state, "digest", day))
    for name in ("history", "digest", "dead", "orphans"):
        for d in _days(spark, state, name):
            # keys are only compared with the day before
            if d <= day - timedelta(days=keep_days) or (name in ("dead", "orphans") and d < (before[-1] if before else day)):
                _delete(spark, _day(spark, state, name, d))
    return spark.read.parquet(_day(spark, state, "digest", day))


def history(spark: SparkSession, state: str) -> DataFrame:
    return spark.read.parquet(f"{state}/history")


def scheduled_run(spark: SparkSession, posts: str, state: str, day: date, site: str, budget: float | None = None, files: int = 1, opportunities: int = 0, keep_days: int = KEEP_DAYS) -> DataFrame | None:
    """Scans for at most `budget` seconds and the batch that exceeds them; when all is scanned, records the day and returns its digest,
    else None: the next run goes on."""
    if not scan(spark, posts, state, files=files, budget=budget):
        return None
    table = spark.read.schema(POST).parquet(posts).select("id", "url")
    return record_day(spark, table, results(spark, state), state, day, site, opportunities, keep_days)

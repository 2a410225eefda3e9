"""Click events with Structured Streaming: ingestion, per-client throttling, daily windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from linkloom.functions import text

EVENT = "post_id long, url string, anchor string, ip string, ts timestamp"
MOST, WINDOW_S = 30, 60


def read_events(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A stream of JSON events from a folder."""
    r = spark.readStream.schema(EVENT)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).json(path)


def internal_clicks(events: DataFrame, site: str) -> DataFrame:
    """Events whose URL leads to the site itself, with the client's key; the rest is not stored."""
    host = text.host_of(F.col("url"))
    return events.where((F.col("post_id") > 0) & (F.trim("url") != "") & (host.isNull() | (host == site)))


def client_key(ip, salt: str):
    return F.sha2(F.concat(F.coalesce(ip, F.lit("")), F.lit(salt)), 256)


def accept(times: list[float], state: tuple[int, float], most: int = MOST, window_s: int = WINDOW_S) -> tuple[list[bool], tuple[int, float]]:
    """Which of a client's hits (seconds, in order) pass. Every accepted hit renews the window, so a client is let in
    again only after a gap of window_s seconds in which nothing was accepted."""
    n, until = state
    out = []
    for t in times:
        if t >= until:
            n = 0
        ok = n < most
        if ok:
            n, until = n + 1, t + window_s
        out.append(ok)
    return out, (n, until)


def throttle(clicks: DataFrame, most: int = MOST, window_s: int = WINDOW_S) -> DataFrame:
    """A stream of clicks (with column client) without those over the limit; state is a count and a deadline per client,
    dropped by an event-time timeout."""
    cols = clicks.columns

    def run(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(pdfs)).sort_values(["ts", *[c for c in cols if c not in ("ts", "client")]], kind="stable")
        have = tuple(state.get) if state.exists else (0, 0.0)
        ok, new = accept([t.timestamp() for t in pdf["ts"]], have, most, window_s)
        state.update(new)
        state.setTimeoutTimestamp(max(int(new[1] * 1000), state.getCurrentWatermarkMs() + 1))
        yield pdf[ok][cols]

    return clicks.withWatermark("ts", "10 minutes").groupBy("client").applyInPandasWithState(run, clicks.schema, "n int, until double", "append", GroupStateTimeout.EventTimeTimeout)


def throttle_batch(clicks: DataFrame, most: int = MOST, window_s: int = WINDOW_S) -> DataFrame:
    """The same over stored clicks: a client's hits in order. Hits are narrow, but a client's sequence is inherent."""
    cols = clicks.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", *[c for c in cols if c not in ("ts", "client")]], kind="stable")  # equal times in one order
        ok, _ = accept([t.timestamp() for t in pdf["ts"]], (0, 0.0), most, window_s)
        return pdf[ok][cols]

    return clicks.groupBy("client").applyInPandas(run, clicks.schema)


def daily_counts(clicks: DataFrame, late: str = "1 hour") -> DataFrame:
    """Clicks per target and day, on a stream or a table."""
    c = clicks.withWatermark("ts", late) if clicks.isStreaming else clicks
    return c.groupBy(F.window("ts", "1 day").alias("w"), "target").agg(F.count("*").alias("clicks")).select(F.col("w.start").alias("day"), "target", "clicks")


def ingest(spark: SparkSession, source: str, out: str, checkpoint: str, site: str, salt: str) -> None:
    """Takes what is in the folder now: classified, throttled, appended as Parquet."""
    rows = internal_clicks(read_events(spark, source), site).withColumn("client", client_key(F.col("ip"), salt)).drop("ip")
    throttle(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()

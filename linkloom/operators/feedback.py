"""Learned rejections, history, activity and undo: event logs and what is derived from them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions import text

# ---- rejections: events (post_id, target, anchor, happened, kind) with kind reject, restore_anchor or restore_pair


def evidence(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per anchor, per pair): distinct posts that rejected since the latest restore. Restoring an anchor
    also clears its pairs."""
    e = events.withColumn("norm", text.normalize_anchor(F.col("anchor"))).where("norm <> ''")
    ra = e.where("kind = 'restore_anchor'").groupBy("norm").agg(F.max("happened").alias("ra"))
    rp = e.where("kind = 'restore_pair'").groupBy("norm", "target").agg(F.max("happened").alias("rp"))
    live = e.where("kind = 'reject'").join(ra, "norm", "left").where("ra is null or happened > ra")
    anchors = live.groupBy("norm").agg(F.countDistinct("post_id").alias("posts"), F.max("happened").alias("last"))
    pairs = live.join(rp, ["norm", "target"], "left").where("rp is null or happened > rp").groupBy("norm", "target").agg(F.countDistinct("post_id").alias("posts"), F.max("happened").alias("last"))
    return anchors, pairs


def threshold(value: int) -> int:
    return min(50, max(0, int(value)))


def blocked(events: DataFrame, pair_at: int = 2, anchor_at: int = 3) -> DataFrame:
    """(norm, target, posts, last): blocked anchors with a null target, and blocked pairs. 0 turns a rule off."""
    anchors, pairs = evidence(events)
    a = anchors.where((F.lit(threshold(anchor_at)) > 0) & (F.col("posts") >= threshold(anchor_at))).withColumn("target", F.lit(None).cast("long"))
    p = pairs.where((F.lit(threshold(pair_at)) > 0) & (F.col("posts") >= threshold(pair_at)))
    return a.select("norm", "target", "posts", "last").unionByName(p.select("norm", F.col("target").cast("long").alias("target"), "posts", "last"))


def suppressed(events: DataFrame, pair_at: int = 2, anchor_at: int = 3) -> DataFrame:
    """Blocked anchors, and blocked pairs whose anchor is not blocked."""
    b = blocked(events, pair_at, anchor_at)
    a = b.where("target is null")
    return a.unionByName(b.where("target is not null").join(a.select("norm"), "norm", "left_anti"))


def pending(events: DataFrame, anchor_at: int = 3) -> DataFrame:
    """Anchors with some evidence but too little, and how much is missing."""
    anchors, _ = evidence(events)
    return anchors.where(F.col("posts") < threshold(anchor_at)).select("norm", "posts", (threshold(anchor_at) - F.col("posts")).alias("needed"), "last")


def allowed(candidates: DataFrame, events: DataFrame, pair_at: int = 2, anchor_at: int = 3) -> DataFrame:
    """candidates (with norm and target) that no rule blocks."""
    b = blocked(events, pair_at, anchor_at)
    return candidates.join(b.where("target is null").select("norm"), "norm", "left_anti").join(b.where("target is not null").select("norm", "target"), ["norm", "target"], "left_anti")


# ---- history: readings (taken_on, taken, metrics)

METRICS = {"internal": True, "orphaned": False, "broken": False, "opportunities": False}  # True: more is better


def daily(readings: DataFrame) -> DataFrame:
    """The last reading of each day."""
    cols = [c for c in readings.columns if c not in ("taken_on", "taken")]
    return readings.groupBy("taken_on").agg(F.max_by(F.struct(*cols), "taken").alias("x")).select("taken_on", "x.*")


def series(history: DataFrame, asof: date, days: int = 90) -> DataFrame:
    return history.where(F.col("taken_on") >= F.date_sub(F.lit(asof), days)).orderBy("taken_on")


def trends(history: DataFrame) -> DataFrame:
    """(metric, then, now, change, good): first against last; good is null when nothing moved."""
    long = history.unpivot(["taken_on"], [F.col(m).cast("double").alias(m) for m in METRICS], "metric", "value")
    r = long.groupBy("metric").agg(F.min_by("value", "taken_on").alias("then"), F.max_by("value", "taken_on").alias("now")).withColumn("change", F.col("now") - F.col("then"))
    up = F.col("metric").isin(*[m for m, u in METRICS.items() if u])
    return r.withColumn("good", F.when(F.abs("change") > 1e-4, F.when(up, F.col("change") > 0).otherwise(F.col("change") < 0)))


def steps(history: DataFrame) -> DataFrame:
    """Each day's change against the day before, per metric. One row per day: a short series."""
    w = W.orderBy("taken_on")
    return history.select(F.col("taken_on"), *[(F.col(m) - F.lag(m).over(w)).alias(f"d_{m}") for m in METRICS])


def diff(prev: DataFrame, now: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are new or gone: (key..., what)."""
    new = now.select(*key).distinct().join(prev.select(*key), key, "left_anti").withColumn("what", F.lit("new"))
    return new.unionByName(prev.select(*key).distinct().join(now.select(*key), key, "left_anti").withColumn("what", F.lit("fixed")))


def digest(prev_broken: DataFrame | None, now_broken: DataFrame, prev_orphans: DataFrame | None, now_orphans: DataFrame, prev_opps: int, now_opps: int) -> DataFrame:
    """One row: new_broken, fixed_broken, new_orphans, new_opps and a subject; a first run reports no changes."""
    spark = now_broken.sparkSession
    if prev_broken is None or prev_orphans is None:
        return spark.createDataFrame([(0, 0, 0, 0, "No changes")], "new_broken long, fixed_broken long, new_orphans long, new_opps long, subject string")
    b = diff(prev_broken, now_broken, ["key"]).agg(F.count_if(F.col("what") == "new").alias("new_broken"), F.count_if(F.col("what") == "fixed").alias("fixed_broken"))
    o = diff(prev_orphans, now_orphans, ["id"]).agg(F.count_if(F.col("what") == "new").alias("new_orphans"))
    one = b.crossJoin(o).withColumn("new_opps", F.lit(max(0, now_opps - prev_opps)).cast("long"))  # one row each
    some = lambda c, w: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {w}"), F.when(F.col(c) == 1, "").otherwise("s")))
    subject = F.concat_ws(", ", some("new_broken", "broken link"), some("new_orphans", "orphaned post"), some("new_opps", "new suggestion"))
    return one.withColumn("subject", F.when(subject == "", "No changes").otherwise(subject))


# ---- activity: log (id, post_id, action, summary, batch, reverted, created[, content_before, after_hash])


def filtered(log: DataFrame, post: int | None = None, action: str | None = None, state: str | None = None, limit: int = 100) -> DataFrame:
    where = F.lit(True)
    if post is not None:
        where = where & (F.col("post_id") == post)
    if action is not None:
        where = where & (F.col("action") == action)
    if state in ("undone", "undoable"):
        where = where & (F.col("reverted") == (state == "undone"))
    return log.where(where).orderBy(F.col("id").desc()).limit(limit)


def batches(log: DataFrame, limit: int = 20) -> DataFrame:
    rows = log.where("batch <> ''").groupBy("batch").agg(F.min("summary").alias("summary"), F.count("*").alias("n"), F.count_if(~F.col("reverted")).alias("open"), F.max("created").alias("created"), F.max("id").alias("last"))
    return rows.orderBy(F.col("last").desc()).limit(limit)


def retained(log: DataFrame, keep: int = 300) -> DataFrame:
    """The newest `keep` rows; the newest batch is never split. 0 keeps nothing."""
    if keep <= 0:
        return log.where("false")
    edge = log.orderBy(F.col("id").desc()).offset(keep).limit(1).select(F.col("id").alias("cut"))
    last = log.orderBy(F.col("id").desc()).limit(1).select(F.col("batch").alias("last_batch"))
    both = log.join(F.broadcast(edge), F.col("id") <= F.col("cut"), "left").crossJoin(F.broadcast(last))  # a row each
    return both.where("cut is null or (batch <> '' and batch = last_batch)").drop("cut", "last_batch")


def expired(rows: DataFrame, ts: str, asof, days: int) -> DataFrame:
    """Rows inside the retention window; 0 days keeps all."""
    return rows if days <= 0 else rows.where(F.col(ts) >= F.lit(asof) - F.expr(f"interval {int(days)} days"))


def record(before: DataFrame, after: DataFrame, action: str, summary: str, batch: str) -> DataFrame:
    """Undo rows for posts whose content changed: the pre-image and a hash of what replaced it."""
    j = before.select(F.col("id").alias("post_id"), F.col("content").alias("content_before")).join(after.select(F.col("id").alias("post_id"), F.col("content").alias("now")), "post_id").where("content_before <> now")
    return j.select("post_id", F.lit(action).alias("action"), F.lit(summary).alias("summary"), "content_before", F.md5("now").alias("after_hash"), F.lit(batch).alias("batch"), F.lit(False).alias("reverted"))


def revert(log: DataFrame, posts: DataFrame) -> DataFrame:
    """Each log row's outcome: done (with the content to restore) or why not."""
    j = log.join(posts.select(F.col("id").alias("post_id"), F.col("content").alias("current")), "post_id", "left")
    why = (F.when(F.col("reverted"), "already reverted").when(F.col("current").isNull(), "post missing").when(F.md5("current") != F.col("after_hash"), "changed since").otherwise("done"))
    return j.withColumn("outcome", why).withColumn("restored", F.when(F.col("outcome") == "done", F.col("content_before")))


def revert_batch(log: DataFrame, posts: DataFrame) -> DataFrame:
    """One row per post of a batch, rolled back newest first as far as hashes agree: the post's state before
    the earliest row that can be reached. Reaching row k needs the rows after it to have been undone, whose
    pre-image must hash to row k's after_hash."""
    w = W.partitionBy("post_id").orderBy(F.col("id").desc())
    rows = log.where("not reverted").join(posts.select(F.col("id").alias("post_id"), F.col("content").alias("current")), "post_id")
    seen = F.coalesce(F.lag("content_before").over(w), F.col("current"))
    ok = (F.md5(seen) == F.col("after_hash")).cast("int")
    done = rows.withColumn("ok", ok).withColumn("chain", F.min("ok").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = done.groupBy("post_id").agg(F.sum("chain").alias("n_done"), (F.count("*") - F.sum("chain")).alias("n_failed"), F.min_by(F.when(F.col("chain") == 1, F.col("content_before")), F.when(F.col("chain") == 1, F.col("id"))).alias("restored"))
    return out

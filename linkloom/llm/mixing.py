"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words: its share by weight of `share` times all words, never above
`repeats` times what it has; the excess is shared again by weight (water-filling). A document's expected number of
copies is proportional to its weight: a column, or by default 1 + floor(log2(1 + words)), so long documents are likelier.
The factor is set per source, with documents at `repeats` copies held there, so that expected words equal the target.
The whole part of the expectation is certain. The rest is an inclusion probability p; documents are ranked by random odds over
inclusion odds, (u/(1-u)) / (p/(1-p)), and taken in that order until the words still missing are filled: a sample of
fixed size, in words, with unequal probabilities. One more document per source, the one whose size is closest to the
gap that is left, closes it.

u is a hash of the document's id, text and source, and of a number where these repeat, so reruns agree and the order
of rows is not used. Repeats that hold more than 2^-HEAVY_BITS of all words are numbered one by one; lighter ones share one u.

The cut is found in steps that never gather a source in one task: words per (source, rank bucket) are summed map-side,
the bucket that holds the cut is found in two levels of 2^7 buckets, then only its documents are ordered. Whether a
document is taken is then a comparison with its source's cut, so texts are not shuffled (those of heavy repeats are, once,
by group and partition, to number them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, join_checked, materialize, ordinals

LEVEL = 1 << 7
BUCKETS = LEVEL * LEVEL
HEAVY_BITS = 16
#: The weights of sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(base: DataFrame, weights=WEIGHTS, share: float = 1.5, repeats: float = 2.0) -> DataFrame:
    """(source, s, target) from rows (source, size): water-filling over grouped sums."""
    sums = base.groupBy("source").agg(F.sum("size").alias("s"))
    ranked = ordinals(sums, F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    src = materialize(ranked.withColumn("weight", F.element_at(table, (F.col("ordinal") % len(weights) + 1).cast("int"))), "sources")
    cap = F.col("s") * F.lit(float(repeats))
    total = src.agg(F.sum("s").alias("s"), F.sum("weight").alias("w")).first()
    want, level, full = (total["s"] or 0) * share, 0.0, -1
    if total["w"]:
        level = want / total["w"]
        while True:
            r = src.agg(F.count_if(cap <= F.col("weight") * level).alias("n"), F.sum(F.when(cap <= F.col("weight") * level, cap)).alias("held"),
                        F.sum(F.when(cap > F.col("weight") * level, F.col("weight"))).alias("open")).first()
            if r["n"] == full or not r["open"]:
                break
            full, level = r["n"], (want - (r["held"] or 0)) / r["open"]
    return src.select("source", "s", F.least(cap, F.col("weight") * level).alias("target"))


def expectations(by_level: DataFrame, targets: DataFrame, repeats: float = 2.0) -> DataFrame:
    """targets (key, target, ...) with factor: the expected copies of a document are least(repeats, factor * w), and its
    source's expected words are the target. by_level: (key, level, size, sw, top), sums of words and of words times weight and
    the largest weight of a bounded number of weight levels; a level is held at `repeats` as a whole. The factor is null where
    all documents of a weight reach `repeats`."""
    down = W.partitionBy("key").orderBy(F.col("level").desc())
    held = F.coalesce(F.sum("size").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum("sw").over(down.rowsBetween(W.currentRow, W.unboundedFollowing))
    rows = join_checked(by_level, targets.select("key", "target"), "key", "inner", 64)
    rows = rows.withColumn("factor", (F.col("target") - held * repeats) / F.nullif(open_, F.lit(0.0))).where(F.col("factor") * F.col("top") < repeats)
    best = rows.groupBy("key").agg(F.max_by("factor", "level").alias("factor"))  # the fewest levels held
    return materialize(targets.join(best, "key", "left"), "factors")


def _level(w: Column, exact: bool) -> Column:
    """A weight's level: itself where weights are few, else one of 64 levels an octave, from 2^-32 to 2^32."""
    return w if exact else F.when(w > 0, F.floor(F.log2(F.greatest(F.least(w, F.lit(2.0**32)), F.lit(2.0**-32))) * 64).cast("double")).otherwise(F.lit(-(2.0**20)))


def _key(source: Column) -> Column:
    """A source as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight_col: str | None) -> DataFrame:
    """docs with mix_size_, mix_w_, mix_h_ and mix_key_ of each row; written apart where heavy repeats are numbered."""
    keys = [F.col(f"`{c}`").cast("string") for c in (id_col, text_col, source_col)]
    size = n_words(F.col(f"`{text_col}`"))
    if weight_col is None:
        w = 1.0 + F.floor(F.log2(1.0 + size))
    else:
        given = F.col(f"`{weight_col}`").cast("double")
        w = F.when(F.coalesce(F.isnan(given), F.lit(False)) | given.isNull(), 1.0).otherwise(F.greatest(given, F.lit(0.0)))
    return docs.withColumns({"mix_size_": size, "mix_w_": w.cast("double"), "mix_h_": F.xxhash64(*keys, F.lit("mix")), "mix_key_": _key(keys[2])})


def _narrow(rows: DataFrame, source_col: str) -> DataFrame:
    return rows.select(F.col(f"`{source_col}`").cast("string").alias("source"), F.col("mix_key_").alias("key"), F.col("mix_size_").alias("size"), F.col("mix_w_").alias("w"), F.col("mix_h_").alias("h"))


def _number_repeats(rows: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """rows with a hash of its own for each row of a heavy group of repeats, and the table of these rows, if any."""
    total = base.agg(F.sum("size")).first()[0] or 0
    groups = base.groupBy("h").agg(F.count("*").alias("n"), F.sum("size").alias("s")).where((F.col("n") > 1) & (F.col("s") > total >> HEAVY_BITS))
    heavy = materialize(groups.select(F.col("h").alias("mix_h_")), "heavy")
    if heavy.isEmpty():
        return rows, None
    few = F.broadcast(heavy)  # at most 2^HEAVY_BITS rows, by their words
    marked = rows.join(few, "mix_h_", "left_semi").withColumns({"mix_part_": F.spark_partition_id(), "mix_at_": F.monotonically_increasing_id()})
    marked = materialize(marked, "repeats")
    parts = marked.groupBy("mix_h_", "mix_part_").count()
    before = F.coalesce(F.sum("count").over(W.partitionBy("mix_h_").orderBy("mix_part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(parts.withColumn("mix_before_", before).drop("count"), "starts")
    own = F.row_number().over(W.partitionBy("mix_h_", "mix_part_").orderBy("mix_at_"))
    numbered = join_checked(marked.withColumn("mix_at_", own), starts, ["mix_h_", "mix_part_"], "inner", 24)
    numbered = numbered.withColumn("mix_h_", F.xxhash64("mix_h_", F.col("mix_before_") + F.col("mix_at_")))
    numbered = materialize(numbered.select(*[F.col(f"`{c}`") for c in rows.columns]), "numbered")
    discard(marked)
    discard(starts)
    return rows.join(few, "mix_h_", "left_anti").select(*[F.col(f"`{c}`") for c in rows.columns]).unionAll(numbered), numbered


def _rank(size: Column, w: Column, h: Column, factor: Column, target: Column, repeats: float) -> tuple[Column, Column, Column]:
    """(certain copies, rank in [0, 1] that orders as odds of u over odds of p, whether one more copy may be taken)."""
    most = F.when((w > 0) & (target > 0), F.lit(float(repeats))).otherwise(0.0)
    expect = F.when(factor.isNull(), most).otherwise(F.least(F.lit(float(repeats)), factor * w))
    sure = F.floor(expect + 1e-9)
    p = F.greatest(expect - sure, F.lit(0.0))
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
    odds = u / (1 - u)
    k = F.when(p <= 0, 1.0).otherwise(odds * (1 - p) / (odds * (1 - p) + p))
    return sure.cast("long"), k, (sure + 1 <= repeats) & (w > 0) & (size > 0)


def _edge(by: DataFrame, need: DataFrame, bucket: str) -> DataFrame:
    """(key, bucket, before, need): the bucket in which each source's missing words are reached. by: (key, bucket, free), at
    most LEVEL rows per key; need: (key, need, before), where before is what lower levels hold."""
    run = F.sum("free").over(W.partitionBy("key").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1))
    cum = join_checked(by, need, "key", "inner", 64).withColumn("before", F.col("before") + F.coalesce(run, F.lit(0)))
    at = cum.where("before <= need and before + free > need").groupBy("key").agg(F.max_by(F.struct(bucket, "before", "need"), bucket).alias("e"))
    return materialize(at.select("key", f"e.{bucket}", "e.before", "e.need"), "edge")


def plan_mix(base: DataFrame, weights=WEIGHTS, share: float = 1.5, repeats: float = 2.0, few_weights: bool = False) -> DataFrame:
    """One row per source of base (source, key, size, w, h; few_weights says that w has a bounded number of values): key, source, s, target, factor, cut (rank up to which
    documents get one more copy), extra (rank of the closing document or null)."""
    targets = source_targets(base, weights, share, repeats).withColumn("key", _key(F.col("source")))
    by_level = base.groupBy("key", _level(F.col("w"), few_weights).alias("level")).agg(F.sum("size").alias("size"), F.sum(F.col("size") * F.col("w")).alias("sw"), F.max("w").alias("top"))
    src = expectations(materialize(by_level, "levels"), targets, repeats)
    sure, k, room = _rank(F.col("size"), F.col("w"), F.col("h"), F.col("factor"), F.col("target"), repeats)
    rows = join_checked(base.drop("source"), src.select("key", "factor", "target"), "key", "inner", 64).where("size > 0")
    rows = rows.select("key", "size", "target", sure.alias("sure"), k.alias("k"), room.alias("room")).withColumn("b", F.least(F.lit(BUCKETS - 1), F.floor(F.col("k") * BUCKETS)).cast("int"))
    free = F.sum(F.when(F.col("room"), F.col("size")).otherwise(0))
    by = materialize(rows.groupBy("key", "b").agg(F.sum(F.col("size") * F.col("sure")).alias("sure"), free.alias("free"), F.first("target").alias("target")).withColumn("c", F.shiftright("b", 7)), "buckets")
    need = by.groupBy("key").agg((F.first("target") - F.sum("sure") + 1e-6).alias("need")).withColumn("before", F.lit(0).cast("long"))
    coarse = _edge(by.groupBy("key", "c").agg(F.sum("free").alias("free")), need, "c")
    inner = join_checked(by, coarse.select("key", "c"), ["key", "c"], "left_semi", 64)
    edge = _edge(inner.select("key", "b", "free"), coarse.select("key", "need", "before"), "b")
    inside = join_checked(rows.where("room"), edge, ["key", "b"], "inner", 64)
    by_rank = inside.groupBy("key", "k").agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("need").alias("need"))
    run = by_rank.withColumn("end", F.col("before") + F.sum("size").over(W.partitionBy("key").orderBy("k")))
    got = run.groupBy("key").agg(F.max(F.when(F.col("end") <= F.col("need"), F.col("k"))).alias("cut"), F.max(F.when(F.col("end") <= F.col("need"), F.col("end"))).alias("got"))
    cuts = edge.join(got, "key", "left").select("key", F.coalesce("cut", F.col("b") / BUCKETS * (1 - 2.0**-53)).alias("cut"), (F.col("need") - F.coalesce("got", "before")).alias("gap"))
    cuts = materialize(cuts, "cuts")
    later = join_checked(rows.where("room"), cuts, "key", "inner", 64).where("k > cut and size < 2 * gap")
    extra = later.groupBy("key").agg(F.min_by("k", F.struct(F.abs(F.col("size") - F.col("gap")), "k")).alias("extra"))
    out = src.join(cuts.drop("gap"), "key", "left").join(extra, "key", "left")
    full = F.when(F.col("target") > 0, 2.0).otherwise(-1.0)
    plan = materialize(out.withColumn("cut", F.coalesce("cut", full)), "mixplan")
    for t in (src, by, coarse, edge, cuts):
        discard(t)
    return plan


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, weights=WEIGHTS,
           share: float = 1.5, repeats: float = 2.0) -> DataFrame:
    """docs with mix_size_, mix_plan_ (source, s, target, ...) and mix_copies_ (0 up to repeats) of each row.

    Defined cases: a null source is a source (last in order); null, empty or blank texts have size 0 and are taken as often
    as the whole part of their expectation; a null or NaN weight is 1, a negative one 0, and documents of weight 0 are
    never taken; rows equal in id, text and source are documents of their own where they hold many words, else alike; ties in rank are
    taken together; an empty table gives no rows; other columns may have any name but those.
    """
    rows = _rows(docs, id_col, text_col, source_col, weight_col)
    base = materialize(_narrow(rows, source_col), "mix")
    rows, numbered = _number_repeats(rows, base)
    if numbered is not None:
        discard(base)
        base = materialize(_narrow(rows, source_col), "mix")
    plan = plan_mix(base, weights, share, repeats, weight_col is None)
    discard(base)
    # the plan's columns are nested so that they can't clash with columns of docs
    nested = plan.select(F.col("key").alias("mix_key_"), F.struct("source", "s", "target", "factor", "cut", "extra").alias("mix_plan_"))
    j = join_checked(rows, nested, "mix_key_", "inner", 128)
    sure, k, room = _rank(F.col("mix_size_"), F.col("mix_w_"), F.col("mix_h_"), F.col("mix_plan_.factor"), F.col("mix_plan_.target"), repeats)
    more = room & ((k <= F.col("mix_plan_.cut")) | F.coalesce(k == F.col("mix_plan_.extra"), F.lit(False)))
    return j.withColumn("mix_copies_", (sure + more.cast("int")).cast("int")).select(*[F.col(f"`{c}`") for c in docs.columns], "mix_size_", "mix_w_", "mix_plan_", "mix_copies_")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, weights=WEIGHTS,
        share: float = 1.5, repeats: float = 2.0) -> DataFrame:
    """The mix itself: each document as often as copies() takes it, with docs' columns; its defined cases hold."""
    taken = copies(docs, id_col, text_col, source_col, weight_col, weights, share, repeats)
    return taken.where("mix_copies_ > 0").withColumn("mix_i_", F.explode(F.sequence(F.lit(1), F.col("mix_copies_")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return copies(docs).select("doc_id", F.col("mix_size_").alias("size"), F.col("mix_plan_.s").alias("source_size"), F.col("mix_plan_.target").alias("target"),
                               (F.col("mix_size_") * F.col("mix_copies_")).cast("long").alias("taken"))

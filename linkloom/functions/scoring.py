"""Scores as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
TIER_WEIGHT = {"exact": 1.00, "partial": 0.92, "title": 0.85, "salient": 0.70}
MIX = (0.75, 0.15, 0.10)
SEMANTIC_FLOOR, SEMANTIC_GOOD, SIMILARITY_GOOD = 0.25, 0.70, 0.12
IMPACT = (0.60, 0.25, 0.15)
STRIKING = (10.5, 20.5)
MIN_IMPRESSIONS = 10


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def idf(df: Column, docs: Column) -> Column:
    """Rarity from 0 to 1; 1 when there are fewer than two documents."""
    n = docs.cast("double")
    return F.when(n < 2, 1.0).otherwise(clamp(F.ln((n + 1) / (df + 1)) / F.ln(n + 1)))


def similarity_norm(semantic: Column, lexical: Column) -> Column:
    return F.when(semantic.isNotNull(), clamp((semantic - SEMANTIC_FLOOR) / (SEMANTIC_GOOD - SEMANTIC_FLOOR))).otherwise(F.least(F.lit(1.0), lexical / SIMILARITY_GOOD))


def tier_weight(tier: Column) -> Column:
    out = F.lit(None).cast("double")
    for k, v in TIER_WEIGHT.items():
        out = F.when(tier == k, v).otherwise(out)
    return out


def confidence(sim: Column, overlap: Column, cluster: Column, tier: Column) -> Column:
    return (MIX[0] * sim + MIX[1] * overlap + MIX[2] * cluster) * tier_weight(tier)


def priority(conf: Column, need_: Column, boost: Column | float = 0.15) -> Column:
    return conf * (1 + boost * need_)


def need(relative: Column) -> Column:
    """How starved of equity a page is: 1 at a quarter of the mean, 0 at the mean."""
    return clamp((1 - relative) / 0.75)


def demand(impressions: Column, position: Column) -> Column:
    """Search demand from 0 to 1, null where too little is known."""
    at = (F.when(position < STRIKING[0], 0.25).when(position <= STRIKING[1], 1 - (position - STRIKING[0]) / 10 * 0.35)
          .otherwise(F.greatest(F.lit(0.0), 0.55 - (position - STRIKING[1]) / 30 * 0.55)))
    volume = 0.4 + 0.6 * F.least(F.lit(1.0), F.log10(F.greatest(F.lit(10.0), impressions.cast("double"))) / 4)
    return F.when((impressions >= MIN_IMPRESSIONS) & (position > 0), at * volume)


def impact(relevance: Column, need_: Column, demand_: Column) -> Column:
    a, b, c = IMPACT
    return clamp(F.when(demand_.isNull(), (a * relevance + b * need_) / (a + b)).otherwise(a * relevance + b * need_ + c * demand_))


def band(pct: Column) -> Column:
    return F.when(pct >= 85, "Excellent").when(pct >= 70, "Good").when(pct >= 50, "Needs Work").otherwise("Poor")


def band_level(pct: Column) -> Column:
    return F.when(pct >= 70, "good").when(pct >= 50, "warn").otherwise("bad")


def health(coverage: Column, orphaned: Column, total: Column, broken: Column, links: Column) -> Column:
    orphan = F.least(F.lit(1.0), orphaned / F.greatest(F.lit(1), total))
    bad = F.when(links > 0, F.least(F.lit(1.0), broken / F.greatest(F.lit(1), links))).otherwise(0.0)
    return F.round(clamp(coverage * 0.60 + (1 - orphan) * 25 + (1 - bad) * 15, 0.0, 100.0)).cast("int")


def quality(internal: Column, with_outbound: Column, total: Column) -> Column:
    n = F.greatest(F.lit(1), total)
    return F.round(clamp((F.least(F.lit(1.0), internal / n / 3) * 0.6 + with_outbound / n * 0.4) * 10, 0.0, 10.0), 1)


def delta_pct(now: Column, prev: Column) -> Column:
    """Change in percent against an earlier window; from nothing it is 100 or 0."""
    return F.when(prev > 0, F.round((now - prev) * 100.0 / F.greatest(prev, F.lit(1)))).otherwise(F.when(now > 0, 100.0).otherwise(0.0)).cast("int")


def strength(match: Column, score: Column) -> Column:
    """Confidence meter: match in percent, else score out of ten, else one half."""
    return clamp(F.coalesce(match / 100, score / 10, F.lit(0.5)))


def severity(same_keyword: Column, similarity: Column, threshold: float = 0.86) -> Column:
    near = F.coalesce(similarity >= threshold, F.lit(False))
    return F.when(same_keyword & near, "direct").when(same_keyword, "keyword").otherwise("overlap")

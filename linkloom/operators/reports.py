"""Reports over the link index: posts, links and clicks in, one DataFrame out.

Per-post counts are aggregated once and joined, never correlated per row; a missing count is 0.
`inbound` here counts link rows to a post (self-links, duplicates and links from drafts included);
the graph's degrees in operators.graph count distinct edges between published posts.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import scoring

TYPES = ("post", "page")


def published(posts: DataFrame, types=TYPES) -> DataFrame:
    return posts.where((F.col("status") == "publish") & F.col("type").isin(*types))


def _count(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name))


def internal(links: DataFrame) -> DataFrame:
    return links.where("type = 'internal'")


def with_counts(posts: DataFrame, links: DataFrame, clicks: DataFrame | None = None) -> DataFrame:
    """posts with outbound, inbound, external and clicks."""
    by = [_count(internal(links), "src", "outbound"), _count(internal(links), "target", "inbound"), _count(links.where("type = 'external'"), "src", "external")]
    by.append(_count(clicks, "target", "clicks") if clicks is not None else None)
    out = posts
    for c in by:
        if c is not None:
            out = out.join(c, "id", "left")
    return out.fillna(0, [c for c in ("outbound", "inbound", "external", "clicks") if c in out.columns])


#: Orders that the links report accepts; anything else is inbound.
ORDERS = {"title", "date", "inbound", "outbound", "external", "clicks"}


def links_report(posts: DataFrame, links: DataFrame, clicks: DataFrame, search: str = "", filter_: str = "all", orderby: str = "inbound", descending: bool = False,
                 page: int = 1, per_page: int = 25) -> tuple[DataFrame, DataFrame]:
    """(one page of rows, the count of all rows as a one-row table)."""
    rows = with_counts(published(posts), links, clicks)
    if search:
        rows = rows.where(F.lower("title").contains(search.lower()))
    if filter_ == "orphaned":
        rows = rows.where("inbound = 0")
    elif filter_ == "no_outbound":
        rows = rows.where("outbound = 0")
    elif filter_ == "money":
        rows = rows.where("money")
    key = F.col({"date": "taken"}.get(orderby, orderby) if orderby in ORDERS else "inbound")
    per_page, page = min(200, max(5, per_page)), max(1, page)
    ordered = rows.orderBy(key.desc() if descending else key.asc(), "title", "id").offset((page - 1) * per_page).limit(per_page)
    cols = ["id", "title", "type", "inbound", "outbound", "external", "clicks", "money"]
    return ordered.select(*cols), rows.agg(F.count("*").alias("total"))


def summary(posts: DataFrame, links: DataFrame) -> DataFrame:
    n = links.agg(F.count_if(F.col("type") == "internal").alias("internal"), F.count_if(F.col("type") == "external").alias("external"), F.count_if(is_broken(F.col("broken_type"))).alias("broken"))
    total = published(posts).agg(F.count("*").alias("total_posts"))
    return n.crossJoin(total).crossJoin(orphans(posts, links).agg(F.count("*").alias("orphaned")))  # one row each


def is_broken(kind: Column) -> Column:
    return ~kind.isin("", "redirect")


def post_rows(posts: DataFrame, links: DataFrame, clicks: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return with_counts(published(posts), links, clicks).orderBy("inbound", F.col("taken").desc(), "id").offset(offset).limit(limit).select("id", "title", "type", "outbound", "inbound", "clicks")


def orphans(posts: DataFrame, links: DataFrame) -> DataFrame:
    to = internal(links).select(F.col("target").alias("id"))
    return published(posts).join(to, "id", "left_anti")


def with_inbound(posts: DataFrame, links: DataFrame) -> DataFrame:
    return published(posts).join(internal(links).select(F.col("target").alias("id")), "id", "left_semi")


def with_outbound(posts: DataFrame, links: DataFrame) -> DataFrame:
    return published(posts).join(internal(links).select(F.col("src").alias("id")), "id", "left_semi")


def inbound_map(links: DataFrame) -> DataFrame:
    return internal(links).where("target > 0").groupBy("target").agg(F.count("*").alias("n"))


def adjacency(links: DataFrame) -> DataFrame:
    """target and the sorted list of its sources, duplicates kept."""
    return internal(links).where("target > 0").groupBy("target").agg(F.array_sort(F.collect_list("src")).alias("sources"))


def in_out_counts(links: DataFrame) -> DataFrame:
    """One pass each way, then summed: id, n_in, n_out, n_ext."""
    out = links.select(F.col("src").alias("id"), F.lit(0).alias("i"), (F.col("type") == "internal").cast("int").alias("o"), (F.col("type") == "external").cast("int").alias("e"))
    into = internal(links).where("target > 0").select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.lit(0).alias("e"))
    return out.unionByName(into).groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.sum("e").alias("n_ext"))


def domains(links: DataFrame) -> DataFrame:
    return links.where("type = 'external' and host <> ''").groupBy("host").agg(F.count("*").alias("links"), F.countDistinct("src").alias("posts"))


def titled(links: DataFrame, posts: DataFrame) -> DataFrame:
    """Links with their source's title, null where the post is gone."""
    return links.join(posts.select(F.col("id").alias("src"), "title"), "src", "left")


def click_report(clicks: DataFrame, days: int | None, asof: datetime) -> DataFrame:
    rows = clicks if days is None else clicks.where(F.col("ts") >= F.lit(asof) - F.expr(f"interval {int(days)} days"))
    return rows.groupBy("target", "anchor", "url").agg(F.count("*").alias("clicks"), F.countDistinct("post_id").alias("sources"))


def window_counts(clicks: DataFrame, asof: datetime, days: int = 30) -> DataFrame:
    """Clicks in the last `days` days and in the ones before."""
    age = lambda k: F.lit(asof) - F.expr(f"interval {k * days} days")
    return clicks.agg(F.count_if(F.col("ts") >= age(1)).alias("now"), F.count_if((F.col("ts") >= age(2)) & (F.col("ts") < age(1))).alias("prev"))


BROKEN = {"404": ("404", "missing"), "redirect": ("redirect",), "timeout": ("timeout", "error")}


def broken(links: DataFrame, posts: DataFrame, kind: str = "all") -> DataFrame:
    of = F.col("broken_type").isin(*BROKEN[kind]) if kind in BROKEN else F.col("broken_type") != ""
    return titled(links.where(of), posts)


def issue_counts(links: DataFrame) -> DataFrame:
    k = F.col("broken_type")
    known = [x for v in BROKEN.values() for x in v]
    return links.agg(*[F.count_if(k.isin(*v)).alias(f"n_{n}") for n, v in BROKEN.items()], F.count_if(~k.isin("", *known)).alias("n_other"), F.count_if(k != "").alias("total"))


def permanent_redirects(links: DataFrame) -> DataFrame:
    """Links that may be pointed at where they land: 301 and 308 with another, non-empty target."""
    return links.where("status_code in (301, 308) and redirects_to <> '' and redirects_to <> url")


def classify_probe(probes: DataFrame) -> DataFrame:
    """probes (url, kind, published, code, location, failure) with broken, status and broken_type.

    Anchors that aren't links are fine, empty ones are broken; internal links are judged by their target; the
    rest by what a probe answered. An absolute Location is given for redirects."""
    url, code = F.trim("url"), F.col("code")
    special = url.rlike("(?i)^(mailto:|tel:|javascript:|#)") & (url != "#")
    internal_ = F.col("kind") == "internal"
    kind = (F.when((url == "") | (url == "#"), "empty").when(special, "").when(internal_ & F.col("published"), "").when(internal_ & F.col("published").isNotNull(), "missing")
            .when(F.col("failure") == "timeout", "timeout").when(F.col("failure").isNotNull(), "error").when(code.between(300, 399), "redirect")
            .when(code.isin(404, 410), "404").when(code >= 500, "5xx").when(code >= 400, "4xx").otherwise(""))
    out = probes.withColumn("broken_type", kind)
    status = F.when(kind == "empty", 0).when(special, 0).when(internal_ & F.col("published"), 200).when(kind == "missing", 404).otherwise(F.coalesce(code, F.lit(0)))
    base = F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    loc = F.coalesce("location", F.lit(""))
    absolute = F.when(kind != "redirect", "").when(loc.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), loc).when(loc.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), loc)).when(loc == "", "").otherwise(
        F.concat(base, F.when(loc.startswith("/"), "").otherwise("/"), loc))
    return out.withColumns({"status": status, "broken": is_broken(F.col("broken_type")), "lands": absolute})


def money_pages(posts: DataFrame, links: DataFrame) -> DataFrame:
    """Money pages with their inbound links and badge, the most starved first."""
    rows = with_counts(published(posts).where("money"), links)
    return rows.withColumn("badge", F.when(F.col("inbound") == 0, "needs links").when(F.col("inbound") < 3, "under-linked").otherwise("healthy")).select("id", "title", "inbound", "badge")


def search_priority(gsc: DataFrame, posts: DataFrame, links: DataFrame) -> DataFrame:
    """Search rows with their post's inbound links; a priority has impressions but few links."""
    into = _count(internal(links), "target", "inbound").withColumnRenamed("id", "post_id")
    rows = gsc.join(into, "post_id", "left").fillna(0, ["inbound"]).join(posts.select(F.col("id").alias("post_id"), "title"), "post_id", "left")
    return rows.withColumn("is_priority", (F.col("impressions") >= 100) & (F.col("inbound") < 3))


def stats(posts: DataFrame, links: DataFrame, clicks: DataFrame, created: DataFrame, asof: datetime) -> DataFrame:
    """Dashboard figures as one row. created: insertion times (column ts)."""
    s = summary(posts, links)
    more = with_inbound(posts, links).agg(F.count("*").alias("linked_posts")).crossJoin(with_outbound(posts, links).agg(F.count("*").alias("with_outbound"))).crossJoin(links.agg(F.countDistinct("src").alias("crawled_")))
    c = window_counts(clicks, asof).toDF("clicks_30", "clicks_prev")
    m = insertions(created, asof, 30, 0).toDF("created_30").crossJoin(insertions(created, asof, 30, 30).toDF("created_prev"))
    one = s.crossJoin(more).crossJoin(c).crossJoin(m)
    pct = lambda a, b, d=0: F.when(b > 0, F.round(a * 100.0 / F.greatest(b, F.lit(1)), d)).otherwise(0.0)
    total, links_ = F.col("total_posts"), F.col("internal") + F.col("external")
    one = one.withColumns({"total_links": links_, "crawled": F.least("crawled_", total)}).drop("crawled_")
    return one.withColumns({
        "coverage": pct(F.col("linked_posts"), total, 1), "indexed_pct": pct(F.col("crawled"), total, 1), "internal_pct": pct(F.col("internal"), links_), "external_pct": pct(F.col("external"), links_),
        "time_saved": F.round(F.col("created_30") * 2 / 60, 1)})


def insertions(created: DataFrame, asof: datetime, days: int, offset: int) -> DataFrame:
    """Insertions in the half-open window (start, end] that ends `offset` days ago."""
    end = F.lit(asof) - F.expr(f"interval {offset} days")
    return created.where((F.col("ts") > end - F.expr(f"interval {days} days")) & (F.col("ts") <= end)).agg(F.count("*").alias("n"))


def with_scores(one: DataFrame) -> DataFrame:
    h = scoring.health(F.col("coverage"), F.col("orphaned"), F.col("total_posts"), F.col("broken"), F.col("total_links"))
    q = scoring.quality(F.col("internal"), F.col("with_outbound"), F.col("total_posts"))
    return one.withColumns({"health": h, "quality": q})


def recommendations(one: DataFrame) -> DataFrame:
    """(place, title, impact) that apply to the dashboard's row, in order."""
    row = lambda p, t, i, when: F.struct(F.lit(p).alias("place"), F.lit(t).alias("title"), i.alias("impact"), when.alias("ok"))
    high, none = F.lit("high"), F.col("total_links") == 0
    list_ = F.array(row(0, "Run your first scan", high, none), row(1, "Orphaned Posts", high, ~none & (F.col("orphaned") > 0)), row(2, "Broken Links", high, ~none & (F.col("broken") > 0)),
                    row(3, "Link Coverage", F.when(F.col("coverage") < 50, "high").otherwise("medium"), ~none & (F.col("coverage") < 85)))
    return one.select(F.explode(list_).alias("r")).where("r.ok").select("r.place", "r.title", "r.impact")


def setup_steps(one: DataFrame) -> DataFrame:
    """Checklist rows (step, done, optional) from the state of the site."""
    row = lambda s, d, o=False: F.struct(F.lit(s).alias("step"), d.alias("done"), F.lit(o).alias("optional"))
    return one.select(F.explode(F.array(row("scan", F.col("total_links") > 0), row("orphans", F.col("orphaned") == 0), row("insert", F.col("created_30") + F.col("created_prev") > 0), row("clicks", F.col("clicks_30") > 0, True))).alias("r")).select("r.*")


def setup_complete(steps: DataFrame) -> DataFrame:
    return steps.agg(F.bool_and(F.col("done") | F.col("optional")).alias("complete"))


def greeting(ts: Column) -> Column:
    return F.when(F.hour(ts) < 12, "Good morning").when(F.hour(ts) < 18, "Good afternoon").otherwise("Good evening")


#: Features in the order in which a dashboard offers them.
FEATURES = ["Click Tracking", "AI Suggestions", "Auto-Linking", "Money Pages", "Search Console Priorities"]


def unused_features(tracks_clicks: bool, has_ai: bool, rules: DataFrame, posts: DataFrame, search: DataFrame) -> DataFrame:
    """(place, feature): what the site does not use yet. rules: active; posts: money; search: any rows."""
    some = lambda df, c, name: df.agg(F.coalesce(F.bool_or(c), F.lit(False)).alias(name))
    flags = some(rules, F.col("active"), "rules").crossJoin(some(posts, F.col("money"), "money")).crossJoin(some(search, F.lit(True), "search"))  # one row each
    used = [F.lit(tracks_clicks), F.lit(has_ai), F.col("rules"), F.col("money"), F.col("search")]
    rows = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(f).alias("feature"), u.alias("used")) for k, (f, u) in enumerate(zip(FEATURES, used))])
    return flags.select(F.explode(rows).alias("x")).where("not x.used").select("x.place", "x.feature")


def fix_candidates(broken_links: DataFrame, posts: DataFrame, url_changes: DataFrame, weak: set[str], limit: int = 6) -> DataFrame:
    """(src, url, tier, fix, title, rank): for each broken link a recorded rename, where it lands, a post
    with the same slug, and posts whose title holds the anchor, best tier first.

    Titles are searched through their words: a title that holds the anchor holds its longest telling word, so
    the join is on that word and the whole anchor is compared only on what it meets."""
    from linkloom.functions import text

    b = broken_links.select("src", "url", "anchor", "redirects_to").distinct()
    pub = published(posts).select(F.col("id").alias("pid"), "title", "slug", F.concat(F.lit("https://example.test/p/"), F.col("id").cast("string")).alias("link"))
    t1 = b.join(url_changes.select(F.col("old_url").alias("url"), F.col("new_url").alias("fix")), "url").withColumns({"tier": F.lit(1), "title": F.col("fix")})
    t2 = b.where("redirects_to <> '' and rtrim('/', redirects_to) <> rtrim('/', url)").withColumns({"tier": F.lit(2), "fix": F.col("redirects_to"), "title": F.col("redirects_to")})
    slug = F.element_at(F.split(F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]*", ""), r"^/+|/+$", ""), "/"), -1)
    t3 = b.withColumn("s", slug).where("s <> ''").join(pub, F.col("s") == F.col("slug")).withColumns({"tier": F.lit(3), "fix": F.col("link")})
    telling = F.filter(F.split(F.lower("anchor"), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*sorted(weak)))
    key = F.array_max(F.transform(telling, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    words = pub.withColumn("w", F.explode(F.array_distinct(F.split(F.lower("title"), r"[^\p{L}\p{N}]+"))))
    t4 = b.withColumn("w", key).where("w is not null").join(words, "w").where((F.col("pid") != F.col("src")) & F.contains(F.lower("title"), F.lower(F.trim("anchor")))).withColumns({"tier": F.lit(4), "fix": F.col("link")})
    from pyspark.sql import Window as W

    t4 = t4.withColumn("n", F.row_number().over(W.partitionBy("src", "url", "anchor").orderBy("pid"))).where("n <= 4")
    cols = ["src", "url", "tier", "fix", "title"]
    rows = t1.select(*cols).unionByName(t2.select(*cols)).unionByName(t3.select(*cols)).unionByName(t4.select(*cols))
    one = rows.groupBy("src", "url", "fix").agg(F.min(F.struct("tier", "title")).alias("x")).select("src", "url", "fix", "x.tier", "x.title")
    rank = F.row_number().over(W.partitionBy("src", "url").orderBy("tier", "fix"))
    return one.withColumn("rank", rank).where(F.col("rank") <= limit)

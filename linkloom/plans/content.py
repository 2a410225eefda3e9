"""Queries over page contents: links, anchors, placement, text functions; and the link graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import scoring, text
from linkloom.functions.words import GENERIC_ANCHORS
from linkloom.operators import anchors as A
from linkloom.operators import graph as G
from linkloom.operators import links as L
from linkloom.sources.site import site, site_sql, table

from .base import Plans

plans = Plans()

HREF = r"""<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>"""
PAGE_LINKS = rf"""with l as (select page_id, unnest(regexp_extract_all(html, '(?is){HREF}', 1)) url, unnest(regexp_extract_all(html, '(?is){HREF}', 2)) anchor, unnest(range(len(regexp_extract_all(html, '(?is){HREF}')))) n, url page from pages),
 i as (select page_id src, n, replace(url, '&amp;', '&') url, trim(regexp_replace(anchor, '<[^>]*>', '', 'g')) anchor, regexp_replace(lower(regexp_extract(page, '://([^/?#:]*)', 1)), '^www\.', '') own, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\.', '') host from l) """


def _pages(s, d):
    return table(s, d, "pages").withColumn("id", F.col("page_id"))


@plans.add("page_links", PAGE_LINKS + "select src, n, url, anchor, host, case when host in ('', own) then 'internal' else 'external' end type from i")
def page_links(s, d):
    return L.build_index(_pages(s, d)).select("src", F.col("n").cast("long").alias("n"), "url", "anchor", "host", "type")


@plans.add("page_link_counts", PAGE_LINKS + "select own host, count(distinct src) pages, count(*) links, count(distinct url) paths from i group by own")
def page_link_counts(s, d):
    rows = L.build_index(_pages(s, d)).join(_pages(s, d).select(F.col("id").alias("src"), text.host_of(F.col("url")).alias("own")), "src")
    return rows.groupBy(F.col("own").alias("host")).agg(F.countDistinct("src").alias("pages"), F.count("*").alias("links"), F.countDistinct("url").alias("paths"))


@plans.add("internal_external_split", PAGE_LINKS + "select case when host in ('', own) then 'internal' else 'external' end type, count(*) n from i group by 1")
def internal_external_split(s, d):
    return L.build_index(_pages(s, d)).groupBy("type").agg(F.count("*").alias("n"))


@plans.add("resolved_links", site_sql("links") + "select target, count(*) n from links where type = 'internal' group by target")
def resolved_links(s, d):
    posts = site(s, d, "posts").withColumn("link", F.concat(F.lit("https://WWW.example.test/p/"), F.col("id").cast("string"), F.lit("/")))
    rows = L.resolve(site(s, d, "links").drop("target"), posts, "example.test")
    return rows.where("type = 'internal'").groupBy("target").agg(F.count("*").alias("n"))


BARE = r"regexp_replace(regexp_replace(html, '(?is)<script[^>]*?>.*?</script>|<style[^>]*?>.*?</style>', '', 'g'), '(?s)<[^>]*>', '', 'g')"


def _decoded(x):
    for name, char in text.ENTITIES:
        x = f"replace({x}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


def _flat(x):
    return f"trim(regexp_replace({_decoded(f'trim({x})')}, '[\\s\\x{{00A0}}]+', ' ', 'g'), ' ')"


@plans.add("plain_text", f"select page_id, md5({_flat(BARE)}) digest, length({_flat(BARE)}) n from pages")
def plain_text(s, d):
    t = text.plain_text(F.col("html"))
    return table(s, d, "pages").select("page_id", F.md5(t).alias("digest"), F.length(t).cast("long").alias("n"))


@plans.add("linkable_text", f"select page_id, md5({_flat(BARE.replace('html', 'h'))}) digest from (select page_id, regexp_replace(html, '(?is)<a\\b[^>]*>.*?</a>', ' ', 'g') h from pages)")
def linkable_text(s, d):
    return table(s, d, "pages").select("page_id", F.md5(text.linkable_text(F.col("html"))).alias("digest"))


@plans.add("sentence_context", r"""select doc_id, case when p = 0 then concat(substr(t, 1, 160), '…') when s is not null and length(s) <= 320 then s
 else concat(case when p > 81 then '…' else '' end, trim(substr(t, greatest(0, p - 81) + 1, 163)), '…') end context
 from (select doc_id, t, strpos(lower(t), 'the') p, trim(list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: contains(lower(x), 'the'))[1]) s from (select doc_id, trim(text) t from documents))""")
def sentence_context(s, d):
    return table(s, d, "documents").select("doc_id", text.sentence_containing(F.col("text"), F.lit("the")).alias("context"))


@plans.add("title_from_url", r"""select page_id, case when w = '' then regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\.', '') else array_to_string(list_transform(string_split(w, ' '), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), ' ') end title
 from (select page_id, url, trim(url_decode(regexp_replace(regexp_replace(list_extract(string_split(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '^/+|/+$', '', 'g'), '/'), -1), '(?i)\.(html?|php|aspx?)$', ''), '[-_]+', ' ', 'g'))) w from pages)""")
def title_from_url(s, d):
    return table(s, d, "pages").select("page_id", text.title_from_url(F.col("url")).alias("title"))


@plans.add("url_key", site_sql("gsc") + "select post_id, regexp_replace(lower(trim(url)), '/+$', '') url_key, md5(regexp_replace(lower(trim(url)), '/+$', '')) url_hash from gsc")
def url_key(s, d):
    return site(s, d, "gsc").select("post_id", text.url_key(F.col("url")).alias("url_key"), text.url_hash(F.col("url")).alias("url_hash"))


NORM = r"lower(trim(trim(regexp_replace(anchor, '\s+', ' ', 'g')), ' .,;:!?\"''“”‘’()[]'))".replace('\\"', '"')
KEYED = f", k as (select *, {NORM} norm, case when target > 0 then concat('p', target) else concat('u', md5(url)) end goal from links where type = 'internal' and {NORM} <> '') "
GENERIC = ", ".join(f"'{g}'" for g in GENERIC_ANCHORS)
ANCHORS = site_sql("links").rstrip() + KEYED + f""", r as (select norm, uses, targets, sources, norm in ({GENERIC}) generic, targets > 1 ambiguous, most >= 10 repetitive from
 (select norm, cast(sum(n) as bigint) uses, count(*) targets, max(n) most from (select norm, goal, count(*) n from k group by all) group by norm) join (select norm, count(distinct src) sources from k group by norm) using (norm)) """


@plans.add("anchor_groups", ANCHORS + "select * from r")
def anchor_groups(s, d):
    return A.report(site(s, d, "links"))


@plans.add("anchor_targets", ANCHORS + "select norm, goal, count(*) uses, max(target) target, min(url) url from k group by norm, goal")
def anchor_targets(s, d):
    return A.targets(site(s, d, "links"))


@plans.add("anchor_generic", ANCHORS + "select norm, uses from r where generic")
def anchor_generic(s, d):
    return A.report(site(s, d, "links")).where("generic").select("norm", "uses")


@plans.add("anchor_counts", ANCHORS + "select count(*) anchors, cast(sum(uses) as bigint) links, count(*) filter (where generic) n_generic, count(*) filter (where ambiguous) n_ambiguous, count(*) filter (where repetitive) n_repetitive from r")
def anchor_counts(s, d):
    return A.counts(A.report(site(s, d, "links")))


@plans.add("single_anchor_targets", site_sql("links") + f"select target, count(*) inbound, count(distinct nullif({NORM}, '')) forms, max({NORM}) anchor from links where type = 'internal' and target > 0 group by target having count(*) >= 2 and count(distinct nullif({NORM}, '')) <= 1")
def single_anchor_targets(s, d):
    return A.single_anchor_targets(site(s, d, "links"), 2)


@plans.add("anchor_usages", site_sql("links", "posts").rstrip() + KEYED + "select src, a.title src_title, target, b.title target_title, url, anchor from k left join posts a on a.id = src left join posts b on b.id = target where norm = 'topic 7'")
def anchor_usages(s, d):
    return A.usages(site(s, d, "links"), site(s, d, "posts"), " Topic 7!")


@plans.add("link_positions", None)
def link_positions(s, d):
    return L.positions(_pages(s, d))


@plans.add("placement_summary", None)
def placement_summary(s, d):
    return L.placement(L.positions(_pages(s, d)), _pages(s, d)).drop("spots")


NODES = site_sql("posts", "links").rstrip() + """, pub as (select * from posts where status = 'publish' and type in ('post', 'page')), e as (select distinct src, target dst from links where links.type = 'internal' and target > 0 and src <> target and src in (select id from pub) and target in (select id from pub)) """


@plans.add("edges", NODES + "select src, dst from e")
def edges(s, d):
    return G.graph(site(s, d, "posts"), site(s, d, "links"))[1]


DEGREES = "select id, coalesce(o, 0) outbound, coalesce(i, 0) inbound from pub left join (select src id, count(*) o from e group by src) using (id) left join (select dst id, count(*) i from e group by dst) using (id)"


@plans.add("degrees", NODES + DEGREES)
def degrees(s, d):
    return G.degrees(*G.graph(site(s, d, "posts"), site(s, d, "links")))


def _rank_sql(rounds):
    out = ", deg as materialized (select id, coalesce(n, 0) od from pub left join (select src id, count(*) n from e group by src) using (id)), r0 as materialized (select id, od, 1.0::double / (select count(*) from deg) r from deg)"
    for k in range(1, rounds + 1):
        p = f"r{k - 1}"
        out += f""", r{k} as materialized (select {p}.id, {p}.od, 0.15 / (select count(*) from deg) + 0.85 * (select coalesce(sum(r), 0) from {p} where od = 0) / (select count(*) from deg) + 0.85 * coalesce(g, 0) r
 from {p} left join (select dst id, sum({p}.r / {p}.od) g from e join {p} on e.src = {p}.id group by dst) x on x.id = {p}.id)"""
    return out


RANKS = NODES + _rank_sql(10)


@plans.add("pagerank_k10", RANKS + " select id, round(r * 1e6, 4) micro from r10")
def pagerank_k10(s, d):
    return G.pagerank(*G.graph(site(s, d, "posts"), site(s, d, "links")), rounds=10, epsilon=None).select("id", F.round(F.col("rank") * 1e6, 4).alias("micro"))


SEEDS = ", seed as (select id from pub where type = 'post' order by taken desc, id limit 10)"
BFS = NODES.replace("with ", "with recursive ", 1) + SEEDS + ", walk(id, depth) as (select id, 0 from seed union select dst, depth + 1 from walk join e on src = id where depth < 40), dep as (select id, min(depth) depth from walk group by id) "


@plans.add("bfs_depth", BFS + "select id, depth from dep")
def bfs_depth(s, d):
    posts = site(s, d, "posts")
    nodes, e = G.graph(posts, site(s, d, "links"))
    return G.depths(e, G.seeds(posts, nodes))


EQUITY = BFS.rstrip() + _rank_sql(10) + f""", eq as (select id, title, r * n relative, depth, inbound, outbound, id in (select id from seed) is_seed, least(1.0, greatest(0.0, (1 - r * n) / 0.75)) need
 from r10 join ({DEGREES}) using (id) left join dep using (id) join posts using (id), (select count(*) n from deg)) """


def _equity(s, d):
    return G.equity(site(s, d, "posts"), site(s, d, "links"), rounds=10, epsilon=None)


@plans.add("equity_report", EQUITY + "select id, title, round(relative, 4) relative, depth, inbound, outbound, is_seed, round(need, 4) need from eq")
def equity_report(s, d):
    return _equity(s, d).select("id", "title", F.round("relative", 4).alias("relative"), "depth", "inbound", "outbound", "is_seed", F.round("need", 4).alias("need"))


@plans.add("equity_starved", EQUITY + "select id from eq where relative < 0.5 order by round(relative, 8), id limit 25")
def equity_starved(s, d):
    return _equity(s, d).where("relative < 0.5").orderBy(F.round("relative", 8), "id").limit(25).select("id")


@plans.add("equity_buried", EQUITY + "select id, depth from eq where depth > 3 order by depth desc, id limit 25")
def equity_buried(s, d):
    return G.view(_equity(s, d), "buried").select("id", "depth")


@plans.add("equity_unreachable", EQUITY + "select id from eq where depth is null")
def equity_unreachable(s, d):
    return G.view(_equity(s, d), "unreachable").select("id")


@plans.add("equity_stats", EQUITY + "select count(*) posts, count(*) filter (where depth is null) unreachable, count(*) filter (where depth > 3) deep, round(avg(depth), 6) avg_depth, max(depth) max_depth, count(*) filter (where relative < 0.5) starved, count(*) filter (where is_seed) seeds from eq")
def equity_stats(s, d):
    return G.equity_stats(_equity(s, d)).withColumn("avg_depth", F.round("avg_depth", 6))


@plans.add("equity_converged", None)
def equity_converged(s, d):
    """Ranks with the reference tolerance and round limit."""
    return G.pagerank(*G.graph(site(s, d, "posts"), site(s, d, "links")))


IMPACT = """demand as (select *, case when impressions >= 10 and position > 0 then (case when position < 10.5 then 0.25 when position <= 20.5 then 1 - (position - 10.5) / 10 * 0.35 else greatest(0, 0.55 - (position - 20.5) / 30 * 0.55) end)
 * (0.4 + 0.6 * least(1, log10(greatest(10, impressions)) / 4)) end demand from gsc) """


@plans.add("demand_score", site_sql("gsc").rstrip() + ", " + IMPACT + "select post_id, round(demand, 6) demand from demand")
def demand_score(s, d):
    return site(s, d, "gsc").select("post_id", F.round(scoring.demand(F.col("impressions"), F.col("position")), 6).alias("demand"))


@plans.add("striking_distance", site_sql("gsc", "posts", "links") + """select post_id, impressions, round(position, 4) position, coalesce(n, 0) inbound from gsc join posts on id = post_id left join (select target, count(*) n from links where links.type = 'internal' group by target) on target = post_id
 where position between 10.5 and 20.5 and impressions >= 10 and title <> '' order by inbound, impressions desc, post_id limit 100""")
def striking_distance(s, d):
    into = site(s, d, "links").where("type = 'internal'").groupBy(F.col("target").alias("post_id")).agg(F.count("*").alias("inbound"))
    rows = site(s, d, "gsc").where(F.col("position").between(*scoring.STRIKING) & (F.col("impressions") >= scoring.MIN_IMPRESSIONS)).join(site(s, d, "posts").where("title <> ''").select(F.col("id").alias("post_id")), "post_id")
    rows = rows.join(into, "post_id", "left").fillna(0, ["inbound"])
    return rows.orderBy("inbound", F.col("impressions").desc(), "post_id").limit(100).select("post_id", "impressions", F.round("position", 4).alias("position"), "inbound")


SCORES = site_sql("gsc", "posts").rstrip() + ", " + IMPACT.rstrip() + """, m as (select id, demand, (id * 37 % 71 + 30) / 100.0::double rel, (id * 13 % 11) / 10.0::double need from posts left join demand on post_id = id),
 sc as (select id, cast(round(rel * 100) as int) "match", least(1, greatest(0, case when demand is null then (0.6 * rel + 0.25 * need) / 0.85 else 0.6 * rel + 0.25 * need + 0.15 * demand end)) score from m) """


def _impact(s, d):
    g = site(s, d, "gsc").select(F.col("post_id").alias("id"), scoring.demand(F.col("impressions"), F.col("position")).alias("demand"))
    m = site(s, d, "posts").join(g, "id", "left").withColumns({"rel": (F.col("id") * 37 % 71 + 30) / F.lit(100.0), "need": (F.col("id") * 13 % 11) / F.lit(10.0)})
    return m.select("id", F.round(F.col("rel") * 100).cast("int").alias("match"), scoring.impact(F.col("rel"), F.col("need"), F.col("demand")).alias("score"))


@plans.add("impact_score", SCORES + 'select id, "match", round(score, 6) score from sc')
def impact_score(s, d):
    return _impact(s, d).withColumn("score", F.round("score", 6))


@plans.add("impact_rank", SCORES + 'select id, rank from (select id, row_number() over (order by round(score, 4) desc, "match" desc, id) rank from sc) where rank <= 50')
def impact_rank(s, d):
    """The best 50 by impact; a global top-k, so the rank is given to the rows that a limit left."""
    from pyspark.sql import Window as W

    order = [F.round("score", 4).desc(), F.col("match").desc(), F.col("id").asc()]
    return _impact(s, d).orderBy(*order).limit(50).withColumn("rank", F.row_number().over(W.orderBy(*order))).select("id", "rank")


@plans.add("link_need", EQUITY + "select id, round(need, 4) need, round(round(0.6 * (1 + 0.15 * need) * 10, 4), 2) score from eq")
def link_need(s, d):
    return _equity(s, d).select("id", F.round("need", 4).alias("need"), F.round(F.round(scoring.priority(F.lit(0.6), F.col("need")) * 10, 4), 2).alias("score"))

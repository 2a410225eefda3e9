"""Queries over the link index."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from linkloom.functions import scoring
from linkloom.operators import reports as R
from linkloom.sources.site import site, site_sql

from .base import Plans

plans = Plans()
ASOF = datetime(2024, 1, 31)
PUB = "pub as (select * from posts where status = 'publish' and type in ('post', 'page')), "
COUNTS = """o as (select src id, count(*) n from links where type = 'internal' group by src), i as (select target id, count(*) n from links where type = 'internal' group by target),
 e as (select src id, count(*) n from links where type = 'external' group by src), c as (select target id, count(*) n from clicks group by target),
 counted as (select pub.*, coalesce(o.n, 0) outbound, coalesce(i.n, 0) inbound, coalesce(e.n, 0) as "external", coalesce(c.n, 0) clicks
   from pub left join o using (id) left join i using (id) left join e using (id) left join c using (id)) """
PLC = ("posts", "links", "clicks")


def _sql(names, body, pub=True, counts=False):
    return site_sql(*names).rstrip() + (", " + PUB.rstrip(", ") if pub else "") + (", " + COUNTS if counts else " ") + body


def _plc(s, d):
    return [site(s, d, n) for n in PLC]


@plans.add("site_summary", _sql(("posts", "links"), """select (select count(*) from links where type = 'internal') internal, (select count(*) from links where type = 'external') as "external",
 (select count(*) from links where broken_type not in ('', 'redirect')) broken, (select count(*) from pub) total_posts,
 (select count(*) from pub where not exists (select 1 from links where target = pub.id and links.type = 'internal')) orphaned"""))
def site_summary(s, d):
    return R.summary(site(s, d, "posts"), site(s, d, "links"))


def _report(name, sql_where, sql_order, **kw):
    cols = 'id, title, type, inbound, outbound, "external", clicks, money'

    @plans.add(name, _sql(PLC, f"select {cols} from counted where {sql_where} order by {sql_order}", counts=True))
    def q(s, d):
        return R.links_report(*_plc(s, d), **kw)[0]


_report("links_report", "true", "inbound, title, id limit 25")
_report("links_report_orphaned", "inbound = 0", "title, id limit 50", filter_="orphaned", orderby="title", per_page=50)
_report("links_report_no_outbound", "outbound = 0", "clicks desc, title, id limit 50", filter_="no_outbound", orderby="clicks", descending=True, per_page=50)
_report("links_report_money", "money", "outbound desc, title, id limit 200", filter_="money", orderby="outbound", descending=True, per_page=500)
_report("links_report_search_page2", "contains(lower(title), 'red')", "taken desc, title, id limit 20 offset 20", search="RED", orderby="date", descending=True, page=2, per_page=20)


@plans.add("links_report_total", _sql(PLC, "select count(*) total from counted where contains(lower(title), 'red')", counts=True))
def links_report_total(s, d):
    return R.links_report(*_plc(s, d), search="red")[1]


@plans.add("post_rows", _sql(PLC, "select id, title, type, outbound, inbound, clicks from counted order by inbound, taken desc, id limit 100", counts=True))
def post_rows(s, d):
    return R.post_rows(*_plc(s, d))


@plans.add("orphan_posts", _sql(("posts", "links"), "select id, title, cast(taken as varchar) taken from pub where not exists (select 1 from links where target = pub.id and links.type = 'internal')"))
def orphan_posts(s, d):
    return R.orphans(site(s, d, "posts"), site(s, d, "links")).select("id", "title", F.col("taken").cast("string").alias("taken"))


@plans.add("posts_with_inbound", _sql(("posts", "links"), "select id from pub where exists (select 1 from links where target = pub.id and links.type = 'internal')"))
def posts_with_inbound(s, d):
    return R.with_inbound(site(s, d, "posts"), site(s, d, "links")).select("id")


@plans.add("posts_with_outbound", _sql(("posts", "links"), "select id from pub where exists (select 1 from links where src = pub.id and links.type = 'internal')"))
def posts_with_outbound(s, d):
    return R.with_outbound(site(s, d, "posts"), site(s, d, "links")).select("id")


@plans.add("inbound_counts", _sql(PLC, 'select id, outbound, inbound, "external", clicks from counted', counts=True))
def inbound_counts(s, d):
    p, k, c = _plc(s, d)
    return R.with_counts(R.published(p), k, c).select("id", "outbound", "inbound", "external", "clicks")


@plans.add("inbound_map", _sql(("links",), "select target, count(*) n from links where type = 'internal' and target > 0 group by target", pub=False))
def inbound_map(s, d):
    return R.inbound_map(site(s, d, "links"))


@plans.add("adjacency_sources", _sql(("links",), "select target, array_to_string(list_sort(list(src)), ',') sources from links where type = 'internal' and target > 0 group by target", pub=False))
def adjacency_sources(s, d):
    return R.adjacency(site(s, d, "links")).select("target", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"))


@plans.add("link_counts_union_all", _sql(("links",), """select id, cast(sum(i) as bigint) n_in, cast(sum(o) as bigint) n_out, cast(sum(e) as bigint) n_ext from (
 select src id, 0 i, case when type = 'internal' then 1 else 0 end o, case when type = 'external' then 1 else 0 end e from links
 union all select target, 1, 0, 0 from links where type = 'internal' and target > 0) group by id""", pub=False))
def link_counts_union_all(s, d):
    return R.in_out_counts(site(s, d, "links"))


@plans.add("domain_report", _sql(("links",), "select host, count(*) links, count(distinct src) posts from links where type = 'external' and host <> '' group by host", pub=False))
def domain_report(s, d):
    return R.domains(site(s, d, "links"))


@plans.add("domain_detail", _sql(("links", "posts"), "select src, url, anchor, title from links left join posts on src = id where host = 'site7.example'", pub=False))
def domain_detail(s, d):
    return R.titled(site(s, d, "links").where("host = 'site7.example'"), site(s, d, "posts")).select("src", "url", "anchor", "title")


@plans.add("links_for_post_inbound", _sql(("links", "posts"), "select src, target, anchor, title from links left join posts on src = id where target = 42 and links.type = 'internal'", pub=False))
def links_for_post_inbound(s, d):
    return R.titled(R.internal(site(s, d, "links")).where("target = 42"), site(s, d, "posts")).select("src", "target", "anchor", "title")


def _clicks(name, days):
    cut = "" if days is None else f"where ts >= timestamp '2024-01-31' - interval {days} days"

    @plans.add(name, _sql(("clicks",), f"select target, anchor, url, count(*) clicks, count(distinct post_id) sources from clicks {cut} group by all", pub=False))
    def q(s, d):
        return R.click_report(site(s, d, "clicks"), days, ASOF)


_clicks("click_report_7", 7)
_clicks("click_report_30", 30)
_clicks("click_report_all", None)


@plans.add("clicks_now_vs_prev", _sql(("clicks",), """select *, cast(case when prev > 0 then round((now - prev) * 100.0 / prev) when now > 0 then 100 else 0 end as int) pct from (
 select count(*) filter (where ts >= timestamp '2024-01-31' - interval 15 days) now, count(*) filter (where ts >= timestamp '2024-01-31' - interval 30 days and ts < timestamp '2024-01-31' - interval 15 days) prev from clicks)""", pub=False))
def clicks_now_vs_prev(s, d):
    return R.window_counts(site(s, d, "clicks"), ASOF, 15).withColumn("pct", scoring.delta_pct(F.col("now"), F.col("prev")))


def _broken(name, kind, where):
    @plans.add(name, _sql(("links", "posts"), f"select src, url, anchor, broken_type, status_code, title from links left join posts on src = id where {where}", pub=False))
    def q(s, d):
        return R.broken(site(s, d, "links"), site(s, d, "posts"), kind).select("src", "url", "anchor", "broken_type", "status_code", "title")


_broken("broken_rows_all", "all", "broken_type <> ''")
_broken("broken_rows_404", "404", "broken_type in ('404', 'missing')")
_broken("broken_rows_timeout", "timeout", "broken_type in ('timeout', 'error')")
_broken("broken_rows_redirect", "redirect", "broken_type = 'redirect'")


@plans.add("issue_counts", _sql(("links",), """select count(*) filter (where broken_type in ('404', 'missing')) n_404, count(*) filter (where broken_type = 'redirect') n_redirect,
 count(*) filter (where broken_type in ('timeout', 'error')) n_timeout, count(*) filter (where broken_type = '5xx') n_other, count(*) filter (where broken_type <> '') total from links""", pub=False))
def issue_counts(s, d):
    return R.issue_counts(site(s, d, "links"))


@plans.add("permanent_redirects", _sql(("links",), "select src, url, redirects_to from links where status_code in (301, 308) and redirects_to <> '' and redirects_to <> url", pub=False))
def permanent_redirects(s, d):
    return R.permanent_redirects(site(s, d, "links")).select("src", "url", "redirects_to")


PROBES = """probes as (select o_orderkey id, case o_orderkey % 7 when 0 then '#' when 1 then 'mailto:a@b.example' when 2 then ' ' else concat('https://h', o_custkey, '.example/a') end url,
 case when o_orderkey % 7 = 3 then 'internal' else 'external' end kind, case when o_orderkey % 7 = 3 then o_custkey % 3 > 0 end published,
 case o_custkey % 6 when 0 then 200 when 1 then 301 when 2 then 404 when 3 then 410 when 4 then 503 else 403 end code, case o_orderkey % 3 when 0 then '/moved' when 1 then 'https://z.example/q' end location,
 case o_orderkey % 29 when 0 then 'timeout' when 1 then 'dns' end failure from {orders})"""


@plans.add("http_classify", "with " + PROBES.format(orders="orders") + """ select id, broken_type, status, broken_type not in ('', 'redirect') broken,
 case when broken_type <> 'redirect' or location is null then '' when location like 'https:%' then location else concat('https://h', regexp_extract(url, 'h([0-9]+)', 1), '.example', location) end lands
 from (select *, case when trim(url) in ('', '#') or url like 'mailto:%' then 0 when kind = 'internal' then case when published then 200 else 404 end else code end status,
  case when trim(url) in ('', '#') then 'empty' when url like 'mailto:%' then '' when kind = 'internal' then case when published then '' else 'missing' end
  when failure = 'timeout' then 'timeout' when failure is not null then 'error' when code = 301 then 'redirect' when code in (404, 410) then '404' when code = 503 then '5xx' when code = 403 then '4xx' else '' end broken_type from probes)""")
def http_classify(s, d):
    orders = s.read.parquet(f"{d}/orders.parquet")
    return R.classify_probe(s.sql("with " + PROBES + " select * from probes", orders=orders)).select("id", "broken_type", F.col("status").cast("int").alias("status"), "broken", "lands")


@plans.add("money_pages", _sql(("posts", "links", "clicks"), "select id, title, inbound, case when inbound = 0 then 'needs links' when inbound < 3 then 'under-linked' else 'healthy' end badge from counted where money", counts=True))
def money_pages(s, d):
    return R.money_pages(site(s, d, "posts"), site(s, d, "links"))


@plans.add("gsc_priority", _sql(("posts", "links", "gsc"), """select post_id, impressions, inbound, title, impressions >= 100 and inbound < 3 is_priority from (
 select gsc.*, coalesce(n, 0) inbound, title from gsc left join (select target, count(*) n from links where type = 'internal' group by target) on target = post_id left join posts on id = post_id)""", pub=False))
def gsc_priority(s, d):
    return R.search_priority(site(s, d, "gsc"), site(s, d, "posts"), site(s, d, "links")).select("post_id", "impressions", "inbound", "title", "is_priority")


STATS = """, k as (select (select count(*) from pub) total_posts, (select count(*) from links where type = 'internal') internal, (select count(*) from links where type = 'external') as "external",
 (select count(*) from links where broken_type not in ('', 'redirect')) broken, (select count(distinct src) from links) srcs,
 (select count(*) from pub where exists (select 1 from links where target = pub.id and links.type = 'internal')) linked_posts,
 (select count(*) from pub where exists (select 1 from links where src = pub.id and links.type = 'internal')) with_outbound,
 (select count(*) from clicks where ts >= timestamp '2024-01-01') clicks_30, (select count(*) from clicks where ts >= timestamp '2023-12-02' and ts < timestamp '2024-01-01') clicks_prev,
 (select count(*) from clicks where target % 10 = 0 and ts > timestamp '2024-01-01' and ts <= timestamp '2024-01-31') created_30,
 (select count(*) from clicks where target % 10 = 0 and ts > timestamp '2023-12-02' and ts <= timestamp '2024-01-01') created_prev),
 st as (select internal, "external", broken, total_posts, total_posts - linked_posts orphaned, linked_posts, with_outbound, clicks_30, clicks_prev, created_30, created_prev, internal + "external" total_links,
 least(srcs, total_posts) crawled, round(linked_posts * 100.0 / total_posts, 1) coverage, round(least(srcs, total_posts) * 100.0 / total_posts, 1) indexed_pct,
 round(internal * 100.0 / (internal + "external")) internal_pct, round("external" * 100.0 / (internal + "external")) external_pct, round(created_30 * 2 / 60, 1) time_saved from k) """


def _stats(s, d):
    p, k, c = _plc(s, d)
    return R.stats(p, k, c, c.where("target % 10 = 0").select("ts"), ASOF)


@plans.add("dashboard_stats", _sql(PLC, "select * from st").replace(" select * from st", STATS + "select * from st"))
def dashboard_stats(s, d):
    return _stats(s, d)


SCORED = STATS + """, sc as (select *, cast(round(coverage * 0.6 + (1 - orphaned / total_posts) * 25 + (1 - broken / total_links) * 15) as int) health,
 round((least(1, internal / total_posts / 3) * 0.6 + with_outbound / total_posts * 0.4) * 10, 1) quality from st) """


@plans.add("health_score", _sql(PLC, "@").replace("@", SCORED + "select health, case when health >= 85 then 'Excellent' when health >= 70 then 'Good' when health >= 50 then 'Needs Work' else 'Poor' end label, case when health >= 70 then 'good' when health >= 50 then 'warn' else 'bad' end level from sc"))
def health_score(s, d):
    return R.with_scores(_stats(s, d)).select("health", scoring.band(F.col("health")).alias("label"), scoring.band_level(F.col("health")).alias("level"))


@plans.add("quality_score", _sql(PLC, "@").replace("@", SCORED + "select quality from sc"))
def quality_score(s, d):
    return R.with_scores(_stats(s, d)).select("quality")


@plans.add("score_bands", "select p_partkey, case when p_size * 2 >= 85 then 'Excellent' when p_size * 2 >= 70 then 'Good' when p_size * 2 >= 50 then 'Needs Work' else 'Poor' end label from part")
def score_bands(s, d):
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", scoring.band(F.col("p_size") * 2).alias("label"))


@plans.add("recommendations", _sql(PLC, "@").replace("@", STATS + """select * from (select 1 place, 'Orphaned Posts' title, 'high' impact from st where total_links > 0 and orphaned > 0 union all select 2, 'Broken Links', 'high' from st where total_links > 0 and broken > 0
 union all select 3, 'Link Coverage', case when coverage < 50 then 'high' else 'medium' end from st where total_links > 0 and coverage < 85 union all select 0, 'Run your first scan', 'high' from st where total_links = 0)"""))
def recommendations(s, d):
    return R.recommendations(_stats(s, d))


@plans.add("setup_complete", _sql(PLC, "@").replace("@", STATS + "select total_links > 0 and orphaned = 0 and created_30 + created_prev > 0 complete from st"))
def setup_complete(s, d):
    return R.setup_complete(R.setup_steps(_stats(s, d)))


@plans.add("setup_steps", _sql(PLC, "@").replace("@", STATS + """select 'scan' step, total_links > 0 done, false optional from st union all select 'orphans', orphaned = 0, false from st
 union all select 'insert', created_30 + created_prev > 0, false from st union all select 'clicks', clicks_30 > 0, true from st"""))
def setup_steps(s, d):
    return R.setup_steps(_stats(s, d))


@plans.add("greeting_by_event", "select event_id, case when hour(ts) < 12 then 'Good morning' when hour(ts) < 18 then 'Good afternoon' else 'Good evening' end greeting from events")
def greeting_by_event(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", R.greeting(F.col("ts")).alias("greeting"))


@plans.add("external_sites", _sql(("external",), "select site_label, count(*) n, max(imported) latest from external group by site_label", pub=False))
def external_sites(s, d):
    return site(s, d, "external").groupBy("site_label").agg(F.count("*").alias("n"), F.max("imported").alias("latest"))

"""The site model over the driver's tables: posts, links, clicks and the rest, as plain projections.

Each table is one SELECT in SQL that Spark and DuckDB both read, so an oracle can start from the same rows.
Ids are p_partkey + 1; target 0 means an unresolved link. No ordering or window is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SITE = {
    "posts": """select p_partkey + 1 id, p_name title, p_type content, case when p_partkey % 10 = 0 then 'page' else 'post' end type,
        case when p_partkey % 17 = 0 then 'draft' else 'publish' end status, date '2020-01-01' + cast(p_partkey % 1500 as int) taken,
        concat(replace(p_name, ' ', '-'), '-', p_partkey + 1) slug, p_partkey % 25 = 0 money from {part}""",
    # Pages 4 (mod 4) are deep: runs of four of them, each leading to the next, and only every other run is entered from elsewhere. So some pages
    # are orphans, some are many clicks away and some can't be reached. Pages 2 (mod 16) link nowhere.
    "links": """select src + 1 src, case when ext then 0 else t + 1 end target, case when ext then 'external' else 'internal' end type,
        case when ext then concat('site', s % 40, '.example') else '' end host,
        case when ext then concat('https://www.site', s % 40, '.example/x/', o % 50) else concat('https://example.test/p/', t + 1) end url,
        case when o % 9 = 0 then 'Click here' when o % 9 = 1 then ' Read more. ' when o % 9 = 2 then concat('Topic ', t % 60, '!') else concat('topic ', t % 60) end anchor,
        case o % 23 when 0 then '404' when 1 then 'redirect' when 2 then 'timeout' when 3 then 'missing' when 4 then 'error' when 5 then '5xx' else '' end broken_type,
        case o % 23 when 0 then 404 when 1 then 301 + o % 2 when 2 then 0 when 3 then 404 when 4 then 0 when 5 then 500 else 200 end status_code,
        case when o % 23 = 1 then concat('https://example.test/moved/', t + 1) else '' end redirects_to, created
        from (select src, case when src % 4 = 3 and src % 16 < 12 and src + 4 < n then src + 4 when u % 4 = 3 and u % 32 <> 3 then u - 1 else u end t, s, o, ext, created
              from (select case when l_partkey % 16 = 1 then l_partkey - 1 else l_partkey end src, (l_orderkey * 31 + l_suppkey) % (select count(*) from {part}) u, (select count(*) from {part}) n,
                    l_suppkey s, l_orderkey o, l_returnflag = 'A' ext, l_shipdate created from {lineitem} ) y) x""",
    "clicks": """select user_id % (select count(*) from {part}) + 1 post_id, event_id % (select count(*) from {part}) + 1 target, concat('/p/', event_id % (select count(*) from {part}) + 1) url,
        concat('topic ', event_id % 20) anchor, ts from {events} where event_type = 'click'""",
    "keywords": "select p_partkey + 1 id, p_partkey % 700 + 1 post_id, p_name keyword from {part}",
    # what a post lacks is an empty value, not a missing row
    "seo_meta": """select p_partkey + 1 post_id, case p_partkey % 3 when 0 then 'rank_math_focus_keyword' when 1 then '_yoast_wpseo_focuskw' else '_seopress_analysis_target_kw' end meta_key,
        case when p_partkey % 5 = 0 then '' else concat(' ', p_name, ', ', p_brand) end meta_value from {part}
        union all select p_partkey + 1, '_yoast_wpseo_focuskw', case when p_partkey % 4 = 0 then concat(p_brand, ' ', p_name) else '' end from {part}""",
    "aioseo": """select p_partkey + 1 post_id, case when p_partkey % 13 = 0 or p_partkey % 6 > 0 then '{{"focus":{{"keyphrase":""}}}}' else concat('{{"focus":{{"keyphrase":" ', p_name, ' "}},"additional":[]}}') end keyphrases from {part}""",
    "gsc": """select concat('https://Example.test/p/', p_partkey + 1, '/') url, p_partkey + 1 post_id, case when p_partkey % 3 = 0 then 0 else p_size * 3 end clicks, case when p_partkey % 3 = 0 then 0 else p_size * 20 - 15 end impressions,
        case when p_partkey % 3 = 0 then cast(0 as double) else cast(p_partkey % 60 as double) + cast(p_size as double) / 10 end position from {part}""",
    "readings": """select date '2024-01-01' + cast(o_orderkey % 120 as int) taken_on, o_orderkey taken, o_custkey % 900 posts, o_custkey internal, o_custkey % 77 external, o_orderkey % 91 orphaned,
        o_orderkey % 37 broken, o_custkey % 53 opportunities, cast(o_custkey % 60 as double) / 10 avg_depth from {orders}""",
    "activity": """select o_orderkey id, o_custkey post_id, case o_orderstatus when 'F' then 'insert' when 'O' then 'replace' else 'remove' end action, o_orderpriority summary,
        case when o_orderkey % 4 = 0 then '' else concat('b', cast(floor(o_orderkey / 50) as bigint)) end batch, o_orderkey % 5 = 0 reverted, o_orderdate created from {orders}""",
    "rejections": """select o_custkey % 60 post_id, o_orderkey % 40 target, concat(case when o_orderkey % 2 = 0 then 'Topic ' else 'topic ' end, o_orderkey % 25) anchor, o_orderkey happened,
        case when o_orderkey % 331 = 0 then 'restore_anchor' when o_orderkey % 127 = 0 then 'restore_pair' else 'reject' end kind from {orders}""",
    # post 0 is no post: who is in no cluster, or in no second one, stands for it
    "membership": """select case when p_partkey % 5 = 0 then 0 else p_partkey + 1 end post_id, cast(p_size % 12 as bigint) cluster from {part}
        union all select case when p_partkey % 7 = 0 and p_partkey % 5 > 0 then p_partkey + 1 else 0 end, cast((p_size + 1) % 12 as bigint) from {part}""",
    "parents": "select cast(n_nationkey as bigint) cluster, cast(n_regionkey as bigint) parent from {nation}",
    "external": "select concat('nation ', s_nationkey) site_label, concat('https://www.site', s_suppkey, '.example/', replace(s_name, '#', '-'), '/') url, case when s_suppkey % 9 = 0 then '' else s_name end title, s_suppkey imported from {supplier}",
    "url_changes": "select p_partkey + 1 id, concat('https://example.test/p/', p_partkey + 1) old_url, concat('https://example.test/new/', p_partkey + 1) new_url, concat('/p/', p_partkey + 1) old_path, p_partkey % 2 = 0 redirect from {part}",
}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


SPREAD = {"documents", "pages"}  # tables of texts, whose work is in their columns
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A scan of at most SPREAD_BYTES that has fewer partitions than there are cores, dealt to all cores. A file of one row
    group is one task however large the cluster is; larger tables have splits enough and are never shuffled here."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SPREAD_BYTES and df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in SPREAD else df


def site(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the site model."""
    text = SITE[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def site_sql(*names: str) -> str:
    """CTEs of the same tables for an oracle: 'with a as (...), b as (...)'."""
    bare = {t: t for t in TABLES}
    return "with " + ", ".join(f"{n} as ({SITE[n].format(**bare)})" for n in names) + " "

"""Files that sites export: rules and link maps in CSV, search performance, sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import text

#: Columns of a rules file, and names of the page column in a search export.
RULE_COLUMNS = ["keyword", "url", "case_sensitive", "partial_match", "new_tab", "nofollow", "max_per_post", "active"]
PAGE_COLUMNS = ["top pages", "page", "url", "landing page"]
BOM = "﻿"


def _first_line(spark: SparkSession, path: str) -> list[str]:
    rows = spark.read.option("mode", "PERMISSIVE").csv(path).limit(1).collect()
    return [(c or "").replace(BOM, "").strip().lower() for c in rows[0]] if rows else []


def _by_name(spark: SparkSession, path: str, columns: list[str], need: list[str]) -> DataFrame:
    """Rows of a CSV file as strings under `columns`: by its header if that has the needed names, else by place."""
    head = _first_line(spark, path)
    raw = spark.read.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("escape", '"').option("multiLine", False).csv(path)
    if not raw.columns:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    named = all(n in head for n in need)
    at = {c: (head.index(c) if c in head else None) if named else i for i, c in enumerate(columns)}
    cols = [F.coalesce(F.col(raw.columns[at[c]]), F.lit("")).alias(c) if at[c] is not None and at[c] < len(raw.columns) else F.lit("").alias(c) for c in columns]
    rows = raw.select(*cols).withColumn(columns[0], F.replace(columns[0], F.lit(BOM), F.lit("")))
    if named:
        rows = rows.where(~F.lower(F.concat_ws("\x1f", *need)).eqNullSafe("\x1f".join(need)))
    return rows.where(F.concat_ws("", *columns) != "")


def _flag(c: Column, empty: bool) -> Column:
    return F.when(c == "", empty).otherwise(F.lower(c).isin("1", "true", "yes", "on"))


def read_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(auto-link rules, one row with imported and skipped). Rows without keyword or url are skipped."""
    rows = _by_name(spark, path, RULE_COLUMNS, ["keyword", "url"])
    ok = (F.trim("keyword") != "") & (F.trim("url") != "")
    flags = [_flag(F.col(c), False).alias(c) for c in RULE_COLUMNS[2:6]]
    rules = rows.where(ok).select(F.trim("keyword").alias("keyword"), F.trim("url").alias("url"), *flags, F.greatest(F.lit(1), F.coalesce(F.col("max_per_post").try_cast("int"), F.lit(1))).alias("max_per_post"), _flag(F.col("active"), True).alias("active"))
    return rules, rows.agg(F.count_if(ok).alias("imported"), F.count_if(~ok).alias("skipped"))


def read_link_map(spark: SparkSession, path: str) -> DataFrame:
    return _by_name(spark, path, ["keyword", "url"], ["keyword", "url"]).where("trim(keyword) <> '' and trim(url) <> ''").select(F.trim("keyword").alias("keyword"), F.trim("url").alias("url"))


def clean_number(c: Column) -> Column:
    """A number from a cell with %, commas or blanks; 0 if it is none."""
    return F.coalesce(F.regexp_replace(c, "[%, ]", "").try_cast("double"), F.lit(0.0))


def search_rows(raw: DataFrame) -> DataFrame:
    """(url, url_hash, clicks, impressions, ctr, position) of rows (url, clicks, impressions, ctr, position) as text."""
    return raw.where(F.trim("url").startswith("http")).select(F.trim("url").alias("url"), text.url_hash(F.col("url")).alias("url_hash"), clean_number(F.col("clicks")).cast("int").alias("clicks"), clean_number(F.col("impressions")).cast("int").alias("impressions"),
                                                               clean_number(F.col("ctr")).alias("ctr"), clean_number(F.col("position")).alias("position"))


def read_search(spark: SparkSession, path: str) -> DataFrame:
    """Search performance by page. The first line is always a header; the page column is found by name or is the first."""
    head = _first_line(spark, path)
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    at = next((i for i, h in enumerate(head) if h in PAGE_COLUMNS), 0)
    rest = {h: i for i, h in enumerate(head)}
    place = {"url": at} | {c: rest.get(c, i) for i, c in enumerate(["clicks", "impressions", "ctr", "position"], 1)}
    cols = [F.coalesce(F.col(f"`{raw.columns[i]}`"), F.lit("")).alias(c) if i < len(raw.columns) else F.lit("").alias(c) for c, i in place.items()]
    return search_rows(raw.select(*cols))


def resolve_search(rows: DataFrame, posts: DataFrame) -> DataFrame:
    """Search rows (url, ...) with post_id, that of the post (id, link) whose address they name, 0 if none: what a load
    replaces the stored table with. Addresses that repeat count once, with the row of most impressions."""
    by = posts.select(text.url_hash(F.col("link")).alias("url_hash"), F.col("id")).groupBy("url_hash").agg(F.min("id").alias("post_id"))
    cols = [c for c in rows.columns if c != "url_hash"]
    best = F.max_by(F.struct(*cols), F.struct("impressions", "clicks", "url"))
    one = rows.withColumn("url_hash", text.url_hash(F.col("url"))).groupBy("url_hash").agg(best.alias("x")).select("url_hash", "x.*")
    return one.join(by, "url_hash", "left").fillna(0, ["post_id"])


def read_sitemaps(spark: SparkSession, path: str, label: str, own_host: str, limit: int | None = None) -> DataFrame:
    """(site_label, url, url_hash, title) of the pages that sitemap files under path list, one level of index files
    included by reading all files; the own host's pages and repeated URLs are left out."""
    pages = spark.read.format("xml").option("rowTag", "url").schema("loc string").load(path)
    rows = pages.select(F.trim("loc").alias("url")).where("url <> ''").withColumn("url_hash", text.url_hash(F.col("url"))).groupBy("url_hash").agg(F.min("url").alias("url"))
    rows = rows.where(~text.host_of(F.col("url")).eqNullSafe(own_host.lower()))
    rows = rows if limit is None else rows.orderBy("url").limit(limit)
    return rows.select(F.lit(label).alias("site_label"), "url", "url_hash", text.title_from_url(F.col("url")).alias("title"))


def excluded_ids(setting: str, listed: list[int], term_posts: DataFrame) -> DataFrame:
    """(id): posts excluded by id, or because a listed term (id or slug, parted by commas or blanks) has them."""
    spark = term_posts.sparkSession
    terms = [t for t in setting.replace(",", " ").split() if t]
    by_term = term_posts.where(F.col("term_id").cast("string").isin(*terms) | F.col("slug").isin(*terms)).select(F.col("post_id").alias("id")) if terms else term_posts.where("false").select(F.col("post_id").alias("id"))
    return by_term.unionByName(spark.createDataFrame([(i,) for i in listed], "id long")).distinct()


def terms(term_rows: DataFrame, term_posts: DataFrame, skip=("post_format",)) -> DataFrame:
    """Non-empty terms of public taxonomies with their post counts."""
    n = term_posts.groupBy("term_id").agg(F.count("*").alias("count"))
    return term_rows.where(~F.col("taxonomy").isin(*skip)).join(n, "term_id")


#: Columns that a content walk may add to id and content.
WALK = ("title", "type", "status", "name", "date")


def walk_columns(asked: list[str]) -> list[str]:
    """The projection of a content walk: unknown names are dropped, repeated ones collapse."""
    return ["id", "content", *dict.fromkeys(c for c in asked if c in WALK)]


def walk(posts: DataFrame, asked: list[str], statuses=("publish",)) -> DataFrame:
    return posts.where(F.col("status").isin(*statuses)).select(*[c for c in walk_columns(asked) if c in posts.columns])

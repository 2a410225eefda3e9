"""CSV exports with defused cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text

ROWS_PER_FILE = 1_000_000  # spreadsheets take little more

#: The header of each export.
HEADERS = {
    "autolinks": "keyword url case_sensitive partial_match new_tab nofollow max_per_post active",
    "report": "post_id title post_type outbound_internal inbound_internal clicks url",
    "broken": "found_in_post_id found_in_title anchor url type",
    "anchors": "anchor total_uses distinct_targets source_posts generic ambiguous over_used target_title target_url target_post_id uses_to_this_target",
    "equity": "post_id title url pagerank relative_equity click_depth inbound outbound is_seed",
    "cannibal": "severity similarity shared_keyword post_a_id post_a_title post_a_url post_a_keyword post_a_equity post_b_id post_b_title post_b_url post_b_keyword post_b_equity suggested_keep_id suggested_keep_title",
    "placement": "post_id title url internal_links avg_position in_first_quarter in_last_quarter shape positions",
    "domains": "host links posts_linking",
    "trends": "date published_posts internal_links external_links orphaned broken open_opportunities avg_click_depth",
}


def defused(df: DataFrame) -> DataFrame:
    """df with every string cell safe to open in a spreadsheet."""
    return df.select(*[text.defuse(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in df.schema.fields])


def export(df: DataFrame, kind: str) -> DataFrame:
    """df under the header of that export: its columns in order, missing ones empty, cells defused."""
    cols = HEADERS[kind].split()
    return defused(df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit("").alias(c) for c in cols]))


def write_csv(df: DataFrame, path: str, kind: str | None = None, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Writes df as CSV files of at most rows_per_file rows, each with the header: one file for an export of up to
    that many rows, an empty one included."""
    out = export(df, kind) if kind else defused(df)
    files = max(1, -(-out.count() // rows_per_file))
    csv = out.repartition(files).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "")
    csv.option("maxRecordsPerFile", rows_per_file).csv(path)


def autolinks_export(rules: DataFrame) -> DataFrame:
    """Auto-link rules as an import takes them, flags as 0 and 1."""
    flags = HEADERS["autolinks"].split()[2:]
    return export(rules.select("keyword", "url", *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in flags]), "autolinks")


def report_export(rows: DataFrame) -> DataFrame:
    url = F.concat(F.lit("https://example.test/p/"), F.col("id").cast("string"))
    return export(rows.select(F.col("id").alias("post_id"), "title", F.col("type").alias("post_type"), F.col("outbound").alias("outbound_internal"), F.col("inbound").alias("inbound_internal"), "clicks", url.alias("url")), "report")


def anchors_export(report: DataFrame, targets: DataFrame, posts: DataFrame) -> DataFrame:
    """One row per anchor and target."""
    j = report.join(targets.select("norm", F.col("uses").alias("n"), "target", "url"), "norm").join(posts.select(F.col("id").alias("target"), "title"), "target", "left")
    return export(j.select(F.col("norm").alias("anchor"), F.col("uses").alias("total_uses"), F.col("targets").alias("distinct_targets"), F.col("sources").alias("source_posts"), "generic", "ambiguous", F.col("repetitive").alias("over_used"),
                           F.col("title").alias("target_title"), F.col("url").alias("target_url"), F.col("target").alias("target_post_id"), F.col("n").alias("uses_to_this_target")), "anchors")


def equity_export(rows: DataFrame) -> DataFrame:
    url = F.concat(F.lit("https://example.test/p/"), F.col("id").cast("string"))
    return export(rows.select(F.col("id").alias("post_id"), "title", url.alias("url"), F.round("equity", 8).alias("pagerank"), F.round("relative", 4).alias("relative_equity"), F.col("depth").alias("click_depth"), "inbound", "outbound", "is_seed"), "equity")


def placement_export(rows: DataFrame, titles: DataFrame) -> DataFrame:
    j = rows.join(titles.select(F.col("id").alias("src"), "title", "url"), "src", "left")
    spots = F.array_join(F.transform(F.coalesce("spots", F.array().cast("array<double>")), lambda x: F.format_number(x, 2)), " ")
    return export(j.select(F.col("src").alias("post_id"), "title", "url", F.col("links").alias("internal_links"), F.round("avg", 4).alias("avg_position"), F.col("first_quarter").alias("in_first_quarter"), F.col("last_quarter").alias("in_last_quarter"), "shape", spots.alias("positions")), "placement")


def trends_export(history: DataFrame) -> DataFrame:
    return export(history.select(F.col("taken_on").cast("string").alias("date"), F.col("posts").alias("published_posts"), F.col("internal").alias("internal_links"), F.col("external").alias("external_links"), "orphaned", "broken", F.col("opportunities").alias("open_opportunities"), F.col("avg_depth").alias("avg_click_depth")), "trends")

"""A sample of the registered queries against DuckDB on the smallest tables."""

import numbers
import os

import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = ["page_links", "page_link_counts", "site_summary", "links_report", "orphan_posts", "link_counts_union_all", "click_report_30", "issue_counts", "http_classify", "dashboard_stats", "anchor_groups", "plain_text",
          "clusters", "focus_keyword_priority", "keyword_clashes", "semantic_overlap", "rejections_blocked", "history_trends", "activity_retained", "idf", "url_rewrite", "csv_defuse", "export_report", "clicks_tumbling", "fix_candidates", "export_anchors", "export_equity", "export_trends", "export_cannibal", "original_case", "undo_batch",
          "export_autolinks", "rule_toggles", "search_load", "unused_features", "undo_batch", "reindex_delta", "scan_progress", "stored_keywords", "stored_money_flags", "equity_buried"]


def rows(df):
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple("null" if pd.isna(v) else f"{v:.6f}" if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v) for v in r))
    return sorted(out)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(c.execute(entry.oracle_sql()[name]).fetchdf())


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 120


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from shopstream.plans import analytics, discovery, merchandising, search

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = analytics.ORACLE | search.ORACLE | merchandising.ORACLE | discovery.ORACLE
QUICK = [
    "rollup_query_day", "attribute_revenue", "rollup_product_day", "overview", "trending", "term_insights", "product_ctr", "assign_arms", "experiment_results", "bought_together", "audit_diff",
    "build_postings", "fuzzy_terms", "match_terms", "business_score", "facet_counts", "sort_facet_values", "apply_price_deltas", "map_feed", "fill_blanks", "compile_selector", "apply_labels", "expand_synonyms", "analyse_queries", "lift_entities", "autocomplete", "rescue",
    "exclude_skus", "filter_to_candidates", "absent_pins", "load_label_plan", "category_position_order", "preview_selector", "union_cases", "build_facets", "similar", "labelled_pairs", "deleted_count",
    "match_redirects", "match_query_rules", "rule_of_request", "session_affinity", "personalise", "newest_changes", "viewed_beside", "page_counts",
]


def plain(df: pd.DataFrame) -> list[tuple]:
    show = lambda v: "~" if v is None or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    df = df[sorted(df.columns)]
    return sorted(tuple(map(show, row)) for row in df.astype(object).where(df.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert plain(entry_module.queries()[name](spark, sf_dir).toPandas()) == plain(con.execute(SQL[name]).fetchdf())


def test_entry_gives_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_query_with_sql_is_registered():
    assert set(SQL) <= set(entry_module.queries()) and set(entry_module.oracle_sql()) <= set(entry_module.queries())

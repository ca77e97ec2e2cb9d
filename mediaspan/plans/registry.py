"""All registered queries of the span engine and the SQL they must agree with."""

from __future__ import annotations

from mediaspan.plans import span_queries, word_queries, plan_queries, catalog_queries, review_queries, edit_queries, more_queries, focus_queries, media_queries, repair_queries, evaluate_queries, selection_queries

QUERIES: dict = {}
SQL: dict = {}
for module in (span_queries, word_queries, plan_queries, catalog_queries, review_queries, edit_queries, more_queries, focus_queries, media_queries, repair_queries, evaluate_queries, selection_queries):
    QUERIES.update(module.QUERIES)
    SQL.update(module.SQL)


def FLAGSHIP(spark, sf_dir):
    return QUERIES["f09_best_match"](spark, sf_dir)

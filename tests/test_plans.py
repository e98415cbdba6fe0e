"""Physical plans: no nested loops, Python only where it has to be, limits before shuffles."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumbline.registry import CATALOG

entry.queries()
D = "/root/testdata/sf0.001"
BATCH = [n for n, q in CATALOG.items() if not q.build.__module__.endswith("streams") and n not in ("interval_lanes", "prune_spurs", "shortest_paths", "link_frontier", "nearest_node", "snap_to_segment", "routes", "crawl_order", "crawl_candidates")]
PYTHON = {
    "keyed_hash", "normalize_lines_nfkc", "page_sections", "section_links", "attachment_links", "html_table_rows", "registry_rows",
    "calendar_rows", "page_links", "office_files", "page_sections_sql", "page_headings",
    # compatibility folding of the rows that need it
    "norm_text", "screen_text", "unanswered_counts", "text_claim", "verify_sentences", "verify_report", "quote_join", "adopted_not_cited",
    "quote_corpus_match", "binary_files", "office_text", "office_text_body", "decode_bytes", "apply_column_fn",
}


def plan(spark, name):
    return CATALOG[name].build(spark, D)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_nested_loops_and_python_only_where_listed(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    uses_python = any(k in text for k in ("ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas", "FlatMapGroupsInArrow", "BatchEvalPython", "PythonUDTF"))
    assert uses_python <= (name in PYTHON)


@pytest.mark.parametrize("name", ["daily_quota", "latest_notices", "history_tail"])
def test_top_per_key_limits_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert text.count("WindowGroupLimit") >= 2


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(spark, "find_eq")
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,1-URGENT)]" in text
    assert "o_custkey" not in text


def test_search_scores_only_postings_that_can_decide(spark):
    from plumbline.operators import search_index
    from plumbline.plans import retrieval

    index = retrieval.stored_index(spark, D)
    asked = []
    real = search_index._scored
    try:
        search_index._scored = lambda i, a: asked.append(a) or real(i, a)
        retrieval.knowledge_search(spark, D).collect()
    finally:
        search_index._scored = real
    _, deciding = asked
    words = retrieval.questions(spark, D).select("query_id", F.explode(search_index.words(F.col("original"))).alias("word")).distinct()
    every = index.terms.join(words, "word").agg(F.sum("n")).first()[0]
    assert deciding.agg(F.sum("n")).first()[0] < every / 2

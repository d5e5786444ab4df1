"""Plan shapes that must hold whatever the data size."""

import re

import pytest

from newsmill.plans.catalog import QUERIES

STREAMS = {"stream_ingest", "stream_dedup", "stream_rate_windows", "message_sink", "stream_objects", "stream_messages"}
PYTHON = {
    "mime_html_part", "html_nodes", "page_title", "page_content", "page_content_once", "page_article", "anchors", "section_links",
    "section_union_fallback", "article_flow", "article_flow_runs",
}
# no exchange at all once the test tables' own spread is left out
NARROW = {
    "event_records", "trigger_response", "raw_object_decode", "payload_normalize", "mime_html_part", "page_article", "section_links",
    "section_union_fallback", "anchors", "url_canonicalize", "link_filter", "summarize", "article_message", "alert_format",
}
# frames over one row per level, never over facts
SUMMARY_FRAMES = {
    "scaling_factors", "perf_flags", "max_concurrent_overall", "execution_monitor_overall", "concurrency_stats_overall", "latency_percentiles_overall",
}


def plan_of(spark, sf_dir, key):
    return QUERIES[key](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(QUERIES) - STREAMS))
def test_plan(spark, sf_dir, key):
    plan = plan_of(spark, sf_dir, key)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert ("MapInArrow" in plan or "MapInPandas" in plan) == (key in PYTHON)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    exchanges = [e for e in re.findall(r"Exchange \w+", plan) if "RoundRobin" not in e]
    if key in NARROW:
        assert exchanges == []
    if key not in SUMMARY_FRAMES:
        windows = plan.count("Window [")
        assert windows == 0 or "Exchange SinglePartition" not in plan.split("Window [")[1]


def test_columns_are_pruned(spark, sf_dir):
    assert re.search(r"ReadSchema: struct<page_id:bigint,url:string>", plan_of(spark, sf_dir, "link_filter"))
    assert "text" not in plan_of(spark, sf_dir, "run_outcome")
    assert re.search(r"ReadSchema: struct<event_type:string,value:double>", plan_of(spark, sf_dir, "latency_percentiles"))


def test_attempt_limit_before_shuffle(spark, sf_dir):
    assert plan_of(spark, sf_dir, "retry_outcome").count("WindowGroupLimit") == 2

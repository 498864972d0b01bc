"""Plan details that hold at any size: early cuts, pushed filters, pruned columns."""

import re

import plans
import pytest
from conftest import FOLDER

import __spark_entry__ as entry

QUERIES = entry.queries()


@pytest.mark.parametrize("key", ["upsert_records", "top_entity", "current_version", "topic_recent_records", "upsert_signals"])
def test_ranked_groups_are_cut_before_the_shuffle(spark, key):
    assert re.search(r"WindowGroupLimit .*Partial", plans.plan_of(QUERIES[key](spark, FOLDER)))


def test_filters_and_columns_reach_the_scan(spark):
    text = plans.plan_of(QUERIES["record_by_id"](spark, FOLDER))
    assert "EqualTo(event_id,421)" in text and "ReadSchema: struct<event_id:bigint,user_id:bigint>" in text


def test_daily_rollup_is_one_shuffle_without_documents(spark):
    text = plans.plan_of(QUERIES["source_daily"](spark, FOLDER))
    assert len(re.findall("Exchange hashpartitioning", text)) == 1
    assert "documents" not in text and "pages" not in text


@pytest.mark.parametrize("key, hot", [
    ("cursor_window", "kind"), ("search_reconcile", "kind"), ("divergence_aligned", "topic_id"), ("signal_novelty", "topic_id"),
    ("signal_evidence", "signal_key"), ("related_stories", "topic_id"), ("saturated_candidates", "topic_id"),
])
def test_rows_of_a_hot_key_do_not_meet_in_one_task(spark, key, hot):
    """With broadcasting off, large rows join on more than the hot key (a salt), or its bounded side is broadcast.

    A join of two sides that are one row a key each is left alone.
    """
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plans.plan_of(QUERIES[key](spark, FOLDER))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    alone = [m for m in re.findall(r"SortMergeJoin \[([^\]]*)\], \[([^\]]*)\], (\w+)", text) if re.fullmatch(rf"(_k_)?{hot}#\d+L?", m[0])]
    # centroids with sums of a topic; cursors with the newest row of a kind
    aggregated = {"signal_novelty": 1, "cursor_window": 1, "search_reconcile": 1}
    assert len(alone) <= aggregated.get(key, 0), alone

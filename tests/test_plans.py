"""What the plans of the registered queries look like."""

import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    return contract.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["keyword_match", "search_all", "search_bool", "search_phrase", "vector_topk_blocks", "rerank_topk", "reduce_parts"]
)
def test_no_cross_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "BatchEvalPython" not in text


def test_columns_and_filters_reach_the_scan(spark):
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in plan(spark, "table_scan")
    assert "Not(In(event_type" in plan(spark, "block_filter")


@pytest.mark.parametrize("name", ["search_all", "vector_topk", "reduce_parts"])
def test_top_k_is_cut_before_the_shuffle(spark, name):
    assert plan(spark, name).count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", ["search_any", "keyword_topk", "rerank_topk", "reduce_parts_own_k", "vector_topk_own_k"])
def test_a_number_of_hits_per_request_is_cut_before_the_shuffle(spark, name):
    """The largest number cuts where the hits are; each request's own number follows."""
    assert plan(spark, name).count("WindowGroupLimit") == 2


def test_few_hits_are_shipped_to_the_documents(spark):
    text = plan(spark, "joint_search")
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text

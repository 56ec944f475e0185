"""Shape of the physical plans."""
import os

import pytest

import __spark_entry__ as E
from tandem.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

# joined by range with one row per language or length bound
RANGE_JOINS = {"length_buckets", "weighted_draw"}


def plan(spark, name):
    return E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_product_joins_and_no_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    assert ("NestedLoop" in text) == (name in RANGE_JOINS)
    assert "InPandas" not in text and "InArrow" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


@pytest.mark.parametrize("name, columns", [
    ("head_split", "struct<doc_id:bigint>"), ("schedule_value", "struct<event_id:bigint>"),
    ("run_status", "struct<event_id:bigint,props:string>"), ("json_field", "struct<event_id:bigint,props:string>")])
def test_scans_read_only_what_is_used(spark, name, columns):
    assert f"ReadSchema: {columns}" in plan(spark, name)


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(toxic), EqualTo(toxic,1)" in plan(spark, "anti_join_ignored")


def test_ngrams_are_not_shuffled(spark):
    """From the exploded n-grams to the per-pair sums there is no exchange."""
    lines = plan(spark, "bleu_sentence").split("\n")
    at = next(i for i, x in enumerate(lines) if "Generate" in x)
    assert not any("Exchange" in x for x in lines[:at])

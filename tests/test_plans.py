"""What the plans must look like, whatever the data."""

import re

import pytest

from scopeline.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name: str) -> str:
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize(
    "name,shuffles",
    [
        ("evidence_bins", 1),
        ("session_box_median", 1),
        ("session_box_quantile", 1),
        ("temporal_segments", 2),
        ("asof_live_box", 1),
        ("evidence_trailing_window", 1),
        ("cadence_due_clock", 1),
        ("cadence_due_regular", 1),
        ("monitor_record", 1),
        ("agreement_mask", 1),
        ("class_histogram", 1),
        ("box_iou_pairs", 0),
        ("validate_box_reasons", 0),
        ("letterbox_params", 0),
    ],
)
def test_shuffles(spark, name, shuffles):
    assert len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition", plan(spark, name))) <= shuffles


@pytest.mark.parametrize("name,absent", [("evidence_bins", "props"), ("asof_live_box", "props"), ("box_iou_pairs", "user_id"), ("letterbox_params", "p_name"), ("recording_probe", "value")])
def test_unused_columns_are_not_read(spark, name, absent):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, name))
    assert schemas and not any(re.search(rf"\b{absent}:", s) for s in schemas)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_row_at_a_time_python(spark, name):
    text = plan(spark, name)
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", text)

"""Physical-plan properties that matter at scale (checked with AQE off, no auto-broadcast)."""

import re

import pytest

import __spark_entry__ as E
from conftest import SF_MID


@pytest.fixture()
def static(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled",
                                          "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flow_scan_reads_only_needed_columns(static):
    p = plan(E.queries()["label_distribution"](static, SF_MID))
    # the counting scan reads two columns, the scan behind the total none
    read = {f.split(":")[0] for s in re.findall(r"ReadSchema: struct<([^>]*)>", p) for f in s.split(",") if f}
    assert read == {"event_type", "value"}


def test_stratified_split_is_a_projection_over_the_rows(static):
    p = plan(E.queries()["split_stratified"](static, SF_MID))
    # one broadcast join with the class table; the rows meet no exchange, no window, no join by id
    assert re.findall(r"BroadcastHashJoin \[_c0#\d+", p)
    assert not re.findall(r"Exchange (hash|range)partitioning", p) and "Window" not in p and "SortMergeJoin" not in p


def test_first_row_per_label_and_metrics_avoid_windows_and_joins(static):
    p = plan(E.queries()["first_row_per_label"](static, SF_MID))
    assert "Window" not in p
    p = plan(E.queries()["per_class_metrics"](static, SF_MID))
    assert "Join" not in p and "Window" not in p


def test_sliding_sequences_do_not_multiply_rows(static):
    p = plan(E.queries()["sliding_sequences"](static, SF_MID))
    assert "Generate" not in p  # no row multiplication: blocks + halo + bounded frame


def test_class_weight_join_is_broadcast_after_size_check(static):
    p = plan(E.queries()["weighted_rows"](static, SF_MID))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p

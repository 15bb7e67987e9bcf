"""What must never show up in a plan, whatever the data."""

import contextlib
import io

import pytest

import __spark_entry__ as entry

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas")


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", list(entry.queries()))
def test_no_pair_products_and_no_python_in_the_plan(spark, sf_dir, name):
    plan = plan_of(entry.queries()[name](spark, sf_dir))
    assert not [word for word in FORBIDDEN if word in plan]


def test_top_k_is_pruned_before_the_shuffle(spark, sf_dir):
    plan = plan_of(entry.queries()["topk_candidates"](spark, sf_dir))
    assert plan.count("WindowGroupLimit") >= 2


def test_scans_read_only_what_they_need(spark, sf_dir):
    plan = plan_of(entry.queries()["distinct_key_scan"](spark, sf_dir))
    assert "ReadSchema: struct<l_orderkey:bigint>" in plan


def test_region_scan_prunes_partitions(spark, sf_dir):
    plan = plan_of(entry.queries()["scan_region_partition"](spark, sf_dir))
    assert "PartitionFilters: [isnotnull(region" in plan


def test_candidate_pairs_meet_by_sort_merge(spark):
    """The exploded side must not be broadcast on the strength of its file size."""
    from cohortloom.operators.candidates import _pairs, control_intervals
    from cohortloom.params import CALIPERS
    from test_random import candidate_frames

    cases, controls = candidate_frames(spark, 5, 20, seed=1)
    exact = ["region", "team_position"]
    pairs = _pairs(cases, control_intervals(controls, exact=exact, p=CALIPERS), exact=exact, p=CALIPERS, radius=1.0)
    assert "SortMergeJoin" in plan_of(pairs)


def test_sequence_windows_are_keyed_by_slice(spark, sf_dir):
    for name in ("asof_backward", "recent_window_join", "episode_reconstruct"):
        plan = plan_of(entry.queries()[name](spark, sf_dir))
        exchanges = [line for line in plan.splitlines() if "hashpartitioning(user_id" in line]
        assert any("_slice" in line for line in exchanges), name

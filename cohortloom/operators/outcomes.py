"""Matched outcome differences: overall, by group, by pairs of groups."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normalise_boolean, normalise_status, state_bins
from ..params import (
    MIN_JOINT_SETS,
    PLAYER_STATE_EDGES,
    STATE_LABELS,
    TEAM_STATE_EDGES,
    TIME_EDGES_MIN,
    TIME_LABELS,
)

GROUPS = ("team_state", "player_state", "purchase_time_group", "lifecycle_group")
PAIRS = (
    ("team_state", "player_state"),
    ("team_state", "purchase_time_group"),
    ("player_state", "purchase_time_group"),
)


def matched_set_effects(
    long: DataFrame,
    *,
    set_id: str = "matched_set_id",
    treatment: str = "treatment",
    weight: str = "matching_weight",
    outcome: str = "outcome_win",
    carried: Sequence[str] = (
        "lifecycle_status",
        "observation_timestamp",
        "team_total_gold_diff",
        "player_gold_diff_vs_role_opponent",
    ),
) -> DataFrame:
    """One row per set: case outcome, weighted control rate and their difference.

    Rows lacking an outcome or a numeric carried value take no part; a set left without its
    case or without controls is dropped.
    """
    y = normalise_boolean(F.col(outcome)).cast("double")
    numeric = [c for c in carried if c != "lifecycle_status"]
    usable = long.withColumn("_y", y).dropna(subset=[set_id, treatment, weight, "_y", *numeric])
    is_case, is_control = F.col(treatment) == 1, F.col(treatment) == 0
    w = F.when(is_control, F.col(weight))
    return (
        usable.groupBy(set_id)
        .agg(
            F.max(F.when(is_case, F.col("_y"))).cast("bigint").alias("case_win"),
            (F.sum(w * F.col("_y")) / F.sum(w)).alias("control_win_rate"),
            F.count_if(is_control).alias("selected_control_count"),
            *[F.max(F.when(is_case, F.col(c))).alias(c) for c in carried],
        )
        .filter("case_win is not null and control_win_rate is not null")
        .withColumn("risk_difference", F.col("case_win") - F.col("control_win_rate"))
        .withColumn("observation_time_minutes", F.col("observation_timestamp") / 60_000)
    )


def add_groups(effects: DataFrame, *, time_edges: Sequence[float] = TIME_EDGES_MIN) -> DataFrame:
    return effects.withColumns(
        {
            "team_state": state_bins(F.col("team_total_gold_diff"), edges=TEAM_STATE_EDGES, labels=STATE_LABELS),
            "player_state": state_bins(
                F.col("player_gold_diff_vs_role_opponent"), edges=PLAYER_STATE_EDGES, labels=STATE_LABELS
            ),
            "purchase_time_group": state_bins(
                F.col("observation_time_minutes"), edges=time_edges, labels=TIME_LABELS
            ),
            "lifecycle_group": normalise_status(F.col("lifecycle_status"), aliases={}),
        }
    )


def _summary_columns() -> list[Column]:
    n = F.count(F.lit(1))
    mean = F.avg("risk_difference")
    margin = F.when(n >= 2, F.lit(1.96) * F.stddev_samp("risk_difference") / F.sqrt(n))
    return [
        n.alias("matched_sets"),
        F.avg("case_win").alias("case_win_rate"),
        F.avg("control_win_rate").alias("control_win_rate"),
        mean.alias("risk_difference"),
        (mean - margin).alias("risk_difference_ci_low"),
        (mean + margin).alias("risk_difference_ci_high"),
    ]


def outcome_by_group(effects: DataFrame, *, groupings: Sequence[str] = GROUPS) -> DataFrame:
    """Overall and per value of each grouping, in one pass over the sets."""
    groupings = list(groupings)
    grouped = effects.groupingSets([[], *[[g] for g in groupings]], *groupings).agg(
        *_summary_columns(), *[F.grouping(g).alias(f"_all_{g}") for g in groupings]
    )
    group_type, group = F.lit("overall"), F.lit("all")
    for g in reversed(groupings):
        mine = F.col(f"_all_{g}") == 0
        group_type = F.when(mine, g).otherwise(group_type)
        group = F.when(mine, F.col(g)).otherwise(group)
    return (
        grouped.withColumn("group_type", group_type)
        .withColumn("group", group)
        .filter("group is not null")
        .drop(*groupings, *[f"_all_{g}" for g in groupings])
    )


def joint_subgroup(
    effects: DataFrame, *, pairs: Sequence[tuple[str, str]] = PAIRS, min_sets: int = MIN_JOINT_SETS
) -> DataFrame:
    """Per pair of groups, cells with at least ``min_sets`` sets."""
    names = sorted({name for pair in pairs for name in pair})
    grouped = (
        effects.groupingSets([list(pair) for pair in pairs], *names)
        .agg(*_summary_columns(), *[F.grouping(g).alias(f"_all_{g}") for g in names])
        .filter(F.col("matched_sets") >= min_sets)
    )
    columns = {key: F.lit(None).cast("string") for key in ("group_a", "value_a", "group_b", "value_b")}
    for a, b in pairs:
        mine = (F.col(f"_all_{a}") == 0) & (F.col(f"_all_{b}") == 0)
        columns["group_a"] = F.when(mine, F.lit(a)).otherwise(columns["group_a"])
        columns["value_a"] = F.when(mine, F.col(a)).otherwise(columns["value_a"])
        columns["group_b"] = F.when(mine, F.lit(b)).otherwise(columns["group_b"])
        columns["value_b"] = F.when(mine, F.col(b)).otherwise(columns["value_b"])
    return (
        grouped.withColumns(columns)
        .filter("value_a is not null and value_b is not null")
        .drop(*names, *[f"_all_{g}" for g in names])
        .orderBy(F.desc("risk_difference"), "group_a", "group_b", "value_a", "value_b")
    )

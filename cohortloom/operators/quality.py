"""Data-quality checks. Composite checks return the tidy form
(check_name, scope, severity, failing_count, sample)."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normalise_boolean, observation_key
from ..functions.frames import union_all
from ..functions.sequence import next_in_order
from ..params import (
    ABORT_RESULT,
    ASOF,
    COMPLETE_RESULT,
    EPISODE_STATUSES,
    MATCHING,
    RANKED_QUEUE,
    Matching,
)
from .candidates import CONTROL_KEY
from .manifest import id_set_difference, standard_rules

Check = tuple[str, str, Column]


def flag_checks(df: DataFrame, checks: Sequence[Check], *, sample: Column, scope: Column | None = None) -> DataFrame:
    """All checks (name, severity, failing condition) in one aggregation over the rows."""
    scope = F.lit("all") if scope is None else scope
    aggs = []
    for i, (_, _, bad) in enumerate(checks):
        failing = F.coalesce(bad, F.lit(False))
        aggs += [
            F.count_if(failing).alias(f"n{i}"),
            F.min(F.when(failing, sample.cast("string"))).alias(f"s{i}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("check_name"),
                F.lit(severity).alias("severity"),
                F.col(f"n{i}").alias("failing_count"),
                F.col(f"s{i}").alias("sample"),
            )
            for i, (name, severity, _) in enumerate(checks)
        ]
    )
    return (
        df.groupBy(scope.alias("scope"))
        .agg(*aggs)
        .select("scope", F.inline(rows))
        .select("check_name", "scope", "severity", "failing_count", "sample")
    )


def count_check(failing: DataFrame, *, name: str, severity: str, sample: Column, scope: str = "all") -> DataFrame:
    """A tidy row from a frame that holds the failing items."""
    return failing.agg(
        F.lit(name).alias("check_name"),
        F.lit(scope).alias("scope"),
        F.lit(severity).alias("severity"),
        F.count(F.lit(1)).alias("failing_count"),
        F.min(sample.cast("string")).alias("sample"),
    )


def batch_gaps(files: DataFrame, *, region: str = "region", batch: str = "batch_id") -> DataFrame:
    """Batch numbers absent between a region's lowest and highest batch."""
    present = files.select(region, F.col(batch).cast("bigint").alias("_b")).dropna().distinct()
    stepped = next_in_order(present, by=[region], ts="_b", tie=(), values=["_b"], slice_ms=10_000)
    return stepped.filter(F.col("next._b") > F.col("_b") + 1).select(
        region, F.explode(F.sequence(F.col("_b") + 1, F.col("next._b") - 1)).alias(batch)
    )


def batch_completeness(
    files: DataFrame, *, tables: Sequence[str], region: str = "region", batch: str = "batch_id"
) -> DataFrame:
    """Batches that some but not all tables have, with the missing tables."""
    flags = [F.max(F.when(F.col("table_name") == t, F.lit(True))).alias(f"_{i}") for i, t in enumerate(tables)]
    missing = F.concat_ws(",", *[F.when(F.col(f"_{i}").isNull(), t) for i, t in enumerate(tables)])
    return (
        files.groupBy(region, batch)
        .agg(*flags)
        .select(region, batch, missing.alias("missing_tables"))
        .filter("missing_tables <> ''")
    )


def batch_size_bounds(
    rows: DataFrame,
    *,
    region: str = "region",
    batch: str = "batch_id",
    lo: int = 1,
    hi: int = 100,
    batches: DataFrame | None = None,
) -> DataFrame:
    """Batches with fewer than ``lo`` or more than ``hi`` rows. ``batches`` lists batches
    that may hold no rows at all."""
    sizes = rows.groupBy(region, batch).agg(F.count(F.lit(1)).alias("rows"))
    if batches is not None:
        sizes = batches.select(region, batch).distinct().join(sizes, [region, batch], "left").fillna(0, ["rows"])
    return sizes.filter(~F.col("rows").between(lo, hi)).withColumn(
        "problem", F.when(F.col("rows") < lo, "too_few").otherwise("too_many")
    )


def duplicate_keys(df: DataFrame, *, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def group_cardinality(
    df: DataFrame, *, by: Sequence[str], expected: int, distinct: str | None = None
) -> DataFrame:
    """Groups whose size (or number of distinct values) is not the expected one."""
    size = F.countDistinct(distinct) if distinct else F.count(F.lit(1))
    return df.groupBy(*by).agg(size.alias("size")).filter(F.col("size") != expected)


def value_range(df: DataFrame, *, column: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    value = F.col(column)
    below = F.count_if(value < lo) if lo is not None else F.lit(0).cast("bigint")
    above = F.count_if(value > hi) if hi is not None else F.lit(0).cast("bigint")
    return df.agg(F.lit(column).alias("column_name"), below.alias("below"), above.alias("above"))


def all_null_columns(df: DataFrame, *, by: Sequence[str]) -> DataFrame:
    columns = [c for c in df.columns if c not in by]
    counted = df.groupBy(*by).agg(*[F.count(c).alias(c) for c in columns])
    return counted.unpivot(list(by), columns, "column_name", "filled").filter("filled = 0").drop("filled")


def winner_anomalies(
    matches: DataFrame, participants: DataFrame, *, max_winners: int = 5, expected_result: str = ABORT_RESULT
) -> DataFrame:
    """Matches with no winner (expected after an abort) or with too many."""
    winners = participants.groupBy("match_id").agg(
        F.count_if(F.coalesce(normalise_boolean(F.col("win")), F.lit(False))).alias("winners")
    )
    odd = winners.filter(F.col("winners").isin(0) | (F.col("winners") > max_winners))
    known = matches.select("match_id", "end_of_game_result", F.lit(True).alias("_known"))
    severity = (
        F.when(F.col("winners") > max_winners, "warning")
        .when(F.col("_known").isNull(), "error")
        .when(F.col("end_of_game_result") == expected_result, "info")
        .otherwise("warning")
    )
    return odd.join(known, "match_id", "left").select("match_id", "winners", "end_of_game_result", severity.alias("severity"))


def missing_profile(df: DataFrame) -> DataFrame:
    counted = df.agg(
        F.count(F.lit(1)).alias("_total"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    return (
        counted.unpivot(["_total"], df.columns, "column_name", "missing")
        .filter("missing > 0")
        .select("column_name", "missing", (F.col("missing") / F.col("_total") * 100).alias("percent"))
    )


def temporal_order(
    df: DataFrame,
    *,
    state_ts: str = "snapshot_timestamp",
    event_ts: str = "purchase_timestamp",
    age: str = "snapshot_age_ms",
    max_age: int = ASOF.max_age_ms,
) -> DataFrame:
    s, e, a = F.col(state_ts), F.col(event_ts), F.col(age)
    return df.agg(
        F.count_if(s > e).alias("state_after_event"),
        F.count_if(s == e).alias("state_at_event"),
        F.count_if(a < 0).alias("negative_age"),
        F.count_if(a > max_age).alias("over_max_age"),
        F.count_if((e - s) != a).alias("age_mismatch"),
    )


DIFFERENCES = (
    ("current_gold", "team_current_gold_sum", "enemy_current_gold_sum", "team_current_gold_diff"),
    ("total_gold", "team_total_gold_sum", "enemy_total_gold_sum", "team_total_gold_diff"),
    ("xp", "team_xp_sum", "enemy_xp_sum", "team_xp_diff"),
    ("lane_cs", "team_minions_killed_sum", "enemy_minions_killed_sum", "team_cs_diff"),
)
PARTS = (
    ("player_total_gold", "team_total_gold_sum"),
    ("player_current_gold", "team_current_gold_sum"),
    ("player_xp", "team_xp_sum"),
    ("player_minions_killed", "team_minions_killed_sum"),
    ("player_jungle_minions_killed", "team_jungle_minions_killed_sum"),
)


def difference_checks(columns: Sequence[str], triples: Sequence[tuple[str, str, str, str]] = DIFFERENCES) -> list[Check]:
    """Stored difference against team minus enemy, negative sums, current above total gold,
    and (informational) rows where lane plus jungle differs from the lane-only difference."""
    checks: list[Check] = []
    for name, team, enemy, diff in triples:
        checks.append((f"{name}_difference", "error", F.col(team) - F.col(enemy) != F.col(diff)))
        checks.append((f"{name}_negative", "error", (F.col(team) < 0) | (F.col(enemy) < 0)))
    names = set(columns)
    if {"team_current_gold_sum", "team_total_gold_sum"} <= names:
        for side in ("team", "enemy"):
            checks.append(
                (
                    f"{side}_current_above_total",
                    "error",
                    F.col(f"{side}_current_gold_sum") > F.col(f"{side}_total_gold_sum"),
                )
            )
    if "team_jungle_minions_killed_sum" in names:
        jungle = F.col("team_jungle_minions_killed_sum") - F.col("enemy_jungle_minions_killed_sum")
        checks.append(("jungle_outside_cs_difference", "info", jungle != 0))
    return checks


def difference_consistency(
    df: DataFrame, *, triples: Sequence[tuple[str, str, str, str]] = DIFFERENCES, sample: str = "case_id"
) -> DataFrame:
    return flag_checks(df, difference_checks(df.columns, triples), sample=F.col(sample))


def part_checks(pairs: Sequence[tuple[str, str]] = PARTS) -> list[Check]:
    return [(f"{a}_above_{b}", "error", F.col(a) > F.col(b)) for a, b in pairs]


def part_le_whole(df: DataFrame, *, pairs: Sequence[tuple[str, str]] = PARTS, sample: str = "case_id") -> DataFrame:
    return flag_checks(df, part_checks(pairs), sample=F.col(sample))


EPISODE_KEY = ("match_id", "participant_id", "purchase_timestamp")


def episode_checks(max_participant: int = 10) -> list[Check]:
    sold = F.col("status") == "SOLD"
    sale, held, bought = F.col("sale_timestamp"), F.col("time_held_ms"), F.col("purchase_timestamp")
    return [
        ("unknown_status", "error", ~F.coalesce(F.col("status").isin(*EPISODE_STATUSES), F.lit(False))),
        ("participant_out_of_range", "error", ~F.col("participant_id").between(1, max_participant)),
        ("negative_purchase_time", "error", bought < 0),
        ("invalid_sale", "error", sold & (sale.isNull() | held.isNull() | (held < 0) | (sale < bought))),
        ("sale_without_sold", "error", ~sold & sale.isNotNull()),
    ]


def episode_invariants(episodes: DataFrame, events: DataFrame, *, max_participant: int = 10) -> DataFrame:
    """``events`` is the item catalogue the episodes were built from."""
    key = list(EPISODE_KEY)
    rows = flag_checks(episodes, episode_checks(max_participant), sample=observation_key(*key))
    copies = count_check(
        duplicate_keys(episodes, key=key), name="duplicate_episode", severity="error", sample=observation_key(*key)
    )
    return union_all(rows, copies, purchases_differ(episodes, events))


def rows_differ(one: DataFrame, other: DataFrame, name: str) -> DataFrame:
    """A tidy row with the difference of two row counts."""
    both = one.select(F.lit(1).alias("_d")).unionByName(other.select(F.lit(-1).alias("_d")))
    return both.agg(
        F.lit(name).alias("check_name"),
        F.lit("all").alias("scope"),
        F.lit("error").alias("severity"),
        F.abs(F.coalesce(F.sum("_d"), F.lit(0))).alias("failing_count"),
        F.lit(None).cast("string").alias("sample"),
    )


def purchases_differ(episodes: DataFrame, events: DataFrame) -> DataFrame:
    bought = events.filter(F.upper(F.trim("event_type")) == "ITEM_PURCHASED")
    return rows_differ(episodes, bought, "episodes_differ_from_purchases")


def manifest_checks(rules: Sequence[tuple[str, Column]] | None = None) -> list[Check]:
    return [
        (f"eligible_{name}", "error", F.col("analysis_eligible") & ~F.coalesce(ok, F.lit(False)))
        for name, ok in (rules or standard_rules())
    ]


def manifest_invariants(manifest: DataFrame, *, rules: Sequence[tuple[str, Column]] | None = None) -> DataFrame:
    rows = flag_checks(manifest, manifest_checks(rules), sample=F.col("match_id"))
    copies = count_check(
        duplicate_keys(manifest, key=["match_id"]), name="duplicate_match", severity="error", sample=F.col("match_id")
    )
    return union_all(rows, copies)


def case_checks(
    *, max_age: int = ASOF.max_age_ms, queue: int = RANKED_QUEUE, result: str = COMPLETE_RESULT, max_participant: int = 10
) -> list[Check]:
    age = F.col("purchase_timestamp") - F.col("snapshot_timestamp")
    return [
        ("participant_out_of_range", "error", ~F.col("participant_id").between(1, max_participant)),
        ("age_mismatch", "error", age != F.col("snapshot_age_ms")),
        ("age_out_of_range", "error", ~F.col("snapshot_age_ms").between(0, max_age)),
        ("wrong_queue", "error", ~F.coalesce(F.col("queue_id") == queue, F.lit(False))),
        ("incomplete_game", "error", ~F.coalesce(F.col("outcome_game_result") == result, F.lit(False))),
        ("missing_outcome", "error", F.col("outcome_win").isNull()),
    ]


def case_invariants(cases: DataFrame, episodes: DataFrame, **bounds) -> DataFrame:
    """``bounds`` are those of ``case_checks``."""
    rows = flag_checks(cases, case_checks(**bounds), sample=F.col("case_id"))
    copies = count_check(
        duplicate_keys(cases, key=["case_id"]), name="duplicate_case", severity="error", sample=F.col("case_id")
    )
    return union_all(rows, copies, case_sides(cases, episodes))


def case_sides(cases: DataFrame, episodes: DataFrame) -> DataFrame:
    """Episodes that are no case, and cases that are no episode."""
    expected = episodes.select(observation_key("match_id", "participant_id", "purchase_timestamp").alias("case_id"))
    return flag_checks(
        id_set_difference(expected, cases.select("case_id"), key=["case_id"]),
        [
            ("missing_case", "error", F.col("side") == "missing"),
            ("unexpected_case", "error", F.col("side") == "unexpected"),
        ],
        sample=F.col("case_id"),
    )


def feature_checks(features: Sequence[str], flags: Sequence[str]) -> list[Check]:
    checks: list[Check] = []
    for name in features:
        checks.append((f"{name}_missing", "error", F.col(name).isNull()))
        checks.append((f"{name}_negative", "error", F.col(name) < 0))
    return checks + [(f"{name}_not_a_flag", "error", ~F.col(name).isin(0, 1)) for name in flags]


def feature_invariants(
    before: DataFrame, after: DataFrame, *, features: Sequence[str], flags: Sequence[str], sample: str
) -> DataFrame:
    rows = flag_checks(after, feature_checks(features, flags), sample=F.col(sample))
    return union_all(rows, rows_differ(after, before, "row_count_changed"))


def set_checks(p: Matching = MATCHING) -> list[Check]:
    """Of sets with ``n`` controls and the sum ``w`` of their weights."""
    return [
        ("controls_out_of_range", "error", ~F.col("n").between(1, p.k)),
        ("weights_do_not_sum_to_one", "error", F.abs(F.col("w") - 1) > 1e-8 + 1e-5),
    ]


def control_checks(*, exact: bool, p: Matching = MATCHING) -> list[Check]:
    checks: list[Check] = [
        ("missing_score", "error", F.col("selection_score").isNull()),
        ("score_above_best", "error", F.col("selection_score_above_best") > p.score_above_best),
        ("state_above_best", "error", F.col("state_distance_above_best") > p.state_above_best),
    ]
    if exact:
        checks.append(("history_differs", "error", ~F.col("dark_seal_history_match")))
    return checks


def selection_invariants(selected: DataFrame, *, exact: bool, p: Matching = MATCHING) -> DataFrame:
    sets = selected.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("matching_weight").alias("w")
    )
    per_set = flag_checks(sets, set_checks(p), sample=F.col("case_id"))
    rows = flag_checks(selected, control_checks(exact=exact, p=p), sample=F.col("case_id"))
    copies = count_check(
        duplicate_keys(selected, key=["case_id", *CONTROL_KEY]),
        name="duplicate_control",
        severity="error",
        sample=F.col("case_id"),
    )
    return union_all(per_set, rows, copies)


def long_columns() -> dict[str, Column]:
    case, control = F.col("treatment") == 1, F.col("treatment") == 0
    return {
        "rows": F.count(F.lit(1)),
        "cases": F.count_if(case),
        "controls": F.count_if(control),
        "cw": F.sum(F.when(case, F.col("matching_weight"))),
        "kw": F.sum(F.when(control, F.col("matching_weight"))),
    }


def with_wanted(sets: DataFrame, selected: DataFrame) -> DataFrame:
    """Sets with the number of controls selected for them; sets of either side."""
    expected = selected.groupBy(F.col("case_id").alias("matched_set_id")).agg(F.count(F.lit(1)).alias("wanted"))
    return sets.join(expected, "matched_set_id", "full_outer")


def long_set_checks(k: int = MATCHING.k) -> list[Check]:
    def off(name):
        return ~F.coalesce(F.abs(F.col(name) - 1) <= 1e-8 + 1e-5, F.lit(False))

    return [
        ("row_count_differs", "error", ~F.coalesce(F.col("rows") == F.col("wanted") + 1, F.lit(False))),
        ("not_one_case", "error", ~F.coalesce(F.col("cases") == 1, F.lit(False))),
        ("controls_out_of_range", "error", ~F.coalesce(F.col("controls").between(1, k), F.lit(False))),
        ("case_weight", "error", off("cw")),
        ("control_weight", "error", off("kw")),
    ]


def long_row_checks() -> list[Check]:
    return [
        ("treatment_not_binary", "error", ~F.col("treatment").isin(0, 1)),
        ("weight_not_positive", "error", F.col("matching_weight") <= 0),
        ("missing_outcome", "error", F.col("outcome_win").isNull()),
    ]


def matched_long_invariants(long: DataFrame, selected: DataFrame, *, k: int = MATCHING.k) -> DataFrame:
    sets = long.groupBy("matched_set_id").agg(*[c.alias(n) for n, c in long_columns().items()])
    per_set = flag_checks(with_wanted(sets, selected), long_set_checks(k), sample=F.col("matched_set_id"))
    return union_all(per_set, flag_checks(long, long_row_checks(), sample=F.col("matched_set_id")))


def quality_report(*checks: DataFrame) -> DataFrame:
    """Per scope and severity: checks run, checks failing, failing items."""
    return (
        union_all(*checks)
        .groupBy("scope", "severity")
        .agg(
            F.count(F.lit(1)).alias("checks"),
            F.count_if(F.col("failing_count") > 0).alias("failing_checks"),
            F.sum("failing_count").alias("failing_items"),
        )
    )

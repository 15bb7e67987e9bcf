"""Matching designs: scores, variable-ratio and one-to-one selection, long tables."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import union_all
from ..params import HISTORY_FEATURE, MATCHING, PAIR_STATE, Matching
from .candidates import CONTROL_KEY
from .quantiles import exact_quantiles

RANK_ORDER = (
    "selection_score",
    "state_distance_standardised",
    "control_snapshot_age_ms",
    *CONTROL_KEY,
)


def enrich_candidates(pool: DataFrame, features: DataFrame, *, p: Matching = MATCHING) -> DataFrame:
    """Adds the event features of both sides; ``features`` is unique per observation."""
    names = [p.history_feature, *p.event_features]
    case_side = features.select(
        F.col("match_id"),
        F.col("participant_id").alias("case_participant_id"),
        F.col("observation_timestamp").alias("case_purchase_timestamp"),
        *[F.col(n).alias(f"case_{n}") for n in names],
    )
    control_side = features.select(
        F.col("match_id").alias("control_match_id"),
        F.col("participant_id").alias("control_participant_id"),
        F.col("observation_timestamp").alias("control_snapshot_timestamp"),
        *[F.col(n).alias(f"control_{n}") for n in names],
    )
    return pool.join(case_side, ["match_id", "case_participant_id", "case_purchase_timestamp"], "left").join(
        control_side, list(CONTROL_KEY), "left"
    )


def feature_means(df: DataFrame, *, features: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(name).alias(name) for name in features])


def selection_score(candidates: DataFrame, *, p: Matching = MATCHING) -> DataFrame:
    """Gaps, their scaling over the whole candidate table, and the weighted score.

    The scales are one row of population deviations, read as a scalar subquery. Pass a
    stored candidate table: it is scanned once for the scales and once for the rows.
    """
    events = list(p.event_features)
    gaps = candidates.select(
        "*",
        (F.col(f"case_{p.history_feature}") == F.col(f"control_{p.history_feature}")).alias("dark_seal_history_match"),
        F.abs(F.col("case_player_current_gold") - F.col("control_player_current_gold")).alias("current_gold_gap"),
        *[F.abs(F.col(f"case_{e}") - F.col(f"control_{e}")).alias(f"{e}_gap") for e in events],
    )
    scaled = ["control_match_state_score", "current_gold_gap", *[f"{e}_gap" for e in events]]
    scales = gaps.agg(
        F.struct(
            *[F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0).alias(c) for c in scaled]
        ).alias("s")
    ).scalar()
    with_scales = gaps.withColumn("_s", scales)

    def distance(name: str) -> Column:
        return F.col(name) / F.col("_s")[name]

    event_total = distance(f"{events[0]}_gap")
    for e in events[1:]:
        event_total = event_total + distance(f"{e}_gap")
    return (
        with_scales.withColumn("state_distance_standardised", distance("control_match_state_score"))
        .withColumn("current_gold_distance_standardised", distance("current_gold_gap"))
        .withColumn("event_distance_standardised", event_total / len(events))
        .withColumn(
            "selection_score",
            F.lit(p.state_weight) * F.col("state_distance_standardised")
            + F.lit(p.gold_weight) * F.col("current_gold_distance_standardised")
            + F.lit(p.event_weight) * F.col("event_distance_standardised"),
        )
        .drop("_s")
    )


def distance_above_best(
    df: DataFrame, *, by: Sequence[str], order: Sequence[str], bounds: dict[str, tuple[str, float]]
) -> DataFrame:
    """``bounds`` maps a new column to (measured column, largest excess over the group's
    best-ranked row); rows over any bound are dropped."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.select(
        "*", *[(F.col(source) - F.first(source).over(w)).alias(name) for name, (source, _) in bounds.items()]
    )
    for name, (_, limit) in bounds.items():
        out = out.filter(F.col(name) <= limit)
    return out


def topk_controls_weighted(df: DataFrame, *, by: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    ranked = df.withColumn("control_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(
        F.col("control_rank") <= k
    )
    size = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return ranked.withColumn("controls_in_set", size).withColumn(
        "matching_weight", F.lit(1.0) / F.col("controls_in_set")
    )


def _select(eligible: DataFrame, p: Matching, sample: str) -> DataFrame:
    bounds = {
        "selection_score_above_best": ("selection_score", p.score_above_best),
        "state_distance_above_best": ("state_distance_standardised", p.state_above_best),
    }
    near = distance_above_best(eligible, by=["case_id"], order=RANK_ORDER, bounds=bounds)
    return topk_controls_weighted(near, by=["case_id"], order=RANK_ORDER, k=p.k).withColumn(
        "selection_sample", F.lit(sample)
    )


def _eligible(cases: DataFrame, scored: DataFrame, p: Matching) -> DataFrame:
    targets = target_cases(cases, p=p).select("case_id")
    return scored.filter(F.col("current_gold_gap") <= p.gold_gap).join(targets, "case_id", "left_semi")


def target_cases(cases: DataFrame, *, p: Matching = MATCHING) -> DataFrame:
    return cases.filter(F.col("lifecycle_status").isin(*p.statuses))


def match_primary(
    cases: DataFrame, scored: DataFrame, *, p: Matching = MATCHING, sample: str = "PRIMARY_VARIABLE_1_TO_3_EXACT_DARK_SEAL"
) -> DataFrame:
    """One to k controls with equal history."""
    exact = _eligible(cases, scored.filter("dark_seal_history_match"), p)
    return _select(exact, p, sample).withColumn("selection_used_fallback", F.lit(False))


def match_relaxed(
    cases: DataFrame, scored: DataFrame, *, p: Matching = MATCHING, sample: str = "RELAXED_VARIABLE_1_TO_3_EXACT_PREFERRED"
) -> DataFrame:
    """Other histories only where a case has no equal-history candidate within the caliper."""
    any_exact = F.bool_or("dark_seal_history_match").over(Window.partitionBy("case_id"))
    allowed = (
        _eligible(cases, scored, p)
        .withColumn("_any_exact", any_exact)
        .filter("dark_seal_history_match or not _any_exact")
        .drop("_any_exact")
    )
    return _select(allowed, p, sample).withColumn("selection_used_fallback", ~F.col("dark_seal_history_match"))


def match_one_to_one(selected: DataFrame, *, sample: str = "PRIMARY_1_TO_1_EXACT_DARK_SEAL") -> DataFrame:
    """The best-ranked control of every set."""
    return (
        selected.filter("control_rank = 1")
        .withColumn("controls_in_set", F.lit(1).cast("bigint"))
        .withColumn("matching_weight", F.lit(1.0))
        .withColumn("selection_sample", F.lit(sample))
        .withColumn("selection_used_fallback", F.lit(False))
    )


def matched_long(cases: DataFrame, selected: DataFrame) -> DataFrame:
    """One case row plus its control rows per set, in aligned columns.

    Outcome, status and champion of a case come from ``cases``; its state is the case side
    of the best-ranked control row.
    """
    suffixes = [name for name in PAIR_STATE if f"case_{name}" in selected.columns]
    per_set = Window.partitionBy("case_id")
    counted = selected.select(
        "*",
        F.count_if("dark_seal_history_match").over(per_set).alias("_exact_in_set"),
        F.bool_or("selection_used_fallback").over(per_set).alias("_fallback_in_set"),
    )
    case_meta = cases.select(
        "case_id",
        "lifecycle_status",
        F.col("match_id").alias("_m"),
        F.col("participant_id").alias("_p"),
        F.col("purchase_timestamp").alias("_t"),
        F.col("outcome_win").alias("_outcome"),
        F.col("region").alias("_region"),
        F.col("team_position").alias("_position"),
        F.col("champion_id").alias("_champion_id"),
        F.col("champion_name").alias("_champion_name"),
        F.col("team_id").alias("_team_id"),
    )
    joined = counted.join(case_meta, "case_id")
    shared = [F.col("case_id").alias("matched_set_id"), F.col("case_id")]
    case_rows = joined.filter("control_rank = 1").select(
        *shared,
        F.lit(1).alias("treatment"),
        F.lit("CASE").alias("sample_type"),
        "lifecycle_status",
        F.col("_m").alias("match_id"),
        F.col("_p").alias("participant_id"),
        F.col("_t").alias("observation_timestamp"),
        F.col("_outcome").alias("outcome_win"),
        F.lit(1.0).alias("matching_weight"),
        "controls_in_set",
        F.col("_exact_in_set").alias("exact_controls_in_set"),
        "selection_sample",
        F.col("_fallback_in_set").alias("selection_used_fallback"),
        F.col("_region").alias("region"),
        F.col("_position").alias("team_position"),
        F.col("_champion_id").alias("champion_id"),
        F.col("_champion_name").alias("champion_name"),
        F.col("_team_id").alias("team_id"),
        *[F.col(f"case_{s}").alias(s) for s in suffixes],
    )
    kept = [
        "control_rank",
        "dark_seal_history_match",
        "selection_score",
        "selection_score_above_best",
        "state_distance_standardised",
        "state_distance_above_best",
        "current_gold_gap",
        "current_gold_distance_standardised",
        "event_distance_standardised",
        "control_match_state_score",
        "control_snapshot_age_ms",
        *[c for c in selected.columns if c.endswith("_last_5m_gap")],
    ]
    control_rows = joined.select(
        *shared,
        F.lit(0).alias("treatment"),
        F.lit("CONTROL").alias("sample_type"),
        F.lit("CONTROL").alias("lifecycle_status"),
        F.col("control_match_id").alias("match_id"),
        F.col("control_participant_id").alias("participant_id"),
        F.col("control_snapshot_timestamp").alias("observation_timestamp"),
        "outcome_win",
        "matching_weight",
        "controls_in_set",
        F.col("_exact_in_set").alias("exact_controls_in_set"),
        "selection_sample",
        "selection_used_fallback",
        F.col("_region").alias("region"),
        "team_position",
        "champion_id",
        "champion_name",
        "team_id",
        *[F.col(f"control_{s}").alias(s) for s in suffixes],
        *kept,
    )
    return union_all(case_rows, control_rows)


def unmatched_cases(targets: DataFrame, selected: DataFrame, *, columns: Sequence[str] = ()) -> DataFrame:
    return (
        targets.join(selected.select("case_id").distinct(), "case_id", "left_anti")
        .select("case_id", "lifecycle_status", *columns)
        .withColumn("reason", F.lit("NO_ELIGIBLE_CONTROL"))
    )


def control_reuse(selected: DataFrame) -> DataFrame:
    return (
        selected.groupBy(*CONTROL_KEY)
        .agg(F.count(F.lit(1)).alias("uses"))
        .agg(
            F.count(F.lit(1)).alias("unique_control_observations"),
            F.count_if(F.col("uses") > 1).alias("reused_control_observations"),
            F.coalesce(F.max("uses"), F.lit(0)).alias("maximum_control_reuse"),
        )
    )


def sample_summary(targets: DataFrame, selected: DataFrame, matched: DataFrame) -> DataFrame:
    """One row per sample: coverage, set sizes, scores, weighted outcome rates, reuse."""
    key = F.col("selection_sample").alias("sample")
    rows = selected.groupBy(key).agg(
        F.count(F.lit(1)).alias("selected_control_rows"),
        F.count_if("dark_seal_history_match").alias("exact_dark_seal_control_rows"),
        F.count_if(~F.col("dark_seal_history_match")).alias("fallback_control_rows"),
        F.avg("selection_score").alias("mean_selection_score"),
        F.max("selection_score_above_best").alias("maximum_score_above_best"),
        F.max("state_distance_above_best").alias("maximum_state_above_best"),
        F.avg("current_gold_gap").alias("mean_current_gold_gap"),
        F.max("current_gold_gap").cast("double").alias("maximum_current_gold_gap"),
    )
    sets = (
        selected.groupBy(key, "case_id")
        .agg(F.count(F.lit(1)).alias("n"), F.bool_or("selection_used_fallback").alias("fallback"))
        .groupBy("sample")
        .agg(
            F.count(F.lit(1)).alias("matched_cases"),
            F.count_if(F.expr("n = 1")).alias("cases_with_1_control"),
            F.count_if(F.expr("n = 2")).alias("cases_with_2_controls"),
            F.count_if(F.expr("n = 3")).alias("cases_with_3_controls"),
            F.count_if("fallback").alias("cases_using_fallback"),
        )
    )
    won = F.col("outcome_win").cast("double")
    weight = F.col("matching_weight")

    def rate(treatment: int) -> Column:
        mine = F.when(F.col("treatment") == treatment, weight)
        return F.sum(mine * won) / F.sum(mine)

    rates = matched.groupBy(key).agg(rate(1).alias("case_win_rate"), rate(0).alias("control_win_rate"))
    reuse = (
        selected.groupBy(key, *CONTROL_KEY)
        .agg(F.count(F.lit(1)).alias("uses"))
        .groupBy("sample")
        .agg(
            F.count(F.lit(1)).alias("unique_control_observations"),
            F.count_if(F.expr("uses > 1")).alias("reused_control_observations"),
            F.max("uses").alias("maximum_control_reuse"),
        )
    )
    median = exact_quantiles(selected.select(key, "selection_score"), by=["sample"], value="selection_score", probs=[0.5]).select(
        "sample", F.col("quantile").alias("median_selection_score")
    )
    wanted = targets.agg(F.count(F.lit(1))).scalar()
    joined = rows
    for part in (sets, rates, reuse, median):
        joined = joined.join(part, "sample")
    return (
        joined.withColumn("target_cases", wanted)
        .withColumn("unmatched_cases", F.col("target_cases") - F.col("matched_cases"))
        .withColumn("coverage", F.col("matched_cases") / F.col("target_cases"))
        .withColumn("raw_win_rate_difference", F.col("case_win_rate") - F.col("control_win_rate"))
    )

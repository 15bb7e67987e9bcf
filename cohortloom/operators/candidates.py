"""Candidate controls: an exact nearest-k search under several calipers at once."""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import relative_gap
from ..functions.frames import dedupe, union_all
from ..functions.sequence import slice_of, slice_width
from ..params import ASOF, CALIPERS, PLAYER_MEASURES, STATE_COLUMNS, Calipers
from ..session import materialise
from .asof import asof_backward

# fixed values: what a control must have
SCORED = (
    "total_gold",
    "player_gold_diff_vs_role_opponent",
    "player_xp_diff_vs_role_opponent",
    "rest_of_team_gold_diff",
    "rest_of_team_xp_diff",
)
CONTROL_REQUIRED = (
    "team_position",
    "level",
    "total_gold",
    "team_total_gold",
    "team_xp",
    "team_cs",
    "team_total_gold_diff",
    "team_xp_diff",
    "team_cs_diff",
    "role_opponent_participant_id",
    "role_opponent_total_gold",
    "role_opponent_xp",
    *SCORED[1:],
)
CONTROL_KEY = ("control_match_id", "control_participant_id", "control_snapshot_timestamp")


def latest_per_entity(df: DataFrame, *, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    return dedupe(df, key=by, order=[F.col(name).desc_nulls_last() for name in order])


def topk_candidates(df: DataFrame, *, by: Sequence[str], order: Sequence[str | Column], k: int) -> DataFrame:
    """The k first rows per group; pruned inside each map task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def case_states(episodes: DataFrame, state: DataFrame, *, max_age: int = ASOF.max_age_ms) -> DataFrame:
    """Episodes with the state of the player's last usable snapshot."""
    mine = state.join(episodes.select("match_id").distinct(), "match_id", "left_semi")
    return asof_backward(
        episodes,
        mine,
        by=["match_id", "participant_id"],
        left_ts="purchase_timestamp",
        right_ts="timestamp",
        payload=["team_position", *PLAYER_MEASURES, *STATE_COLUMNS],
        max_age=max_age,
    ).filter("asof_timestamp is not null")


def control_intervals(controls: DataFrame, *, exact: Sequence[str], p: Calipers) -> DataFrame:
    """Controls per case level they are in reach of, with the interval of case times for
    which they are the player's last snapshot in reach.

    This settles "keep the last snapshot per player" before any pair exists: a later snapshot
    in reach of the same case level ends the interval of the earlier one.
    """
    width = slice_width(p.max_gap_ms)
    own = slice_of(F.col("timestamp"), width)
    seen_from = slice_of(F.col("timestamp") - p.max_gap_ms, width)
    narrow = (
        controls.dropna(subset=[*exact, *CONTROL_REQUIRED])
        .filter("level >= 1")
        .select(*exact, "match_id", "participant_id", "timestamp", F.col("level").cast("int").alias("level"), *SCORED)
        .withColumn("_own", own)
        .withColumn("_slice", F.explode(F.array_distinct(F.array(own, seen_from))))
        .repartition("match_id", "participant_id", "_slice")
        .withColumn(
            "case_level",
            F.explode(F.sequence(F.col("level") - p.level_band, F.col("level") + p.level_band)),
        )
    )
    later = Window.partitionBy("match_id", "participant_id", "_slice", "case_level").orderBy("timestamp")
    until = F.least(
        F.lead("timestamp").over(later) - 1, F.col("timestamp") + p.max_gap_ms
    )
    intervals = (
        narrow.withColumn("valid_to", until)
        .filter("_slice = _own and valid_to >= timestamp")
        .drop("_slice", "_own")
    )
    # rows equal in everything that is scored differ only in the tie-break: k of them suffice.
    # The hash comes first only to let the sort settle most comparisons on one number.
    scored = [*exact, "case_level", "level", "timestamp", "valid_to", *SCORED]
    return topk_candidates(
        intervals.withColumn("_hash", F.xxhash64(*scored)),
        by=["_hash", *scored],
        order=["match_id", "participant_id"],
        k=p.k,
    ).drop("_hash")


def _cells(prefix: str, p: Calipers, radius: float, *, tilted: bool = False) -> dict[str, Column]:
    """Grid cells one caliper wide: rows within the caliper are in equal or adjacent cells.

    A radius bounds the sum of the three gaps as well, each in calipers, and with it their sums
    of any signs. ``tilted`` cells are cut along three of these sums, which a quarter of the
    volume meets. On the log scale a smaller gap takes at most its share of the width.
    """
    slack = 1 + 1e-9
    gold = F.col(f"{prefix}total_gold").cast("double")
    # a relative gap of at most c is a distance of at most -ln(1-c) on this scale
    log_gold = F.signum(gold) * F.log(F.greatest(F.abs(gold), F.lit(1.0)))
    widths = {
        "_g0": (log_gold, -math.log(1 - p.gold_ratio * radius)),
        "_g1": (F.col(f"{prefix}player_gold_diff_vs_role_opponent"), p.player_gold_gap * radius),
        "_g2": (F.col(f"{prefix}rest_of_team_gold_diff"), p.rest_gold_gap * radius),
    }
    if tilted:
        a, b, c = [value / width for value, width in widths.values()]
        return {name: F.floor(v / slack).cast("bigint") for name, v in zip(widths, (a + b + c, a + b - c, a - b + c), strict=True)}
    return {name: F.floor(value / (width * slack)).cast("bigint") for name, (value, width) in widths.items()}


def _case_keys(
    cases: DataFrame, *, exact: Sequence[str], p: Calipers, radius: float, near: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """Cases once per time bucket and grid cell in which a partner may lie."""
    case = cases.select(
        "case_id",
        *keep,
        *exact,
        F.col("level").cast("int").alias("case_level"),
        F.col("purchase_timestamp").alias("_t"),
        *[F.col(c).alias(f"c_{c}") for c in SCORED],
    ).dropna()
    bucket = F.floor(F.col("_t") / p.max_gap_ms).cast("bigint")
    case = case.withColumn("_bucket", F.explode(F.array(bucket - 1, bucket)))
    for name, cell in _cells("c_", p, radius, tilted=near).items():
        case = case.withColumn(name, F.explode(F.sequence(cell - 1, cell + 1)))
    return case


def _control_keys(intervals: DataFrame, *, p: Calipers, radius: float, near: bool = False) -> DataFrame:
    if near and radius * (1 + 1e-9) < p.level_weight / max(p.level_band, 1):
        intervals = intervals.filter("level = case_level")  # another level alone takes a score out of the radius
    return intervals.withColumn(
        "_bucket", F.floor(F.col("timestamp") / p.max_gap_ms).cast("bigint")
    ).withColumns(_cells("", p, radius, tilted=near))


CELL = ("case_level", "_bucket", "_g0", "_g1", "_g2")


FEW_CASES = 1_000  # cases whose 54 rows each may be broadcast to the controls, some 5 MB


def _pairs(
    cases: DataFrame, intervals: DataFrame, *, exact: Sequence[str], p: Calipers, radius: float, near: bool = False, few: bool = False
) -> DataFrame:
    """Case/control pairs of neighbouring cells within all calipers, scored. With ``near`` only
    those with scores up to the radius plus the case's least possible time term."""
    case = _case_keys(cases, exact=exact, p=p, radius=radius, near=near, keep=["_time_term"] if near else [])
    control = _control_keys(intervals, p=p, radius=radius, near=near)
    # the exploded case side is some 50 times its file size, which the planner cannot see:
    # never let it pick a broadcast from the file size
    joined = case.hint("broadcast" if few else "merge").join(control, [*exact, *CELL])

    def gap(name):
        return F.abs(F.col(name) - F.col(f"c_{name}"))

    gold = relative_gap(F.col("total_gold"), F.col("c_total_gold"))
    terms = [
        gold / p.gold_ratio,
        gap("player_gold_diff_vs_role_opponent") / p.player_gold_gap,
        gap("rest_of_team_gold_diff") / p.rest_gold_gap,
        F.lit(p.level_weight) * F.abs(F.col("level") - F.col("case_level")) / max(p.level_band, 1),
        F.lit(p.time_weight) * (F.col("_t") - F.col("timestamp")) / p.max_gap_ms,
        F.lit(p.player_xp_weight) * gap("player_xp_diff_vs_role_opponent") / p.player_xp_scale,
        F.lit(p.rest_xp_weight) * gap("rest_of_team_xp_diff") / p.rest_xp_scale,
    ]
    score = terms[0]
    for term in terms[1:]:
        score = score + term
    near_enough = score <= F.lit(radius) + F.col("_time_term") if near else F.lit(True)
    return joined.filter(
        near_enough
        & F.col("_t").between(F.col("timestamp"), F.col("valid_to"))
        & (gold <= p.gold_ratio)
        & (gap("player_gold_diff_vs_role_opponent") <= p.player_gold_gap)
        & (gap("rest_of_team_gold_diff") <= p.rest_gold_gap)
    ).select(
        "case_id",
        F.col("match_id").alias("control_match_id"),
        F.col("participant_id").alias("control_participant_id"),
        F.col("timestamp").alias("control_snapshot_timestamp"),
        (F.col("_t") - F.col("timestamp")).alias("control_snapshot_age_ms"),
        score.alias("control_match_state_score"),
    )


def first_radii(
    cases: DataFrame, intervals: DataFrame, *, exact: Sequence[str], p: Calipers, dense: int
) -> DataFrame:
    """(case_id, radius): the widest radius with at most ``dense`` controls around the case.

    Controls are counted per cell and the counts, not the rows, meet the cases. The radius
    halves while some case is still too crowded. Where halving thins nobody's surroundings,
    larger and larger steps are taken, and after five of them, 2**15 in all, the controls are
    taken to stand at one point, which no radius can part.
    """
    settled = []
    radius, before, stuck = 1.0, None, 0
    while True:
        counts = (
            _control_keys(intervals, p=p, radius=radius, near=True).groupBy(*exact, *CELL).agg(F.count(F.lit(1)).alias("_n"))
        )
        found = (
            _case_keys(cases, exact=exact, p=p, radius=radius, near=True)
            .hint("merge")
            .join(counts, [*exact, *CELL])
            .groupBy("case_id")
            .agg(F.sum("_n").alias("_reach"))
        )
        reach = materialise(cases.select("case_id").join(found, "case_id", "left").fillna(0, ["_reach"]), "case_reach")
        denser = reach.filter(F.col("_reach") > dense)
        cases_left, controls_left = denser.agg(F.count(F.lit(1)), F.sum("_reach")).first()
        stuck = stuck + 1 if (cases_left, controls_left) == before else 0
        last = not cases_left or stuck == 5
        before = cases_left, controls_left
        done = reach if last else reach.filter(F.col("_reach") <= dense)
        settled.append(done.select("case_id", F.lit(radius).alias("radius")))
        if last:
            break
        cases = cases.join(denser.select("case_id"), "case_id", "left_semi")
        radius /= 2 ** (1 + stuck)
    return union_all(*settled)


def least_time_terms(cases: DataFrame, intervals: DataFrame, *, exact: Sequence[str], p: Calipers) -> DataFrame:
    """Cases with ``_time_term``: what even the youngest control in reach adds to a score.

    Where snapshots come once a minute this is the same large amount for every control.
    """
    stratum = [*exact, "case_level"]
    instants = intervals.select(*stratum, "timestamp").distinct()
    leveled = cases.withColumn("case_level", F.col("level").cast("int"))
    # many cases share an instant: each is looked up once
    timed = asof_backward(
        leveled.select(*stratum, "purchase_timestamp").distinct(),
        instants,
        by=stratum,
        left_ts="purchase_timestamp",
        right_ts="timestamp",
        payload=[],
        max_age=p.max_gap_ms,
        slice_factor=1,
    )
    term = F.lit(p.time_weight) * F.col("asof_age_ms") / p.max_gap_ms
    terms = timed.select(*stratum, "purchase_timestamp", term.alias("_time_term"))
    return (
        leveled.join(terms, [*stratum, "purchase_timestamp"], "left")
        .select(*cases.columns, F.coalesce("_time_term", F.lit(0.0)).alias("_time_term"))
    )


def nearest_controls(
    cases: DataFrame,
    controls: DataFrame,
    *,
    exact: Sequence[str] = ("region", "team_position"),
    p: Calipers = CALIPERS,
    dense: int = 5_000,
) -> DataFrame:
    """The k best-scored controls of every case, without scoring all pairs of a dense cell.

    Every case first looks within a fraction r of every caliper, the widest with at most
    ``dense`` controls around it. No term of the score is negative, so whatever lies outside
    that reach scores more than r plus the least possible time term: a case that finds k controls
    up to there is finished, the others double r and look again. Those that do not find k within
    a whole caliper, few or in thin places, look at all within the calipers in the end.
    ``dense`` therefore changes the work, never the result.
    """
    order = ["control_match_state_score", *CONTROL_KEY]
    intervals = materialise(control_intervals(controls, exact=exact, p=p), "control_intervals")

    def best(some: DataFrame, radius: float, **how: bool) -> DataFrame:
        pairs = _pairs(some, intervals, exact=exact, p=p, radius=radius, **how)
        return topk_candidates(pairs, by=["case_id"], order=order, k=p.k)

    radii = first_radii(cases, intervals, exact=exact, p=p, dense=dense)
    open_cases = materialise(least_time_terms(cases.join(radii, "case_id"), intervals, exact=exact, p=p), "cases_with_radius")
    parts = []
    sizes = dict(open_cases.groupBy("radius").count().collect())
    radius = min(sizes, default=2.0)
    while radius <= 1.0:
        few = sum(n for r, n in sizes.items() if r <= radius) <= FEW_CASES
        near = materialise(best(open_cases.filter(F.col("radius") <= radius), radius, near=True, few=few), "near_controls")
        finished = near.groupBy("case_id").count().filter(F.col("count") >= p.k).select("case_id")
        parts.append(near.join(finished, "case_id", "left_semi"))
        open_cases = open_cases.join(finished, "case_id", "left_anti")
        radius *= 2
    return union_all(*parts, best(open_cases, 1.0))


def caliper_candidates(
    cases: DataFrame,
    controls: DataFrame,
    *,
    exact: Sequence[str] = ("region", "team_position"),
    p: Calipers = CALIPERS,
    dense: int = 5_000,
) -> DataFrame:
    """Candidate pool: nearest controls with the state of both sides.

    The search runs on narrow rows; the wide state is attached to the k survivors only.
    ``controls`` must be unique per (match, participant, timestamp).
    """
    found = nearest_controls(cases, controls, exact=exact, p=p, dense=dense)
    case_side = cases.select(
        "case_id",
        "match_id",
        F.col("participant_id").alias("case_participant_id"),
        F.col("purchase_timestamp").alias("case_purchase_timestamp"),
        F.col("lifecycle_status").alias("case_lifecycle_status"),
        *exact,
        *[F.col(c).alias(f"case_player_{c}") for c in PLAYER_MEASURES],
        *[F.col(c).alias(f"case_{c}") for c in STATE_COLUMNS],
    )
    control_side = controls.select(
        F.col("match_id").alias("control_match_id"),
        F.col("participant_id").alias("control_participant_id"),
        F.col("timestamp").alias("control_snapshot_timestamp"),
        "champion_id",
        "champion_name",
        "team_id",
        F.col("win").alias("outcome_win"),
        *[F.col(c).alias(f"control_player_{c}") for c in PLAYER_MEASURES],
        *[F.col(c).alias(f"control_{c}") for c in STATE_COLUMNS],
    )
    return found.join(control_side, list(CONTROL_KEY)).join(case_side, "case_id")


def pool_summary(pool: DataFrame) -> DataFrame:
    """Long form (section, item, rows) of the pool's size, spread and outcome."""
    totals = pool.agg(
        F.count(F.lit(1)).alias("candidate_rows"),
        F.countDistinct("case_id").alias("cases"),
        F.countDistinct("control_match_id").alias("control_matches"),
        F.countDistinct("control_match_id", "control_participant_id").alias("control_players"),
    )
    total_rows = totals.unpivot([], totals.columns, "item", "rows").withColumn("section", F.lit("total"))
    per_case = (
        pool.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(F.col("n").cast("string").alias("item"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("section", F.lit("controls_per_case"))
    )
    outcome = (
        pool.groupBy(F.coalesce(F.col("outcome_win").cast("string"), F.lit("missing")).alias("item"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("section", F.lit("outcome"))
    )
    champions = (
        pool.filter("champion_name is not null")
        .groupBy(F.col("champion_name").alias("item"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("rows"), "item")
        .limit(15)
        .withColumn("section", F.lit("top_champions"))
    )
    return union_all(total_rows, per_case, outcome, champions).select("section", "item", "rows")

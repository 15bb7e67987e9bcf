"""State attachment: dimensions, team totals, role opponents, the case dataset."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import observation_key
from ..params import ASOF, PLAYER_MEASURES, TEAM_MEASURES
from ..sources.tables import PARTICIPANTS
from .asof import asof_backward

CS = {"total_gold": "total_gold", "xp": "xp", "minions_killed": "cs"}


def attach_dimension(fact: DataFrame, dim: DataFrame, *, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Many-to-one left join. A key that occurs twice in the dimension fails the query.

    The check is a count of its own, read as a scalar subquery. That leaves the join a plain
    shuffle on both sides, which AQE can split where one key holds much of the fact table.
    """
    keys = F.concat_ws(" ", *[F.col(k).cast("string") for k in key])
    repeated = (
        dim.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .agg(F.min(keys))
        .scalar()
    )
    message = F.concat(F.lit("dimension key is not unique: "), repeated)
    # the check rides on a key column: a join key is never pruned away
    first = F.when(repeated.isNotNull(), F.raise_error(message).cast(dim.schema[key[0]].dataType)).otherwise(
        F.col(key[0])
    )
    checked = dim.select(first.alias(key[0]), *key[1:], *columns)
    kept = [name for name in fact.columns if name not in columns]
    return fact.select(*kept).join(checked, list(key), "left").select(*kept, *columns)


def _filled(total: Column) -> Column:
    return F.coalesce(total, F.lit(0))


def team_totals(
    snapshots: DataFrame, *, match: str, ts: str, team: str, measures: Sequence[str]
) -> DataFrame:
    """One row per (match, ts, team): ``<m>_team`` and ``<m>_match`` totals.

    Rows are reduced per team before anything is shuffled; the match total is then a window
    over the few team rows.
    """
    per_team = snapshots.groupBy(match, ts, team).agg(
        *[_filled(F.sum(m)).alias(f"{m}_team") for m in measures]
    )
    whole = Window.partitionBy(match, ts)
    return per_team.select(
        "*", *[F.sum(f"{m}_team").over(whole).alias(f"{m}_match") for m in measures]
    )


def team_window_totals(
    state: DataFrame, *, match: str, ts: str, team: str, measures: dict[str, str]
) -> DataFrame:
    """Adds ``team_<m>``, ``enemy_<m>`` (match minus team) and ``team_<m>_diff``."""
    usable = state.dropna(subset=[team])
    totals = team_totals(usable, match=match, ts=ts, team=team, measures=list(measures))
    joined = usable.join(totals, [match, ts, team])
    return joined.select(*state.columns, *_team_columns(measures))


def _team_columns(measures: dict[str, str]) -> list[Column]:
    columns = []
    for source, name in measures.items():
        own = F.col(f"{source}_team")
        enemy = F.col(f"{source}_match") - own
        columns += [
            own.alias(f"team_{name}"),
            enemy.alias(f"enemy_{name}"),
            (own - enemy).alias(f"team_{name}_diff"),
        ]
    return columns


def _opponent_heads(
    state: DataFrame, *, match: str, ts: str, position: str, team: str, entity: str, measures: Sequence[str]
) -> DataFrame:
    """Lowest-numbered player of another team, per (match, ts, position, team).

    Only each team's lowest player can be somebody's lowest opponent, so the comparison runs
    over one row per team instead of over player pairs.
    """
    # min_by over plain columns keeps this a hash aggregation; a struct minimum would sort
    heads = (
        state.groupBy(match, ts, position, team)
        .agg(F.min(entity).alias("_id"), *[F.min_by(m, entity).alias(f"_{m}") for m in measures])
        .select(
            match,
            ts,
            position,
            team,
            F.struct(F.col("_id").alias("id"), *[F.col(f"_{m}").alias(m) for m in measures]).alias("_head"),
        )
    )
    group = Window.partitionBy(match, ts, position)
    first = heads.withColumn("_first", F.min(F.struct(F.col("_head.id"), F.col(team).alias("team"), "_head")).over(group))
    # the best opponent of the leading team is the best head outside that team
    second = first.withColumn(
        "_second", F.min(F.when(F.col(team) != F.col("_first.team"), F.col("_head"))).over(group)
    )
    return second.select(
        match,
        ts,
        position,
        team,
        F.when(F.col("_first.team") != F.col(team), F.col("_first._head")).otherwise(F.col("_second")).alias("_opp"),
    ).filter("_opp is not null")


def role_opponent(
    state: DataFrame,
    *,
    match: str,
    ts: str,
    position: str,
    team: str,
    entity: str,
    measures: Sequence[str],
) -> DataFrame:
    """Rows that have an opponent in the same position, with its id and measures."""
    usable = state.dropna(subset=[team, entity, position])
    heads = _opponent_heads(
        usable, match=match, ts=ts, position=position, team=team, entity=entity, measures=measures
    )
    return usable.join(heads, [match, ts, position, team]).select(
        *state.columns,
        F.col("_opp.id").alias(f"role_opponent_{entity}"),
        *[F.col("_opp")[m].alias(f"role_opponent_{m}") for m in measures],
    )


def state_features(snapshots: DataFrame, participants: DataFrame | None = None) -> DataFrame:
    """Whole-team state, same-role opponent and the derived differences of every snapshot.

    One summary per (match, timestamp, team, position) feeds team totals, match totals and
    opponents; the snapshot rows themselves are shuffled once, to meet it.
    """
    if participants is not None:
        snapshots = attach_dimension(
            snapshots,
            participants,
            key=["match_id", "participant_id"],
            columns=["team_id", "team_position", "champion_id", "champion_name", "win"],
        )
    usable = snapshots.dropna(subset=["team_id", "participant_id", "team_position"]).withColumn(
        "team_position", F.upper(F.trim("team_position"))
    )
    summary = (
        usable.groupBy("match_id", "timestamp", "team_position", "team_id")
        .agg(
            F.min("participant_id").alias("_id"),
            F.min_by("total_gold", "participant_id").alias("_g"),
            F.min_by("xp", "participant_id").alias("_x"),
            *[_filled(F.sum(m)).alias(f"_{m}") for m in CS],
        )
        .withColumn("_head", F.struct(F.col("_id").alias("id"), F.col("_g").alias("total_gold"), F.col("_x").alias("xp")))
    )
    match_w = Window.partitionBy("match_id", "timestamp")
    team_w = Window.partitionBy("match_id", "timestamp", "team_id")
    position_w = Window.partitionBy("match_id", "timestamp", "team_position")
    summary = summary.select(
        "*",
        *[F.sum(f"_{m}").over(match_w).alias(f"{m}_match") for m in CS],
        *[F.sum(f"_{m}").over(team_w).alias(f"{m}_team") for m in CS],
        F.min(F.struct(F.col("_head.id"), F.col("team_id").alias("team"), "_head")).over(position_w).alias("_first"),
    ).withColumn(
        "_second",
        F.min(F.when(F.col("team_id") != F.col("_first.team"), F.col("_head"))).over(position_w),
    )
    opponent = F.when(F.col("_first.team") != F.col("team_id"), F.col("_first._head")).otherwise(F.col("_second"))
    lookup = summary.select(
        "match_id",
        "timestamp",
        "team_position",
        "team_id",
        opponent.alias("_opp"),
        *_team_columns(CS),
    ).filter("_opp is not null")
    gold_diff = F.col("total_gold") - F.col("_opp.total_gold")
    xp_diff = F.col("xp") - F.col("_opp.xp")
    return usable.join(lookup, ["match_id", "timestamp", "team_position", "team_id"]).select(
        *usable.columns,
        *[c for name in CS.values() for c in (f"team_{name}", f"enemy_{name}", f"team_{name}_diff")],
        F.col("_opp.id").alias("role_opponent_participant_id"),
        F.col("_opp.total_gold").alias("role_opponent_total_gold"),
        F.col("_opp.xp").alias("role_opponent_xp"),
        gold_diff.alias("player_gold_diff_vs_role_opponent"),
        xp_diff.alias("player_xp_diff_vs_role_opponent"),
        (F.col("team_total_gold_diff") - gold_diff).alias("rest_of_team_gold_diff"),
        (F.col("team_xp_diff") - xp_diff).alias("rest_of_team_xp_diff"),
    )


def time_bucket(ts: Column, *, bucket_ms: int = 30_000) -> Column:
    return F.floor(ts / bucket_ms).cast("bigint")


def team_vs_enemy_at_ts(
    obs: DataFrame, snapshots: DataFrame, *, match: str, obs_ts: str, snap_ts: str, team: str, measures: Sequence[str]
) -> DataFrame:
    """Sums at one instant for the observer's team and for everyone else, including rows
    without a team. Adds ``team_<m>_sum``, ``enemy_<m>_sum`` and ``team_<m>_diff``.

    An instant is one row that holds the sums of its few teams, so observers meet it in one join.
    Dealing the rows by instant serves both sums and the join.
    """
    rows = snapshots.select(match, F.col(snap_ts).alias(obs_ts), F.col(team).alias("_team"), *measures)
    per_team = rows.repartition(match, obs_ts).groupBy(match, obs_ts, "_team").agg(
        *[_filled(F.sum(m)).alias(f"_{m}") for m in measures]
    )
    sums = [f"_{m}" for m in measures]
    at = per_team.groupBy(match, obs_ts).agg(
        *[F.sum(f"_{m}").alias(f"{m}_match") for m in measures],
        F.collect_list(F.when(F.col("_team").isNotNull(), F.struct("_team", *sums))).alias("_teams"),
    )
    own = F.filter("_teams", lambda x: x["_team"] == F.col(team))
    whole = [f"{m}_match" for m in measures]
    joined = obs.join(at, [match, obs_ts], "left").select(*obs.columns, *whole, F.get(own, F.lit(0)).alias("_own"))
    columns = []
    for m in measures:
        mine = F.when(F.col(f"{m}_match").isNotNull(), _filled(F.col("_own")[f"_{m}"]))
        rest = F.col(f"{m}_match") - mine
        columns += [
            mine.alias(f"team_{m}_sum"),
            rest.alias(f"enemy_{m}_sum"),
            (mine - rest).alias(f"team_{m}_diff"),
        ]
    return joined.select(*obs.columns, *columns)


# what a participant row says beside who the player was and what the inventory held
WHO = ("match_id", "participant_id", "puuid", "team_id", "team_position", "champion_id", "champion_name", "win")
OUTCOME_COLUMNS = tuple(
    name for name in (part.split()[0] for part in PARTICIPANTS.split(", ")) if name not in WHO and not name.startswith("item")
)


def case_dataset(
    episodes: DataFrame,
    matches: DataFrame,
    participants: DataFrame,
    snapshots: DataFrame,
    *,
    max_age: int = ASOF.max_age_ms,
) -> DataFrame:
    """One row per episode with context, state, outcome and ``failure`` (null for a case).

    ``participants`` must be unique per (match, participant). The failure is the first of the
    ordered checks that does not hold. Snapshots and participants of matches without an episode
    change nothing; a caller with many of them cuts them before.
    """
    snaps = snapshots
    first_seen = snaps.groupBy("match_id", "participant_id").agg(F.min("timestamp").alias("_first_ts"))
    any_seen = first_seen.select("match_id").distinct().withColumn("_has_snapshots", F.lit(True))
    match_cols = ["game_version", "queue_id", "map_id", "game_duration", "end_of_game_result", "region"]
    people = ["team_id", "team_position", "champion_id", "champion_name", "win", *OUTCOME_COLUMNS]

    base = (
        episodes.join(matches.select("match_id", *match_cols, F.lit(True).alias("_has_match")), "match_id", "left")
        .join(
            participants.select("match_id", "participant_id", *people, F.lit(True).alias("_has_player")),
            ["match_id", "participant_id"],
            "left",
        )
        .join(any_seen, "match_id", "left")
        .join(first_seen, ["match_id", "participant_id"], "left")
    )
    # asof_backward keeps every left row, unmatched ones with null state
    with_state = asof_backward(
        base,
        snaps,
        by=["match_id", "participant_id"],
        left_ts="purchase_timestamp",
        right_ts="timestamp",
        payload=[*PLAYER_MEASURES, "position_x", "position_y"],
        max_age=max_age,
    )
    teams = participants.select("match_id", "participant_id", "team_id")
    snaps_with_team = snaps.join(teams, ["match_id", "participant_id"], "left")
    full = team_vs_enemy_at_ts(
        with_state,
        snaps_with_team,
        match="match_id",
        obs_ts="asof_timestamp",
        snap_ts="timestamp",
        team="team_id",
        measures=TEAM_MEASURES,
    )
    failure = (
        F.when(F.col("_has_match").isNull(), "missing_match")
        .when(F.col("_has_player").isNull(), "missing_participant")
        .when(F.col("team_id").isNull(), "missing_team_id")
        .when(F.col("_has_snapshots").isNull(), "missing_snapshots")
        .when(
            F.col("_first_ts").isNull() | (F.col("_first_ts") > F.col("purchase_timestamp")),
            "missing_pre_purchase_snapshot",
        )
        .when(F.col("asof_timestamp").isNull(), "invalid_snapshot_timing")
    )
    return full.select(
        observation_key("match_id", "participant_id", "purchase_timestamp").alias("case_id"),
        "match_id",
        "participant_id",
        "region",
        "purchase_timestamp",
        (F.col("purchase_timestamp") / 1000).alias("purchase_time_seconds"),
        F.col("status").alias("lifecycle_status"),
        "game_version",
        "queue_id",
        "map_id",
        "team_id",
        "team_position",
        "champion_id",
        "champion_name",
        F.col("asof_timestamp").alias("snapshot_timestamp"),
        F.col("asof_age_ms").alias("snapshot_age_ms"),
        *[F.col(m).alias(f"player_{m}") for m in (*PLAYER_MEASURES, "position_x", "position_y")],
        *[f"{side}_{m}_sum" for m in TEAM_MEASURES for side in ("team", "enemy")],
        "team_total_gold_diff",
        "team_current_gold_diff",
        "team_xp_diff",
        F.col("team_minions_killed_diff").alias("team_cs_diff"),
        F.col("win").alias("outcome_win"),
        *[F.col(c).alias(f"outcome_final_{c}") for c in OUTCOME_COLUMNS],
        F.col("game_duration").alias("outcome_game_duration"),
        F.col("end_of_game_result").alias("outcome_game_result"),
        failure.alias("failure"),
    )

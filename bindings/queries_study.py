"""Manifest, episodes, state, candidates, matching, balance and outcomes."""

from pyspark.sql import functions as F

from cohortloom.functions.columns import observation_key
from cohortloom.functions.frames import union_all
from cohortloom.operators import asof, balance, candidates, episodes, manifest, matching, outcomes, profile, reach, state
from cohortloom.params import PLAYER_MEASURES, STATE_COLUMNS, TEAM_MEASURES

from . import tables
from .ctes import _FEATURES, _SUFFIXES, SAMPLES, per_sample, rounded
from .registry import query

EVENT_MS = "unix_micros(CAST(ts AS TIMESTAMP)) DIV 1000"
HOUR = 3_600_000


def log(spark, sf):
    """The given event table with epoch milliseconds."""
    return tables.read(spark, sf, "events").selectExpr("event_id", "user_id", "event_type", "value", f"{EVENT_MS} AS at_ms")


# --- joins ---------------------------------------------------------------------------


@query(
    "semi_eligible",
    "SELECT match_id, event_seq, event_type, timestamp FROM e SEMI JOIN (SELECT match_id FROM man WHERE analysis_eligible) USING (match_id)",
)
def semi_eligible(spark, sf):
    s = tables.study(spark, sf)
    return manifest.semi_eligible(s.events, s.manifest).select("match_id", "event_seq", "event_type", "timestamp")


@query(
    "anti_control_matches",
    "SELECT match_id, storage_partition FROM man WHERE analysis_eligible AND match_id NOT IN (SELECT match_id FROM ep)",
)
def anti_control_matches(spark, sf):
    s = tables.study(spark, sf)
    return manifest.anti_control_matches(s.manifest.filter("analysis_eligible"), s.episodes).select(
        "match_id", "storage_partition"
    )


@query(
    "orphan_keys",
    """SELECT 'order_without_line' AS check_name, count(*) AS keys FROM (SELECT DISTINCT o_orderkey FROM orders
      WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
    UNION ALL SELECT 'line_without_order', count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem
      WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
    UNION ALL SELECT 'player_without_snapshot', count(*) FROM (SELECT match_id, participant_id FROM p EXCEPT SELECT match_id, participant_id FROM s)""",
)
def orphan_keys(spark, sf):
    orders, lines = tables.read(spark, sf, "orders"), tables.read(spark, sf, "lineitem")
    one = manifest.orphan_keys(
        orders.select("o_orderkey"), lines.select(F.col("l_orderkey").alias("o_orderkey")), key=["o_orderkey"]
    )
    two = manifest.orphan_keys(lines.select(F.col("l_orderkey").alias("o_orderkey")), orders.select("o_orderkey"), key=["o_orderkey"])
    three = manifest.orphan_keys(tables.participants(spark, sf), tables.snapshots(spark, sf), key=["match_id", "participant_id"])

    def counted(df, name):
        return df.agg(F.lit(name).alias("check_name"), F.count(F.lit(1)).alias("keys"))

    return union_all(counted(one, "order_without_line"), counted(two, "line_without_order"), counted(three, "player_without_snapshot"))


@query(
    "asof_backward",
    """WITH ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS at_ms FROM events)
    SELECT o.event_id, o.user_id, o.at_ms, CASE WHEN o.at_ms - v.at_ms <= 172800000 THEN v.at_ms END AS asof_timestamp,
           CASE WHEN o.at_ms - v.at_ms <= 172800000 THEN o.at_ms - v.at_ms END AS asof_age_ms,
           CASE WHEN o.at_ms - v.at_ms <= 172800000 THEN round(v.value, 6) END AS value
    FROM (SELECT * FROM ev WHERE event_type = 'purchase') o
    LEFT JOIN LATERAL (SELECT * FROM ev v WHERE v.event_type = 'view' AND v.user_id = o.user_id AND v.at_ms <= o.at_ms
                       ORDER BY v.at_ms DESC, v.event_id DESC LIMIT 1) v ON true""",
)
def asof_backward(spark, sf):
    ev = log(spark, sf)
    return asof.asof_backward(
        ev.filter("event_type = 'purchase'").select("event_id", "user_id", "at_ms"),
        ev.filter("event_type = 'view'").select("user_id", F.col("at_ms").alias("seen_at"), "event_id", "value"),
        by=["user_id"],
        left_ts="at_ms",
        right_ts="seen_at",
        payload=["value"],
        tie=["event_id"],
        max_age=48 * HOUR,
        slice_factor=1,
    )


@query(
    "attach_dimension",
    """SELECT s.match_id, s.timestamp, s.participant_id, s.total_gold, p.team_id, p.team_position, p.champion_name
    FROM s LEFT JOIN p USING (match_id, participant_id)""",
)
def attach_dimension(spark, sf):
    return state.attach_dimension(
        tables.snapshots(spark, sf).select("match_id", "timestamp", "participant_id", "total_gold"),
        tables.participants(spark, sf),
        key=["match_id", "participant_id"],
        columns=["team_id", "team_position", "champion_name"],
    )


# an instant without any state has no sums
_SUM = "CASE WHEN count(x.match_id) > 0 THEN coalesce(sum(x.{m}) FILTER (x.team_id IS {not_} DISTINCT FROM o.team_id), 0) END"
_TEAM_SUMS = ", ".join(
    f"CAST({a} AS BIGINT) AS team_{m}_sum, CAST({b} AS BIGINT) AS enemy_{m}_sum, CAST({a} - {b} AS BIGINT) AS team_{m}_diff"
    for m in TEAM_MEASURES
    for a, b in [(_SUM.format(m=m, not_="NOT"), _SUM.format(m=m, not_=""))]
)


@query(
    "team_vs_enemy_at_ts",
    f"""SELECT o.match_id, o.participant_id, o.at_ms, o.team_id, {_TEAM_SUMS}
    FROM (SELECT match_id, participant_id, team_id, unnest([0, 60000, 120000, 180000])::BIGINT AS at_ms FROM p) o
    LEFT JOIN (SELECT s.*, p.team_id FROM s LEFT JOIN p USING (match_id, participant_id)) x
      ON x.match_id = o.match_id AND x.timestamp = o.at_ms
    GROUP BY ALL""",
)
def team_vs_enemy_at_ts(spark, sf):
    people = tables.participants(spark, sf)
    teams = people.select("match_id", "participant_id", "team_id")
    snaps = tables.snapshots(spark, sf).join(teams, ["match_id", "participant_id"], "left")
    frames = F.explode(F.array(*[F.lit(f * 60_000).cast("bigint") for f in range(4)]))
    obs = people.select("match_id", "participant_id", "team_id", frames.alias("at_ms"))
    return state.team_vs_enemy_at_ts(
        obs, snaps, match="match_id", obs_ts="at_ms", snap_ts="timestamp", team="team_id", measures=TEAM_MEASURES
    )


@query(
    "role_opponent",
    """SELECT t.match_id, t.timestamp, t.participant_id, t.total_gold, o.participant_id AS role_opponent_participant_id,
      o.total_gold AS role_opponent_total_gold, o.xp AS role_opponent_xp
    FROM sp t JOIN sp o ON t.match_id = o.match_id AND t.timestamp = o.timestamp AND t.team_position = o.team_position
      AND t.team_id <> o.team_id
    QUALIFY row_number() OVER (PARTITION BY t.match_id, t.timestamp, t.participant_id ORDER BY o.participant_id) = 1""",
)
def role_opponent(spark, sf):
    return state.role_opponent(
        placed(spark, sf),
        match="match_id",
        ts="timestamp",
        position="team_position",
        team="team_id",
        entity="participant_id",
        measures=["total_gold", "xp"],
    ).select(
        "match_id",
        "timestamp",
        "participant_id",
        "total_gold",
        "role_opponent_participant_id",
        "role_opponent_total_gold",
        "role_opponent_xp",
    )


def placed(spark, sf):
    """Snapshots of eligible matches with team and position."""
    s = tables.study(spark, sf)
    eligible = s.manifest.filter("analysis_eligible and storage_partition is not null").select("match_id")
    people = s.participants.select("match_id", "participant_id", "team_id", "team_position")
    return s.snapshots_of(eligible).join(people, ["match_id", "participant_id"], "left")


@query(
    "caliper_candidates",
    """SELECT case_id, control_match_id, control_participant_id, control_snapshot_timestamp, control_snapshot_age_ms,
    round(control_match_state_score, 6) AS control_match_state_score, control_player_total_gold, case_player_total_gold,
    control_rest_of_team_gold_diff, case_rest_of_team_gold_diff, outcome_win FROM pool""",
)
def caliper_candidates(spark, sf):
    return tables.study(spark, sf).pool.select(
        "case_id",
        "control_match_id",
        "control_participant_id",
        "control_snapshot_timestamp",
        "control_snapshot_age_ms",
        "control_match_state_score",
        "control_player_total_gold",
        "case_player_total_gold",
        "control_rest_of_team_gold_diff",
        "case_rest_of_team_gold_diff",
        "outcome_win",
    )


@query(
    "recent_window_join",
    """WITH ev AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS at_ms FROM events)
    SELECT o.user_id, o.at_ms,
      (SELECT count(*) FROM ev c WHERE c.user_id = o.user_id AND c.event_type = 'click' AND c.at_ms >= o.at_ms - 259200000 AND c.at_ms < o.at_ms) AS clicks,
      (SELECT count(*) FROM ev c WHERE c.user_id = o.user_id AND c.event_type = 'view' AND c.at_ms >= o.at_ms - 259200000 AND c.at_ms < o.at_ms) AS views,
      EXISTS (SELECT 1 FROM ev c WHERE c.user_id = o.user_id AND c.event_type = 'error' AND c.at_ms < o.at_ms)::INT::BIGINT AS error_before
    FROM (SELECT DISTINCT user_id, at_ms FROM ev WHERE event_type = 'purchase') o""",
)
def recent_window_join(spark, sf):
    ev = log(spark, sf)
    return asof.recent_window_counts(
        ev.filter("event_type = 'purchase'").select("user_id", "at_ms"),
        ev.filter("event_type in ('click', 'view', 'error')").select("user_id", "at_ms", F.col("event_type").alias("kind")),
        by=["user_id"],
        obs_ts="at_ms",
        mark_ts="at_ms",
        counted={"clicks": "click", "views": "view"},
        ever={"error_before": "error"},
        window_ms=72 * HOUR,
        slice_factor=1,
    )


@query(
    "recent_event_features",
    "SELECT * FROM feat",
)
def recent_event_features(spark, sf):
    return tables.study(spark, sf).features


@query(
    "case_control_pairing",
    """SELECT matched_set_id, round(case_value, 6) AS case_value, round(control_mean, 6) AS control_mean,
    round(case_value - control_mean, 6) AS difference FROM pairs WHERE covariate = 'player_total_gold'""",
)
def case_control_pairing(spark, sf):
    return balance.case_control_pairing(tables.study(spark, sf).primary_long, value="player_total_gold")


@query(
    "category_outer_join",
    """SELECT covariate, category, round(case_proportion, 6) AS case_proportion, round(control_proportion, 6) AS control_proportion,
    round(case_proportion - control_proportion, 6) AS proportion_difference FROM shares""",
)
def category_outer_join(spark, sf):
    return balance.category_outer_join(tables.study(spark, sf).primary_long)


# --- manifest and episodes -----------------------------------------------------------


@query("participant_structure", "SELECT * FROM struct_")
def participant_structure(spark, sf):
    return manifest.participant_structure(tables.participants(spark, sf), expected_ids=None)


@query("match_manifest", "SELECT * FROM man")
def match_manifest(spark, sf):
    return tables.study(spark, sf).manifest


@query(
    "manifest_summary",
    """SELECT coalesce(storage_partition, r) AS region, count(*) AS total_matches, count(*) FILTER (analysis_eligible) AS eligible_matches,
      count(*) FILTER (NOT analysis_eligible) AS excluded_matches, round(avg(analysis_eligible::INT), 6) AS eligibility_rate
    FROM (SELECT *, NULL AS r FROM man UNION ALL SELECT * REPLACE ('ALL' AS storage_partition), 'ALL' FROM man) GROUP BY ALL""",
)
def manifest_summary(spark, sf):
    return manifest.manifest_summary(tables.study(spark, sf).manifest)


@query(
    "exclusion_counts",
    "SELECT exclusion_reason, count(*) AS matches FROM man WHERE NOT analysis_eligible GROUP BY 1",
)
def exclusion_counts(spark, sf):
    return manifest.exclusion_counts(tables.study(spark, sf).manifest)


@query(
    "event_type_counts",
    """SELECT CASE WHEN event_seq % 7 = 0 THEN NULL ELSE event_type END AS event_type, count(*) AS events
    FROM e WHERE match_id IN (SELECT match_id FROM el) GROUP BY 1""",
)
def event_type_counts(spark, sf):
    s = tables.study(spark, sf)
    eligible = manifest.semi_eligible(s.events, s.manifest)
    return episodes.event_type_counts(
        eligible.select(F.when(F.col("event_seq") % 7 != 0, F.col("event_type")).alias("event_type"))
    )


_USER_EPISODES = """
    SELECT user_id, at_ms AS purchase_timestamp, CASE WHEN nk = 'signup' THEN nat END AS sale_timestamp,
      CASE WHEN nk = 'signup' THEN nat - at_ms END AS time_held_ms,
      CASE WHEN nk IS NULL THEN 'RETAINED' WHEN nk = 'signup' THEN 'SOLD' WHEN nk = 'error' THEN 'UNDONE'
           ELSE 'PURCHASED_AGAIN_BEFORE_SALE' END AS status
    FROM (SELECT *, lead(event_type) OVER w AS nk, lead(at_ms) OVER w AS nat
          FROM (SELECT user_id, event_id, event_type, epoch_us(ts) // 1000 AS at_ms FROM events
                WHERE event_type IN ('purchase', 'error', 'signup'))
          WINDOW w AS (PARTITION BY user_id ORDER BY at_ms, event_id))
    WHERE event_type = 'purchase'"""


def user_episodes(spark, sf):
    kind = F.col("event_type")
    return episodes.episode_reconstruct(
        log(spark, sf),
        by=["user_id"],
        ts="at_ms",
        seq=["event_id"],
        open_when=kind == "purchase",
        undo_when=kind == "error",
        close_when=kind == "signup",
        slice_ms=24 * HOUR,
    )


@query("episode_reconstruct", _USER_EPISODES)
def episode_reconstruct(spark, sf):
    return user_episodes(spark, sf)


@query("item_episodes", "SELECT * FROM ep")
def item_episodes(spark, sf):
    return tables.study(spark, sf).episodes


@query(
    "episode_state_counts",
    f"""WITH ue AS ({_USER_EPISODES}), v AS (SELECT user_id, event_id, value, epoch_us(ts) // 1000 AS at_ms FROM events WHERE event_type = 'view')
    SELECT status, count(*) AS episodes, count(value) AS with_state, round(avg(value), 6) AS mean_value,
           round(avg(time_held_ms), 6) AS mean_held_ms
    FROM (SELECT ue.*, (SELECT value FROM v WHERE v.user_id = ue.user_id AND v.at_ms <= ue.purchase_timestamp
            AND v.at_ms >= (SELECT max(v2.at_ms) FROM v v2 WHERE v2.user_id = ue.user_id AND v2.at_ms <= ue.purchase_timestamp)
            AND v.at_ms >= ue.purchase_timestamp - 172800000 ORDER BY v.event_id DESC LIMIT 1) AS value FROM ue)
    GROUP BY status""",
)
def episode_state_counts(spark, sf):
    """Flagship: episodes, each with the user's last view of the preceding 48 hours, per status."""
    views = log(spark, sf).filter("event_type = 'view'").select("user_id", F.col("at_ms").alias("seen_at"), "event_id", "value")
    with_state = asof.asof_backward(
        user_episodes(spark, sf),
        views,
        by=["user_id"],
        left_ts="purchase_timestamp",
        right_ts="seen_at",
        payload=["value"],
        tie=["event_id"],
        max_age=48 * HOUR,
        slice_factor=1,
    )
    return with_state.groupBy("status").agg(
        F.count(F.lit(1)).alias("episodes"),
        F.count("value").alias("with_state"),
        F.avg("value").alias("mean_value"),
        F.avg("time_held_ms").alias("mean_held_ms"),
    )


@query(
    "episode_summary",
    """SELECT coalesce(status, 'ALL') AS status, count(*) AS episodes, count(DISTINCT match_id) AS matches,
      count(DISTINCT concat(match_id, '/', participant_id)) AS players,
      CASE WHEN status IS NOT NULL THEN round(avg(time_held_ms), 6) END AS mean_held_ms,
      CASE WHEN status IS NOT NULL THEN min(time_held_ms) END AS min_held_ms,
      CASE WHEN status IS NOT NULL THEN max(time_held_ms) END AS max_held_ms,
      CASE WHEN status IS NOT NULL THEN round(quantile_cont(time_held_ms, 0.5), 6) END AS median_held_ms
    FROM ep GROUP BY GROUPING SETS ((), (status))""",
)
def episode_summary(spark, sf):
    return episodes.episode_summary(tables.study(spark, sf).episodes)


# --- state and case dataset ----------------------------------------------------------


@query(
    "latest_per_entity",
    """SELECT match_id, participant_id, timestamp, total_gold FROM s
    QUALIFY row_number() OVER (PARTITION BY match_id, participant_id ORDER BY timestamp DESC) = 1""",
)
def latest_per_entity(spark, sf):
    snaps = tables.snapshots(spark, sf)
    return candidates.latest_per_entity(
        snaps.select("match_id", "participant_id", "timestamp", "total_gold"),
        by=["match_id", "participant_id"],
        order=["timestamp"],
    )


@query(
    "team_window_totals",
    "SELECT match_id, timestamp, participant_id, team_id, "
    + ", ".join(
        f"(sum({c}) OVER t)::BIGINT AS team_{n}, (sum({c}) OVER g - sum({c}) OVER t)::BIGINT AS enemy_{n}, "
        f"(2 * sum({c}) OVER t - sum({c}) OVER g)::BIGINT AS team_{n}_diff"
        for c, n in {"total_gold": "total_gold", "xp": "xp", "minions_killed": "cs"}.items()
    )
    + " FROM sp WINDOW t AS (PARTITION BY match_id, timestamp, team_id), g AS (PARTITION BY match_id, timestamp)",
)
def team_window_totals(spark, sf):
    keep = ["match_id", "timestamp", "participant_id", "team_id"]
    return state.team_window_totals(
        placed(spark, sf), match="match_id", ts="timestamp", team="team_id", measures=state.CS
    ).select(*keep, *[f"{side}_{n}{end}" for n in state.CS.values() for side, end in (("team", ""), ("enemy", ""), ("team", "_diff"))])


@query(
    "state_features",
    f"SELECT match_id, timestamp, participant_id, region, {', '.join(STATE_COLUMNS)}, timestamp // 30000 AS time_bucket FROM st",
)
def state_features(spark, sf):
    return (
        tables.study(spark, sf)
        .states.withColumn("time_bucket", state.time_bucket(F.col("timestamp")))
        .select("match_id", "timestamp", "participant_id", "region", *STATE_COLUMNS, "time_bucket")
    )


_CASE_ROUNDED = "SELECT * REPLACE (round(purchase_time_seconds, 6) AS purchase_time_seconds)"


@query("case_dataset", f"{_CASE_ROUNDED} FROM cases")
def case_dataset(spark, sf):
    return tables.study(spark, sf).cases.withColumn("failure", F.lit(None).cast("string"))


@query("case_failures", "SELECT failure, count(*) AS episodes FROM att WHERE failure IS NOT NULL GROUP BY 1")
def case_failures(spark, sf):
    attempts = tables.study(spark, sf).case_attempts
    return attempts.filter("failure is not null").groupBy("failure").agg(F.count(F.lit(1)).alias("episodes"))


# --- candidates and matching ---------------------------------------------------------


@query(
    "topk_candidates",
    """SELECT case_id, control_match_id, control_participant_id, round(control_match_state_score, 6) AS control_match_state_score
    FROM pool QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY control_match_state_score, control_match_id,
      control_participant_id, control_snapshot_timestamp) <= 5""",
)
def topk_candidates(spark, sf):
    return candidates.topk_candidates(
        tables.study(spark, sf).pool, by=["case_id"], order=["control_match_state_score", *candidates.CONTROL_KEY], k=5
    ).select("case_id", "control_match_id", "control_participant_id", "control_match_state_score")


@query(
    "pool_summary",
    """SELECT 'total' AS section, 'candidate_rows' AS item, count(*) AS rows FROM pool
    UNION ALL SELECT 'total', 'cases', count(DISTINCT case_id) FROM pool
    UNION ALL SELECT 'total', 'control_matches', count(DISTINCT control_match_id) FROM pool
    UNION ALL SELECT 'total', 'control_players', count(DISTINCT concat(control_match_id, '/', control_participant_id)) FROM pool
    UNION ALL SELECT 'controls_per_case', CAST(n AS STRING), count(*) FROM (SELECT count(*) AS n FROM pool GROUP BY case_id) GROUP BY n
    UNION ALL SELECT 'outcome', coalesce(CAST(outcome_win AS STRING), 'missing'), count(*) FROM pool GROUP BY 2
    UNION ALL SELECT * FROM (SELECT 'top_champions', champion_name, count(*) AS n FROM pool WHERE champion_name IS NOT NULL
      GROUP BY 2 ORDER BY n DESC, champion_name LIMIT 15)""",
)
def pool_summary(spark, sf):
    return candidates.pool_summary(tables.study(spark, sf).pool)


@query(
    "feature_means",
    "SELECT 'case' AS side, " + ", ".join(f"round(avg({f}), 6) AS {f}" for f in _FEATURES) + " FROM ecases UNION ALL SELECT 'control', "
    + ", ".join(f"round(avg(control_{f}), 6)" for f in _FEATURES)
    + " FROM epool",
)
def feature_means(spark, sf):
    s = tables.study(spark, sf)
    control = s.enriched_pool.select(*[F.col(f"control_{f}").alias(f) for f in _FEATURES])
    return (
        matching.feature_means(s.enriched_cases, features=_FEATURES)
        .withColumn("side", F.lit("case"))
        .unionByName(matching.feature_means(control, features=_FEATURES).withColumn("side", F.lit("control")))
    )


@query(
    "union_distinct_observations",
    "SELECT concat(match_id, '_', participant_id, '_', observation_timestamp) AS observation_id FROM obs",
)
def union_distinct_observations(spark, sf):
    s = tables.study(spark, sf)
    return asof.union_distinct_observations(s.cases, s.pool).select(
        observation_key("match_id", "participant_id", "observation_timestamp").alias("observation_id")
    )


_KEYS = ["case_id", "control_match_id", "control_participant_id", "control_snapshot_timestamp"]
_KEY_SQL = ", ".join(_KEYS)
_DISTANCES = [
    "state_distance_standardised",
    "current_gold_distance_standardised",
    "event_distance_standardised",
    "selection_score",
]


@query("selection_score", f"SELECT {_KEY_SQL}, dark_seal_history_match, current_gold_gap, {rounded(_DISTANCES)} FROM scored")
def selection_score(spark, sf):
    return tables.study(spark, sf).scored.select(*_KEYS, "dark_seal_history_match", "current_gold_gap", *_DISTANCES)


_RANK = (
    "selection_score, state_distance_standardised, control_snapshot_age_ms, control_match_id, "
    "control_participant_id, control_snapshot_timestamp"
)


@query(
    "distance_above_best",
    f"""SELECT * FROM (SELECT {_KEY_SQL}, round(selection_score - first_value(selection_score) OVER b, 6) AS score_above,
      round(state_distance_standardised - first_value(state_distance_standardised) OVER b, 6) AS state_above
      FROM scored WINDOW b AS (PARTITION BY case_id ORDER BY {_RANK}))
    WHERE score_above <= 0.75 AND state_above <= 0.75""",
)
def distance_above_best(spark, sf):
    return matching.distance_above_best(
        tables.study(spark, sf).scored,
        by=["case_id"],
        order=matching.RANK_ORDER,
        bounds={"score_above": ("selection_score", 0.75), "state_above": ("state_distance_standardised", 0.75)},
    ).select(*_KEYS, "score_above", "state_above")


@query(
    "topk_controls_weighted",
    f"""SELECT {_KEY_SQL}, control_rank, count(*) OVER (PARTITION BY case_id) AS controls_in_set,
      round(1.0::DOUBLE / count(*) OVER (PARTITION BY case_id), 6) AS matching_weight
    FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {_RANK})::INT AS control_rank FROM scored) WHERE control_rank <= 3""",
)
def topk_controls_weighted(spark, sf):
    return matching.topk_controls_weighted(
        tables.study(spark, sf).scored, by=["case_id"], order=matching.RANK_ORDER, k=3
    ).select(*_KEYS, "control_rank", "controls_in_set", "matching_weight")


_CHOSEN = ["control_rank", "controls_in_set", "matching_weight", "selection_sample", "selection_used_fallback"]


def _chosen_sql(source):
    return (
        f"SELECT {_KEY_SQL}, control_rank::INT AS control_rank, controls_in_set, round(matching_weight, 6) AS matching_weight, "
        f"selection_sample, selection_used_fallback FROM {source}"
    )


@query("match_primary", _chosen_sql("prim"))
def match_primary(spark, sf):
    return tables.study(spark, sf).primary.select(*_KEYS, *_CHOSEN)


@query("match_relaxed", _chosen_sql("relax"))
def match_relaxed(spark, sf):
    return tables.study(spark, sf).relaxed.select(*_KEYS, *_CHOSEN)


@query("match_one_to_one", _chosen_sql("one"))
def match_one_to_one(spark, sf):
    return tables.study(spark, sf).one_to_one.select(*_KEYS, *_CHOSEN)


_LONG = [
    "matched_set_id",
    "treatment",
    "sample_type",
    "lifecycle_status",
    "match_id",
    "participant_id",
    "observation_timestamp",
    "outcome_win",
    "controls_in_set",
    "exact_controls_in_set",
    "selection_sample",
    "selection_used_fallback",
    "region",
    "team_position",
    "champion_id",
    "champion_name",
    "team_id",
    *_SUFFIXES,
]
_LONG_SQL = (
    f"SELECT {', '.join(_LONG)}, round(matching_weight, 6) AS matching_weight, CAST(control_rank AS INT) AS control_rank, "
    "round(selection_score, 6) AS selection_score FROM {}"
)


@query("matched_long", _LONG_SQL.format("rlong"))
def matched_long(spark, sf):
    return tables.study(spark, sf).relaxed_long.select(*_LONG, "matching_weight", "control_rank", "selection_score")


@query("total_order_sort", _LONG_SQL.format("plong"))
def total_order_sort(spark, sf):
    rows = tables.study(spark, sf).primary_long.select(*_LONG, "matching_weight", "control_rank", "selection_score")
    return profile.total_order_sort(
        rows, order=["matched_set_id", F.desc("treatment"), F.col("control_rank").asc_nulls_first()]
    )


@query(
    "unmatched_cases",
    """SELECT case_id, lifecycle_status, dark_seal_purchased_before_observation, 'NO_ELIGIBLE_CONTROL' AS reason
    FROM targets WHERE case_id NOT IN (SELECT case_id FROM prim)""",
)
def unmatched_cases(spark, sf):
    s = tables.study(spark, sf)
    return matching.unmatched_cases(
        matching.target_cases(s.enriched_cases), s.primary, columns=["dark_seal_purchased_before_observation"]
    )


_REUSE = (
    "SELECT count(*) AS unique_control_observations, count(*) FILTER (n > 1) AS reused_control_observations, "
    "max(n) AS maximum_control_reuse FROM (SELECT count(*) AS n FROM {} GROUP BY control_match_id, control_participant_id, "
    "control_snapshot_timestamp)"
)


@query("control_reuse", _REUSE.format("prim"))
def control_reuse(spark, sf):
    return matching.control_reuse(tables.study(spark, sf).primary)


def _summary_sql(selected, long):
    return f"""
    SELECT a.*, b.*, c.*, d.*, t.target_cases, t.target_cases - b.matched_cases AS unmatched_cases,
      round(b.matched_cases / t.target_cases, 6) AS coverage
    FROM (SELECT any_value(selection_sample) AS sample, count(*) AS selected_control_rows,
        count(*) FILTER (dark_seal_history_match) AS exact_dark_seal_control_rows,
        count(*) FILTER (NOT dark_seal_history_match) AS fallback_control_rows,
        round(avg(selection_score), 6) AS mean_selection_score, round(quantile_cont(selection_score, 0.5), 6) AS median_selection_score,
        round(max(selection_score_above_best), 6) AS maximum_score_above_best,
        round(max(state_distance_above_best), 6) AS maximum_state_above_best,
        round(avg(current_gold_gap), 6) AS mean_current_gold_gap, max(current_gold_gap)::DOUBLE AS maximum_current_gold_gap
      FROM {selected}) a,
      (SELECT count(*) AS matched_cases, count(*) FILTER (n = 1) AS cases_with_1_control, count(*) FILTER (n = 2) AS cases_with_2_controls,
        count(*) FILTER (n = 3) AS cases_with_3_controls, count(*) FILTER (fb) AS cases_using_fallback
      FROM (SELECT count(*) AS n, bool_or(selection_used_fallback) AS fb FROM {selected} GROUP BY case_id)) b,
      ({_REUSE.format(selected)}) c,
      (SELECT round(cw, 6) AS case_win_rate, round(kw, 6) AS control_win_rate, round(cw - kw, 6) AS raw_win_rate_difference FROM (
        SELECT sum(matching_weight * outcome_win::INT) FILTER (treatment = 1) / sum(matching_weight) FILTER (treatment = 1) AS cw,
          sum(matching_weight * outcome_win::INT) FILTER (treatment = 0) / sum(matching_weight) FILTER (treatment = 0) AS kw FROM {long})) d,
      (SELECT count(*) AS target_cases FROM targets) t"""


@query("sample_summary", " UNION ALL BY NAME ".join(_summary_sql(selected, long) for selected, long, _ in SAMPLES.values()))
def sample_summary(spark, sf):
    s = tables.study(spark, sf)
    targets = matching.target_cases(s.cases)
    return union_all(*[matching.sample_summary(targets, selected, long) for selected, long in s.samples.values()])


def _all_samples(spark, sf):
    """The long tables of all designs, with the design's name."""
    samples = tables.study(spark, sf).samples.items()
    return union_all(*[long.withColumn("sample", F.lit(name)) for name, (_, long) in samples])


# --- balance -------------------------------------------------------------------------


@query(
    "weighted_moments",
    "SELECT covariate, treatment, round(weighted_mean, 6) AS weighted_mean, round(weighted_variance, 2) AS weighted_variance FROM moments",
)
def weighted_moments(spark, sf):
    from cohortloom.params import BALANCE_COVARIATES

    long = tables.study(spark, sf).primary_long.withColumn(
        "observation_time_minutes", F.col("observation_timestamp") / 60_000
    )
    values = balance.covariate_long(
        long, covariates=BALANCE_COVARIATES, keep=["matched_set_id", "treatment", "matching_weight"]
    )
    moments = balance.weighted_moments(values, by=["covariate", "treatment"], value="value", weight="matching_weight")
    return moments.withColumn("weighted_variance", F.round("weighted_variance", 2))


@query(
    "effective_sample_size",
    """SELECT treatment, round(sum(matching_weight) * sum(matching_weight) / sum(matching_weight * matching_weight), 6) AS effective_sample_size
    FROM rlong GROUP BY treatment""",
)
def effective_sample_size(spark, sf):
    return balance.effective_sample_size(
        tables.study(spark, sf).relaxed_long, by=["treatment"], weight="matching_weight"
    )


_SMD = [
    "case_mean",
    "control_mean",
    "mean_difference",
    "case_standard_deviation",
    "control_standard_deviation",
    "standardised_mean_difference",
    "absolute_smd",
    "mean_paired_difference",
    "median_absolute_paired_difference",
    "maximum_absolute_paired_difference",
]
_SMD_SQL = f"SELECT covariate, {rounded(_SMD)}, balance_status, case_non_missing, control_non_missing FROM smd"


@query("smd_balance", per_sample(_SMD_SQL))
def smd_balance(spark, sf):
    return balance.smd_balance(_all_samples(spark, sf), by=["sample"])


@query("top_n_examples", _SMD_SQL + " ORDER BY round(smd.absolute_smd, 4) DESC, covariate LIMIT 10")
def top_n_examples(spark, sf):
    # to four places, so that what is equal but for summation order ranks by name
    ranked = balance.smd_balance(tables.study(spark, sf).primary_long)
    return profile.top_n_examples(ranked, order=[F.round("absolute_smd", 4).desc(), "covariate"], n=10)


@query(
    "categorical_balance",
    per_sample(
        """SELECT covariate, categories, round(total_variation_distance, 6) AS total_variation_distance,
        round(maximum_absolute_category_gap, 6) AS maximum_absolute_category_gap FROM catbal"""
    ),
)
def categorical_balance(spark, sf):
    return balance.categorical_balance(_all_samples(spark, sf), by=["sample"])


@query(
    "set_consistency",
    per_sample("SELECT field, matched_sets, mismatched_sets, round(mismatched_sets / matched_sets, 6) AS mismatch_rate FROM consist"),
)
def set_consistency(spark, sf):
    return balance.set_consistency(_all_samples(spark, sf), by=["sample"])


@query(
    "balance_summary",
    per_sample("""SELECT count(DISTINCT matched_set_id) AS matched_sets, count(*) FILTER (treatment = 1) AS case_rows,
      count(*) FILTER (treatment = 0) AS control_rows,
      round(pow(sum(matching_weight) FILTER (treatment = 1), 2) / sum(matching_weight * matching_weight) FILTER (treatment = 1), 6) AS case_effective_sample_size,
      round(pow(sum(matching_weight) FILTER (treatment = 0), 2) / sum(matching_weight * matching_weight) FILTER (treatment = 0), 6) AS control_effective_sample_size,
      (SELECT round(max(absolute_smd), 6) FROM smd) AS maximum_absolute_smd, (SELECT round(median(absolute_smd), 6) FROM smd) AS median_absolute_smd,
      (SELECT count(*) FROM smd WHERE absolute_smd < 0.1) AS covariates_good_below_0_10,
      (SELECT count(*) FROM smd WHERE absolute_smd >= 0.1 AND absolute_smd < 0.2) AS covariates_review_0_10_to_0_20,
      (SELECT count(*) FROM smd WHERE absolute_smd >= 0.2) AS covariates_poor_0_20_or_more,
      (SELECT round(total_variation_distance, 6) FROM catbal WHERE covariate = 'champion_name') AS champion_total_variation_distance,
      (SELECT count(*) FROM (SELECT matched_set_id, unnest([count(DISTINCT coalesce(region, '-')), count(DISTINCT coalesce(team_position, '-')),
         count(DISTINCT dark_seal_purchased_before_observation)]) AS n FROM plong GROUP BY 1) WHERE n > 1) AS exact_field_mismatched_sets_total
    FROM plong"""),
)
def balance_summary(spark, sf):
    long, by = _all_samples(spark, sf), ["sample"]
    parts = balance.smd_balance(long, by=by), balance.categorical_balance(long, by=by), balance.set_consistency(long, by=by)
    return balance.balance_summary(*parts, long, by=by)


# --- outcomes ------------------------------------------------------------------------


@query(
    "matched_set_effects",
    """SELECT matched_set_id, case_win, round(control_win_rate, 6) AS control_win_rate, selected_control_count, lifecycle_status,
    observation_timestamp, team_total_gold_diff, player_gold_diff_vs_role_opponent, round(risk_difference, 6) AS risk_difference,
    round(observation_time_minutes, 6) AS observation_time_minutes, team_state, player_state, purchase_time_group, lifecycle_group FROM eff""",
)
def matched_set_effects(spark, sf):
    return tables.study(spark, sf).effects


_EFFECT = (
    "count(*) AS matched_sets, round(avg(case_win), 6) AS case_win_rate, round(avg(control_win_rate), 6) AS control_win_rate, "
    "round(avg(risk_difference), 6) AS risk_difference, "
    "round(avg(risk_difference) - 1.96 * stddev_samp(risk_difference) / sqrt(count(*)), 6) AS risk_difference_ci_low, "
    "round(avg(risk_difference) + 1.96 * stddev_samp(risk_difference) / sqrt(count(*)), 6) AS risk_difference_ci_high"
)


@query(
    "outcome_by_group",
    f"SELECT 'overall' AS group_type, 'all' AS \"group\", {_EFFECT} FROM eff UNION ALL "
    + " UNION ALL ".join(f"SELECT '{g}', {g}, {_EFFECT} FROM eff GROUP BY {g}" for g in outcomes.GROUPS),
)
def outcome_by_group(spark, sf):
    return outcomes.outcome_by_group(tables.study(spark, sf).effects)


@query(
    "joint_subgroup",
    " UNION ALL ".join(
        f"SELECT '{a}' AS group_a, {a} AS value_a, '{b}' AS group_b, {b} AS value_b, {_EFFECT} FROM eff GROUP BY {a}, {b} HAVING count(*) >= 40"
        for a, b in outcomes.PAIRS
    ),
)
def joint_subgroup(spark, sf):
    return outcomes.joint_subgroup(tables.study(spark, sf).effects, min_sets=40)


# --- profiles ------------------------------------------------------------------------

_PROFILED = ("l_extendedprice", "l_quantity", "l_discount", "l_tax")


@query(
    "numeric_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS count, CAST(sum(CAST({c} AS DECIMAL(18, 2))) AS DOUBLE) / count({c}) AS mean, round(stddev_samp({c}), 6) AS std, "
        f"round(min({c}), 6) AS min, round(max({c}), 6) AS max, "
        + ", ".join(f"round(quantile_cont({c}, {p}), 6) AS p{round(p * 100):02d}" for p in profile.PROFILE_PERCENTILES)
        + " FROM lineitem"
        for c in _PROFILED
    ),
    exact=("mean",),
)
def numeric_profile(spark, sf):
    lines = tables.read(spark, sf, "lineitem").select(*_PROFILED)
    return profile.numeric_profile(lines, columns=_PROFILED, decimals=2)


@query(
    "value_share",
    """SELECT lifecycle_status AS value, count(*) AS rows, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM cases), 6) AS percent
    FROM cases GROUP BY 1""",
)
def value_share(spark, sf):
    return profile.value_share(tables.study(spark, sf).cases, column="lifecycle_status")


@query(
    "crosstab_margins",
    """SELECT coalesce(lifecycle_status, 'All') AS row_value, coalesce(CAST(outcome_win AS STRING), 'All') AS col_value, count(*) AS rows
    FROM cases WHERE outcome_win IS NOT NULL GROUP BY CUBE (lifecycle_status, outcome_win)""",
)
def crosstab_margins(spark, sf):
    return profile.crosstab_margins(tables.study(spark, sf).cases, row="lifecycle_status", col="outcome_win")


# --- sets and reach ------------------------------------------------------------------


@query(
    "id_set_difference",
    """SELECT o_orderkey, 'missing' AS side FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT l_orderkey, 'unexpected' FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)""",
)
def id_set_difference(spark, sf):
    lines = tables.read(spark, sf, "lineitem")
    return manifest.id_set_difference(
        tables.read(spark, sf, "orders").select("o_orderkey"),
        lines.select(F.col("l_orderkey").alias("o_orderkey")),
        key=["o_orderkey"],
    )


@query(
    "frontier_expand",
    """WITH RECURSIVE ed AS MATERIALIZED (
        SELECT DISTINCT concat('pu-', l_suppkey) AS player, concat('EUW1_', l_orderkey) AS match, l_orderkey AS recency FROM lineitem),
    out_ AS MATERIALIZED (
        SELECT player, match FROM ed QUALIFY row_number() OVER (PARTITION BY player ORDER BY recency DESC, match DESC) <= 3),
    r(kind, id, hop) USING KEY (kind, id) AS (
        SELECT 'player', 'pu-0', 0
        UNION
        (WITH nm AS (SELECT DISTINCT o.match, r.hop + 1 AS hop FROM r JOIN out_ o ON r.kind = 'player' AND r.id = o.player
                     WHERE o.match NOT IN (SELECT k.id FROM recurring.r k WHERE k.kind = 'match'))
         SELECT 'match', match, hop FROM nm
         UNION ALL
         SELECT DISTINCT 'player', ed.player, nm.hop FROM nm JOIN ed ON ed.match = nm.match
         WHERE ed.player NOT IN (SELECT k.id FROM recurring.r k WHERE k.kind = 'player')))
    SELECT kind, id, hop, true AS complete FROM r""",
)
def frontier_expand(spark, sf):
    lines = tables.read(spark, sf, "lineitem")
    seeds = tables.read(spark, sf, "supplier").filter("s_suppkey = 0").selectExpr("concat('pu-', s_suppkey) AS player")
    edges = lines.selectExpr("concat('pu-', l_suppkey) AS player", "concat('EUW1_', l_orderkey) AS match", "l_orderkey AS recency")
    return reach.frontier_expand(edges, seeds, per_player=3)

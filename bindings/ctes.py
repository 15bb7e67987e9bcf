"""Comparison SQL: the study's stages as plain relational definitions (DuckDB dialect).

These are written from the definitions (pair first, then filter, then rank), not from the
Spark plans, so the two sides reach a result by different routes.
"""

import re

from cohortloom.params import BALANCE_COVARIATES, PLAYER_MEASURES, STATE_COLUMNS, TEAM_MEASURES

from . import derive
from .derive import select_list


def _sql(columns: dict[str, str]) -> str:
    return ", ".join(select_list(columns, ints="INTEGER[]", array="list_value"))


def _region(column: str) -> str:
    return (
        f"CASE WHEN {column} SIMILAR TO '(VN2_|SG2_|TW2_|OC1_|PH2_|TH2_).*' THEN 'sea' "
        f"WHEN {column} SIMILAR TO '(KR_|JP1_).*' THEN 'asia' "
        f"WHEN {column} SIMILAR TO '(EUW1_|EUN1_|TR1_|RU_).*' THEN 'europe' "
        f"WHEN {column} SIMILAR TO '(NA1_|BR1_|LA1_|LA2_).*' THEN 'americas' END"
    )


def rounded(names, prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{n}, 6) AS {n}" for n in names)


_TEAM = {"total_gold": "total_gold", "xp": "xp", "minions_killed": "cs"}
_FEATURES = ("dark_seal_purchased_before_observation", "kills_last_5m", "deaths_last_5m", "assists_last_5m")
_SUFFIXES = sorted([f"player_{m}" for m in PLAYER_MEASURES] + list(STATE_COLUMNS) + list(_FEATURES))
_ORDER = (
    "selection_score, state_distance_standardised, control_snapshot_age_ms, control_match_id, "
    "control_participant_id, control_snapshot_timestamp"
)
_OUT = (
    "gold_earned",
    "gold_spent",
    "champ_level",
    "champ_experience",
    "kills",
    "deaths",
    "assists",
    "damage_dealt_to_champions",
    "damage_taken",
)


def _chosen(source: str, sample: str, fallback: str) -> str:
    return f"""
    SELECT *, count(*) OVER (PARTITION BY case_id) AS controls_in_set,
           1.0::DOUBLE / count(*) OVER (PARTITION BY case_id) AS matching_weight,
           '{sample}' AS selection_sample, {fallback} AS selection_used_fallback
    FROM (
      SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {_ORDER}) AS control_rank
      FROM (
        SELECT *, selection_score - first_value(selection_score) OVER b AS selection_score_above_best,
               state_distance_standardised - first_value(state_distance_standardised) OVER b AS state_distance_above_best
        FROM {source} WINDOW b AS (PARTITION BY case_id ORDER BY {_ORDER})
      ) WHERE selection_score_above_best <= 0.75 AND state_distance_above_best <= 0.75
    ) WHERE control_rank <= 3"""


def _long(source: str) -> str:
    case_side = ", ".join(f"x.case_{s} AS {s}" for s in _SUFFIXES)
    control_side = ", ".join(f"x.control_{s} AS {s}" for s in _SUFFIXES)
    return f"""
    SELECT x.case_id AS matched_set_id, x.case_id, 1 AS treatment, 'CASE' AS sample_type, c.lifecycle_status,
           c.match_id, c.participant_id, c.purchase_timestamp AS observation_timestamp, c.outcome_win,
           1.0::DOUBLE AS matching_weight, x.controls_in_set,
           (SELECT count(*) FROM {source} y WHERE y.case_id = x.case_id AND y.dark_seal_history_match) AS exact_controls_in_set,
           x.selection_sample,
           EXISTS (SELECT 1 FROM {source} y WHERE y.case_id = x.case_id AND y.selection_used_fallback) AS selection_used_fallback,
           c.region, c.team_position, c.champion_id, c.champion_name, c.team_id, {case_side},
           NULL AS control_rank, NULL::DOUBLE AS selection_score
    FROM {source} x JOIN cases c USING (case_id) WHERE x.control_rank = 1
    UNION ALL
    SELECT x.case_id, x.case_id, 0, 'CONTROL', 'CONTROL', x.control_match_id, x.control_participant_id,
           x.control_snapshot_timestamp, x.outcome_win, x.matching_weight, x.controls_in_set,
           (SELECT count(*) FROM {source} y WHERE y.case_id = x.case_id AND y.dark_seal_history_match),
           x.selection_sample, x.selection_used_fallback,
           c.region, x.team_position, x.champion_id, x.champion_name, x.team_id, {control_side},
           x.control_rank, x.selection_score
    FROM {source} x JOIN cases c USING (case_id)"""


CTES: dict[str, str] = {
    # the batch of a match: four days of orders in one region
    "batchkey": f"""
    SELECT match_id, region, batch_id FROM (
      SELECT {derive.O_MATCH} AS match_id, {_region(derive.O_MATCH)} AS region, CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) // 4 AS BIGINT) AS batch_id
      FROM orders) WHERE region IS NOT NULL""",
    "m": f"SELECT *, {_region('match_id')} AS region FROM (SELECT {_sql(derive.MATCH)} FROM orders)",
    "numbered": f"SELECT * REPLACE ({derive.PLAYER_NO} AS l_linenumber) FROM lineitem",
    "lines": """
    SELECT * FROM numbered QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1""",
    "p": f"SELECT {_sql(derive.PARTICIPANT)} FROM lines",
    "s": f"SELECT {_sql(derive.SNAPSHOT)} FROM lines, (VALUES (0), (1), (2), (3)) fr(f) WHERE {derive.FRAME_PRESENT}",
    "e": " UNION ALL ".join(f"SELECT {_sql(columns)} FROM numbered" for columns in derive.EVENTS),
    # a table has a batch where it has rows: a table without rows writes no file
    "batchfiles": """
    SELECT 'matches' AS table_name, region, batch_id FROM batchkey
    UNION SELECT 'participants', region, batch_id FROM batchkey JOIN p USING (match_id)
    UNION SELECT 'snapshots', region, batch_id FROM batchkey JOIN s USING (match_id)
    UNION SELECT 'events', region, batch_id FROM batchkey JOIN e USING (match_id)""",
    "struct_": """
    SELECT match_id, count(DISTINCT participant_id) AS participant_count, count(*) FILTER (win) AS winner_count,
           count(DISTINCT team_id) AS team_count,
           min(participant_id) = 1 AND max(participant_id) = count(DISTINCT participant_id) AS participant_ids_valid
    FROM p GROUP BY match_id""",
    "man0": """
    SELECT m.match_id, m.region AS storage_partition, m.queue_id, m.end_of_game_result,
           coalesce(t.participant_count, 0) AS participant_count, coalesce(t.winner_count, 0) AS winner_count,
           coalesce(t.team_count, 0) AS team_count, coalesce(t.participant_ids_valid, false) AS participant_ids_valid,
           hs.match_id IS NOT NULL AS has_snapshots, he.match_id IS NOT NULL AS has_events
    FROM m LEFT JOIN struct_ t USING (match_id) LEFT JOIN (SELECT DISTINCT match_id FROM s) hs ON hs.match_id = m.match_id
      LEFT JOIN (SELECT DISTINCT match_id FROM e) he ON he.match_id = m.match_id""",
    "man": """
    SELECT *, exclusion_reason IS NULL AS analysis_eligible FROM (
      SELECT *, nullif(concat_ws('|',
        CASE WHEN queue_id IS DISTINCT FROM 420 THEN 'wrong_queue' END,
        CASE WHEN end_of_game_result IS DISTINCT FROM 'GameComplete' THEN 'incomplete_game' END,
        CASE WHEN participant_count < 2 THEN 'invalid_participant_count' END,
        CASE WHEN winner_count < 1 THEN 'invalid_winner_count' END,
        CASE WHEN team_count <> 2 THEN 'invalid_team_count' END,
        CASE WHEN NOT participant_ids_valid THEN 'invalid_participant_ids' END,
        CASE WHEN NOT has_snapshots THEN 'missing_snapshots' END,
        CASE WHEN NOT has_events THEN 'missing_events' END), '') AS exclusion_reason
      FROM man0)""",
    "el": "SELECT match_id, storage_partition AS region FROM man WHERE analysis_eligible",
    "cat": """
    SELECT e.* FROM e WHERE match_id IN (SELECT match_id FROM el)
      AND (coalesce(item_id = 3041, false) OR coalesce(before_item_id = 3041, false) OR coalesce(after_item_id = 3041, false))""",
    "ep": """
    SELECT match_id, participant_id, ts AS purchase_timestamp,
           CASE WHEN nk = 'S' THEN nts END AS sale_timestamp, CASE WHEN nk = 'S' THEN nts - ts END AS time_held_ms,
           CASE WHEN nk IS NULL THEN 'RETAINED' WHEN nk = 'S' THEN 'SOLD' WHEN nk = 'U' THEN 'UNDONE'
                ELSE 'PURCHASED_AGAIN_BEFORE_SALE' END AS status
    FROM (
      SELECT *, lead(kind) OVER w AS nk, lead(ts) OVER w AS nts FROM (
        SELECT match_id, participant_id, timestamp AS ts, event_seq,
               CASE WHEN event_type = 'ITEM_PURCHASED' THEN 'P'
                    WHEN event_type = 'ITEM_UNDO' AND before_item_id = 3041 THEN 'U'
                    WHEN event_type = 'ITEM_SOLD' AND item_id = 3041 THEN 'S' END AS kind
        FROM cat WHERE participant_id IS NOT NULL) WHERE kind IS NOT NULL
      WINDOW w AS (PARTITION BY match_id, participant_id ORDER BY ts, event_seq))
    WHERE kind = 'P'""",
    "asof_": """
    SELECT ep.*, x.timestamp AS snap_ts, x.* EXCLUDE (match_id, participant_id, timestamp)
    FROM ep ASOF LEFT JOIN s x
      ON ep.match_id = x.match_id AND ep.participant_id = x.participant_id AND ep.purchase_timestamp >= x.timestamp""",
    "teams_": "SELECT match_id, timestamp, team_id, "
    + ", ".join(f"sum({m})::BIGINT AS {m}" for m in TEAM_MEASURES)
    + " FROM s LEFT JOIN (SELECT match_id, participant_id, team_id FROM p) USING (match_id, participant_id) GROUP BY ALL",
    "att": "SELECT concat(a.match_id, '_', a.participant_id, '_', a.purchase_timestamp) AS case_id, a.match_id, a.participant_id, "
    "m.region, a.purchase_timestamp, a.purchase_timestamp / 1000.0::DOUBLE AS purchase_time_seconds, "
    "a.status AS lifecycle_status, m.game_version, m.queue_id, m.map_id, p.team_id, p.team_position, p.champion_id, "
    "p.champion_name, CASE WHEN ok THEN a.snap_ts END AS snapshot_timestamp, "
    "CASE WHEN ok THEN a.purchase_timestamp - a.snap_ts END AS snapshot_age_ms, "
    + ", ".join(f"CASE WHEN ok THEN a.{m} END AS player_{m}" for m in (*PLAYER_MEASURES, "position_x", "position_y"))
    + ", "
    + ", ".join(
        f"CASE WHEN ok THEN (SELECT coalesce(sum(t.{m}), 0)::BIGINT FROM teams_ t WHERE t.match_id = a.match_id AND "
        f"t.timestamp = a.snap_ts AND t.team_id IS NOT DISTINCT FROM p.team_id) END AS team_{m}_sum, "
        f"CASE WHEN ok THEN (SELECT coalesce(sum(t.{m}), 0)::BIGINT FROM teams_ t WHERE t.match_id = a.match_id AND "
        f"t.timestamp = a.snap_ts AND t.team_id IS DISTINCT FROM p.team_id) END AS enemy_{m}_sum"
        for m in TEAM_MEASURES
    )
    + ", p.win AS outcome_win, "
    + ", ".join(f"p.{c} AS outcome_final_{c}" for c in _OUT)
    + ", m.game_duration AS outcome_game_duration, m.end_of_game_result AS outcome_game_result, "
    "CASE WHEN m.match_id IS NULL THEN 'missing_match' WHEN p.match_id IS NULL THEN 'missing_participant' "
    "WHEN p.team_id IS NULL THEN 'missing_team_id' WHEN a.match_id NOT IN (SELECT match_id FROM s) THEN 'missing_snapshots' "
    "WHEN a.snap_ts IS NULL THEN 'missing_pre_purchase_snapshot' WHEN NOT ok THEN 'invalid_snapshot_timing' END AS failure "
    "FROM (SELECT *, coalesce(purchase_timestamp - snap_ts <= 60000, false) AS ok FROM asof_) a "
    "LEFT JOIN m USING (match_id) LEFT JOIN p USING (match_id, participant_id)",
    "cases": "SELECT *, team_total_gold_sum - enemy_total_gold_sum AS team_total_gold_diff, "
    "team_current_gold_sum - enemy_current_gold_sum AS team_current_gold_diff, team_xp_sum - enemy_xp_sum AS team_xp_diff, "
    "team_minions_killed_sum - enemy_minions_killed_sum AS team_cs_diff FROM att WHERE failure IS NULL",
    "sp": """
    SELECT s.*, p.team_id, p.team_position, p.champion_id, p.champion_name, p.win, el.region
    FROM s JOIN el USING (match_id) LEFT JOIN p USING (match_id, participant_id) WHERE el.region IS NOT NULL""",
    "st": "SELECT *, total_gold - role_opponent_total_gold AS player_gold_diff_vs_role_opponent, "
    "xp - role_opponent_xp AS player_xp_diff_vs_role_opponent, "
    "team_total_gold_diff - (total_gold - role_opponent_total_gold) AS rest_of_team_gold_diff, "
    "team_xp_diff - (xp - role_opponent_xp) AS rest_of_team_xp_diff FROM (SELECT t.*, "
    + ", ".join(
        f"t.tt_{n} AS team_{n}, t.mt_{n} - t.tt_{n} AS enemy_{n}, 2 * t.tt_{n} - t.mt_{n} AS team_{n}_diff"
        for n in _TEAM.values()
    )
    + ", o.participant_id AS role_opponent_participant_id, o.total_gold AS role_opponent_total_gold, o.xp AS role_opponent_xp "
    "FROM (SELECT *, "
    + ", ".join(
        f"(sum({c}) OVER (PARTITION BY match_id, timestamp, team_id))::BIGINT AS tt_{n}, "
        f"(sum({c}) OVER (PARTITION BY match_id, timestamp))::BIGINT AS mt_{n}"
        for c, n in _TEAM.items()
    )
    + " FROM sp) t JOIN sp o ON t.match_id = o.match_id AND t.timestamp = o.timestamp AND t.team_position = o.team_position "
    "AND t.team_id <> o.team_id QUALIFY row_number() OVER (PARTITION BY t.match_id, t.timestamp, t.participant_id "
    "ORDER BY o.participant_id) = 1)",
    "cs": "SELECT c.case_id, c.match_id, c.participant_id, c.purchase_timestamp, c.lifecycle_status, c.region AS case_region, "
    "x.* EXCLUDE (match_id, participant_id) FROM cases c ASOF JOIN st x ON c.match_id = x.match_id "
    "AND c.participant_id = x.participant_id AND c.purchase_timestamp >= x.timestamp "
    "WHERE c.purchase_timestamp - x.timestamp <= 60000",
    "ctl": "SELECT * FROM st WHERE match_id NOT IN (SELECT match_id FROM ep)",
    "latest": """
    SELECT c.case_id, k.match_id AS km, k.participant_id AS kp, k.timestamp AS kt
    FROM cs c JOIN ctl k ON c.region = k.region AND c.team_position = k.team_position
      AND abs(c.level - k.level) <= 1 AND k.level >= 1
      AND k.timestamp BETWEEN c.purchase_timestamp - 60000 AND c.purchase_timestamp
    QUALIFY row_number() OVER (PARTITION BY c.case_id, k.match_id, k.participant_id ORDER BY k.timestamp DESC) = 1""",
    "near": """
    SELECT * FROM (
      SELECT l.case_id, km, kp, kt, c.purchase_timestamp - kt AS age,
        abs(k.total_gold - c.total_gold) / greatest(abs(k.total_gold), abs(c.total_gold), 1.0::DOUBLE) AS rg,
        abs(k.player_gold_diff_vs_role_opponent - c.player_gold_diff_vs_role_opponent) AS pg,
        abs(k.rest_of_team_gold_diff - c.rest_of_team_gold_diff) AS tg,
        abs(k.level - c.level) AS lv,
        abs(k.player_xp_diff_vs_role_opponent - c.player_xp_diff_vs_role_opponent) AS px,
        abs(k.rest_of_team_xp_diff - c.rest_of_team_xp_diff) AS tx
      FROM latest l JOIN cs c USING (case_id)
      JOIN ctl k ON k.match_id = km AND k.participant_id = kp AND k.timestamp = kt)
    WHERE rg <= 0.25 AND pg <= 2500 AND tg <= 4000""",
    "best30": """
    SELECT case_id, km, kp, kt, age, rg / 0.25::DOUBLE + pg / 2500.0::DOUBLE + tg / 4000.0::DOUBLE + 0.35::DOUBLE * lv / 1
      + 0.25::DOUBLE * age / 60000 + 0.2::DOUBLE * px / 2500.0::DOUBLE + 0.2::DOUBLE * tx / 4000.0::DOUBLE AS score
    FROM near QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY score, km, kp, kt) <= 30""",
    "pool": "SELECT b.case_id, c.match_id, c.participant_id AS case_participant_id, c.purchase_timestamp AS case_purchase_timestamp, "
    "c.lifecycle_status AS case_lifecycle_status, c.region, c.team_position, b.km AS control_match_id, b.kp AS control_participant_id, "
    "b.kt AS control_snapshot_timestamp, b.age AS control_snapshot_age_ms, b.score AS control_match_state_score, "
    "k.champion_id, k.champion_name, k.team_id, k.win AS outcome_win, "
    + ", ".join(f"c.{x} AS case_player_{x}, k.{x} AS control_player_{x}" for x in PLAYER_MEASURES)
    + ", "
    + ", ".join(f"c.{x} AS case_{x}, k.{x} AS control_{x}" for x in STATE_COLUMNS)
    + " FROM best30 b JOIN cs c USING (case_id) JOIN ctl k ON k.match_id = km AND k.participant_id = kp AND k.timestamp = kt",
    "obs": """
    SELECT match_id, participant_id, purchase_timestamp AS observation_timestamp FROM cases
    UNION SELECT control_match_id, control_participant_id, control_snapshot_timestamp FROM pool""",
    "marks": """
    SELECT match_id, timestamp, killer_id AS participant_id, 'kills' AS kind FROM e WHERE event_type = 'CHAMPION_KILL' AND killer_id > 0
    UNION ALL SELECT match_id, timestamp, victim_id, 'deaths' FROM e WHERE event_type = 'CHAMPION_KILL' AND victim_id > 0
    UNION ALL SELECT match_id, timestamp, who, 'assists' FROM (
      SELECT match_id, timestamp, unnest(assisting_ids) AS who FROM e WHERE event_type = 'CHAMPION_KILL') WHERE who > 0
    UNION ALL SELECT match_id, timestamp, participant_id, 'history' FROM e
      WHERE event_type = 'ITEM_PURCHASED' AND item_id = 1082 AND participant_id > 0""",
    "feat": """
    SELECT o.match_id, o.participant_id, o.observation_timestamp,
      count(*) FILTER (k.kind = 'kills' AND k.timestamp >= o.observation_timestamp - 300000) AS kills_last_5m,
      count(*) FILTER (k.kind = 'deaths' AND k.timestamp >= o.observation_timestamp - 300000) AS deaths_last_5m,
      count(*) FILTER (k.kind = 'assists' AND k.timestamp >= o.observation_timestamp - 300000) AS assists_last_5m,
      coalesce(bool_or(k.kind = 'history'), false)::INT::BIGINT AS dark_seal_purchased_before_observation
    FROM obs o LEFT JOIN marks k ON k.match_id = o.match_id AND k.participant_id = o.participant_id
      AND k.timestamp < o.observation_timestamp
    GROUP BY ALL""",
    "ecases": """
    SELECT c.*, f.* EXCLUDE (match_id, participant_id, observation_timestamp) FROM cases c LEFT JOIN feat f
      ON f.match_id = c.match_id AND f.participant_id = c.participant_id AND f.observation_timestamp = c.purchase_timestamp""",
    "epool": "SELECT pool.*, "
    + ", ".join(f"a.{n} AS case_{n}, b.{n} AS control_{n}" for n in _FEATURES)
    + " FROM pool LEFT JOIN feat a ON a.match_id = pool.match_id AND a.participant_id = case_participant_id "
    "AND a.observation_timestamp = case_purchase_timestamp LEFT JOIN feat b ON b.match_id = control_match_id "
    "AND b.participant_id = control_participant_id AND b.observation_timestamp = control_snapshot_timestamp",
    "gaps": """
    SELECT *, case_dark_seal_purchased_before_observation = control_dark_seal_purchased_before_observation AS dark_seal_history_match,
      abs(case_player_current_gold - control_player_current_gold) AS current_gold_gap,
      abs(case_kills_last_5m - control_kills_last_5m) AS kills_last_5m_gap,
      abs(case_deaths_last_5m - control_deaths_last_5m) AS deaths_last_5m_gap,
      abs(case_assists_last_5m - control_assists_last_5m) AS assists_last_5m_gap FROM epool""",
    "scales": "SELECT "
    + ", ".join(
        f"CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END AS s_{i}"
        for i, c in enumerate(
            ("control_match_state_score", "current_gold_gap", "kills_last_5m_gap", "deaths_last_5m_gap", "assists_last_5m_gap")
        )
    )
    + " FROM gaps",
    "scored": """
    SELECT *, 1.0::DOUBLE * state_distance_standardised + 1.0::DOUBLE * current_gold_distance_standardised
             + 2.0::DOUBLE * event_distance_standardised AS selection_score
    FROM (SELECT gaps.*, control_match_state_score / s_0 AS state_distance_standardised,
            current_gold_gap / s_1 AS current_gold_distance_standardised,
            (kills_last_5m_gap / s_2 + deaths_last_5m_gap / s_3 + assists_last_5m_gap / s_4) / 3 AS event_distance_standardised
          FROM gaps, scales)""",
    "targets": "SELECT * FROM ecases WHERE lifecycle_status IN ('RETAINED', 'SOLD')",
    "elig": "SELECT * FROM scored WHERE case_id IN (SELECT case_id FROM targets) AND current_gold_gap <= 750",
    "eligx": "SELECT * FROM elig WHERE dark_seal_history_match",
    "eligr": """
    SELECT * FROM elig x WHERE dark_seal_history_match
      OR NOT EXISTS (SELECT 1 FROM elig y WHERE y.case_id = x.case_id AND y.dark_seal_history_match)""",
    "prim": _chosen("eligx", "PRIMARY_VARIABLE_1_TO_3_EXACT_DARK_SEAL", "false"),
    "relax": _chosen("eligr", "RELAXED_VARIABLE_1_TO_3_EXACT_PREFERRED", "NOT dark_seal_history_match"),
    "one": """
    SELECT * REPLACE (1::BIGINT AS controls_in_set, 1.0::DOUBLE AS matching_weight,
      'PRIMARY_1_TO_1_EXACT_DARK_SEAL' AS selection_sample, false AS selection_used_fallback)
    FROM prim WHERE control_rank = 1""",
    "plong": _long("prim"),
    "rlong": _long("relax"),
    "olong": _long("one"),
    "cov": "SELECT matched_set_id, treatment, matching_weight, observation_timestamp / 60000.0::DOUBLE AS observation_time_minutes, "
    + ", ".join(
        f"{c}::DOUBLE AS {c}"
        for c in BALANCE_COVARIATES
        if c != "observation_time_minutes"
    )
    + " FROM plong",
    "covl": "SELECT * FROM (UNPIVOT cov ON COLUMNS(* EXCLUDE (matched_set_id, treatment, matching_weight)) INTO NAME covariate VALUE value)",
    "moments": """
    SELECT covariate, treatment, any_value(mu) AS weighted_mean,
           sum(matching_weight * (value - mu) * (value - mu)) / sum(matching_weight) AS weighted_variance
    FROM (SELECT *, sum(matching_weight * value) OVER w / sum(matching_weight) OVER w AS mu FROM covl
          WINDOW w AS (PARTITION BY covariate, treatment))
    GROUP BY covariate, treatment""",
    "pairs": """
    SELECT covariate, matched_set_id, max(value) FILTER (treatment = 1) AS case_value,
           sum(value * matching_weight) FILTER (treatment = 0) / sum(matching_weight) FILTER (treatment = 0) AS control_mean
    FROM covl GROUP BY ALL""",
    "smd": """
    SELECT c.covariate, a.weighted_mean AS case_mean, b.weighted_mean AS control_mean,
      a.weighted_mean - b.weighted_mean AS mean_difference, sqrt(a.weighted_variance) AS case_standard_deviation,
      sqrt(b.weighted_variance) AS control_standard_deviation,
      CASE WHEN (a.weighted_variance + b.weighted_variance) / 2 <= 0 THEN 0.0
           ELSE (a.weighted_mean - b.weighted_mean) / sqrt((a.weighted_variance + b.weighted_variance) / 2) END AS standardised_mean_difference,
      abs(standardised_mean_difference) AS absolute_smd,
      CASE WHEN absolute_smd < 0.1 THEN 'GOOD' WHEN absolute_smd < 0.2 THEN 'REVIEW' ELSE 'POOR' END AS balance_status,
      c.mean_paired_difference, c.median_absolute_paired_difference, c.maximum_absolute_paired_difference,
      n.case_non_missing, n.control_non_missing
    FROM (SELECT covariate, avg(case_value - control_mean) AS mean_paired_difference,
                 quantile_cont(abs(case_value - control_mean), 0.5) AS median_absolute_paired_difference,
                 max(abs(case_value - control_mean)) AS maximum_absolute_paired_difference
          FROM pairs GROUP BY covariate) c
    JOIN (SELECT covariate, count(value) FILTER (treatment = 1) AS case_non_missing,
                 count(value) FILTER (treatment = 0) AS control_non_missing FROM covl GROUP BY covariate) n USING (covariate)
    JOIN moments a ON a.covariate = c.covariate AND a.treatment = 1
    JOIN moments b ON b.covariate = c.covariate AND b.treatment = 0""",
    "cats": """
    SELECT treatment, matching_weight AS w, unnest(['region', 'team_position', 'champion_name']) AS covariate,
           unnest([coalesce(region, 'MISSING'), coalesce(team_position, 'MISSING'), coalesce(champion_name, 'MISSING')]) AS category
    FROM plong""",
    "shares": """
    SELECT coalesce(a.covariate, b.covariate) AS covariate, coalesce(a.category, b.category) AS category,
           coalesce(a.share, 0) AS case_proportion, coalesce(b.share, 0) AS control_proportion
    FROM (SELECT covariate, category, sum(w) / any_value(tot) AS share FROM
           (SELECT *, sum(w) OVER (PARTITION BY covariate) AS tot FROM cats WHERE treatment = 1) GROUP BY ALL) a
    FULL JOIN (SELECT covariate, category, sum(w) / any_value(tot) AS share FROM
           (SELECT *, sum(w) OVER (PARTITION BY covariate) AS tot FROM cats WHERE treatment = 0) GROUP BY ALL) b
      ON a.covariate = b.covariate AND a.category = b.category""",
    "catbal": """
    SELECT covariate, count(*) AS categories, sum(abs(case_proportion - control_proportion)) / 2 AS total_variation_distance,
           max(abs(case_proportion - control_proportion)) AS maximum_absolute_category_gap FROM shares GROUP BY covariate""",
    "consist": """
    SELECT field, count(*) AS matched_sets, count(*) FILTER (n > 1) AS mismatched_sets FROM (
      SELECT field, matched_set_id, count(DISTINCT coalesce(v, '<null>')) AS n FROM (
        SELECT matched_set_id, unnest(['region', 'team_position', 'dark_seal_purchased_before_observation']) AS field,
               unnest([region, team_position, CAST(dark_seal_purchased_before_observation AS STRING)]) AS v FROM plong)
      GROUP BY ALL) GROUP BY field""",
    "eff": """
    SELECT *, case_win - control_win_rate AS risk_difference, observation_timestamp / 60000.0::DOUBLE AS observation_time_minutes,
      CASE WHEN team_total_gold_diff < -2000 THEN 'behind' WHEN team_total_gold_diff < 2000 THEN 'close' ELSE 'ahead' END AS team_state,
      CASE WHEN player_gold_diff_vs_role_opponent < -1000 THEN 'behind'
           WHEN player_gold_diff_vs_role_opponent < 1000 THEN 'close' ELSE 'ahead' END AS player_state,
      CASE WHEN observation_timestamp < 60000 THEN 'before_15m' WHEN observation_timestamp < 120000 THEN '15_to_25m'
           ELSE 'after_25m' END AS purchase_time_group,
      lifecycle_status AS lifecycle_group
    FROM (
      SELECT matched_set_id, (max(outcome_win::INT) FILTER (treatment = 1))::BIGINT AS case_win,
        sum(outcome_win::INT * matching_weight) FILTER (treatment = 0) / sum(matching_weight) FILTER (treatment = 0) AS control_win_rate,
        count(*) FILTER (treatment = 0) AS selected_control_count,
        max(lifecycle_status) FILTER (treatment = 1) AS lifecycle_status,
        max(observation_timestamp) FILTER (treatment = 1) AS observation_timestamp,
        max(team_total_gold_diff) FILTER (treatment = 1) AS team_total_gold_diff,
        max(player_gold_diff_vs_role_opponent) FILTER (treatment = 1) AS player_gold_diff_vs_role_opponent
      FROM plong GROUP BY matched_set_id)""",
}
# the balance definitions once more for each further sample, and the samples by name
_BALANCE = ("cov", "covl", "moments", "pairs", "smd", "cats", "shares", "catbal", "consist")
SAMPLES = {"primary": ("prim", "plong", ""), "relaxed": ("relax", "rlong", "_r"), "one_to_one": ("one", "olong", "_o")}


def for_sample(text: str, sample: str) -> str:
    """Text about the primary sample, said about another one."""
    selected, long, tail = SAMPLES[sample]
    names = {"prim": selected, "plong": long, **{n: n + tail for n in _BALANCE}}
    return re.sub(rf"(?<!')\b({'|'.join(names)})\b(?!')", lambda m: names[m[0]], text)


for _sample in ("relaxed", "one_to_one"):
    for _name in _BALANCE:
        CTES[for_sample(_name, _sample)] = for_sample(CTES[_name], _sample)


def per_sample(query: str, column: str = "sample") -> str:
    """A query about the primary sample, for every sample with its name."""
    return " UNION ALL BY NAME ".join(f"SELECT '{s}' AS {column}, * FROM ({for_sample(query, s)})" for s in SAMPLES)


_NAMES = list(CTES)


def _needs(text: str) -> set[str]:
    words = set(re.findall(r"[a-z_][a-z0-9_]*", re.sub(r"'[^']*'", "", text)))
    # a single letter counts only where it is read from
    found = {n for n in _NAMES if n in words and len(n) > 1}
    for short in ("m", "p", "s", "e"):
        if re.search(rf"(?:FROM|JOIN|IN \(SELECT match_id FROM)\s+{short}\b", text):
            found.add(short)
    return found


def with_ctes(query: str) -> str:
    """The query with every definition it rests on."""
    wanted: set[str] = set()
    todo = _needs(query)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo |= _needs(CTES[name]) - {name}
    parts = [f"{name} AS MATERIALIZED ({CTES[name].strip()})" for name in _NAMES if name in wanted]
    return (f"WITH {', '.join(parts)} " if parts else "") + query

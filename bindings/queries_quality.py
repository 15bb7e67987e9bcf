"""Data-quality checks over the given and derived tables."""

from pyspark.sql import functions as F

from cohortloom.functions.columns import route_region
from cohortloom.functions.frames import union_all
from cohortloom.operators import quality as q
from cohortloom.params import INGEST_REGIONS
from cohortloom.plans.checks import file_checks, study_checks
from cohortloom.sources.batches import all_null_batch_columns, batch_list

from . import derive, tables
from .ctes import _FEATURES, SAMPLES, _region, per_sample
from .derive import O_MATCH
from .registry import check_rows, query

TABLES = ("matches", "participants", "snapshots", "events")
BATCH = "CAST(floor({} / 100) AS BIGINT)"
O_BATCH = BATCH.format("o_orderkey")


ORACLE_PARTS = {
    "gaps": """SELECT region, batch_id FROM (SELECT region, unnest(range(min(batch_id), max(batch_id) + 1)) AS batch_id FROM batchfiles GROUP BY region)
    EXCEPT SELECT region, batch_id FROM batchfiles""",
}


@query("batch_gaps", ORACLE_PARTS["gaps"])
def batch_gaps(spark, sf):
    return q.batch_gaps(batch_list(spark, tables.batch_folder(spark, sf)))


ORACLE_PARTS["completeness"] = (
    f"""SELECT * FROM (SELECT region, batch_id, concat_ws(',',
      {", ".join(f"CASE WHEN NOT bool_or(table_name = '{t}') THEN '{t}' END" for t in TABLES)}) AS missing_tables
      FROM batchfiles GROUP BY region, batch_id) WHERE missing_tables <> ''"""
)


@query("batch_completeness", ORACLE_PARTS["completeness"])
def batch_completeness(spark, sf):
    return q.batch_completeness(batch_list(spark, tables.batch_folder(spark, sf)), tables=TABLES)


@query(
    "batch_size_bounds",
    f"""SELECT region, batch_id, count(*) AS rows, CASE WHEN count(*) < 5 THEN 'too_few' ELSE 'too_many' END AS problem
    FROM (SELECT {_region('match_id')} AS region, batch_id FROM (SELECT {O_MATCH} AS match_id, {O_BATCH} AS batch_id FROM orders))
    GROUP BY region, batch_id HAVING count(*) NOT BETWEEN 5 AND 20""",
)
def batch_size_bounds(spark, sf):
    rows = tables.read(spark, sf, "orders").selectExpr(f"{O_MATCH} AS match_id", f"{O_BATCH} AS batch_id")
    return q.batch_size_bounds(route_region(rows, id_col="match_id", rules=INGEST_REGIONS), lo=5, hi=20)


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_keys(spark, sf):
    return q.duplicate_keys(tables.read(spark, sf, "lineitem"), key=["l_orderkey", "l_linenumber"])


@query(
    "group_cardinality",
    """SELECT 'participants_not_4' AS check_name, match_id, CAST(NULL AS INT) AS team_id, count(*) AS size FROM p GROUP BY match_id HAVING count(*) <> 4
    UNION ALL SELECT 'team_not_2', match_id, team_id, count(*) FROM p GROUP BY match_id, team_id HAVING count(*) <> 2
    UNION ALL SELECT 'teams_not_2', match_id, NULL, count(DISTINCT team_id) FROM p GROUP BY match_id HAVING count(DISTINCT team_id) <> 2""",
)
def group_cardinality(spark, sf):
    people = tables.participants(spark, sf)
    none = F.lit(None).cast("int")

    def tag(df, name):
        df = df if "team_id" in df.columns else df.withColumn("team_id", none)
        return df.select(F.lit(name).alias("check_name"), "match_id", "team_id", "size")

    return (
        tag(q.group_cardinality(people, by=["match_id"], expected=4), "participants_not_4")
        .unionByName(tag(q.group_cardinality(people, by=["match_id", "team_id"], expected=2), "team_not_2"))
        .unionByName(tag(q.group_cardinality(people, by=["match_id"], expected=2, distinct="team_id"), "teams_not_2"))
    )


@query(
    "value_range",
    """SELECT 'l_linenumber' AS column_name, count(*) FILTER (l_linenumber < 2) AS below, count(*) FILTER (l_linenumber > 6) AS above FROM lineitem
    UNION ALL SELECT 'l_extendedprice', count(*) FILTER (l_extendedprice < 0), 0 FROM lineitem""",
)
def value_range(spark, sf):
    lines = tables.read(spark, sf, "lineitem")
    return q.value_range(lines, column="l_linenumber", lo=2, hi=6).unionByName(
        q.value_range(lines, column="l_extendedprice", lo=0)
    )


_NULLABLE = ["participant_id", "item_id", "before_item_id", "after_item_id", "killer_id", "victim_id", "assisting_ids"]


@query(
    "all_null_columns",
    " UNION ALL ".join(
        f"SELECT event_type, '{c}' AS column_name FROM e GROUP BY event_type HAVING count({c}) = 0" for c in _NULLABLE
    ),
)
def all_null_columns(spark, sf):
    return q.all_null_columns(tables.events(spark, sf).select("event_type", *_NULLABLE), by=["event_type"])


_COLUMNS = {
    "matches": ("m", [c for c in derive.MATCH if c != "match_id"]),
    "participants": ("p", [c for c in derive.PARTICIPANT if c != "match_id"]),
    "snapshots": ("s", [c for c in derive.SNAPSHOT if c != "match_id"]),
    "events": ("e", [c for c in derive.EVENTS[0] if c != "match_id"]),
}


ORACLE_PARTS["null_columns"] = (
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, b.region, b.batch_id, '{c}' AS column_name FROM batchkey b JOIN {short} x USING (match_id) "
        f"GROUP BY b.region, b.batch_id HAVING count(x.{c}) = 0"
        for t, (short, columns) in _COLUMNS.items()
        for c in columns
    )
)


@query("all_null_batch_columns", ORACLE_PARTS["null_columns"])
def all_null_batch_columns_query(spark, sf):
    folder = tables.batch_folder(spark, sf)
    return union_all(*[all_null_batch_columns(spark, folder, t) for t in TABLES])


@query(
    "winner_anomalies",
    """SELECT w.match_id, w.winners, m.end_of_game_result, CASE WHEN w.winners > 3 THEN 'warning' WHEN m.match_id IS NULL THEN 'error'
      WHEN m.end_of_game_result = 'Abort_AntiCheatExit' THEN 'info' ELSE 'warning' END AS severity
    FROM (SELECT match_id, count(*) FILTER (win) AS winners FROM p GROUP BY match_id) w
    LEFT JOIN m USING (match_id) WHERE w.winners = 0 OR w.winners > 3""",
)
def winner_anomalies(spark, sf):
    return q.winner_anomalies(tables.matches(spark, sf), tables.participants(spark, sf), max_winners=3)


@query(
    "missing_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS percent "
        f"FROM e HAVING count({c}) < count(*)"
        for c in _NULLABLE
    ),
)
def missing_profile(spark, sf):
    return q.missing_profile(tables.events(spark, sf).select("match_id", "event_type", *_NULLABLE))


@query(
    "temporal_order",
    """SELECT count(*) FILTER (snapshot_timestamp > purchase_timestamp) AS state_after_event,
    count(*) FILTER (snapshot_timestamp = purchase_timestamp) AS state_at_event, count(*) FILTER (snapshot_age_ms < 0) AS negative_age,
    count(*) FILTER (snapshot_age_ms > 30000) AS over_max_age,
    count(*) FILTER (purchase_timestamp - snapshot_timestamp <> snapshot_age_ms) AS age_mismatch FROM cases""",
)
def temporal_order(spark, sf):
    return q.temporal_order(tables.study(spark, sf).cases, max_age=30_000)


_DIFF_CHECKS = [
    c
    for name, team, enemy, diff in q.DIFFERENCES
    for c in (
        (f"{name}_difference", "error", f"{team} - {enemy} <> {diff}"),
        (f"{name}_negative", "error", f"{team} < 0 OR {enemy} < 0"),
    )
] + [
    (f"{side}_current_above_total", "error", f"{side}_current_gold_sum > {side}_total_gold_sum") for side in ("team", "enemy")
] + [("jungle_outside_cs_difference", "info", "team_jungle_minions_killed_sum - enemy_jungle_minions_killed_sum <> 0")]


@query("difference_consistency", check_rows("cases", "case_id", _DIFF_CHECKS))
def difference_consistency(spark, sf):
    return q.difference_consistency(tables.study(spark, sf).cases)


@query("part_le_whole", check_rows("cases", "case_id", [(f"{a}_above_{b}", "error", f"{a} > {b}") for a, b in q.PARTS]))
def part_le_whole(spark, sf):
    return q.part_le_whole(tables.study(spark, sf).cases)


_EP_KEY = "concat(match_id, '_', participant_id, '_', purchase_timestamp)"


def _duplicates(source, key, name, sample):
    return (
        f"SELECT '{name}' AS check_name, 'all' AS scope, 'error' AS severity, count(*) AS failing_count, min(k) AS sample FROM "
        f"(SELECT {sample} AS k FROM {source} GROUP BY {key} HAVING count(*) > 1)"
    )


_EP_CHECKS = [
    ("unknown_status", "error", "status NOT IN ('RETAINED', 'SOLD', 'UNDONE', 'PURCHASED_AGAIN_BEFORE_SALE')"),
    ("participant_out_of_range", "error", "participant_id NOT BETWEEN 1 AND 5"),
    ("negative_purchase_time", "error", "purchase_timestamp < 0"),
    (
        "invalid_sale",
        "error",
        "status = 'SOLD' AND (sale_timestamp IS NULL OR time_held_ms IS NULL OR time_held_ms < 0 OR sale_timestamp < purchase_timestamp)",
    ),
    ("sale_without_sold", "error", "status <> 'SOLD' AND sale_timestamp IS NOT NULL"),
]


@query(
    "episode_invariants",
    check_rows("ep", _EP_KEY, _EP_CHECKS)
    + " UNION ALL "
    + _duplicates("ep", "match_id, participant_id, purchase_timestamp", "duplicate_episode", _EP_KEY)
    + " UNION ALL SELECT 'episodes_differ_from_purchases', 'all', 'error', abs((SELECT count(*) FROM ep) - "
    "(SELECT count(*) FROM cat WHERE event_type = 'ITEM_PURCHASED')), NULL",
)
def episode_invariants(spark, sf):
    s = tables.study(spark, sf)
    return q.episode_invariants(s.episodes, s.catalogue, max_participant=5)


_MAN_RULES = [
    ("wrong_queue", "queue_id IS DISTINCT FROM 420"),
    ("incomplete_game", "end_of_game_result IS DISTINCT FROM 'GameComplete'"),
    ("invalid_participant_count", "participant_count < 2"),
    ("invalid_winner_count", "winner_count < 1"),
    ("invalid_team_count", "team_count <> 2"),
    ("invalid_participant_ids", "NOT participant_ids_valid"),
    ("missing_snapshots", "NOT has_snapshots"),
    ("missing_events", "NOT has_events"),
]


@query(
    "manifest_invariants",
    check_rows(
        "man", "match_id", [(f"eligible_{n}", "error", f"analysis_eligible AND ({bad})") for n, bad in _MAN_RULES]
    )
    + " UNION ALL "
    + _duplicates("man", "match_id", "duplicate_match", "match_id"),
)
def manifest_invariants(spark, sf):
    return q.manifest_invariants(tables.study(spark, sf).manifest, rules=tables.study_rules())


_CASE_CHECKS = [
    ("participant_out_of_range", "error", "participant_id NOT BETWEEN 1 AND 10"),
    ("age_mismatch", "error", "purchase_timestamp - snapshot_timestamp <> snapshot_age_ms"),
    ("age_out_of_range", "error", "snapshot_age_ms NOT BETWEEN 0 AND 60000"),
    ("wrong_queue", "error", "queue_id IS DISTINCT FROM 420"),
    ("incomplete_game", "error", "outcome_game_result IS DISTINCT FROM 'GameComplete'"),
    ("missing_outcome", "error", "outcome_win IS NULL"),
]


@query(
    "case_invariants",
    check_rows("cases", "case_id", _CASE_CHECKS)
    + " UNION ALL "
    + _duplicates("cases", "case_id", "duplicate_case", "case_id")
    + f""" UNION ALL SELECT 'missing_case', 'all', 'error', count(*), min(k) FROM
      (SELECT {_EP_KEY} AS k FROM ep EXCEPT SELECT case_id FROM cases)
    UNION ALL SELECT 'unexpected_case', 'all', 'error', count(*), min(k) FROM
      (SELECT case_id AS k FROM cases EXCEPT SELECT {_EP_KEY} FROM ep)""",
)
def case_invariants(spark, sf):
    s = tables.study(spark, sf)
    return q.case_invariants(s.cases, s.episodes)


_HISTORY = _FEATURES[0]


_SIDES = [f"{side}_{f}" for side in ("case", "control") for f in _FEATURES]


def _feature_rows(source, sample, names, scope):
    return check_rows(
        source,
        sample,
        [c for f in names for c in ((f"{f}_missing", "error", f"{f} IS NULL"), (f"{f}_negative", "error", f"{f} < 0"))]
        + [(f"{f}_not_a_flag", "error", f"{f} NOT IN (0, 1)") for f in names if f.endswith(_HISTORY)],
        scope=scope,
    )


@query(
    "feature_invariants",
    _feature_rows("ecases", "case_id", _FEATURES, "'cases'")
    + " UNION ALL SELECT 'row_count_changed', 'cases', 'error', abs((SELECT count(*) FROM ecases) - (SELECT count(*) FROM cases)), NULL UNION ALL "
    + _feature_rows("epool", "case_id", _SIDES, "'pool'")
    + " UNION ALL SELECT 'row_count_changed', 'pool', 'error', abs((SELECT count(*) FROM epool) - (SELECT count(*) FROM pool)), NULL",
)
def feature_invariants(spark, sf):
    s = tables.study(spark, sf)
    cases = q.feature_invariants(s.cases, s.enriched_cases, features=_FEATURES, flags=[_HISTORY], sample="case_id")
    flags = [f for f in _SIDES if f.endswith(_HISTORY)]
    pool = q.feature_invariants(s.pool, s.enriched_pool, features=_SIDES, flags=flags, sample="case_id")
    return union_all(cases.withColumn("scope", F.lit("cases")), pool.withColumn("scope", F.lit("pool")))


@query(
    "selection_invariants",
    per_sample(
        column="design",
        query=check_rows(
        "(SELECT case_id, count(*) AS n, sum(matching_weight) AS w FROM prim GROUP BY 1)",
        "case_id",
        [
            ("controls_out_of_range", "error", "n NOT BETWEEN 1 AND 3"),
            ("weights_do_not_sum_to_one", "error", "abs(w - 1) > 1e-5"),
        ],
    )
    + " UNION ALL "
    + check_rows(
        "prim",
        "case_id",
        [
            ("missing_score", "error", "selection_score IS NULL"),
            ("score_above_best", "error", "selection_score_above_best > 0.75"),
            ("state_above_best", "error", "state_distance_above_best > 0.75"),
            ("history_differs", "error", "NOT dark_seal_history_match"),
        ],
    )
    + " UNION ALL "
    + _duplicates(
        "prim",
        "case_id, control_match_id, control_participant_id, control_snapshot_timestamp",
        "duplicate_control",
        "case_id",
    ),
    )
    + " EXCEPT SELECT 'relaxed', 'history_differs', 'all', 'error', count(*) FILTER (NOT dark_seal_history_match), "
    "min(CAST(case_id AS STRING)) FILTER (NOT dark_seal_history_match) FROM relax",
)
def selection_invariants(spark, sf):
    samples = tables.study(spark, sf).samples.items()
    return union_all(
        *[q.selection_invariants(selected, exact=name != "relaxed").withColumn("design", F.lit(name)) for name, (selected, _) in samples]
    )


@query(
    "matched_long_invariants",
    per_sample(
        column="design",
        query=check_rows(
        "(SELECT matched_set_id, count(*) AS rows_, count(*) FILTER (treatment = 1) AS cases_, count(*) FILTER (treatment = 0) AS controls, "
        "sum(matching_weight) FILTER (treatment = 1) AS cw, sum(matching_weight) FILTER (treatment = 0) AS kw, "
        "(SELECT count(*) FROM prim x WHERE x.case_id = matched_set_id) AS wanted FROM plong GROUP BY 1)",
        "matched_set_id",
        [
            ("row_count_differs", "error", "rows_ <> wanted + 1"),
            ("not_one_case", "error", "cases_ <> 1"),
            ("controls_out_of_range", "error", "controls NOT BETWEEN 1 AND 3"),
            ("case_weight", "error", "abs(cw - 1) > 1e-5"),
            ("control_weight", "error", "abs(kw - 1) > 1e-5"),
        ],
    )
    + " UNION ALL "
    + check_rows(
        "plong",
        "matched_set_id",
        [
            ("treatment_not_binary", "error", "treatment NOT IN (0, 1)"),
            ("weight_not_positive", "error", "matching_weight <= 0"),
            ("missing_outcome", "error", "outcome_win IS NULL"),
        ],
    ),
    ),
)
def matched_long_invariants(spark, sf):
    samples = tables.study(spark, sf).samples.items()
    return union_all(
        *[q.matched_long_invariants(long, selected).withColumn("design", F.lit(name)) for name, (selected, long) in samples]
    )


_SET_CHECKS = [("controls_out_of_range", "error", "n NOT BETWEEN 1 AND 3"), ("weights_do_not_sum_to_one", "error", "abs(w - 1) > 1e-5")]
_CONTROL_CHECKS = [
    ("missing_score", "error", "selection_score IS NULL"),
    ("score_above_best", "error", "selection_score_above_best > 0.75"),
    ("state_above_best", "error", "state_distance_above_best > 0.75"),
    ("history_differs", "error", "NOT dark_seal_history_match"),
]
_LONG_CHECKS = [
    ("treatment_not_binary", "error", "treatment NOT IN (0, 1)"),
    ("weight_not_positive", "error", "matching_weight <= 0"),
    ("missing_outcome", "error", "outcome_win IS NULL"),
]
_LONG_SET_CHECKS = [
    ("row_count_differs", "error", "rows_ IS DISTINCT FROM wanted + 1"),
    ("not_one_case", "error", "cases_ IS DISTINCT FROM 1"),
    ("controls_out_of_range", "error", "coalesce(controls NOT BETWEEN 1 AND 3, true)"),
    ("case_weight", "error", "coalesce(abs(cw - 1) > 1e-5, true)"),
    ("control_weight", "error", "coalesce(abs(kw - 1) > 1e-5, true)"),
]


def _nulls(columns):
    return [(f"{c}_missing", "info", f"{c} IS NULL") for c in columns]


def _copies(source, key, name, scope):
    return check_rows(f"(SELECT count(*) AS copies FROM {source} GROUP BY {key})", "NULL", [(name, "error", "copies > 1")], scope=scope)


def _report_sql():
    columns = {t: c for t, (_, c) in _COLUMNS.items()}
    by_player = "(SELECT match_id, participant_id, count(*) AS copies, max(team_id) AS team, max(CAST(win AS INT)) AS won FROM p GROUP BY 1, 2)"
    by_match = (
        f"(SELECT g.*, k.end_of_game_result AS result, k.match_id IS NOT NULL AS known FROM (SELECT match_id, sum(copies) AS people, "
        f"count(DISTINCT coalesce(team, -1)) AS teams, sum(won) AS winners FROM {by_player} GROUP BY match_id) g LEFT JOIN m k USING (match_id))"
    )
    aborted = "coalesce(result = 'Abort_AntiCheatExit', false)"
    sides = [f"{side}_{f}" for side in ("case", "control") for f in _FEATURES]

    def features(names, flag):
        return [c for f in names for c in ((f"{f}_missing", "error", f"{f} IS NULL"), (f"{f}_negative", "error", f"{f} < 0"))] + [
            (f"{f}_not_a_flag", "error", f"{f} NOT IN (0, 1)") for f in names if f.endswith(flag)
        ]

    parts = [
        "SELECT 'missing_batch' AS check_name, 'files' AS scope, 'error' AS severity, count(*) AS failing_count, NULL AS sample FROM (" + ORACLE_PARTS["gaps"] + ")",
        "SELECT 'incomplete_batch', 'files', 'error', count(*), NULL FROM (" + ORACLE_PARTS["completeness"] + ")",
        "SELECT 'null_column_in_batch', 'files', 'warning', count(*), NULL FROM (" + ORACLE_PARTS["null_columns"] + ")",
        check_rows("(SELECT m.* EXCLUDE (region), b.region, b.batch_id FROM m LEFT JOIN batchkey b USING (match_id))", "NULL", _nulls([*columns["matches"], "region", "batch_id"]), scope="'matches'"),
        _copies("m", "match_id", "duplicate_match", "'matches'"),
        check_rows(
            "(SELECT count(*) AS rows_ FROM batchkey GROUP BY region, batch_id)", "NULL",
            [("batch_too_small", "warning", "rows_ < 2"), ("batch_too_large", "error", "rows_ > 20")], scope="'matches'",
        ),
        check_rows("p", "NULL", [*_nulls(columns["participants"]), ("participant_id_below", "error", "participant_id < 1"),
                   ("participant_id_above", "error", "participant_id > 5"), ("gold_earned_below", "error", "gold_earned < 0")], scope="'participants'"),
        _copies("p", "match_id, participant_id", "duplicate_participant", "'participants'"),
        check_rows(f"(SELECT sum(copies) AS members FROM {by_player} GROUP BY match_id, team)", "NULL", [("team_size", "warning", "members <> 2")], scope="'participants'"),
        check_rows(by_match, "NULL", [
            ("participant_count", "warning", "people <> 4"), ("team_count", "warning", "teams <> 2"), ("unknown_match", "error", "NOT known"),
            ("no_winner", "warning", f"winners = 0 AND known AND NOT {aborted}"), ("no_winner_after_abort", "info", f"winners = 0 AND known AND {aborted}"),
            ("too_many_winners", "warning", "winners > 3")], scope="'participants'"),
        check_rows("s", "NULL", [*_nulls(columns["snapshots"]), ("total_gold_below", "error", "total_gold < 0"), ("current_above_total", "error", "current_gold > total_gold")], scope="'snapshots'"),
        _copies("s", "match_id, participant_id, timestamp", "duplicate_snapshot", "'snapshots'"),
        check_rows("e", "NULL", [*_nulls(columns["events"]), ("participant_id_below", "error", "participant_id < 1"),
                   ("participant_id_above", "error", "participant_id > 5"), ("timestamp_below", "error", "timestamp < 0")], scope="'events'"),
        _copies("e", "match_id, event_seq", "duplicate_event", "'events'"),
        check_rows("man", "NULL", [(f"eligible_{n}", "error", f"analysis_eligible AND ({bad})") for n, bad in _MAN_RULES], scope="'manifest'"),
        _copies("man", "match_id", "duplicate_match", "'manifest'"),
        check_rows("ep", "NULL", _EP_CHECKS, scope="'episodes'"),
        _copies("ep", "match_id, participant_id, purchase_timestamp", "duplicate_episode", "'episodes'"),
        check_rows("cases", "NULL", [
            ("state_after_event", "error", "snapshot_timestamp > purchase_timestamp"), ("state_at_event", "info", "snapshot_timestamp = purchase_timestamp"),
            ("negative_age", "error", "snapshot_age_ms < 0"), ("over_max_age", "error", "snapshot_age_ms > 30000"),
            *_DIFF_CHECKS, *[(f"{a}_above_{b}", "error", f"{a} > {b}") for a, b in q.PARTS], *_CASE_CHECKS], scope="'cases'"),
        _copies("cases", "case_id", "duplicate_case", "'cases'"),
        check_rows("ecases", "NULL", features(_FEATURES, _HISTORY), scope="'case_features'"),
        check_rows("epool", "NULL", features(sides, _HISTORY), scope="'pool_features'"),
        "SELECT 'episodes_differ_from_purchases', 'across', 'error', abs((SELECT count(*) FROM ep) - (SELECT count(*) FROM cat WHERE event_type = 'ITEM_PURCHASED')), NULL",
        f"SELECT 'missing_case', 'across', 'error', count(*), NULL FROM (SELECT {_EP_KEY} AS k FROM ep EXCEPT SELECT case_id FROM cases)",
        f"SELECT 'unexpected_case', 'across', 'error', count(*), NULL FROM (SELECT case_id AS k FROM cases EXCEPT SELECT {_EP_KEY} FROM ep)",
        "SELECT 'case_rows_changed', 'across', 'error', abs((SELECT count(*) FROM ecases) - (SELECT count(*) FROM cases)), NULL",
        "SELECT 'pool_rows_changed', 'across', 'error', abs((SELECT count(*) FROM epool) - (SELECT count(*) FROM pool)), NULL",
    ]
    for name, (selected, long, _) in SAMPLES.items():
        rows = [c for c in _CONTROL_CHECKS if name != "relaxed" or c[0] != "history_differs"]
        parts += [
            check_rows(selected, "NULL", rows, scope=f"'{name}_controls'"),
            _copies(selected, "case_id, control_match_id, control_participant_id, control_snapshot_timestamp", "duplicate_control", f"'{name}_controls'"),
            check_rows(f"(SELECT count(*) AS n, sum(matching_weight) AS w FROM {selected} GROUP BY case_id)", "NULL", _SET_CHECKS, scope=f"'{name}_controls'"),
            check_rows(long, "NULL", _LONG_CHECKS, scope=f"'{name}_long'"),
            check_rows(
                f"(SELECT rows_, cases_, controls, cw, kw, wanted FROM (SELECT matched_set_id, count(*) AS rows_, count(*) FILTER (treatment = 1) AS cases_, "
                f"count(*) FILTER (treatment = 0) AS controls, sum(matching_weight) FILTER (treatment = 1) AS cw, sum(matching_weight) FILTER (treatment = 0) AS kw "
                f"FROM {long} GROUP BY 1) l FULL JOIN (SELECT case_id AS matched_set_id, count(*) AS wanted FROM {selected} GROUP BY 1) w USING (matched_set_id))",
                "NULL", _LONG_SET_CHECKS, scope=f"'{name}_long'",
            ),
        ]
    return (
        "SELECT scope, severity, count(*) AS checks, count(*) FILTER (failing_count > 0) AS failing_checks, sum(failing_count)::BIGINT AS failing_items FROM ("
        + " UNION ALL ".join(parts)
        + ") GROUP BY scope, severity"
    )


@query("quality_report", _report_sql())
def quality_report(spark, sf):
    found = study_checks(
        tables.study(spark, sf), tables.batch_keys(spark, sf), batch_rows=(2, 20), team=2, people=4, max_winners=3, max_participant=5, max_age=30_000,
        rules=tables.study_rules(),
    )
    return q.quality_report(file_checks(spark, tables.batch_folder(spark, sf)), found)

"""Hand-made cases for the definitions that are easy to get wrong."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import columns as fc
from cohortloom.functions import frames as ff
from cohortloom.operators import asof, balance, episodes, manifest, matching, outcomes, profile, quality, reach, state
from cohortloom.params import INGEST_REGIONS, RESEARCH_REGIONS, Matching


def one(df):
    found = df.collect()
    assert len(found) == 1
    return found[0]


def values(spark, column, items, ddl):
    return [r[0] for r in spark.createDataFrame([(i,) for i in items], f"x {ddl}").select(column).collect()]


# --- normalisation -------------------------------------------------------------------


def test_boolean_words_numbers_and_flags(spark):
    b = fc.normalise_boolean(F.col("x"))
    assert values(spark, b, [" TRUE", "Won", "0", "lost", "1.0", "", None], "string") == [True, True, False, False, None, None, None]
    assert values(spark, b, [1.0, 0.0, 2.0, None], "double") == [True, False, None, None]
    assert values(spark, b, [True, False, None], "boolean") == [True, False, None]


def test_status_aliases(spark):
    s = fc.normalise_status(F.col("x"))
    assert values(spark, s, [" undo ", "Undone", "sold", None], "string") == ["UNDONE", "UNDONE", "SOLD", None]


def test_id_lists(spark):
    ids = fc.normalise_id_list(F.col("x"))
    texts = ["[1, 2]", "3.0,4", "nan", "", None, "['5', \"6\"]", "[-1, 0, 7.9, x]", "(8,)", "none"]
    assert values(spark, ids, texts, "string") == [[1, 2], [3, 4], [], [], [], [5, 6], [7], [8], []]
    df = spark.createDataFrame([([3, 0, -2, None, 4],), (None,)], "x array<int>")
    assert [r[0] for r in df.select(ids).collect()] == [[3, 4], []]


def test_bins_are_closed_on_the_left(spark):
    bins = fc.state_bins(F.col("x"), edges=(-2000, 2000), labels=("behind", "close", "ahead"))
    assert values(spark, bins, [-2001, -2000, 1999, 2000, None], "int") == ["behind", "close", "close", "ahead", None]


def test_two_routing_tables_disagree(spark):
    ids = ["OC1_1", "TW2_1", "ID_1", "EUW1_2", "LA2_9", "kr_5", "XX_1"]
    assert values(spark, fc.region_of(F.col("x"), INGEST_REGIONS), ids, "string") == [
        "sea", "sea", None, "europe", "americas", "asia", None,
    ]
    assert values(spark, fc.region_of(F.col("x"), RESEARCH_REGIONS), ids, "string") == [
        "americas", "asia", "sea", "europe", "americas", "asia", None,
    ]


def test_coerce_drops_rows_without_a_key_and_turns_nan_into_null(spark):
    df = spark.createDataFrame(
        [("1", "2.5"), ("2.0", "nan"), ("x", "1"), (None, "1"), ("9007199254740993", "oops")], "k string, v string"
    )
    got = ff.coerce_types(df, casts={"k": "bigint", "v": "double"}, required=["k"]).collect()
    assert [tuple(r) for r in got] == [(1, 2.5), (2, None), (9007199254740993, None)]


def test_unknown_counts_as_broken_rule(spark):
    df = spark.createDataFrame([(420, "GameComplete"), (None, "GameComplete"), (440, None)], "q int, r string")
    rules = [("wrong_queue", F.col("q") == 420), ("incomplete_game", F.col("r") == "GameComplete")]
    got = [tuple(r)[2:] for r in ff.eligibility_flag(df, rules=rules).collect()]
    assert got == [(True, None), (False, "wrong_queue"), (False, "wrong_queue|incomplete_game")]


# --- manifest ------------------------------------------------------------------------


def test_standard_manifest_rules(spark):
    people = [("ok", i, 100 if i <= 5 else 200, i <= 5) for i in range(1, 11)]
    people += [("odd", i, 100 if i <= 6 else 200, i <= 6) for i in range(2, 12)]
    matches = [("ok", "asia", 420, "GameComplete"), ("odd", "asia", 420, "GameComplete"), ("bare", None, None, None)]
    m = spark.createDataFrame(matches, "match_id string, region string, queue_id int, end_of_game_result string")
    p = spark.createDataFrame(people, "match_id string, participant_id int, team_id int, win boolean")
    seen = spark.createDataFrame([("ok",), ("ok",), ("odd",)], "match_id string")
    got = {r["match_id"]: r for r in manifest.match_manifest(m, p, seen, seen.limit(2)).collect()}
    assert got["ok"]["analysis_eligible"] and got["ok"]["exclusion_reason"] is None
    assert got["odd"]["exclusion_reason"] == "invalid_participant_ids|missing_events"
    assert got["bare"]["participant_count"] == 0
    assert got["bare"]["exclusion_reason"].split("|") == [
        "wrong_queue",
        "incomplete_game",
        "invalid_participant_count",
        "invalid_winner_count",
        "invalid_team_count",
        "invalid_participant_ids",
        "missing_snapshots",
        "missing_events",
    ]


# --- episodes ------------------------------------------------------------------------


def test_item_events_that_do_not_close(spark):
    """Undoing a sale, selling another item and a close with nothing open change nothing."""
    schema = "match_id string, participant_id int, timestamp bigint, event_seq bigint, event_type string, item_id int, before_item_id int, after_item_id int"
    events = [
        ("m", 1, 5, 0, "ITEM_SOLD", 3041, None, None),
        ("m", 1, 10, 1, "ITEM_PURCHASED", 3041, None, None),
        ("m", 1, 11, 2, "ITEM_SOLD", 9, None, None),
        ("m", 1, 12, 3, "ITEM_SOLD", 3041, None, None),
        ("m", 1, 13, 4, "ITEM_UNDO", None, 0, 3041),
        # equal timestamps: the sequence number decides
        ("m", 2, 20, 6, " item_undo ", None, 3041, 0),
        ("m", 2, 20, 5, "ITEM_PURCHASED", 3041, None, None),
    ]
    got = episodes.item_episodes(spark.createDataFrame(events, schema)).orderBy("participant_id").collect()
    assert [(r["purchase_timestamp"], r["sale_timestamp"], r["time_held_ms"], r["status"]) for r in got] == [
        (10, 12, 2, "SOLD"),
        (20, None, None, "UNDONE"),
    ]


# --- joins ---------------------------------------------------------------------------


def test_asof_includes_the_instant_and_the_age_limit(spark):
    left = spark.createDataFrame([(1, 60_000), (1, 59_999), (1, 120_000), (1, 120_001)], "k int, t bigint")
    right = spark.createDataFrame([(1, 60_000, "a"), (1, None, "b")], "k int, s bigint, v string")
    got = asof.asof_backward(left, right, by=["k"], left_ts="t", right_ts="s", payload=["v"])
    assert sorted((r["t"], r["v"], r["asof_age_ms"]) for r in got.collect() if r["v"]) == [
        (60_000, "a", 0),
        (120_000, "a", 60_000),
    ]
    assert got.count() == 4


def test_recent_features_are_strictly_before(spark):
    schema = (
        "match_id string, timestamp bigint, event_type string, participant_id int, item_id int, killer_id int, "
        "victim_id int, assisting_ids array<int>"
    )
    events = [
        ("m", 100, "CHAMPION_KILL", None, None, 1, 2, [3, 0]),
        ("m", 300_100, "CHAMPION_KILL", None, None, 1, 2, None),
        ("m", 50, "ITEM_PURCHASED", 1, 1082, None, None, None),
        ("m", 60, "ITEM_PURCHASED", 2, 99, None, None, None),
        ("m", 10, "CHAMPION_KILL", None, None, 0, None, []),
    ]
    obs = [("m", 1, 300_100), ("m", 1, 300_101), ("m", 2, 101), ("m", 3, 100), ("m", 3, 101), ("m", 1, 50), ("x", 1, 5)]
    got = asof.recent_event_features(
        spark.createDataFrame(obs, "match_id string, participant_id int, observation_timestamp bigint"),
        spark.createDataFrame(events, schema),
    )
    table = {
        (r["match_id"], r["participant_id"], r["observation_timestamp"]): (
            r["kills_last_5m"],
            r["deaths_last_5m"],
            r["assists_last_5m"],
            r["dark_seal_purchased_before_observation"],
        )
        for r in got.collect()
    }
    assert table == {
        ("m", 1, 300_100): (1, 0, 0, 1),  # window start inclusive, own instant not
        ("m", 1, 300_101): (1, 0, 0, 1),  # the first kill has left, the second is in
        ("m", 2, 101): (0, 1, 0, 0),
        ("m", 3, 100): (0, 0, 0, 0),
        ("m", 3, 101): (0, 0, 1, 0),
        ("m", 1, 50): (0, 0, 0, 0),  # bought at that very instant
        ("x", 1, 5): (0, 0, 0, 0),
    }


def test_marks_of_observed_people_only(spark, monkeypatch):
    r = random.Random(6)
    schema = (
        "match_id string, timestamp bigint, event_type string, participant_id int, item_id int, killer_id int, "
        "victim_id int, assisting_ids array<int>, kind string"
    )
    someone = lambda: r.choice([None, 0, 1, 2, 3, 4, 5])
    rows = [
        (
            r.choice([None, "a", "b", "c", "d"]),
            r.choice([None, *range(1000)]),
            r.choice(["CHAMPION_KILL", " champion_kill", "ITEM_PURCHASED", "OTHER", None]),
            someone(),
            r.choice([1082, 7, None]),
            someone(),
            someone(),
            r.choice([None, [], [someone() for _ in range(4)]]),
            "clash",
        )
        for _ in range(2000)
    ]
    events = spark.createDataFrame(rows, schema)
    observed = spark.createDataFrame([("a", 1), ("a", 4), ("b", 2), ("z", 3), (None, 1), ("c", None)], "match_id string, participant_id int")
    every = Counter(map(tuple, asof.event_marks(events).collect()))
    pairs = {("a", 1), ("a", 4), ("b", 2)}
    marks = asof.event_marks(events, observed=observed)
    assert Counter(map(tuple, marks.collect())) == Counter({k: n for k, n in every.items() if (k[0], k[2]) in pairs})
    # the join lies below the explode, and nothing is cut after it
    plan = marks._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.index("Generate") < plan.index("BroadcastHashJoin")
    assert "Filter" not in plan[: plan.index("Generate")]

    obs = spark.createDataFrame([(m, p, t) for m, p in [*pairs, ("z", 3)] for t in (1, 500, 900)], "match_id string, participant_id int, observation_timestamp bigint")
    small = sorted(map(tuple, asof.recent_event_features(obs, events).collect()))
    monkeypatch.setattr(asof, "OBSERVED_ROWS", 0)
    assert small == sorted(map(tuple, asof.recent_event_features(obs, events).collect()))
    assert len(small) == 12


def test_repeated_dimension_key_fails(spark):
    fact = spark.createDataFrame([(1,), (2,)], "k int")
    dim = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="not unique"):
        state.attach_dimension(fact, dim, key=["k"], columns=["v"]).collect()
    assert state.attach_dimension(fact, dim.limit(1), key=["k"], columns=["v"]).count() == 2


def test_players_without_a_team_count_as_enemy(spark):
    snaps = spark.createDataFrame(
        [("m", 0, 100, 5, None), ("m", 0, 200, 7, 1), ("m", 0, None, 9, 2)], "match_id string, ts bigint, team int, g bigint, h bigint"
    )
    obs = spark.createDataFrame([("m", 0, 100), ("m", None, 100), ("m", 0, 300)], "match_id string, at_ts bigint, team int")
    got = state.team_vs_enemy_at_ts(obs, snaps, match="match_id", obs_ts="at_ts", snap_ts="ts", team="team", measures=["g", "h"])
    table = {(r["at_ts"], r["team"]): (r["team_g_sum"], r["enemy_g_sum"], r["team_h_sum"], r["enemy_h_sum"]) for r in got.collect()}
    # a sum over nothing is zero, an absent instant is null
    assert table == {(0, 100): (5, 16, 0, 3), (None, 100): (None,) * 4, (0, 300): (0, 21, 0, 3)}


# --- matching ------------------------------------------------------------------------


def scored_frame(spark, items):
    return spark.createDataFrame(
        items,
        "case_id string, control_match_id string, control_participant_id int, control_snapshot_timestamp bigint, "
        "control_snapshot_age_ms bigint, selection_score double, state_distance_standardised double, "
        "current_gold_gap bigint, dark_seal_history_match boolean",
    )


def test_calipers_are_measured_from_the_best_row(spark):
    items = [
        ("a", "m1", 1, 0, 5, 1.0, 1.0, 10, True),
        ("a", "m2", 1, 0, 5, 1.5, 2.0, 10, True),  # state too far from the best
        ("a", "m3", 1, 0, 5, 1.75, 0.1, 750, True),  # exactly at the bound
        ("a", "m4", 1, 0, 5, 1.8, 0.1, 10, True),
        ("a", "m5", 1, 0, 5, 0.5, 0.1, 751, True),  # outside the gold caliper
        ("b", "m1", 1, 0, 5, 1.0, 1.0, 10, False),
        ("c", "m1", 1, 0, 5, 1.0, 1.0, 10, True),  # status not studied
    ]
    cases = spark.createDataFrame([("a", "SOLD"), ("b", "RETAINED"), ("c", "UNDONE")], "case_id string, lifecycle_status string")
    scored = scored_frame(spark, items)
    got = matching.match_primary(cases, scored).orderBy("control_rank").collect()
    assert [(r["case_id"], r["control_match_id"], r["control_rank"], r["matching_weight"]) for r in got] == [
        ("a", "m1", 1, 0.5),
        ("a", "m3", 2, 0.5),
    ]
    relaxed = {(r["case_id"], r["control_match_id"], r["selection_used_fallback"]) for r in matching.match_relaxed(cases, scored).collect()}
    assert relaxed == {("a", "m1", False), ("a", "m3", False), ("b", "m1", True)}
    lone = matching.match_one_to_one(matching.match_primary(cases, scored)).collect()
    assert [(r["control_match_id"], r["matching_weight"]) for r in lone] == [("m1", 1.0)]
    left_over = matching.unmatched_cases(matching.target_cases(cases), matching.match_primary(cases, scored))
    assert [r["case_id"] for r in left_over.collect()] == ["b"]


def test_constant_gap_scales_to_one(spark):
    names = ["kills_last_5m", "deaths_last_5m", "assists_last_5m", "dark_seal_purchased_before_observation"]
    items = [(1.0, 100, 50, *[1] * 4, *[0] * 4), (3.0, 100, 150, *[1] * 4, *[0] * 4)]
    ddl = "control_match_state_score double, case_player_current_gold bigint, control_player_current_gold bigint, " + ", ".join(
        f"{side}_{n} bigint" for side in ("case", "control") for n in names
    )
    got = matching.selection_score(spark.createDataFrame(items, ddl)).orderBy("control_match_state_score").collect()
    # state scale 1, gold gaps both 50: deviation 0 becomes 1, event gaps all 1: scale 1
    assert [r["selection_score"] for r in got] == [1.0 + 50.0 + 2.0, 3.0 + 50.0 + 2.0]
    assert not got[0]["dark_seal_history_match"]


# --- balance -------------------------------------------------------------------------


def test_smd_edge_cases(spark):
    items = [
        ("flat_equal", 5.0, 5.0, 0.0, 0.0),
        ("flat_apart", 5.0, 6.0, 0.0, 0.0),
        ("one_side", 2.0, 1.0, 4.0, None),
        ("plain", 1.0, 0.0, 1.0, 3.0),
        ("empty", 1.0, 0.0, None, None),
    ]
    df = spark.createDataFrame(items, "name string, a double, b double, va double, vb double")
    smd = balance.standardised_difference(F.col("a"), F.col("b"), F.col("va"), F.col("vb"))
    got = {r["name"]: (r["d"], r["c"]) for r in df.select("name", smd.alias("d"), balance.smd_class(F.abs(smd)).alias("c")).collect()}
    assert got["flat_equal"] == (0.0, "GOOD")
    assert got["flat_apart"] == (math.inf, "UNAVAILABLE")
    assert got["one_side"] == (0.5, "POOR")
    assert got["plain"][0] == pytest.approx(1 / math.sqrt(2))
    assert got["empty"] == (None, "UNAVAILABLE")


def test_infinite_difference_counts_as_poor_but_not_as_maximum(spark):
    smd = spark.createDataFrame([("a", math.inf), ("b", 0.05), ("c", 0.15)], "covariate string, absolute_smd double")
    long = spark.createDataFrame([("s", 1, 1.0), ("s", 0, 0.5), ("s", 0, 0.5)], "matched_set_id string, treatment int, matching_weight double")
    cats = spark.createDataFrame([("champion_name", 0.25)], "covariate string, total_variation_distance double")
    consistency = spark.createDataFrame([("region", 2)], "field string, mismatched_sets bigint")
    got = one(balance.balance_summary(smd, cats, consistency, long))
    assert (got["covariates_good_below_0_10"], got["covariates_review_0_10_to_0_20"], got["covariates_poor_0_20_or_more"]) == (1, 1, 1)
    assert got["maximum_absolute_smd"] == 0.15 and got["median_absolute_smd"] == pytest.approx(0.1)
    assert got["control_effective_sample_size"] == pytest.approx(2.0)
    assert got["exact_field_mismatched_sets_total"] == 2


def test_null_is_a_value_in_set_consistency(spark):
    long = spark.createDataFrame(
        [("a", None), ("a", "x"), ("b", None), ("b", None), ("c", "x"), ("c", "y"), ("d", "x"), ("d", "x")],
        "matched_set_id string, region string",
    )
    got = one(balance.set_consistency(long, fields=["region"]))
    assert (got["matched_sets"], got["mismatched_sets"], got["mismatch_rate"]) == (4, 2, 0.5)


def test_category_missing_on_one_side(spark):
    long = spark.createDataFrame(
        [(1, 1.0, "x"), (1, 1.0, None), (0, 1.0, "x"), (0, 0.5, "y"), (0, 0.5, "y")],
        "treatment int, matching_weight double, region string",
    )
    got = {r["category"]: (r["case_proportion"], r["control_proportion"]) for r in balance.category_outer_join(long, categories=["region"]).collect()}
    assert got == {"x": (0.5, 0.5), "MISSING": (0.5, 0.0), "y": (0.0, 0.5)}
    assert one(balance.categorical_balance(long, categories=["region"]))["total_variation_distance"] == 0.5


def test_moments_skip_what_is_not_finite(spark):
    df = spark.createDataFrame(
        [("g", 1.0, 1.0), ("g", 3.0, 1.0), ("g", math.nan, 1.0), ("g", math.inf, 1.0), ("g", None, 1.0), ("g", 9.0, -1.0)],
        "g string, v double, w double",
    )
    got = one(balance.weighted_moments(df, by=["g"], value="v", weight="w"))
    assert (got["weighted_mean"], got["weighted_variance"]) == (2.0, 1.0)


# --- published identities ------------------------------------------------------------

SETS = {1: 11711, 2: 5423, 3: 3857}
RELAXED_SETS = {1: 13397, 2: 6464, 3: 5078}


def selected_of(spark, sizes):
    """Selected control rows for sets of the published sizes."""
    total = sum(sizes.values())
    size = F.when(F.col("id") < sizes[1], 1).when(F.col("id") < sizes[1] + sizes[2], 2).otherwise(3)
    sets = spark.range(total).select(F.col("id").cast("string").alias("case_id"), size.alias("n"))
    rows = sets.select("case_id", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("control_rank"))
    return rows.select(
        "case_id",
        "control_rank",
        (F.lit(1.0) / F.col("n")).alias("matching_weight"),
        F.lit("S").alias("selection_sample"),
        F.lit(True).alias("dark_seal_history_match"),
        F.lit(False).alias("selection_used_fallback"),
        F.lit(1.0).alias("selection_score"),
        F.lit(0.0).alias("selection_score_above_best"),
        F.lit(0.0).alias("state_distance_above_best"),
        F.lit(10).alias("current_gold_gap"),
        F.col("case_id").alias("control_match_id"),
        F.col("control_rank").alias("control_participant_id"),
        F.lit(0).alias("control_snapshot_timestamp"),
    )


def test_published_set_sizes(spark):
    selected = selected_of(spark, SETS)
    case_rows = spark.range(20991).select(F.lit("S").alias("selection_sample"), F.lit(1).alias("treatment"), F.lit(1.0).alias("matching_weight"), F.lit(True).alias("outcome_win"))
    control_rows = selected.select("selection_sample", F.lit(0).alias("treatment"), "matching_weight", F.lit(True).alias("outcome_win"))
    long = case_rows.unionByName(control_rows)
    got = one(matching.sample_summary(spark.range(25416), selected, long))
    assert got["selected_control_rows"] == 34128 and got["matched_cases"] == 20991 and got["unmatched_cases"] == 4425
    assert got["coverage"] == pytest.approx(0.8258970727101038)
    ess = one(balance.effective_sample_size(selected, by=["selection_sample"], weight="matching_weight"))
    assert round(ess["effective_sample_size"], 1) == 28050.5
    assert selected_of(spark, RELAXED_SETS).count() == 41559


# --- outcomes ------------------------------------------------------------------------


def test_set_effects_and_interval(spark):
    schema = (
        "matched_set_id string, treatment int, matching_weight double, outcome_win boolean, lifecycle_status string, "
        "observation_timestamp bigint, team_total_gold_diff bigint, player_gold_diff_vs_role_opponent bigint"
    )
    items = []
    for i, (case, controls) in enumerate([(True, [True, False]), (False, [False]), (True, [False, False, True])]):
        items.append((f"s{i}", 1, 1.0, case, "sold ", 60_000 * (10 + 10 * i), -2000 if i else -2001, 1000))
        items += [(f"s{i}", 0, 1 / len(controls), c, "CONTROL", 0, 0, 0) for c in controls]
    items.append(("lone", 1, 1.0, True, "SOLD", 0, 0, 0))
    effects = outcomes.add_groups(outcomes.matched_set_effects(spark.createDataFrame(items, schema)))
    table = {r["matched_set_id"]: r for r in effects.collect()}
    assert set(table) == {"s0", "s1", "s2"}
    assert [round(table[s]["risk_difference"], 6) for s in ("s0", "s1", "s2")] == [0.5, 0.0, 0.666667]
    assert (table["s0"]["team_state"], table["s1"]["team_state"], table["s0"]["player_state"]) == ("behind", "close", "ahead")
    assert [table[s]["purchase_time_group"] for s in ("s0", "s1", "s2")] == ["before_15m", "15_to_25m", "after_25m"]
    got = {(r["group_type"], r["group"]): r for r in outcomes.outcome_by_group(effects).collect()}
    whole = got["overall", "all"]
    diffs = [0.5, 0.0, 2 / 3]
    mean = sum(diffs) / 3
    margin = 1.96 * math.sqrt(sum((d - mean) ** 2 for d in diffs) / 2) / math.sqrt(3)
    assert whole["risk_difference_ci_low"] == pytest.approx(mean - margin)
    assert got["lifecycle_group", "SOLD"]["matched_sets"] == 3
    assert got["team_state", "behind"]["risk_difference_ci_low"] is None
    assert outcomes.joint_subgroup(effects, min_sets=2).count() == 1
    assert outcomes.joint_subgroup(effects).count() == 0


# --- quality -------------------------------------------------------------------------


def failing(df):
    return {r["check_name"]: r["failing_count"] for r in df.collect() if r["failing_count"]}


def test_batch_checks(spark):
    files = spark.createDataFrame(
        [("matches", "sea", b) for b in (0, 1, 4, 30_000)] + [("events", "sea", 1), ("matches", "asia", 7)],
        "table_name string, region string, batch_id bigint",
    )
    gaps = quality.batch_gaps(files)
    assert gaps.count() == 30_000 - 4 + 1 and gaps.filter("region = 'asia'").count() == 0
    part = quality.batch_completeness(files.filter("batch_id < 5"), tables=["matches", "events"])
    assert sorted((r["batch_id"], r["missing_tables"]) for r in part.collect()) == [(0, "events"), (4, "events")]
    rows = spark.createDataFrame([("sea", 0)] * 101 + [("sea", 1)] * 100, "region string, batch_id bigint")
    bounds = quality.batch_size_bounds(rows, batches=files.filter("region = 'sea' and batch_id < 5"))
    assert sorted((r["batch_id"], r["rows"], r["problem"]) for r in bounds.collect()) == [(0, 101, "too_many"), (4, 0, "too_few")]


def test_winner_severity(spark):
    m = spark.createDataFrame([("a", "Abort_AntiCheatExit"), ("b", "GameComplete"), ("c", "GameComplete")], "match_id string, end_of_game_result string")
    p = spark.createDataFrame(
        [("a", False), ("b", False), ("d", None), *[("c", True)] * 6, *[("e", True)] * 5], "match_id string, win boolean"
    )
    got = {r["match_id"]: (r["winners"], r["severity"]) for r in quality.winner_anomalies(m, p).collect()}
    assert got == {"a": (0, "info"), "b": (0, "warning"), "d": (0, "error"), "c": (6, "warning")}


def test_broken_rows_are_reported(spark):
    eps = spark.createDataFrame(
        [("m", 1, 10, 5, -5, "SOLD"), ("m", 1, 10, None, None, "LOST"), ("m", 11, -1, 7, 8, "RETAINED")],
        "match_id string, participant_id int, purchase_timestamp bigint, sale_timestamp bigint, time_held_ms bigint, status string",
    )
    log = spark.createDataFrame([("ITEM_PURCHASED",), ("ITEM_SOLD",)], "event_type string")
    assert failing(quality.episode_invariants(eps, log)) == {
        "unknown_status": 1,
        "participant_out_of_range": 1,
        "negative_purchase_time": 1,
        "invalid_sale": 1,
        "sale_without_sold": 1,
        "duplicate_episode": 1,
        "episodes_differ_from_purchases": 2,
    }
    sel = spark.createDataFrame(
        [("a", "m", 1, 0, 0.5, 1.0, 0.8, 0.0, False), ("a", "m", 1, 0, 0.4, None, 0.0, 0.9, True)],
        "case_id string, control_match_id string, control_participant_id int, control_snapshot_timestamp bigint, matching_weight double, "
        "selection_score double, selection_score_above_best double, state_distance_above_best double, dark_seal_history_match boolean",
    )
    assert failing(quality.selection_invariants(sel, exact=True)) == {
        "weights_do_not_sum_to_one": 1,
        "missing_score": 1,
        "score_above_best": 1,
        "state_above_best": 1,
        "history_differs": 1,
        "duplicate_control": 1,
    }
    assert "history_differs" not in failing(quality.selection_invariants(sel, exact=False))
    assert failing(quality.selection_invariants(sel, exact=False, p=Matching(k=1)))["controls_out_of_range"] == 1


# --- profiles and reach --------------------------------------------------------------


def test_crosstab_leaves_nulls_out_and_share_keeps_them(spark):
    df = spark.createDataFrame([("a", True), ("a", None), (None, True), ("b", False)], "s string, w boolean")
    got = {(r["row_value"], r["col_value"]): r["rows"] for r in profile.crosstab_margins(df, row="s", col="w").collect()}
    assert got == {("a", "true"): 1, ("b", "false"): 1, ("a", "All"): 1, ("b", "All"): 1, ("All", "true"): 1, ("All", "false"): 1, ("All", "All"): 2}
    assert {r["value"]: r["percent"] for r in profile.value_share(df, column="s").collect()} == {"a": 50.0, None: 25.0, "b": 25.0}


def test_reach_stops_at_hops_target_and_dry_frontier(spark):
    edges = spark.createDataFrame(
        [(0, 10, 1), (0, 11, 2), (1, 11, 2), (1, 12, 9), (2, 12, 9), (3, 13, 1)], "player bigint, match bigint, recency bigint"
    )
    seeds = spark.createDataFrame([(0,)], "player bigint")

    def run(**kw):
        return {(r["kind"], r["id"], r["hop"]) for r in reach.frontier_expand(edges, seeds, **kw).collect()}

    near = {("player", 0, 0), ("match", 11, 1), ("player", 1, 1)}
    assert run(per_player=1, max_hops=1) == near
    assert run(per_player=1, max_hops=9) == near | {("match", 12, 2), ("player", 2, 2)}
    assert run(per_player=9, max_hops=9, match_target=2) == near | {("match", 10, 1)}


def test_reach_of_text_ids_goes_to_the_end(spark):
    chain = [(f"pu-{i + d}", f"EUW1_{i}", i) for i in range(11) for d in (0, 1)]
    edges = spark.createDataFrame(chain, "player string, match string, recency bigint")
    seeds = spark.createDataFrame([("pu-0",)], "player string")
    whole = reach.frontier_expand(edges, seeds)
    assert whole.filter("kind = 'player'").count() == 12 and {r["complete"] for r in whole.collect()} == {True}
    cut = reach.frontier_expand(edges, seeds, max_hops=3)
    assert cut.filter("kind = 'player'").count() == 4 and {r["complete"] for r in cut.collect()} == {False}


def test_status_aliases_and_id_text(spark):
    from cohortloom.functions.columns import normalise_id_list, normalise_status

    df = spark.createDataFrame([(" undo ", "[1 2 3]"), ("sold", "['1', \"2\", x, 3.0, -4]")], "s string, i string")
    got = df.select(normalise_status(F.col("s")).alias("a"), normalise_status(F.col("s"), aliases={}).alias("b"), normalise_id_list(F.col("i")).alias("i"))
    assert [tuple(r) for r in got.collect()] == [("UNDONE", "UNDO", []), ("SOLD", "SOLD", [1, 2, 3])]

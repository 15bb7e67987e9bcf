"""Randomised comparison with plain Python definitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions.columns import relative_gap
from cohortloom.operators import asof, candidates, episodes, quantiles, state
from cohortloom.params import CALIPERS, PLAYER_MEASURES, STATE_COLUMNS, Calipers


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- episodes ------------------------------------------------------------------------


def machine(events):
    """The open/close state machine, one key."""
    out, opened = [], None
    for ts, _, kind in sorted(events):
        if kind == "open":
            if opened is not None:
                out.append((opened, None, "PURCHASED_AGAIN_BEFORE_SALE"))
            opened = ts
        elif opened is not None and kind == "undo":
            out.append((opened, None, "UNDONE"))
            opened = None
        elif opened is not None and kind == "close":
            out.append((opened, ts, "SOLD"))
            opened = None
    if opened is not None:
        out.append((opened, None, "RETAINED"))
    return out


@pytest.mark.parametrize("slice_ms", [1, 7, 50, 10**9])
def test_episodes_equal_the_state_machine(spark, slice_ms):
    rng = random.Random(slice_ms)
    events = []
    # key 0 holds far more than a third of all rows
    for key in range(40):
        for seq in range(600 if key == 0 else rng.randint(1, 12)):
            events.append((key, rng.randint(0, 900), seq, rng.choice(["open", "undo", "close", "noise"])))
    df = spark.createDataFrame(events, "k int, ts bigint, seq int, kind string")
    got = episodes.episode_reconstruct(
        df,
        by=["k"],
        ts="ts",
        seq=["seq"],
        open_when=F.col("kind") == "open",
        undo_when=F.col("kind") == "undo",
        close_when=F.col("kind") == "close",
        slice_ms=slice_ms,
    )
    want = []
    for key in range(40):
        mine = [(ts, seq, kind) for k, ts, seq, kind in events if k == key and kind != "noise"]
        want += [(key, a, -1 if b is None else b, s) for a, b, s in machine(mine)]
    got = got.fillna(-1, ["sale_timestamp"])
    assert rows(got, "k", "purchase_timestamp", "sale_timestamp", "status") == sorted(want)


# --- as-of and recent windows --------------------------------------------------------


@pytest.mark.parametrize("factor", [1, 3])
@pytest.mark.parametrize("max_age", [0, 1, 10, 200])
def test_asof_equals_brute_force(spark, max_age, factor):
    rng = random.Random(max_age)
    left = [(i, rng.choice([0, 0, 0, 1, 2]), rng.randint(0, 400)) for i in range(200)]
    right = [(rng.choice([0, 0, 0, 1, 2]), rng.randint(0, 400), i) for i in range(300)]
    got = asof.asof_backward(
        spark.createDataFrame(left, "id int, k int, t bigint"),
        spark.createDataFrame(right, "k int, s bigint, v int"),
        by=["k"],
        left_ts="t",
        right_ts="s",
        payload=["v"],
        tie=["v"],
        max_age=max_age,
        slice_factor=factor,
    )
    want = []
    for i, k, t in left:
        seen = [(s, v) for rk, s, v in right if rk == k and s <= t]
        best = max(seen) if seen else None
        if best and t - best[0] > max_age:
            best = None
        want.append((i, best[0] if best else -1, best[1] if best else -1))
    filled = got.fillna(-1, ["asof_timestamp", "v"])
    assert rows(filled, "id", "asof_timestamp", "v") == sorted(want)


@pytest.mark.parametrize("factor", [1, 4])
@pytest.mark.parametrize("window", [1, 5, 60])
def test_recent_counts_equal_brute_force(spark, window, factor):
    rng = random.Random(window)
    obs = sorted({(rng.choice([0, 0, 1, 2]), rng.randint(0, 300)) for _ in range(150)})
    marks = [(rng.choice([0, 0, 1, 2, 3]), rng.randint(0, 300), rng.choice("abc")) for _ in range(500)]
    got = asof.recent_window_counts(
        spark.createDataFrame(obs + obs[:10], "k int, t bigint"),
        spark.createDataFrame(marks, "k int, m bigint, kind string"),
        by=["k"],
        obs_ts="t",
        mark_ts="m",
        counted={"na": "a", "nb": "b"},
        ever={"c_before": "c"},
        window_ms=window,
        slice_factor=factor,
    )
    want = []
    for k, t in obs:
        near = [kind for mk, m, kind in marks if mk == k and t - window <= m < t]
        ever = any(mk == k and m < t and kind == "c" for mk, m, kind in marks)
        want.append((k, t, near.count("a"), near.count("b"), int(ever)))
    assert rows(got, "k", "t", "na", "nb", "c_before") == sorted(want)


# --- candidates ----------------------------------------------------------------------

CONTROL_SCHEMA = (
    "region string, team_position string, match_id string, participant_id int, timestamp bigint, "
    "champion_id int, champion_name string, team_id int, win boolean, "
    + ", ".join(f"{c} bigint" for c in PLAYER_MEASURES)
    + ", "
    + ", ".join(f"{c} bigint" for c in STATE_COLUMNS)
)
CASE_SCHEMA = (
    "case_id string, match_id string, participant_id int, purchase_timestamp bigint, lifecycle_status string, "
    "region string, team_position string, "
    + ", ".join(f"{c} bigint" for c in PLAYER_MEASURES)
    + ", "
    + ", ".join(f"{c} bigint" for c in STATE_COLUMNS)
)


def _state(rng, level=None):
    measures = {c: rng.randint(0, 50) for c in PLAYER_MEASURES}
    measures["level"] = rng.randint(0, 5) if level is None else level
    measures["total_gold"] = rng.choice([0, 1, 900, 1000, 1000, 1100, 1200, 1500])
    values = {c: rng.randint(-2500, 2500) for c in STATE_COLUMNS}
    return measures, values


def candidate_frames(spark, n_cases, n_players, seed, copies=0):
    rng = random.Random(seed)
    controls, cases = [], []
    for player in range(n_players):
        region, position = rng.choice("AAB"), rng.choice("xy")
        for ts in sorted(rng.sample(range(0, 300_000, 5_000), rng.randint(1, 6))):
            m, v = _state(rng)
            controls.append(
                (region, position, f"m{player // 3}", player % 3, ts, 1, "c", 100, True)
                + tuple(m[c] for c in PLAYER_MEASURES)
                + tuple(v[c] for c in STATE_COLUMNS)
            )
    for i in range(copies):
        # identical twins in everything that is scored
        controls.append(
            ("A", "x", f"z{i:04d}", 1, 100_000, 1, "c", 100, True)
            + tuple({"level": 3, "total_gold": 1000}.get(c, 10) for c in PLAYER_MEASURES)
            + tuple(0 for _ in STATE_COLUMNS)
        )
    for i in range(n_cases):
        m, v = _state(rng)
        if copies and i % 2 == 0:
            m = {**m, "level": 3, "total_gold": 1000}
            v = {c: rng.randint(-300, 300) for c in STATE_COLUMNS}
        t = rng.randint(100_000, 160_000) if copies else rng.randint(0, 330_000)
        cases.append(
            (f"case{i}", f"c{i}", 1, t, "SOLD", rng.choice("AAB"), rng.choice("xy"))
            + tuple(m[c] for c in PLAYER_MEASURES)
            + tuple(v[c] for c in STATE_COLUMNS)
        )
    return spark.createDataFrame(cases, CASE_SCHEMA), spark.createDataFrame(controls, CONTROL_SCHEMA)


def brute_candidates(cases, controls, p):
    """Pair, keep the last snapshot per player in reach, then calipers, score and rank."""
    found = []
    controls = [r.asDict() for r in controls.collect()]
    for c in (r.asDict() for r in cases.collect()):
        t = c["purchase_timestamp"]
        last = {}
        for k in controls:
            if (k["region"], k["team_position"]) != (c["region"], c["team_position"]):
                continue
            if k["level"] < 1 or abs(k["level"] - c["level"]) > p.level_band:
                continue
            if not t - p.max_gap_ms <= k["timestamp"] <= t:
                continue
            key = (k["match_id"], k["participant_id"])
            if key not in last or k["timestamp"] > last[key]["timestamp"]:
                last[key] = k
        scored = []
        for key, k in last.items():
            rg = abs(k["total_gold"] - c["total_gold"]) / max(abs(k["total_gold"]), abs(c["total_gold"]), 1)
            pg = abs(k["player_gold_diff_vs_role_opponent"] - c["player_gold_diff_vs_role_opponent"])
            tg = abs(k["rest_of_team_gold_diff"] - c["rest_of_team_gold_diff"])
            if rg > p.gold_ratio or pg > p.player_gold_gap or tg > p.rest_gold_gap:
                continue
            px = abs(k["player_xp_diff_vs_role_opponent"] - c["player_xp_diff_vs_role_opponent"])
            tx = abs(k["rest_of_team_xp_diff"] - c["rest_of_team_xp_diff"])
            score = (
                rg / p.gold_ratio
                + pg / p.player_gold_gap
                + tg / p.rest_gold_gap
                + p.level_weight * abs(k["level"] - c["level"]) / max(p.level_band, 1)
                + p.time_weight * (t - k["timestamp"]) / p.max_gap_ms
                + p.player_xp_weight * px / p.player_xp_scale
                + p.rest_xp_weight * tx / p.rest_xp_scale
            )
            scored.append((round(score, 9), *key, k["timestamp"]))
        found += [(c["case_id"], m, i, ts) for _, m, i, ts in sorted(scored)[: p.k]]
    return sorted(found)


@pytest.mark.parametrize("dense", [1, 8, 10_000])
@pytest.mark.parametrize("seed,k,copies", [(1, 30, 0), (2, 3, 0), (3, 5, 60)])
def test_candidates_equal_brute_force(spark, dense, seed, k, copies):
    p = Calipers(k=k)
    cases, controls = candidate_frames(spark, 60, 150, seed, copies)
    got = candidates.caliper_candidates(cases, controls, p=p, dense=dense)
    want = brute_candidates(cases, controls, p)
    assert len(want) > 50
    assert rows(got, "case_id", *candidates.CONTROL_KEY) == want


def test_wider_level_band(spark):
    p = Calipers(k=4, level_band=2, max_gap_ms=30_000)
    cases, controls = candidate_frames(spark, 50, 150, 9)
    got = candidates.nearest_controls(cases, controls, p=p)
    assert rows(got, "case_id", *candidates.CONTROL_KEY) == brute_candidates(cases, controls, p)


def test_gold_cells_cover_the_caliper(spark):
    """Values within the relative caliper are never more than one cell apart."""
    rng = random.Random(5)
    pairs = [(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(3000)]
    pairs += [(x, x * 0.75) for x in (1.0, 2.0, 10.0, 1e6)] + [(0.0, 0.25), (-0.1, 0.1), (1.0, 0.75)]
    df = spark.createDataFrame(pairs, "total_gold double, c_total_gold double").withColumns(
        {f"{p}{c}": F.lit(0) for p in ("", "c_") for c in candidates.SCORED[1:]}
    )
    df = df.withColumn("gap", relative_gap(F.col("total_gold"), F.col("c_total_gold")))
    df = df.withColumn("a", candidates._cells("", CALIPERS, 1.0)["_g0"]).withColumn(
        "b", candidates._cells("c_", CALIPERS, 1.0)["_g0"]
    )
    assert df.filter("gap <= 0.25").count() > 50
    assert df.filter("gap <= 0.25 and abs(a - b) > 1").count() == 0


# --- quantiles -----------------------------------------------------------------------


@pytest.mark.parametrize("accuracy,most", [(20, 20_000), (100, 3), (20, 5), (100_000, 20_000)])
def test_exact_quantiles(spark, accuracy, most):
    """Exact whatever the sketch's accuracy, with a value that holds a third of the rows."""
    rng = np.random.default_rng(accuracy)
    data = []
    for g, n in (("a", 5000), ("b", 2), ("c", 1), ("d", 37)):
        values = rng.normal(size=n) * 100
        values[: n // 3] = 7.0
        data += [(g, float(v)) for v in values]
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    df = spark.createDataFrame(data, "g string, v double").repartition(7)
    got = {
        (r["g"], r["prob"]): r["quantile"]
        for r in quantiles.exact_quantiles(df, by=["g"], value="v", probs=probs, accuracy=accuracy, most=most).collect()
    }
    for g in "abcd":
        mine = [v for key, v in data if key == g]
        for p in probs:
            assert got[g, p] == pytest.approx(np.quantile(mine, p), abs=1e-9), (g, p)
    overall = quantiles.exact_quantiles(df, by=[], value="v", probs=[0.5]).collect()[0]["quantile"]
    assert overall == pytest.approx(np.median([v for _, v in data]))


# --- state ---------------------------------------------------------------------------


def test_state_features_equal_brute_force(spark):
    rng = random.Random(3)
    snaps, people = [], []
    for match in range(12):
        for pid in range(1, 11):
            people.append((f"m{match}", pid, rng.choice([100, 200, 200, None]), rng.choice([" top", "MID", "mid", None])))
            for ts in (0, 60_000):
                snaps.append((f"m{match}", ts, pid, rng.randint(0, 9), rng.choice([None, 5, 6]), rng.randint(0, 9)))
    s = spark.createDataFrame(snaps, "match_id string, timestamp bigint, participant_id int, total_gold bigint, xp bigint, minions_killed bigint")
    p = spark.createDataFrame(people, "match_id string, participant_id int, team_id int, team_position string").withColumns(
        {"champion_id": F.lit(1), "champion_name": F.lit("x"), "win": F.lit(True)}
    )
    got = state.state_features(s, p)
    place = {(m, i): (t, q.strip().upper()) for m, i, t, q in people if t is not None and q is not None}
    usable = [(m, ts, i, *place[m, i], g, x, cs) for m, ts, i, g, x, cs in snaps if (m, i) in place]
    want = []
    for m, ts, i, team, pos, gold, xp, _ in usable:
        same = [r for r in usable if r[:2] == (m, ts)]
        rivals = [r for r in same if r[4] == pos and r[3] != team]
        if not rivals:
            continue
        rival = min(rivals, key=lambda r: r[2])
        mine = sum(r[5] for r in same if r[3] == team)
        other = sum(r[5] for r in same if r[3] != team)
        xp_diff = None if xp is None or rival[6] is None else xp - rival[6]
        want.append((m, ts, i, rival[2], mine, other, (mine - other) - (gold - rival[5]), -99 if xp_diff is None else xp_diff))
    filled = got.fillna(-99, ["player_xp_diff_vs_role_opponent"])
    assert rows(
        filled,
        "match_id",
        "timestamp",
        "participant_id",
        "role_opponent_participant_id",
        "team_total_gold",
        "enemy_total_gold",
        "rest_of_team_gold_diff",
        "player_xp_diff_vs_role_opponent",
    ) == sorted(want)

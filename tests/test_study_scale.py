"""Steps of the study read each table once, and only the rows they use."""

import contextlib
import io
import random

from bindings import queries_study, tables
from cohortloom import session
from cohortloom.operators import asof, candidates, state
from cohortloom.params import CALIPERS
from cohortloom.sources import batches
from pyspark.sql import functions as F
from test_random import candidate_frames


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    return out.getvalue().split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]


def test_events_of_an_item_are_looked_for_among_the_lines(spark, sf_dir):
    found = plan(tables.study(spark, sf_dir).catalogue)
    assert "Generate" not in found and "item#" in found


def test_snapshots_of_cases_are_cut_once(spark, sf_dir):
    tables.forget_studies()
    start = session.written()
    tables.study(spark, sf_dir).case_attempts
    names = [path.rsplit("/", 1)[1].split("-")[0] for path in session._written[start:]]
    assert names == ["lines", "manifest", "episodes", "case_snapshots", "case_attempts"]


def test_manifest_joins_matches_once(spark, sf_dir):
    from cohortloom.operators import manifest

    s = tables.study(spark, sf_dir)
    found = plan(manifest.match_manifest(s.matches, s.participants, s.snapshots, s.events, rules=tables.study_rules(), expected_ids=None))
    assert found.count("Join ") == 1


def test_team_sums_read_the_snapshots_once(spark, sf_dir):
    found = plan(queries_study.team_vs_enemy_at_ts(spark, sf_dir))
    assert found.count("Generate explode([0,1,2,3])") == 1


def test_team_sums_are_dealt_by_instant_once(spark):
    obs = spark.range(9).selectExpr("'m' || id AS match_id", "id AS at_ms", "1 AS team_id")
    snaps = spark.range(9).selectExpr("'m' || id AS match_id", "id AS timestamp", "1 AS team_id", "id AS xp")
    found = state.team_vs_enemy_at_ts(obs, snaps, match="match_id", obs_ts="at_ms", snap_ts="timestamp", team="team_id", measures=["xp"])
    out = io.StringIO()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with contextlib.redirect_stdout(out):
            found.explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out.getvalue().count("Exchange hashpartitioning") == 2  # observers and rows


def test_team_sums_with_nulls_and_unseen_teams(spark):
    obs = spark.createDataFrame(
        [("m", 1, 10, 100), ("m", 2, 10, 200), ("m", 3, 10, 300), ("m", 4, 10, None), ("m", 5, 11, 100), (None, 6, 10, 100), ("m", 7, None, 100)],
        "match_id string, participant_id int, at_ms long, team_id int",
    )
    snaps = spark.createDataFrame(
        [("m", 10, 100, 5), ("m", 10, 100, None), ("m", 10, 200, 7), ("m", 10, None, 11), (None, 10, 100, 13), ("m", None, 100, 17)],
        "match_id string, timestamp long, team_id int, xp long",
    )
    found = state.team_vs_enemy_at_ts(obs, snaps, match="match_id", obs_ts="at_ms", snap_ts="timestamp", team="team_id", measures=["xp"])
    got = {r["participant_id"]: (r["team_xp_sum"], r["enemy_xp_sum"], r["team_xp_diff"]) for r in found.collect()}
    none = (None, None, None)
    assert got == {1: (5, 18, -13), 2: (7, 16, -9), 3: (0, 23, -23), 4: (0, 23, -23), 5: none, 6: none, 7: none}


def test_snapshots_of_some_matches_are_cut_before_they_are_made(spark, sf_dir):
    for found in (plan(queries_study.placed(spark, sf_dir)), plan(tables.study(spark, sf_dir).snapshots_of(tables.study(spark, sf_dir).episodes))):
        assert found.index("Generate explode") < found.index("Join LeftSemi")


def test_snapshots_of_some_matches_are_theirs(spark, sf_dir):
    s = tables.study(spark, sf_dir)
    some = s.matches.filter("game_id % 3 = 1").select("match_id")
    wanted = s.snapshots.join(some, "match_id", "left_semi")
    found = s.snapshots_of(some.unionByName(some))
    assert found.columns == wanted.columns
    assert wanted.exceptAll(found).isEmpty() and found.exceptAll(wanted).isEmpty() and not found.isEmpty()


def shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum(block.isShuffle() for block in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllBlocks()))


def test_a_stage_table_takes_its_shuffles_along(spark):
    before, asked = shuffle_files(spark), spark.conf.get(session.CLEANUP, None)
    rows = spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count()
    assert sorted(map(tuple, session.materialise(rows, "counts").collect())) == [(k, 100) for k in range(10)]
    assert shuffle_files(spark) <= before
    assert spark.conf.get(session.CLEANUP, None) == asked


def test_tilted_cells_hold_a_radius_and_meet_fewer(spark):
    r = random.Random(4)
    near = [[(-1) ** i * s for i, s in zip((r.getrandbits(1), r.getrandbits(1), r.getrandbits(1)), gaps)] for gaps in ([r.random() for _ in "abc"] for _ in range(2000))]
    at = [(r.uniform(100, 9000), r.uniform(-5000, 5000), r.uniform(-5000, 5000)) for _ in near]
    p, found = CALIPERS, {}
    for radius in (1.0, 0.25, 2**-10):
        pairs = []
        for (g, a, b), (x, y, z) in zip(at, near):
            total = (abs(x) + abs(y) + abs(z)) / radius
            x, y, z = x / total, y / total, z / total  # gaps in calipers whose sum is the radius
            other = g * (1 - abs(x) * p.gold_ratio) if x < 0 else g / (1 - x * p.gold_ratio)
            pairs.append((g, a, b, other, a + y * p.player_gold_gap, b + z * p.rest_gold_gap))
        names = ["total_gold", "player_gold_diff_vs_role_opponent", "rest_of_team_gold_diff"]
        df = spark.createDataFrame(pairs, ", ".join(f"{c} double" for c in [*names, *[f"c_{n}" for n in names]]))
        left, right = candidates._cells("", p, radius, tilted=True), candidates._cells("c_", p, radius, tilted=True)
        far = df.select(F.greatest(*[F.abs(left[c] - right[c]) for c in left]).alias("apart")).filter("apart > 1").count()
        assert far == 0
        # two points at random in the box of the calipers meet less often than in cells along the axes
        box = spark.createDataFrame([(*p0, *p1) for p0, p1 in zip(at, at[1:])], df.schema)
        for tilted in (False, True):
            a, b = candidates._cells("", p, radius, tilted=tilted), candidates._cells("c_", p, radius, tilted=tilted)
            found[radius, tilted] = box.filter(F.greatest(*[F.abs(a[c] - b[c]) for c in a]) <= 1).count()
    assert found[1.0, True] < found[1.0, False] / 2


def test_few_cases_are_sent_to_the_controls(spark):
    cases, controls = candidate_frames(spark, 5, 20, seed=1)
    exact = ["region", "team_position"]
    intervals = candidates.control_intervals(controls, exact=exact, p=CALIPERS)
    timed = cases.withColumn("_time_term", F.lit(0.0))
    pairs = [candidates._pairs(timed, intervals, exact=exact, p=CALIPERS, radius=1.0, near=True, few=few) for few in (False, True)]
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in pairs]
    assert "SortMergeJoin" in plans[0] and "SortMergeJoin" not in plans[1] and "BroadcastHashJoin" in plans[1]
    assert sorted(map(tuple, pairs[0].collect())) == sorted(map(tuple, pairs[1].collect()))


def test_marks_of_all_are_made_without_arrays(spark, sf_dir):
    marks = asof.event_marks(tables.events(spark, sf_dir))
    found = plan(marks.filter("kind = 'history'"))
    assert "Generate" not in found  # scans of the purchases
    assert plan(marks.filter("kind in ('kills', 'deaths', 'assists')")).count("Generate") == 1  # of those that assist


def test_lines_are_dealt_to_batches_before_they_become_rows(spark, tmp_path):
    given = spark.range(60).selectExpr("id", "IF(id % 2 = 0, 'sea', 'asia') AS region", "id DIV 20 AS batch_id")
    given = given.unionByName(spark.createDataFrame([(99, None, 1), (98, "sea", None)], "id long, region string, batch_id long"))
    made = []

    def five(dealt):
        made.append(dealt.selectExpr("id", "region", "batch_id", "explode(sequence(1, 5)) AS n"))
        return made[0]

    batches.write_batches(given, str(tmp_path), "some", make=five)
    found = made[0]._jdf.queryExecution().executedPlan().toString()
    assert found.index("Generate") < found.index("REPARTITION_BY_NUM")
    rows = sorted(map(tuple, batches.read_batches(spark, str(tmp_path), "some").select("id", "region", "batch_id", "n").collect()))
    assert rows == sorted((i, "asia" if i % 2 else "sea", i // 20, n) for i in range(60) for n in range(1, 6))
    files = batches.batch_files(spark, str(tmp_path))
    assert files.count() == 6 == batches.batch_list(spark, str(tmp_path)).count()


def test_batched_tables_are_those_joined_with_their_batches(spark, sf_dir):
    keys = tables.batch_keys(spark, sf_dir)
    found = tables.batched(spark, sf_dir)
    own = {"matches": tables.matches(spark, sf_dir).drop("region"), "participants": tables.participants(spark, sf_dir)}
    own |= {"snapshots": tables.snapshots(spark, sf_dir), "events": tables.events(spark, sf_dir)}
    for name, rows in own.items():
        wanted = rows.join(keys, "match_id")
        assert found[name].columns == wanted.columns and [f.dataType for f in found[name].schema] == [f.dataType for f in wanted.schema]
        assert wanted.exceptAll(found[name]).isEmpty() and found[name].exceptAll(wanted).isEmpty() and not found[name].isEmpty()
        assert name == "matches" or "Join" not in plan(found[name])

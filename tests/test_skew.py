"""One key holding a third of the rows: results stay whole and the joins stay splittable."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from cohortloom.operators import asof, candidates, state
from cohortloom.params import CALIPERS
from cohortloom.session import materialise
from test_random import candidate_frames


@contextmanager
def conf(spark, **settings):
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
}


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def hot(spark, n):
    """A third of the rows share key 0."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("k"), (F.col("id") * 37 % 100_000).alias("t"), "id"
    )


def test_dimension_join_is_split_on_a_hot_key(spark):
    fact = hot(spark, 60_000)
    dim = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    with conf(spark, **SMALL):
        joined = state.attach_dimension(fact, dim, key=["k"], columns=["v"])
        assert "skew=true" in final_plan(joined)
    assert joined.count() == 60_000 and joined.filter("v <> 2 * k or v is null").count() == 0


def test_candidate_join_is_split_on_a_hot_cell(spark):
    cases, controls = candidate_frames(spark, 40, 60, seed=4)
    # distinct controls, all in one cell
    crowd = controls.filter("level >= 1").limit(1).drop("match_id", "timestamp").crossJoin(
        spark.range(20_000).select(
            F.concat(F.lit("h"), F.col("id").cast("string")).alias("match_id"),
            F.lit(90_000).cast("bigint").alias("timestamp"),
            (F.col("id") % 997).alias("nudge"),
        )
    )
    crowd = crowd.withColumn("player_xp_diff_vs_role_opponent", F.col("nudge")).drop("nudge")
    exact = ["region", "team_position"]
    intervals = candidates.control_intervals(controls.unionByName(crowd), exact=exact, p=CALIPERS)
    # many input splits, as a large stored table has: a partition is split along its map tasks
    intervals = materialise(intervals, "skew_intervals").repartition(16)
    with conf(spark, **SMALL):
        assert "skew=true" in final_plan(candidates._pairs(cases, intervals, exact=exact, p=CALIPERS, radius=1.0))


def test_window_counts_spread_a_hot_key_over_slices(spark):
    log = hot(spark, 30_000).withColumn("kind", F.lit("x"))
    got = asof.recent_window_counts(
        log, log, by=["k"], obs_ts="t", mark_ts="t", counted={"n": "x"}, ever={"before": "x"}, window_ms=1_000, slice_factor=1
    )
    t = sorted(r["t"] for r in log.filter("k = 0").select("t").collect())
    import bisect

    for r in got.filter("k = 0").orderBy("t").limit(400).collect():
        lo, hi = bisect.bisect_left(t, r["t"] - 1_000), bisect.bisect_left(t, r["t"])
        assert (r["n"], r["before"]) == (hi - lo, int(hi > 0))
    assert log.filter("k = 0").select(F.floor(F.col("t") / 1_000)).distinct().count() > 50

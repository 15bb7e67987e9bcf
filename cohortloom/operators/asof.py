"""Backward as-of attachment and recent-window counts."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import union_all
from ..functions.sequence import SLICE_FACTOR, look_back_slices, slice_of, slice_width
from ..params import ASOF, HISTORY_ITEM, RECENT
from ..session import materialise

OBSERVED_ROWS = 500_000  # observed (match, participant) that may be broadcast, some 20 MB


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    *,
    by: Sequence[str],
    left_ts: str,
    right_ts: str,
    payload: Sequence[str],
    tie: Sequence[str] = (),
    max_age: int = ASOF.max_age_ms,
    slice_factor: int = SLICE_FACTOR,
) -> DataFrame:
    """Left rows with the payload of the last right row at or before them, null if none is
    at most ``max_age`` old.

    Both sides are tagged, unioned and swept once per (key, time slice): one shuffle, no
    row pairs. Right rows near a slice end are also sent to the next slice.
    """
    width = slice_width(max_age, slice_factor)
    state = F.struct(F.col(right_ts).alias("_asof_ts"), *payload)
    left_row = F.struct(*left.columns)
    events = right.dropna(subset=[*by, right_ts]).select(
        *by,
        F.explode(look_back_slices(F.col(right_ts), max_age, slice_factor)).alias("_slice"),
        F.col(right_ts).cast("bigint").alias("_at"),
        F.lit(0).alias("_side"),
        *[F.col(name).alias(f"_tie_{i}") for i, name in enumerate(tie)],
        state.alias("_state"),
    )
    probes = left.select(
        *by,
        slice_of(F.col(left_ts), width).alias("_slice"),
        F.col(left_ts).cast("bigint").alias("_at"),
        F.lit(1).alias("_side"),
        left_row.alias("_left"),
    )
    stream = events.unionByName(probes, allowMissingColumns=True)
    order = ["_at", "_side", *[f"_tie_{i}" for i in range(len(tie))]]
    sweep = (
        Window.partitionBy(*by, "_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = stream.withColumn("_found", F.last("_state", ignorenulls=True).over(sweep)).filter("_side = 1")
    age = F.col("_at") - F.col("_found._asof_ts")
    fresh = age <= max_age
    return found.select(
        "_left.*",
        F.when(fresh, F.col("_found._asof_ts")).alias("asof_timestamp"),
        F.when(fresh, age).alias("asof_age_ms"),
        *[F.when(fresh, F.col("_found")[name]).alias(name) for name in payload],
    )


def union_distinct_observations(cases: DataFrame, controls: DataFrame) -> DataFrame:
    """Every (match, participant, timestamp) observed as a case or as a control, once."""
    as_case = cases.select(
        "match_id", "participant_id", F.col("purchase_timestamp").alias("observation_timestamp")
    )
    as_control = controls.select(
        F.col("control_match_id").alias("match_id"),
        F.col("control_participant_id").alias("participant_id"),
        F.col("control_snapshot_timestamp").alias("observation_timestamp"),
    )
    return as_case.unionByName(as_control).distinct()


def event_marks(events: DataFrame, *, history_item: int = HISTORY_ITEM, observed: DataFrame | None = None) -> DataFrame:
    """Long form (match, participant, timestamp, kind) of kills, deaths, assists and
    history purchases. Ids of zero or less are nobody. With ``observed``, a small table of distinct
    (match, participant) that is broadcast, only their marks: others are cut before an event
    becomes a row for each of its people, events of other matches right after the scan."""
    kind = F.upper(F.trim("event_type"))
    is_kill = kind == "CHAMPION_KILL"
    is_purchase = (kind == "ITEM_PURCHASED") & (F.col("item_id") == history_item)
    kept = events.filter(is_kill | is_purchase).filter("match_id is not null and timestamp is not null")
    if observed is None:
        # a plain scan for each kind: what reads some kinds only never makes the others
        who = {
            "kills": (is_kill, F.col("killer_id")),
            "deaths": (is_kill, F.col("victim_id")),
            "assists": (is_kill, F.explode("assisting_ids")),
            "history": (is_purchase, F.col("participant_id")),
        }
        return union_all(
            *[
                kept.filter(when).select("match_id", "timestamp", person.alias("participant_id"), F.lit(name).alias("kind"))
                for name, (when, person) in who.items()
            ]
        ).filter("participant_id > 0")
    # everybody involved in one array; the place in it tells the role
    people = F.concat(
        F.array(
            F.when(is_kill, F.col("killer_id")),
            F.when(is_kill, F.col("victim_id")),
            F.when(is_purchase, F.col("participant_id")),
        ),
        F.coalesce(F.when(is_kill, F.col("assisting_ids")), F.array().cast("array<int>")),
    )
    people = F.transform(people, lambda person, place: F.struct(place.alias("role"), person.alias("participant_id")))
    per_match = observed.groupBy("match_id").agg(F.collect_set(F.col("participant_id").cast("bigint")).alias("_observed"))
    kept = kept.join(F.broadcast(per_match), "match_id")
    somebody = F.filter(
        people, lambda p: (p["participant_id"] > 0) & F.array_contains("_observed", p["participant_id"].cast("bigint"))
    )
    role = F.col("_person.role")
    return (
        kept.select("match_id", "timestamp", F.explode(somebody).alias("_person"))
        .select(
            "match_id",
            "timestamp",
            "_person.participant_id",
            F.when(role == 0, "kills").when(role == 1, "deaths").when(role == 2, "history").otherwise("assists").alias("kind"),
        )
    )


def recent_window_counts(
    observations: DataFrame,
    marks: DataFrame,
    *,
    by: Sequence[str],
    obs_ts: str,
    mark_ts: str,
    counted: dict[str, str],
    ever: dict[str, str],
    window_ms: int = RECENT.window_ms,
    slice_factor: int = SLICE_FACTOR,
) -> DataFrame:
    """Per distinct observation: marks of each kind in ``[t - window, t)``, and whether a mark
    of the ``ever`` kinds lies before ``t``.

    The count is a difference of two running totals, read at ``t`` and at ``t - window``.
    Both reads fall into the same time slice, so the difference needs no further shuffle and
    no sliding frame.
    """
    width = slice_width(window_ms, slice_factor)
    totals = [F.count_if(F.col("kind") == kind).alias(f"_n_{name}") for name, kind in counted.items()]
    names = list(counted)
    per_instant = (
        marks.filter(F.col("kind").isin(*counted.values()))
        .groupBy(*by, F.col(mark_ts).cast("bigint").alias("_at"))
        .agg(*totals)
        .withColumn("_slice", F.explode(look_back_slices(F.col("_at"), window_ms, slice_factor)))
        .withColumn("_is_mark", F.lit(1))
    )
    t = F.col(obs_ts).cast("bigint")
    reads = F.array(
        F.struct(t.alias("_at"), F.lit(1).cast("bigint").alias("_sign")),
        F.struct((t - window_ms).alias("_at"), F.lit(-1).cast("bigint").alias("_sign")),
    )
    probes = (
        observations.select(*by, t.alias(obs_ts))
        .distinct()
        .select(*by, obs_ts, slice_of(F.col(obs_ts), width).alias("_slice"), F.explode(reads).alias("_r"))
        .select(*by, obs_ts, "_slice", "_r._at", "_r._sign", F.lit(0).alias("_is_mark"))
    )
    firsts = (
        marks.filter(F.col("kind").isin(*ever.values()))
        .groupBy(*by)
        .agg(
            *[
                F.min(F.when(F.col("kind") == kind, F.col(mark_ts))).alias(f"_first_{name}")
                for name, kind in ever.items()
            ]
        )
    )
    # the first marks enter each slice as one row, ahead of everything: a frequent key then
    # meets them once per slice instead of once per observation
    openers = (
        probes.select(*by, "_slice")
        .distinct()
        .join(firsts, list(by))
        .withColumns({"_at": F.lit(-(2**63)).cast("bigint"), "_is_mark": F.lit(1)})
    )
    stream = per_instant.unionByName(probes, allowMissingColumns=True).unionByName(openers, allowMissingColumns=True)
    running = (
        Window.partitionBy(*by, "_slice")
        .orderBy("_at", "_is_mark")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    swept = stream.select(
        *by,
        "_slice",
        obs_ts,
        "_sign",
        "_is_mark",
        *[F.coalesce(F.sum(f"_n_{name}").over(running), F.lit(0)).alias(f"_n_{name}") for name in names],
        *[F.min(f"_first_{name}").over(running).alias(f"_first_{name}") for name in ever],
    ).filter("_is_mark = 0")
    counts = swept.groupBy(*by, "_slice", obs_ts).agg(
        *[F.sum(F.col("_sign") * F.col(f"_n_{name}")).alias(name) for name in names],
        *[F.min(f"_first_{name}").alias(f"_first_{name}") for name in ever],
    )
    return counts.select(
        *by,
        obs_ts,
        *names,
        *[
            F.coalesce(F.col(f"_first_{name}") < F.col(obs_ts), F.lit(False)).cast("bigint").alias(name)
            for name in ever
        ],
    )


def recent_event_features(observations: DataFrame, events: DataFrame) -> DataFrame:
    """The study's four features for (match, participant, observation_timestamp) rows.

    Who is observed is written and counted first. Up to ``OBSERVED_ROWS`` of them cut the events
    before these become marks; beyond, most of a log is observed and the marks are counted first.
    """
    observed = materialise(observations.select("match_id", "participant_id").distinct(), "observed")
    few = observed.count() <= OBSERVED_ROWS
    return recent_window_counts(
        observations,
        event_marks(events, observed=observed if few else None),
        by=["match_id", "participant_id"],
        obs_ts="observation_timestamp",
        mark_ts="timestamp",
        counted={"kills_last_5m": "kills", "deaths_last_5m": "deaths", "assists_last_5m": "assists"},
        ever={"dark_seal_purchased_before_observation": "history"},
    )

"""Eligibility manifest and the joins that apply it."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normalise_boolean
from ..functions.frames import eligibility_flag, union_all
from ..params import COMPLETE_RESULT, RANKED_QUEUE


def standard_rules(*, participants: int = 10, winners: int = 5, teams: int = 2) -> list[tuple[str, Column]]:
    c = F.col
    return [
        ("wrong_queue", c("queue_id") == RANKED_QUEUE),
        ("incomplete_game", c("end_of_game_result") == COMPLETE_RESULT),
        ("invalid_participant_count", c("participant_count") == participants),
        ("invalid_winner_count", c("winner_count") == winners),
        ("invalid_team_count", c("team_count") == teams),
        ("invalid_participant_ids", c("participant_ids_valid")),
        ("missing_snapshots", c("has_snapshots")),
        ("missing_events", c("has_events")),
    ]


def distinct_key_scan(df: DataFrame, *, key: str) -> DataFrame:
    return df.select(key).dropna().distinct()


def participant_structure(
    participants: DataFrame,
    *,
    match: str = "match_id",
    entity: str = "participant_id",
    team: str = "team_id",
    win: str = "win",
    expected_ids: int | None = 10,
) -> DataFrame:
    """Per match: participants, winners, teams, and whether the ids are exactly 1..n, n being
    ``expected_ids`` or, if that is None, the match's own number of participants."""
    count = F.countDistinct(entity)
    wanted = count if expected_ids is None else F.lit(expected_ids)
    won = F.coalesce(normalise_boolean(F.col(win)), F.lit(False))
    return participants.groupBy(match).agg(
        count.alias("participant_count"),
        F.count_if(won).alias("winner_count"),
        F.countDistinct(team).alias("team_count"),
        (
            (count == wanted) & (F.min(entity) == 1) & (F.max(entity) == wanted)
        ).alias("participant_ids_valid"),
    )


def match_manifest(
    matches: DataFrame,
    participants: DataFrame,
    snapshots: DataFrame,
    events: DataFrame,
    *,
    rules: Sequence[tuple[str, Column]] | None = None,
    expected_ids: int | None = 10,
) -> DataFrame:
    """One row per match with structure, coverage, eligibility and exclusion reasons.

    ``matches`` must be unique per match and ``participants`` per (match, participant).
    """
    structure = participant_structure(participants, expected_ids=expected_ids)
    seen = distinct_key_scan(snapshots, key="match_id").withColumn("_snap", F.lit(True))
    logged = distinct_key_scan(events, key="match_id").withColumn("_events", F.lit(True))
    # three tables of a row per match are folded into one, which the matches meet in one join
    found = [name for name in structure.columns if name != "match_id"] + ["_snap", "_events"]
    known = union_all(structure, seen, logged).groupBy("match_id").agg(*[F.max(name).alias(name) for name in found])
    joined = matches.select("match_id", "region", "queue_id", "end_of_game_result").join(known, "match_id", "left")
    zero, no = F.lit(0), F.lit(False)
    filled = joined.select(
        "match_id",
        F.col("region").alias("storage_partition"),
        "queue_id",
        "end_of_game_result",
        F.coalesce("participant_count", zero).alias("participant_count"),
        F.coalesce("winner_count", zero).alias("winner_count"),
        F.coalesce("team_count", zero).alias("team_count"),
        F.coalesce("participant_ids_valid", no).alias("participant_ids_valid"),
        F.coalesce("_snap", no).alias("has_snapshots"),
        F.coalesce("_events", no).alias("has_events"),
    )
    return eligibility_flag(filled, rules=rules or standard_rules())


def manifest_summary(manifest: DataFrame, *, region: str = "storage_partition") -> DataFrame:
    """Per region and in total (``ALL``): matches, eligible, excluded, rate."""
    counted = manifest.groupingSets([[], [region]], region).agg(
        F.count(F.lit(1)).alias("total_matches"),
        F.count_if("analysis_eligible").alias("eligible_matches"),
        F.grouping(region).alias("_all"),
    )
    return counted.select(
        F.when(F.col("_all") == 1, "ALL").otherwise(F.col(region)).alias("region"),
        "total_matches",
        "eligible_matches",
        (F.col("total_matches") - F.col("eligible_matches")).alias("excluded_matches"),
        (F.col("eligible_matches") / F.col("total_matches")).alias("eligibility_rate"),
    )


def exclusion_counts(manifest: DataFrame) -> DataFrame:
    return (
        manifest.filter(~F.col("analysis_eligible"))
        .groupBy(F.coalesce("exclusion_reason", F.lit("unknown")).alias("exclusion_reason"))
        .agg(F.count(F.lit(1)).alias("matches"))
        .orderBy(F.desc("matches"), "exclusion_reason")
    )


def semi_eligible(df: DataFrame, manifest: DataFrame, *, key: str = "match_id") -> DataFrame:
    return df.join(manifest.filter("analysis_eligible").select(key), key, "left_semi")


def semi_matches(df: DataFrame, matches: DataFrame, *, key: str = "match_id") -> DataFrame:
    """Rows whose match is in ``matches``, however often."""
    return df.join(matches.select(key).distinct(), key, "left_semi")


def anti_control_matches(matches: DataFrame, episodes: DataFrame, *, key: str = "match_id") -> DataFrame:
    """Matches without any episode, whatever its status."""
    return matches.join(episodes.select(key).distinct(), key, "left_anti")


def orphan_keys(child: DataFrame, parent: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Distinct child keys that no parent row has. Both sides are reduced to distinct keys
    before they meet, so a frequent key is one row."""
    return (
        child.select(*key).dropna().distinct().join(parent.select(*key).dropna().distinct(), list(key), "left_anti")
    )


def id_set_difference(expected: DataFrame, actual: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Keys on one side only, tagged ``missing`` (expected, absent) or ``unexpected``."""
    tagged = expected.select(*key, F.lit(1).alias("_e"), F.lit(0).alias("_a")).unionByName(
        actual.select(*key, F.lit(0).alias("_e"), F.lit(1).alias("_a"))
    )
    sides = tagged.groupBy(*key).agg(F.max("_e").alias("_e"), F.max("_a").alias("_a"))
    return sides.filter("_e <> _a").select(
        *key, F.when(F.col("_e") == 1, "missing").otherwise("unexpected").alias("side")
    )

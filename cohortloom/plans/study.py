"""The study from base tables to evidence, stage by stage.

Each stage that several later ones read is written once as a table; everything between two
stage tables is one Catalyst plan.
"""

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame

from ..operators import asof, candidates, episodes, manifest, matching, outcomes, state
from ..params import TIME_EDGES_MIN
from ..session import remove_stages, written
from ..session import materialise as write_stage


@dataclass
class Study:
    """Base tables: matches unique per match with ``region``, participants unique per
    (match, participant), snapshots, events with ``event_seq``."""

    matches: DataFrame
    participants: DataFrame
    snapshots: DataFrame
    events: DataFrame
    rules: list[tuple[str, Column]] | None = None
    expected_ids: int | None = 10
    time_edges: tuple[float, ...] = TIME_EDGES_MIN
    snapshots_of_matches: Callable[[DataFrame], DataFrame] | None = None  # snapshots of given matches, without making the rest
    _paths: list[tuple[int, int]] = field(default_factory=list, repr=False)

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        start = written()
        out = write_stage(df, name)
        self._paths.append((start, written()))
        return out

    def close(self) -> None:
        """Removes the stage tables that this study has written; its results end with them."""
        for start, stop in self._paths:
            remove_stages(self.matches.sparkSession, start, stop)
        self._paths.clear()

    def snapshots_of(self, matches: DataFrame) -> DataFrame:
        """Snapshots whose match is in ``matches``."""
        if self.snapshots_of_matches is not None:
            return self.snapshots_of_matches(matches)
        return manifest.semi_matches(self.snapshots, matches)

    @cached_property
    def manifest(self) -> DataFrame:
        built = manifest.match_manifest(
            self.matches,
            self.participants,
            self.snapshots,
            self.events,
            rules=self.rules,
            expected_ids=self.expected_ids,
        )
        return self._stage(built, "manifest")

    @cached_property
    def catalogue(self) -> DataFrame:
        eligible = manifest.semi_eligible(self.events, self.manifest)
        return episodes.item_event_filter(
            eligible,
            item_cols=["item_id", "before_item_id", "after_item_id"],
            item=episodes.EPISODE_ITEM,
        )

    @cached_property
    def episodes(self) -> DataFrame:
        eligible = manifest.semi_eligible(self.events, self.manifest)
        return self._stage(episodes.item_episodes(eligible), "episodes")

    @cached_property
    def case_attempts(self) -> DataFrame:
        # three joins of the case dataset read the snapshots of its matches, which are few of all
        snapshots = self._stage(self.snapshots_of(self.episodes), "case_snapshots")
        people = manifest.semi_matches(self.participants, self.episodes)
        return self._stage(state.case_dataset(self.episodes, self.matches, people, snapshots), "case_attempts")

    @cached_property
    def cases(self) -> DataFrame:
        return self.case_attempts.filter("failure is null").drop("failure")

    @cached_property
    def states(self) -> DataFrame:
        """State features of every eligible snapshot, with region."""
        eligible = (
            self.manifest.filter("analysis_eligible and storage_partition is not null")
            .select("match_id", "storage_partition")
            .withColumnRenamed("storage_partition", "region")
        )
        return self._stage(state.state_features(self.snapshots.join(eligible, "match_id"), self.participants), "states")

    @cached_property
    def pool(self) -> DataFrame:
        """Candidate controls of every case."""
        wanted = self.cases.select(
            "case_id", "match_id", "participant_id", "purchase_timestamp", "lifecycle_status", "region"
        )
        cases = self._stage(candidates.case_states(wanted, self.states), "case_states")
        controls = manifest.anti_control_matches(self.states, self.episodes)
        return self._stage(
            candidates.caliper_candidates(cases, controls), "candidate_pool"
        )

    @cached_property
    def features(self) -> DataFrame:
        observations = asof.union_distinct_observations(self.cases, self.pool)
        return self._stage(asof.recent_event_features(observations, self.events), "features")

    @cached_property
    def enriched_cases(self) -> DataFrame:
        own = self.features.withColumnRenamed("observation_timestamp", "purchase_timestamp")
        return self.cases.join(own, ["match_id", "participant_id", "purchase_timestamp"], "left")

    @cached_property
    def enriched_pool(self) -> DataFrame:
        return self._stage(matching.enrich_candidates(self.pool, self.features), "enriched_pool")

    @cached_property
    def scored(self) -> DataFrame:
        return matching.selection_score(self.enriched_pool)

    @cached_property
    def primary(self) -> DataFrame:
        return self._stage(matching.match_primary(self.cases, self.scored), "primary")

    @cached_property
    def relaxed(self) -> DataFrame:
        return self._stage(matching.match_relaxed(self.cases, self.scored), "relaxed")

    @cached_property
    def one_to_one(self) -> DataFrame:
        return self._stage(matching.match_one_to_one(self.primary), "one_to_one")

    @cached_property
    def primary_long(self) -> DataFrame:
        return self._stage(matching.matched_long(self.cases, self.primary), "primary_long")

    @cached_property
    def relaxed_long(self) -> DataFrame:
        return self._stage(matching.matched_long(self.cases, self.relaxed), "relaxed_long")

    @cached_property
    def one_to_one_long(self) -> DataFrame:
        return self._stage(matching.matched_long(self.cases, self.one_to_one), "one_to_one_long")

    @property
    def samples(self) -> dict[str, tuple[DataFrame, DataFrame]]:
        """The selected controls and the long table of each design."""
        return {
            "primary": (self.primary, self.primary_long),
            "relaxed": (self.relaxed, self.relaxed_long),
            "one_to_one": (self.one_to_one, self.one_to_one_long),
        }

    @cached_property
    def effects(self) -> DataFrame:
        return outcomes.add_groups(
            outcomes.matched_set_effects(self.primary_long), time_edges=self.time_edges
        )

"""Open/close episodes from an event log."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import next_in_order
from ..params import EPISODE_ITEM
from .quantiles import exact_quantiles


def item_event_filter(events: DataFrame, *, item_cols: Sequence[str], item: int) -> DataFrame:
    """Events in which any of the item columns names the item."""
    hit = F.lit(False)
    for name in item_cols:
        hit = hit | F.coalesce(F.col(name) == item, F.lit(False))
    return events.filter(hit)


def episode_reconstruct(
    events: DataFrame,
    *,
    by: Sequence[str],
    ts: str,
    seq: Sequence[str],
    open_when: Column,
    undo_when: Column,
    close_when: Column,
    slice_ms: int = 6 * 3_600_000,
) -> DataFrame:
    """One row per opening event; the next effective event of the same key decides its status.

    Only openings, undos and closes take part. A close with nothing open follows a close, an
    undo or nothing, so it is never the successor of an opening and drops out by itself.
    """
    kind = F.when(open_when, "open").when(undo_when, "undo").when(close_when, "close")
    effective = (
        events.select(*by, F.col(ts).alias("_ts"), *seq, kind.alias("_kind"))
        .filter(F.col("_kind").isNotNull() & F.col("_ts").isNotNull())
        .dropna(subset=list(by))
    )
    ordered = next_in_order(
        effective, by=by, ts="_ts", tie=seq, values=["_kind", "_ts"], slice_ms=slice_ms
    )
    following = F.col("next._kind")
    sold_at = F.when(following == "close", F.col("next._ts"))
    return ordered.filter("_kind = 'open'").select(
        *by,
        F.col("_ts").alias("purchase_timestamp"),
        sold_at.alias("sale_timestamp"),
        (sold_at - F.col("_ts")).alias("time_held_ms"),
        F.when(following.isNull(), "RETAINED")
        .when(following == "close", "SOLD")
        .when(following == "undo", "UNDONE")
        .otherwise("PURCHASED_AGAIN_BEFORE_SALE")
        .alias("status"),
    )


def item_episodes(events: DataFrame, *, item: int = EPISODE_ITEM, slice_ms: int = 600_000) -> DataFrame:
    """Episodes of one item per (match, participant), from the extracted event table."""
    catalogue = item_event_filter(
        events, item_cols=["item_id", "before_item_id", "after_item_id"], item=item
    )
    kind = F.upper(F.trim("event_type"))
    return episode_reconstruct(
        catalogue,
        by=["match_id", "participant_id"],
        ts="timestamp",
        seq=["event_seq"],
        open_when=kind == "ITEM_PURCHASED",
        undo_when=(kind == "ITEM_UNDO") & (F.col("before_item_id") == item),
        close_when=(kind == "ITEM_SOLD") & (F.col("item_id") == item),
        slice_ms=slice_ms,
    )


def event_type_counts(events: DataFrame, *, type_col: str = "event_type") -> DataFrame:
    return events.groupBy(F.col(type_col).alias("event_type")).agg(F.count(F.lit(1)).alias("events"))


def episode_summary(episodes: DataFrame, *, match: str = "match_id", entity: str = "participant_id") -> DataFrame:
    """Counts per status with a held-time profile of the sold ones; ``ALL`` is the total."""
    by_status = episodes.groupBy("status").agg(
        F.count(F.lit(1)).alias("episodes"),
        F.countDistinct(match).alias("matches"),
        F.countDistinct(match, entity).alias("players"),
        F.avg("time_held_ms").alias("mean_held_ms"),
        F.min("time_held_ms").alias("min_held_ms"),
        F.max("time_held_ms").alias("max_held_ms"),
    )
    total = episodes.agg(
        F.lit("ALL").alias("status"),
        F.count(F.lit(1)).alias("episodes"),
        F.countDistinct(match).alias("matches"),
        F.countDistinct(match, entity).alias("players"),
        F.lit(None).cast("double").alias("mean_held_ms"),
        F.lit(None).cast("bigint").alias("min_held_ms"),
        F.lit(None).cast("bigint").alias("max_held_ms"),
    )
    median = exact_quantiles(
        episodes.filter("status = 'SOLD'"), by=["status"], value="time_held_ms", probs=[0.5]
    ).select("status", F.col("quantile").alias("median_held_ms"))
    return by_status.unionByName(total).join(F.broadcast(median), "status", "left")



"""Ordered-sequence primitives that never put a whole hot key into one task.

A sequence is cut into time slices, so the shuffle key is (entity, slice) instead of
(entity). Look-backs with a known bound copy only the rows near a slice border into the
neighbouring slice; unbounded look-ahead carries one row per slice.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A slice is this many look-back lengths wide and one row in so many is copied. Lower it, down
# to 1, for logs in which one entity holds a large share of a few look-back lengths.
SLICE_FACTOR = 8


def slice_of(ts: Column, width: int) -> Column:
    return F.floor(ts / F.lit(width)).cast("bigint")


def look_back_slices(ts: Column, bound: int, factor: int = SLICE_FACTOR) -> Column:
    """Slices in which a row at ``ts`` may be looked back on from up to ``bound`` later."""
    width = slice_width(bound, factor)
    own = slice_of(ts, width)
    return F.when(
        slice_of(ts + F.lit(bound), width) > own, F.array(own, own + F.lit(1).cast("bigint"))
    ).otherwise(F.array(own))


def slice_width(bound: int, factor: int = SLICE_FACTOR) -> int:
    return max(1, bound) * max(1, factor)


def next_in_order(
    df: DataFrame, *, by: Sequence[str], ts: str, tie: Sequence[str], values: Sequence[str], slice_ms: int
) -> DataFrame:
    """Adds ``next``: a struct of ``values`` from the following row of the same key.

    Inside a slice this is a plain ``lead``. The last row of a slice takes the first row of
    the next non-empty slice; that carry table has one row per (key, slice).
    """
    order = [ts, *tie]
    sliced = df.withColumn("_slice", slice_of(F.col(ts), slice_ms))
    payload = F.struct(*values)
    inside = Window.partitionBy(*by, "_slice").orderBy(*order)
    across = Window.partitionBy(*by).orderBy("_slice")
    heads = (
        sliced.groupBy(*by, "_slice")
        .agg(F.min_by(payload, F.struct(*order)).alias("_head"))
        .withColumn("_carry", F.lead("_head").over(across))
        .filter("_carry is not null")
        .drop("_head")
    )
    return (
        sliced.withColumn("_next", F.lead(payload).over(inside))
        .join(heads, [*by, "_slice"], "left")
        .withColumn("next", F.coalesce("_next", "_carry"))
        .drop("_next", "_carry", "_slice")
    )

"""Row and schema normalisation on whole frames."""

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coerce_types(df: DataFrame, *, casts: Mapping[str, str], required: Sequence[str]) -> DataFrame:
    """Cast with failures to null, turn NaN into null, drop rows lacking a required value.

    Integer targets accept decimal text ("3.0") and truncate, like a numeric parse followed
    by an integer cast.
    """
    whole = {"int", "bigint", "smallint", "long", "integer"}
    columns = []
    for name in df.columns:
        target = casts.get(name)
        column = F.col(name)
        if target is None:
            columns.append(column)
        elif target in whole:
            direct = column.try_cast(target)
            columns.append(F.coalesce(direct, column.try_cast("double").try_cast(target)).alias(name))
        elif target == "double":
            value = column.try_cast("double")
            columns.append(F.when(~F.isnan(value), value).alias(name))
        else:
            columns.append(column.try_cast(target).alias(name))
    return df.select(*columns).dropna(subset=list(required))


def dedupe(df: DataFrame, *, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key under a total order. Plans as a group limit, so a map task ships
    at most one row per key."""
    return ranked(df, key=key, order=order).filter("_rn = 1").drop("_rn")


def ranked(df: DataFrame, *, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Adds ``_rn``, the place of a row among those of its key, from 1."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def latest_first(order: Sequence[str]) -> list[Column]:
    return [F.col(name).desc_nulls_last() for name in order]


def dedupe_keep_last(df: DataFrame, *, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    return dedupe(df, key=key, order=latest_first(order))


def eligibility_flag(
    df: DataFrame,
    *,
    rules: Sequence[tuple[str, Column]],
    flag: str = "analysis_eligible",
    reason: str = "exclusion_reason",
) -> DataFrame:
    """Each rule is (reason, condition). An unknown condition counts as broken."""
    broken = [(name, ~F.coalesce(condition, F.lit(False))) for name, condition in rules]
    text = F.concat_ws("|", *[F.when(bad, name) for name, bad in broken])
    any_broken = F.lit(False)
    for _, bad in broken:
        any_broken = any_broken | bad
    return df.withColumn(flag, ~any_broken).withColumn(reason, F.when(text != "", text))


def prefix_rename(df: DataFrame, *, prefix: str, columns: Iterable[str]) -> DataFrame:
    return df.withColumnsRenamed({name: f"{prefix}{name}" for name in columns})


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def union_all(*dfs: DataFrame) -> DataFrame:
    result = dfs[0]
    for other in dfs[1:]:
        result = result.unionByName(other, allowMissingColumns=True)
    return result

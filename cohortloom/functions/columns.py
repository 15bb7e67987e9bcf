"""Column-level building blocks: plain expressions, no Python in the data path."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import FALSE_WORDS, TRUE_WORDS


def normalise_boolean(column: Column) -> Column:
    """Boolean, 0/1 number or win/loss word to a nullable boolean."""
    word = F.lower(F.trim(column.cast("string")))
    number = column.try_cast("double")
    from_word = F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
    from_number = F.when(number == 1.0, True).when(number == 0.0, False)
    return F.when(F.typeof(column) == "string", from_word).otherwise(from_number)


def normalise_status(column: Column, *, aliases: Mapping[str, str] | None = None) -> Column:
    text = F.upper(F.trim(column.cast("string")))
    result = text
    for old, new in ({"UNDO": "UNDONE"} if aliases is None else aliases).items():
        result = F.when(text == old, new).otherwise(result)
    return result


def normalise_id_list(column: Column) -> Column:
    """Array or list-like text to an array of positive integers; nothing parsable is empty.
    Brackets are taken off the whole, quotes and spaces off each item: "1 2" is no item."""
    text = F.regexp_replace(column.cast("string"), r"^[\s\[({]+|[\s\])}]+$", "")
    items = F.transform(F.split(text, ","), lambda part: F.regexp_replace(part, r"^[\s'\"]+|[\s'\"]+$", ""))
    ids = F.transform(items, lambda part: part.try_cast("double").try_cast("int"))
    return F.coalesce(F.filter(ids, lambda item: item > 0), F.array().cast("array<int>"))


def observation_key(*columns: str) -> Column:
    parts: list[Column] = []
    for name in columns:
        parts += [F.lit("_"), F.col(name).cast("string")]
    return F.concat(*parts[1:])


def relative_gap(left: Column, right: Column) -> Column:
    return F.abs(left - right) / F.greatest(F.abs(left), F.abs(right), F.lit(1.0))


def state_bins(column: Column, *, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Left-closed bins; a null value stays null."""
    result = F.when(column < edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:]):
        result = result.when(column < edge, label)
    return result.when(column >= edges[-1], labels[-1])


def region_of(match_id: Column, rules: Mapping[str, Sequence[str]]) -> Column:
    text = F.upper(match_id)
    result = F.lit(None).cast("string")
    for region, prefixes in reversed(list(rules.items())):
        hit = F.lit(False)
        for prefix in prefixes:
            hit = hit | text.startswith(prefix)
        result = F.when(hit, region).otherwise(result)
    return result


def route_region(df: DataFrame, *, id_col: str, rules: Mapping[str, Sequence[str]]) -> DataFrame:
    return df.withColumn("region", region_of(F.col(id_col), rules))

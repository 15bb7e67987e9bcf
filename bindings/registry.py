"""Query registry: one Spark callable and, where SQL can say it, one comparison query."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ctes import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None, exact: tuple[str, ...] = ()):
    """``exact`` names the doubles that both sides make by the same exact steps: not rounded,
    since a value that lies on a tie rounds up on one side and down on the other."""

    def register(function):
        QUERIES[name] = lambda spark, sf_dir: six_places(function(spark, sf_dir), exact)
        if sql is not None:
            ORACLE[name] = with_ctes(sql)
        return function

    return register


def six_places(df: DataFrame, exact: tuple[str, ...] = ()) -> DataFrame:
    """Doubles to six places, so that summation order does not show."""
    return df.select(
        *[
            F.round(f.name, 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) and f.name not in exact else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def check_rows(source: str, sample: str, checks: list[tuple[str, str, str]], scope: str = "'all'") -> str:
    """SQL of tidy check rows, one per (name, severity, failing condition)."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, {scope} AS scope, '{severity}' AS severity, "
        f"count(*) FILTER ({bad}) AS failing_count, min(CAST({sample} AS STRING)) FILTER ({bad}) AS sample FROM {source}"
        for name, severity, bad in checks
    )

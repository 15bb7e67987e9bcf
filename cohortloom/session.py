"""Session defaults and the shared folder that stage tables are written to."""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed partition even if that costs one more exchange downstream
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # as many splits of an input as there are cores, also where one file is small
    "spark.sql.files.openCostInBytes": "1048576",
    # hash instead of sort where every partition of a side proves small at run time
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
}


def build_session(app: str = "cohortloom", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else the checkpoint folder that the context
    was given, else a folder in the warehouse, which driver and executors share as well."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/stages"


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, a query that ends takes its shuffle files along. They would stay until the driver
    happens to collect its garbage, and what was written is read from its table from then on."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a stage table and read it back.

    Later steps then see a plain Parquet scan: lineage is cut, column pruning and size
    statistics still work, a lost executor costs only its own tasks, and the shuffles that made
    the table leave the disk with the write.
    """
    path = stage_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    keep_stage(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_written: list[str] = []


def keep_stage(spark: SparkSession, path: str) -> str:
    """Notes a folder as a stage table, which ``remove_stages`` may remove."""
    _written.append(path)
    return path


def written() -> int:
    """How many stage tables this driver has written: a mark for ``remove_stages``."""
    return len(_written)


def remove_stages(spark: SparkSession, start: int, stop: int | None = None) -> None:
    """Removes the stage tables written from mark ``start`` to mark ``stop``. What was read from
    them can't be read again."""
    for i in range(start, len(_written) if stop is None else stop):
        if _written[i]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written[i])
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            _written[i] = ""

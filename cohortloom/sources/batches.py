"""Tables kept as batches, one folder per (table, region, batch), and what files alone tell.

Layout: ``<folder>/<table>/region=<region>/batch_id=<number>/*.parquet``. Region names are plain
words. A batch is at most some hundred matches, so there are many small folders; listing them and
reading their footers is work for tasks, not for the driver.
"""

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..session import materialise, shuffles_removed, stage_path
from .tables import loaded_batches

KEY = ("region", "batch_id")
LEDGER = "_ledger"
LEDGER_SCHEMA = "table_name string, region string, batch_id bigint, rows bigint"


def write_batches(
    df: DataFrame, folder: str, table: str, *, mode: str = "errorifexists", make: Callable[[DataFrame], DataFrame] | None = None
) -> None:
    """Rows of whole batches. Rows without region or batch belong to none and are left out. Each
    batch is one file: many small files take their time, so the batches stay dealt to all tasks.
    With ``make`` the rows are made of those of ``df``, row by row and with their region and batch:
    ``df`` is then dealt in place of the many rows it becomes."""
    rows = df.dropna(subset=list(KEY)).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEY)
    rows = rows if make is None else make(rows)
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*KEY).parquet(f"{folder}/{table}")


def key_of_path():
    """table_name, region and batch_id, as the folders of a file's ``path`` name them."""
    part = lambda i: F.regexp_extract("path", r"([^/]+)/region=([^/]+)/batch_id=(\d+)/[^/]+$", i)
    return part(1).alias("table_name"), part(2).alias("region"), part(3).try_cast("bigint").alias("batch_id")


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def listing_dealt(spark: SparkSession) -> Iterator[None]:
    """A job that lists folders has a task for each of them otherwise, and starting these takes
    longer than listing. Reading a path lists it at once, so the setting need not last."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, listing_tasks(spark))
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


def listing_tasks(spark: SparkSession) -> str:
    return str(max(2, 2 * spark.sparkContext.defaultParallelism))


def batch_files(spark: SparkSession, folder: str) -> DataFrame:
    """(table_name, region, batch_id, path, bytes) of every file of every table. Only names are
    read: neither data nor footers. A folder without files gives no rows."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    path = F.col("_metadata.file_path")
    with listing_dealt(spark):
        found = listed.load(folder)
    return (
        found.select(path.alias("path"), F.col("_metadata.file_size").alias("bytes"))
        .select(*key_of_path(), "path", "bytes")
        .filter("batch_id IS NOT NULL")
    )


def batch_list(spark: SparkSession, folder: str) -> DataFrame:
    """The batches that each table has, (table_name, region, batch_id), from the names of files."""
    return batch_files(spark, folder).select("table_name", *KEY).distinct()


def read_batches(spark: SparkSession, folder: str, table: str, schema: T.StructType | None = None) -> DataFrame:
    """One table with its region and batch. With a ``schema`` a table without files is empty."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        with listing_dealt(spark):
            found = reader.parquet(f"{folder}/{table}")
    except AnalysisException:
        if schema is None:
            raise
        return spark.createDataFrame([], schema)
    # partition values that all look like numbers or are missing would be guessed otherwise
    return found.withColumns({"region": F.col("region").cast("string"), "batch_id": F.col("batch_id").cast("bigint")})


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """What was loaded wholly: a row for each table and batch, with its number of rows."""
    path = f"{folder}/{LEDGER}"
    spark.createDataFrame([], LEDGER_SCHEMA).write.mode("append").parquet(path)  # also where there is none yet
    return spark.read.schema(LEDGER_SCHEMA).parquet(path).distinct()


def commit_batches(spark: SparkSession, sources: dict[str, DataFrame], folder: str, *, planned: DataFrame | None = None, again: bool = False) -> None:
    """Loads the batches of ``sources`` (tables by name, with region and batch_id) that the ledger
    lacks, table by table.

    The rows of a table go first, as overwritten batch folders, its ledger rows after them. A run
    that is cut off in between leaves batches that the ledger does not name; the next run writes
    the same folders anew, so nothing is lost and nothing doubles. A table without rows for a
    batch that another table has is named with 0 rows: such a batch is complete and stays so.

    ``planned`` (table_name, region, batch_id) limits what is loaded, ``again`` loads it even if
    the ledger has it.
    """
    if planned is None:
        keys = None
        for rows in sources.values():
            keys = rows.select(*KEY) if keys is None else keys.unionByName(rows.select(*KEY))
        keys = keys.dropna().distinct()
        names = F.explode(F.array(*map(F.lit, sources)))
        planned = keys.withColumn("table_name", names).select("table_name", *KEY)
    if not again:
        planned = planned.join(ledger(spark, folder), ["table_name", *KEY], "left_anti")
    planned = materialise(planned, "batches-planned")
    with shuffles_removed(spark):
        for name, rows in sources.items():
            todo = planned.filter(F.col("table_name") == name).select(*KEY)
            if todo.isEmpty():
                continue
            write_batches(rows.join(todo, list(KEY), "left_semi"), folder, name, mode="overwrite")
            sizes = read_batches(spark, folder, name, rows.schema).join(todo, list(KEY), "left_semi").groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows"))
            done = todo.join(sizes, list(KEY), "left").select(F.lit(name).alias("table_name"), *KEY, F.coalesce("rows", F.lit(0)).alias("rows"))
            done.write.mode("append").parquet(f"{folder}/{LEDGER}")


def complete_batches(spark: SparkSession, folder: str, tables: Sequence[str]) -> DataFrame:
    """The batches that the ledger has for all ``tables``."""
    return loaded_batches(ledger(spark, folder), tables=tables, by=KEY)


def stream_batches(spark: SparkSession, landing: str, folder: str, checkpoint: str, *, tables: dict[str, str], max_files: int = 1000) -> None:
    """Loads the batches whose files have arrived in ``landing`` since the last call.

    The stream carries the names of files alone. Each micro-batch commits, of each table, the
    whole batches that got a file: a micro-batch that is repeated after a failure writes the same
    folders, and a batch whose files come in two micro-batches is whole after the second.
    ``tables`` gives the schema of each table, region and batch_id included. A table of which no
    file ever arrives for a batch stays out of the ledger.
    """
    named = "path string, modificationTime timestamp, length bigint, content binary"
    files = (
        spark.readStream.format("binaryFile").schema(named).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
        .option("maxFilesPerTrigger", max_files).load(landing).select("path")
    )
    keys = files.select(*key_of_path())

    def commit(arrived: DataFrame, _: int) -> None:
        session = arrived.sparkSession
        planned = arrived.filter("batch_id IS NOT NULL").filter(F.col("table_name").isin(*tables)).distinct()
        sources = {name: read_batches(session, landing, name, T.StructType.fromDDL(schema)) for name, schema in tables.items()}
        commit_batches(session, sources, folder, planned=planned, again=True)

    query = keys.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def leaves(kind: T.DataType) -> int:
    """Columns that a Parquet file keeps for a type."""
    if isinstance(kind, T.StructType):
        return sum(leaves(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return leaves(kind.elementType)
    if isinstance(kind, T.MapType):
        return leaves(kind.keyType) + leaves(kind.valueType)
    return 1


def filled_counts(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """(region, batch_id, column_name, filled, rows): values that are not null, of every column of
    every batch of a table.

    Counts of flat columns come from the column statistics in the footers: an aggregate over
    partition columns alone is answered by the scan itself. Rows are read for nested columns, whose
    statistics count elements, and for all columns if a file has no statistics.
    """
    path = f"{folder}/{table}"
    # one frame of the newer reader, which lists the many folders once for all that is read here
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    own.conf.set(LISTING, listing_tasks(spark))
    found = own.read.parquet(path)
    schema = [f for f in found.schema.fields if f.name not in KEY]
    nested = [f.name for f in schema if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)]
    # statistics are found by the place of a column, so all before it have to be one column each
    flat = [] if any(leaves(f.dataType) != 1 for f in schema) else [f.name for f in schema if f.name not in nested]

    def counted(columns: list[str]) -> DataFrame:
        counts = found.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in columns])
        return counts.withColumns({"region": F.col("region").cast("string"), "batch_id": F.col("batch_id").cast("bigint")})

    done = None
    if flat:
        stored = footer_table(spark, counted(flat))
        if stored is not None:
            done = long_form(stored, flat)
    rest = nested if done is not None else [f.name for f in schema]
    if rest:
        own.conf.set("spark.sql.parquet.aggregatePushdown", "false")
        read = long_form(footer_table(spark, counted(rest)), rest)
        done = read if done is None else done.unionByName(read)
    return done


def footer_table(spark: SparkSession, counts: DataFrame) -> DataFrame | None:
    """The counts as a stage table of ``spark``; None where a file has no statistics."""
    path = stage_path(spark, "footer-counts")
    try:
        counts.write.parquet(path)
    except Exception as error:  # Spark wraps what the scan says in an error of its task
        if "aggregatePushdown" not in str(error):
            raise
        return None
    return spark.read.schema(counts.schema).parquet(path)


def long_form(counts: DataFrame, columns: list[str]) -> DataFrame:
    return counts.unpivot([*KEY, "_rows"], columns, "column_name", "filled").select(*KEY, "column_name", "filled", F.col("_rows").alias("rows"))


def all_null_batch_columns(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The columns of each batch that are null in all of its rows."""
    return filled_counts(spark, folder, table).filter("filled = 0 AND rows > 0").select(F.lit(table).alias("table_name"), *KEY, "column_name")

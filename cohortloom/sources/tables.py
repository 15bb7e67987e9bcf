"""Schemas, tolerant scans and sinks of the base tables."""

import json
import re
import sys
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions.frames import require_columns, union_all
from ..session import materialise

# the functions that read footers travel with their tasks; executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MATCHES = (
    "match_id string, game_id bigint, game_creation bigint, game_start_timestamp bigint, "
    "game_duration bigint, game_end_timestamp bigint, game_version string, queue_id int, "
    "map_id int, game_mode string, game_type string, platform_id string, end_of_game_result string"
)
PARTICIPANTS = (
    "match_id string, participant_id int, puuid string, team_id int, team_position string, "
    "champion_id int, champion_name string, win boolean, gold_earned bigint, gold_spent bigint, "
    "champ_level bigint, champ_experience bigint, kills bigint, deaths bigint, assists bigint, "
    "damage_dealt_to_champions bigint, damage_taken bigint, item0 bigint, item1 bigint, "
    "item2 bigint, item3 bigint, item4 bigint, item5 bigint, item6 bigint"
)
SNAPSHOTS = (
    "match_id string, timestamp bigint, participant_id int, current_gold bigint, total_gold bigint, "
    "gold_per_second bigint, level bigint, xp bigint, minions_killed bigint, "
    "jungle_minions_killed bigint, position_x bigint, position_y bigint"
)
EVENTS = (
    "match_id string, event_seq bigint, timestamp bigint, event_type string, position_x int, "
    "position_y int, participant_id int, item_id int, before_item_id int, after_item_id int, "
    "killer_id int, victim_id int, assisting_ids array<int>, building_type string, "
    "lane_type string, team_id int, monster_type string, monster_sub_type string"
)


def scan_tolerant_columns(
    spark: SparkSession, path: str, *, schema: str | T.StructType, required: Sequence[str], fmt: str = "parquet"
) -> DataFrame:
    """Read with the schema's columns and types: absent optional ones become null, an absent
    required one is an error, in whichever file it is absent. Files of one folder may differ in
    columns and types: those of equal footers are read in one scan, cast and put together."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    parts = []
    for found in (_same_schema_scans(spark, path) if fmt == "parquet" else [spark.read.format(fmt).load(path)]):
        require_columns(found, required)
        present = set(found.columns)
        parts.append(
            found.select(
                *[
                    (F.col(f.name).try_cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name)
                    for f in schema.fields
                ]
            )
        )
    return union_all(*parts)


FOOTER = "path string, columns array<struct<name string, type string>>"


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(path, columns) of the Parquet files below a folder: names and Spark types of the columns
    of each. Tasks read the footers. Files in a store that only Spark can open are read whole, by
    its own reader, and their footers taken from the bytes."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)

    def opened(batches):
        for batch in batches:
            files = batch.column("path").to_pylist()
            yield footer_rows(files, [open_footer(file) for file in files])

    def given(batches):
        for batch in batches:
            sources = [pa.BufferReader(content.as_buffer()) for content in batch.column("content")]
            yield footer_rows(batch.column("path").to_pylist(), [columns_of(pq.read_schema(source)) for source in sources])

    found = materialise(listed.select("path").mapInArrow(opened, FOOTER), "footers")
    closed = found.filter("columns IS NULL")
    if closed.isEmpty():
        return found
    rest = listed.select("path", "content").join(closed.select("path"), "path", "left_semi").mapInArrow(given, FOOTER)
    return found.filter("columns IS NOT NULL").unionByName(materialise(rest, "footers"))


def open_footer(file: str) -> list[dict] | None:
    """The columns of a file that Arrow can open by its address, else None."""
    try:
        if file.startswith("file:"):
            return columns_of(pq.read_schema(file[5:].replace("//", "/", 1) if file.startswith("file://") else file[5:]))
        store, name = fs.FileSystem.from_uri(file)
        return columns_of(pq.read_schema(name, filesystem=store))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None


def columns_of(schema: pa.Schema) -> list[dict]:
    """Names and Spark types of the columns: those that Spark noted in the file, else Arrow's."""
    noted = (schema.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
    kind = T.StructType.fromJson(json.loads(noted)) if noted else from_arrow_schema(schema)
    return [{"name": f.name, "type": f.dataType.simpleString()} for f in kind.fields]


def footer_rows(files: list[str], columns: list) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())]))
    return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(columns, kind)], ["path", "columns"])


def _same_schema_scans(spark: SparkSession, path: str) -> list[DataFrame]:
    """A scan for each distinct schema; only these, with the names of their files, reach the driver."""
    found = footers(spark, path)
    order = F.array_join(F.transform("columns", lambda c: F.concat_ws(" ", c["name"], c["type"])), ",")
    groups = found.groupBy(order.alias("schema")).agg(F.sort_array(F.collect_list("path")).alias("files")).orderBy("schema").collect()
    if not groups:
        raise ValueError(f"no Parquet files in {path}")
    partitioned = any(re.search(r"/[^/]+=[^/]+/[^/]+$", file) for group in groups for file in group["files"])
    reader = spark.read.option("basePath", path) if partitioned else spark.read
    return [reader.parquet(*group["files"]) for group in groups]


def column_types(spark: SparkSession, path: str) -> DataFrame:
    """Tidy types of the columns of a folder of Parquet files: column_name, types (sorted,
    joined by |), files_missing (files without the column) and drifts."""
    found = footers(spark, path)
    files = found.agg(F.count(F.lit(1))).scalar()
    types = found.select(F.explode("columns").alias("c")).groupBy(F.col("c.name").alias("column_name")).agg(
        F.array_sort(F.collect_set("c.type")).alias("types"), F.count(F.lit(1)).alias("files")
    )
    return types.select(
        "column_name", F.array_join("types", "|").alias("types"), (files - F.col("files")).cast("int").alias("files_missing"), (F.size("types") > 1).alias("drifts")
    )


def scan_region_partition(
    spark: SparkSession,
    path: str,
    *,
    region: str,
    columns: Sequence[str] | None = None,
    keys: DataFrame | None = None,
    key: str = "match_id",
    partition: str = "region",
) -> DataFrame:
    """One region of a partitioned table: partition and column pruning happen at the scan, an
    id list of any size is a semi-join."""
    table = spark.read.parquet(path).filter(F.col(partition) == region)
    if columns is not None:
        table = table.select(*[c for c in columns if c in table.columns])
    if keys is not None:
        table = table.join(keys.select(key).distinct(), key, "left_semi")
    return table


def read_id_list_csv(spark: SparkSession, path: str, *, column: str = "match_id") -> DataFrame:
    # a header file may list further columns, so names come from the header, types stay text
    return spark.read.csv(path, header=True, inferSchema=False).select(column)


def incremental_load(new: DataFrame, existing: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """The new rows whose key is not loaded yet."""
    return new.join(existing.select(*key).distinct(), list(key), "left_anti")


def loaded_batches(
    files: DataFrame, *, tables: Sequence[str], by: Sequence[str] = ("region", "batch_id"), table_col: str = "table_name"
) -> DataFrame:
    """The batches that every one of the tables has. A batch lost from one table is not loaded:
    as ``existing`` of ``incremental_load`` this loads it again."""
    return (
        files.filter(F.col(table_col).isin(*tables))
        .groupBy(*by)
        .agg(F.count_distinct(table_col).alias("n_tables"))
        .filter(F.col("n_tables") == len(set(tables)))
        .select(*by)
    )


def write_dataset(
    df: DataFrame, path: str, *, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    """Parquet, CSV or JSON; the output committer makes the result appear as a whole."""
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)

"""Resumable file ingest: each new file is loaded once, whatever interrupts the run."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def load_new_files(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    *,
    schema: str | T.StructType,
    fmt: str = "parquet",
    glob: str | None = None,
    max_files: int = 1000,
    transform=None,
) -> DataFrame:
    """Appends the files not seen before to ``target`` and returns the whole target.

    The query's checkpoint records finished files and the file sink's log hides rows of a
    batch that was cut off, so a rerun neither repeats nor loses a file.
    """
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.load(source)
    if transform is not None:
        rows = transform(rows)
    query = (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(target)
    )
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(target)

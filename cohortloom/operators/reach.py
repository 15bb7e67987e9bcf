"""Breadth-first reach over a bipartite player/match graph."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import keep_stage, materialise, stage_path


def hop_zero(rows: DataFrame, name: str) -> DataFrame:
    """A new table with a folder per hop, the first one written."""
    path = keep_stage(rows.sparkSession, stage_path(rows.sparkSession, name))
    rows.write.parquet(f"{path}/hop=0")
    return all_hops(rows.sparkSession, path, rows.schema)


def all_hops(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    schema = T.StructType([*[f for f in schema.fields if f.name != "hop"], T.StructField("hop", T.IntegerType())])
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def delta(found: DataFrame, reached: DataFrame, key: str, hop: int) -> tuple[DataFrame, DataFrame]:
    """What of ``found`` was not reached before, appended as the folder of this hop, and all that
    is reached with it."""
    spark = found.sparkSession
    path = reached.inputFiles()[0].rsplit("/hop=", 1)[0]
    found.join(reached, key, "left_anti").select(key).write.parquet(f"{path}/hop={hop}")
    return spark.read.schema(found.select(key).schema).parquet(f"{path}/hop={hop}"), all_hops(spark, path, found.select(key).schema)


def frontier_expand(
    edges: DataFrame,
    seeds: DataFrame,
    *,
    player: str = "player",
    match: str = "match",
    recency: str = "recency",
    per_player: int = 20,
    max_hops: int | None = None,
    match_target: int | None = None,
) -> DataFrame:
    """Rows (kind, id, hop, complete) reached from the seed players; ids keep their type, as
    text where players and matches differ in it.

    A hop takes each frontier player's newest ``per_player`` matches and then everybody in
    the new ones. It goes on until nothing new is found, or until the match target is met or
    ``max_hops`` are done, if the caller names them; ``complete`` says whether the frontier was
    empty at the end. Each hop is one pair of joins against two prepared edge tables; only its
    row count returns to the driver. What was reached is one table per kind, to which each hop
    appends a folder: the plan does not grow with the hops, and the bytes written grow with the
    reach alone. Whole hops are kept when the match target is met.
    """
    newest = Window.partitionBy("player").orderBy(F.col("recency").desc(), F.col("match").desc())
    distinct = (
        edges.select(F.col(player).alias("player"), F.col(match).alias("match"), F.col(recency).alias("recency"))
        .filter("player IS NOT NULL AND match IS NOT NULL")
        .groupBy("player", "match")
        .agg(F.max("recency").alias("recency"))
    )
    outgoing = materialise(
        distinct.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= per_player).select("player", "match"),
        "reach_out",
    )
    # only matches somebody can step into matter on the way back
    incoming = materialise(
        distinct.select("match", "player").join(outgoing.select("match").distinct(), "match", "left_semi"), "reach_in"
    )
    seed_rows = seeds.select(F.col(player).alias("player")).filter("player IS NOT NULL").distinct()
    players = hop_zero(seed_rows, "reach_players")
    matches = hop_zero(outgoing.select("match").limit(0), "reach_matches")
    frontier, hop, found = players, 0, 0
    complete = frontier.isEmpty()
    while not complete and (max_hops is None or hop < max_hops) and (match_target is None or found < match_target):
        hop += 1
        stepped = outgoing.join(frontier, "player", "left_semi").select("match").distinct()
        new_matches, matches = delta(stepped, matches, "match", hop)
        reached = incoming.join(new_matches, "match", "left_semi").select("player").distinct()
        frontier, players = delta(reached, players, "player", hop)
        found = matches.count() if match_target is not None else 0
        complete = frontier.isEmpty()
    same = players.schema["player"].dataType == matches.schema["match"].dataType
    text = (lambda name: F.col(name).alias("id")) if same else (lambda name: F.col(name).cast("string").alias("id"))
    nodes = players.select(F.lit("player").alias("kind"), text("player"), "hop").unionByName(
        matches.select(F.lit("match").alias("kind"), text("match"), "hop")
    )
    return nodes.withColumn("complete", F.lit(complete))

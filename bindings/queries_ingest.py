"""Sources, sinks, extraction and normalisation over the given tables."""

from pyspark.sql import functions as F

from cohortloom.functions import columns as fc
from cohortloom.functions import frames as ff
from cohortloom.operators.manifest import distinct_key_scan
from cohortloom.params import INGEST_REGIONS, RESEARCH_REGIONS
from cohortloom.session import stage_path
from cohortloom.sources import documents as docs
from cohortloom.sources import tables as src
from cohortloom.sources.batches import commit_batches, complete_batches, read_batches
from cohortloom.streaming.ingest import load_new_files

from . import derive, tables
from .ctes import _region
from .derive import L_MATCH, O_MATCH, QTY
from .registry import query

ORDER_MS = "unix_micros(CAST(o_orderdate AS TIMESTAMP)) DIV 1000"


@query(
    "extract_matches",
    f"""SELECT {O_MATCH} AS match_id, o_orderkey AS game_id, epoch_ms(o_orderdate) AS game_creation,
    CAST(NULL AS BIGINT) AS game_start_timestamp, 600 + o_custkey % 1800 AS game_duration,
    epoch_ms(o_orderdate) + (600 + o_custkey % 1800) * 1000 AS game_end_timestamp,
    concat('14.', CAST(o_custkey % 5 AS STRING)) AS game_version,
    CASE WHEN o_orderkey % 29 = 0 THEN 440 ELSE 420 END AS queue_id, 11 AS map_id, o_orderpriority AS game_mode,
    CAST(NULL AS VARCHAR) AS game_type, concat('P', CAST(o_custkey % 3 AS STRING)) AS platform_id,
    {derive.MATCH['end_of_game_result']} AS end_of_game_result FROM orders""",
)
def extract_matches(spark, sf):
    m = derive.MATCH
    text = (
        f"to_json(struct(struct({m['match_id']} AS matchId) AS metadata, struct({m['game_id']} AS gameId, "
        f"{ORDER_MS} AS gameCreation, {m['game_duration']} AS gameDuration, "
        f"{ORDER_MS} + ({m['game_duration']}) * 1000 AS gameEndTimestamp, {m['game_version']} AS gameVersion, "
        f"{m['queue_id']} AS queueId, {m['map_id']} AS mapId, o_orderpriority AS gameMode, "
        f"concat('P', CAST(o_custkey % 3 AS STRING)) AS platformId, {m['end_of_game_result']} AS endOfGameResult) AS info))"
    )
    raw = tables.read(spark, sf, "orders").selectExpr(f"{text} AS value")
    return docs.extract_matches(docs.parse_documents(raw, schema=docs.MATCH_DOCUMENT))


_P = derive.PARTICIPANT
_ITEMS = "l_partkey % 4000 AS item0, " + ", ".join(f"CAST(NULL AS BIGINT) AS item{i}" for i in range(1, 7))


@query(
    "extract_participants",
    f"""SELECT {L_MATCH} AS match_id, l_linenumber AS participant_id, concat('u', CAST(l_partkey AS STRING)) AS puuid,
    {_P['team_id']} AS team_id, l_returnflag AS team_position, CAST({_P['champion_id']} AS INT) AS champion_id,
    {_P['champion_name']} AS champion_name, {_P['win']} AS win, {_P['gold_earned']} AS gold_earned,
    CAST(NULL AS BIGINT) AS gold_spent, {_P['champ_level']} AS champ_level, {_P['champ_experience']} AS champ_experience,
    {_P['kills']} AS kills, {_P['deaths']} AS deaths, {_P['assists']} AS assists,
    {_P['damage_dealt_to_champions']} AS damage_dealt_to_champions, {_P['damage_taken']} AS damage_taken,
    {_ITEMS} FROM lineitem""",
)
def extract_participants(spark, sf):
    person = (
        f"struct(l_linenumber AS participantId, concat('u', CAST(l_partkey AS STRING)) AS puuid, {_P['team_id']} AS teamId, "
        f"l_returnflag AS teamPosition, {_P['champion_id']} AS championId, {_P['champion_name']} AS championName, "
        f"{_P['win']} AS win, {_P['gold_earned']} AS goldEarned, {_P['champ_level']} AS champLevel, "
        f"{_P['champ_experience']} AS champExperience, {_P['kills']} AS kills, {_P['deaths']} AS deaths, "
        f"{_P['assists']} AS assists, {_P['damage_dealt_to_champions']} AS totalDamageDealtToChampions, "
        f"{_P['damage_taken']} AS totalDamageTaken, l_partkey % 4000 AS item0)"
    )
    text = f"to_json(struct(struct({L_MATCH} AS matchId) AS metadata, struct(array({person}) AS participants) AS info))"
    raw = tables.read(spark, sf, "lineitem").selectExpr(f"{text} AS value")
    return docs.extract_participants(docs.parse_documents(raw, schema=docs.MATCH_DOCUMENT))


_S = derive.SNAPSHOT
_E = derive.EVENTS


def timelines(spark, sf, schema):
    """One timeline document per order line, read by ``schema``: four frames, events in the first three."""
    ints = {"ints": "ARRAY<INT>", "array": "array"}

    def put(text):
        for key, value in ints.items():
            text = text.replace("{" + key + "}", value)
        return text

    def frame(f, events):
        state = {k: v.replace("(f + 1)", f"({f} + 1)").replace("1 + f +", f"1 + {f} +") for k, v in _S.items()}
        body = (
            f"map(CAST(l_linenumber AS STRING), struct({state['current_gold']} AS currentGold, "
            f"{state['total_gold']} AS totalGold, {state['level']} AS level, {state['xp']} AS xp, "
            f"{state['minions_killed']} AS minionsKilled, {state['jungle_minions_killed']} AS jungleMinionsKilled, "
            f"struct({state['position_x']} AS x, {state['position_y']} AS y) AS position))"
        )
        extra = f", array({', '.join(events)}) AS events" if events else ""
        return f"to_json(struct({f} * 60000 AS timestamp, {body} AS participantFrames{extra}))"

    first, second, third = _E
    ward = "struct('WARD_PLACED' AS type, 5 AS timestamp)"
    buy = (
        f"struct('ITEM_PURCHASED' AS type, {first['timestamp']} AS timestamp, l_linenumber AS participantId, "
        f"{first['item_id']} AS itemId)"
    )
    follow = (
        f"struct({second['event_type']} AS type, CASE WHEN {QTY} % 2 = 0 THEN {second['timestamp']} END AS timestamp, "
        f"l_linenumber AS participantId, {second['item_id']} AS itemId, {second['before_item_id']} AS beforeId, "
        f"{second['after_item_id']} AS afterId, l_linenumber AS killerId, 'TOWER_BUILDING' AS buildingType, "
        "'MID_LANE' AS laneType, 100 AS teamId, 'DRAGON' AS monsterType, 'FIRE_DRAGON' AS monsterSubType)"
    )
    kill = (
        f"struct('CHAMPION_KILL' AS type, {third['timestamp']} AS timestamp, {third['killer_id']} AS killerId, "
        f"{third['victim_id']} AS victimId, {put(third['assisting_ids'])} AS assistingParticipantIds, "
        "struct(l_suppkey AS x, 7 AS y) AS position)"
    )
    frames = [frame(0, [ward]), frame(1, [buy]), frame(2, [follow]), frame(3, [kill])]
    text = "concat('{\"info\":{\"frames\":[', " + ", ',', ".join(frames) + ", ']}}')"
    # raw lines are dealt by key before documents are made of them: the given file is one row group
    lines = tables.read(spark, sf, "lineitem").repartition("l_orderkey", "l_linenumber")
    raw = lines.selectExpr(f"{L_MATCH} AS match_id", f"{text} AS value")
    return docs.parse_documents(raw, schema=schema, keep=["match_id"])


@query(
    "extract_snapshots",
    f"""SELECT {L_MATCH} AS match_id, {_S['timestamp']} AS timestamp, l_linenumber AS participant_id,
    {_S['current_gold']} AS current_gold, {_S['total_gold']} AS total_gold, CAST(NULL AS BIGINT) AS gold_per_second,
    {_S['level']} AS level, {_S['xp']} AS xp, {_S['minions_killed']} AS minions_killed,
    {_S['jungle_minions_killed']} AS jungle_minions_killed, {_S['position_x']} AS position_x, {_S['position_y']} AS position_y
    FROM lineitem, (VALUES (0), (1), (2), (3)) fr(f)""",
)
def extract_snapshots(spark, sf):
    return docs.extract_snapshots(timelines(spark, sf, docs.SNAPSHOT_DOCUMENT))


def _event_sql():
    none = {c: "NULL" for c in ("position_x", "position_y", "participant_id", "item_id", "before_item_id", "after_item_id",
                                "killer_id", "victim_id", "assisting_ids", "building_type", "lane_type", "team_id",
                                "monster_type", "monster_sub_type")}
    ints = [c for c in none if c not in ("assisting_ids", "building_type", "lane_type", "monster_type", "monster_sub_type")]
    first, second, third = _E
    q = f"{QTY} % 5"
    rows = [
        {**none, "event_seq": "1000000", "timestamp": first["timestamp"], "event_type": "'ITEM_PURCHASED'",
         "participant_id": "l_linenumber", "item_id": first["item_id"]},
        {**none, "event_seq": "2000000", "timestamp": f"CASE WHEN {QTY} % 2 = 0 THEN {second['timestamp']} ELSE 120000 END",
         "event_type": second["event_type"], "participant_id": second["participant_id"], "item_id": second["item_id"],
         "before_item_id": second["before_item_id"], "after_item_id": second["after_item_id"],
         "killer_id": second["killer_id"], "building_type": f"CASE WHEN {q} = 3 THEN 'TOWER_BUILDING' END",
         "lane_type": f"CASE WHEN {q} = 3 THEN 'MID_LANE' END", "team_id": f"CASE WHEN {q} = 3 THEN 100 END",
         "monster_type": f"CASE WHEN {q} = 4 THEN 'DRAGON' END", "monster_sub_type": f"CASE WHEN {q} = 4 THEN 'FIRE_DRAGON' END"},
        {**none, "event_seq": "3000000", "timestamp": third["timestamp"], "event_type": "'CHAMPION_KILL'",
         "position_x": "l_suppkey", "position_y": "7", "killer_id": third["killer_id"], "victim_id": third["victim_id"],
         "assisting_ids": "CASE WHEN l_suppkey % 4 <> 0 THEN concat(l_linenumber % 5 + 1, ',', (l_linenumber + 2) % 7 + 1, ',0') END"},
    ]
    selects = []
    for row in rows:
        cols = []
        for name, text in row.items():
            kind = "INT" if name in ints else "BIGINT" if name in ("event_seq", "timestamp") else "VARCHAR"
            cols.append(f"CAST({text} AS {kind}) AS {name}")
        selects.append(f"SELECT {L_MATCH} AS match_id, {', '.join(cols)} FROM lineitem")
    return " UNION ALL ".join(selects)


@query("extract_events", _event_sql())
def extract_events(spark, sf):
    listed = F.when(F.col("assisting_ids").isNotNull(), F.concat_ws(",", F.col("assisting_ids").cast("array<string>")))
    return docs.extract_events(timelines(spark, sf, docs.EVENT_DOCUMENT)).withColumn("assisting_ids", listed)


@query(
    "scan_region_partition",
    "SELECT match_id, game_duration, queue_id FROM m WHERE region = 'sea' "
    "AND game_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
)
def scan_region_partition(spark, sf):
    path = stage_path(spark, "matches_by_region")
    src.write_dataset(tables.matches(spark, sf), path, partition_by=["region"])
    finished = tables.read(spark, sf, "orders").filter("o_orderstatus = 'F'").selectExpr(f"{O_MATCH} AS match_id")
    return src.scan_region_partition(
        spark, path, region="sea", columns=["match_id", "game_duration", "queue_id"], keys=finished
    )


def _mixed_orders(spark, sf):
    """All orders in three kinds of files: one with a further column, two with another type."""
    orders = tables.read(spark, sf, "orders")
    path = stage_path(spark, "mixed_orders")
    kinds = (
        ["o_orderkey", "o_totalprice", "o_custkey AS extra"],
        ["CAST(o_orderkey AS INT) AS o_orderkey", "CAST(floor(o_totalprice) AS BIGINT) AS o_totalprice"],
        ["CAST(o_orderkey AS STRING) AS o_orderkey", "CAST(o_custkey AS STRING) AS o_totalprice"],
    )
    for i, columns in enumerate(kinds):
        src.write_dataset(orders.filter(F.col("o_orderkey") % 3 == i).selectExpr(*columns), f"{path}/kind{i}")
    return path


@query(
    "scan_tolerant_columns",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN round(o_totalprice, 6) WHEN 1 THEN floor(o_totalprice) ELSE o_custkey END::DOUBLE AS o_totalprice,
    CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS extra, CAST(NULL AS VARCHAR) AS o_comment FROM orders""",
)
def scan_tolerant_columns(spark, sf):
    schema = "o_orderkey bigint, o_totalprice double, extra bigint, o_comment string"
    return src.scan_tolerant_columns(spark, _mixed_orders(spark, sf), schema=schema, required=["o_orderkey"])


@query(
    "column_types",
    """SELECT * FROM (VALUES ('extra', 'bigint', true, false), ('o_orderkey', 'bigint|int|string', false, true),
      ('o_totalprice', 'bigint|double|string', false, true)) v(column_name, types, missing, drifts)""",
)
def column_types(spark, sf):
    found = src.column_types(spark, _mixed_orders(spark, sf))
    return found.select("column_name", "types", (F.col("files_missing") > 0).alias("missing"), "drifts")


def _research_region(c):
    hit = lambda *prefixes: " OR ".join(f"starts_with({c}, '{p}')" for p in prefixes)
    return (
        f"CASE WHEN {hit('VN', 'SG', 'TH', 'PH', 'ID', 'MY')} THEN 'sea' WHEN {hit('KR', 'JP', 'TW', 'HK')} THEN 'asia' "
        f"WHEN {hit('EUW', 'EUN', 'TR', 'RU')} THEN 'europe' WHEN {hit('NA', 'BR', 'LA1', 'LA2', 'OC')} THEN 'americas' END"
    )


@query(
    "route_region",
    f"SELECT match_id, {_region('match_id')} AS region, {_research_region('match_id')} AS research_region "
    f"FROM (SELECT {O_MATCH} AS match_id FROM orders)",
)
def route_region(spark, sf):
    ids = tables.read(spark, sf, "orders").selectExpr(f"{O_MATCH} AS match_id")
    return fc.route_region(ids, id_col="match_id", rules=INGEST_REGIONS).withColumn(
        "research_region", fc.region_of(F.col("match_id"), RESEARCH_REGIONS)
    )


@query(
    "incremental_load",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, b.region, b.batch_id // 15 AS batch_id, count(*) AS rows, count(DISTINCT b.match_id) AS matches, true AS complete "
        f"FROM batchkey b JOIN {short} x USING (match_id) GROUP BY 1, 2, 3"
        for t, short in (("matches", "m"), ("participants", "p"), ("snapshots", "s"), ("events", "e"))
    ),
)
def incremental_load(spark, sf):
    """A run that ends after two of the four tables, and one that resumes it."""
    sources, folder = tables.batched(spark, sf, days=60), stage_path(spark, "loaded")
    names = list(sources)
    commit_batches(spark, {n: sources[n] for n in names[:2]}, folder)
    commit_batches(spark, sources, folder)
    complete = complete_batches(spark, folder, names).withColumn("complete", F.lit(True))
    loaded = [
        read_batches(spark, folder, n).groupBy("region", "batch_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("match_id").alias("matches"))
        .select(F.lit(n).alias("table_name"), "*")
        for n in names
    ]
    return ff.union_all(*loaded).join(complete, ["region", "batch_id"], "left").fillna(False, ["complete"])


@query("incremental_load_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F'")
def incremental_load_rows(spark, sf):
    orders = tables.read(spark, sf, "orders")
    loaded = orders.filter("o_orderstatus = 'F'")
    return src.incremental_load(orders.select("o_orderkey", "o_totalprice"), loaded, key=["o_orderkey"])


@query("incremental_load_stream", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def incremental_load_stream(spark, sf):
    """Two runs over the same folder: the second finds nothing new."""
    schema = "o_orderkey bigint, o_orderstatus string, o_totalprice double"
    target, checkpoint = stage_path(spark, "stream_target"), stage_path(spark, "stream_state")
    for _ in range(2):
        loaded = load_new_files(spark, sf, target, checkpoint, schema=schema, glob="orders.parquet")
    return loaded


@query("distinct_key_scan", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL")
def distinct_keys(spark, sf):
    return distinct_key_scan(tables.read(spark, sf, "lineitem"), key="l_orderkey")


@query(
    "write_dataset",
    "SELECT f AS fmt, o_orderkey, o_custkey, o_orderstatus FROM orders, (VALUES ('parquet'), ('json'), ('csv')) v(f)",
)
def write_dataset(spark, sf):
    rows = tables.read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    back = []
    for fmt in ("parquet", "json", "csv"):
        path = stage_path(spark, f"orders_{fmt}")
        src.write_dataset(rows, path, fmt=fmt, partition_by=["o_orderstatus"])
        reader = spark.read.schema("o_orderkey bigint, o_custkey bigint, o_orderstatus string")
        loaded = reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)
        back.append(loaded.select(F.lit(fmt).alias("fmt"), "o_orderkey", "o_custkey", "o_orderstatus"))
    return ff.union_all(*back)


@query("read_id_list_csv", f"SELECT {O_MATCH} AS match_id FROM orders")
def read_id_list_csv(spark, sf):
    path = stage_path(spark, "id_list")
    src.write_dataset(
        tables.read(spark, sf, "orders").selectExpr("o_custkey AS player", f"{O_MATCH} AS match_id"), path, fmt="csv"
    )
    return src.read_id_list_csv(spark, path)


@query(
    "coerce_types",
    """SELECT o_orderkey AS key_number, CASE WHEN o_orderkey % 13 <> 0 THEN round(o_totalprice, 6) END AS price,
    CASE WHEN o_custkey % 3 <> 0 THEN CAST(o_custkey AS INT) END AS customer
    FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0""",
)
def coerce_types(spark, sf):
    text = tables.read(spark, sf, "orders").selectExpr(
        "CASE WHEN o_orderkey % 7 = 0 THEN concat('x', CAST(o_orderkey AS STRING)) "
        "WHEN o_orderkey % 11 <> 0 THEN concat(CAST(o_orderkey AS STRING), '.0') END AS key_number",
        "CASE WHEN o_orderkey % 13 = 0 THEN 'nan' ELSE CAST(o_totalprice AS STRING) END AS price",
        "CASE WHEN o_custkey % 3 = 0 THEN '' ELSE CAST(o_custkey AS STRING) END AS customer",
    )
    return ff.coerce_types(
        text, casts={"key_number": "bigint", "price": "double", "customer": "int"}, required=["key_number"]
    )


_WORDS = (
    "CASE o_orderkey % 9 WHEN 0 THEN ' True ' WHEN 1 THEN 'WON' WHEN 2 THEN 'loss' WHEN 3 THEN '0' WHEN 4 THEN '1' "
    "WHEN 5 THEN 'maybe' WHEN 6 THEN 'win ' WHEN 7 THEN 'FALSE' END"
)


@query(
    "normalise_boolean",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 9 IN (0, 1, 4, 6) THEN true WHEN o_orderkey % 9 IN (2, 3, 7) THEN false END AS from_text,
    CASE o_orderkey % 3 WHEN 1 THEN true WHEN 0 THEN false END AS from_number, o_orderkey % 2 = 0 AS from_flag FROM orders""",
)
def normalise_boolean(spark, sf):
    rows = tables.read(spark, sf, "orders").selectExpr(
        "o_orderkey", f"{_WORDS} AS t", "CAST(o_orderkey % 3 AS DOUBLE) AS n", "o_orderkey % 2 = 0 AS b"
    )
    return rows.select(
        "o_orderkey",
        fc.normalise_boolean(F.col("t")).alias("from_text"),
        fc.normalise_boolean(F.col("n")).alias("from_number"),
        fc.normalise_boolean(F.col("b")).alias("from_flag"),
    )


@query(
    "normalise_status",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'SOLD' WHEN 'P' THEN 'UNDONE' ELSE 'RETAINED' END AS status FROM orders",
)
def normalise_status(spark, sf):
    rows = tables.read(spark, sf, "orders").selectExpr(
        "o_orderkey", "CASE o_orderstatus WHEN 'F' THEN 'sold ' WHEN 'P' THEN ' Undo' ELSE 'Retained' END AS raw"
    )
    return rows.select("o_orderkey", fc.normalise_status(F.col("raw")).alias("status"))


@query("dedupe_keep_last", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lines")
def dedupe_keep_last(spark, sf):
    return tables.lines(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query(
    "item_event_filter",
    f"""SELECT match_id, event_seq, timestamp, event_type, {_region('match_id')} AS region, 'lineitem.parquet' AS source_file
    FROM e WHERE item_id = 3041 OR before_item_id = 3041 OR after_item_id = 3041""",
)
def item_event_filter(spark, sf):
    from cohortloom.operators.episodes import item_event_filter as keep

    rows = keep(
        tables.events(spark, sf, with_source=True),
        item_cols=["item_id", "before_item_id", "after_item_id"],
        item=3041,
    )
    return fc.route_region(rows, id_col="match_id", rules=INGEST_REGIONS).select(
        "match_id", "event_seq", "timestamp", "event_type", "region", "source_file"
    )


@query(
    "normalise_id_list",
    """SELECT l_orderkey, l_linenumber, l_suppkey,
    CASE WHEN l_suppkey % 7 = 0 THEN '' WHEN l_suppkey % 7 = 1 THEN CASE WHEN l_suppkey > 0 THEN CAST(l_suppkey AS STRING) ELSE '' END
    ELSE concat_ws(',', l_linenumber, CASE WHEN l_suppkey > 0 THEN CAST(l_suppkey AS STRING) END) END AS ids FROM lineitem""",
)
def normalise_id_list(spark, sf):
    raw = (
        "CASE WHEN l_suppkey % 14 = 0 THEN NULL WHEN l_suppkey % 7 = 0 THEN '[]' "
        "WHEN l_suppkey % 7 = 1 THEN CAST(l_suppkey AS STRING) "
        "ELSE concat('[', l_linenumber, '.0, ', CHAR(39), l_suppkey, CHAR(39), ', 0, nan, x, -2]') END"
    )
    rows = tables.read(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_suppkey", f"{raw} AS raw")
    ids = fc.normalise_id_list(F.col("raw")).cast("array<string>")
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", F.concat_ws(",", ids).alias("ids"))


@query("observation_key", "SELECT concat(l_orderkey, '_', l_linenumber, '_', l_partkey) AS observation_id FROM lineitem")
def observation_key(spark, sf):
    return tables.read(spark, sf, "lineitem").select(
        fc.observation_key("l_orderkey", "l_linenumber", "l_partkey").alias("observation_id")
    )


@query("eligibility_flag", "SELECT match_id, analysis_eligible, exclusion_reason FROM man")
def eligibility_flag(spark, sf):
    plain = tables.study(spark, sf).manifest.drop("analysis_eligible", "exclusion_reason")
    return ff.eligibility_flag(plain, rules=tables.study_rules()).select(
        "match_id", "analysis_eligible", "exclusion_reason"
    )


@query(
    "state_bins",
    """SELECT l_orderkey, l_linenumber, l_partkey,
    CASE WHEN l_extendedprice - 20000 < -2000 THEN 'behind' WHEN l_extendedprice - 20000 < 2000 THEN 'close' ELSE 'ahead' END AS team_state,
    CASE WHEN l_quantity < 15 THEN 'before_15m' WHEN l_quantity < 25 THEN '15_to_25m' ELSE 'after_25m' END AS time_group FROM lineitem""",
)
def state_bins(spark, sf):
    from cohortloom.params import STATE_LABELS, TEAM_STATE_EDGES, TIME_EDGES_MIN, TIME_LABELS

    return tables.read(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        fc.state_bins(F.col("l_extendedprice") - 20000, edges=TEAM_STATE_EDGES, labels=STATE_LABELS).alias("team_state"),
        fc.state_bins(F.col("l_quantity"), edges=TIME_EDGES_MIN, labels=TIME_LABELS).alias("time_group"),
    )


@query(
    "relative_gap",
    """SELECT l_orderkey, l_linenumber, l_partkey, abs(l_extendedprice - l_quantity * 1000)
    / greatest(abs(l_extendedprice), abs(l_quantity * 1000), 1) AS gap FROM lineitem""",
    exact=("gap",),
)
def relative_gap(spark, sf):
    return tables.read(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        fc.relative_gap(F.col("l_extendedprice"), F.col("l_quantity") * 1000).alias("gap"),
    )


@query(
    "prefix_rename",
    "SELECT match_id, participant_id, gold_earned AS outcome_gold_earned, kills AS outcome_kills, deaths AS outcome_deaths FROM p",
)
def prefix_rename(spark, sf):
    rows = tables.participants(spark, sf).select("match_id", "participant_id", "gold_earned", "kills", "deaths")
    return ff.prefix_rename(rows, prefix="outcome_", columns=["gold_earned", "kills", "deaths"])


@query(
    "union_regions",
    "SELECT match_id, region FROM m WHERE region IN ('asia', 'europe', 'sea', 'americas')",
)
def union_regions(spark, sf):
    routed = tables.matches(spark, sf).select("match_id", "region")
    return routed.filter(F.col("region").isin(*INGEST_REGIONS))

"""Relational tables from nested match and timeline documents."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import ITEM_EVENT_TYPES, KEPT_EVENT_TYPES

_POINT = "struct<x:int,y:int>"
MATCH_DOCUMENT = (
    "metadata struct<matchId:string>, info struct<gameId:bigint,gameCreation:bigint,"
    "gameStartTimestamp:bigint,gameDuration:bigint,gameEndTimestamp:bigint,gameVersion:string,"
    "queueId:int,mapId:int,gameMode:string,gameType:string,platformId:string,endOfGameResult:string,"
    "participants:array<struct<participantId:int,puuid:string,teamId:int,teamPosition:string,"
    "championId:int,championName:string,win:boolean,goldEarned:bigint,goldSpent:bigint,"
    "champLevel:bigint,champExperience:bigint,kills:bigint,deaths:bigint,assists:bigint,"
    "totalDamageDealtToChampions:bigint,totalDamageTaken:bigint,item0:bigint,item1:bigint,"
    "item2:bigint,item3:bigint,item4:bigint,item5:bigint,item6:bigint>>>"
)
_PLAYERS = (
    "participantFrames:map<string,struct<currentGold:bigint,totalGold:bigint,goldPerSecond:bigint,"
    f"level:bigint,xp:bigint,minionsKilled:bigint,jungleMinionsKilled:bigint,position:{_POINT}>>"
)
_EVENTS = (
    "events:array<struct<type:string,timestamp:bigint,participantId:int,itemId:int,beforeId:int,"
    "afterId:int,killerId:int,victimId:int,assistingParticipantIds:array<int>,buildingType:string,"
    f"laneType:string,teamId:int,monsterType:string,monsterSubType:string,position:{_POINT}>>"
)
TIMELINE_DOCUMENT = f"info struct<frames:array<struct<timestamp:bigint,{_PLAYERS},{_EVENTS}>>>"
# what one extraction reads of a timeline; the parser skips the rest of the text
SNAPSHOT_DOCUMENT = f"info struct<frames:array<struct<timestamp:bigint,{_PLAYERS}>>>"
EVENT_DOCUMENT = f"info struct<frames:array<struct<timestamp:bigint,{_EVENTS}>>>"


def parse_documents(
    raw: DataFrame, *, schema: str, text: str = "value", keep: Sequence[str] = ()
) -> DataFrame:
    """Documents held as text; a timeline names its match in a column next to it."""
    return raw.select(*keep, F.from_json(text, schema).alias("d")).select(*keep, "d.*")


def extract_matches(docs: DataFrame) -> DataFrame:
    info = F.col("info")
    return docs.select(
        F.col("metadata.matchId").alias("match_id"),
        info["gameId"].alias("game_id"),
        info["gameCreation"].alias("game_creation"),
        info["gameStartTimestamp"].alias("game_start_timestamp"),
        info["gameDuration"].alias("game_duration"),
        info["gameEndTimestamp"].alias("game_end_timestamp"),
        info["gameVersion"].alias("game_version"),
        info["queueId"].alias("queue_id"),
        info["mapId"].alias("map_id"),
        info["gameMode"].alias("game_mode"),
        info["gameType"].alias("game_type"),
        info["platformId"].alias("platform_id"),
        info["endOfGameResult"].alias("end_of_game_result"),
    )


PARTICIPANT_FIELDS = {
    # fixed values: document field -> column
    "participantId": "participant_id",
    "puuid": "puuid",
    "teamId": "team_id",
    "teamPosition": "team_position",
    "championId": "champion_id",
    "championName": "champion_name",
    "win": "win",
    "goldEarned": "gold_earned",
    "goldSpent": "gold_spent",
    "champLevel": "champ_level",
    "champExperience": "champ_experience",
    "kills": "kills",
    "deaths": "deaths",
    "assists": "assists",
    "totalDamageDealtToChampions": "damage_dealt_to_champions",
    "totalDamageTaken": "damage_taken",
    **{f"item{i}": f"item{i}" for i in range(7)},
}
FRAME_FIELDS = {
    "currentGold": "current_gold",
    "totalGold": "total_gold",
    "goldPerSecond": "gold_per_second",
    "level": "level",
    "xp": "xp",
    "minionsKilled": "minions_killed",
    "jungleMinionsKilled": "jungle_minions_killed",
}


def extract_participants(docs: DataFrame) -> DataFrame:
    # below an inner explode Spark filters by the array's size, and parses the text anew for that
    people = docs.select(F.col("metadata.matchId").alias("match_id"), F.posexplode_outer("info.participants").alias("_place", "p"))
    return people.filter("_place is not null").select(
        "match_id", *[F.col("p")[field].alias(name) for field, name in PARTICIPANT_FIELDS.items()]
    )


def extract_snapshots(timelines: DataFrame) -> DataFrame:
    """One row per frame and participant; the map key is the participant id."""
    frames = timelines.select("match_id", F.explode("info.frames").alias("f"))
    players = frames.select(
        "match_id", F.col("f.timestamp").alias("timestamp"), F.explode("f.participantFrames").alias("id", "p")
    )
    return players.select(
        "match_id",
        "timestamp",
        F.col("id").cast("int").alias("participant_id"),
        *[F.col("p")[field].alias(name) for field, name in FRAME_FIELDS.items()],
        F.col("p.position.x").cast("bigint").alias("position_x"),
        F.col("p.position.y").cast("bigint").alias("position_y"),
    )


def extract_events(timelines: DataFrame, *, keep_types: Sequence[str] = KEPT_EVENT_TYPES) -> DataFrame:
    """One row per kept event; columns an event type does not use are null. ``event_seq``
    numbers a document's events in order, which settles equal timestamps later."""
    frames = timelines.select("match_id", F.posexplode("info.frames").alias("_frame", "f"))
    e = F.col("e")
    rows = frames.select(
        "match_id", "_frame", F.col("f.timestamp").alias("_frame_ts"), F.posexplode("f.events").alias("_pos", "e")
    ).filter(e["type"].isin(*keep_types))
    kind = e["type"]

    def only(types, field):
        return F.when(kind.isin(*types), e[field])

    kills, building, monster = ("CHAMPION_KILL",), ("BUILDING_KILL",), ("ELITE_MONSTER_KILL",)
    return rows.select(
        "match_id",
        (F.col("_frame").cast("bigint") * 1_000_000 + F.col("_pos")).alias("event_seq"),
        F.coalesce(e["timestamp"], F.col("_frame_ts")).alias("timestamp"),
        kind.alias("event_type"),
        e["position"]["x"].alias("position_x"),
        e["position"]["y"].alias("position_y"),
        only(ITEM_EVENT_TYPES, "participantId").alias("participant_id"),
        only(ITEM_EVENT_TYPES + monster, "itemId").alias("item_id"),
        only(ITEM_EVENT_TYPES, "beforeId").alias("before_item_id"),
        only(ITEM_EVENT_TYPES, "afterId").alias("after_item_id"),
        only(kills + building + monster, "killerId").alias("killer_id"),
        only(kills, "victimId").alias("victim_id"),
        only(kills, "assistingParticipantIds").alias("assisting_ids"),
        only(building, "buildingType").alias("building_type"),
        only(building, "laneType").alias("lane_type"),
        only(building, "teamId").alias("team_id"),
        only(monster, "monsterType").alias("monster_type"),
        only(monster, "monsterSubType").alias("monster_sub_type"),
    )

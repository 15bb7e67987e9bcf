"""How the given order tables are read as match tables.

An order is a match, an order line (first dedupes on order and line number) a participant,
each participant has a state per one-minute frame, and each raw line yields three events.
The expressions are plain SQL that both Spark and DuckDB accept; ``{k}`` is the order key.
"""


# Line numbers have gaps. Players are numbered from 1 without gaps, but for every tenth order,
# whose matches thereby have invalid player ids.
PLAYER_NO = (
    "CAST(CASE WHEN l_orderkey % 10 = 0 THEN l_linenumber "
    "ELSE dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) END AS INT)"
)


def match_id(key: str) -> str:
    return (
        f"concat(CASE WHEN {key} % 97 = 0 THEN 'ZZ9_' WHEN {key} % 5 = 0 THEN 'EUW1_' "
        f"WHEN {key} % 5 = 1 THEN 'NA1_' WHEN {key} % 5 = 2 THEN 'KR_' "
        f"WHEN {key} % 5 = 3 THEN 'VN2_' ELSE 'OC1_' END, CAST({key} AS STRING))"
    )


L_MATCH = match_id("l_orderkey")
O_MATCH = match_id("o_orderkey")
QTY = "CAST(l_quantity AS BIGINT)"

MATCH = {
    "match_id": O_MATCH,
    "game_id": "o_orderkey",
    "game_duration": "600 + o_custkey % 1800",
    "game_version": "concat('14.', CAST(o_custkey % 5 AS STRING))",
    "queue_id": "CASE WHEN o_orderkey % 29 = 0 THEN 440 ELSE 420 END",
    "map_id": "11",
    "end_of_game_result": (
        "CASE WHEN o_orderkey % 101 = 0 THEN NULL "
        "WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'Abort_AntiCheatExit' "
        "ELSE 'GameComplete' END"
    ),
}

PARTICIPANT = {
    "match_id": L_MATCH,
    "participant_id": "l_linenumber",
    "team_id": "CASE WHEN l_linestatus = 'O' THEN 100 ELSE 200 END",
    "team_position": "l_returnflag",
    "champion_id": "l_partkey % 40",
    "champion_name": "concat('C', CAST(l_partkey % 40 AS STRING))",
    "win": "(l_linestatus = 'O') = (l_orderkey % 3 <> 0)",
    "gold_earned": "CAST(floor(l_extendedprice / 10) AS BIGINT)",
    "gold_spent": "CAST(floor(l_extendedprice / 12) AS BIGINT)",
    "champ_level": f"{QTY} % 18 + 1",
    "champ_experience": f"{QTY} * 350",
    "kills": "l_partkey % 13",
    "deaths": "l_suppkey % 9",
    "assists": "(l_partkey + l_suppkey) % 17",
    "damage_dealt_to_champions": "l_partkey * 7 % 40000",
    "damage_taken": "l_suppkey * 11 % 30000",
}

# per frame f = 0..3; some players miss a frame
FRAME_PRESENT = "NOT (f = 0 AND l_suppkey % 6 = 0) AND NOT (f = 2 AND l_partkey % 7 = 0)"
SNAPSHOT = {
    "match_id": L_MATCH,
    "timestamp": "CAST(f AS BIGINT) * 60000",
    "participant_id": "l_linenumber",
    "current_gold": "CAST(floor((500 + l_extendedprice * (f + 1) / 40) * l_discount * 5) AS BIGINT)",
    "total_gold": "500 + CAST(floor(l_extendedprice * (f + 1) / 40) AS BIGINT)",
    "level": "1 + f + CAST(floor(l_quantity / 10) AS BIGINT)",
    "xp": f"{QTY} * 20 * (f + 1)",
    "minions_killed": f"{QTY} * (f + 1)",
    "jungle_minions_killed": "CAST(floor(l_tax * 100) AS BIGINT) * (f + 1)",
    "position_x": "l_partkey % 15000",
    "position_y": "l_suppkey % 15000",
}

ITEM = (
    "CASE WHEN (l_partkey + l_suppkey) % 23 = 0 THEN 3041 "
    "WHEN (l_partkey + l_suppkey) % 3 = 1 THEN 1082 ELSE 2000 + l_partkey % 20 END"
)
LINE_ITEM = f"CAST({ITEM} AS INT)"
T0 = "(l_partkey * 37 + l_suppkey * 101 + l_orderkey * 13) % 150000"
T1 = f"({T0} + {QTY} * 1000)"
T2 = "(l_partkey * 53 + l_suppkey * 7 + l_orderkey * 29) % 200000"
SEQ = "(l_partkey * 100000 + l_suppkey) * 10"
NO_INT = "CAST(NULL AS INT)"
FOLLOW_TYPE = (
    f"CASE WHEN {QTY} % 5 = 0 THEN 'ITEM_SOLD' WHEN {QTY} % 5 = 1 THEN 'ITEM_UNDO' "
    f"WHEN {QTY} % 5 = 2 THEN 'ITEM_PURCHASED' WHEN {QTY} % 5 = 3 THEN 'BUILDING_KILL' "
    "ELSE 'ELITE_MONSTER_KILL' END"
)

# three events per line: a purchase, a follow-up, a kill
EVENTS = (
    {
        "match_id": L_MATCH,
        "event_seq": SEQ,
        "timestamp": T0,
        "event_type": "'ITEM_PURCHASED'",
        "participant_id": "l_linenumber",
        "item_id": LINE_ITEM,
        "before_item_id": NO_INT,
        "after_item_id": NO_INT,
        "killer_id": NO_INT,
        "victim_id": NO_INT,
        "assisting_ids": "CAST(NULL AS {ints})",
    },
    {
        "match_id": L_MATCH,
        "event_seq": f"{SEQ} + 1",
        "timestamp": T1,
        "event_type": FOLLOW_TYPE,
        "participant_id": f"CASE WHEN {QTY} % 5 < 3 THEN l_linenumber END",
        "item_id": f"CASE WHEN {QTY} % 5 IN (0, 2) THEN {LINE_ITEM} END",
        "before_item_id": f"CASE WHEN {QTY} % 10 = 1 THEN {LINE_ITEM} WHEN {QTY} % 10 = 6 THEN 0 END",
        "after_item_id": f"CASE WHEN {QTY} % 10 = 1 THEN 0 WHEN {QTY} % 10 = 6 THEN {LINE_ITEM} END",
        "killer_id": f"CASE WHEN {QTY} % 5 > 2 THEN l_linenumber END",
        "victim_id": NO_INT,
        "assisting_ids": "CAST(NULL AS {ints})",
    },
    {
        "match_id": L_MATCH,
        "event_seq": f"{SEQ} + 2",
        "timestamp": T2,
        "event_type": "'CHAMPION_KILL'",
        "participant_id": NO_INT,
        "item_id": NO_INT,
        "before_item_id": NO_INT,
        "after_item_id": NO_INT,
        "killer_id": "CASE WHEN l_partkey % 10 = 0 THEN 0 ELSE l_linenumber END",
        "victim_id": "l_linenumber % 7 + 1",
        "assisting_ids": (
            "CASE WHEN l_suppkey % 4 = 0 THEN NULL "
            "ELSE {array}(l_linenumber % 5 + 1, (l_linenumber + 2) % 7 + 1, 0) END"
        ),
    },
)


def select_list(columns: dict[str, str], **names: str) -> list[str]:
    out = []
    for name, text in columns.items():
        for key, value in names.items():
            text = text.replace("{" + key + "}", value)
        out.append(f"{text} AS {name}")
    return out


def select_stored(columns: dict[str, str], **names: str) -> list[str]:
    """The same columns, read from lines that hold ``match_id`` and ``item`` already."""
    return [text.replace(L_MATCH, "match_id").replace(LINE_ITEM, "item") for text in select_list(columns, **names)]

"""Documents, tolerant reads, sinks and resumable loading."""

import json

import pytest

from cohortloom.session import materialise, shared_folder
from cohortloom.sources import documents as docs
from cohortloom.sources import tables as src
from cohortloom.streaming.ingest import load_new_files


def parsed(spark, schema, *items):
    raw = spark.createDataFrame([(k, json.dumps(d)) for k, d in items], "match_id string, value string")
    keep = ["match_id"] if schema == docs.TIMELINE_DOCUMENT else []
    return docs.parse_documents(raw, schema=schema, keep=keep)


def test_match_document(spark):
    doc = {
        "metadata": {"matchId": "KR_1"},
        "info": {
            "gameId": 1,
            "queueId": 420,
            "participants": [
                {"participantId": 1, "puuid": "a", "teamId": 100, "win": True, "item0": 3041},
                {"participantId": 2, "puuid": "b", "teamId": 200},
            ],
        },
    }
    d = parsed(spark, docs.MATCH_DOCUMENT, ("KR_1", doc))
    match = docs.extract_matches(d).collect()[0]
    assert (match["match_id"], match["queue_id"], match["game_version"]) == ("KR_1", 420, None)
    assert len(match) == 13
    people = docs.extract_participants(d).orderBy("participant_id").collect()
    assert [(p["participant_id"], p["win"], p["item0"], p["item6"]) for p in people] == [(1, True, 3041, None), (2, None, None, None)]


def test_timeline_document(spark):
    doc = {
        "info": {
            "frames": [
                {
                    "timestamp": 0,
                    "participantFrames": {"10": {"totalGold": 500, "position": {"x": 1, "y": 2}}, "2": {"totalGold": 600}},
                    "events": [
                        {"type": "WARD_PLACED", "timestamp": 1},
                        {"type": "ITEM_UNDO", "participantId": 2, "beforeId": 3041, "afterId": 0, "killerId": 9},
                    ],
                },
                {
                    "timestamp": 60_000,
                    "participantFrames": {},
                    "events": [
                        {"type": "CHAMPION_KILL", "timestamp": 5, "killerId": 1, "victimId": 2, "assistingParticipantIds": [3], "itemId": 4},
                        {"type": "ELITE_MONSTER_KILL", "timestamp": 6, "killerId": 1, "monsterType": "DRAGON", "itemId": 8, "laneType": "MID"},
                        {"type": "BUILDING_KILL", "timestamp": 7, "killerId": 0, "teamId": 100, "buildingType": "TOWER", "laneType": "MID"},
                    ],
                },
                {"timestamp": 120_000, "participantFrames": {"1": {}}},
            ]
        }
    }
    d = parsed(spark, docs.TIMELINE_DOCUMENT, ("m", doc), ("without_timeline", {}))
    snaps = {(r["timestamp"], r["participant_id"]): r for r in docs.extract_snapshots(d).collect()}
    assert set(snaps) == {(0, 10), (0, 2), (120_000, 1)}
    assert (snaps[0, 10]["total_gold"], snaps[0, 10]["position_y"], snaps[0, 2]["position_x"]) == (500, 2, None)
    events = docs.extract_events(d).orderBy("event_seq").collect()
    assert [(e["event_type"], e["timestamp"]) for e in events] == [
        ("ITEM_UNDO", 0),  # no own time: the frame's
        ("CHAMPION_KILL", 5),
        ("ELITE_MONSTER_KILL", 6),
        ("BUILDING_KILL", 7),
    ]
    undo, kill, monster, building = events
    assert (undo["before_item_id"], undo["killer_id"]) == (3041, None)
    assert (kill["assisting_ids"], kill["item_id"]) == ([3], None)
    assert (monster["item_id"], monster["monster_type"], monster["lane_type"]) == (8, "DRAGON", None)
    assert (building["team_id"], building["lane_type"], building["victim_id"]) == (100, "MID", None)


def test_tolerant_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("7", 1.0), ("x", 2.0)], "participant_id string, extra double").write.parquet(path)
    got = src.scan_tolerant_columns(spark, path, schema="participant_id int, win boolean", required=["participant_id"])
    assert got.columns == ["participant_id", "win"]
    assert sorted(got.collect(), key=str) == sorted([(7, None), (None, None)], key=str)
    with pytest.raises(ValueError, match="match_id"):
        src.scan_tolerant_columns(spark, path, schema="match_id string", required=["match_id"])


def test_tolerant_scan_of_mixed_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, 5)], "k bigint, x bigint").write.parquet(path + "/a")
    spark.createDataFrame([(2, 2.5, 7)], "k bigint, x double, extra int").write.parquet(path + "/b")
    spark.createDataFrame([(3, "4")], "k bigint, x string").write.parquet(path + "/c")
    spark.createDataFrame([(4,)], "k bigint").write.parquet(path + "/d")
    got = src.scan_tolerant_columns(spark, path, schema="k bigint, x double, extra bigint", required=["k"])
    assert {tuple(r) for r in got.collect()} == {(1, 5.0, None), (2, 2.5, 7), (3, 4.0, None), (4, None, None)}
    with pytest.raises(ValueError, match="extra"):
        src.scan_tolerant_columns(spark, path, schema="k bigint, extra bigint", required=["extra"])
    types = {r["column_name"]: (r["types"], r["drifts"]) for r in src.column_types(spark, path).collect()}
    assert types == {"k": ("bigint", False), "x": ("bigint|double|string", True), "extra": ("int", False)}


def test_sink_refuses_to_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a")], "k int, region string")
    src.write_dataset(df, path, partition_by=["region"])
    with pytest.raises(Exception, match="already exists"):
        src.write_dataset(df, path)
    src.write_dataset(df, path, partition_by=["region"], mode="append")
    assert src.scan_region_partition(spark, path, region="a").count() == 2


def test_loading_resumes_without_repeats(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def land(name, *ids):
        spark.createDataFrame([(i,) for i in ids], "id bigint").coalesce(1).write.mode("append").parquet(source)

    land("a", 1, 2)
    assert load_new_files(spark, source, target, state, schema="id bigint").count() == 2
    assert load_new_files(spark, source, target, state, schema="id bigint").count() == 2
    land("b", 3)
    doubled = load_new_files(spark, source, target, state, schema="id bigint", transform=lambda df: df.selectExpr("id * 10 AS id"))
    assert sorted(r["id"] for r in doubled.collect()) == [1, 2, 30]


def test_incremental_load_by_key(spark):
    new = spark.createDataFrame([("sea", 1), ("sea", 2), ("asia", 1)], "region string, batch_id int")
    done = spark.createDataFrame([("sea", 1), ("sea", 1)], "region string, batch_id int")
    left = src.incremental_load(new, done, key=["region", "batch_id"])
    assert sorted(tuple(r) for r in left.collect()) == [("asia", 1), ("sea", 2)]


def test_stage_tables_go_to_the_shared_folder(spark):
    stored = materialise(spark.range(3), "stage")
    folder = shared_folder(spark).split(":")[-1]
    assert all(folder in f for f in stored.inputFiles())
    assert stored.count() == 3


def test_a_batch_lost_from_one_table_is_loaded_again(spark):
    names = ["matches", "participants", "snapshots", "events"]
    rows = [(t, "euw", b) for t in names for b in (1, 2, 3) if (t, b) != ("events", 2)] + [("matches", "euw", 2), ("other", "euw", 2), ("events", "na", 2)]
    files = spark.createDataFrame(rows, "table_name string, region string, batch_id long")
    new = spark.createDataFrame([("euw", 1), ("euw", 2), ("euw", 3), ("na", 2)], "region string, batch_id long")
    done = src.loaded_batches(files, tables=names)
    got = src.incremental_load(new, done, key=["region", "batch_id"]).collect()
    assert sorted(map(tuple, got)) == [("euw", 2), ("na", 2)]


def test_footers_are_read_in_tasks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    for i in range(40):
        spark.range(i, i + 1).selectExpr("id AS k", "id AS extra" if i % 4 == 0 else "CAST(id AS STRING) AS x").coalesce(1).write.parquet(f"{path}/n{i}")
    types = {tuple(r) for r in src.column_types(spark, path).collect()}
    assert types == {("k", "bigint", 0, False), ("extra", "bigint", 30, False), ("x", "string", 10, False)}
    scans = []
    real = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *files, **kw: scans.append(len(files)) or real(self, *files, **kw))
    got = src.scan_tolerant_columns(spark, path, schema="k bigint, x string, extra bigint", required=["k"])
    assert sorted(n for n in scans if n > 1) == [10, 30]  # one scan for each schema
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, None, i) if i % 4 == 0 else (i, str(i), None) for i in range(40))


def test_footers_of_files_that_arrow_cannot_open(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    want = {tuple(r) for r in src.column_types(spark, path).collect()}
    monkeypatch.setattr(src, "open_footer", lambda file: None)
    assert {tuple(r) for r in src.column_types(spark, path).collect()} == want == {("id", "bigint", 0, False)}

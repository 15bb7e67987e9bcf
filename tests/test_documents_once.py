"""A document is parsed once, and no more of it than an extraction reads."""

import contextlib
import io
import json

from bindings import queries_ingest
from cohortloom.sources import documents as docs


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_participants_parse_a_document_once(spark, sf_dir):
    assert plan(queries_ingest.extract_participants(spark, sf_dir)).count("from_json(") == 1


def test_lists_without_players_give_no_row(spark):
    texts = ['{"metadata":{"matchId":"m"},"info":{"participants":%s}}' % p for p in ("null", "[]", '[null,{"participantId":3}]')]
    raw = spark.createDataFrame([(t,) for t in [*texts, '{"metadata":{"matchId":"n"}}', "broken", None]], "value string")
    found = docs.extract_participants(docs.parse_documents(raw, schema=docs.MATCH_DOCUMENT))
    assert sorted(map(str, found.select("match_id", "participant_id").collect())) == sorted(
        ["Row(match_id='m', participant_id=None)", "Row(match_id='m', participant_id=3)"]
    )


def test_a_timeline_is_parsed_for_what_is_read(spark, sf_dir, monkeypatch):
    whole, asked = docs.parse_documents, []
    monkeypatch.setattr(docs, "parse_documents", lambda raw, **how: asked.append(how["schema"]) or whole(raw, **how))
    queries_ingest.extract_snapshots(spark, sf_dir)
    queries_ingest.extract_events(spark, sf_dir)
    assert "events:" not in asked[0] and "participantFrames:" not in asked[1]


def test_narrow_schemas_give_the_rows_of_the_whole_one(spark):
    players = {"1": {"totalGold": 5, "xp": "odd", "position": {"x": 1, "y": 2}}, "2": None}
    events = [{"type": "CHAMPION_KILL", "killerId": 1, "assistingParticipantIds": [2, 3]}, {"type": "ITEM_SOLD", "itemId": "odd"}, None]
    frames = [{"timestamp": 7, "participantFrames": players, "events": events}, {"timestamp": 8, "events": "odd"}, {"participantFrames": 3}]
    texts = [json.dumps({"info": {"frames": frames}}), json.dumps({"info": {"frames": frames[:1]}}), '{"info":{"frames":[{"timestamp":1', "{}", None]
    raw = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "match_id string, value string")

    def rows(extract, schema):
        return sorted(map(str, extract(docs.parse_documents(raw, schema=schema, keep=["match_id"])).collect()))

    assert rows(docs.extract_snapshots, docs.SNAPSHOT_DOCUMENT) == rows(docs.extract_snapshots, docs.TIMELINE_DOCUMENT)
    assert rows(docs.extract_events, docs.EVENT_DOCUMENT) == rows(docs.extract_events, docs.TIMELINE_DOCUMENT)

"""Tables as batches: what file names and footers tell, and loading that is cut off."""

import pytest

from cohortloom.operators import quality as q
from cohortloom.sources import batches as b

NAMES = ["matches", "events", "rare"]


def sources(spark):
    rows = spark.range(90).selectExpr("id", "CASE WHEN id % 9 = 8 THEN NULL WHEN id % 2 = 0 THEN 'sea' ELSE 'asia' END AS region", "id DIV 30 + 1 AS batch_id")
    rows = rows.selectExpr("*", "IF(batch_id = 2, NULL, id) AS x", "IF(id = 77, array(1, NULL), NULL) AS ids")
    return {"matches": rows, "events": rows.filter("batch_id <> 2").drop("ids"), "rare": rows.filter("id = 4")}


def content(spark, folder):
    return {n: sorted(tuple(r) for r in b.read_batches(spark, folder, n).select("id", "region", "batch_id").collect()) for n in NAMES}


def expected(spark):
    return {n: sorted(tuple(r) for r in df.dropna(subset=["region"]).select("id", "region", "batch_id").collect()) for n, df in sources(spark).items()}


def test_files_tell_gaps_and_missing_tables(spark, tmp_path):
    folder = str(tmp_path)
    for name, rows in sources(spark).items():
        b.write_batches(rows.filter("NOT (region = 'sea' AND batch_id = 2)"), folder, name)
    found = b.batch_list(spark, folder)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FileScan binaryFile" in plan and "content" not in plan  # names alone
    assert sorted(map(tuple, q.batch_gaps(found).collect())) == [("sea", 2)]
    missing = {tuple(r) for r in q.batch_completeness(found, tables=NAMES).collect()}
    assert missing == {("sea", 3, "rare"), ("asia", 1, "rare"), ("asia", 2, "events,rare"), ("asia", 3, "rare")}


def test_loading_that_is_cut_off_resumes(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    given = sources(spark)
    b.commit_batches(spark, {"matches": given["matches"]}, folder)
    # the second table's rows are written, its ledger rows are not
    real = b.read_batches

    def fail(session, path, table, schema=None):
        if table == "events":
            raise RuntimeError("lost")
        return real(session, path, table, schema)

    monkeypatch.setattr(b, "read_batches", fail)
    with pytest.raises(RuntimeError, match="lost"):
        b.commit_batches(spark, given, folder)
    assert b.complete_batches(spark, folder, NAMES).count() == 0
    monkeypatch.undo()
    for _ in range(2):
        b.commit_batches(spark, given, folder)
        assert content(spark, folder) == expected(spark)
    # batches without rows of a table are complete as well
    assert b.complete_batches(spark, folder, NAMES).count() == 6
    sizes = {tuple(r) for r in b.ledger(spark, folder).filter("table_name = 'rare'").select("region", "batch_id", "rows").collect()}
    assert sizes == {("sea", 1, 1), ("sea", 2, 0), ("sea", 3, 0), ("asia", 1, 0), ("asia", 2, 0), ("asia", 3, 0)}


def test_a_stream_of_files_loads_whole_batches(spark, tmp_path):
    landing, folder, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    given = sources(spark)
    schemas = {n: df.schema.simpleString()[7:-1].replace(":", " ") for n, df in given.items()}
    for name in NAMES:
        b.write_batches(given[name].filter("id < 60"), landing, name)
    b.stream_batches(spark, landing, folder, state, tables=schemas, max_files=3)
    for name in NAMES:
        b.write_batches(given[name].filter("id >= 50"), landing, name, mode="append")  # a second file of batch 2
    for _ in range(2):
        b.stream_batches(spark, landing, folder, state, tables=schemas, max_files=3)
        assert content(spark, folder) == content(spark, landing)


def test_null_columns_from_footers(spark, tmp_path):
    folder = str(tmp_path)
    rows = sources(spark)["matches"]
    b.write_batches(rows, folder, "matches")
    rows.dropna(subset=["region"]).write.option("parquet.column.statistics.enabled", "false").partitionBy(*b.KEY).parquet(folder + "/bare")
    want = {(r, n, c) for r in ("sea", "asia") for n, c in ((2, "x"), (1, "ids"), (2, "ids"), (3, "ids"))} - {("asia", 3, "ids")}
    for table in ("matches", "bare"):
        got = b.all_null_batch_columns(spark, folder, table).collect()
        assert {tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_counts_of_flat_columns_read_no_rows(spark, tmp_path):
    b.write_batches(sources(spark)["events"], str(tmp_path), "events")
    seen = []
    real = b.footer_table
    try:
        b.footer_table = lambda session, counts: seen.append(counts._jdf.queryExecution().optimizedPlan().toString()) or real(session, counts)
        b.filled_counts(spark, str(tmp_path), "events")
    finally:
        b.footer_table = real
    assert "count(x)" in seen[0] and "RelationV2[region" in seen[0]


def test_folders_are_listed_by_few_tasks_and_once_for_their_counts(spark, tmp_path):
    rows = spark.range(200).selectExpr("id", "'sea' AS region", "id AS batch_id", "array(id) AS ids")
    b.write_batches(rows, str(tmp_path), "matches")
    tracker, before = spark.sparkContext.statusTracker(), spark.conf.get(b.LISTING)

    def listing_jobs(action):
        spark.sparkContext.setJobGroup(str(action), "listing")
        action()
        spark.sparkContext._jsc.clearJobGroup()
        found = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(str(action)) for s in tracker.getJobInfo(j).stageIds]
        return [stage.numTasks for stage in found if stage and stage.name.startswith(("load at", "parquet at"))]

    assert max(listing_jobs(lambda: b.batch_files(spark, str(tmp_path)))) <= 2 * spark.sparkContext.defaultParallelism
    counts = b.filled_counts(spark, str(tmp_path), "matches")
    assert counts.count() == 400 and counts.filter("filled <> 1 OR rows <> 1").isEmpty()
    assert spark.conf.get(b.LISTING) == before

"""The registered queries on the given tables, and the pipeline by its definitions."""

from collections import Counter

import compare
import llm_cases as cases
import pytest
from pyspark.sql import functions as F
from test_llm_texts import brute_components, brute_contamination

import corpus_pipeline
from cohortloom.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert compare.compare(spark, con, sf_dir, name, QUERIES[name], ORACLE[name]) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE and n != "op12_packing"])
def test_query_covers_its_table(spark, sf_dir, name):
    table, key = ("pages", "page_id") if name.startswith("op9") else ("documents", "doc_id")
    got = QUERIES[name](spark, sf_dir)
    want = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    assert Counter(r[0] for r in got.select(key).collect()) == Counter(r[0] for r in want.select(key).collect())


def test_all_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.fixture
def folder(spark, tmp_path, sf_dir):
    """A folder with labels and a benchmark beside which stages can run."""
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def write_benchmark(spark, folder, items):
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_keep_columns_and_follow_their_operators(spark, folder):
    rows = cases.hard_rows(21)
    items = [(1, " ".join(cases.plain(next(t for _, t, _ in rows if t and len(cases.plain(t)) > 14))[:12]))]
    write_benchmark(spark, folder, items)
    docs = cases.frame(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "mixing":
            assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert stage(spark, docs.limit(0), folder).count() == 0
    kept = Counter((r.doc_id, r.text, r.source) for r in stages["decontamination"](spark, docs, folder).collect())
    want = Counter(rows)
    for i, t, s in rows:
        if next(iter(brute_contamination([(i, t, s)], items, 10)))[2]:
            del want[i, t, s]
    assert kept == want
    near = Counter((r.doc_id, r.text) for r in stages["near_duplicates"](spark, docs, folder).collect())
    assert set(near) <= {(i, t) for i, t, _ in rows} and max(near[k] for k in near if k[1] and k[0] is not None) == 1
    left = [(i, t, "a") for (i, t), n in near.items() for _ in range(n)]
    sizes = brute_components([x for x in left if x[0] is not None and x[1] and x[1].split()], 5, 80)
    # nothing that stays is linked any more, and every group has one that stays
    assert all(c == i or i == next(j for j, t, _ in rows if j == i) for (i, _, c) in sizes)
    groups = {c for (_, _, c) in brute_components([x for x in rows if x[0] is not None], 5, 80)}
    assert groups <= {i for i, _ in near}


def test_stages_with_every_clashing_name(spark, folder):
    rows = [(i, f"some text number {i % 7}\nline {i}", "ab"[i % 2]) for i in range(30)]
    clashing = ["id_hash", "text_hash", "kept", "all_gone", "repeated", "copy", "Text_Hash_", "stage_kept", "stage_repeated", "group_id", "copies", "predicted", "n_hit", "first", "a", "b", "c"]
    docs = cases.frame(spark, rows).select("doc_id", "text", "source", "n_chars", *[F.lit(f"own {n}").alias(n) for n in clashing])
    write_benchmark(spark, folder, [(1, "no such words anywhere here")])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        found = out.collect()
        assert found and all(x[n] == f"own {n}" for x in found for n in clashing), name
    assert out.columns[-1] == "copy_"


def test_mixing_stage_repeats_documents(spark, folder):
    rows = [(i, f"text number {i} " + "w " * (i % 17), "ab"[i % 2]) for i in range(200)]
    out = corpus_pipeline.mix(spark, cases.frame(spark, rows).drop("copy"), folder).collect()
    copies = Counter(r.doc_id for r in out)
    assert max(copies.values()) <= 2 and {r.copy for r in out} == {1, 2}
    assert len(out) == len({(r.doc_id, r.copy) for r in out})


def test_pipeline_runs(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert set(docs.columns) <= set(out.columns)
    assert 0 < out.select("doc_id").distinct().count() <= docs.count()

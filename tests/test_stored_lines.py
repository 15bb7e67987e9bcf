"""The base tables are projections of one stored table of lines."""

import datetime

import pytest

from bindings import derive, queries_study, tables
from cohortloom import session


@pytest.fixture
def folder(spark, tmp_path):
    day = datetime.date(1996, 3, 1)
    kinds = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string"
    orders = [(k, k * 3, "P" if k % 4 == 0 else "F", 10.0, day, "1-URGENT") for k in range(40)]
    spark.createDataFrame(orders, kinds).write.parquet(f"{tmp_path}/orders.parquet")
    kinds = (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"
    )
    lines = [
        (k, k * 7 + i, k * 5 + i * i, None if i == 5 else 1 + i % 4, float(i + k % 11), 900.0 * i + k, 0.1 * i, 0.02, "NRA"[i % 3], "OF"[(k + i) % 2], day + datetime.timedelta(i % 3))
        for k in range(38)
        for i in range(k % 9)
    ]
    spark.createDataFrame(lines, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    yield str(tmp_path)
    tables.forget_studies()


def bag(df):
    return sorted(map(repr, df.collect()))


def test_base_tables_hold_the_rows_of_the_given_lines(spark, folder):
    structs = ["struct(" + ", ".join(derive.select_list(c, ints="ARRAY<INT>", array="array")) + ")" for c in derive.EVENTS]
    raw = tables.numbered(spark, folder)
    assert bag(tables.events(spark, folder)) == bag(raw.selectExpr(f"inline(array({', '.join(structs)}))"))
    people = tables.lines(spark, folder).selectExpr(*derive.select_list(derive.PARTICIPANT))
    assert bag(tables.participants(spark, folder)) == bag(people)
    assert tables.participants(spark, folder).count() < raw.count()


def test_a_study_stores_lines_once_and_no_base_tables(spark, folder):
    start = session.written()
    queries_study.event_type_counts(spark, folder).collect()
    queries_study.role_opponent(spark, folder).collect()
    names = [path.rsplit("/", 1)[1].split("-")[0] for path in session._written[start:]]
    assert names == ["lines", "manifest"]

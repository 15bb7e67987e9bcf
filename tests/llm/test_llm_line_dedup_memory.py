"""Texts stream past the removed lines; they are not sorted for it."""

import contextlib
import io

from cohortloom.llm.line_dedup import line_dedup


def test_texts_are_not_sorted(spark):
    docs = spark.createDataFrame([(i, "same\nown %d" % i, "s%d" % i) for i in range(12)], "doc_id long, text string, source string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            line_dedup(docs).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line.split("+- ")[-1].strip() for line in out.getvalue().splitlines() if "Join" in line]
    assert joins[0].startswith("ShuffledHashJoin") and "LeftOuter, BuildRight" in joins[0]
    assert [r.n_removed for r in line_dedup(docs).orderBy("doc_id").collect()] == [0] + [1] * 11

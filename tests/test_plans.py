import re

import pytest

from veilspan.operators import combine, extract
from veilspan.plans import catalog, files
from veilspan.session import spread
from veilspan.sources.blocks import whole_blocks
from veilspan.sources.rules import ASCII_RULES

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q01_span_scan", "q14_context_words", "q46_phrases"])
def test_scans_read_two_columns(spark, name):
    read = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan(catalog.queries()[name](spark, DATA))))
    assert read == {"doc_id:bigint,text:string"}


def test_scan_has_no_shuffle_and_no_python(spark):
    text = plan(extract.scan(whole_blocks(spark.read.parquet(f"{DATA}/documents.parquet")), ASCII_RULES))
    assert "Exchange" not in text and not re.search("Python|Arrow|Pandas", text)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(files.QUERIES)))
def test_no_query_runs_python_or_a_cartesian_product(spark, name):
    text = plan(catalog.queries()[name](spark, DATA))
    assert not re.search("Python|MapInArrow|Pandas|CartesianProduct", text)


def test_folds_shuffle_once(spark):
    assert plan(catalog.queries()["q10_greedy_suppression"](spark, DATA)).count("Exchange hashpartitioning") == 1


def test_only_small_tables_are_dealt_out(spark):
    assert "RoundRobin" in plan(spread(spark.read.parquet(f"{DATA}/documents.parquet")))
    assert "Exchange" not in plan(spread(spark.range(0, 100, 1, 64)))


def test_passages_are_joined_by_words(spark):
    docs = spark.createDataFrame([(1, "being near the old mill"), (2, "a bc d"), (3, None), (4, "xa bcd e")], "doc_id long, text string")
    passages = spark.createDataFrame([(1, "ing near"), (2, "near the old"), (3, "a bc"), (4, "mil"), (5, ""), (6, None), (7, "zz zz")], "item_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = combine.contained(passages, docs)
        assert not re.search("CartesianProduct|NestedLoop", plan(out))
        assert sorted(map(tuple, out.collect())) == [(1, 1), (1, 2), (1, 4), (2, 3), (4, 3)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

from pyspark.sql import functions as F

from veilspan.functions import text as tx
from veilspan.functions.spans import matches
from veilspan.sources import blocks as bl


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normalization(spark):
    assert one(spark, tx.normalize_block(F.lit(" a \n b\t"))) == "a b"
    assert one(spark, tx.normalize_loose(F.lit("a​ b　"))) == "a b"
    assert one(spark, tx.plain_spaces(F.lit("a b"))) == "a b"
    assert one(spark, tx.normalize_block(F.lit(None).cast("string"))) == ""


def test_placeholders(spark):
    cases = {"13/ОК-2023": "[CONTRACT_ID]/ОК-2023", "13-ОК-2023": "[CONTRACT_ID]-ОК-2023", "ОК13": "[CONTRACT_ID]", "a/b/c": "[CONTRACT_ID]"}
    for number, want in cases.items():
        assert one(spark, tx.contract_placeholder(F.lit(number))) == want


def test_system_parts_and_suffix(spark):
    got = one(spark, tx.system_parts(F.lit("Единая система учёта кадров")))
    assert (got.core, got.private, got.anonymized) == ("Единая система", "учёта кадров", "Единая система [SYSTEM_ID]")
    assert one(spark, tx.system_parts(F.lit("система учёта"))).anonymized == "система"
    assert one(spark, tx.system_parts(F.lit("просто слова"))) is None
    assert one(spark, tx.system_suffix(F.lit(" учёта кадров, а также"))) == "учёта кадров"
    assert one(spark, tx.system_suffix(F.lit(" учёта (УК) кадров"))) == "учёта"
    assert one(spark, tx.system_suffix(F.lit(" содержит всё"))) == ""


def test_uuids_depend_on_every_part(spark):
    a, b = (one(spark, tx.hash_uuid(F.lit(1), F.lit(x))) for x in "ab")
    assert a != b and one(spark, tx.is_uuid(F.lit(a))) and not one(spark, tx.is_uuid(F.lit(a[:-1])))


def test_matches_count_code_points(spark):
    got = one(spark, matches(F.lit("😀 a1 é b22"), r"[a-z]\d+"))
    assert [(m.start, m.end, m.value) for m in got] == [(2, 4, "a1"), (7, 10, "b22")]
    assert one(spark, matches(F.lit(None).cast("string"), "a")) == []


def test_blocks_keep_numbers_of_empty_lines(spark):
    df = spark.createDataFrame([(1, "a\n\n b  c "), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.block_id, r.text) for r in bl.text_blocks(df).orderBy("block_seq").collect()] == [("paragraph_0", "a"), ("paragraph_2", "b c")]

from veilspan.operators import extract, reports, rewrite
from veilspan.plans import flows
from veilspan.sources import blocks as bl
from veilspan.sources import tables
from veilspan.sources.rules import ASCII_RULES, Rule

TEXTS = ["mail a@b.com, ip 10.0.0.1 and 10.0.0.1.", "4111 1111 1111 1111", "nothing", "", None, "é😀 x@y.org"]


def blocks(spark):
    return bl.whole_blocks(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))


def test_round_trip(spark):
    out = flows.anonymise(blocks(spark), ASCII_RULES)
    hidden = out["blocks"]
    assert not any("@" in r.text or "10.0" in r.text for r in hidden.collect())
    back = flows.restore(hidden, out["replacements"].where("success"))
    assert {r.doc_id: r.text for r in back["blocks"].collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert tuple(back["statistics"].first()) == (5, 5, 0, 100.0)


def test_equal_values_get_their_own_ids(spark):
    rows = flows.anonymise(blocks(spark), ASCII_RULES)["replacements"].where("original_value = '10.0.0.1'").collect()
    assert len({r.uuid for r in rows}) == 2


def test_overlapping_spans_are_reported_not_replaced(spark):
    rows = flows.anonymise(blocks(spark), [*ASCII_RULES, Rule("digits", r"[0-9]{4} [0-9]{4}", "", 0.9)])["replacements"]
    got = [(r.original_value, r.success) for r in rows.where("doc_id = 1").orderBy("start", "ord").collect()]
    assert [s for _, s in got].count(True) >= 1 and any(not s for _, s in got)


def test_empty_selection_replaces_nothing(spark):
    items = spark.createDataFrame([], "doc_id long, block_id string, category string, original_value string, start int, end int, item int")
    out = flows.anonymise(blocks(spark), ASCII_RULES, items=items)
    assert {r.doc_id: r.text for r in out["blocks"].collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_unknown_blocks_are_skipped_and_first_wins(spark):
    schema = "doc_id long, block_id string, category string, original_value string, start int, end int, item int"
    items = spark.createDataFrame([(0, "paragraph_0", None, "a@b.com", 5, 12, 1), (0, "paragraph_0", "email", "a@b.com", 5, 12, 2), (0, "paragraph_7", "email", "x", 0, 1, 3)], schema)
    out = flows.anonymise(blocks(spark), items=items)
    assert [r.category for r in out["replacements"].collect()] == ["unknown"] and [r.item for r in out["skipped"].collect()] == [3]


def test_random_ids_differ(spark):
    found = extract.scan(blocks(spark), ASCII_RULES)
    a, b = ({r.uuid for r in rewrite.with_uuid(found, "random").collect()} for _ in range(2))
    assert len(a) == 5 and not a & b


def test_table_round_trip(spark, tmp_path):
    out = flows.anonymise(blocks(spark), ASCII_RULES)
    tables.write_replacements(out["table"], str(tmp_path / "t"))
    back = tables.read_replacements(spark, str(tmp_path / "t"))
    assert {(r.uuid, r.original_value) for r in back.collect()} == {(r.uuid, r.original_value) for r in out["table"].collect()}


def test_table_aliases_and_last_wins(spark):
    df = spark.createDataFrame([(" u1 ", "a"), ("u1", "b"), ("u2", "nan"), ("", "c"), (None, "d"), ("u3", " e ")], "`UUID` string, `Original` string").coalesce(1)
    assert sorted(map(tuple, tables.replacement_table(df).collect())) == [("u1", "b"), ("u3", "e")]


def test_ledger_is_json(spark, tmp_path):
    import json

    out = flows.anonymise(blocks(spark), ASCII_RULES)
    tables.write_ledger(out["ledger"], str(tmp_path / "l"))
    rows = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "l")).collect()]
    assert sum(r["total_matches"] for r in rows) == 5
    assert reports.mapping_statistics(out["replacements"]).first().unique_uuids == 5

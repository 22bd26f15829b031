import json

from veilspan.operators import caching, extract, hooks
from veilspan.sources import blocks as bl
from veilspan.sources import rules as ru
from veilspan.streaming import ingest


def test_structured_csv_is_repaired(spark, tmp_path):
    lines = ["category,pattern,description,confidence", r"Phone,\d{1,3}\s,number,0.9", r'Email,"a,b",quoted,x', "empty,,none,0.5"]
    (tmp_path / "r.csv").write_text("\n".join(lines), encoding="utf-8")
    got = [tuple(r) for r in ru.read_structured(spark, str(tmp_path / "r.csv")).collect()]
    assert got == [("phone", r"\d{1,3}\s", "number", 0.9), ("email", "a,b", "quoted", 0.5)]
    assert ru.repaired_line(lines[1]) == ("Phone", r"\d{1,3}\s", "number", "0.9")


def test_language_json(spark, tmp_path):
    rules = {"patterns": [{"category": "a", "type": "regex", "priority": 2, "pattern": "x+"}, {"category": "a", "type": "regex", "pattern": ""}, {"category": "b", "pattern_type": "phrase", "pattern": "y"}]}
    (tmp_path / "r.json").write_text(json.dumps(rules), encoding="utf-8")
    df = ru.read_language(spark, str(tmp_path / "r.json"))
    assert [(r.category, r.type, r.priority, r.confidence, r.context_required) for r in df.orderBy("category").collect()] == [("a", "regex", 2, 0.7, True), ("b", "phrase", 1, 0.7, True)]
    assert ru.lookup(df, "b", "phrase").count() == 1 and len(ru.from_json(json.dumps(rules))) == 1


def test_dictionary(spark, tmp_path):
    (tmp_path / "n.txt").write_text("Пётр\n\n Иван \nИван\n", encoding="utf-8")
    got = ru.dictionary(spark, str(tmp_path / "n.txt"), str(tmp_path / "missing.txt"))
    assert sorted(r.word for r in got.collect()) == ["Иван", "Петр"]


def test_rules_can_be_pruned_and_switched():
    off = ru.toggled(ru.ASCII_RULES, False, "email")
    assert len(ru.pruned(off)) == 4 and len(ru.pruned(ru.ASCII_RULES, least=0.9)) == 2
    assert ru.statistics(off)["enabled"] == 4 and ru.compiles(ru.ASCII_RULES[0]) and not ru.compiles(ru.Rule("x", "("))


def _blocks(spark, *texts):
    return bl.whole_blocks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_store_searches_new_texts_only(spark, tmp_path):
    seen = []

    def detect(b):
        seen.append(b.count())
        return extract.scan(b, ru.ASCII_RULES)

    path = str(tmp_path / "store")
    assert caching.with_store(_blocks(spark, "a@b.com", "A@b.com", "a@b.com"), detect, path).count() == 3
    assert caching.with_store(_blocks(spark, "a@b.com", "c@d.org"), detect, path).count() == 2
    assert seen == [2, 1]


def test_model_hook(spark):
    got = hooks.model_detections(_blocks(spark, "Anna met Bob", None), lambda: lambda t: [("person_name", 0, 4, 0.9)] if t else [], "model").collect()
    assert [(r.original_value, r.method) for r in got] == [("Anna", "model")]


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a@b.com"), (2, "none"), (3, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    found = ingest.detections(ingest.documents(spark, str(tmp_path / "in")), ru.ASCII_RULES)
    for _ in range(2):  # the second run has nothing new
        ingest.to_files(found, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert [r.original_value for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a@b.com"]

import pytest
from pyspark.sql import functions as F

from veilspan.operators import combine, extract, strategies
from veilspan.sources import blocks as bl
from veilspan.sources import rules as ru
from veilspan.sources.data import language


def blocks(spark, *texts):
    return bl.whole_blocks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("doc_id", "start", "ord").collect()]


#: For each category of the structured rules, a text with a match and the match.
STRUCTURED = {
    "phone": ("тел. 8 912 345-67-89", "8 912 345-67-89"), "email": ("пишите a.b@mail.ru сегодня", "a.b@mail.ru"), "passport": ("паспорт 4510 123456", "4510 123456"), "inn": ("ИНН 7707083893", "7707083893"),
    "snils": ("СНИЛС 112-233-445 95", "112-233-445 95"), "name": ("это Иванов Иван Иванович", "Иванов Иван Иванович"), "bank_account": ("счёт 40817810099910004312", "40817810099910004312"),
    "card_number": ("карта 4111 1111 1111 1111", "4111 1111 1111 1111"), "ogrn": ("ОГРН 1027700132195", "1027700132195"), "ogrnip": ("ОГРНИП 304500116000157", "304500116000157"), "kpp": ("КПП 773601001", "773601001"),
    "bik": ("БИК 044525225", "044525225"), "date_birth": ("14 августа 2023", "14 августа 2023"), "driver_license": ("права 77 12 345678", "77 12 345678"), "address": ("живёт на ул. Ленина", "ул. Ленина"),
    "foreign_passport": ("загранпаспорт 71 1234567", "71 1234567"), "military_id": ("билет АБ 1234567", "АБ 1234567"), "insurance_policy": ("полис 1234567890123456", "1234567890123456"), "car_number": ("машина А123ВС77", "А123ВС77"),
    "coordinates": ("точка 55.75° N, 37.61° E", "55.75° N, 37.61° E"), "medical": ("группа крови АII+ ", "группа крови АII"),
}


def test_every_structured_category_matches(spark):
    rules = ru.structured_rules()
    assert len(rules) == 39 and {r.category for r in rules} == set(STRUCTURED)
    names = list(STRUCTURED)
    found = extract.scan(blocks(spark, *(STRUCTURED[n][0] for n in names)), rules)
    got = {(r.doc_id, r.category, r.original_value) for r in found.collect()}
    for i, n in enumerate(names):
        assert (i, n, STRUCTURED[n][1]) in got, n
    for r in found.collect():
        assert STRUCTURED[names[r.doc_id]][0][r.start : r.end] == r.original_value


def test_plain_text_has_no_structured_match_but_words(spark):
    found = extract.scan(blocks(spark, "без чисел и имён", "", None), ru.structured_rules())
    assert found.count() == 0


def test_all_rules_compile_in_java(spark):
    good, bad = ru.checked(spark, [*ru.structured_rules(), *ru.language_rules(), *extract.CONTRACTS, *ru.ASCII_RULES])
    assert not bad and len(good) == 39 + 32 + 4 + 5
    assert [m for _, m in ru.checked(spark, [ru.Rule("x", "a*")])[1]] == ["matches the empty string"]
    assert len(ru.checked(spark, [ru.Rule("x", "(")])[1]) == 1


def test_confidence_of_language_rules():
    got = {}
    for r in ru.language_rules():
        got.setdefault(r.category, []).append(round(r.confidence, 2))
    assert got["person_name"] == [0.7, 0.7, 0.7, 0.7, 0.85, 0.85] and got["organization"] == [1.0, 1.0, 1.0] and got["financial_amount"] == [0.95]
    assert got["contract_number"] == [1.0, 1.0] and got["address"] == [1.0, 0.9, 0.9] and got["website_url"] == [0.8]


def test_systems(spark):
    text = "Работа ЕИСУФХД и ЕИС УФХД ПК, а также ГИС ЖКХ."
    long_ = "Единая информационная система управления закупками края предназначена для всего"
    got = values(extract.information_systems(blocks(spark, text, long_, "нет систем тут, мАИСт")), "doc_id", "original_value", "method", "core", "private", "confidence")
    assert got == [
        (0, "ЕИСУФХД", "complex_abbreviation", "ЕИС", "УФХД", 0.9),
        (0, "ЕИС УФХД ПК", "spaced_abbreviation", "ЕИС", "УФХД ПК", 0.95),
        (0, "ГИС ЖКХ", "simple_abbreviation", "ГИС ЖКХ", "", 0.85),
        (1, "Единая информационная система управления закупками края", "information_system_regex", "Единая информационная система", "управления закупками края", 0.8),
    ]


def test_refined_systems_keep_what_has_none(spark):
    rows = extract.scan(blocks(spark, "это ЕИС УФХД и фирма"), [ru.Rule("organization", "ЕИС УФХД", "", 0.8), ru.Rule("organization", "фирма", "", 0.8)])
    assert values(extract.refine_systems(rows), "original_value", "start", "category") == [("ЕИС УФХД", 4, "information_system"), ("фирма", 15, "organization")]


@pytest.mark.parametrize(("number", "valid"), [("13/ОК-2023", True), ("13-ОК-2023", True), ("ОК-13-2023", True), ("2023-13", True), ("ОК13", True), ("13/2023", True), ("7", False), ("12", False), ("абв", False)])
def test_contract_shapes(spark, number, valid):
    got = extract.contract_numbers(blocks(spark, f"контракт № {number} подписан"))
    assert (got.count() > 0) == valid
    assert {r.original_value for r in got.collect()} <= {number}


def test_number_alone_needs_a_contract_near(spark):
    assert extract.contract_numbers(blocks(spark, "заказ № 13/2023")).count() == 0


def test_context_words(spark):
    got = extract.scan_with_context(blocks(spark, "стоимость 1000 руб за всё", "просто 1000 руб за всё"), ru.language_rules(), language.CONTEXT_WORDS)
    assert [r.doc_id for r in got.where("category = 'financial_amount'").collect()] == [0]


def test_names_need_known_words(spark):
    found = extract.scan(blocks(spark, "Иванов Иван Иванович", "Петров И. И.", "Сидоров Пётр Кузьмич", "Фёдоров Семён Ильич"), [r for r in ru.language_rules() if r.category == "person_name"])
    word = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    got = extract.name_filter(found, word("Иванов", "Петров", "Федоров"), word("Иван", "Семен"))
    assert {(r.doc_id, r.original_value) for r in got.collect()} == {(0, "Иванов Иван Иванович"), (1, "Петров И. И."), (3, "Фёдоров Семён Ильич")}
    assert extract.name_filter(found, word(), word()).count() == 0


def test_phrases_prefer_longest(spark):
    got = values(extract.smart_phrases(blocks(spark, "Министерство связи края"), "government_org", ["министерство связи", "министерство", "края"]), "original_value", "confidence")
    assert [(v, round(c, 2)) for v, c in got] == [("Министерство связи", 0.97), ("края", 0.96)]


def test_partial_names_are_extended(spark):
    b = blocks(spark, "Министерство связи края и развития сообщает")
    found = extract.phrases(b, "government_org", ["министерство связи края"])
    got = extract.extend_partial(found, b, spark.createDataFrame([("Министерство связи края и развития",), ("Министерство связи края для иных целей",)], "name string")).first()
    assert (got.original_value, got.method, got.extended_from, round(got.confidence, 2)) == ("Министерство связи края и развития", "phrase_matcher_extended", "Министерство связи края", 0.75)


def test_hybrid_government(spark):
    rows = [(0, "paragraph_0", "government_org", "министерство связи", 0, 18, 0.8, "phrase_matcher", "", 0), (0, "paragraph_0", "government_org", "министерство", 0, 12, 0.7, "spacy_ner", "", 1), (0, "paragraph_0", "government_org", "комитет", 30, 37, 0.8, "spacy_ner", "", 2)]
    df = spark.createDataFrame(rows, "doc_id long, block_id string, category string, original_value string, start int, end int, confidence double, method string, description string, ord int")
    got = [(r.original_value, r.method, round(r.confidence, 2), r.organization_type) for r in strategies.hybrid_government(df).orderBy("start").collect()]
    assert got == [("министерство связи", "hybrid_phrase_matcher", 0.98, "government"), ("комитет", "hybrid_spacy_ner", 0.9, "government")]


def test_language_detections_end_to_end(spark):
    b = blocks(spark, "ООО «Рога и Копыта» стоимость 1000 руб и сайт https://a.b.ru/x")
    raw = extract.scan_with_context(b, ru.language_rules(), language.CONTEXT_WORDS)
    got = {(r.category, r.original_value) for r in strategies.language_detections(raw).collect()}
    assert {("financial_amount", "1000 руб"), ("website_url", "https://a.b.ru/x")} <= got and any(c == "organization" for c, _ in got)


def test_equal_texts_are_searched_once(spark):
    b = blocks(spark, "a@b.com x", "a@b.com x", "", None)
    got = combine.once_for_equal_texts(b, lambda x: extract.scan(x, ru.ASCII_RULES))
    assert sorted(r.doc_id for r in got.collect()) == [0, 1]


def test_invalid_strategy():
    with pytest.raises(ValueError):
        strategies.strategy("none")


def test_no_break_spaces_keep_offsets(spark):
    got = extract.scan(blocks(spark, "Иванов И. И. тут"), ru.language_rules())
    assert ("Иванов И. И.", 0, 12) in values(got, "original_value", "start", "end")


def test_scan_without_rules(spark):
    assert extract.scan(blocks(spark, "x"), []).count() == 0


def test_scan_is_one_narrow_stage(spark):
    df = extract.scan(blocks(spark, "x"), ru.ASCII_RULES).select(F.count(F.lit(1)))
    assert "Exchange hashpartitioning" not in df._jdf.queryExecution().toString()


def test_needs_drop_no_match(spark):
    arabic = str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩")
    texts = [t for t, _ in STRUCTURED.values()] + [t.translate(arabic) for t, _ in STRUCTURED.values()] + ["код ١٢٣٤٥٦٧٨٩٠ конец", "no digits"]
    b = blocks(spark, *texts)
    rules = [*ru.structured_rules(), *ru.language_rules(), *ru.ASCII_RULES]
    bare = [ru.Rule(**{**r.__dict__, "needs": ""}) for r in rules]
    got, want = (sorted(map(tuple, extract.scan(b, r).collect())) for r in (rules, bare))
    assert got == want and any(r[0] == len(texts) - 2 and r[2] == "inn" for r in got)


def test_values_are_searched_for_systems_once(spark):
    rows = [(1, "b", "organization", "Данные АИСДОМ", 5, 18, 0.7, "m", "", 0), (1, "b", "organization", "просто дом", 30, 40, 0.7, "m", "", 1), (2, "b", "organization", None, 0, 4, 0.7, "m", "", 0)]
    found = extract.refine_systems(spark.createDataFrame(rows, "doc_id long, block_id string, category string, original_value string, start int, end int, confidence double, method string, description string, ord int"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("АИС[А-ЯA-Z]{2,}") <= 1
    got = sorted((r.doc_id, r.category, r.original_value, r.start, r.end, r.core, r.private) for r in found.collect() if r.original_value)
    assert got == [(1, "information_system", "АИСДОМ", 12, 18, "АИС", "ДОМ"), (1, "organization", "просто дом", 30, 40, None, None)]
    assert found.count() == 3

"""Tokens, patterns over tokens, word forms, dictionaries and rule tables, against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilspan.functions.spans import matches
from veilspan.operators import dictionary, extract, morphology, rule_index, tokens
from veilspan.sources.rules import GOVERNMENT_FALLBACK, Rule, government_bodies

TOKEN = re.compile(r"([^\W\d_]\.(?<=[A-ZА-ЯЁ]\.)|\w+|[^\w\s])")
BLOCK = "doc_id long, block_id string, text string"


def plain_tokens(text):
    return [(m.group(), m.start(), m.end()) for m in TOKEN.finditer((text or "").replace(" ", " "))]


def word(t):
    return t.lower().replace("ё", "е")


TEXTS = [
    "Иванова Петра Сидоровича и А. Б. Козлова; ООО «Рога и Копыта». ООО \"Ромашка Плюс Минус\" конец", None, "", " \n ", "Козлов А. Б. ушёл, Козлов А.Б. пришёл", "ЗАО «Ромашка» и ип 'Плюс' и ао «»", "Петра Сидоровича Петра Сидоровича Петра",
    "é😀 Ромашка  Плюс a1_b.", "АО «Плюс\nМинус»", "А. Б. В. Г. Козлов",
]
FORMS = [("ромашка", "ромашка", "NOUN"), ("плюс", "плюс", "NOUN"), ("минус", "минус", "NOUN"), ("копыта", "копыто", "NOUN"), ("и", "и", "CONJ"), (None, "x", "NOUN"), ("плюс", "плюс", "PROPN")] + [(w, w, "PROPN") for w in ("иванова", "петра", "козлова", "сидоровича", "козлов")]
TAGS = {}
for _w, _, _t in FORMS:
    TAGS.setdefault(_w, set()).add(_t)


def accepted(text):
    """Every span that one of the four patterns accepts, by trying all of them."""
    t = plain_tokens(text)
    tags = [TAGS.get(word(x), set()) for x, _, _ in t]
    titled = lambda i: "PROPN" in tags[i] and re.match(r"[A-ZА-ЯЁ][^A-ZА-ЯЁ]*$", t[i][0])
    initial = lambda i: re.match(r"[A-ZА-ЯЁ]\.$", t[i][0])
    name = lambda i: "PROPN" in tags[i] and len(t[i][0]) > 2
    out = []
    for i in range(len(t) - 2):
        for label, tests in {"full_name": (titled,) * 3, "initials_lastname": (initial, initial, name), "lastname_initials": (name, initial, initial)}.items():
            if all(f(i + k) for k, f in enumerate(tests)):
                out.append((label, t[i][1], t[i + 2][2]))
    for i, (x, start, _) in enumerate(t):
        if word(x) in tokens.LEGAL_FORMS and i + 1 < len(t) and t[i + 1][0] in tokens.OPENING:
            j = i + 2
            while j < len(t) and tags[j] & {"NOUN", "PROPN"}:
                j += 1
                if j < len(t) and t[j][0] in tokens.CLOSING:
                    out.append(("quoted_organization", start, t[j][2]))
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    bits = ["Козлов", "Петра", "А.", "Б. ", "ООО", "ао", '"', "«", "»", "'", " ", " ", "  ", "Плюс", "минус", "и", ".", "КОЗЛОВ", "сидоровича", "x"]
    return TEXTS + [" ".join(rng.choices(bits, k=rng.randint(1, 60))) for _ in range(150)] + ["".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(60)] + ["ООО « Плюс » " * 400]


@pytest.fixture(scope="module")
def blocks(spark, texts):
    return spark.createDataFrame([(i, "b", t) for i, t in enumerate(texts)], BLOCK)


def test_tokens_and_offsets(blocks, texts):
    got = {}
    for r in tokens.exploded(blocks).orderBy("doc_id", "i").collect():
        got.setdefault(r.doc_id, []).append((r.text, r.start, r.end))
        assert r.word == word(r.text)
    assert got == {i: t for i, t in enumerate(map(plain_tokens, texts)) if t}


@pytest.mark.parametrize("broadcast", [True, False])
def test_patterns_equal_trying_all(spark, blocks, texts, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(morphology, "BROADCAST", -1)
    forms = spark.createDataFrame(FORMS, "form string, lemma string, tag string")
    rows = tokens.exploded(blocks)
    found = tokens.matched(morphology.with_tags(rows, morphology.resolve(rows.select("word"), forms, morphology.declension_endings(spark).where("false"))), tokens.patterns()).collect()
    got = {i: [] for i in range(len(texts))}
    for r in found:
        assert r.original_value == texts[r.doc_id].replace(" ", " ")[r.start : r.end]
        assert r.category == ("organization" if r.description == "quoted_organization" else "person_name")
        got[r.doc_id].append((r.description, r.start, r.end))
    assert {i: sorted(v) for i, v in got.items()} == {i: accepted(t) for i, t in enumerate(texts)}
    assert len(found) == sum(map(len, got.values())) > 100


def test_repeated_step_accepts_every_length(spark):
    b = spark.createDataFrame([(1, "b", "x a a a x a")], BLOCK)
    step = lambda w, more=False: tokens.Step(tokens.one_of(w), more)
    rows = tokens.exploded(b).selectExpr("*", "cast(null as array<string>) as tags")
    got = tokens.matched(rows, [tokens.Pattern("p", "c", (step("x"), step("a", True))), tokens.Pattern("q", "c", (step("a"),), 0.5)])
    assert sorted((r.description, r.start, r.end, r.confidence) for r in got.collect()) == [("p", 0, 3, 1.0), ("p", 0, 5, 1.0), ("p", 0, 7, 1.0), ("p", 8, 11, 1.0), ("q", 2, 3, 0.5), ("q", 4, 5, 0.5), ("q", 6, 7, 0.5), ("q", 10, 11, 0.5)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_unseen_forms_take_the_longest_ending(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(morphology, "BROADCAST", -1)
    words = ["Смирнова", "смирновой", "Достоевскому", "Петровичем", "Алексеевны", "стол", "Иванова", "ИВАНОВА", "аб", None, "Семёновым"]
    forms = spark.createDataFrame([("иванова", "иванов", "Surn"), ("иванова", "иваново", "Geox")], "form string, lemma string, tag string")
    got = morphology.resolve(spark.createDataFrame([(w,) for w in words], "word string"), forms, morphology.declension_endings(spark)).collect()
    want = [("смирнова", "смирнов", "Surn", "ова"), ("смирновой", "смирнов", "Surn", "овой"), ("достоевскому", "достоевский", "Surn", "скому"), ("петровичем", "петрович", "Patr", "овичем"), ("алексеевны", "алексеевна", "Patr", "евны"),
            ("стол", None, None, None), ("иванова", "иванов", "Surn", None), ("иванова", "иваново", "Geox", None), ("аб", None, None, None), ("семеновым", "семенов", "Surn", "овым")]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_endings_are_learned_by_majority(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choices("абвг", k=3)) + e, lemma, tag) for e, lemma, tag in [("ками", "ка", "NOUN"), ("ами", "а", "NOUN"), ("ой", "ый", "ADJF"), ("ой", "ая", "ADJF")] for _ in range(40)]
    forms = [(f, f[:3] + end, t) for f, end, t in rows] + [("нет", "других", "X"), (None, "a", "b"), ("ab", "ab", "X")]
    got = {r.ending: (r.lemma_ending, r.tag) for r in morphology.learn_endings(spark.createDataFrame(forms, "form string, lemma string, tag string")).collect()}
    counts = {}
    for f, lemma, t in {(f, m, t) for f, m, t in forms if f}:
        for k in range(1, min(morphology.LONGEST, len(f) - morphology.STEM) + 1):
            if lemma.startswith(f[:-k]):
                c = counts.setdefault(f[-k:], {})
                key = (lemma[len(f) - k :], t)
                c[key] = c.get(key, 0) + 1
    assert got == {e: min(c, key=lambda k: (-c[k], k)) for e, c in counts.items()}


def test_names_by_morphology(spark):
    b = spark.createDataFrame([(1, "b", "Видел Смирнова и Ромашку. директор Неизвестный пришёл, Неизвестный"), (2, "b", None), (3, "b", "")], BLOCK)
    forms = spark.createDataFrame([("неизвестный", "неизвестный", "PROPN"), ("видел", "видеть", "VERB")], "form string, lemma string, tag string")
    resolved = morphology.resolve(tokens.exploded(b).select("word"), forms, morphology.declension_endings(spark))
    got = sorted((r.start, r.original_value, r.method, round(r.confidence, 3)) for r in morphology.names(b, resolved, ["Директор"]).collect())
    assert got == [(6, "Смирнова", "morphological_enhanced", 0.75), (35, "Неизвестный", "morphological", 0.65)]


def test_inflected_names_pass_the_dictionary_filter(spark):
    values = ["Смирнову Петру", "Петровой Анной", "Козлову А.Б.", "Столу Петру"]
    rows = spark.createDataFrame([(i, "b", "person_name", v, 0) for i, v in enumerate(values)], "doc_id long, block_id string, category string, original_value string, ord int")
    surnames, given = (spark.createDataFrame([(w,) for w in ws], "word string") for ws in (["Смирнов", "Петров", "Козлов"], ["Петр", "Анна"]))
    forms = spark.createDataFrame([("петру", "петр", "Name"), ("анной", "анна", "Name"), ("столу", "стол", "NOUN")], "form string, lemma string, tag string")
    lemmas = morphology.name_lemmas(rows, forms, morphology.declension_endings(spark))
    assert extract.name_filter(rows, surnames, given).count() == 0
    assert sorted(r.doc_id for r in extract.name_filter(rows, surnames, given, lemmas).collect()) == [0, 1, 2]


PHRASES = ["рога и копыта", "Плюс", "плюс минус", "минус", "А. Б.", "копыта».", "и и", "ООО «", "", None, " ", "ПЛЮС", "a1_b"]


@pytest.mark.parametrize("broadcast", [True, False])
def test_dictionary_equals_looking_each_phrase_up(spark, blocks, texts, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(dictionary, "BROADCAST", -1)
    table = spark.createDataFrame([(p, f"c{i % 2}", 0.5 + i / 100) for i, p in enumerate(PHRASES)], "phrase string, category string, confidence double")
    got = sorted((r.doc_id, r.category, r.start, r.end) for r in dictionary.match(blocks, table).collect())
    want = set()
    spelt = lambda t, text: [word(x) if k == 0 or t[k - 1][2] == a else " " + word(x) for k, (x, a, _) in enumerate(t)]
    for d, text in enumerate(texts):
        t = plain_tokens(text)
        s = spelt(t, text)
        for i, p in enumerate(PHRASES):
            q = plain_tokens(p)
            if q:
                w = spelt(q, p)
                for k in range(len(t) - len(q) + 1):
                    if s[k].strip() == w[0].strip() and s[k + 1 : k + len(q)] == w[1:]:
                        want.add((d, f"c{i % 2}", t[k][1], t[k + len(q) - 1][2]))
    assert got == sorted(want) and len(got) > 300


def test_longest_phrases_win_and_empty_dictionaries_find_nothing(spark, blocks):
    table = spark.createDataFrame([("плюс минус", "p", 0.1), ("минус", "p", 0.1)], "phrase string, category string, confidence double")
    b = spark.createDataFrame([(1, "b", "плюс минус минус")], BLOCK)
    assert sorted((r.start, r.end, round(r.confidence, 3)) for r in dictionary.match_longest(b, table).collect()) == [(0, 10, 0.97), (11, 16, 0.96)]
    assert dictionary.match(blocks, table.where("false")).count() == 0


def test_government_bodies_through_the_index(spark):
    b = spark.createDataFrame([(1, "b", "Федеральная  служба и Совет Федерации, советы"), (2, "b", "Правительство Российской Федерации")], BLOCK)
    got = sorted((r.doc_id, r.description) for r in dictionary.match(b, dictionary.from_words(government_bodies(spark), "government_org")).collect())
    assert got == [(1, "служба"), (1, "совет"), (1, "совет федерации"), (1, "федеральная служба"), (2, "правительство"), (2, "правительство российской федерации")]
    assert {d for _, d in got} <= set(GOVERNMENT_FALLBACK)


def test_a_dictionary_of_many_phrases(spark, blocks):
    many = spark.range(60_000).selectExpr("concat('phrase', id, ' number ', id) as phrase", "'m' as category", "0.7D as confidence")
    b = spark.createDataFrame([(1, "b", "x phrase7 number 7, PHRASE59999 Number  59999 phrase8 number 9")], BLOCK)
    assert sorted((r.start, r.end) for r in dictionary.match(b, many).collect()) == [(2, 18), (20, 45)]


LITERALS = {
    r"\bабв\d+": "абв", r"(?:ab|cd)efg": "efg", r"a?bc*def": "def", r"(abc)+de": "abc", r"[abc]{3}": None, r"x{2}yz": "yz", r"\d{16}": None, "(?i)Token: ": "Token: ", r"(?<!a)bcd(?=efghi)": "bcd", "(": None, "": None,
    r"a\Qbcd\E": None, r"no\s+space": "space", r"(?>abcd)e": "abcde", r"абв|где": None, r"((?:abc)d)efg": "abcdefg", r"(abc)?de": "de", r"(abc){0,2}d": "d", r"ab(?x) cd": None, r"a\.bcd": "bcd", r"x*": None, r"(a|b(c)d)efg\p{Lu}hi": "efg", "ab{0,3}c": "c", r"[a&&[b]]cd": None,
}


def test_required_literals(spark):
    rows = spark.createDataFrame([(p,) for p in LITERALS], "p string")
    got = {r.p: r.l for r in rows.select("p", rule_index.required_literal(rows["p"]).alias("l")).collect()}
    want = dict(LITERALS) | {r"(abc)+de": got[r"(abc)+de"]}
    assert got[r"(abc)+de"] in ("abc", "de") and got == want


RULES = [r"\bкозлов\b", r"(?iu)плюс\s+минус", r"[А-Я]\.\s*[А-Я]\.", r"ООО\s*«[^»]*»", r"(?:Петра|Плюс)\s", r"сидорович[а-я]*", r"(?iu)КОЗЛОВ", "x", None, "", r"(?iu)ÉΣ"]
ROWS = "rule int, category string, pattern string, description string, confidence double, method string"


@pytest.mark.parametrize("broadcast", [True, False])
def test_rule_table_equals_running_every_rule(spark, blocks, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(rule_index, "BROADCAST", -1)
    table = spark.createDataFrame([(i, f"c{i}", p, "d", 0.5, "regex") for i, p in enumerate(RULES)], ROWS)
    got = sorted((r.doc_id, r.category, r.start, r.end, r.original_value) for r in rule_index.scan(blocks, table).collect())
    each = [Rule(f"c{i}", p, "d", 0.5) for i, p in enumerate(RULES) if p]
    want = sorted((r.doc_id, r.category, r.start, r.end, r.original_value) for r in extract.scan(blocks, each).collect())
    assert got == want and len({c for _, c, *_ in got}) >= 7


def test_odd_letters_meet_their_rules(spark):
    b = spark.createDataFrame([(1, "b", "ὈΔΥΣΣΕΎΣ straſse İstanbul K")], BLOCK)
    table = spark.createDataFrame([(i, "c", p, "", 0.5, "regex") for i, p in enumerate(["(?iu)ὀδυσσεύς", "(?iu)strasse", "(?iu)istanbul"])], ROWS)
    got = {r.rule for r in rule_index.candidates(b, rule_index.index(table)).collect()}
    assert got == {0, 1, 2}


def test_texts_are_not_sorted_by_rule(spark, blocks):
    table = rule_index.from_rules(spark, [Rule("a", r"\bплюс\w*"), Rule("b", r"копыта|[а-я]+")])
    plan = rule_index.scan(blocks, table)._jdf.queryExecution().sparkPlan().toString()
    assert not re.search(r"\bSort \[", plan)


@pytest.mark.parametrize("text", ["ab1 AB_2\x0bcd\x1f ef\x00$+<gh>^ k 9", "ab1 é \u0661 K \u212a \u2003x", "ab\ue000 cd"])
def test_ascii_texts_are_searched_as_all_others(spark, text):
    found = [r"\b\w+\b", r"[^\w\s]+", r"\d+", r"\S+", r"(?i)k", r"(?iu)k", r"\p{Punct}+", r"\x{212A}|e", r"(?<=\s)\w", r"\bab\W"]
    table = rule_index.from_table(spark.createDataFrame([("c", p) for p in found], "category string, pattern string"))
    b = spark.createDataFrame([(1, "b", text)], BLOCK)
    got = sorted((r.start, r.end, r.original_value) for r in rule_index.scan(b, table).collect())
    want = [(r.m.start, r.m.end, r.m.value) for p in found for r in b.select(F.explode(matches(b["text"], "(?U)" + re.sub(r"^\(\?i\)", "(?iu)", p))).alias("m")).collect()]
    assert got == sorted(want) and got


def test_rules_are_validated(spark):
    table = spark.createDataFrame([(p,) for p in ["a+", "(", "a*", "", None, "[a", "x|"]], "pattern string")
    got = [(r.pattern, r.valid, r.reason) for r in rule_index.validated(table).collect()]
    assert got == [("a+", True, None), ("(", False, "doesn't compile"), ("a*", False, "matches the empty string"), ("", False, "no pattern"), (None, False, "no pattern"), ("[a", False, "doesn't compile"), ("x|", False, "matches the empty string")]


@pytest.mark.parametrize("few", [1_000, -1])
def test_rules_with_equal_patterns_and_words_first(spark, few, monkeypatch):
    monkeypatch.setattr(rule_index, "FEW", few)
    found = [r"\bab[a-z]*", r"\bab[a-z]*", r"\bab?", r"\bab\s+of\b", r"\bab|\bof", r"\bof+", r"\b(?:ab|of)\s+(?:and|of)\b", r"\ba", r"\bAb1{2}", r"\bаб\w+", r"\b(ab)c(?=\s)", r"(?i)\bOF\b", "ab of", r"abc  cab\sof", "(ab, of)", r"\(ab\)? of: a"]
    b = spark.createDataFrame([(i, "b", t) for i, t in enumerate(["ab abc  cab of\nab of and Ab11 xab", "éab ab\u0301 off абв ab\u00a0of", "a_b ofof 7ab OF", "", None, "cab", "ab, of (ab of: a"])], BLOCK)
    table = spark.createDataFrame([(i, f"c{i}", p, "", 0.5, "regex") for i, p in enumerate(found)], ROWS)
    got = sorted((r.doc_id, r.rule, r.start, r.end, r.original_value, r.ord) for r in rule_index.scan(b, table).collect())
    each = [(r.doc_id, i, r.m.start, r.m.end, r.m.value, r.ord) for i, p in enumerate(found) for r in b.select("doc_id", F.posexplode(matches(F.replace("text", F.lit("\u00a0"), F.lit(" ")), "(?U)" + p)).alias("ord", "m")).collect()]
    assert got == sorted(each) and {g[1] for g in got} == set(range(len(found)))


def test_few_rules_come_to_texts_that_move_once(spark, blocks):
    table = spark.createDataFrame([(i, "c", p, "", 0.5, "regex") for i, p in enumerate([r"\bкозлов\b", r"\bкозлов\b", "плюс"])], ROWS)
    plan = rule_index.scan(blocks, table)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("RepartitionByExpression") + len(re.findall(r"Exchange hashpartitioning\(doc_id", plan)) <= 1 and not re.search(r"HashAggregate\(keys=\[doc_id", plan)
    assert not re.search(r"Filter [^\n]*regexp_replace\([^\n]*\ue000", plan)


def test_very_long_texts(spark):
    b = spark.createDataFrame([(1, "b", "слово " * 60_000 + "ООО «Плюс»"), (2, "b", "ж" * 300_000)], BLOCK)
    table = spark.createDataFrame([("ооо «плюс»", "c", 0.5)], "phrase string, category string, confidence double")
    assert [(r.start, r.end) for r in dictionary.match(b, table).collect()] == [(360_000, 360_010)]
    rules = spark.createDataFrame([(1, "c", "ООО «[^»]*»", "", 0.5, "regex")], ROWS)
    assert [(r.start, r.end) for r in rule_index.scan(b, rules).collect()] == [(360_000, 360_010)]


RUSSIAN = [
    "Петров Иван Сидорович, паспорт 4510 123456, ИНН 7701234567, тел. +7 (495) 123-45-67, petrov@example.com", "ООО «Ромашка» и МИНИСТЕРСТВО цифрового развития, г. Москва, ул. Тверская, д. 5", "зарплата: 50 000 руб, диагноз и лечение", "ЕИСЗАКУПКИ и ГИСЖКХ, https://site.example.org/a?b=c",
    "Договор от 5 мая 2023 г. № 13/ОК-2023, договор № 7-А", "СНИЛС 123-456-789 01, счёт 40702810900000012345, дата 14.08.2023", "4111 1111 1111 1111", None, "",
]


def test_shipped_rules_as_tables(spark):
    """Structured and language rules through the index find what they find one by one."""
    from veilspan.sources import rules

    b = spark.createDataFrame([(i, "b", t) for i, t in enumerate(RUSSIAN)], BLOCK)
    for mine in (rules.structured_rules(), rules.language_rules()):
        each = [r for r in mine if not r.group]
        assert len(each) > 20
        got = sorted((r.doc_id, r.category, r.start, r.end) for r in rule_index.scan(b, rule_index.from_rules(spark, mine)).collect())
        want = sorted((r.doc_id, r.category, r.start, r.end) for r in extract.scan(b, each).collect())
        assert got == want and len(got) > 8
        assert rule_index.validated(rule_index.from_rules(spark, mine)).where("not valid").count() == 0


def test_rule_files_through_the_index(spark, tmp_path):
    """A CSV of structured rules and a JSON of language rules, as they are read."""
    import json

    from veilspan.sources import rules

    csv, js = tmp_path / "rules.csv", tmp_path / "rules.json"
    csv.write_text("category,pattern,description,confidence\nInn,ИНН\\s*\\d{10,12},tax number,0.9\nCARD,\\d{4} \\d{4},card,x\n")
    js.write_text(json.dumps({"patterns": [{"category": "date", "type": "regex", "pattern": "(?i)ДАТА\\s+[\\d.]+"}, {"category": "position", "type": "phrase", "pattern": "директор"}, {"category": "date", "type": "regex", "pattern": ""}]}))
    table = rule_index.from_table(rules.read_structured(spark, str(csv))).unionByName(rule_index.from_table(rules.read_language(spark, str(js))))
    b = spark.createDataFrame([(i, "b", t) for i, t in enumerate(RUSSIAN)], BLOCK)
    got = sorted((r.doc_id, r.category, r.original_value, r.confidence) for r in rule_index.scan(b, table).collect())
    assert (0, "inn", "ИНН 7701234567") in {g[:3] for g in got} and (5, "date", "дата 14.08.2023", 0.7) in got and (6, "card", "4111 1111", 0.5) in got
    assert rules.lookup(rules.read_language(spark, str(js)), "position").count() == 1


def read_counted(spark, df):
    """df, and a count of its rows that are read."""
    seen = spark.sparkContext.accumulator(0)

    def rows(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(rows, df.schema), seen


ODD = ["ΟΔΟΣ ΑΣ'Β Σ. ΑΣ", "İstanbul I\u0307 ﬁ", "a\u0301 \u0301b e\u200dx", "\uE000a\uE000", "x\u00a0y\u00a0", "😀😀 a😀b", "А. Б.\r\nЁж", None, "", " ", "a " * 40_000]


def test_tokens_of_tables_equal_the_expression(spark):
    rows = spark.createDataFrame([(i, "b", t) for i, t in enumerate(ODD)], BLOCK).repartition(2)
    want = rows.select("doc_id", F.posexplode(tokens.tokens(F.col("text"))).alias("i", "t")).select("doc_id", "i", "t.*").withColumn("word", tokens.word_of(F.col("text")))
    got = tokens.exploded(rows)
    assert "MapInArrow" in got._jdf.queryExecution().toString()  # not cut token by token in expressions
    assert sorted(map(tuple, got.drop("block_id").collect())) == sorted(map(tuple, want.collect()))


def test_dictionaries_meet_odd_letters(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "b", t) for i, t in enumerate(ODD[:-1])], BLOCK)
    known = spark.createDataFrame([(p, "c", 0.5) for p in ("οδος ας", "ας", "x y", "i̇stanbul", "a😀b", "А. Б. еж", "a😀b c")], "phrase string, category string, confidence double")
    found = dictionary.match(rows, known)
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    few = sorted((r.doc_id, r.original_value, r.start, r.end, r.ord) for r in found.collect())
    assert {"x y", "a😀b", "А. Б.\r\nЁж"} <= {v for _, v, *_ in few}
    assert all(ODD[d].replace("\u00a0", " ")[a:z] == v for d, v, a, z, _ in few)
    monkeypatch.setattr(dictionary, "BROADCAST", 0)
    assert few == sorted((r.doc_id, r.original_value, r.start, r.end, r.ord) for r in dictionary.match(rows, known).collect())


def test_longest_phrases_are_folded_by_islands(spark):
    rows = spark.createDataFrame([(0, "b", "of the x " * 3000)], BLOCK)
    known = spark.createDataFrame([(p, "c", 0.5) for p in ("of", "of the", "the x")], "phrase string, category string, confidence double")
    found = dictionary.match_longest(rows, known)
    assert "island" in found._jdf.queryExecution().toString()  # not one array for the whole block
    assert sorted((r.start, r.end) for r in found.collect()) == [(9 * k, 9 * k + 6) for k in range(3000)]


def test_names_read_the_texts_once(spark):
    blocks, seen = read_counted(spark, spark.createDataFrame([(i, "b", "Козлов и Петра тут") for i in range(20)], BLOCK))
    resolved = spark.createDataFrame([("козлов", "Surn"), ("петра", "PROPN")], "word string, tag string")
    assert morphology.names(blocks, resolved, ["тут"]).count() == 40
    assert seen.value == 20


def test_only_runs_that_can_match_are_folded(spark):
    steps = [(p, s, step) for p, pattern in enumerate(tokens.patterns()) for s, step in enumerate(pattern.steps)]
    at = lambda p, s: [(q, t) for q, t, _ in steps].index((p, s))
    holds = lambda *on: [k in on for k in range(len(steps))]
    name = holds(*(at(0, s) for s in range(3)))
    made = [("two", i, name) for i in (0, 1)] + [("gap", i, name) for i in (0, 1, 3, 4)] + [("three", i, name) for i in (1, 5, 6, 7, 8)] + [("late", 0, holds(at(1, 2)))] + [("late", i, name) for i in (1, 2, 3)]
    rows = spark.createDataFrame([(d, "b", i, h) for d, i, h in made], "doc_id string, block_id string, i int, holds array<boolean>")
    assert sorted((r.doc_id, r.i, r.run) for r in tokens._reached(rows, steps).collect()) == [("late", i, 0) for i in (1, 2, 3)] + [("three", i, 5) for i in (5, 6, 7, 8)]

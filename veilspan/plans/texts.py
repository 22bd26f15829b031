"""Queries of contracts, people and cut names on many different texts, whose SQL searches them.

Contract texts are made from orders (numbers of good and bad shapes, with and without the words that they need, two a text); people and names from words of the
benchmark. The SQL scans, splits and joins; it states no result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import dictionary, extract
from ..session import spread, table
from ..sources import blocks as bl
from ..sources.rules import Rule
from .catalog import DOCS, _docs, _with_spans
from .words import _TOKENS, _WORDS, _benchmark_words

#: What is written around the numbers {a} and {b}, and how a number is spelt from the order's key {k} and {m}, one of MARKS.
CONTRACT_TEXTS = (
    "государственный контракт № {a} подписан, см. номер {b}", "по договору от 5 мая 2023 г. № {a} и № {b}", "номер {a} без нужного слова, а № {b} тоже", "Контракт от апреля №{a}; НОМЕР {b}", "счёт № {a}, договор номер {b}",
    "договор от 12 июня 2022 г №{a}.", "{a} и {b} — контракт", "контракт" + " далеко" * 9 + " № {a} и номер {b}",
)
NUMBERS = ("{k}/ОК-2023", "{k}-АБ-2023", "ОК-{k}-2023", "2023-{k}", "ОК{k}", "{k}/2023", "{k}", "{m}{k}-x", "{k}/ок-20", "№{k}/2023")
MARKS = ("А", "б", "Z", "ОК")


def _filled(texts: tuple[str, ...], choice, **parts):
    """One of the texts, by choice, with its parts in braces replaced by columns."""
    out = F.element_at(F.array(*map(F.lit, texts)), (choice % len(texts) + 1).cast("int"))
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def _contract_blocks(spark, d) -> DataFrame:
    key, other = F.col("o_orderkey"), F.col("o_custkey")
    mark = _filled(MARKS, other)
    number = lambda choice, k: _filled(NUMBERS, choice, k=(k % 9999 + 1).cast("string"), m=mark)
    text = _filled(CONTRACT_TEXTS, key, a=number(key + other, key), b=number(other, other))
    return bl.whole_blocks(spread(table(spark, d, "orders")).select(key.alias("doc_id"), text.alias("text")))


def q92(spark, d):
    found = extract.contract_numbers(_contract_blocks(spark, d))
    return found.select("doc_id", "original_value", "start", "end", "confidence", "method")


def _people(spark, d) -> DataFrame:
    """doc_id (item and place), original_value: one to three words of the benchmark, some with initials."""
    w = F.col("w")
    at = lambda i: F.get(w, i)
    made = lambda i: F.array(at(i), F.concat_ws(" ", at(i), at(i + 1)), F.concat_ws(" ", at(i), at(i + 1), at(i + 2)), F.concat(at(i), F.lit(" А.Б.")), F.concat(F.lit("А. Б. "), at(i)), F.concat(F.lit("А.Б. В.Г. "), at(i)))
    rows = _benchmark_words(spark, d).where(F.size(w) > 3).select("item_id", F.explode(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(i.alias("i"), F.get(made(i), i % 6).alias("v")))).alias("p"))
    ids = F.concat_ws("-", "item_id", "p.i")
    return rows.select(ids.alias("doc_id"), F.lit("b").alias("block_id"), F.when(F.col("p.i") % 13 == 12, "other").otherwise(F.lit("person_name")).alias("category"), F.col("p.v").alias("original_value"), F.lit(0).alias("ord"))


def q93(spark, d):
    words = _benchmark_words(spark, d)
    surnames = words.where("item_id % 2 = 0").select(F.explode("w").alias("word")).distinct()
    given = words.where("item_id % 3 = 0").select(F.explode("w").alias("word")).where(F.length("word") >= 4).distinct()
    return extract.name_filter(_people(spark, d), surnames, given).select("doc_id", "category", "original_value")


def q94(spark, d):
    n = F.length("form")
    forms = _benchmark_words(spark, d).select(F.explode("w").alias("form")).distinct().select("form", F.when(n % 4 == 3, "VERB").otherwise(F.lit("NOUN")).alias("pos"), (n % 3 > 0).alias("animate"), F.lit(0).alias("ord"))
    return extract.three_nouns(_people(spark, d), forms).select("doc_id", "category", "original_value")


def q95(spark, d):
    """Beginnings of three words, found in the documents, extended to names of six words where enough of these stand around."""
    names = _benchmark_words(spark, d).where(F.size("w") >= 6)
    names = names.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 6, F.lit(6)), lambda i: F.slice("w", i + 1, F.lit(6)))).alias("n"))
    names = names.select(F.array_join("n", " ").alias("name"), F.array_join(F.slice("n", 1, 3), " ").alias("short")).distinct()
    starts = names.select(F.col("short").alias("phrase"), F.lit("name").alias("category"), F.lit(0.9).alias("confidence")).distinct()
    docs = _docs(spark, d)
    found = extract.extend_partial(dictionary.match(docs, starts, "regex"), docs, names.select("name"))
    return found.select("doc_id", "start", "original_value", F.round("confidence", 6).alias("confidence"), "method", F.col("extended_from").isNotNull().alias("extended"))


#: Around words of the benchmark ({u} and {v} in capitals, {x} and {y} as they are): systems of all kinds, beside each other and overlapping, and what only looks like them.
SYSTEM_TEXTS = (
    "Данные АИС{u} приняты и ЕИС {v}", "это единая информационная система {x} {y} содержит данные", "в ГИС ЖКХ и потом ФГИС {u} {v}.", "гис жкх {u} рядом", "x{u}АИС{v} и аис{u}", "ЕГИС{u}x и ПГИС {u}",
    "государственная информационная система {x}, затем автоматизированная информационная система {y} ({x})", "ЕИС И {u} ЕИС {v} ДЛЯ", "ЕИС ГИС ЖКХ {u} {v}", "ГИС ЖКХ, {u}", "Портал {x} {y} и платформа", "Федеральная информационная система {u} служит всем", "просто {x} {y}",
)


def _system_blocks(spark, d) -> DataFrame:
    w = F.col("w")
    at = lambda i: F.get(w, i)
    rows = _benchmark_words(spark, d).select("item_id", F.filter("w", lambda x: F.length(x) > 1).alias("w")).where(F.size(w) > 4)
    rows = rows.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), F.size(w) - 4), lambda i: F.struct(i.alias("i"), at(i).alias("u"), at(i + 1).alias("v"), at(i + 2).alias("x"), at(i + 3).alias("y")))).alias("p"))
    text = _filled(SYSTEM_TEXTS, F.col("p.i"), u=F.upper("p.u"), v=F.upper("p.v"), x=F.col("p.x"), y=F.col("p.y"))
    return bl.whole_blocks(rows.select(F.concat_ws("-", "item_id", "p.i").alias("doc_id"), text.alias("text")))


def q96(spark, d):
    found = extract.information_systems(_system_blocks(spark, d))
    return found.select("doc_id", "original_value", "start", "end", "confidence", "method", "core", "private")


def q97(spark, d):
    """Every text as an organisation, refined to the systems in it."""
    blocks = _system_blocks(spark, d)
    rows = blocks.select("doc_id", "block_id", F.lit("organization").alias("category"), F.col("text").alias("original_value"), F.lit(5).alias("start"), (F.length("text") + 5).alias("end"), F.lit(0.7).alias("confidence"), F.lit("spacy_ner").alias("method"), F.lit("").alias("description"), F.lit(0).alias("ord"))
    return extract.refine_systems(rows).select("doc_id", "category", "original_value", "start", "end", "method")


def q98(spark, d):
    """Every text as a system's name, and as what follows one."""
    blocks = _system_blocks(spark, d)
    rows = extract.span_systems(blocks.select("doc_id", F.col("text").alias("original_value"), F.when(F.length("text") % 2 == 0, "phrase_matcher").otherwise(F.lit("token_matcher")).alias("method")))
    return rows.select("doc_id", "method", "confidence", "core", "private", "anonymized", tx.system_suffix(F.concat(F.lit("  "), F.col("original_value"))).alias("suffix"))


def _case(values: tuple[str, ...], choice: str) -> str:
    return f"CASE {choice} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _number(choice: str, k: str) -> str:
    return f"replace(replace({_case(NUMBERS, choice)}, '{{k}}', CAST({k} % 9999 + 1 AS VARCHAR)), '{{m}}', {_case(MARKS, 'o_custkey')})"


#: The rules of contracts for DuckDB, whose classes are ASCII.
_CONTRACTS = tuple(Rule(r.category, ("(?i)" if r.ignore_case else "") + r.pattern.replace(r"\w", r"[\p{L}\p{N}_]"), r.description, r.confidence, r.method) for r in extract.CONTRACTS)
_PEOPLE = f"""{_WORDS}, pl AS (SELECT item_id, w, unnest(range(1, len(w) - 1)) AS i FROM bw WHERE len(w) > 3),
people AS (SELECT item_id || '-' || (i - 1) AS doc_id, CASE WHEN (i - 1) % 13 = 12 THEN 'other' ELSE 'person_name' END AS category,
  CASE (i - 1) % 6 WHEN 0 THEN w[i] WHEN 1 THEN w[i] || ' ' || w[i + 1] WHEN 2 THEN w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] WHEN 3 THEN w[i] || ' А.Б.' WHEN 4 THEN 'А. Б. ' || w[i] ELSE 'А.Б. В.Г. ' || w[i] END AS original_value FROM pl)"""
_ALL = "SELECT DISTINCT unnest(w) AS word FROM bw"

def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _suffix(rest: str) -> str:
    """The suffix of a text whose words stand between single spaces."""
    clean = r"lower(regexp_replace(x, '[^\p{L}\p{N}_\s-]', '', 'g'))"
    stops = _list(tx.STOP_WORDS)
    ends = f"(contains(x, '(') OR {clean} IN {stops} OR regexp_matches(x, '[.,;!?]$') OR {clean} = '')"
    kept = f"CASE WHEN contains(x, '(') THEN split_part(x, '(', 1) WHEN {clean} IN {stops} THEN '' WHEN regexp_matches(x, '[.,;!?]$') THEN left(x, length(x) - 1) WHEN {clean} = '' THEN '' ELSE x END"
    words = f"list_filter(string_split({rest}, ' '), lambda x: x <> '')"
    first = f"coalesce(list_position(list_transform({words}, lambda x: {ends}), true), len({words}))"
    return f"array_to_string(list_filter(list_transform({words}[1:{first}], lambda x: {kept}), lambda x: x <> ''), ' ')"


def _parts(name: str) -> str:
    """Struct of core and private of a name whose words stand between single spaces; null without a system word."""
    words, word = f"string_split(trim({name}), ' ')", "|".join(tx.SYSTEM_WORDS)
    at = f"list_position(list_transform({words}, lambda x: regexp_matches(lower(x), '{word}')), true)"
    return f"CASE WHEN {at} > 0 THEN {{'core': array_to_string({words}[1:{at}], ' '), 'private': CASE WHEN len({words}) - {at} >= 2 THEN array_to_string({words}[{at} + 1:], ' ') ELSE '' END}} END"


_UPPER, _ENDS = "^[А-ЯЁA-Z]{1,10}$", _list(("И", "В", "НА", "С", "ДЛЯ", "ПО"))
_LONG_NAME = "(?i)" + "|".join(f"(?:{p})" for p in extract.LONG_NAMES)
_HITS = " OR ".join(f"contains(lower(text), '{w}')" for w in extract.SYSTEM_HINTS)
_SYSTEM_TEXT = rf"""{_WORDS}, sw AS (SELECT item_id, list_filter(w, lambda x: length(x) > 1) AS w FROM bw), sp AS (SELECT item_id, w, unnest(range(1, len(w) - 2)) AS i FROM sw WHERE len(w) > 4),
b AS (SELECT item_id || '-' || (i - 1) AS doc_id, replace(replace(replace(replace({_case(SYSTEM_TEXTS, '(i - 1)')}, '{{u}}', upper(w[i])), '{{v}}', upper(w[i + 1])), '{{x}}', w[i + 2]), '{{y}}', w[i + 3]) AS text FROM sp)"""
_SYSTEMS = rf"""{_SYSTEM_TEXT}, {_TOKENS},
tt AS (SELECT *, lead(text) OVER o AS t1, lead(text, 2) OVER o AS t2, lead(text, 3) OVER o AS t3, lead(start) OVER o AS s1, lead(start, 2) OVER o AS s2, lead(start, 3) OVER o AS s3, lead("end") OVER o AS e1, lead("end", 2) OVER o AS e2, lead("end", 3) OVER o AS e3 FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
joined AS (SELECT doc_id, text AS v, start, "end" AS e, 0.9 AS c, 'complex_abbreviation' AS m, regexp_extract(text, '^({'|'.join(extract.JOINED)})', 1) AS core FROM t WHERE regexp_matches(text, '^(?:{'|'.join(extract.JOINED)})[А-ЯA-Z]{{2,}}$')),
l0 AS (SELECT doc_id, text, string_split_regex(text, '{_LONG_NAME}') AS s, regexp_extract_all(text, '{_LONG_NAME}') AS x FROM b), l1 AS (SELECT doc_id, text, s, x, unnest(range(1, len(x) + 1)) AS k FROM l0),
l2 AS (SELECT doc_id, text, x[k] AS m, CAST(list_sum(list_transform(s[1:k], lambda y: length(y))) + coalesce(list_sum(list_transform(x[1:k - 1], lambda y: length(y))), 0) AS INTEGER) AS start FROM l1),
l3 AS (SELECT *, substr(text, start + length(m) + 1) AS rest FROM l2), l4 AS (SELECT *, {_suffix('rest')} AS suffix FROM l3),
long AS (SELECT doc_id, CASE WHEN suffix <> '' THEN m || ' ' || suffix ELSE m END AS v, start, CAST(start + length(m) + CASE WHEN suffix <> '' THEN length(rest) - length(ltrim(rest)) + length(suffix) ELSE 0 END AS INTEGER) AS e, m AS name FROM l4),
phrase AS (SELECT doc_id, text || ' ' || t1 AS v, start, e1 AS e FROM tt WHERE upper(text) = 'ГИС' AND upper(t1) = 'ЖКХ' AND s1 > "end" AND NOT (t2 IS NOT NULL AND s2 > e1 AND regexp_matches(t2, '{_UPPER}')) AND NOT coalesce(s3 > e2 AND s2 > e1 AND regexp_matches(t3, '{_UPPER}'), false)),
h AS (SELECT *, upper(text) IN {_list(extract.SPACED)} AND s1 > "end" AND regexp_matches(t1, '{_UPPER}') AND t1 NOT IN {_ENDS} AS ok1, s2 > e1 AND regexp_matches(t2, '{_UPPER}') AND t2 NOT IN {_ENDS} AS ok2, s3 > e2 AND regexp_matches(t3, '{_UPPER}') AND t3 NOT IN {_ENDS} AS ok3 FROM tt),
sa AS (SELECT doc_id, text AS head, start, CASE WHEN ok2 AND ok3 THEN e3 WHEN ok2 THEN e2 ELSE e1 END AS e, CASE WHEN ok2 AND ok3 THEN t1 || ' ' || t2 || ' ' || t3 WHEN ok2 THEN t1 || ' ' || t2 ELSE t1 END AS rest FROM h WHERE ok1),
spaced AS (SELECT * FROM sa WHERE NOT EXISTS (SELECT 1 FROM sa o WHERE o.doc_id = sa.doc_id AND o.start < sa.start AND o.e > sa.start)),
one AS (SELECT doc_id, v, start, e, c, m, core, substr(v, length(core) + 1) AS private FROM joined),
two AS (SELECT doc_id, v, start, e, 0.8 AS c, 'information_system_regex' AS m, coalesce(p.core, name) AS core, coalesce(p.private, '') AS private FROM (SELECT *, {_parts('v')} AS p FROM long) q WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.doc_id = q.doc_id AND q.start < one.e AND q.e > one.start)),
three AS (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT doc_id, v, start, e, 0.85, 'simple_abbreviation', v, '' FROM phrase q WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, start, e FROM one UNION ALL SELECT doc_id, start, e FROM two) o WHERE o.doc_id = q.doc_id AND q.start < o.e AND q.e > o.start)),
four AS (SELECT * FROM three UNION ALL SELECT sp.doc_id, substr(b.text, sp.start + 1, sp.e - sp.start), sp.start, sp.e, 0.95, 'spaced_abbreviation', upper(head), rest FROM spaced sp JOIN b ON b.doc_id = sp.doc_id WHERE NOT EXISTS (SELECT 1 FROM three o WHERE o.doc_id = sp.doc_id AND sp.start >= o.start AND sp.start < o.e)),
found AS (SELECT * FROM four q WHERE NOT EXISTS (SELECT 1 FROM four o WHERE o.doc_id = q.doc_id AND o.c > q.c AND least(o.e, q.e) - greatest(o.start, q.start) >= 0.7 * least(o.e - o.start, q.e - q.start)))"""

QUERIES = {
    "q96_systems_in_texts": (q96, f"WITH {_SYSTEMS} SELECT doc_id, v AS original_value, start, e AS \"end\", CAST(c AS DOUBLE) AS confidence, m AS method, core, private FROM found"),
    "q97_organisations_refined": (q97, f"""WITH {_SYSTEMS}, hits AS (SELECT doc_id, text, {_HITS} AS hit FROM b) SELECT found.doc_id, 'information_system' AS category, v AS original_value, CAST(start + 5 AS INTEGER) AS start, CAST(e + 5 AS INTEGER) AS "end", m AS method FROM found JOIN hits ON hits.doc_id = found.doc_id WHERE hit
UNION ALL SELECT doc_id, 'organization', text, 5, CAST(length(text) + 5 AS INTEGER), 'spacy_ner' FROM hits WHERE NOT hit OR doc_id NOT IN (SELECT doc_id FROM found)"""),
    "q98_system_names_in_texts": (q98, f"""WITH {_SYSTEM_TEXT}, k AS (SELECT doc_id, text, {_parts('text')} AS p FROM b)
SELECT doc_id, 'information_system_' || CASE WHEN length(text) % 2 = 0 THEN 'phrase_matcher' ELSE 'token_matcher' END AS method, CASE WHEN length(text) % 2 = 0 THEN 0.85 ELSE 0.8 END::DOUBLE AS confidence, coalesce(p.core, text) AS core, coalesce(p.private, '') AS private,
  CASE WHEN p IS NULL THEN text WHEN p.private <> '' THEN p.core || ' [SYSTEM_ID]' ELSE p.core END AS anonymized, {_suffix('text')} AS suffix FROM k"""),
    "q92_contracts_in_texts": (q92, f"""WITH {_with_spans(_CONTRACTS, f"SELECT o_orderkey AS doc_id, 'b' AS block_id, replace(replace({_case(CONTRACT_TEXTS, 'o_orderkey')}, '{{a}}', {_number('(o_orderkey + o_custkey)', 'o_orderkey')}), '{{b}}', {_number('o_custkey', 'o_custkey')}) AS text FROM orders")},
g AS (SELECT spans.*, regexp_extract(original_value, pattern, 1) AS v FROM spans JOIN spans_r USING (description)), k AS (SELECT *, CAST(start + instr(original_value, v) - 1 AS INTEGER) AS s FROM g),
c AS (SELECT k.*, lower(substr(text, greatest(s - 50, 0) + 1, least(length(text), s + length(v) + 50) - greatest(s - 50, 0))) AS context FROM k JOIN b USING (doc_id))
SELECT doc_id, v AS original_value, s AS start, CAST(s + length(v) AS INTEGER) AS "end", confidence, method FROM c
WHERE length(v) >= 2 AND regexp_matches(upper(v), '{extract.CONTRACT_SHAPE}') AND (description NOT IN ('number_sign', 'word_number') OR contains(context, 'контракт') OR contains(context, 'договор'))"""),
    "q93_people_by_dictionary": (q93, f"""WITH {_PEOPLE}, p AS (SELECT *, string_split(replace(replace(original_value, 'А. Б.', 'А.Б.'), '  ', ' '), ' ') AS ws FROM people), s AS (SELECT DISTINCT unnest(w) AS word FROM bw WHERE item_id % 2 = 0), g AS (SELECT word FROM (SELECT DISTINCT unnest(w) AS word FROM bw WHERE item_id % 3 = 0) WHERE length(word) >= 4),
u AS (SELECT doc_id, unnest(ws) AS word FROM p), k AS (SELECT doc_id, count(*) AS n, bool_or(word IN (SELECT word FROM s)) AS s, bool_or(word IN (SELECT word FROM g) OR contains(word, '.')) AS g FROM u GROUP BY doc_id)
SELECT doc_id, category, original_value FROM p JOIN k USING (doc_id) WHERE category = 'other' OR (n = 1 AND (s OR g)) OR (n BETWEEN 2 AND 3 AND s AND g)"""),
    "q94_people_of_three_nouns": (q94, f"""WITH {_PEOPLE}, p AS (SELECT *, string_split(original_value, ' ') AS ws FROM people), a AS ({_ALL}), u AS (SELECT doc_id, unnest(ws) AS word FROM p WHERE len(ws) = 3),
k AS (SELECT doc_id, count(*) FILTER (length(word) % 4 <> 3) AS nouns, count(*) FILTER (length(word) % 4 <> 3 AND length(word) % 3 > 0) AS animate FROM u JOIN a USING (word) GROUP BY doc_id)
SELECT doc_id, category, original_value FROM p LEFT JOIN k USING (doc_id) WHERE category = 'other' OR (nouns = 3 AND animate >= 2)"""),
    "q95_names_extended": (q95, f"""WITH b AS ({DOCS}), {_TOKENS}, {_WORDS}, n0 AS (SELECT w, unnest(range(1, len(w) - 4, 6)) AS i FROM bw WHERE len(w) >= 6), names AS (SELECT DISTINCT w[i:i + 5] AS ws FROM n0),
h AS (SELECT x.doc_id, x.start, z."end", x.word || ' ' || y.word || ' ' || z.word AS short FROM t x JOIN t y ON y.doc_id = x.doc_id AND y.i = x.i + 1 AND y.start > x."end" JOIN t z ON z.doc_id = x.doc_id AND z.i = x.i + 2 AND z.start > y."end"),
k AS (SELECT h.*, ws, lower(substr(b.text, greatest(h.start - 100, 0) + 1, least(length(b.text), h."end" + 100) - greatest(h.start - 100, 0))) AS context, substr(b.text, h.start + 1, h."end" - h.start) AS value FROM h JOIN names ON array_to_string(ws[1:3], ' ') = short JOIN b ON b.doc_id = h.doc_id),
r AS (SELECT doc_id, start, value, array_to_string(ws, ' ') AS name, len(list_filter(ws, lambda x: contains(context, x))) / 6.0 AS share FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, start ORDER BY share DESC, name DESC) = 1)
SELECT doc_id, start, CASE WHEN share > 0.7 THEN name ELSE value END AS original_value, CASE WHEN share > 0.7 THEN 0.95 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN share > 0.7 THEN 'regex_extended' ELSE 'regex' END AS method, share > 0.7 AS extended FROM r"""),
}

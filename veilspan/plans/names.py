"""Registered queries of names, systems, contracts and strategies, each with its SQL.

The texts of these rules are Russian, and the tables hold none; so the queries make them from the customers' market segments (words in
capitals), one text a customer, and the SQL says what must be found there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import batching, caching, combine, extract, intervals, reports, strategies
from ..session import dealt, table
from ..sources import blocks as bl
from .catalog import (
    BLOCK,
    DOCS,
    LANGUAGE,
    LINES,
    OVERLAPPING,
    PACK,
    POLICY,
    REPLACED,
    Query,
    _docs,
    _greedy_sql,
    _lines,
    _ratio,
    _replacements,
    _resolved,
    _spans,
    _strict,
    _unnested,
    _with_spans,
)

S = "c_mktsegment"


def _customers(spark, d, text) -> DataFrame:
    """One block a customer with this text."""
    rows = dealt(table(spark, d, "customer").select("c_custkey", S)).select(F.col("c_custkey").alias("doc_id"), text.alias("text"))
    return bl.whole_blocks(rows)


def _by_key(*texts):
    """The text whose place is the customer's key modulo their number."""
    out = texts[-1]
    for i, t in enumerate(texts[:-1]):
        out = F.when(F.col("c_custkey") % len(texts) == i, t).otherwise(out)
    return out


def _text(before: str, after: str = ""):
    return F.concat(F.lit(before), F.col(S), F.lit(after))


SYSTEM_TEXTS = ("Данные АИС", " приняты"), ("это единая информационная система ", " содержит данные"), ("в ГИС ЖКХ и потом есть ", ""), ("и ЕИС ", " тут")


def q58(spark, d):
    found = extract.information_systems(_customers(spark, d, _by_key(*(_text(*t) for t in SYSTEM_TEXTS))))
    return found.select("doc_id", "original_value", "start", "end", "confidence", "method", "core", "private")


def q59(spark, d):
    texts = _customers(spark, d, _by_key(*(_text(*t) for t in SYSTEM_TEXTS), _text("просто ")))
    rows = texts.select(*BLOCK, F.lit("organization").alias("category"), F.col("text").alias("original_value"), F.lit(5).alias("start"), (F.length("text") + 5).alias("end"), F.lit(0.7).alias("confidence"), F.lit("spacy_ner").alias("method"), F.lit("").alias("description"), F.lit(0).alias("ord"))
    return extract.refine_systems(rows).select("doc_id", "category", "original_value", "start", "end", "method")


_N = "CAST(c_custkey % 9000 + 1 AS VARCHAR)"


def q60(spark, d):
    number = F.concat((F.col("c_custkey") % 9000 + 1).cast("string"), F.lit("/2024"))
    texts = _by_key(F.concat(F.lit("контракт № "), number, F.lit(" подписан")), F.concat(F.lit("номер "), number, F.lit(" без слова")), F.concat(F.lit("договор: номер "), number))
    found = extract.contract_numbers(_customers(spark, d, texts))
    return found.select("doc_id", "original_value", "start", "end", "confidence", "method")


def q61(spark, d):
    names = _customers(spark, d, _by_key(_text("Единая система "), _text("Портал ", " учета"), _text("")))
    parts = tx.system_parts(F.col("text"))
    rest = tx.system_suffix(F.concat(F.lit(" "), F.col("text"), F.lit(" (часть) x")))
    cut = tx.system_suffix(F.concat(F.lit(" новый "), F.col("text"), F.lit(", затем")))
    stop = tx.system_suffix(F.concat(F.lit("  "), F.col("text"), F.lit(" служит всем")))
    return names.select("doc_id", parts["core"].alias("core"), parts["private"].alias("private"), parts["anonymized"].alias("anonymized"), rest.alias("to_bracket"), cut.alias("to_mark"), stop.alias("to_stop"))


def q62(spark, d):
    docs = _customers(spark, d, _by_key(_text("see the Bureau of ", " Affairs Agency now"), _text("see the Bureau of ", " only")))
    names = table(spark, d, "customer").select(_text("Bureau of ", " Affairs Agency").alias("name")).distinct()
    short = F.regexp_extract("text", "Bureau of [A-Z]+", 0)
    rows = docs.select(*BLOCK, F.lit("government_org").alias("category"), short.alias("original_value"), F.lit(8).alias("start"), (F.length(short) + 8).alias("end"), F.lit(0.9).alias("confidence"), F.lit("regex").alias("method"), F.lit("").alias("description"), F.lit(0).alias("ord"))
    return extract.extend_partial(rows, docs, names).select("doc_id", "original_value", F.round("confidence", 6).alias("confidence"), "method", "extended_from")


def _people(spark, d, *values) -> DataFrame:
    rows = _customers(spark, d, _by_key(*values))
    category = F.when(F.col("doc_id") % 5 == 4, "other").otherwise(F.lit("person_name"))
    return rows.select(*BLOCK, category.alias("category"), F.col("text").alias("original_value"), F.lit(0).alias("ord"))


def q63(spark, d):
    surnames = table(spark, d, "customer").where(F.col(S) < "G").select(F.col(S).alias("word")).distinct()
    given = table(spark, d, "region").select(F.col("r_name").alias("word"))
    people = _people(spark, d, _text("", " ASIA"), _text("", " NOWHERE"), _text(""), _text("", " А.Б."))
    return extract.name_filter(people, surnames, given).select("doc_id", "category", "original_value")


def q64(spark, d):
    segments = table(spark, d, "customer").select(F.col(S).alias("form"), F.lit("NOUN").alias("pos"), (F.col(S) < "G").alias("animate"), F.lit(0).alias("ord")).distinct()
    regions = table(spark, d, "region").select(F.col("r_name").alias("form"), F.lit("NOUN").alias("pos"), (F.col("r_regionkey") % 2 == 0).alias("animate"), F.lit(0).alias("ord"))
    people = _people(spark, d, _text("", " AFRICA ASIA"), _text("", " AMERICA ASIA"), _text("", " ASIA"), _text("AFRICA ASIA ", "S"))
    return extract.three_nouns(people, segments.unionByName(regions)).select("doc_id", "category", "original_value")


def q65(spark, d):
    spans = _customers(spark, d, _by_key(_text("Портал ", " учета"), _text("")))
    method = F.when(F.col("doc_id") % 3 == 0, "phrase_matcher").otherwise(F.lit("token_matcher"))
    return extract.span_systems(spans.select("doc_id", F.col("text").alias("original_value"), method.alias("method"))).select("doc_id", "method", "confidence", "core", "private", "anonymized")


def q66(spark, d):
    lines = _lines(spark, d)
    odd = F.translate("text", "aeo", "\u00a0\u2009\u200b")
    variants = tx.text_variants(F.translate("text", "ß", "s"), [("[0-9]+", "#")])
    return lines.select("doc_id", "block_id", F.md5(tx.normalize_loose(odd)).alias("loose"), F.md5(tx.plain_spaces(F.translate("text", "aeo", "\u00a0\u00a0\u00a0"))).alias("plain"), F.size(variants).alias("n_variants"), F.md5(F.get(variants, F.lit(1))).alias("second"))


def q67(spark, d):
    """The strategies that suppress at their own thresholds, by name."""
    out = None
    for name in ("information_system", "contract_number"):
        rows = strategies.strategy(name)(_spans(spark, d, OVERLAPPING)).select(F.lit(name).alias("strategy"), "doc_id", "pos", "category", "start", "end", "method")
        out = rows if out is None else out.unionByName(rows)
    return out


def q68(spark, d):
    out = strategies.hybrid_government(_spans(spark, d, OVERLAPPING), ("^1",))
    return out.select("doc_id", "pos", "category", "start", "end", F.round("confidence", 6).alias("confidence"), "method", "organization_type")


def q69(spark, d):
    return extract.not_overlapping(_spans(spark, d, POLICY), _spans(spark, d, LANGUAGE)).select("doc_id", "category", "original_value", "start", "end")


def q71(spark, d):
    found = caching.once_for_similar(_lines(spark, d), lambda b: extract.scan(b, OVERLAPPING[:5]))
    return found.select("doc_id", "block_id", "similar_to", "category", "original_value", "start", "end")


def q73(spark, d):
    out = reports.replacement_report(_replacements(spark, d))
    return out.select("total", "high", "medium", "low", F.array_join(F.transform(F.map_entries("categories"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("categories"))


def q74(spark, d):
    events = table(spark, d, "events")
    kinds = events.select(F.col("event_type").alias("stage"), F.round("value", 2).alias("seconds"))
    names = [r.stage for r in kinds.select("stage").distinct().orderBy("stage").limit(2).collect()]
    return reports.run_metrics(kinds, names[0], names[-1], combine.union_all(_spans(spark, d, POLICY), _spans(spark, d, LANGUAGE)))


def q75(spark, d):
    rows = reports.profile_export(table(spark, d, "events"), "value", "event_type")
    parts = [F.get_json_object("record", f"$.{k}").cast("double" if k != "n" else "long").alias(k) for k in ("n", "total", "mean", "least", "most")]
    return rows.select("dimension", "name", *parts)


def q76(spark, d):
    marked = _lines(spark, d).withColumn("type", F.when(F.col("block_seq") == 0, "header").when(F.col("block_seq") % 3 == 2, "table_cell").otherwise(F.col("type")))
    out = bl.walk(marked)
    return out.select("doc_id", *(F.md5(F.array_join(k, "\n")).alias(k) for k in ("paragraphs", "tables", "headers", "footers")))


# ---- SQL


def _sorted_kept(order: str) -> str:
    return f"""WITH {_greedy_sql('-confidence, ord', _ratio('k', 'x[1]') + ' >= 0.8')},
flat AS (SELECT doc_id, i, l[i] AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM kept))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {order}, i) - 1 AS INTEGER) AS pos, s.category AS category, s.start AS start, s."end" AS "end", round(s.confidence, 6) AS confidence, s.method AS method FROM flat"""


_LONG = "единая информационная система "
_SYSTEMS = f"""s AS (SELECT c_custkey AS doc_id, c_custkey % {{n}} AS k, {S} AS w FROM customer),
found AS (SELECT doc_id, w, k, CASE k WHEN 0 THEN 'АИС' || w WHEN 1 THEN '{_LONG}' || w WHEN 2 THEN 'ГИС ЖКХ' ELSE 'ЕИС ' || w END AS original_value, CASE k WHEN 0 THEN 7 WHEN 1 THEN 4 ELSE 2 END AS place,
  CASE k WHEN 0 THEN 0.9 WHEN 1 THEN 0.8 WHEN 2 THEN 0.85 ELSE 0.95 END AS confidence, CASE k WHEN 0 THEN 'complex_abbreviation' WHEN 1 THEN 'information_system_regex' WHEN 2 THEN 'simple_abbreviation' ELSE 'spaced_abbreviation' END AS method,
  CASE k WHEN 0 THEN 'АИС' WHEN 1 THEN '{_LONG.strip()}' WHEN 2 THEN 'ГИС ЖКХ' ELSE 'ЕИС' END AS core, CASE WHEN k IN (0, 3) THEN w ELSE '' END AS private FROM s WHERE k < 4)"""

_HYBRID = f"""{_with_spans(OVERLAPPING)}, u AS (SELECT *, method <> 'spacy_ner' AS is_phrase FROM spans WHERE method = 'phrase_matcher' OR (method = 'spacy_ner' AND NOT regexp_matches(original_value, '^1'))),
raised AS (SELECT * REPLACE (CASE WHEN is_phrase THEN 0.98 ELSE confidence END AS confidence) FROM u),
lists0 AS (SELECT doc_id, list_transform(list({PACK} ORDER BY NOT is_phrase, ord), lambda x: [x]) AS l FROM raised GROUP BY doc_id),
kept0 AS (SELECT doc_id, list_reduce(l, lambda acc, x: CASE WHEN x[1].method = 'spacy_ner' AND len(list_filter(acc, lambda k: {_ratio('k', 'x[1]')} >= 0.5)) > 0 THEN acc ELSE list_concat(acc, x) END) AS l FROM lists0),
flat AS (SELECT doc_id, i, l[i] AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM kept0)),
lists AS (SELECT doc_id, list_transform(list(s ORDER BY s.start, i), lambda x: [[x]]) AS l FROM flat GROUP BY doc_id),
groups AS (SELECT doc_id, list_reduce(l, lambda acc, x: CASE WHEN coalesce(list_position(list_transform(acc, lambda g: {_ratio('g[1]', 'x[1][1]')} >= 0.3), true), 0) > 0
  THEN list_transform(acc, lambda g, i: CASE WHEN i = list_position(list_transform(acc, lambda h: {_ratio('h[1]', 'x[1][1]')} >= 0.3), true) THEN list_concat(g, x[1]) ELSE g END)
  ELSE list_concat(acc, x) END) AS g FROM lists),
rank AS (SELECT doc_id, list_transform(g, lambda h: list_filter(h, lambda s: CASE WHEN s.method = 'spacy_ner' THEN 2 + s.confidence ELSE 3 + s.confidence + 0.1 END = list_max(list_transform(h, lambda t: CASE WHEN t.method = 'spacy_ner' THEN 2 + t.confidence ELSE 3 + t.confidence + 0.1 END)))[1]) AS l FROM groups)"""

_SIMILAR = f"""l AS ({LINES}), k AS (SELECT *, md5(trim(lower(substr(text, 1, 50)))) AS p FROM l), one AS (SELECT p, arg_min({{'d': doc_id, 'b': block_id, 't': text}}, {{'d': doc_id, 'b': block_id}}) AS o FROM k GROUP BY p)"""
_SPACES = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

QUERIES: dict[str, tuple[Query, str | None]] = {
    "q57_best_confidence": (_resolved(intervals.best_confidence), _sorted_kept('-s.confidence, s.start - s."end"')),
    "q57_combine_all": (_resolved(intervals.combine_all), _sorted_kept("s.start")),
    "q58_information_systems": (q58, f"WITH {_SYSTEMS.format(n=4)} SELECT doc_id, original_value, CAST(place AS INTEGER) AS start, CAST(place + length(original_value) AS INTEGER) AS \"end\", CAST(confidence AS DOUBLE) AS confidence, method, core, private FROM found"),
    "q59_refined_systems": (q59, f"""WITH {_SYSTEMS.format(n=5)} SELECT doc_id, 'information_system' AS category, original_value, CAST(place + 5 AS INTEGER) AS start, CAST(place + 5 + length(original_value) AS INTEGER) AS "end", method FROM found
UNION ALL SELECT doc_id, 'organization', 'просто ' || w, 5, CAST(12 + length(w) AS INTEGER), 'spacy_ner' FROM s WHERE k = 4"""),
    "q60_contract_numbers": (q60, f"""WITH k AS (SELECT c_custkey AS doc_id, {_N} || '/2024' AS v, c_custkey % 3 AS k FROM customer), r AS (SELECT * FROM (VALUES (0, 11, 0.95, 'government_contract_number'), (0, 11, 0.8, 'number_sign'), (2, 15, 0.85, 'word_number')) t(k, place, c, m))
SELECT doc_id, v AS original_value, CAST(place AS INTEGER) AS start, CAST(place + length(v) AS INTEGER) AS "end", CAST(c AS DOUBLE) AS confidence, 'contract_regex_' || m AS method FROM k JOIN r USING (k)"""),
    "q61_system_names": (q61, f"""WITH k AS (SELECT c_custkey AS doc_id, c_custkey % 3 AS k, {S} AS w, CASE c_custkey % 3 WHEN 0 THEN 'Единая система ' || {S} WHEN 1 THEN 'Портал ' || {S} || ' учета' ELSE {S} END AS t FROM customer)
SELECT doc_id, CASE k WHEN 0 THEN 'Единая система' WHEN 1 THEN 'Портал' END AS core, CASE k WHEN 0 THEN '' WHEN 1 THEN w || ' учета' END AS private, CASE k WHEN 0 THEN 'Единая система' WHEN 1 THEN 'Портал [SYSTEM_ID]' END AS anonymized, t AS to_bracket, 'новый ' || t AS to_mark, t AS to_stop FROM k"""),
    "q62_extended_names": (q62, f"""SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'Bureau of ' || {S} || ' Affairs Agency' ELSE 'Bureau of ' || {S} END AS original_value, CASE WHEN c_custkey % 2 = 0 THEN 0.95 ELSE 0.9 END::DOUBLE AS confidence,
  CASE WHEN c_custkey % 2 = 0 THEN 'regex_extended' ELSE 'regex' END AS method, CASE WHEN c_custkey % 2 = 0 THEN 'Bureau of ' || {S} END AS extended_from FROM customer"""),
    "q63_name_filter": (q63, f"""WITH k AS (SELECT c_custkey AS doc_id, c_custkey % 4 AS k, {S} AS w, CASE WHEN c_custkey % 5 = 4 THEN 'other' ELSE 'person_name' END AS category FROM customer)
SELECT doc_id, category, w || CASE k WHEN 0 THEN ' ASIA' WHEN 1 THEN ' NOWHERE' WHEN 2 THEN '' ELSE ' А.Б.' END AS original_value FROM k WHERE category = 'other' OR (w < 'G' AND k <> 1)"""),
    "q64_three_nouns": (q64, f"""WITH k AS (SELECT c_custkey AS doc_id, c_custkey % 4 AS k, {S} AS w, CASE WHEN c_custkey % 5 = 4 THEN 'other' ELSE 'person_name' END AS category FROM customer),
a AS (SELECT r_name AS n, CAST(r_regionkey % 2 = 0 AS INTEGER) AS y FROM region), z AS (SELECT (SELECT y FROM a WHERE n = 'AFRICA') AS africa, (SELECT y FROM a WHERE n = 'AMERICA') AS america, (SELECT y FROM a WHERE n = 'ASIA') AS asia)
SELECT doc_id, category, CASE k WHEN 0 THEN w || ' AFRICA ASIA' WHEN 1 THEN w || ' AMERICA ASIA' WHEN 2 THEN w || ' ASIA' ELSE 'AFRICA ASIA ' || w || 'S' END AS original_value FROM k, z
WHERE category = 'other' OR (k = 0 AND CAST(w < 'G' AS INTEGER) + africa + asia >= 2) OR (k = 1 AND CAST(w < 'G' AS INTEGER) + america + asia >= 2)"""),
    "q65_span_systems": (q65, f"""SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN 'information_system_phrase_matcher' ELSE 'information_system_token_matcher' END AS method, CASE WHEN c_custkey % 3 = 0 THEN 0.85 ELSE 0.8 END::DOUBLE AS confidence,
  CASE WHEN c_custkey % 2 = 0 THEN 'Портал' ELSE {S} END AS core, CASE WHEN c_custkey % 2 = 0 THEN {S} || ' учета' ELSE '' END AS private, CASE WHEN c_custkey % 2 = 0 THEN 'Портал [SYSTEM_ID]' ELSE {S} END AS anonymized FROM customer"""),
    "q66_text_forms": (q66, f"""WITH b AS ({LINES}), v AS (SELECT doc_id, block_id, text, translate(text, 'ß', 's') AS t, regexp_replace(translate(text, 'ß', 's'), '[0-9]+', '#', 'g') AS n FROM b)
SELECT doc_id, block_id, md5(trim(regexp_replace(translate(text, 'aeo', chr(160) || chr(8201) || chr(8203)), '{_SPACES}', ' ', 'g'))) AS loose, md5(translate(text, 'aeo', '   ')) AS plain,
  CAST(len(list_distinct([t, n, upper(t), upper(n)])) AS INTEGER) AS n_variants, md5(CASE WHEN n <> t THEN n WHEN upper(t) <> t THEN upper(t) END) AS second FROM v"""),
    "q67_strategies": (q67, f"""SELECT 'information_system' AS strategy, doc_id, pos, category, start, "end", method FROM (WITH {_greedy_sql('-confidence, ord', _ratio('k', 'x[1]') + ' >= 0.6')} {_unnested('kept')})
UNION ALL SELECT 'contract_number', doc_id, pos, category, start, "end", method FROM (WITH {_greedy_sql('-confidence, ord', _ratio('k', 'x[1]') + ' >= 0.7')} {_unnested('kept')})"""),
    "q68_hybrid_government": (q68, f"""WITH {_HYBRID} SELECT doc_id, pos, 'government_org' AS category, start, "end", confidence, 'hybrid_' || method AS method, CASE WHEN method = 'spacy_ner' THEN 'unknown' ELSE 'government' END AS organization_type FROM ({_unnested('rank')})"""),
    "q69_occupied_ranges": (q69, f"""WITH {_with_spans(POLICY, DOCS, 'p')}, {_with_spans(LANGUAGE, DOCS, 'l').split('), ', 1)[1]} SELECT doc_id, category, original_value, start, "end" FROM p WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.doc_id = p.doc_id AND {_strict('l', 'p')})"""),
    "q70_batch_sizes": (lambda s, d: batching.batch_sizes(_lines(s, d)), f"""WITH b AS ({LINES}), k AS (SELECT doc_id, count(*) AS blocks, avg(length(text)) AS m, count(DISTINCT text) AS u FROM b GROUP BY doc_id), z AS (SELECT *, CASE WHEN blocks < 100 THEN 50 WHEN blocks < 300 THEN 75 WHEN blocks < 600 THEN 100 WHEN blocks < 1000 THEN 175 ELSE 200 END AS n FROM k)
SELECT doc_id, blocks, round(m, 4) AS mean_length, CAST(CASE WHEN m > 500 THEN greatest(50, n // 2) WHEN m < 50 THEN least(200, floor(n * 1.2)) ELSE n END AS INTEGER) AS batch_size, u >= 200 AS parallel FROM z"""),
    "q71_similar_texts": (q71, f"""WITH {_SIMILAR}, {_with_spans(OVERLAPPING[:5], "SELECT p AS doc_id, 'x' AS block_id, o.t AS text FROM one")}
SELECT k.doc_id, k.block_id, concat_ws('/', o.d, o.b) AS similar_to, category, original_value, start, "end" FROM k JOIN one USING (p) JOIN spans ON spans.doc_id = p"""),
    "q72_cache_statistics": (lambda s, d: caching.cache_statistics(_lines(s, d)), f"WITH b AS ({LINES}), k AS (SELECT count(*) AS a, count(DISTINCT text) AS u FROM b) SELECT a AS requests, u AS misses, a - u AS hits, round((a - u) * 100.0 / a, 2) AS hit_rate, u AS size FROM k"),
    "q73_replacement_report": (q73, f"""WITH {REPLACED}, c AS (SELECT category, count(*) AS n FROM marked GROUP BY category)
SELECT (SELECT count(*) FROM marked) AS total, (SELECT count(*) FROM marked WHERE confidence > 0.8) AS high, (SELECT count(*) FROM marked WHERE confidence > 0.5 AND confidence <= 0.8) AS medium, (SELECT count(*) FROM marked WHERE confidence <= 0.5) AS low,
  (SELECT string_agg(category || ':' || n, ',' ORDER BY category) FROM c) AS categories"""),
    "q74_run_metrics": (q74, f"""WITH {_with_spans(POLICY, DOCS, 'p')}, {_with_spans(LANGUAGE, DOCS, 'l').split('), ', 1)[1]}, e AS (SELECT event_type AS k, round(value, 2) AS v FROM events), n AS (SELECT DISTINCT k FROM e ORDER BY k LIMIT 2),
t AS (SELECT sum(v) AS a, sum(v) FILTER (k = (SELECT min(k) FROM n)) AS p, sum(v) FILTER (k = (SELECT max(k) FROM n)) AS w FROM e)
SELECT round(a, 2) AS total_seconds, round(p, 2) AS parse_seconds, round(w, 2) AS work_seconds, round(p / w, 1) AS ratio, (SELECT count(*) FROM p) AS rule_items, (SELECT count(*) FROM l) AS language_items FROM t"""),
    "q75_profile_export": (q75, "SELECT 'event_type' AS dimension, event_type AS name, count(value) AS n, round(sum(value), 3) AS total, round(avg(value), 3) AS mean, round(min(value), 3) AS least, round(max(value), 3) AS most FROM events WHERE event_type IS NOT NULL GROUP BY event_type"),
    "q76_walk": (q76, f"""WITH b AS ({LINES}) SELECT doc_id, md5(coalesce(string_agg(text, chr(10) ORDER BY block_seq) FILTER (block_seq > 0 AND block_seq % 3 <> 2), '')) AS paragraphs, md5(coalesce(string_agg(text, chr(10) ORDER BY block_seq) FILTER (block_seq % 3 = 2), '')) AS tables,
  md5(coalesce(string_agg(text, chr(10) ORDER BY block_seq) FILTER (block_seq = 0), '')) AS headers, md5('') AS footers FROM b GROUP BY doc_id"""),
}

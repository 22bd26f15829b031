"""Queries of tokens, forms, dictionaries and rule tables, with their SQL.

The tables hold no Russian, so forms, dictionaries and rules are made from words of the benchmark, and looked for in all documents. The SQL cuts tokens and
joins them by place; it knows none of the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dictionary, intervals, morphology, proximity, rule_index, strategies, tokens
from ..session import spread, table
from ..sources import blocks as bl
from ..sources.rules import ASCII_RULES, Rule
from .catalog import OVERLAPPING, QUERIES as FIRST, _docs, _spans, _with_spans
from .names import QUERIES as NAMES

LEGAL = ("the", "of", "and", "in", "to", "that")
LONG = 9


def _documents(spark, d, text) -> DataFrame:
    return bl.whole_blocks(spread(table(spark, d, "documents")).select("doc_id", text.alias("text")))


def _made_texts():
    """By document: every word with a capital; short words cut to initials; commas and full stops turned into quotes."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z., \n]", "")
    capital = F.initcap(plain)
    k = F.col("doc_id") % 3
    return F.when(k == 0, capital).when(k == 1, F.regexp_replace(capital, "([A-Z])[a-z]{1,3} ", "$1. ")).otherwise(F.replace(F.replace(plain, F.lit(","), F.lit(' "')), F.lit("."), F.lit('" ')))


def _benchmark_words(spark, d) -> DataFrame:
    rows = table(spark, d, "benchmark").where("text IS NOT NULL").select("item_id", F.array_remove(F.split(F.lower("text"), "[^a-z]+"), "").alias("w"))
    return rows


def _forms(spark, d) -> DataFrame:
    """form, lemma, tag: of each benchmark word, a made lemma and a tag."""
    rows = _benchmark_words(spark, d).select(F.explode("w").alias("form")).distinct()
    n = F.length("form")
    lemma = F.when(n > 4, F.concat(F.substring("form", F.lit(1), n - 2), F.lit("o"))).otherwise(F.col("form"))
    return rows.select("form", lemma.alias("lemma"), F.when(n % 2 == 0, "PROPN").otherwise("NOUN").alias("tag"))


def q84(spark, d):
    blocks = _documents(spark, d, _made_texts())
    rows = tokens.exploded(blocks)
    tags = _forms(spark, d).select(F.col("form").alias("word"), "tag")
    found = tokens.matched(morphology.with_tags(rows, tags), tokens.patterns(LEGAL))
    return found.select("doc_id", F.col("description").alias("pattern"), "category", "original_value", "start", "end")


def q85(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("word <> ''")
    forms = _forms(spark, d)
    return morphology.resolve(words, forms, morphology.learn_endings(forms))


def _phrases(spark, d) -> DataFrame:
    """phrase, category, confidence: all runs of two and three words of the benchmark, and its long words."""
    rows = _benchmark_words(spark, d)
    run = lambda n: F.transform("w", lambda x, i: F.when(i + n <= F.size("w"), F.array_join(F.slice("w", i + 1, F.lit(n)), " ")))
    out = None
    for n in (1, 2, 3):
        part = rows.select(F.explode(run(n)).alias("phrase")).where("phrase IS NOT NULL").distinct()
        part = (part.where(F.length("phrase") >= LONG) if n == 1 else part).withColumns({"category": F.lit(f"words_{n}"), "confidence": F.lit(0.7)})
        out = part if out is None else out.unionByName(part)
    return out


def q86(spark, d):
    blocks = _documents(spark, d, F.col("text"))
    every = dictionary.match(blocks, _phrases(spark, d)).select("doc_id", "category", F.col("description").alias("phrase"), "start", "end")
    return every


def _rules(spark, d) -> DataFrame:
    """A table of rules from the benchmark: two words in a row, a beginning, and, for some items, two words of which either will do."""
    w = lambda i: F.get("w", F.lit(i))
    rows = _benchmark_words(spark, d).where(F.size("w") > 5)
    kinds = {
        "pair": F.concat(F.lit(r"\b"), w(0), F.lit(r"\s+"), w(1), F.lit(r"\b")),
        "start": F.concat(F.lit(r"\b"), w(2), F.lit("[a-z]+")),
        "either": F.when(F.col("item_id") % 20 == 0, F.concat(F.lit(r"\b(?:"), w(3), F.lit("|"), w(4), F.lit(r")\s+"), F.lit("(?:of|and)"), F.lit(r"\b"))),
    }
    out = F.array(*(F.struct(F.concat_ws(":", "item_id", F.lit(k)).alias("rule"), F.lit(k).alias("category"), p.alias("pattern")) for k, p in kinds.items()))
    rows = rows.select(F.explode(out).alias("r")).select("r.*").where("pattern IS NOT NULL").distinct()
    return rows.select("*", F.col("rule").alias("description"), F.lit(0.8).alias("confidence"), F.lit("regex").alias("method"))


def q87(spark, d):
    blocks = _documents(spark, d, F.regexp_replace("text", r"[^\x00-\x7F]", ""))
    return rule_index.scan(blocks, _rules(spark, d)).select("doc_id", "rule", "category", "original_value", "start", "end")


def q88(spark, d):
    ends = F.element_at(F.array(*map(F.lit, ("(", "[a-", "", "+", "|"))), (F.col("p_size") % 5 + 1).cast("int"))
    pattern = F.when(F.col("p_partkey") % 7 != 0, F.concat("p_brand", ends))
    rules = rule_index.validated(table(spark, d, "part").select(F.col("p_type").alias("category"), pattern.alias("pattern")))
    return rules.groupBy("category", "valid", "reason").agg(F.count(F.lit(1)).alias("n"))


CUES = {"ip": ("the", "of"), "card_number": ("and", "de", "die"), "phone": ("that",)}


def q89(spark, d):
    words = spark.createDataFrame([(w, c, 0.7) for c, ws in CUES.items() for w in ws], "phrase string, category string, confidence double")
    cues = dictionary.match(_docs(spark, d), words)
    return proximity.with_cues(_spans(spark, d), cues, 40).select("doc_id", "category", "start", "end", "cue", "cue_start", "distance")


def q90(spark, d):
    """q10 by rounds, whatever the length of the blocks."""
    out = intervals.suppressed(_spans(spark, d, OVERLAPPING), long=0)
    return out.select("doc_id", "pos", "category", "start", "end", F.round("confidence", 6).alias("confidence"), "method")


def q91(spark, d):
    """Every strategy by its name."""
    out, found = None, _spans(spark, d, OVERLAPPING)
    for name in sorted(strategies.STRATEGIES):
        rows = strategies.strategy(name)(found).select(F.lit(name).alias("strategy"), "doc_id", "pos", "category", "start", "end", "method")
        out = rows if out is None else out.unionByName(rows)
    return out


def _tagged_forms(spark, d) -> DataFrame:
    """_forms() with the tags of names too."""
    n = F.length("form")
    return _forms(spark, d).withColumn("tag", F.when(n % 5 == 0, "Surn").when(n % 2 == 0, "PROPN").otherwise("NOUN"))


RULES = (ASCII_RULES[1], Rule("card_number", r"\b[0-9]{16}\b", "card", 0.9, context_required=False, needs="[0-9]"))
NEAR_RULES, NEAR_NAMES = {"ip": ("the", "of", "die")}, ("tion", "und")


def q99(spark, d):
    docs = _docs(spark, d)
    resolved = _tagged_forms(spark, d).select(F.col("form").alias("word"), "tag")
    phrases = _phrases(spark, d).where("category = 'words_3'")
    found = strategies.every_extractor(docs, RULES, NEAR_RULES, phrases, resolved, NEAR_NAMES, LEGAL)
    return found.select("doc_id", "category", "original_value", "start", "end", "method", F.round("confidence", 6).alias("confidence"))


_BY_NAME = {
    "best_confidence": NAMES["q57_best_confidence"][1], "combine_all": NAMES["q57_combine_all"][1], "first_match": FIRST["q15_first_match"][1], "weighted_average": FIRST["q16_weighted_average"][1],
    "hybrid_government": NAMES["q68_hybrid_government"][1].replace("NOT regexp_matches(original_value, '^1')", "true"),
}


#: b (doc_id, text) -> t (doc_id, i, text, word, start, "end"): the tokens of texts in which letters, marks and ASCII white space stand.
_TOKENS = r"""parts AS (SELECT doc_id, string_split(regexp_replace(text, '\p{Lu}\.|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]', chr(57344) || '\0' || chr(57344), 'g'), chr(57344)) AS p FROM b),
u AS (SELECT doc_id, unnest(p) AS x, unnest(range(len(p))) AS k FROM parts),
c AS (SELECT doc_id, x, k, coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u),
t AS (SELECT doc_id, (k - 1) // 2 AS i, x AS text, lower(x) AS word, CAST(start AS INTEGER) AS start, CAST(start + length(x) AS INTEGER) AS "end" FROM c WHERE k % 2 = 1)"""
_WORDS = "bw AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL)"
_FORMS = f"{_WORDS}, f AS (SELECT DISTINCT unnest(w) AS form FROM bw), forms AS (SELECT form, CASE WHEN length(form) > 4 THEN left(form, length(form) - 2) || 'o' ELSE form END AS lemma, CASE WHEN length(form) % 2 = 0 THEN 'PROPN' ELSE 'NOUN' END AS tag FROM f)"
_LEGAL = ", ".join(f"'{w}'" for w in LEGAL)
_SPAN = "substr(b.text, {first}.start + 1, {last}.\"end\" - {first}.start) AS original_value, {first}.start, {last}.\"end\" FROM"

_NAMED = f"""g AS (SELECT t.*, tag, regexp_matches(t.text, '^\\p{{Lu}}[^\\p{{Lu}}]*$') AND coalesce(tag = 'PROPN', false) AS titled, regexp_matches(t.text, '^\\p{{Lu}}\\.$') AS initial, coalesce(tag = 'PROPN', false) AND length(t.text) > 2 AS named,
  min(CASE WHEN tag IS NULL OR tag NOT IN ('NOUN', 'PROPN') THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop,
  bool_or({" OR ".join(f"contains(word, '{w}')" for w in NEAR_NAMES)}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM t LEFT JOIN forms2 ON form = word),
m AS (SELECT x.doc_id, 'person_name' AS category, x.start, z."end" FROM g x JOIN g y ON y.doc_id = x.doc_id AND y.i = x.i + 1 JOIN g z ON z.doc_id = x.doc_id AND z.i = x.i + 2 WHERE (x.titled AND y.titled AND z.titled) OR (x.initial AND y.initial AND z.named) OR (x.named AND y.initial AND z.initial)
  UNION ALL SELECT x.doc_id, 'organization', x.start, z."end" FROM g x JOIN g y ON y.doc_id = x.doc_id AND y.i = x.i + 1 JOIN g z ON z.doc_id = x.doc_id AND z.i = x.stop WHERE x.word IN ({_LEGAL}) AND y.text IN ('"', '«', chr(39)) AND z.text IN ('"', '»', chr(39)) AND z.i > x.i + 2)"""

QUERIES = {
    "q84_token_patterns": (q84, rf"""WITH s AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z., \n]', '', 'g') AS p FROM documents),
s2 AS (SELECT doc_id, p, array_to_string(list_transform(string_split(p, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS cap FROM s),
b AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN cap WHEN 1 THEN regexp_replace(cap, '([A-Z])[a-z]{{1,3}} ', '\1. ', 'g') ELSE replace(replace(p, ',', ' "'), '.', '" ') END AS text FROM s2),
{_TOKENS}, {_FORMS}, g AS (SELECT t.*, tag, regexp_matches(t.text, '^[A-Z][^A-Z]*$') AND coalesce(tag = 'PROPN', false) AS titled, regexp_matches(t.text, '^[A-Z]\.$') AS initial, coalesce(tag = 'PROPN', false) AND length(t.text) > 2 AS named,
  min(CASE WHEN tag IS NULL THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop FROM t LEFT JOIN forms ON form = word)
SELECT x.doc_id, CASE WHEN x.titled AND y.titled AND z.titled THEN 'full_name' WHEN x.initial THEN 'initials_lastname' ELSE 'lastname_initials' END AS pattern, 'person_name' AS category, {_SPAN.format(first='x', last='z')} g x JOIN g y ON y.doc_id = x.doc_id AND y.i = x.i + 1 JOIN g z ON z.doc_id = x.doc_id AND z.i = x.i + 2 JOIN b ON b.doc_id = x.doc_id
WHERE (x.titled AND y.titled AND z.titled) OR (x.initial AND y.initial AND z.named) OR (x.named AND y.initial AND z.initial)
UNION ALL SELECT x.doc_id, 'quoted_organization', 'organization', {_SPAN.format(first='x', last='z')} g x JOIN g y ON y.doc_id = x.doc_id AND y.i = x.i + 1 JOIN g z ON z.doc_id = x.doc_id AND z.i = x.stop JOIN b ON b.doc_id = x.doc_id
WHERE x.word IN ({_LEGAL}) AND y.text = '"' AND z.text = '"' AND z.i > x.i + 2"""),
    "q85_word_forms": (q85, rf"""WITH {_FORMS}, e0 AS (SELECT right(form, k) AS ending, substr(lemma, length(form) - k + 1) AS lemma_ending, tag FROM forms, (SELECT unnest(range(1, {morphology.LONGEST + 1})) AS k) WHERE length(form) > 2 AND k <= length(form) - 2 AND starts_with(lemma, left(form, length(form) - k))),
e1 AS (SELECT ending, lemma_ending, tag, count(*) AS n FROM e0 GROUP BY ALL), e AS (SELECT ending, lemma_ending, tag FROM e1 QUALIFY row_number() OVER (PARTITION BY ending ORDER BY n DESC, lemma_ending, tag) = 1),
w AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents), v AS (SELECT word FROM w WHERE word <> ''), un AS (SELECT word FROM v WHERE word NOT IN (SELECT form FROM forms)),
hit AS (SELECT word, ending, lemma_ending, tag FROM (SELECT word, unnest(range(1, length(word) - 1)) AS k FROM un) x JOIN e ON e.ending = right(word, k) QUALIFY row_number() OVER (PARTITION BY word ORDER BY length(ending) DESC) = 1)
SELECT word, lemma, tag, NULL::VARCHAR AS ending FROM v JOIN forms ON form = word UNION ALL SELECT un.word, left(un.word, length(un.word) - length(ending)) || lemma_ending, tag, ending FROM un LEFT JOIN hit ON hit.word = un.word"""),
    "q86_dictionary": (q86, rf"""WITH b AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {_TOKENS}, {_WORDS},
g AS (SELECT doc_id, start, "end", word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3, lead(start) OVER o AS s2, lead(start, 2) OVER o AS s3, lead("end") OVER o AS e2, lead("end", 2) OVER o AS e3 FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT DISTINCT 1 AS n, x AS phrase FROM (SELECT unnest(w) AS x FROM bw) WHERE length(x) >= {LONG} UNION ALL SELECT DISTINCT 2, x FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS x FROM bw) UNION ALL SELECT DISTINCT 3, x FROM (SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM bw WHERE len(w) > 2)),
k AS (SELECT doc_id, 1 AS n, word AS phrase, start, "end" FROM g UNION ALL SELECT doc_id, 2, word || ' ' || w2, start, e2 FROM g WHERE s2 > "end" UNION ALL SELECT doc_id, 3, word || ' ' || w2 || ' ' || w3, start, e3 FROM g WHERE s2 > "end" AND s3 > e2)
SELECT doc_id, 'words_' || n AS category, phrase, start, "end" FROM k JOIN p USING (n, phrase)"""),
    "q87_rule_table": (q87, rf"""WITH b AS (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS text FROM documents), {_WORDS},
r AS (SELECT DISTINCT item_id || ':pair' AS rule, 'pair' AS category, '\b' || w[1] || '\s+' || w[2] || '\b' AS pattern FROM bw WHERE len(w) > 5 UNION SELECT item_id || ':start', 'start', '\b' || w[3] || '[a-z]+' FROM bw WHERE len(w) > 5
  UNION SELECT item_id || ':either', 'either', '\b(?:' || w[4] || '|' || w[5] || ')\s+(?:of|and)\b' FROM bw WHERE len(w) > 5 AND item_id % 20 = 0),
parts AS (SELECT doc_id, rule, category, string_split(regexp_replace(text, pattern, chr(57344) || '\0' || chr(57344), 'g'), chr(57344)) AS p FROM b, r WHERE regexp_matches(text, pattern)),
u AS (SELECT doc_id, rule, category, unnest(p) AS x, unnest(range(len(p))) AS k FROM parts),
c AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY doc_id, rule ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u)
SELECT doc_id, rule, category, x AS original_value, CAST(start AS INTEGER) AS start, CAST(start + length(x) AS INTEGER) AS "end" FROM c WHERE k % 2 = 1"""),
    "q89_context_matches": (q89, rf"""WITH {_with_spans()}, {_TOKENS}, w(category, word) AS (VALUES {", ".join(f"('{c}', '{x}')" for c, xs in CUES.items() for x in xs)}), cue AS (SELECT doc_id, category, text AS cue, start, "end" FROM t JOIN w USING (word)),
n AS (SELECT s.doc_id, s.category, s.ord, s.start, s."end", arg_max(cue.start, cue."end") FILTER (cue.start <= s.start) AS b, arg_min(cue.start, cue.start) FILTER (cue.start >= s.start) AS a FROM spans s JOIN cue USING (doc_id, category) GROUP BY ALL),
k AS (SELECT n.*, cue, cue.start AS cue_start, greatest(0, n.start - cue."end", cue.start - n."end") AS distance, CASE WHEN cue.start = b THEN 0 ELSE 1 END AS side FROM n JOIN cue ON cue.doc_id = n.doc_id AND cue.category = n.category AND (cue.start = b OR cue.start = a))
SELECT doc_id, category, start, "end", cue, cue_start, distance FROM k WHERE distance <= 40 QUALIFY row_number() OVER (PARTITION BY doc_id, category, ord ORDER BY distance, side) = 1"""),
    "q99_every_extractor": (q99, rf"""WITH {_with_spans(RULES)}, {_TOKENS}, {_FORMS}, forms2 AS (SELECT form, CASE WHEN length(form) % 5 = 0 THEN 'Surn' WHEN length(form) % 2 = 0 THEN 'PROPN' ELSE 'NOUN' END AS tag FROM forms), {_NAMED},
r AS (SELECT spans.*, lower(substr(text, greatest(start - 50, 0) + 1, least(length(text), "end" + 50) - greatest(start - 50, 0))) AS context FROM spans JOIN b USING (doc_id)),
w3 AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS phrase FROM bw WHERE len(w) > 2),
k AS (SELECT doc_id, start, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS phrase, lead(start) OVER o > "end" AND lead(start, 2) OVER o > lead("end") OVER o AS spaced, lead("end", 2) OVER o AS e FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
every AS (SELECT doc_id, category, start, "end", method, confidence FROM r WHERE category <> 'ip' OR {" OR ".join(f"contains(context, '{x}')" for x in NEAR_RULES["ip"])}
  UNION ALL SELECT doc_id, 'words_3', start, e, 'phrase_matcher', 0.7 FROM k JOIN w3 USING (phrase) WHERE spaced
  UNION ALL SELECT doc_id, 'person_name', start, "end", CASE WHEN tag = 'Surn' THEN 'morphological_enhanced' ELSE 'morphological' END, CASE WHEN tag = 'Surn' THEN 0.75 ELSE 0.65 END FROM g WHERE regexp_matches(text, '^\p{{Lu}}[\p{{L}}\p{{N}}_]') AND (tag = 'Surn' OR (tag = 'PROPN' AND near))
  UNION ALL SELECT doc_id, category, start, "end", 'custom_matcher', 1.0 FROM m)
SELECT every.doc_id, category, substr(text, start + 1, "end" - start) AS original_value, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", method, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM every JOIN b USING (doc_id)"""),
    "q90_greedy_in_rounds": (q90, FIRST["q10_greedy_suppression"][1]),
    "q91_strategies_by_name": (q91, " UNION ALL ".join([*(f"SELECT '{n}' AS strategy, doc_id, pos, category, start, \"end\", method FROM ({sql})" for n, sql in _BY_NAME.items()), f"SELECT strategy, doc_id, pos, category, start, \"end\", method FROM ({NAMES['q67_strategies'][1]})"])),
    "q88_rule_validation": (q88, r"""WITH r AS (SELECT p_type AS category, CASE WHEN p_partkey % 7 <> 0 THEN p_brand || CASE p_size % 5 WHEN 0 THEN '(' WHEN 1 THEN '[a-' WHEN 2 THEN '' WHEN 3 THEN '+' ELSE '|' END END AS pattern FROM part),
v AS (SELECT category, CASE WHEN coalesce(pattern, '') = '' THEN 'no pattern' WHEN TRY(regexp_matches('', pattern)) IS NULL THEN 'doesn''t compile' WHEN TRY(regexp_matches('', pattern)) THEN 'matches the empty string' END AS reason FROM r)
SELECT category, reason IS NULL AS valid, reason, count(*) AS n FROM v GROUP BY ALL"""),
}

"""The registered queries of the span engine, each with its SQL where SQL can express it.

Texts of the tables are in ASCII letters where rules look, so ASCII_RULES are used; rules in Cyrillic are covered by tests. The SQL is for
DuckDB; it finds matches and offsets by its own functions, and folds lists where the order of rows matters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import confidence as conf
from ..functions import text as tx
from ..operators import batching, combine, extract, intervals, reports, rewrite, strategies
from ..session import spread, table
from ..sources import blocks as bl
from ..sources.rules import ASCII_RULES, Rule, as_table, typed_rules
from .flows import analyse, anonymise

Query = Callable[[SparkSession, str], DataFrame]
#: Rules whose matches overlap each other, for queries of resolution.
OVERLAPPING = (
    *ASCII_RULES,
    Rule("digits", r"\b[0-9][0-9 ()+-]{5,}[0-9]\b", "run of digits", 0.6, "custom_matcher", needs="[0-9]"),
    Rule("host", r"\b[a-z0-9]+\.example\.[a-z]+\b", "host name", 0.75, "phrase_matcher", needs="example"),
    Rule("octets", r"\b[0-9]{1,3}\.[0-9]{1,3}\b", "part of an address", 0.8, "spacy_ner", needs="[0-9]"),
)
BLOCK = ["doc_id", "block_id"]
LANGUAGE = (Rule("card_number", r"\b[0-9]{16}\b", "card", 0.9, "phrase_matcher", needs="[0-9]"),)
POLICY = (Rule("insurance_policy", r"\b[0-9]{16}\b", "policy", 0.65, needs="[0-9]"), Rule("ip", ASCII_RULES[1].pattern, "address", 0.8, needs="[0-9]"))
PHRASES = ("the", "of the", "and", "this is")
FIRST_WORDS = ("the", "of", "and")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return bl.whole_blocks(spread(table(spark, d, "documents").select("doc_id", "text")))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return bl.text_blocks(spread(table(spark, d, "documents").select("doc_id", "text")))


def _spans(spark: SparkSession, d: str, rules=ASCII_RULES) -> DataFrame:
    return extract.scan(_docs(spark, d), rules)


def _resolved(fold) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        out = intervals.resolve(_spans(spark, d, OVERLAPPING), fold, *BLOCK)
        return out.select("doc_id", "pos", "category", "start", "end", F.round("confidence", 6).alias("confidence"), "method")

    return query


# ---- SQL pieces

DOCS = "SELECT doc_id, 'paragraph_0' AS block_id, 0 AS block_seq, coalesce(text, '') AS text FROM documents"
LINES = """SELECT doc_id, 'paragraph_' || i AS block_id, CAST(i AS INTEGER) AS block_seq, trim(regexp_replace(parts[i + 1], '\\s+', ' ', 'g')) AS text
  FROM (SELECT doc_id, parts, unnest(range(0, len(parts))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))
  WHERE trim(regexp_replace(parts[i + 1], '\\s+', ' ', 'g')) <> ''"""


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rules) -> str:
    return ", ".join(f"({i}, {_quote(r.category)}, {_quote(r.pattern)}, CAST({r.confidence} AS DOUBLE), {_quote(r.method)}, {_quote(r.description)})" for i, r in enumerate(rules))


def _with_spans(rules=ASCII_RULES, blocks: str = DOCS, name: str = "spans") -> str:
    """WITH-items b (blocks), and the spans of the rules under `name`."""
    return f"""b AS ({blocks}), {name}_r(place, category, pattern, confidence, method, description) AS (VALUES {_values(rules)}),
{name}_m AS (SELECT doc_id, block_id, {name}_r.*, regexp_extract_all(text, pattern) AS m, string_split_regex(text, pattern) AS s FROM b, {name}_r),
{name} AS (
  SELECT doc_id, block_id, category, m[k] AS original_value, confidence, method, description, CAST(place * 1000000 + k - 1 AS INTEGER) AS ord,
    CAST(list_sum(list_transform(s[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS INTEGER) AS start,
    CAST(list_sum(list_transform(s[1:k], lambda x: length(x))) + list_sum(list_transform(m[1:k], lambda x: length(x))) AS INTEGER) AS "end"
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM {name}_m)
)"""


PACK = 'struct_pack(ord := ord, category := category, "start" := start, "end" := "end", confidence := confidence, method := method, original_value := original_value)'


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN least({a}.\"end\" - {a}.start, {b}.\"end\" - {b}.start) > 0 THEN greatest(0, least({a}.\"end\", {b}.\"end\") - greatest({a}.start, {b}.start)) / least({a}.\"end\" - {a}.start, {b}.\"end\" - {b}.start) ELSE 0 END"


def _strict(a: str, b: str) -> str:
    return f'({a}.start < {b}."end" AND {a}."end" > {b}.start)'


def _greedy_sql(order: str, clash: str) -> str:
    """WITH-items ending in kept (doc_id, l): each block's list after the greedy fold."""
    return f"""{_with_spans(OVERLAPPING)}, lists AS (SELECT doc_id, list_transform(list({PACK} ORDER BY {order}), lambda x: [x]) AS l FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {clash})) > 0 THEN acc ELSE list_concat(acc, x) END) AS l FROM lists)"""


def _groups_sql(joins: str) -> str:
    """WITH-items ending in groups (doc_id, g): each block's anchor groups."""
    return f"""{_with_spans(OVERLAPPING)}, lists AS (SELECT doc_id, list_transform(list({PACK} ORDER BY ord), lambda x: [[x]]) AS l FROM spans GROUP BY doc_id),
groups AS (SELECT doc_id, list_reduce(l, lambda acc, x: CASE WHEN coalesce(list_position(list_transform(acc, lambda g: {joins}), true), 0) > 0
  THEN list_transform(acc, lambda g, i: CASE WHEN i = list_position(list_transform(acc, lambda h: {joins.replace("g[1]", "h[1]")}), true) THEN list_concat(g, x[1]) ELSE g END)
  ELSE list_concat(acc, x) END) AS g FROM lists)"""


def _unnested(source: str) -> str:
    return f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, l[i].category AS category, l[i].start AS start, l[i]."end" AS "end", round(l[i].confidence, 6) AS confidence, l[i].method AS method
FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM {source})"""


_WEIGHT = "CASE {x}.method WHEN 'spacy_ner' THEN 1.0 WHEN 'morphological' THEN 0.8 WHEN 'regex' THEN 0.6 WHEN 'phrase_matcher' THEN 0.7 WHEN 'custom_matcher' THEN 0.9 ELSE 0.5 END"
_TYPED = "CASE {x}.method WHEN 'regex' THEN 1.0 WHEN 'phrase_matcher' THEN 0.9 WHEN 'spacy_ner' THEN 0.8 WHEN 'custom_matcher' THEN 0.6 ELSE 0.5 END"
_OLD = f"list_filter(acc, lambda q: {_strict('q', 'x[1]')})[1]"
UUID_SQL = "regexp_replace(md5(doc_id::VARCHAR || chr(1) || block_id || chr(1) || start::VARCHAR || chr(1) || \"end\"::VARCHAR || chr(1) || category), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')"
BAND = "CASE WHEN confidence > 0.8 THEN 'high' WHEN confidence > 0.5 THEN 'medium' ELSE 'low' END"
REPLACED = f"""{_with_spans(OVERLAPPING)}, lists AS (SELECT doc_id, block_id, list_transform(list({PACK} ORDER BY start, ord), lambda x: [x]) AS l FROM spans GROUP BY doc_id, block_id),
kept AS (SELECT doc_id, block_id, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {_strict("k", "x[1]")})) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM lists),
named AS (SELECT *, {UUID_SQL} AS uuid FROM spans),
marked AS (SELECT named.*, kept.k IS NOT NULL AS success FROM named LEFT JOIN kept ON kept.doc_id = named.doc_id AND kept.block_id = named.block_id AND kept.k.ord = named.ord)"""
REWRITTEN = f"""{REPLACED}, pieces AS (
  SELECT doc_id, list(start ORDER BY start) AS s, list("end" ORDER BY start) AS e, list(uuid ORDER BY start) AS u FROM marked WHERE success GROUP BY doc_id
), rewritten AS (
  SELECT b.doc_id, b.block_id, CASE WHEN s IS NULL THEN text ELSE array_to_string(list_transform(range(1, len(s) + 2), lambda k: substr(text, CAST(CASE WHEN k = 1 THEN 1 ELSE e[k - 1] + 1 END AS INTEGER),
    CAST(CASE WHEN k > len(s) THEN length(text) ELSE s[k] END - CASE WHEN k = 1 THEN 0 ELSE e[k - 1] END AS INTEGER)) || CASE WHEN k > len(s) THEN '' ELSE u[k] END), '') END AS text
  FROM b LEFT JOIN pieces USING (doc_id)
)"""


# ---- queries

def q01(spark, d):
    return _spans(spark, d).select("doc_id", "category", "original_value", "start", "end", "confidence", "method")


def q03(spark, d):
    return _lines(spark, d).select("doc_id", "block_id", "block_seq", "text", tx.size_bucket(F.col("text")).alias("bucket"), tx.content_hash(F.col("text")).alias("hash"), tx.prefix_key(F.col("text")).alias("prefix"))


def q04(spark, d):
    return reports.rule_statistics(as_table(spark, OVERLAPPING))


def q06(spark, d):
    found = combine.once_for_equal_texts(_lines(spark, d), lambda b: extract.scan(b, ASCII_RULES))
    return found.select("doc_id", "block_id", "category", "original_value", "start", "end")


def q07(spark, d):
    out = combine.prefer_language(_spans(spark, d, POLICY), _spans(spark, d, LANGUAGE))
    return out.select("doc_id", "category", "original_value", "start", "end", "source")


def q08(spark, d):
    return reports.totals(combine.union_all(_spans(spark, d, POLICY), _spans(spark, d, LANGUAGE)), _docs(spark, d))


def _items(spark, d) -> DataFrame:
    """Found spans as chosen items: each twice, the second time with another category, and every one of a block that isn't there."""
    rows = _spans(spark, d).select("doc_id", "block_id", "category", "original_value", "start", "end", F.col("ord").alias("item"))
    again = rows.withColumns({"category": F.lit("again"), "item": F.col("item") + 500_000})
    lost = rows.withColumns({"block_id": F.lit("paragraph_9"), "category": F.lit(None).cast("string")})
    return rows.unionByName(again).unionByName(lost)


def q09(spark, d):
    known, unknown = combine.selected(_items(spark, d), _docs(spark, d))
    cols = ("doc_id", "block_id", "category", "original_value", "start", "end")
    return known.select(*cols, F.lit(True).alias("chosen")).unionByName(unknown.select(*cols, F.lit(False).alias("chosen")))


def q12(spark, d):
    digits = lambda s: F.length(F.regexp_replace(s, "[^0-9]", ""))
    line = Window.partitionBy(*BLOCK, "start", "end").orderBy(-digits(F.col("original_value")), -F.col("confidence"), "ord")
    rows = _spans(spark, d, OVERLAPPING)
    return rows.withColumn("n", F.row_number().over(line)).where("n = 1").select("doc_id", "category", "start", "end", "confidence")


def q14(spark, d):
    out = extract.scan_with_context(_docs(spark, d), ASCII_RULES, {r.category: FIRST_WORDS for r in ASCII_RULES})
    return extract.with_context(out, _docs(spark, d)).select("doc_id", "category", "start", "end", "context")


def q17(spark, d):
    return strategies.capped(_spans(spark, d, OVERLAPPING), 1).select("doc_id", "category", "start", "end", "confidence")


def _replacements(spark, d) -> DataFrame:
    return rewrite.separable(rewrite.with_uuid(_spans(spark, d, OVERLAPPING)))


def q18(spark, d):
    return rewrite.anonymized(_docs(spark, d), _replacements(spark, d)).select("doc_id", "text")


def q20(spark, d):
    rows = reports.ledger(_replacements(spark, d).where("success"))
    return rows.select("doc_id", F.get_json_object("ledger", "$.total_matches").cast("int").alias("total_matches"), F.get_json_object("ledger", "$.replacements[0].uuid").alias("first_uuid"), F.get_json_object("ledger", "$.replacements[0].position.start").cast("int").alias("first_start"))


def q21(spark, d):
    rows = _replacements(spark, d)
    done, _ = rewrite.restored(rewrite.anonymized(_docs(spark, d), rows), rows.where("success"))
    return done.select("doc_id", "text")


def q22(spark, d):
    """Uuids of every second start are unknown to the table."""
    rows = _replacements(spark, d)
    _, found = rewrite.restored(rewrite.anonymized(_docs(spark, d), rows), rows.where(F.col("success") & (F.col("start") % 2 == 0)))
    return reports.restore_statistics(found)


def q24(spark, d):
    url = Rule("website_url", r"https?://[A-Za-z0-9_.-]+\.[A-Za-z0-9_.-]+[/A-Za-z0-9_.~:?#@!$&'()*+,;=%-]*", "web address", 0.8)
    pages = bl.whole_blocks(spread(table(spark, d, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("text"))), "page_id")
    talk = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    found = extract.scan(pages, [url]).select(F.lit("pages").alias("table_name"), "doc_id", "original_value", "start")
    return found.unionByName(extract.scan(bl.whole_blocks(talk, "id"), ASCII_RULES).select(F.lit("conversations").alias("table_name"), "doc_id", "original_value", "start"))


def q25(spark, d):
    return combine.contained(table(spark, d, "benchmark"), table(spark, d, "documents").select("doc_id", "text"))


def q28(spark, d):
    """Scalar functions over the found values."""
    rows = _spans(spark, d)
    v = F.col("original_value")
    uuid = tx.hash_uuid(F.col("doc_id"), F.col("block_id"), F.col("start"), F.col("end"), F.col("category"))
    return rows.select("doc_id", "start", "category", uuid.alias("uuid"), tx.is_uuid(uuid).alias("valid"), tx.contract_placeholder(v).alias("placeholder"), tx.surrogate(F.lit("[CONTRACT_ID]/[SYSTEM_ID]"), uuid).alias("surrogate"), tx.method_label(F.col("method")).alias("label"), F.array_join(tx.text_variants(v), "|").alias("variants"), tx.cache_key(v).alias("cache_key"))


def q29(spark, d):
    docs = _docs(spark, d)
    rows = extract.scan(docs, ASCII_RULES[:1]).join(docs.select(*BLOCK, "text"), BLOCK)
    return rows.select("doc_id", "start", F.md5(tx.highlight(F.col("text"), F.col("original_value"))).alias("shown"))


def q30(spark, d):
    return reports.summary(_spans(spark, d, OVERLAPPING), _docs(spark, d))


def q31(spark, d):
    return reports.shares(_spans(spark, d, OVERLAPPING), "method")


def q32(spark, d):
    rows = combine.approve_all(_spans(spark, d, OVERLAPPING)).withColumn("approved", F.col("start") % 3 != 0)
    return reports.review(rows)


def q33(spark, d):
    return batching.similar_groups(_lines(spark, d))


def q34(spark, d):
    return batching.prefix_groups(_lines(spark, d))


def q35(spark, d):
    return batching.batches(_lines(spark, d), 5).groupBy("doc_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("block_seq").alias("first_seq"))


def q36(spark, d):
    return batching.batches_by_length(_lines(spark, d), 2000)


def q37(spark, d):
    out = extract.typed(_docs(spark, d), OVERLAPPING, least=0.6)
    return out.select("doc_id", "category", "start", "end", "confidence", "method", "rank")


def q38(spark, d):
    priorities = {"regex": 1, "phrase_matcher": 2, "spacy_ner": 3, "custom_matcher": 4}
    out = strategies.early_exit(_spans(spark, d, OVERLAPPING), priorities, {"regex": 0.9, "phrase_matcher": 0.75})
    out = strategies.thresholds(out, {("insurance_policy", "regex"): 0.7}, 0.6)
    return out.select("doc_id", "category", "start", "end", "method", "confidence")


def _metadata(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = _spans(spark, d).select("doc_id", "block_id", "ord", "original_value", "category", rewrite.hash_uuid(*(F.col(c) for c in (*BLOCK, "start", "end", "category"))).alias("uuid"))
    one = rows.groupBy("doc_id").agg(F.min_by("original_value", "ord").alias("v"))
    props = one.select("doc_id", F.lit("core").alias("section"), F.lit("title").alias("property"), F.col("v").alias("value"))
    props = props.unionByName(one.select("doc_id", F.lit("app").alias("section"), F.lit("Company").alias("property"), F.concat(F.lit("by "), "v", F.lit(" & co")).alias("value")))
    return props.unionByName(one.select("doc_id", F.lit("core").alias("section"), F.lit("subject").alias("property"), F.lit("nothing").alias("value"))), rows


def q39(spark, d):
    props, rows = _metadata(spark, d)
    found = combine.metadata_matches(props, rows)
    return found.select("doc_id", "section", "property", "uuid", "category", "confidence", F.array_join("partial_matches", "|").alias("partial"))


def q40(spark, d):
    props, rows = _metadata(spark, d)
    return rewrite.properties_replaced(props, combine.metadata_matches(props, rows)).select("doc_id", "section", "property", "value")


def q41(spark, d):
    items = _spans(spark, d).withColumn("block_id", F.when(F.col("start") % 2 == 0, F.lit("header_0_1")).otherwise(F.col("block_id")))
    return combine.header_metadata(items).select("doc_id", "original_value", "section", "start")


def q42(spark, d):
    rows = _spans(spark, d)
    meta = rows.select("doc_id", F.concat("original_value", F.when(F.col("start") % 2 == 0, F.lit("")).otherwise(F.lit("!"))).alias("original_value"), F.lit("metadata").alias("block_id"))
    return combine.report_with_metadata(rows.select("doc_id", "original_value", "block_id"), meta)


def q43(spark, d):
    return reports.rule_listing(as_table(spark, OVERLAPPING))


def q44(spark, d):
    rows = spark.createDataFrame([("email", "regex", "high", "a@b", 0.9), ("email", "sql", "high", "a", 0.9), ("phone", "keyword", "low", "tel", 1.5), ("other", "regex", "low", "", 0.5), ("inn", "regex", "medium", "1+", 0.0)], "category string, method string, priority string, pattern string, confidence double")
    good, bad = typed_rules(rows)
    return good.select("category", "method", F.lit(True).alias("valid")).unionByName(bad.select("category", "method", F.lit(False).alias("valid")))


def q45(spark, d):
    blocks = _lines(spark, d)
    marked = blocks.withColumn("type", F.when(F.col("block_seq") == 0, F.lit("header")).otherwise(F.col("type")))
    echo = marked.where("block_seq = 0").select("doc_id", F.lit("paragraph_x").alias("block_id"), F.lit(-1).alias("block_seq"), F.lit("paragraph").alias("type"), F.concat(F.lit("see "), "text").alias("text"))
    out = bl.header_echo(marked.unionByName(echo))
    return out.select("doc_id", "block_seq", F.size("hf_matches").alias("n_echo"))


def q46(spark, d):
    """The phrase matchers: every phrase, and the longest without overlap."""
    docs = _docs(spark, d)
    every = extract.phrases(docs, "phrase", PHRASES).select("doc_id", F.lit("every").alias("how"), "start", "end", F.round("confidence", 6).alias("confidence"))
    return every.unionByName(extract.smart_phrases(docs, "phrase", PHRASES).select("doc_id", F.lit("longest").alias("how"), "start", "end", F.round("confidence", 6).alias("confidence")))


def q47(spark, d):
    return analyse(_docs(spark, d), ASCII_RULES, LANGUAGE).select("doc_id", "category", "original_value", "start", "end", "source")


def q48(spark, d):
    return anonymise(_docs(spark, d), ASCII_RULES, LANGUAGE)["statistics"]


def q49(spark, d):
    rows = _spans(spark, d, (*ASCII_RULES[1:3], LANGUAGE[0]))
    kinds = rows.select("category", "original_value", extract.organisation_type(F.col("original_value"), ("1", "23"), ("4", "5")).alias("kind"), extract.likely_partial(F.concat_ws(" ", F.lit("a"), "category"), ("ip",)).alias("partial"), extract.may_be_system(F.col("original_value")).alias("system"), extract.false_positive(F.col("original_value"), ("^9", "0$")).alias("dropped"))
    return kinds.groupBy("category", "kind", "partial", "system", "dropped").agg(F.count(F.lit(1)).alias("n"))


def q50(spark, d):
    rows = _spans(spark, d)
    moved = rows.withColumn("original_value", F.upper("original_value"))
    return extract.map_positions(moved, _docs(spark, d)).select("doc_id", "category", "original_value", "start", "end")


def q51(spark, d):
    done = rewrite.anonymized(_docs(spark, d), _replacements(spark, d))
    return extract.uuids(done).select("doc_id", F.col("original_value").alias("uuid"), "start")


def q52(spark, d):
    values = [("regex", conf.for_regex(0.6, "x" * 81, True)), ("regex short", conf.for_regex(0.6, "x" * 10)), ("matcher", conf.for_matcher(0.7, 0.9, True)), ("morphology", conf.for_morphology(0.7, 2, True)), ("phrase", conf.for_phrase(3))]
    return spark.createDataFrame([(k, round(v, 6)) for k, v in values], "kind string, confidence double")


def q53(spark, d):
    """Invalid detections apart from valid ones."""
    rows = _spans(spark, d).withColumn("confidence", F.when(F.col("start") % 7 == 0, F.lit(1.5)).otherwise(F.col("confidence")))
    return extract.validated(rows).groupBy("category", "valid").agg(F.count(F.lit(1)).alias("n"))


_S = "doc_id, category, original_value, start, \"end\""
_JOIN_RULES = f"{_with_spans(POLICY, DOCS, 'p')}, {_with_spans(LANGUAGE, DOCS, 'l').split('), ', 1)[1]}"
_KEPT_RULES = f'SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.doc_id = p.doc_id AND {_ratio("l", "p")} >= 0.5)'
_ANALYSE = f"{_with_spans(ASCII_RULES, DOCS, 'p')}, {_with_spans(LANGUAGE, DOCS, 'l').split('), ', 1)[1]}"
_VIEW_META = f"""{_with_spans()}, u AS (SELECT *, {UUID_SQL} AS uuid FROM spans), one AS (SELECT doc_id, arg_min(original_value, ord) AS v FROM spans GROUP BY doc_id),
props AS (SELECT doc_id, 'core' AS section, 'title' AS property, v AS value FROM one UNION ALL SELECT doc_id, 'app', 'Company', 'by ' || v || ' & co' FROM one UNION ALL SELECT doc_id, 'core', 'subject', 'nothing' FROM one),
equal AS (SELECT doc_id, original_value AS value, arg_max(uuid, ord) AS uuid, arg_max(category, ord) AS category FROM u GROUP BY doc_id, original_value),
found AS (SELECT props.*, uuid, category, 1.0::DOUBLE AS confidence, NULL::VARCHAR[] AS partial FROM props JOIN equal USING (doc_id, value)
UNION ALL SELECT props.doc_id, section, property, props.value, arg_min(u.uuid, u.ord), arg_min(u.category, u.ord), 0.8::DOUBLE, list_sort(list_distinct(list(u.original_value)))
  FROM props LEFT JOIN equal USING (doc_id, value) JOIN u ON u.doc_id = props.doc_id AND length(u.original_value) >= 3 AND contains(props.value, u.original_value) WHERE equal.uuid IS NULL GROUP BY props.doc_id, section, property, props.value)"""

_PHRASES = tuple(Rule("phrase", rf"(?i)\b{w.replace(' ', chr(92) + 's+')}\b", "phrase", round(conf.for_phrase(len(w.split())), 6)) for w in PHRASES)
#: DuckDB's \\b knows ASCII alone: letters beyond it become z, and other characters beyond it a space, so that all offsets stay.
_ASCII_WORDS = f"SELECT doc_id, block_id, block_seq, regexp_replace(regexp_replace(text, '[^\\x00-\\x7F\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]', ' ', 'g'), '[^\\x00-\\x7F]', 'z', 'g') AS text FROM ({DOCS})"
QUERIES: dict[str, tuple[Query, str | None]] = {
    "q01_span_scan": (q01, f'WITH {_with_spans()} SELECT doc_id, category, original_value, start, "end", confidence, method FROM spans'),
    "q02_span_report": (lambda s, d: reports.by_category(_spans(s, d)), f"WITH {_with_spans()} SELECT category, {BAND} AS band, count(*) AS n FROM spans GROUP BY ALL"),
    "q03_line_blocks": (q03, f"WITH b AS ({LINES}) SELECT doc_id, block_id, block_seq, text, CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) < 100 THEN 'small' WHEN length(text) < 500 THEN 'medium' ELSE 'large' END AS bucket, md5(text) AS hash, trim(lower(substr(text, 1, 50))) AS prefix FROM b"),
    "q04_rule_statistics": (q04, f"WITH r(place, category, pattern, confidence, method, description) AS (VALUES {_values(OVERLAPPING)}) SELECT category, method, count(*) AS rules, count(*) AS enabled, round(avg(confidence), 6) AS mean_confidence FROM r GROUP BY ALL"),
    "q05_dedup_ratio": (lambda s, d: combine.dedup_ratio(_lines(s, d)), f"WITH b AS ({LINES}), c AS (SELECT count(*) AS a, count(DISTINCT md5(text)) AS u FROM b) SELECT a AS with_text, u AS unique_texts, round((a - u) / a * 100, 4) AS dedup_percent, CAST(ceil(u / 50) AS BIGINT) AS batches FROM c"),
    "q06_detect_once_replicate": (q06, f'WITH {_with_spans(ASCII_RULES, LINES)} SELECT doc_id, block_id, category, original_value, start, "end" FROM spans'),
    "q07_interval_anti_join": (q07, f"WITH {_JOIN_RULES}, k AS ({_KEPT_RULES}) SELECT {_S}, 'Rule Engine' AS source FROM k UNION ALL SELECT {_S}, 'NLP Service' FROM l"),
    "q08_union_totals": (q08, f"WITH {_JOIN_RULES} SELECT (SELECT count(*) FROM p) + (SELECT count(*) FROM l) AS total, (SELECT count(*) FROM p) AS rule_items, (SELECT count(*) FROM l) AS language_items, CAST(0 AS BIGINT) AS duplicates_removed, (SELECT count(*) FROM documents) AS blocks"),
    "q09_selection": (q09, f"""WITH {_with_spans()}, i AS (SELECT {_S}, block_id, ord FROM spans UNION ALL SELECT doc_id, 'again', original_value, start, "end", block_id, ord + 500000 FROM spans),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block_id, original_value, start, "end" ORDER BY ord) AS n FROM i)
SELECT doc_id, block_id, category, original_value, start, "end", true AS chosen FROM k WHERE n = 1 UNION ALL SELECT doc_id, 'paragraph_9', 'unknown', original_value, start, "end", false FROM spans"""),
    "q10_greedy_suppression": (_resolved(intervals.suppress), f"WITH {_greedy_sql('-confidence, ord', _ratio('k', 'x[1]') + ' >= 0.8')} {_unnested('kept')}"),
    "q11_longest_first": (_resolved(lambda s: intervals.longest_first(s, lambda x: F.size(F.split(x["original_value"], " ")))), f"WITH {_greedy_sql('-len(string_split(original_value, chr(32))), -confidence, start, ord', _strict('k', 'x[1]'))} {_unnested('kept')}"),
    "q12_position_dedup": (q12, f"""WITH {_with_spans(OVERLAPPING)}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start, "end" ORDER BY -length(regexp_replace(original_value, '[^0-9]', '', 'g')), -confidence, ord) AS n FROM spans) SELECT doc_id, category, start, "end", confidence FROM k WHERE n = 1"""),
    "q13_global_dedup": (_resolved(intervals.global_dedup), f"WITH {_groups_sql(_ratio('g[1]', 'x[1][1]') + ' >= 0.5')}, best AS (SELECT doc_id, list_transform(g, lambda h: list_filter(h, lambda s: s.confidence = list_max(list_transform(h, lambda t: t.confidence)))[1]) AS l FROM groups) {_unnested('best')}"),
    "q14_context_words": (q14, f"""WITH {_with_spans()}, w AS (SELECT spans.*, substr(text, greatest(start - 50, 0) + 1, least(length(text), "end" + 50) - greatest(start - 50, 0)) AS context FROM spans JOIN b USING (doc_id)) SELECT doc_id, category, start, "end", context FROM w WHERE contains(lower(context), 'the') OR contains(lower(context), 'of') OR contains(lower(context), 'and')"""),
    "q15_first_match": (_resolved(intervals.first_match), f"WITH {_with_spans(OVERLAPPING)}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY method, ord) AS n FROM spans WHERE confidence >= 0.7) SELECT doc_id, CAST(0 AS INTEGER) AS pos, category, start, \"end\", round(confidence, 6) AS confidence, method FROM k WHERE n = 1"),
    "q16_weighted_average": (
        _resolved(lambda s: intervals.weighted_average(s, strategies.language.METHOD_WEIGHTS)),
        f"""WITH {_groups_sql(_ratio('g[1]', 'x[1][1]') + ' > 0.3')}, best AS (SELECT doc_id, list_transform(g, lambda h: CASE WHEN len(h) = 1 THEN h[1] ELSE struct_pack(ord := 0, category := list_filter(h, lambda s: {_WEIGHT.format(x='s')} = list_max(list_transform(h, lambda t: {_WEIGHT.format(x='t')})))[1].category,
  "start" := list_filter(h, lambda s: {_WEIGHT.format(x='s')} = list_max(list_transform(h, lambda t: {_WEIGHT.format(x='t')})))[1].start, "end" := list_filter(h, lambda s: {_WEIGHT.format(x='s')} = list_max(list_transform(h, lambda t: {_WEIGHT.format(x='t')})))[1]."end",
  confidence := list_sum(list_transform(h, lambda t: t.confidence * {_WEIGHT.format(x='t')})) / list_sum(list_transform(h, lambda t: {_WEIGHT.format(x='t')})), method := 'weighted_combination', original_value := '') END) AS l FROM groups) {_unnested('best')}""",
    ),
    "q17_top_of_category": (q17, f"WITH {_with_spans(OVERLAPPING)}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY -confidence, ord) AS n FROM spans) SELECT doc_id, category, start, \"end\", confidence FROM k WHERE n = 1"),
    "q18_redacted_text": (q18, f"WITH {REWRITTEN} SELECT doc_id, text FROM rewritten"),
    "q19_replacement_table": (lambda s, d: reports.replacement_table(_replacements(s, d)), f"WITH {REPLACED} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block_id, start, \"end\", ord) AS INTEGER) AS number, original_value, uuid, block_id FROM marked"),
    "q20_ledger": (q20, f'WITH {REPLACED} SELECT doc_id, CAST(count(*) AS INTEGER) AS total_matches, arg_min(uuid, start) AS first_uuid, min(start) AS first_start FROM marked WHERE success GROUP BY doc_id'),
    "q21_restored_text": (q21, "SELECT doc_id, coalesce(text, '') AS text FROM documents"),
    "q22_restore_statistics": (q22, f"WITH {REPLACED}, k AS (SELECT start % 2 = 0 AS ok FROM marked WHERE success) SELECT count(*) AS found, count(*) FILTER (ok) AS restored, count(*) FILTER (NOT ok) AS failed, round(count(*) FILTER (ok) * 100 / greatest(1, count(*)), 1) AS percent FROM k"),
    "q23_replacement_statistics": (lambda s, d: reports.replacement_statistics(_replacements(s, d)), f"WITH {REPLACED} SELECT category, count(*) AS attempts, count(*) FILTER (success) AS successes FROM marked GROUP BY category"),
    "q24_pages_and_conversations": (q24, "WITH " + _with_spans((Rule("website_url", r"https?://[A-Za-z0-9_.-]+\.[A-Za-z0-9_.-]+[/A-Za-z0-9_.~:?#@!$&'()*+,;=%-]*", "web address", 0.8),), "SELECT page_id AS doc_id, 'paragraph_0' AS block_id, concat_ws(' ', url, html) AS text FROM pages", "p").replace("b AS", "b1 AS").replace("FROM b,", "FROM b1,") + ", " + _with_spans(ASCII_RULES, "SELECT conv_id * 1000 + turn AS doc_id, 'paragraph_0' AS block_id, coalesce(text, '') AS text FROM conversations", "c") + " SELECT 'pages' AS table_name, doc_id, original_value, start FROM p UNION ALL SELECT 'conversations', doc_id, original_value, start FROM c"),
    "q25_contained_passages": (q25, "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)"),
    "q26_value_profile": (lambda s, d: reports.profile(table(s, d, "events"), "event_type", "value").select("event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), "least", "most", F.round("median", 6).alias("median")), "SELECT event_type, count(value) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(median(value), 6) AS median FROM events GROUP BY event_type"),
    "q27_slowest": (lambda s, d: reports.slowest(table(s, d, "events"), "value", "event_id").select("event_id", "event_type", "value"), "SELECT event_id, event_type, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 5"),
    "q28_scalar_functions": (q28, f"""WITH {_with_spans()}, u AS (SELECT *, {UUID_SQL} AS uuid FROM spans) SELECT doc_id, start, category, uuid, true AS valid, CASE WHEN contains(original_value, '-') THEN '[CONTRACT_ID]-' || array_to_string(string_split(original_value, '-')[2:], '-') ELSE '[CONTRACT_ID]' END AS placeholder,
  substr(replace(uuid, '-', ''), 1, 2) || '/' || upper(substr(replace(uuid, '-', ''), 1, 8)) AS surrogate, 'Regular expression' AS label, CASE WHEN upper(original_value) = original_value THEN original_value ELSE original_value || '|' || upper(original_value) END AS variants, sha256(lower(trim(original_value))) AS cache_key FROM u"""),
    "q29_highlight": (q29, f"WITH {_with_spans(ASCII_RULES[:1])} SELECT doc_id, start, md5(replace(text, original_value, '**' || original_value || '**')) AS shown FROM spans JOIN b USING (doc_id)"),
    "q30_summary": (q30, f"WITH {_with_spans(OVERLAPPING)} SELECT (SELECT count(*) FROM b) AS total_blocks, count(*) AS total, count(DISTINCT doc_id) AS blocks_with_data, count(*) FILTER ({BAND} = 'high') AS high, count(*) FILTER ({BAND} = 'medium') AS medium, count(*) FILTER ({BAND} = 'low') AS low, count(*) FILTER (method = 'regex') AS by_regex, count(*) FILTER (method <> 'regex') AS by_language FROM spans"),
    "q31_method_shares": (q31, f"WITH {_with_spans(OVERLAPPING)} SELECT method, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM spans GROUP BY method"),
    "q32_review": (q32, f"WITH {_with_spans(OVERLAPPING)} SELECT category, count(*) AS total, count(*) FILTER (start % 3 <> 0) AS approved, count(*) FILTER (start % 3 = 0) AS excluded, round(avg(confidence), 6) AS mean_confidence FROM spans GROUP BY category"),
    "q33_similar_groups": (q33, f"WITH b AS ({LINES}) SELECT CASE WHEN length(text) < 100 THEN 'small' WHEN length(text) < 500 THEN 'medium' ELSE 'large' END AS bucket, md5(text) AS hash, count(*) AS n FROM b GROUP BY ALL"),
    "q34_prefix_groups": (q34, f"WITH b AS ({LINES}) SELECT trim(lower(substr(text, 1, 50))) AS prefix, count(*) AS n FROM b GROUP BY ALL"),
    "q35_batches": (q35, f"WITH b AS ({LINES}), k AS (SELECT doc_id, block_seq, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY block_seq) - 1) // 5 AS INTEGER) AS batch FROM b) SELECT doc_id, batch, count(*) AS n, min(block_seq) AS first_seq FROM k GROUP BY ALL"),
    "q36_batches_by_length": (q36, f"""WITH RECURSIVE b AS ({LINES}), k AS (SELECT doc_id, block_seq, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY block_seq) AS i FROM b),
w AS (SELECT doc_id, i, block_seq, n AS chars, 0 AS batch FROM k WHERE i = 1 UNION ALL SELECT k.doc_id, k.i, k.block_seq, CASE WHEN w.chars + k.n <= 2000 THEN w.chars + k.n ELSE k.n END, CASE WHEN w.chars + k.n <= 2000 THEN w.batch ELSE w.batch + 1 END FROM w JOIN k ON k.doc_id = w.doc_id AND k.i = w.i + 1)
SELECT doc_id, batch, min(block_seq) AS first_seq, max(block_seq) AS last_seq, CAST(max(chars) AS INTEGER) AS chars FROM w GROUP BY doc_id, batch"""),
    "q37_typed_engine": (q37, f"""WITH {_with_spans(OVERLAPPING)}, lists AS (SELECT doc_id, list_transform(list({PACK} ORDER BY start, "end", ord), lambda x: [x]) AS l FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {_strict('k', 'x[1]')})) = 0 THEN list_concat(acc, x)
  WHEN {_TYPED.format(x='x[1]')} > {_TYPED.format(x=_OLD)} OR ({_TYPED.format(x='x[1]')} = {_TYPED.format(x=_OLD)} AND x[1].confidence > {_OLD}.confidence)
  THEN list_concat(list_filter(acc, lambda k: k.ord <> {_OLD}.ord), x) ELSE acc END)) AS k FROM lists)
SELECT doc_id, k.category AS category, k.start AS start, k."end" AS "end", k.confidence AS confidence, k.method AS method, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {_TYPED.format(x='k')} DESC, k.confidence DESC, k.start, k.ord) AS INTEGER) AS rank FROM kept"""),
    "q38_early_exit": (q38, f"""WITH {_with_spans(OVERLAPPING)}, k AS (SELECT *, CASE method WHEN 'regex' THEN 1 WHEN 'phrase_matcher' THEN 2 WHEN 'spacy_ner' THEN 3 ELSE 4 END AS place, CASE method WHEN 'regex' THEN 0.9 WHEN 'phrase_matcher' THEN 0.75 ELSE 0.95 END AS lim FROM spans), x AS (SELECT *, min(CASE WHEN confidence >= lim THEN place END) OVER (PARTITION BY doc_id) AS last FROM k)
SELECT doc_id, category, start, "end", method, confidence FROM x WHERE (last IS NULL OR place <= last) AND confidence >= 0.6 AND NOT (category = 'insurance_policy' AND method = 'regex' AND confidence < 0.7)"""),
    "q39_metadata_matches": (q39, f"WITH {_VIEW_META} SELECT doc_id, section, property, uuid, category, confidence, array_to_string(partial, '|') AS partial FROM found"),
    "q40_metadata_rewrite": (q40, f"WITH {_VIEW_META} SELECT props.doc_id, props.section, props.property, CASE WHEN confidence = 1 THEN uuid WHEN confidence IS NULL THEN props.value ELSE list_reduce(list_prepend(props.value, partial), lambda a, x: replace(a, x, uuid)) END AS value FROM props LEFT JOIN found USING (doc_id, section, property)"),
    "q41_header_metadata": (q41, f"WITH {_with_spans()} SELECT doc_id, original_value, unnest(['core', 'app', 'custom']) AS section, start FROM spans WHERE start % 2 = 0"),
    "q42_report_with_metadata": (q42, f"WITH {_with_spans()}, m AS (SELECT doc_id, original_value || CASE WHEN start % 2 = 0 THEN '' ELSE '!' END AS original_value FROM spans) SELECT doc_id, original_value, block_id FROM spans UNION ALL SELECT doc_id, original_value, 'metadata' FROM m WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = m.doc_id AND s.original_value = m.original_value)"),
    "q43_rule_listing": (q43, f"WITH r(place, category, pattern, confidence, method, description) AS (VALUES {_values(OVERLAPPING)}) SELECT category, count(*) AS n, 'regex' AS kinds, string_agg(description, '; ' ORDER BY description) AS descriptions FROM r GROUP BY category"),
    "q44_typed_rules": (q44, "SELECT * FROM (VALUES ('email', 'regex', true), ('inn', 'regex', true), ('email', 'sql', false), ('phone', 'keyword', false), ('other', 'regex', false)) t(category, method, valid)"),
    "q45_header_echo": (q45, f"WITH l AS ({LINES}), b AS (SELECT *, CASE WHEN block_seq = 0 THEN 'header' ELSE 'paragraph' END AS type FROM l UNION ALL SELECT doc_id, 'paragraph_x', -1, 'see ' || text, 'paragraph' FROM l WHERE block_seq = 0) SELECT b.doc_id, b.block_seq, CAST(count(h.text) AS INTEGER) AS n_echo FROM b LEFT JOIN (SELECT doc_id, text FROM b WHERE type = 'header') h ON h.doc_id = b.doc_id AND b.type <> 'header' AND contains(b.text, h.text) GROUP BY ALL"),
    "q46_phrases": (q46, f"""WITH {_with_spans(_PHRASES, _ASCII_WORDS)}, lists AS (SELECT doc_id, list_transform(list({PACK} ORDER BY -len(string_split(original_value, ' ')), -confidence, start, ord), lambda x: [x]) AS l FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {_strict('k', 'x[1]')})) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM lists)
SELECT doc_id, 'every' AS how, start, "end", CAST(0.7 AS DOUBLE) AS confidence FROM spans UNION ALL SELECT doc_id, 'longest', k.start, k."end", round(k.confidence, 6) FROM kept"""),
    "q47_analyse": (q47, f"WITH {_ANALYSE} SELECT {_S}, 'Rule Engine' AS source FROM p UNION ALL SELECT {_S}, 'NLP Service' FROM l"),
    "q48_anonymise_statistics": (q48, f"""WITH {_ANALYSE}, k AS (SELECT *, 'Rule Engine' AS source FROM ({_KEPT_RULES}) UNION ALL SELECT *, 'NLP Service' FROM l),
spans AS (SELECT * EXCLUDE (ord), row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", category, source, ord) AS ord FROM k),
lists AS (SELECT doc_id, list_transform(list({PACK} ORDER BY start, ord), lambda x: [x]) AS l FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {_strict('k', 'x[1]')})) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM lists)
SELECT category, count(*) AS attempts, count(k) AS successes FROM spans LEFT JOIN kept ON kept.doc_id = spans.doc_id AND kept.k.ord = spans.ord GROUP BY category"""),
    "q49_classifiers": (q49, f"WITH {_with_spans((*ASCII_RULES[1:3], LANGUAGE[0]))} SELECT category, CASE WHEN contains(original_value, '1') OR contains(original_value, '23') THEN 'government' WHEN contains(original_value, '4') OR contains(original_value, '5') THEN 'commercial' ELSE 'unknown' END AS kind, category = 'ip' AS partial, false AS system, starts_with(original_value, '9') OR ends_with(original_value, '0') AS dropped, count(*) AS n FROM spans GROUP BY ALL"),
    "q50_map_positions": (q50, f"WITH {_with_spans()}, v AS (SELECT doc_id, category, upper(original_value) AS original_value FROM spans), k AS (SELECT v.*, CASE WHEN contains(text, original_value) THEN instr(text, original_value) ELSE instr(lower(text), lower(original_value)) END AS p FROM v JOIN b USING (doc_id)) SELECT doc_id, category, original_value, CAST(p - 1 AS INTEGER) AS start, CAST(p - 1 + length(original_value) AS INTEGER) AS \"end\" FROM k WHERE p > 0"),
    "q51_find_uuids": (q51, f"WITH {REPLACED}, k AS (SELECT doc_id, uuid, start, \"end\" FROM marked WHERE success) SELECT doc_id, uuid, CAST(start + coalesce(sum(36 - (\"end\" - start)) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start FROM k"),
    "q52_confidence_model": (q52, "SELECT * FROM (VALUES ('regex', 0.85::DOUBLE), ('regex short', 0.5::DOUBLE), ('matcher', 0.9::DOUBLE), ('morphology', 0.85::DOUBLE), ('phrase', 0.98::DOUBLE)) t(kind, confidence)"),
    "q53_validation": (q53, f"WITH {_with_spans()} SELECT category, start % 7 <> 0 AS valid, count(*) AS n FROM spans GROUP BY ALL"),
    "q55_metadata_summary": (lambda s, d: reports.metadata_summary(_metadata(s, d)[0]), f"WITH {_VIEW_META} SELECT doc_id, section, count(*) AS n FROM props GROUP BY doc_id, section"),
    "q56_preview": (lambda s, d: reports.preview(_spans(s, d), "doc_id", "start", "ord").select("doc_id", "category", "start"), f"WITH {_with_spans()} SELECT doc_id, category, start FROM spans ORDER BY doc_id, start, ord LIMIT 3"),
    "q54_mapping_statistics": (lambda s, d: reports.mapping_statistics(_replacements(s, d)), f"WITH {REPLACED} SELECT count(*) AS total, count(DISTINCT original_value) AS unique_texts, count(DISTINCT uuid) AS unique_uuids FROM marked"),
}


def _all() -> dict[str, tuple[Query, str | None]]:
    from . import files, names, streams, texts, words

    return {**QUERIES, **names.QUERIES, **files.QUERIES, **words.QUERIES, **texts.QUERIES, **streams.QUERIES}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}

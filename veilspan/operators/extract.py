"""Span extraction: from blocks to detections.

Blocks have doc_id, block_id, text. Detections have doc_id, block_id, category, original_value, start, end, confidence,
method, description and ord, the order of production within a block. Each extractor is one projection with literal patterns, so
the scan of the texts isn't shuffled and rules aren't joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import matches, no_spans, overlap_ratio, overlaps
from ..functions.text import UUID_PATTERN, context_window, let, plain_spaces, system_parts, system_suffix
from ..sources.data import language
from ..sources.rules import Rule
from . import dictionary, intervals, proximity

COLUMNS = ("doc_id", "block_id", "category", "original_value", "start", "end", "confidence", "method", "description", "ord")
#: Rules' matches are numbered from multiples of this, so that ord keeps rules apart.
_STRIDE = 1_000_000


def _found(text: Column, rule: Rule, place: int) -> Column:
    """Structs of a rule's matches."""

    def struct(m: Column, i: Column) -> Column:
        value, start = m["value"], m["start"]
        if rule.group:
            value = F.regexp_extract(m["value"], rule.java(), rule.group)
            start = start + F.instr(m["value"], value) - 1
        return F.struct(
            F.lit(rule.category).alias("category"), value.alias("original_value"), start.cast("int").alias("start"), (start + F.length(value)).cast("int").alias("end"),
            F.lit(float(rule.confidence)).alias("confidence"), F.lit(rule.method).alias("method"), F.lit(rule.description).alias("description"), (F.lit(place * _STRIDE) + i).alias("ord"),
        )

    found = matches(text, rule.java())
    if rule.needs:
        found = F.when(F.col(_need(rule.needs)), found).otherwise(no_spans())
    return F.transform(found, struct)


def _need(pattern: str) -> str:
    return f"_need_{pattern}"


def _texts(blocks: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ()) -> DataFrame:
    """Blocks with _text, and for each different need of the rules whether it is met; most texts meet few, and are passed over fast."""
    rows = blocks.select("doc_id", "block_id", *keep, plain_spaces(F.col("text")).alias("_text"))
    return rows.withColumns({_need(n): F.col("_text").rlike(n) for n in sorted({r.needs for r in rules if r.needs})})


def scan(blocks: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ()) -> DataFrame:
    """All matches of all rules in all blocks, rule by rule; matches of different rules may overlap.

    Columns of `keep` go along. Without rules there are no detections.
    """
    rows = _texts(blocks, rules, keep)
    if not rules:
        none = "category string, original_value string, start int, end int, confidence double, method string, description string, ord int"
        return rows.where(F.lit(False)).select("doc_id", "block_id", *keep, *(F.lit(None).cast(t.split()[1]).alias(t.split()[0]) for t in none.split(", ")))
    found = F.concat(*(_found(F.col("_text"), r, i) for i, r in enumerate(rules)))
    return rows.select("doc_id", "block_id", *keep, F.explode(found).alias("_m")).select(*COLUMNS[:2], *keep, "_m.*")


def with_context(detections: DataFrame, blocks: DataFrame, width: int = language.CONTEXT_WIDTH) -> DataFrame:
    """detections with `context`, the text around each."""
    text = blocks.select("doc_id", "block_id", plain_spaces(F.col("text")).alias("_text"))
    out = detections.join(text, ["doc_id", "block_id"])
    return out.withColumn("context", context_window(F.col("_text"), F.col("start"), F.col("end"), width)).drop("_text")


def scan_with_context(blocks: DataFrame, rules: Sequence[Rule], words: dict[str, Sequence[str]], width: int = language.CONTEXT_WIDTH) -> DataFrame:
    """scan(), without matches of a category in `words` that have none of its words near them (in any case)."""
    rows = _texts(blocks, rules)
    parts = []
    for i, r in enumerate(rules):
        found = _found(F.col("_text"), r, i)
        if words.get(r.category):
            found = F.filter(found, _near(words[r.category], width))
        parts.append(found)
    return rows.select("doc_id", "block_id", F.explode(F.concat(*parts)).alias("_m")).select(*COLUMNS[:2], "_m.*")


def _near(words: Sequence[str], width: int):
    lowered = [w.lower() for w in words]

    def near(m: Column) -> Column:
        window = F.lower(context_window(F.col("_text"), m["start"], m["end"], width))
        out = F.lit(False)
        for w in lowered:
            out |= F.contains(window, F.lit(w))
        return out

    return near


def phrase_rule(category: str, phrases: Sequence[str], confidence: float, method: str = "phrase_matcher") -> Rule:
    """One rule for whole phrases in any case; at one place the longest wins."""
    body = "|".join(_quoted(p) for p in sorted(phrases, key=lambda p: (-len(p), p)))
    return Rule(category, rf"(?<!\w)(?:{body})(?!\w)", "phrase", confidence, method, ignore_case=True)


def _quoted(phrase: str) -> str:
    special = set("\\^$.|?*+()[]{}-")
    return r"\s+".join("".join(f"\\{c}" if c in special else c for c in w) for w in phrase.split())


def phrases(blocks: DataFrame, category: str, values: Sequence[str], confidence: float = 0.7) -> DataFrame:
    """Phrases of a category, overlapping ones too; a dictionary of any size goes to dictionary.match as a table."""
    return dictionary.match(blocks, _phrase_table(blocks, category, values, confidence))


def smart_phrases(blocks: DataFrame, category: str, values: Sequence[str]) -> DataFrame:
    """Phrases, longer ones surer, without those that overlap a longer one."""
    return dictionary.match_longest(blocks, _phrase_table(blocks, category, values, 0.0))


def _phrase_table(blocks: DataFrame, category: str, values: Sequence[str], confidence: float) -> DataFrame:
    return blocks.sparkSession.createDataFrame([(v, category, float(confidence)) for v in values], "phrase string, category string, confidence double")


def uuids(blocks: DataFrame) -> DataFrame:
    return scan(blocks, [Rule("uuid", UUID_PATTERN, "uuid", 1.0)])


def typed(blocks: DataFrame, rules: Sequence[Rule], categories=None, methods=None, least: float = 0.0) -> DataFrame:
    """The typed engine: enabled rules of these kinds, in any case, resolved by weight, with trimmed context.

    `rank` is the order of a block's result: by the method's weight and the confidence from the highest, then by start.
    """
    from pyspark.sql.window import Window

    from ..sources.rules import pruned

    chosen = [Rule(**{**r.__dict__, "ignore_case": True}) for r in pruned(rules, categories, methods, least)]
    rows = scan(blocks, chosen)
    rows = intervals.resolve(rows, intervals.typed_overlap, "doc_id", "block_id").drop("pos")
    rows = with_context(rows, blocks).withColumn("context", F.trim("context"))
    weights = F.create_map(*(F.lit(x) for p in intervals.TYPED_WEIGHTS.items() for x in p))
    weight = F.coalesce(F.try_element_at(weights, F.col("method")), F.lit(0.5))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "block_id").orderBy(-weight, -F.col("confidence"), "start", "ord")))


def name_filter(detections: DataFrame, surnames: DataFrame, given: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """Detections of person_name whose words are known: one word, a surname or given name; two or three, a surname and a given name or initials.

    Words are compared with е for ё, as they stand or by `lemmas` (form, lemma). Other categories pass. surnames and given have a column word.
    """
    word = F.translate(F.trim("_w"), "ёЁ", "еЕ")
    rows = detections.withColumn("_id", F.struct("doc_id", "block_id", "ord"))
    names = rows.where("category = 'person_name'")
    parts = names.select("_id", F.explode(F.split(F.regexp_replace("original_value", r"(?U)(\p{Lu}\.)\s*(\p{Lu}\.)", "$1$2 "), r"(?U)\s+")).alias("_w")).select("_id", word.alias("word")).where("word != ''")
    if lemmas is not None:
        parts = parts.join(lemmas.withColumnRenamed("form", "word"), "word", "left").withColumn("word", F.coalesce("lemma", "word")).drop("lemma")
    parts = parts.withColumn("initials", F.col("word").rlike(r"(?U)^\p{Lu}\.\p{Lu}\.$"))
    parts = parts.join(surnames.select("word", F.lit(True).alias("s")), "word", "left").join(given.select("word", F.lit(True).alias("g")), "word", "left")
    known = parts.groupBy("_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("s", F.lit(False))).alias("s"), F.max(F.coalesce("g", F.lit(False)) | F.col("initials")).alias("g"))
    valid = known.where(((F.col("n") == 1) & (F.col("s") | F.col("g"))) | (F.col("n").between(2, 3) & F.col("s") & F.col("g"))).select("_id")
    return names.join(valid, "_id", "left_semi").unionByName(rows.where("category != 'person_name'")).drop("_id")


def three_nouns(detections: DataFrame, forms: DataFrame) -> DataFrame:
    """Detections of person_name with three words, all nouns and two of them animate, by a table of forms (form, pos, animate); other categories pass.

    Words are compared in lower case; of a form's several rows the first by `ord` counts. Stands in for a morphological model, which the engine hasn't.
    """
    rows = detections.withColumn("_id", F.struct("doc_id", "block_id", "ord"))
    names = rows.where("category = 'person_name'")
    best = forms.groupBy(F.lower("form").alias("word")).agg(F.min_by(F.struct("pos", "animate"), "ord").alias("f"))
    words = F.filter(F.split(F.trim(F.lower("original_value")), r"(?U)\s+"), lambda w: w != "")
    parts = names.where(F.size(words) == 3).select("_id", F.explode(words).alias("word")).join(best, "word")
    noun = F.col("f.pos") == "NOUN"
    valid = parts.groupBy("_id").agg(F.count_if(noun).alias("nouns"), F.count_if(noun & F.col("f.animate")).alias("animate")).where("nouns = 3 and animate >= 2").select("_id")
    return names.join(valid, "_id", "left_semi").unionByName(rows.where("category != 'person_name'")).drop("_id")


def span_systems(spans: DataFrame) -> DataFrame:
    """Spans found by a method as detections of information systems: 0.85 for phrases and 0.8 for others, with core, private and anonymized parts.

    A value without a system word is its own core.
    """
    value, parts = F.col("original_value"), system_parts(F.col("original_value"))
    return spans.withColumns({
        "category": F.lit("information_system"),
        "confidence": F.when(F.col("method") == "phrase_matcher", 0.85).otherwise(F.lit(0.8)),
        "method": F.concat(F.lit("information_system_"), "method"),
        "core": F.coalesce(parts["core"], value),
        "private": F.coalesce(parts["private"], F.lit("")),
        "anonymized": F.coalesce(parts["anonymized"], value),
    })


# Abbreviations of information systems, what may follow them, and patterns of long names.
JOINED = ("ЕИС", "АИС", "ГИС", "ЕГИС", "ПГИС", "ГАС", "ФИС")
SPACED = ("ЕИС", "АИС", "ГИС", "ФГИС", "ЕГИС", "ПГИС", "ГАС", "ФИС", "РИС")
SYSTEM_PHRASES = ("ГИС ЖКХ",)
LONG_NAMES = (
    r"единая\s+информационная\s+система",
    r"едино[йыеми]\s+информационно[йыеми]\s+систем[аыеуой]",
    r"(?:государственна[яоейыми]|федеральна[яоейыми])\s+информационна[яоейыми]\s+систем[аыеуой]",
    r"автоматизированна[яоейыми]\s+информационна[яоейыми]\s+систем[аыеуой]",
)
# What a text that names a system holds.
SYSTEM_HINTS = ("информационная система", "информационная платформа", "информационный портал", "информационный комплекс", "еис", "аис", "гис", "егис", "епгу", "есиа")


def may_be_system(text: Column) -> Column:
    """Whether a text names an information system."""
    low = F.lower(text)
    out = F.lit(False)
    for w in SYSTEM_HINTS:
        out |= F.contains(low, F.lit(w))
    return out


def _struct(start: Column, end: Column, value: Column, confidence: float, method: str, core: Column, private: Column, place: int, i: Column) -> Column:
    return F.struct(
        F.lit("information_system").alias("category"), value.alias("original_value"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(confidence).alias("confidence"),
        F.lit(method).alias("method"), F.lit("").alias("description"), (F.lit(place * _STRIDE) + i).alias("ord"), core.alias("core"), private.alias("private"),
    )


def system_spans(text: Column) -> Column:
    """Structs of the information systems in a text: joined abbreviations, long names, known phrases, spaced abbreviations.

    A later kind gives way to an earlier one where they overlap (the last, where it starts inside one); what remains is suppressed at 0.7.
    """
    upper = r"[А-ЯЁA-Z]"

    def joined(abbreviation: str, place: int) -> Column:
        body = rf"(?U)(?<!\p{{Ll}})\b{abbreviation}[А-ЯA-Z]{{2,}}\b(?!\p{{Ll}})"
        n = len(abbreviation)
        return F.transform(matches(text, body), lambda m, i: _struct(m["start"], m["end"], m["value"], 0.9, "complex_abbreviation", F.lit(abbreviation), F.substring(m["value"], F.lit(n + 1), F.length(m["value"])), place, i))

    def long_name(pattern: str, place: int) -> Column:
        def made(m: Column, i: Column) -> Column:
            rest = F.substring(text, m["end"] + 1, F.length(text))
            gap = F.length(rest) - F.length(F.regexp_replace(rest, r"(?U)^\s+", ""))
            flat = lambda s: F.when(s != "", s)
            suffix = flat(system_suffix(rest))
            end = F.when(suffix.isNotNull(), m["end"] + gap + F.length(suffix)).otherwise(m["end"])
            value = F.concat_ws(" ", m["value"], suffix)
            parts = system_parts(value)
            return _struct(m["start"], end, value, 0.8, "information_system_regex", F.coalesce(parts["core"], m["value"]), F.coalesce(parts["private"], F.lit("")), place, i)

        return F.transform(matches(text, f"(?iuU){pattern}"), made)

    def phrase(value: str, place: int) -> Column:
        follow = rf"(?![\s]+{upper}{{1,10}}\b)(?!\s+\S+\s+{upper}{{1,10}}\b)"
        body = rf"(?U)(?iu:(?<!\w){_quoted(value)}(?!\w)){follow}"
        return F.transform(matches(text, body), lambda m, i: _struct(m["start"], m["end"], m["value"], 0.85, "simple_abbreviation", m["value"], F.lit(""), place, i))

    def spaced(place: int) -> Column:
        head = "|".join(sorted(SPACED, key=len, reverse=True))
        stop = r"(?!(?:И|В|НА|С|ДЛЯ|ПО)\b)"
        body = rf"(?U)(?<!\w)(?iu:{head})(?:\s+{stop}{upper}{{1,10}}(?!\w)){{1,3}}"
        core = lambda m: F.upper(F.regexp_extract(m["value"], r"(?U)^(\w+)", 1))
        rest = lambda m: F.regexp_replace(F.regexp_replace(m["value"], r"(?U)^\w+\s+", ""), r"(?U)\s+", " ")
        return F.transform(matches(text, body), lambda m, i: _struct(m["start"], m["end"], m["value"], 0.95, "spaced_abbreviation", core(m), rest(m), place, i))

    first = F.concat(*(joined(a, k) for k, a in enumerate(JOINED)))
    free = lambda s, taken: ~F.exists(taken, lambda t: (s["start"] < t["end"]) & (s["end"] > t["start"]))
    second = F.concat(*(long_name(p, 20 + k) for k, p in enumerate(LONG_NAMES)))
    third = F.concat(*(phrase(p, 40 + k) for k, p in enumerate(SYSTEM_PHRASES)))

    def more(a: Column) -> Column:
        return let(F.concat(a, F.filter(second, lambda s: free(s, a))), with_phrases)

    def with_phrases(b: Column) -> Column:
        return let(F.concat(b, F.filter(third, lambda s: free(s, b))), with_spaced)

    def with_spaced(c: Column) -> Column:
        starts_free = lambda s: ~F.exists(c, lambda t: (s["start"] >= t["start"]) & (s["start"] < t["end"]))
        return intervals.suppress(F.concat(c, F.filter(spaced(60), starts_free)), 0.7)

    return let(first, more)


def information_systems(blocks: DataFrame) -> DataFrame:
    """Detections of information systems, with their core and private parts."""
    rows = blocks.select("doc_id", "block_id", plain_spaces(F.col("text")).alias("_text")).where(F.col("_text").rlike("(?iu)ис|систем|гас"))
    return rows.select("doc_id", "block_id", F.explode(system_spans(F.col("_text"))).alias("_m")).select(*COLUMNS[:2], "_m.*")


def refine_systems(detections: DataFrame) -> DataFrame:
    """Detections that may name a system, replaced by the systems found in their values (offsets moved), if any; suppressed at 0.6."""
    inner = F.when(may_be_system(F.col("original_value")), system_spans(F.col("original_value")))
    rows = detections.select("*", F.explode_outer(inner).alias("_m"))  # the one place that searches a value; null where nothing is found
    m, old = F.col("_m"), F.col("_m").isNull()
    moved = {"start": m["start"] + F.col("start"), "end": m["end"] + F.col("start"), "ord": F.col("ord")}
    of = lambda c: moved.get(c, m[c] if c in COLUMNS else F.lit(None))
    rest = [F.when(old, F.col(c)).otherwise(of(c)).alias(c) for c in detections.columns if c not in ("doc_id", "block_id")]
    both = rows.select("doc_id", "block_id", *rest, m["core"].alias("core"), m["private"].alias("private"))
    return intervals.resolve(both, lambda s: intervals.suppress(s, 0.6), "doc_id", "block_id").drop("pos")


# Patterns of contract numbers with their confidences and needs, and the shapes of valid ones.
CONTRACTS = (
    Rule("contract_number", r"(?:государственный\s+)?(?:контракт|договор)(?:\s+от\s+[^№]*?)?\s*№\s*([^\s,.\n]+)", "government_contract_number", 0.95, "contract_regex_government_contract_number", group=1, ignore_case=True),
    Rule("contract_number", r"№\s*([А-Яа-я0-9\-\/ОК]+(?:\-\d{4})?)", "number_sign", 0.8, "contract_regex_number_sign", group=1),
    Rule("contract_number", r"номер\s+([А-Яа-я0-9\-\/ОК]+(?:\-\d{4})?)", "word_number", 0.85, "contract_regex_word_number", group=1, ignore_case=True),
    Rule("contract_number", r"(?:государственный\s+)?(?:контракт|договор)\s+от\s+\d{1,2}\s+\w+\s+\d{4}\s*г\.?\s*№\s*([^\s,.\n]+)", "contract_with_date_number", 0.98, "contract_regex_contract_with_date_number", group=1, ignore_case=True),
)
CONTRACT_WORDS = ("контракт", "договор")
CONTRACT_SHAPE = r"^(?:\d{1,4}/[А-Я]{2,4}-\d{4}|\d{1,4}-[А-Я]{2,4}-\d{4}|[А-Я]{2,4}-\d{1,4}-\d{4}|\d{4}-\d{1,4}|[А-Я]{2,4}\d{1,4}|\d{1,4}/\d{4})$"


def valid_contract(number: Column) -> Column:
    return (F.length(number) >= 2) & F.upper(number).rlike(CONTRACT_SHAPE)


def contract_numbers(blocks: DataFrame, width: int = 50) -> DataFrame:
    """Contract numbers of a valid shape; rules by sign or word alone need a contract near the match."""
    found = scan(blocks, CONTRACTS)
    near = F.lower("context").rlike("|".join(CONTRACT_WORDS))
    found = with_context(found, blocks, width)
    needs = F.col("description").isin("number_sign", "word_number")
    return found.where(valid_contract(F.col("original_value")) & (~needs | near)).drop("context")


def organisation_type(name: Column, government: Sequence[str] = language.GOVERNMENT_WORDS, commercial: Sequence[str] = language.COMMERCIAL_FORMS) -> Column:
    """government, commercial or unknown, by words that the name contains."""
    low = F.lower(name)
    has = lambda words: low.rlike("|".join(_quoted(w) for w in words)) if words else F.lit(False)
    return F.when(has(government), "government").when(has(commercial), "commercial").otherwise("unknown")


def false_positive(name: Column, patterns: Sequence[str]) -> Column:
    """Whether any of the patterns (in any case) is found in the name."""
    out = F.lit(False)
    for p in patterns:
        out |= name.rlike(f"(?iuU){p}")
    return out


# Last words of names that are likely cut short.
PARTIAL_ENDINGS = ("министерство", "департамент", "управление", "развития", "связи")


def likely_partial(name: Column, endings: Sequence[str] = PARTIAL_ENDINGS) -> Column:
    """Under six words, and the last one of the endings."""
    words = F.split(F.trim(F.lower(name)), r"(?U)\s+")
    return (F.size(words) < 6) & F.element_at(words, -1).isin(*endings)


def extend_partial(detections: DataFrame, blocks: DataFrame, names: DataFrame) -> DataFrame:
    """Detections that are the first three or more words of a full name in `names` (name), replaced by that name.

    Of the candidates the one with the largest share of its words within 100 characters wins, if that is over 0.7; names in
    order break ties. Confidence rises by 0.05, to 0.99 at most, and the method gets the suffix _extended.
    """
    words = F.split(F.trim(F.lower("name")), r"(?U)\s+")
    cuts = F.when(F.size(words) > 3, F.sequence(F.lit(3), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    prefixes = names.select("name", words.alias("_words"), F.explode(cuts).alias("_n")).select("name", "_words", F.array_join(F.slice("_words", F.lit(1), F.col("_n")), " ").alias("_short"))
    rows = with_context(detections, blocks, 100).withColumn("_short", F.trim(F.lower("original_value")))
    joined = rows.join(prefixes, "_short", "left")
    share = F.size(F.filter("_words", lambda w: F.contains(F.lower(F.col("context")), w))) / F.size("_words")
    key = [c for c in detections.columns]
    best = joined.withColumn("_share", share).groupBy(*key).agg(F.max_by("name", F.struct(F.coalesce("_share", F.lit(0.0)), F.regexp_replace("name", "^", ""))).alias("_best"), F.max("_share").alias("_most"))
    hit = F.col("_most") > 0.7
    out = best.withColumns({
        "extended_from": F.when(hit, F.col("original_value")),
        "original_value": F.when(hit, F.col("_best")).otherwise(F.col("original_value")),
        "confidence": F.when(hit, F.least(F.col("confidence") + 0.05, F.lit(0.99))).otherwise(F.col("confidence")),
        "method": F.when(hit, F.concat("method", F.lit("_extended"))).otherwise(F.col("method")),
    })
    return out.drop("_best", "_most")


def map_positions(detections: DataFrame, blocks: DataFrame) -> DataFrame:
    """Detections with start and end of their value's first occurrence in the block: exact, in any case, or with line breaks as spaces.

    What isn't found is dropped.
    """
    text = blocks.select("doc_id", "block_id", F.coalesce("text", F.lit("")).alias("_t"))
    value = F.col("original_value")
    at = lambda t, v: F.when(F.instr(t, v) > 0, F.instr(t, v))
    flat = F.regexp_replace("_t", "[\\r\\n]", " ")
    place = F.coalesce(at(F.col("_t"), value), at(F.lower("_t"), F.lower(value)), at(flat, F.regexp_replace(value, "[\\r\\n]", " ")))
    out = detections.join(text, ["doc_id", "block_id"]).withColumn("_at", place).where("_at is not null")
    return out.withColumns({"start": F.col("_at") - 1, "end": F.col("_at") - 1 + F.length(value)}).drop("_t", "_at")


def validated(detections: DataFrame) -> DataFrame:
    """detections with `valid`: category and value are there, the confidence is from 0 to 1, and the start isn't after the end."""
    good = F.col("category").isNotNull() & F.col("original_value").isNotNull() & F.col("confidence").between(0, 1) & (F.col("start") <= F.col("end"))
    return detections.withColumn("valid", F.coalesce(good, F.lit(False)))


def not_overlapping(detections: DataFrame, taken: DataFrame, threshold: float | None = None) -> DataFrame:
    """Detections that overlap nothing in `taken` of their block: any character, or a ratio from the threshold (over 0).

    Only spans that share a bin of the block are compared (proximity), so a long block is split over tasks; what is hit goes by its place.
    """
    clash = (lambda a, b: overlaps(a, b)) if threshold is None else (lambda a, b: overlap_ratio(a, b) >= threshold)
    place = ["start", "end"]
    hit = proximity.meeting(detections.select(*proximity.KEY, *place).distinct(), taken.select(*proximity.KEY, *place).distinct(), clash, place, [])
    return detections.join(hit.withColumnsRenamed({f"l_{c}": c for c in place}), [*proximity.KEY, *place], "left_anti")

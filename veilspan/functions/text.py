"""Scalar functions over block texts, values and ids, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A whole uuid in a text.
UUID_PATTERN = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def normalize_block(text: Column) -> Column:
    """White space, the no-break space included, becomes single spaces; the ends are trimmed. Null counts as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def normalize_loose(text: Column) -> Column:
    """As normalize_block(), and zero-width and typographic spaces count as white space too."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\u00A0\u2000-\u200B\u202F\u205F\u3000]+", " "))


def plain_spaces(text: Column) -> Column:
    """No-break spaces become spaces; the length stays."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("\u00a0"), F.lit(" "))


def text_variants(text: Column, rules: list[tuple[str, str]] = ()) -> Column:
    """The text, the text after the replacement rules, and both in upper case, without repeats."""
    normal = text
    for pattern, replacement in rules:
        normal = F.regexp_replace(normal, f"(?iU){pattern}", replacement)
    return F.array_distinct(F.array(text, normal, F.upper(text), F.upper(normal)))


def context_window(text: Column, start: Column, end: Column, width: int = 50) -> Column:
    """The text from `width` characters before start to as many after end."""
    left = F.greatest(start - width, F.lit(0))
    return F.substring(text, left + 1, F.least(F.length(text), end + width) - left)


def grams(text: Column, size: int = 3) -> Column:
    """The distinct runs of `size` characters; a shorter text or null has none."""
    runs = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - size), lambda i: F.concat(*(F.get(c, i + k) for k in range(size))))
    return F.when(F.length(text) >= size, F.array_distinct(let(F.split(text, ""), runs))).otherwise(F.array().cast("array<string>"))


def size_bucket(text: Column) -> Column:
    """empty, small (under 100 characters), medium (under 500) or large, of the trimmed text."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(n == 0, "empty").when(n < 100, "small").when(n < 500, "medium").otherwise("large")


def content_hash(text: Column) -> Column:
    return F.md5(F.trim(F.coalesce(text, F.lit(""))))


def cache_key(text: Column) -> Column:
    """Equal for texts that differ in case or outer white space only."""
    return F.sha2(F.lower(F.trim(F.coalesce(text, F.lit("")))), 256)


def prefix_key(text: Column, length: int = 50) -> Column:
    return F.trim(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, length)))


def highlight(text: Column, value: Column) -> Column:
    """Every occurrence of the value between double stars; an empty value changes nothing."""
    return F.when(F.length(value) > 0, F.replace(text, value, F.concat(F.lit("**"), value, F.lit("**")))).otherwise(text)


#: Labels of detection methods.
METHOD_LABELS = {
    "regex": "Regular expression",
    "spacy_ner": "Entity model",
    "spacy_ner_per": "Entity model (persons)",
    "spacy_ner_org": "Entity model (organizations)",
    "morphological": "Morphology",
    "morphological_enhanced": "Morphology (enhanced)",
    "custom_matcher": "Token matcher",
    "phrase_matcher": "Phrase matcher",
    "context_matcher": "Context matcher",
    "complex_abbreviation": "Joined abbreviation",
    "spaced_abbreviation": "Spaced abbreviation",
    "simple_abbreviation": "Simple abbreviation",
    "information_system_regex": "System name",
    "weighted_combination": "Weighted combination",
}


def method_label(method: Column) -> Column:
    """The label of a method; an unknown method is its own label."""
    labels = F.create_map(*(F.lit(x) for pair in METHOD_LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(labels, method), method)


def contract_placeholder(number: Column) -> Column:
    """[CONTRACT_ID] in place of the part before the first slash (of two parts) or else the first hyphen."""
    by_slash, by_hyphen = F.split(number, "/", -1), F.split(number, "-", -1)
    return (
        F.when(F.contains(number, F.lit("/")) & (F.size(by_slash) == 2), F.concat(F.lit("[CONTRACT_ID]/"), F.get(by_slash, F.lit(1))))
        .when(F.contains(number, F.lit("/")), F.lit("[CONTRACT_ID]"))
        .when(F.contains(number, F.lit("-")), F.concat(F.lit("[CONTRACT_ID]-"), F.array_join(F.slice(by_hyphen, 2, F.greatest(F.size(by_hyphen) - 1, F.lit(1))), "-")))
        .otherwise(F.lit("[CONTRACT_ID]"))
    )


def surrogate(placeholder: Column, uuid: Column) -> Column:
    """The placeholder with two hex digits of the uuid for a contract, and eight in upper case for a system."""
    flat = F.replace(uuid, F.lit("-"), F.lit(""))
    with_contract = F.replace(placeholder, F.lit("[CONTRACT_ID]"), F.substring(flat, 1, 2))
    return F.replace(with_contract, F.lit("[SYSTEM_ID]"), F.upper(F.substring(flat, 1, 8)))


#: Words of which one ends the core part of a system's name.
SYSTEM_WORDS = ("система", "системы", "систему", "системе", "платформа", "портал")


def system_parts(name: Column) -> Column:
    """Struct of core, private, anonymized: the name is cut after its first system word; null if it has none.

    A private part of one word is dropped.
    """
    word = "|".join(SYSTEM_WORDS)
    words = F.split(F.trim(name), r"(?U)\s+")
    at = F.array_position(F.transform(words, lambda w: F.lower(w).rlike(word)), F.lit(True)).cast("int")
    core = F.array_join(F.slice(words, F.lit(1), at), " ")
    rest = F.slice(words, at + 1, F.greatest(F.size(words) - at, F.lit(1)))
    private = F.when(F.size(words) - at >= 2, F.array_join(rest, " ")).otherwise(F.lit(""))
    shown = F.when(private != "", F.concat(core, F.lit(" [SYSTEM_ID]"))).otherwise(core)
    return F.when(at > 0, F.struct(core.alias("core"), private.alias("private"), shown.alias("anonymized")))


#: Words that end a system's name.
STOP_WORDS = (
    "содержит", "включает", "предназначена", "используется", "применяется", "обеспечивает", "является", "представляет", "служит",
    "создана", "разработана", "внедрена", "функционирует", "работает", "действует", "предоставляет", "осуществляет", "выполняет",
)


def system_suffix(rest: Column) -> Column:
    """The words that go on a system's name: up to a bracket, a stop word, or a word that ends with a mark (kept without it)."""
    words = F.filter(F.split(F.ltrim(rest), r"(?U)\s+"), lambda w: w != "")
    state = F.struct(F.lit(False).alias("over"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, w: Column) -> Column:
        clean = F.lower(F.regexp_replace(w, r"(?U)[^\w\s-]", ""))
        cut = F.substring_index(w, "(", 1)
        ends = w.rlike(r"[.,;!?]$")
        bare = F.substring(w, F.lit(1), F.length(w) - 1)
        kept = F.when(F.contains(w, F.lit("(")), cut).when(clean.isin(*STOP_WORDS), F.lit("")).when(ends, bare).when(clean == "", F.lit("")).otherwise(w)
        over = F.contains(w, F.lit("(")) | clean.isin(*STOP_WORDS) | ends | (clean == "")
        more = F.when(kept != "", F.concat(a["out"], F.array(kept))).otherwise(a["out"])
        return F.when(a["over"], a).otherwise(F.struct(over.alias("over"), more.alias("out")))

    return F.aggregate(words, state, step, lambda a: F.array_join(a["out"], " "))


def hash_uuid(*parts: Column) -> Column:
    """A reproducible id in uuid form, from the MD5 of the parts."""
    digest = F.md5(F.concat_ws("\u0001", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit(False))

"""Rule sources: structured rules, typed rules, language rules, dictionaries; loaded as data and checked on the driver.

A rule set is small and fixed for a query: it becomes literal patterns in the plan, so that each is compiled once, and
categories and confidences prune it before the plan is built.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import xlsx
from .data import language, structured


@dataclass(frozen=True)
class Rule:
    category: str
    pattern: str
    description: str = ""
    confidence: float = 0.5
    method: str = "regex"
    kind: str = "regex"
    priority: int = 1
    enabled: bool = True
    context_required: bool = True
    group: int = 0
    ignore_case: bool = False
    #: A cheap pattern that a text must hold for the rule to match at all; empty if none is known.
    needs: str = ""

    def java(self) -> str:
        """The pattern for Spark: Unicode classes, and no case where it is ignored."""
        body = self.pattern.removeprefix("(?i)")
        return f"(?iuU){body}" if self.ignore_case or body != self.pattern else f"(?U){body}"


#: Rules for texts in ASCII, which other engines match alike; used by the registered queries.
ASCII_RULES = (
    Rule("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "e-mail address", 0.98, needs="@"),
    Rule("ip", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "IPv4 address", 0.8, needs="[0-9]"),
    Rule("card_number", r"\b[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}\b", "payment card, 16 digits", 0.9, needs="[0-9]"),
    Rule("insurance_policy", r"\b[0-9]{16}\b", "insurance policy, 16 digits", 0.65, needs="[0-9]"),
    Rule("phone", r"\+[0-9] \([0-9]{3}\) [0-9]{3}-[0-9]{4}\b", "telephone number", 0.7, needs="[0-9]"),
)


#: Categories of structured rules that can't match without a digit.
_NUMERIC = frozenset("phone passport inn snils bank_account card_number ogrn ogrnip kpp bik date_birth driver_license foreign_passport military_id insurance_policy car_number coordinates".split())


def structured_rules() -> list[Rule]:
    return [Rule(c.lower(), p, d, f, needs=r"(?U)\d" if c.lower() in _NUMERIC else "@" if c.lower() == "email" else "") for c, p, d, f in structured.RULES]


def repaired_line(line: str) -> tuple[str, str, str, str]:
    """category, pattern, description, confidence of a line whose pattern may hold bare commas."""
    category, rest = line.split(",", 1)
    pattern, description, confidence = rest.rsplit(",", 2)
    if len(pattern) > 1 and pattern[0] == pattern[-1] == '"':
        pattern = pattern[1:-1].replace('""', '"')
    return category, pattern, description, confidence


def read_structured(spark: SparkSession, path: str) -> DataFrame:
    """category (lower case), pattern, description, confidence (0.5 if it isn't a number) of a CSV of rules.

    The pattern is all between the first comma and the last two, so bare commas in it are no error; rules without a pattern go.
    """
    line = F.regexp_extract_all("value", F.lit(r"^([^,]*),(.*),([^,]*),([^,]*)$"), F.lit(0))
    parts = [F.regexp_extract("value", r"^([^,]*),(.*),([^,]*),([^,]*)$", i) for i in range(1, 5)]
    rows = spark.read.text(path).where((F.size(line) > 0) & ~F.lower("value").startswith("category,"))
    pattern = F.regexp_replace(F.regexp_replace(F.trim(parts[1]), '^"(.*)"$', "$1"), '""', '"')
    out = rows.select(F.lower(F.trim(parts[0])).alias("category"), pattern.alias("pattern"), F.trim(parts[2]).alias("description"), F.coalesce(parts[3].try_cast("double"), F.lit(0.5)).alias("confidence"))
    return out.where("pattern != ''")


def read_structured_workbook(spark: SparkSession, path: str) -> DataFrame:
    """As read_structured(), of a workbook with the columns category, pattern, description and confidence, in any case."""
    rows = xlsx.read_table(spark, path)
    names = {c.strip().lower(): c for c in reversed(rows.columns)}
    cell = lambda n: F.trim(F.col(f"`{names[n]}`")) if n in names else F.lit(None).cast("string")
    out = rows.select(F.lower(cell("category")).alias("category"), cell("pattern").alias("pattern"), F.coalesce(cell("description"), F.lit("")).alias("description"), F.coalesce(cell("confidence").try_cast("double"), F.lit(0.5)).alias("confidence"))
    return out.where("pattern != ''")


#: Names of the typed rules' categories and methods.
TYPED_CATEGORIES = ("person_name", "organization", "position", "address", "phone", "email", "passport", "inn", "snils", "bank_account", "date", "financial_amount", "other")
TYPED_METHODS = ("regex", "phrase_matcher", "spacy_ner", "morphological", "custom_matcher", "context_matcher", "keyword")
TYPED_PRIORITIES = ("critical", "high", "medium", "low")


def typed_rules(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of typed rules that are valid, and those that aren't.

    Valid are known categories, methods and priorities, confidences from 0 to 1, and patterns that aren't empty.
    """
    known = F.col("category").isin(*TYPED_CATEGORIES) & F.col("method").isin(*TYPED_METHODS) & F.col("priority").isin(*TYPED_PRIORITIES)
    valid = F.coalesce(known & F.col("confidence").between(0, 1) & (F.length("pattern") > 0), F.lit(False))
    return rows.where(valid), rows.where(~valid)


def language_rules() -> list[Rule]:
    """The regex rules among the language rules, with the confidence and case of their category."""
    from ..functions.confidence import DEFAULT, for_regex

    out = []
    for category, kind, priority, pattern in language.RULES:
        if kind != "regex" or not pattern:
            continue
        methods = dict(language.CATEGORIES.get(category, ((), ""))[0])
        base = methods.get("regex", DEFAULT)
        confidence = for_regex(base, pattern, True)  # what is reported has passed the context check
        out.append(Rule(category, pattern, "", confidence, "regex", "regex", priority, ignore_case=category not in language.CASE_SENSITIVE))
    return out


def read_language(spark: SparkSession, path: str) -> DataFrame:
    """category, type, priority, pattern, description, confidence (0.7), context_required (true) of a JSON of language rules.

    `type` may also be called pattern_type; regex rules without a pattern go.
    """
    schema = "patterns array<struct<category string, type string, pattern_type string, priority int, pattern string, description string, confidence double, context_required boolean, replacement string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("patterns").alias("p")).select("p.*")
    rows = rows.withColumns({
        "type": F.coalesce("type", "pattern_type"),
        "priority": F.coalesce("priority", F.lit(1)),
        "confidence": F.coalesce("confidence", F.lit(0.7)),
        "context_required": F.coalesce("context_required", F.lit(True)),
        "pattern": F.coalesce("pattern", F.lit("")),
    })
    return rows.where((F.col("type") != "regex") | (F.col("pattern") != "")).drop("pattern_type")


def lookup(rules: DataFrame, category: str | None = None, kind: str | None = None) -> DataFrame:
    """Rules of a category and a type."""
    if category is not None:
        rules = rules.where(F.col("category") == category)
    return rules if kind is None else rules.where(F.col("type") == kind)


def dictionary(spark: SparkSession, *paths: str) -> DataFrame:
    """word: the distinct lines of the files, trimmed, not empty, with е for ё; a file that isn't there has none."""
    out = spark.createDataFrame([], "word string")
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            lines = spark.read.text(path).select(F.translate(F.trim("value"), "ёЁ", "еЕ").alias("word"))
            out = out.unionByName(lines.where("word != ''"))
    return out.distinct()


#: Government bodies that are looked for where there is no list.
GOVERNMENT_FALLBACK = (
    "министерство", "департамент", "управление", "служба", "комитет", "администрация", "правительство", "дума", "совет",
    "федеральная служба", "государственная дума", "совет федерации", "правительство российской федерации",
)


def government_bodies(spark: SparkSession, *paths: str) -> DataFrame:
    """word: the lines of the lists that are there, else GOVERNMENT_FALLBACK."""
    listed = dictionary(spark, *paths)
    return spark.createDataFrame([(w,) for w in GOVERNMENT_FALLBACK], "word string") if listed.isEmpty() else listed


def checked(spark: SparkSession, rules: Iterable[Rule]) -> tuple[list[Rule], list[tuple[Rule, str]]]:
    """Rules that Java compiles and that don't match the empty string; and the others with the reason."""
    jvm, good, bad = spark.sparkContext._jvm, [], []
    for r in rules:
        try:
            if jvm.java.util.regex.Pattern.compile(r.java()).matcher("").find():
                bad.append((r, "matches the empty string"))
            else:
                good.append(r)
        except Exception as e:
            bad.append((r, str(e).splitlines()[0]))
    return good, bad


def pruned(rules: Iterable[Rule], categories: Iterable[str] | None = None, methods: Iterable[str] | None = None, least: float = 0.0) -> list[Rule]:
    """Enabled rules of these categories and methods with at least this confidence."""
    return [r for r in rules if r.enabled and (categories is None or r.category in set(categories)) and (methods is None or r.method in set(methods)) and r.confidence >= least]


def toggled(rules: Iterable[Rule], enabled: bool, *categories: str) -> list[Rule]:
    """rules with those of the categories switched on or off."""
    return [replace(r, enabled=enabled) if r.category in categories else r for r in rules]


def as_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """One row a rule, with its place as ord."""
    schema = "ord int, category string, pattern string, description string, confidence double, method string, kind string, priority int, enabled boolean, context_required boolean, `group` int, ignore_case boolean, needs string"
    return spark.createDataFrame([(i, *asdict(r).values()) for i, r in enumerate(rules)], schema)


def statistics(rules: Iterable[Rule]) -> dict:
    """Counts of rules: all, enabled, by method and by category."""
    rules = list(rules)
    return {"total": len(rules), "enabled": sum(r.enabled for r in rules), "by_method": dict(Counter(r.method for r in rules)), "by_category": dict(Counter(r.category for r in rules))}


def from_json(text: str) -> list[Rule]:
    """Language rules from a JSON text, regex rules only; for tests and small sets."""
    return [Rule(p["category"], p["pattern"], p.get("description", ""), p.get("confidence", 0.7), "regex", "regex", p.get("priority", 1)) for p in json.loads(text)["patterns"] if p.get("type", p.get("pattern_type")) == "regex" and p.get("pattern")]


def compiles(rule: Rule) -> bool:
    try:
        re.compile(rule.pattern)
    except re.error:
        return False
    return True

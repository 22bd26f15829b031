"""Tables of rules of any size: an index of required literals that names the rules to run on each text.

Most patterns have a literal that every match contains. It is read off the pattern once; of each literal's runs of three characters the one that fewest rules share is
the rule's anchor. A text's distinct runs of three are looked up among the anchors in one pass, whatever the number of rules; only rules whose anchor and then whose whole
literal a text holds are run on it. Rules without a literal of three characters are run on every text.

Of up to FEW patterns each is looked for by the words of its literals among a text's distinct words, without cutting texts into runs: texts are dealt out once, and the patterns come to them. Rules with equal
patterns are run once.

An index of up to BROADCAST rules is broadcast behind a count, beyond it the lookup shuffles. The rules of a block meet its text by (document, block) in one row and are
told apart only in the task that runs them: texts are shuffled and sorted once, whatever the number of rules. A pattern is compiled for each text, which costs less than
carrying the texts to the patterns.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import matches, unmarked
from ..functions.text import grams, plain_spaces
from ..sources.rules import Rule

BROADCAST, SALT = 200_000, 16
#: Patterns that are looked for one by one, and the parts for each core that texts are dealt into for that.
FEW, PARTS = 1_000, 4
COLUMNS = ("rule", "category", "pattern", "description", "confidence", "method")


def required_literals(pattern: Column) -> Column:
    """The runs of characters that every match of a pattern contains, as far as they show, longest first; null where none is found.

    Runs end at escapes, classes, alternatives, groups with anything but plain characters, and optional parts. Patterns with quoting, comments or
    intersections of classes have none, and neither have those with an alternative outside of groups.
    """
    end = "\uE000"
    rest = F.regexp_replace(pattern, r"\\(?:[pP]\{[^}]*\}|[xu][0-9A-Fa-f]+|.)", end)
    rest = F.regexp_replace(rest, r"\[[^\]]*\]", end)
    for _ in range(3):  # plain groups that aren't optional are their content
        rest = F.regexp_replace(rest, r"\((?:\?[:>])?([^()|?*+{}\[\]]*)\)(?![?*{])", "$1")
    for _ in range(3):  # others end a run
        rest = F.regexp_replace(rest, r"\([^()]*\)", end)
    odd = pattern.rlike(r"\(\?[a-z]*x|\\Q|&&") | rest.rlike(r"[|()\[\]]")
    rest = F.regexp_replace(rest, rf"[^{end}](?=[*?]|\{{0)", end)
    rest = F.regexp_replace(rest, r"\{[^}]*\}|[*+?.^$]", end)
    runs = F.transform(F.filter(F.split(rest, end), lambda r: r != ""), lambda r: F.struct(F.length(r).alias("n"), r.alias("r")))
    return F.when(~odd & (F.size(runs) > 0), F.transform(F.sort_array(runs, asc=False), lambda r: r["r"]))


def required_literal(pattern: Column) -> Column:
    """The longest of them."""
    return F.get(required_literals(pattern), F.lit(0))


def from_rules(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """A table of rules as index() and scan() take it, from rules in Python (structured, typed or language ones); a rule's id is its place.

    Rules that report a group of their match are left to extract.scan.
    """
    rows = [(i, r.category, r.java().removeprefix("(?U)"), r.description, float(r.confidence), r.method) for i, r in enumerate(rules) if not r.group]
    return spark.createDataFrame(rows, "rule int, category string, pattern string, description string, confidence double, method string")


def from_table(rows: DataFrame, method: str = "regex") -> DataFrame:
    """The same from a table of rules (category, pattern, and perhaps description, confidence, type), as the readers in sources.rules give them.

    Of rows with a type only regular expressions are rules; (?i) at the beginning of a pattern holds for all letters. A rule's id is a hash of its category
    and pattern, so repeated rows are one rule.
    """
    if "type" in rows.columns:
        rows = rows.where("type = 'regex'")
    pattern = F.regexp_replace("pattern", r"^\(\?i\)", "(?iu)")
    of = lambda name, kind, value: F.coalesce(F.col(name).cast(kind), F.lit(value)) if name in rows.columns else F.lit(value)
    rows = rows.select(F.xxhash64("category", "pattern").alias("rule"), "category", pattern.alias("pattern"), of("description", "string", "").alias("description"), of("confidence", "double", 0.5).alias("confidence"), F.lit(method).alias("method"))
    return rows.dropDuplicates(["rule"])


def folded(text: Column) -> Column:
    """A form that is equal for all texts that match each other in any case."""
    upper = F.replace(F.upper(F.replace(plain_spaces(text), F.lit("İ"), F.lit("I"))), F.lit("ẞ"), F.lit("SS"))
    return F.replace(F.lower(upper), F.lit("ς"), F.lit("σ"))


def index(rules: DataFrame) -> DataFrame:
    """COLUMNS, literal and anchor (null: run on every text) of rules (COLUMNS; rule is an id of its own kind)."""
    rows = rules.where(F.col("pattern").isNotNull() & (F.col("pattern") != "")).select(*COLUMNS, folded(required_literal(F.col("pattern"))).alias("literal"))
    runs = rows.select("rule", F.explode(grams(F.col("literal"))).alias("gram"))
    shared = runs.groupBy("gram").agg(F.count(F.lit(1)).alias("rules"))
    anchors = runs.join(shared, "gram").groupBy("rule").agg(F.min(F.struct("rules", "gram")).alias("a")).select("rule", F.col("a.gram").alias("anchor"))
    return rows.join(anchors, "rule", "left")


def candidates(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, block_id, text, COLUMNS: the rules of an index that may match a block, and those without an anchor for each."""
    anchored = known.where("anchor IS NOT NULL")
    runs = blocks.select("doc_id", "block_id", F.explode(grams(folded(F.col("text")))).alias("anchor"))
    small = anchored.count() <= BROADCAST
    if small:
        hits = runs.join(F.broadcast(anchored.select("rule", "anchor")), "anchor")
    else:  # then the rules come along whole, so that no join has texts repeated by rule
        salted = anchored.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        hits = runs.withColumn("salt", F.pmod(F.xxhash64("doc_id", "block_id"), F.lit(SALT)).cast("int")).join(salted, ["anchor", "salt"])
    carried = ["rule"] if small else [*COLUMNS, "literal"]
    named = hits.groupBy("doc_id", "block_id").agg(F.collect_list(F.struct(*carried)).alias("rules"))
    texts = blocks.select("doc_id", "block_id", plain_spaces(F.col("text")).alias("text"))
    few = texts.join(named, ["doc_id", "block_id"]).withColumn("folded", folded(F.col("text"))).withColumn("r", F.explode("rules")).select("doc_id", "block_id", "text", "folded", "r.*")
    few = (few.join(F.broadcast(anchored), "rule") if small else few).where(F.contains("folded", F.col("literal")))
    always = known.where("anchor IS NULL").agg(F.collect_list(F.struct(*COLUMNS)).alias("r"))  # one row: the rules that can't be anchored
    rest = texts.join(F.broadcast(always)).select("doc_id", "block_id", "text", F.explode("r").alias("r")).select("doc_id", "block_id", "text", "r.*")
    return few.select("doc_id", "block_id", "text", *COLUMNS).unionByName(rest)


def _ascii() -> Column:
    """Whether text and pattern are ASCII and the pattern names no class of characters by number or property: then (?U) changes nothing, and is slow."""
    return _ascii_text() & _plain_pattern()


def _ascii_text() -> Column:
    return F.octet_length("text") == F.length("text")


def _plain_pattern() -> Column:
    return F.col("pattern").rlike(r"\A[\x00-\x7F]*\z") & ~F.col("pattern").rlike(r"\\[^bBdDsSwWntrf.()\[\]{}|*+?^$/-]|\(\?[a-zA-Z-]*[uUx]|\[:|&&")


def _word_first() -> Column:
    """An equal pattern that begins with a word's letters instead of \\b and them, as Java then looks at far fewer places of a text."""
    turned = F.regexp_replace("pattern", r"^\\b([A-Za-z0-9]+)(?![A-Za-z0-9*+?{])", r"$1(?<=\\b$1)")
    return F.when(required_literals(F.col("pattern")).isNotNull(), turned).otherwise(F.col("pattern"))


def scan(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """Detections of all rules of a table (COLUMNS) in blocks, the same as if each were run on each block; patterns are Java's.

    Patterns must be valid and not match the empty string (see validated()); rules without a pattern are left out. ord is the match's place among its rule's in a
    block. Null and empty texts have no detections; (doc_id, block_id) must name one block. A rule is known by `rule`, which goes along.
    """
    texts = blocks.select("doc_id", "block_id", unmarked(F.col("text")).alias("text"))
    known = rules.where(F.col("pattern").isNotNull() & (F.col("pattern") != ""))
    if known.select("pattern").distinct().count() <= min(FEW, BROADCAST):
        rows = _met(texts, known)
    else:
        rows = candidates(texts, index(rules)).select("doc_id", "block_id", "text", _ascii().alias("plain"), _word_first().alias("pattern"), F.array(F.struct(*COLUMNS)).alias("rules"))
    found = matches(F.col("text"), F.concat(F.when(F.col("plain"), "").otherwise("(?U)"), F.col("pattern")), clean=True)
    rows = rows.select("doc_id", "block_id", "rules", F.posexplode_outer(found).alias("ord", "m")).where("m IS NOT NULL")  # without outer, Spark would find matches twice, first to see whether there are any
    rows = rows.select("doc_id", "block_id", "ord", "m", F.explode("rules").alias("r"))
    return rows.select("doc_id", "block_id", "r.category", F.col("m.value").alias("original_value"), F.col("m.start").alias("start"), F.col("m.end").alias("end"), "r.confidence", "r.method", "r.description", "r.rule", "ord")


def _pieces(text: Column) -> Column:
    """A text cut at white space and common marks; what a text holds, its pieces hold piece by piece, and a text's distinct ones are fewer than its letters."""
    return F.filter(F.split(text, r"""[\s.,;:!?()"]+"""), lambda x: x != "")


def _met(texts: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, block_id, text, plain, pattern, rules: the patterns of a small table whose literals a block holds, with the rules that have them."""
    each = known.groupBy("pattern").agg(F.collect_list(F.struct(*COLUMNS)).alias("rules"))
    literals = F.flatten(F.transform(F.coalesce(required_literals(F.col("pattern")), F.array().cast("array<string>")), lambda x: _pieces(folded(x))))
    each = each.select(_word_first().alias("pattern"), _plain_pattern().alias("plain"), literals.alias("literals"), "rules")
    every = each.agg(F.collect_list(F.struct("pattern", "plain", "literals", "rules")).alias("every"))  # one row
    texts = texts.repartition(PARTS * texts.sparkSession.sparkContext.defaultParallelism, "doc_id", "block_id")
    texts = texts.select("doc_id", "block_id", plain_spaces(F.col("text")).alias("text")).withColumn("ascii", _ascii_text())
    texts = texts.withColumn("words", F.array_join(F.array_distinct(_pieces(folded(F.col("text")))), " "))
    held = F.filter("every", lambda p: F.forall(p["literals"], lambda x: F.contains(F.col("words"), x)))
    rows = texts.join(F.broadcast(every)).select("doc_id", "block_id", "text", "ascii", F.explode_outer(held).alias("p")).where("p IS NOT NULL")
    return rows.select("doc_id", "block_id", "text", (F.col("ascii") & F.col("p.plain")).alias("plain"), "p.pattern", "p.rules")


def validated(rules: DataFrame) -> DataFrame:
    """rules with valid, and reason where they aren't: no pattern, one that Java doesn't compile, or one that matches the empty string."""
    java = F.lit("java.util.regex.Pattern")
    pattern = F.concat(F.lit("(?U)"), F.col("pattern"))
    compiled = F.try_reflect(java, F.lit("compile"), pattern)
    empty = F.try_reflect(java, F.lit("matches"), pattern, F.lit(""))
    reason = F.when(F.coalesce(F.col("pattern"), F.lit("")) == "", "no pattern").when(compiled.isNull(), "doesn't compile").when(empty == "true", "matches the empty string")
    return rules.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())

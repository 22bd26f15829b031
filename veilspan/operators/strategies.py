"""Strategies that combine a category's detections by method, chosen by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.spans import overlap_ratio
from ..sources.data import language
from ..sources.rules import Rule
from . import dictionary, extract, intervals, morphology, tokens
from .extract import false_positive, organisation_type

BLOCK = ("doc_id", "block_id")
Strategy = Callable[[DataFrame], DataFrame]


def _folded(fold: Callable[[Column], Column]) -> Strategy:
    return lambda detections: intervals.resolve(detections, fold, *BLOCK)


def hybrid_government(detections: DataFrame, patterns: tuple[str, ...] = (), boost: float = 0.1, phrase: float = 0.98) -> DataFrame:
    """Known phrases first, at a fixed confidence; then entities that aren't false positives and overlap none of them by half.

    Entities of government bodies gain confidence, up to 0.95. By start, anchors take what overlaps them by 0.3; of each group the
    best method and then the highest confidence (government 0.1 more) stays.
    """
    kinds = detections.where(F.col("method").isin("phrase_matcher", "context_matcher", "spacy_ner"))
    entity = F.col("method") == "spacy_ner"
    kind = F.when(entity, organisation_type(F.col("original_value"))).otherwise(F.lit("government"))
    raised = F.when(~entity, F.lit(phrase)).when(kind == "government", F.least(F.lit(0.95), F.col("confidence") + boost)).otherwise(F.col("confidence"))
    rows = kinds.where(~entity | ~false_positive(F.col("original_value"), patterns)).withColumns({"organization_type": kind, "confidence": raised})

    def fold(spans: Column) -> Column:
        is_phrase = lambda s: s["method"] != "spacy_ner"
        ordered = F.concat(F.filter(spans, is_phrase), F.filter(spans, lambda s: ~is_phrase(s)))
        kept = F.aggregate(ordered, F.slice(ordered, 1, 0), lambda a, s: F.when(is_phrase(s) | ~F.exists(a, lambda k: overlap_ratio(s, k) >= 0.5), F.concat(a, F.array(s))).otherwise(a))
        by_start = F.transform(F.array_sort(F.transform(kept, lambda s, i: F.struct(s["start"].alias("a"), i.alias("i"), s.alias("s")))), lambda x: x["s"])
        groups = intervals.anchor_groups(by_start, lambda a, s: overlap_ratio(a, s) >= 0.3)
        cost = lambda s: F.struct(F.when(is_phrase(s), -3).otherwise(-2).alias("m"), (-(s["confidence"] + F.when(s["organization_type"] == "government", 0.1).otherwise(0.0))).alias("c"))
        best = lambda g: F.array_min(F.transform(g, lambda s, i: F.struct(cost(s).alias("c"), i.alias("i"))))["i"]
        return F.transform(groups, lambda g: F.get(g, best(g)))

    out = intervals.resolve(rows, fold, *BLOCK)
    return out.withColumns({"category": F.lit("government_org"), "method": F.concat(F.lit("hybrid_"), "method")})


STRATEGIES: dict[str, Strategy] = {
    "best_confidence": _folded(intervals.best_confidence),
    "combine_all": _folded(intervals.combine_all),
    "first_match": _folded(intervals.first_match),
    "weighted_average": _folded(lambda s: intervals.weighted_average(s, language.METHOD_WEIGHTS)),
    "hybrid_government": hybrid_government,
    "information_system": _folded(lambda s: intervals.suppress(s, 0.6)),
    "contract_number": _folded(lambda s: intervals.suppress(s, 0.7)),
}


def strategy(name: str) -> Strategy:
    if name not in STRATEGIES:
        raise ValueError(f"no strategy {name}; there are {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[name]


def early_exit(detections: DataFrame, priorities: dict[str, int], exits: dict[str, float], default: float = 0.95) -> DataFrame:
    """Without methods after the first (by priority) that has a detection at or over its exit confidence, block by block."""
    place, limit = F.lit(max(priorities.values(), default=0) + 1), F.lit(default)
    for method, p in priorities.items():
        place = F.when(F.col("method") == method, F.lit(p)).otherwise(place)
        limit = F.when(F.col("method") == method, F.lit(exits.get(method, default))).otherwise(limit)
    rows = detections.withColumn("_place", place)
    last = F.min(F.when(F.col("confidence") >= limit, F.col("_place"))).over(Window.partitionBy(*BLOCK))
    return rows.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("_place") <= F.col("_last"))).drop("_place", "_last")


def thresholds(detections: DataFrame, by_method: dict[tuple[str, str], float], least: float = language.LEAST_CONFIDENCE) -> DataFrame:
    """Detections that reach the least confidence of their category and method, and the general one."""
    limit = F.lit(0.0)
    for (category, method), value in by_method.items():
        limit = F.when((F.col("category") == category) & (F.col("method") == method), F.lit(value)).otherwise(limit)
    return detections.where((F.col("confidence") >= limit) & (F.col("confidence") >= least))


def capped(detections: DataFrame, most: int = language.MOST_OF_CATEGORY) -> DataFrame:
    """The `most` detections with the highest confidence of each block and category; ord breaks ties."""
    line = Window.partitionBy(*BLOCK, "category").orderBy(-F.col("confidence"), "ord")
    return detections.withColumn("_n", F.row_number().over(line)).where(F.col("_n") <= most).drop("_n")


def _numbered(detections: DataFrame, order: dict[str, int]) -> DataFrame:
    """ord anew within each block: by category in the given order, then as before."""
    place = F.lit(len(order))
    for category, p in order.items():
        place = F.when(F.col("category") == category, F.lit(p)).otherwise(place)
    return detections.withColumn("ord", F.row_number().over(Window.partitionBy(*BLOCK).orderBy(place, "pos", "ord")))


def language_detections(candidates: DataFrame) -> DataFrame:
    """From raw detections by category and method to the language result.

    Per category: thresholds, early exit, its strategy and cap; then over all categories in their order the global dedup by
    anchors, and the general threshold.
    """
    order, parts = {}, []
    for i, (category, (methods, name)) in enumerate(language.CATEGORIES.items()):
        order[category] = i
        rows = candidates.where(F.col("category") == category)
        rows = thresholds(rows, {(category, m): c for m, c in methods}, 0.0)
        if name != "hybrid_government":
            exits = {m: language.EARLY_EXIT[category, m] for m, _ in methods if (category, m) in language.EARLY_EXIT}
            rows = early_exit(rows, {m: k for k, (m, _) in enumerate(methods)}, exits)
        parts.append(capped(strategy(name)(rows)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out = _numbered(out, order).drop("pos")
    out = intervals.resolve(out, intervals.global_dedup, *BLOCK).drop("pos")
    return out.where(F.col("confidence") >= language.LEAST_CONFIDENCE)


def every_extractor(blocks: DataFrame, rules: Sequence[Rule], words: dict[str, Sequence[str]], phrases: DataFrame, resolved: DataFrame, context: Sequence[str], legal_forms: Sequence[str] = tokens.LEGAL_FORMS, models: DataFrame | None = None) -> DataFrame:
    """What all extractors find, whatever the category, one after the other; nothing is resolved, and ord is anew in each block.

    Models' detections (if given); rules, with words of their category near where the rule wants context; phrases of a dictionary (phrase, category,
    confidence); names by morphology and patterns of tokens, by resolved words (morphology.resolve). Null and empty texts have no detections.
    """
    wanting, others = [r for r in rules if r.context_required], [r for r in rules if not r.context_required]
    rows = tokens.exploded(blocks)
    parts = [models] if models is not None else []
    parts += [extract.scan_with_context(blocks, wanting, words)] if wanting else []
    parts += [extract.scan(blocks, others)] if others else []
    parts += [dictionary.match(blocks, phrases), morphology.names(blocks, resolved, context), tokens.matched(morphology.with_tags(rows, resolved), tokens.patterns(legal_forms))]
    out = None
    for k, part in enumerate(parts):
        part = part.select(*extract.COLUMNS).withColumn("_part", F.lit(k))
        out = part if out is None else out.unionByName(part)
    line = Window.partitionBy(*BLOCK).orderBy("_part", "start", "end", "ord", "category", "method")
    return out.withColumn("ord", F.row_number().over(line)).drop("_part")

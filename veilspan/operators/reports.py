"""Reports: counts, statistics, tables and ledgers of detections, replacements and restores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def band(confidence: Column) -> Column:
    """high over 0.8, medium over 0.5, else low."""
    return F.when(confidence > 0.8, "high").when(confidence > 0.5, "medium").otherwise("low")


def by_category(detections: DataFrame) -> DataFrame:
    """category, band, n."""
    return detections.groupBy("category", band(F.col("confidence")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def summary(detections: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row: blocks, blocks with data, detections, and those of high, medium and low confidence, by rules and by language."""
    rule = F.col("method") == "regex"
    b = band(F.col("confidence"))
    found = detections.agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct("doc_id", "block_id").alias("blocks_with_data"), *(F.count_if(b == k).alias(k) for k in ("high", "medium", "low")), F.count_if(rule).alias("by_regex"), F.count_if(~rule).alias("by_language")
    )
    return blocks.agg(F.count(F.lit(1)).alias("total_blocks")).crossJoin(found)  # one row each


def totals(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row: items, of rules, of language, blocks; found has the column source."""
    rows = found.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("source") == "Rule Engine").alias("rule_items"), F.count_if(F.col("source") == "NLP Service").alias("language_items"), F.lit(0).cast("long").alias("duplicates_removed"))
    return rows.crossJoin(blocks.agg(F.count(F.lit(1)).alias("blocks")))  # one row each


def replacement_statistics(replacements: DataFrame) -> DataFrame:
    """category, attempts, successes of replacements; each is counted once."""
    return replacements.groupBy("category").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("success").alias("successes"))


def replacement_table(replacements: DataFrame) -> DataFrame:
    """doc_id, number, original_value, uuid, block_id: numbered within each document by block and start."""
    line = Window.partitionBy("doc_id").orderBy("block_id", "start", "end", "ord")
    return replacements.select("doc_id", F.row_number().over(line).alias("number"), "original_value", "uuid", "block_id")


def ledger(replacements: DataFrame) -> DataFrame:
    """doc_id, ledger: a JSON text with the number of replacements, their categories and each one, in order."""
    item = F.struct("block_id", "start", "end", "ord", "uuid", "category", "original_value", "confidence")
    rows = replacements.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("r"))
    counts = F.transform(F.array_sort(F.array_distinct(F.transform("r", lambda x: x["category"]))), lambda c: F.struct(c.alias("category"), F.size(F.filter("r", lambda x: x["category"] == c)).alias("n")))
    out = F.struct(
        F.size("r").alias("total_matches"), counts.alias("categories"),
        F.transform("r", lambda x: F.struct(x["uuid"].alias("uuid"), x["category"].alias("category"), x["original_value"].alias("original_value"), x["block_id"].alias("block_id"), F.struct(x["start"].alias("start"), x["end"].alias("end")).alias("position"), x["confidence"].alias("confidence"))).alias("replacements"),
    )
    return rows.select("doc_id", F.to_json(out).alias("ledger"))


def restore_statistics(found: DataFrame) -> DataFrame:
    """One row: uuids found, restored, failed, and the percentage restored (0 if none is found)."""
    out = found.agg(F.count(F.lit(1)).alias("found"), F.count_if("success").alias("restored"), F.count_if(~F.col("success")).alias("failed"))
    return out.withColumn("percent", F.round(F.col("restored") * 100 / F.greatest(F.lit(1), F.col("found")), 1))


def mapping_statistics(replacements: DataFrame) -> DataFrame:
    """One row: replacements, different texts, different uuids."""
    return replacements.agg(F.count(F.lit(1)).alias("total"), F.count_distinct("original_value").alias("unique_texts"), F.count_distinct("uuid").alias("unique_uuids"))


def rule_statistics(rules: DataFrame) -> DataFrame:
    """category, method, rules, enabled, mean_confidence of a table of rules."""
    return rules.groupBy("category", "method").agg(F.count(F.lit(1)).alias("rules"), F.count_if("enabled").alias("enabled"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def rule_listing(rules: DataFrame) -> DataFrame:
    """category, n, kinds, descriptions."""
    return rules.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.array_join(F.array_sort(F.collect_list("description")), "; ").alias("descriptions"))


def profile(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, total, mean, least, most, median of value; nulls count as no value."""
    v = F.col(value)
    return rows.groupBy(by).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.median(v).alias("median"))


def slowest(rows: DataFrame, value: str, ties: str, n: int = 5) -> DataFrame:
    return rows.orderBy(F.col(value).desc_nulls_last(), ties).limit(n)


def shares(rows: DataFrame, by: str) -> DataFrame:
    """by, n, percent of all rows."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def review(items: DataFrame) -> DataFrame:
    """category, total, approved, excluded, mean_confidence of items in review."""
    yes = F.coalesce(F.col("approved"), F.lit(False))
    return items.groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.count_if(yes).alias("approved"), F.count_if(~yes).alias("excluded"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def metadata_summary(properties: DataFrame) -> DataFrame:
    """doc_id, section, n of metadata (doc_id, section, property, value)."""
    return properties.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n"))


def preview(rows: DataFrame, *order: str, n: int = 3) -> DataFrame:
    """The first n rows in an order."""
    return rows.orderBy(*order).limit(n)


def replacement_report(replacements: DataFrame) -> DataFrame:
    """One row: total, categories (a map of counts; a missing category is `unknown`), and replacements of high, medium and low confidence (missing: 1)."""
    rows = replacements.select(F.coalesce("category", F.lit("unknown")).alias("category"), band(F.coalesce("confidence", F.lit(1.0))).alias("band"))
    counts = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("band") == k).alias(k) for k in ("high", "medium", "low")))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("n", "total"), ("high", "high"), ("medium", "medium"), ("low", "low"))]
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("categories"), *sums)


def run_metrics(timings: DataFrame, parse: str, work: str, found: DataFrame) -> DataFrame:
    """One row: total, parse and work time of timings (stage, seconds), items by source of found, and the parse time over the work time (null without work)."""
    seconds = lambda name: F.coalesce(F.sum(F.when(F.col("stage") == name, F.col("seconds"))), F.lit(0.0))
    times = timings.agg(F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("total"), seconds(parse).alias("parse"), seconds(work).alias("work"))
    times = times.select(*(F.round(c, 2).alias(f"{c}_seconds") for c in ("total", "parse", "work")), F.round(F.try_divide("parse", "work"), 1).alias("ratio"))
    items = found.agg(F.count_if(F.col("source") == "Rule Engine").alias("rule_items"), F.count_if(F.col("source") == "NLP Service").alias("language_items"))
    return times.crossJoin(items)  # one row each


def profile_export(timings: DataFrame, value: str, *by: str) -> DataFrame:
    """dimension, name, record: a JSON record of n, total, mean, least and most of the value for each name of each column in `by`.

    For write.json(); beside it slowest() has the bottlenecks, and the timings themselves are a table already.
    """
    out = None
    for c in by:
        rows = profile(timings.where(F.col(c).isNotNull()), c, value)
        record = F.to_json(F.struct("n", *(F.round(k, 3).alias(k) for k in ("total", "mean", "least", "most"))))
        rows = rows.select(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("name"), record.alias("record"))
        out = rows if out is None else out.unionByName(rows)
    return out

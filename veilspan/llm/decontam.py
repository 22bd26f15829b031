"""Benchmark decontamination by winnowing (DataFrame operations only).

Texts become words; every run of K words gets a hash, and of each WINDOW consecutive words the smallest hash of its runs
is kept as fingerprint. Two texts that share a window of WINDOW words share its fingerprint, so a join of fingerprints
loses nothing. What it finds is extended to whole windows, which are compared word by word. Items with fewer words are one
window of that length, fingerprinted whole.

The first pass keeps only texts with a fingerprint of the benchmark (by the MD5 of the text, so copies are worked on once);
the second extends the hits of those. Windows are exploded without their text's words, so a row stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, split_words, text_of, written

#: What stands between words, once A-Z is lower-cased, and before.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, K = 10, 5
#: Fingerprints of the benchmark (8 bytes each) and keys of texts with one (32 bytes) are broadcast up to these numbers;
#: beyond, the joins shuffle.
BROADCAST_PRINTS, BROADCAST_KEYS = 1_000_000, 200_000


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return split_words(ascii_lower(text), GAPS)


def _span(n: Column) -> Column:
    """0 to n - 1; none for n under 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _run_hashes(hashes: Column, length: int) -> Column:
    return F.transform(_span(F.size(hashes) - length + 1), lambda i: F.xxhash64(F.lit(length), *(F.get(hashes, i + j) for j in range(length))))


def _fingerprints(hashes: Column, lengths: list[int]) -> dict[int, Column]:
    """By window length, the fingerprint of the window that starts at each word."""
    out = {n: _run_hashes(hashes, n) for n in lengths if n != WINDOW}
    if WINDOW in lengths:
        runs = WINDOW - K + 1
        out[WINDOW] = _let(
            _run_hashes(hashes, K),
            lambda g: F.transform(_span(F.size(g) - runs + 1), lambda i: F.least(*(F.get(g, i + j) for j in range(runs)))),
        )
    return out


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _starts(words: Column, lengths: list[int]) -> Column:
    """Structs of start, len and print of all windows of these lengths."""

    def of_length(n: int):
        return lambda p: F.transform(p, lambda x, i: F.struct(i.alias("start"), F.lit(n).alias("len"), x.alias("print")))

    return _let(_hashes(words), lambda h: F.concat(*(_let(p, of_length(n)) for n, p in _fingerprints(h, lengths).items())))


def _with_words(words: Column, starts: Column) -> Column:
    """starts with the window's words."""
    return F.transform(starts, lambda s: F.struct(s["start"].alias("start"), s["len"].alias("len"), s["print"].alias("print"), F.array_join(F.slice(words, s["start"] + 1, s["len"]), " ").alias("window")))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """print, len, window, items: each distinct window of the benchmark and the ids of the items that hold it."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), _words(text_of(benchmark)).alias("words")).where(F.size("words") > 0)
    long_ = items.where(F.size("words") >= WINDOW).select("item", F.explode(_with_words(F.col("words"), _starts(F.col("words"), [WINDOW]))).alias("w"))
    short = items.where(F.size("words") < WINDOW)
    short = short.select(
        "item",
        F.struct(
            F.lit(0).alias("start"),
            F.size("words").alias("len"),
            _short_print(F.col("words")).alias("print"),
            F.array_join("words", " ").alias("window"),
        ).alias("w"),
    )
    return long_.unionByName(short).groupBy("w.print", "w.len", "w.window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _short_print(words: Column) -> Column:
    """The fingerprint of an item that is one short window, as _run_hashes() makes it."""
    out = F.lit(None).cast("long")
    for n in range(1, WINDOW):
        out = F.when(F.size(words) == n, F.get(_run_hashes(_hashes(words), n), F.lit(0))).otherwise(out)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """Each row of docs with the words that a window of the benchmark covers.

    Returns row (a struct of the columns in keep), n_words, n_hit, items (ids of items with a window in the text, as sorted strings).
    A null or empty text has no words and no hit; an item without words is never found; repeated items and null item ids (as
    the empty text) count once. Equal texts get equal results; the order of rows doesn't matter. Empty tables give no rows, or
    no hits. Columns may have any names. Very long texts are worked on whole: windows are exploded without their text.
    """
    table = written(benchmark_windows(benchmark), "decontam-windows")
    lengths = sorted(r.len for r in table.select("len").distinct().collect())  # at most WINDOW values
    n_words = F.size(split_words(text_of(docs), ANY_CASE_GAPS)).cast("long").alias("n_words")
    rows = docs.select(F.struct(*(docs[c] for c in keep)).alias("row"), F.md5(text_of(docs)).alias("_key"), n_words)
    none = F.array().cast("array<string>")
    if not lengths:
        return rows.select("row", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("items"))
    prints = table.select("print").distinct()
    if prints.count() <= BROADCAST_PRINTS:
        prints = F.broadcast(prints)

    texts = docs.select(F.md5(text_of(docs)).alias("_key"), text_of(docs).alias("_text"))
    every = _let(_hashes(_words(F.col("_text"))), lambda h: F.array_distinct(F.concat(*_fingerprints(h, lengths).values())))
    found = texts.select("_key", F.explode(every).alias("print")).join(prints, "print", "left_semi").groupBy("_key").agg(F.collect_set("print").alias("_prints"))
    found = written(found, "decontam-found")

    keys = found.select("_key")
    texts = texts.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "_key", "left_semi")
    texts = written(texts.groupBy("_key").agg(F.first("_text").alias("_text")), "decontam-texts")  # a task sends a text once, however often it has it
    starts = texts.select("_key", F.explode(_let(_words(F.col("_text")), lambda w: _starts(w, lengths))).alias("s")).select("_key", "s.*")
    starts = starts.join(found.select("_key", F.explode("_prints").alias("print")), ["_key", "print"], "left_semi")
    starts = starts.groupBy("_key").agg(F.collect_list(F.struct("start", "len", "print")).alias("_starts"))
    hit = texts.join(starts, "_key")
    hit = hit.select("_key", F.explode(_let(_words(F.col("_text")), lambda w: _with_words(w, F.col("_starts")))).alias("w")).select("_key", "w.*")
    hit = hit.join(table, ["print", "len", "window"])
    hit = hit.groupBy("_key").agg(
        F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("len")).alias("end")))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")),
        lambda a: a["n"],
    )
    hit = written(hit.select("_key", covered.cast("long").alias("_n_hit"), "_items"), "decontam-hits")
    out = rows.join(hit, "_key", "left")
    return out.select("row", "n_words", F.coalesce("_n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("_items", none).alias("items"))


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """The digest of contamination() of all documents by all items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])
    return out.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents
), b AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark
), bp AS (
  SELECT item, w, least(len(w), 10) AS n, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(w, i + 1, i + n), ' ') AS s FROM bp
), dp AS (
  SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n
), hits AS (
  SELECT doc_id, i, dp.n, item FROM dp JOIN bw ON dp.n = bw.n AND array_to_string(list_slice(w, i + 1, i + dp.n), ' ') = s
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

"""Source divergence audit by two-dimensional tiling of blocks of groups.

A group is a (lang, source). Its occurrences of each kept term of the language give a smoothed share p, in parts of SCALE; the
divergence of a group from another share q of the same term is floor((p - q)^2 / q). Every pair of sources of a language is compared over all
its kept terms, and every group with its language as a whole, term by term. All arithmetic is exact.

Tasks count the terms of their texts in bounded tables and send partial counts, so that a hot source or language costs a row a term and
task. One shuffle by (lang, term) adds them up and finds the terms in enough documents. A language's terms are dealt by hash into chunks of
about CHUNK, its sources into blocks of about BLOCK, and the counts of one block in one chunk are packed into one row. Each packed row goes to
the tiles (block by block, once for both directions) that need it. A tile's task walks through the chunks of one stripe, at most STRIPE, and
adds up its pair submatrix; the submatrices of stripes are summed. So a task holds two blocks of one chunk and its stripe's packed rows,
whatever the number of sources, terms or documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, written

#: Documents of its language that a kept term is in, at least; ranks of part `term`.
MIN_DOCS, TOP_TERMS = 3, 200
SCALE = 1_000_000_000
#: Terms in a chunk and sources in a block, about; chunks in a stripe, at most.
CHUNK, BLOCK, STRIPE = 2048, 32, 32
#: Counts that a task holds before it sends them on.
HELD = 200_000
#: Terms are runs of letters and of anything beyond ASCII: other bytes end them, and A-Z are lower-cased.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 97 and b <= 122 or b >= 128 else 32 for b in range(256))
_KEYS = ["lang", "source"]


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text. (Bytes are only split at ASCII white space, which the table leaves as ends of terms alone.)"""
    return text.translate(_TABLE).split()


def _sent(groups: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    """The counts of each group, and a row with an empty term, which says that the group occurs."""
    for (lang, source), (n, df) in groups.items():
        terms = [b"", *n]
        columns = [pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)), pa.array(terms, pa.binary()).view(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(df[t] for t in n)], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "df"])
    groups.clear()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in _KEYS), batch.column("text"), strict=True):
            n, df = groups.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            terms = terms_of(text.as_buffer().to_pybytes())
            n.update(terms)
            df.update(set(terms))
            held += len(n) - before
            if held >= HELD:
                yield from _sent(groups)
                held = 0
    yield from _sent(groups)


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exactly."""
    over = (count.cast("decimal(18,0)") + 1) * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", over, (total + terms).cast("decimal(18,0)")) + 1


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def shares(counts: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    """The same of a row of counts for each total; long division by thousands keeps every step below 2**63."""
    over = (totals + terms)[:, None]
    rest, out = counts + 1, np.zeros(counts.shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // over
        rest = rest % over
    return out + 1


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each row of p, each row of q: the sum over the columns of floor((p - q)^2 / q)."""
    out = np.empty((len(p), len(q)), np.int64)
    for i, row in enumerate(p):
        apart = row - q
        out[i] = (apart * apart // q).sum(1)
    return out


def _tile(table: pa.Table) -> pa.Table:
    """Sums of divergences for the pairs of sources of two blocks, over the chunks of one stripe."""
    rows = table.sort_by([("chunk", "ascending"), ("block", "ascending")]).to_batches(max_chunksize=1)
    names: dict[int, list[str]] = {}
    sums: dict[tuple[int, int], np.ndarray] = {}
    lang, low, high = (table.column(c)[0].as_py() for c in ("lang", "low", "high"))
    held: tuple[int, np.ndarray] | None = None

    def add(key: tuple[int, int], value: np.ndarray) -> None:
        sums[key] = sums[key] + value if key in sums else value

    for row in rows:
        one = {c: row.column(c)[0] for c in ("block", "chunk", "width", "terms", "sources", "totals", "cells")}
        block, chunk, width = (one[c].as_py() for c in ("block", "chunk", "width"))
        names[block] = one["sources"].as_py()
        counts = np.zeros(len(names[block]) * width, np.int64)
        if one["cells"].is_valid and len(one["cells"].values):
            cells = one["cells"].values
            counts[cells.field("cell").to_numpy(zero_copy_only=False)] = cells.field("n").to_numpy(zero_copy_only=False)
        p = shares(counts.reshape(len(names[block]), width), np.array(one["totals"].as_py(), np.int64), one["terms"].as_py())
        if low == high:
            add((low, low), divergences(p, p))
        elif block == low:
            held = (chunk, p)
        else:
            assert held is not None and held[0] == chunk
            add((low, high), divergences(held[1], p))
            add((high, low), divergences(p, held[1]))
    out: dict[str, list] = {"source": [], "item": [], "value": []}
    for (a, b), matrix in sums.items():
        for i, source in enumerate(names[a]):
            for j, item in enumerate(names[b]):
                if a != b or i != j:
                    out["source"].append(source)
                    out["item"].append(item)
                    out["value"].append(int(matrix[i, j]))
    n = len(out["value"])
    return pa.table([pa.array([lang] * n, pa.string()), pa.array(out["source"], pa.string()), pa.array(out["item"], pa.string()), pa.array(out["value"], pa.int64())], ["lang", "source", "item", "value"])


def _dealt(what: Column, number: Column, size: int) -> Column:
    """A part of about `size` things for each, by hash; one part at least."""
    return F.pmod(F.xxhash64(what), F.greatest(F.ceil(number / size), F.lit(1))).cast("int")


def _parts(groups: DataFrame, kept: DataFrame, langs: DataFrame) -> DataFrame:
    """The packed counts of each block of sources in each chunk of terms: lang, block, chunk, width, terms, sources, totals, cells."""
    blocks = groups.withColumn("block", _dealt(F.col("source"), F.col("n_sources"), BLOCK))
    place = F.row_number().over(Window.partitionBy("lang", "block").orderBy("source")) - 1
    blocks = blocks.select("lang", "source", "total", "block", place.cast("int").alias("place"))
    heads = kept.where("head").join(langs, "lang").select("lang", "term", _dealt(F.col("term"), F.col("terms"), CHUNK).alias("chunk"))
    inside = Window.partitionBy("lang", "chunk")
    heads = heads.select("lang", "term", "chunk", (F.row_number().over(inside.orderBy("term")) - 1).cast("int").alias("at"), F.count(F.lit(1)).over(inside).cast("int").alias("width"))
    counts = kept.select("lang", "source", "term", "n").join(heads, ["lang", "term"]).join(blocks.select("lang", "source", "block", "place"), ["lang", "source"])
    cell = F.struct((F.col("place") * F.col("width") + F.col("at")).alias("cell"), F.col("n").alias("n"))
    packed = counts.groupBy("lang", "block", "chunk").agg(F.collect_list(cell).alias("cells"))
    named = F.array_sort(F.collect_list(F.struct("place", "source", "total")))
    blocks = blocks.groupBy("lang", "block").agg(named.alias("named")).select("lang", "block", F.col("named.source").alias("sources"), F.col("named.total").alias("totals"))
    widths = heads.groupBy("lang", "chunk").agg(F.count(F.lit(1)).cast("int").alias("width"))
    chunks = F.explode(F.sequence(F.lit(0), (F.greatest(F.ceil(F.col("terms") / CHUNK), F.lit(1)) - 1).cast("int")))
    grid = blocks.join(langs.select("lang", "terms", chunks.alias("chunk")), "lang").join(widths, ["lang", "chunk"], "left").fillna(0, ["width"])
    return grid.join(packed, ["lang", "block", "chunk"], "left")


def pairs(groups: DataFrame, kept: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, source, item, value: the divergence of each source from each other of its language, over all kept terms."""
    parts = _parts(groups, kept, langs)
    blocks = F.greatest(F.ceil(F.col("n_sources") / BLOCK), F.lit(1)).cast("int")
    parts = parts.join(langs.select("lang", blocks.alias("blocks")), "lang")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    parts = parts.withColumn("other", other).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other"), "stripe": F.floor(F.col("chunk") / STRIPE).cast("int")})
    there = groups.select("lang", _dealt(F.col("source"), F.col("n_sources"), BLOCK).alias("other")).distinct()
    parts = parts.join(there, ["lang", "other"], "left_semi")  # a block may be empty, as sources are dealt by hash
    columns = ["lang", "low", "high", "stripe", "block", "chunk", "width", "terms", "sources", "totals", "cells"]
    tiles = parts.select(*columns).groupBy("lang", "low", "high", "stripe").applyInArrow(_tile, "lang string, source string, item string, value long")
    return tiles.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """How far each source of docs (text, lang, source) is from every other of its language, and which terms mark it.

    Returns lang, source, part, item, value, rank. In part `pair` item is each other source of the language and value the sum over all kept
    terms; in part `term` item is a term that the source has, more than its language has, and ranks end at top_terms. Ranks go by value, the
    highest first, then by the item's UTF-8.

    A null text, lang or source counts as ''. Rows are documents, repeated ones too. Empty texts make their group occur, so it is compared
    even without a term; where a language keeps no term all values of pairs are 0. Very long texts are counted whole, in memory in proportion to
    their length. Equal values are ranked by item. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    text = F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text")
    rows = docs.select(*(F.coalesce(docs[c], F.lit("")).alias(c) for c in _KEYS), text)
    partial = rows.mapInArrow(_counted, "lang string, source string, term string, n long, df long")
    counts = partial.groupBy(*_KEYS, "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    of_term = Window.partitionBy("lang", "term")
    counts = counts.withColumns({"docs": F.sum("df").over(of_term), "all": F.sum("n").over(of_term), "first": F.min("source").over(of_term)})
    counts = counts.where((F.col("term") == "") | (F.col("docs") >= min_docs))
    counts = written(counts.select(*_KEYS, "term", "n", "all", (F.col("source") == F.col("first")).alias("head")), "divergence-counts")
    kept, named = counts.where("term <> ''"), counts.where("term = ''")
    sums = kept.groupBy("lang").agg(F.count_if("head").alias("terms"), F.sum("n").alias("words"))
    langs = named.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources")).join(sums, "lang", "left").fillna(0, ["terms", "words"])
    groups = named.select(*_KEYS).join(kept.groupBy(*_KEYS).agg(F.sum("n").alias("total")), _KEYS, "left").fillna(0, ["total"])
    langs = written(langs, "divergence-langs")
    groups = written(groups.join(langs.select("lang", "n_sources", "terms", "words"), "lang"), "divergence-groups")

    best = Window.partitionBy(*_KEYS).orderBy(F.col("value").desc(), "item")
    p = _share(F.col("n"), F.col("total"), F.col("terms"))
    q = _share(F.col("all"), F.col("words"), F.col("terms"))
    marks = kept.join(groups, _KEYS).select(*_KEYS, F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    marks = marks.select(*_KEYS, "item", _divergence(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)
    every = pairs(groups, kept, langs).withColumn("rank", F.row_number().over(best))
    columns = lambda part: [*_KEYS, F.lit(part).alias("part"), "item", "value", "rank"]
    return every.select(*columns("pair")).unionByName(marks.select(*columns("term")))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    """audit() of all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


#: The same.
OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (
  SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= {MIN_DOCS}
), groups AS (
  SELECT DISTINCT lang, source FROM d
), counts AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY w.lang, w.source, w.term
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), totals AS (
  SELECT lang, source, coalesce(sum(n), 0) AS n FROM groups LEFT JOIN counts USING (lang, source) GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + CAST({SCALE} AS HUGEINT) * (coalesce(c.n, 0) + 1) // (g.n + l.v) AS BIGINT) AS p
  FROM totals g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), q AS (
  SELECT lang, term, CAST(1 + CAST({SCALE} AS HUGEINT) * (k.n + 1) // (l.n + l.v) AS BIGINT) AS q FROM kept k JOIN langs l USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), every AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
), marks AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM every
UNION ALL
SELECT lang, source, 'term', item, CAST(value AS BIGINT), CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) FROM marks
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {TOP_TERMS}
"""

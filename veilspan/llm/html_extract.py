"""Main text of web pages by deduction of their hosts' templates from equivalence classes.

A page is a sequence of tokens: its elements, told apart by the path of block elements above them, and its text blocks. Over the
distinct pages of a host each token has an occurrence vector, the pages it stands on; tokens with equal vectors are one
equivalence class. A class is valid if it stands on SUPPORT pages at least and holds a token of markup, so that it has a frame. Valid
classes nest by their paths: the parent of a class is the one that holds the nearest element above its own topmost element, and those that
hang from the class of the page, or from an element at the top, make up the template, one branch for each layout of the host. Text blocks
of these classes belong to the template; what remains are slots, known by their path. Of these the main text takes those of the article:
slots inside an article (or main) element, else in the container that holds most text on the host's pages. Where all text of an article is
in the template (a host of mirrors, say), there is nothing to tell them apart by, and the article stays.

Menus, headers, footers, forms and the like are never taken; nor are elements whose class, id or role names one of these and nothing else
(`share-bar` does, `share-price-report` doesn't). Marks of html, body, main and article say nothing, nor those of elements around the
article where a page has no article without such marks around, nor any where nothing else would be left.

Vectors are compared by hash: the exclusive or of the pages' hashes, so that no host's pages meet in one task; equal pages of a host count
once. Hosts' decisions are broadcast up to BROADCAST_HOSTS hosts and BROADCAST_TOKENS tokens in all; beyond, the join shuffles.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: The least pages on which a class must stand.
SUPPORT = 5
BROADCAST_HOSTS, BROADCAST_TOKENS = 200_000, 2_000_000
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("aside button dialog fieldset footer form head label menu nav option search select title".split())
#: Words in class, id or role that mark what isn't the article.
MARKERS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies footer login menu modal nav navbar navigation newsletter "
    "notice pagination popup promo recommended related reply replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that may stand beside one of MARKERS in a name.
PLAIN = frozenset("area bar block body bottom box button buttons cell column container content desktop form group header holder icon icons inner item items left link links list mobile outer overlay pane panel right row section slot small strip text title top unit wrap wrapper zone".split())
#: Elements that marks don't drop.
FRAMES = frozenset("html body main article".split())
#: A start of one of these ends an open element of the set.
ENDS = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg|object|canvas|audio|video|math)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^\"'>]|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>"
    r"|<[!?][^>]*+>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)", re.I)

class Block:
    """A text block: its text, the path of its block elements, whether these (or their marks alone) say it isn't the article, and whether one is an article."""

    __slots__ = ("article", "dropped", "marked", "path", "text")

    def __init__(self, text: str, path: str, dropped: bool, marked: bool, article: bool):
        self.text, self.path, self.dropped, self.marked, self.article = text, path, dropped, marked, article


def _marked(attributes: str) -> tuple[str, bool]:
    """The marks of an element for its path, and whether one of its names says that it isn't the article."""
    marks, marked = [], False
    for value in _ATTRIBUTE.findall(attributes):
        for name in value.strip("\"'").split():
            words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()) if w]
            marks += words
            marked |= any(w in MARKERS for w in words) and all(w in MARKERS or w in PLAIN for w in words)
    return ".".join(marks), marked


def blocks(page: str) -> tuple[list[Block], Counter]:
    """The text blocks of a page in order, and how often each element path opens."""
    out: list[Block] = []
    opened: Counter = Counter()
    # name, path, dropped, marked inside an article, marked outside of any, article
    stack: list[tuple[str, str, bool, bool, bool, bool]] = [("", "", False, False, False, False)]
    around: list[Block] = []
    parts: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            _, path, dropped, within, outside, article = stack[-1]
            out.append(Block(text, path, dropped, within or outside, article))
            if outside and article and not dropped and not within:
                around.append(out[-1])

    at = 0
    for m in _PIECE.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
            continue
        if name not in BLOCKS and name not in DROPPED:
            continue
        flush()
        if m[2]:
            if any(s[0] == name for s in stack):
                while stack.pop()[0] != name:
                    pass
            continue
        while len(stack) > 1 and name in ENDS.get(stack[-1][0], ()):
            stack.pop()
        marks, marked = _marked(m[4]) if "=" in m[4] else ("", False)
        _, path, dropped, within, outside, inside = stack[-1]
        path = f"{path}/{name}.{marks}" if marks else f"{path}/{name}"
        core = name in ("article", "main") or "main" in marks.split(".") and "role" in m[4].lower()
        article = inside or core
        marked = marked and not core and name not in FRAMES
        dropped = dropped or name in DROPPED or (name == "header" and not article)
        within = within or (marked and inside)
        outside = outside or (marked and not inside)
        opened[path] += 1
        if name not in VOID:
            stack.append((name, path, dropped, within, outside, article))
    if at < len(page):
        parts.append(page[at:])
    flush()
    if not any(b.article and not b.dropped and not b.marked for b in out):
        for b in around:
            b.marked = False
    if any(not b.dropped and not b.marked for b in out):
        for b in out:
            b.dropped |= b.marked
    return out, opened


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


PAGE, ELEMENT, TEXT = 0, 1, 2


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, kind, token, path, vector, chars: a row for each token of each page (host, key, html)."""
    for batch in batches:
        cols: list[list] = [[] for _ in range(6)]
        for host, key, page in zip(batch.column("host").to_pylist(), batch.column("key").to_pylist(), batch.column("html").to_pylist(), strict=True):
            found, opened = blocks(page)
            vector = _hash(key)
            chars: Counter = Counter()
            for b in found:
                if not b.dropped:
                    chars[b.path] += len(b.text)
            rows = [(PAGE, "", "", 0)]
            rows += [(ELEMENT, path, path, chars[path]) for path in opened]
            rows += [(TEXT, f"{path}\x00{text}", path, 0) for path, text in {(b.path, b.text): None for b in found}]
            for kind, token, path, size in rows:
                for c, v in zip(cols, (host, kind, _hash(str(kind), token), path if kind == ELEMENT else None, vector, size), strict=True):
                    c.append(v)
        types = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["host", "kind", "token", "path", "vector", "chars"])


def _host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*+://(?:[^/?#@]*+@)?([^/?#:]*+)", 1)), F.lit(""))


def distinct_pages(pages: DataFrame) -> DataFrame:
    """host, key, html: one row for each distinct html of a host. Only repeated ones are shuffled, one from each task."""
    rows = pages.select(_host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).withColumn("key", F.md5("html"))
    again = written(rows.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("host", "key"), "html-again")
    again = F.broadcast(again) if again.count() <= BROADCAST_HOSTS else again
    one = rows.join(again, ["host", "key"], "left_semi").groupBy("host", "key").agg(F.first("html").alias("html"))
    return rows.join(again, ["host", "key"], "left_anti").select("host", "key", "html").unionByName(one)


def nested_classes(tokens: DataFrame) -> DataFrame:
    """host, vector, pages, top, parent: the classes of each host's template; top is the topmost element's path, parent the one above it in the class it hangs from."""
    name = ["host", "vector", "pages"]
    element = F.col("kind") == ELEMENT
    least = F.min(F.when(element, F.struct(F.size(F.split("path", "/")).alias("depth"), "path")))
    classes = tokens.groupBy(*name).agg(F.max(F.col("kind") == PAGE).alias("root"), least.alias("top"))
    valid = classes.where((F.col("pages") >= SUPPORT) & F.col("top").isNotNull()).select(*name, "root", "top.depth", "top.path")
    frames = tokens.where(element).join(valid.select(*name), name, "left_semi").select("host", F.col("path").alias("above"))
    parts = F.split("path", "/")
    ups = F.when(F.col("depth") > 2, F.transform(F.sequence(F.lit(2), F.col("depth") - 1), lambda k: F.concat_ws("/", F.slice(parts, F.lit(1), k)))).otherwise(F.array().cast("array<string>"))
    ups = valid.select(*name, F.explode(ups).alias("above")).join(frames, ["host", "above"])
    parents = ups.groupBy(*name).agg(F.max_by("above", F.length("above")).alias("parent"))
    nested = valid.join(parents, name, "left")
    return nested.where(F.col("root") | (F.col("depth") == 2) | F.col("parent").isNotNull()).select(*name, F.col("path").alias("top"), "parent")


def templates(pages: DataFrame) -> DataFrame:
    """host, constant (tokens of text in the template's classes), container (the path that holds most text), for each host."""
    rows = distinct_pages(pages).mapInArrow(_tokens, "host string, kind int, token long, path string, vector long, chars long")
    tokens = rows.groupBy("host", "kind", "token").agg(F.first("path", ignorenulls=True).alias("path"), F.bit_xor("vector").alias("vector"), F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"))
    tokens = written(tokens, "html-tokens")
    name = ["host", "vector", "pages"]
    constant = tokens.where(F.col("kind") == TEXT).join(nested_classes(tokens).select(*name), name, "left_semi")
    constant = constant.groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("constant"))
    parent = F.regexp_replace("path", "/[^/]*$", "")
    held = tokens.where((F.col("kind") == ELEMENT) & (F.col("chars") > 0)).groupBy("host", parent.alias("container")).agg(F.sum("chars").alias("chars"))
    most = held.groupBy("host").agg(F.max_by("container", F.struct("chars", "container")).alias("container"))
    return tokens.where(F.col("kind") == PAGE).select("host").distinct().join(constant, "host", "left").join(most, "host", "left")


def main_text(page: str, constant: frozenset[int], container: str) -> str:
    """The slots of the article, joined by line breaks."""
    found = [b for b in blocks(page)[0] if not b.dropped]
    if any(b.article for b in found):
        found = [b for b in found if b.article]
    elif container:
        found = [b for b in found if b.path == container or b.path.startswith(f"{container}/")] or found
    left = [b for b in found if _hash(str(TEXT), f"{b.path}\x00{b.text}") not in constant] if constant else found
    return "\n".join(b.text for b in left or found)


def extract(pages: DataFrame) -> DataFrame:
    """Each row of pages (page_id, url, html) with its main text.

    Returns page_id, url, text. A null or empty html has the empty text; pages whose url has no host (null too) are one host.
    Repeated rows and pages of one host with equal html count as one page, and get equal texts. An empty table gives no rows.
    Other columns are not read. Very long pages are parsed whole, in time in proportion to their length.
    """
    hosts = written(templates(pages), "html-hosts").withColumnRenamed("host", "_host")
    n, tokens = hosts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.greatest(F.size("constant"), F.lit(0))), F.lit(0))).first()
    bounded = n <= BROADCAST_HOSTS and tokens <= BROADCAST_TOKENS
    rows = pages.select("page_id", "url", "html")
    joined = rows.withColumn("_host", _host(F.col("url"))).join(F.broadcast(hosts) if bounded else hosts, "_host", "left").drop("_host")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[tuple, frozenset] = {}
            out = []
            for page, constant, container in zip(batch.column("html").to_pylist(), batch.column("constant").to_pylist(), batch.column("container").to_pylist(), strict=True):
                key = tuple(constant or ())
                out.append(main_text(page or "", sets.setdefault(key, frozenset(key)), container or ""))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    fields = [T.StructField("page_id", pages.schema["page_id"].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())]
    return joined.mapInArrow(texts, T.StructType(fields))


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The digest of extract() over all pages."""
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

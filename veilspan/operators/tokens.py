"""Tokens of texts, and patterns over sequences of tokens.

A token is a run of word characters, an initial with its point, or another character that is no white space. A pattern is a sequence of steps,
each a test of one token; a step may repeat. All patterns are matched at once by one automaton: a block's tokens are folded over the set of live states
(pattern, step, first token), and every span that a pattern accepts is a match, overlapping ones too.

What a token may be (its tags) comes from a joined table of word forms (see morphology). Only tokens that pass some step leave the scan, with their place
in the block, so the shuffle that gathers them carries these few; a gap in their places ends all live states, so each run without gaps is folded by itself.

Tokens of whole tables (exploded) are marked by one Java expression and cut in Arrow batches, column by column; tokens() is the same as one expression, for short
texts such as phrases, as it works token by token.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import let, plain_spaces
from ..session import bounded_batches

#: Marks the ends of tokens; in the text it is first exchanged for another private-use character, so lengths stay.
_MARK, _OTHER = "\uE000", "\uE001"
TOKEN = r"(?U)\p{Lu}\.|\w+|[^\w\s]"
#: Tokens put together at once; a longer text's are put together in pieces of this.
PIECE = 32
_STRUCT = "struct<gap:string,text:string,start:int,end:int>"
#: Bytes of texts that are cut in Python at once (or one text), and rows of a batch that goes back.
CUT, BATCH = 1 << 20, 1 << 15


def marked(text: Column) -> Column:
    """The text with a mark before and behind each token; null counts as empty."""
    return F.regexp_replace(F.replace(plain_spaces(text), F.lit(_MARK), F.lit(_OTHER)), TOKEN, f"{_MARK}$0{_MARK}")


def tokens(text: Column) -> Column:
    """Structs of gap (the white space before), text, start, end (code points, end exclusive) of the tokens; null counts as empty."""

    def paired(c: Column) -> Column:
        at = lambda k: F.get(c, k.cast("int"))
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(c) / 2).cast("int") - 1), lambda k: F.struct(at(2 * k).alias("gap"), at(2 * k + 1).alias("text")))

    def cut(parts: Column) -> Column:
        count = F.floor((F.size(parts) - 3) / (2 * PIECE)).cast("int")
        return let(F.transform(F.sequence(F.lit(0), count), lambda k: let(F.slice(parts, 2 * PIECE * k + 1, F.lit(2 * PIECE)), paired)), placed)

    def placed(pieces: Column) -> Column:
        size = lambda n, p: n + F.length(p["gap"]) + F.length(p["text"])
        starts = F.aggregate(pieces, F.array(F.lit(0)), lambda a, c: F.concat(a, F.array(F.aggregate(c, F.element_at(a, -1), size))))
        return let(starts, lambda at: F.flatten(F.transform(pieces, lambda c, k: F.aggregate(c, F.struct(F.get(at, k).alias("at"), _none().alias("out")), step, lambda a: a["out"]))))

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + F.length(p["gap"])
        end = start + F.length(p["text"])
        token = F.struct(p["gap"].alias("gap"), p["text"].alias("text"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(token)).alias("out"))

    return let(F.split(marked(text), _MARK, -1), lambda parts: F.when(F.size(parts) > 1, cut(parts)).otherwise(_none()))


def _none() -> Column:
    return F.array().cast(f"array<{_STRUCT}>")


def word_of(text: Column) -> Column:
    """The form that tables are looked up by: lower case, е for ё."""
    return F.replace(F.lower(text), F.lit("ё"), F.lit("е"))


@dataclass(frozen=True)
class Cut:
    """The tokens of some marked texts: each one's row and place there, its part among all parts (the gap is the part before), start and end; and the first token of each row."""

    parts: pa.Array
    row: np.ndarray
    i: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def cut(texts: pa.Array) -> Cut:
    """The tokens of marked() texts."""
    lists = pc.split_pattern(texts, _MARK)
    offsets, parts = lists.offsets.to_numpy().astype(np.int64), lists.values
    sizes = pc.utf8_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    n = (np.diff(offsets) - 1) // 2
    row, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    i = np.arange(len(row)) - first[row]
    at = offsets[:-1][row] + 2 * i + 1
    start = upto[at] - upto[offsets[:-1]][row]
    return Cut(parts, row, i, at, start, start + sizes[at], first)


def in_arrow(rows: DataFrame, by: str, made: list[T.StructField], how: Callable[[pa.RecordBatch, Cut], tuple[np.ndarray, list[pa.Array]]]) -> DataFrame:
    """Rows made from the tokens of the texts in the column `by` (marked()): the columns of rows without a leading _, and those made.

    how(some rows, their tokens) says from which row each new one is, and gives the columns made.

    Texts are cut by CUT bytes at a time, and a batch that goes back has BATCH rows at most.
    """
    bounded_batches(rows.sparkSession)
    carried = [f for f in rows.schema if not f.name.startswith("_")]
    names = [f.name for f in [*carried, *made]]

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.cumsum(pc.binary_length(batch.column(by)).to_numpy(zero_copy_only=False))
            begin = 0
            while begin < batch.num_rows:
                before = upto[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(upto, before + CUT, "right")))
                part = batch.slice(begin, end - begin)
                row, columns = how(part, cut(part.column(by)))
                whole = pa.RecordBatch.from_arrays([*(part.column(f.name).take(pa.array(row)) for f in carried), *columns], names)
                for k in range(0, whole.num_rows, BATCH):
                    yield whole.slice(k, BATCH)
                begin = end

    return rows.mapInArrow(out, T.StructType([*carried, *made]))


def exploded(blocks: DataFrame, *keep: str) -> DataFrame:
    """doc_id, block_id, keep, i (the token's place), gap, text, start, end, word: one row a token."""
    rows = blocks.select("doc_id", "block_id", *keep, marked(F.col("text")).alias("_marked"))
    made = [T.StructField(n, T.StringType() if n in ("gap", "text") else T.IntegerType()) for n in ("i", "gap", "text", "start", "end")]

    def columns(batch: pa.RecordBatch, t: Cut) -> tuple[np.ndarray, list[pa.Array]]:
        return t.row, [pa.array(t.i, pa.int32()), t.parts.take(pa.array(t.at - 1)), t.parts.take(pa.array(t.at)), pa.array(t.start, pa.int32()), pa.array(t.end, pa.int32())]

    return in_arrow(rows, "_marked", made, columns).withColumn("word", word_of(F.col("text")))


@dataclass(frozen=True)
class Step:
    """A test of a token (columns text, word, tags); `more` lets it hold for several in a row."""

    test: Callable[[Column, Column, Column], Column]
    more: bool = False


@dataclass(frozen=True)
class Pattern:
    label: str
    category: str
    steps: tuple[Step, ...]
    confidence: float = 1.0


def tagged(tag: str, *more: str) -> Callable[[Column, Column, Column], Column]:
    """A token with one of these tags."""
    return lambda text, word, tags: F.arrays_overlap(tags, F.array(F.lit(tag), *map(F.lit, more)))


def titled(tag: str) -> Callable[[Column, Column, Column], Column]:
    """A token with this tag that begins with a capital and has no other."""
    return lambda text, word, tags: F.array_contains(tags, tag) & text.rlike(r"(?U)^\p{Lu}[^\p{Lu}]*$")


def is_initial(text: Column, word: Column, tags: Column) -> Column:
    return text.rlike(r"^\p{Lu}\.$")


def long_name(text: Column, word: Column, tags: Column) -> Column:
    return F.array_contains(tags, "PROPN") & (F.length(text) > 2)


def one_of(*words: str) -> Callable[[Column, Column, Column], Column]:
    return lambda text, word, tags: word.isin(*words)


#: Legal forms and quotes of organisations.
LEGAL_FORMS = ("ооо", "ао", "пао", "зао", "ип", "гуп", "муп")
OPENING, CLOSING = ('"', "«", "'"), ('"', "»", "'")


def patterns(legal_forms: Sequence[str] = LEGAL_FORMS) -> tuple[Pattern, ...]:
    """Three titled names in a row; two initials before a name, and behind it; a legal form with a quoted name of nouns."""
    name, first = Step(titled("PROPN")), Step(is_initial)
    quoted = (Step(one_of(*legal_forms)), Step(one_of(*OPENING)), Step(tagged("NOUN", "PROPN"), more=True), Step(one_of(*CLOSING)))
    return (
        Pattern("full_name", "person_name", (name, name, name)),
        Pattern("initials_lastname", "person_name", (first, first, Step(long_name))),
        Pattern("lastname_initials", "person_name", (Step(long_name), first, first)),
        Pattern("quoted_organization", "organization", quoted),
    )


def matched(rows: DataFrame, known: Sequence[Pattern]) -> DataFrame:
    """Detections of the patterns over tokens (exploded(), with tags: array<string>, null counts as none).

    Every span that a pattern accepts is one, with method custom_matcher and the pattern's label as description; ord goes by end, then by first
    token, then by pattern. Repeated blocks (equal doc_id and block_id) must be told apart before. Without tokens there are none.
    """
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    steps = [(p, s, step) for p, pattern in enumerate(known) for s, step in enumerate(pattern.steps)]
    first = [i for i, (_, s, _) in enumerate(steps) if s == 0]
    last = F.array(*(F.lit(s + 1 == len(known[p].steps)) for p, s, _ in steps))
    more = F.array(*(F.lit(step.more) for _, _, step in steps))
    holds = F.array(*(F.coalesce(step.test(F.col("text"), F.col("word"), tags), F.lit(False)) for _, _, step in steps))
    few = rows.withColumn("holds", holds).where(F.array_contains("holds", True))
    live = _reached(few.select("doc_id", "block_id", "i", "gap", "text", "start", "end", "holds"), steps)
    gathered = live.groupBy("doc_id", "block_id", "run").agg(F.array_sort(F.collect_list(F.struct("i", "gap", "text", "start", "end", "holds"))).alias("tokens"))

    state = "array<struct<step:int,first:int>>"
    found = "array<struct<last:int,first:int,step:int>>"

    def advance(a: Column, t: Column, k: Column) -> Column:
        new = F.array(*(F.struct(F.lit(s).alias("step"), k.alias("first")) for s in first))
        return let(F.filter(F.concat(a["live"], new), lambda x: F.get(t["holds"], x["step"])), lambda met: reached(a, t, k, met))

    def reached(a: Column, t: Column, k: Column, met: Column) -> Column:
        done = F.transform(F.filter(met, lambda x: F.get(last, x["step"])), lambda x: F.struct(k.alias("last"), x["first"].alias("first"), x["step"].alias("step")))
        on = F.transform(F.filter(met, lambda x: ~F.get(last, x["step"])), lambda x: F.struct((x["step"] + 1).alias("step"), x["first"].alias("first")))
        again = F.filter(met, lambda x: F.get(more, x["step"]))
        return F.struct((k + 1).alias("k"), F.array_distinct(F.concat(on, again)).alias("live"), F.concat(a["out"], done).alias("out"))

    def span(m: Column) -> Column:
        inner = F.slice("tokens", m["first"] + 1, m["last"] - m["first"] + 1)
        value = F.array_join(F.transform(inner, lambda t, j: F.when(j == 0, t["text"]).otherwise(F.concat(t["gap"], t["text"]))), "")
        a, z = F.get("tokens", m["first"]), F.get("tokens", m["last"])
        return F.struct(z["i"].alias("last"), a["i"].alias("first"), m["step"].alias("step"), value.alias("value"), a["start"].alias("start"), z["end"].alias("end"))

    start = F.struct(F.lit(0).alias("k"), F.array().cast(state).alias("live"), F.array().cast(found).alias("out"))
    out = F.aggregate("tokens", start, lambda a, t: let(a, lambda b: advance(b, t, b["k"])), lambda a: F.transform(a["out"], span))
    spans = gathered.select("doc_id", "block_id", F.explode(out).alias("m")).select("doc_id", "block_id", "m.*")
    ord_ = F.row_number().over(Window.partitionBy("doc_id", "block_id").orderBy("last", "first", "step")) - 1
    of = lambda f: F.get(F.array(*(F.lit(f(known[p])) for p, _, _ in steps)), F.col("step"))
    return spans.select(
        "doc_id", "block_id", of(lambda p: p.category).alias("category"), F.col("value").alias("original_value"), "start", "end",
        of(lambda p: float(p.confidence)).alias("confidence"), F.lit("custom_matcher").alias("method"), of(lambda p: p.label).alias("description"), ord_.alias("ord"),
    )


#: Tokens of a pattern's beginning that are looked for before runs are folded.
HEAD = 3


def _reached(rows: DataFrame, steps: list[tuple[int, int, Step]]) -> DataFrame:
    """rows (with holds) with `run`, the place where their run of neighbours begins, from the first token of a run on at which some pattern can begin.

    There its steps hold one after the other, up to HEAD of them and up to its first that may repeat; most runs have no such token, and aren't folded.
    """
    heads: dict[int, list[int]] = {}
    for at, (p, s, _) in enumerate(steps):
        if s < HEAD and not any(q == p and t < s and step.more for q, t, step in steps):
            heads.setdefault(p, []).append(at)
    line = Window.partitionBy("doc_id", "block_id").orderBy("i")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    ahead = {k: f"_{k}" for k in range(1, max(map(len, heads.values()), default=1))}
    rows = rows.withColumns({"_before": F.lag("i").over(line), **{name: F.lead(F.struct("i", "holds"), k).over(line) for k, name in ahead.items()}})
    begins = F.lit(False)
    for head in heads.values():
        here = F.get("holds", F.lit(head[0]))
        for k, at in enumerate(head[1:], 1):
            here &= (F.col(f"{ahead[k]}.i") == F.col("i") + k) & F.get(F.col(f"{ahead[k]}.holds"), F.lit(at))
        begins |= F.coalesce(here, F.lit(False))
    opens = F.coalesce(F.col("_before") + 1 != F.col("i"), F.lit(True))
    rows = rows.withColumns({"run": F.max(F.when(opens, F.col("i"))).over(so_far), "_begun": F.max(F.when(begins, F.col("i"))).over(so_far)})
    return rows.where(F.col("_begun") >= F.col("run")).drop("_before", "_begun", *ahead.values())

"""Secrets by character Markov models (DataFrame operations only on the main path).

Two first-order models over the characters of ALPHABET, one of random strings and one of ordinary identifiers, give each pair of neighbouring
characters a log-likelihood ratio. A candidate is a run of at least LEAST such characters; it is a secret where its pairs' ratios add up to the
threshold. The spans of the fixed base patterns always stay, and a secret is added where it overlaps none of them.

The models are counted from labelled samples (value, secret), at most EXAMPLES of either label: values that the base patterns find in
documents are secrets, words of documents and names put together from them (snake and camel case, paths, numbers behind) are ordinary;
made strings of other alphabets and made runs (dates, numbers, one character again and again) add shapes that documents may lack. Pairs are counted
in half of the samples, and the threshold is the least that no more than FALSE of the ordinary ones of the other half reach, FLOOR at least.

Everything that is found is found inside the row of a document, so nothing is shuffled; offsets are in code points.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written
from .pii import _MARK, _OTHER, _let, _matches

KINDS = ("assign", "access", "hex")
#: The base kinds, and what the models add.
ALL = (*KINDS, "random")
_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\x22']?\x20*[:=]\x20*[\x22']?"
#: Equal to the base patterns, leftmost and without overlap, with what a text needs to hold a match. A shorter match of `access` or `hex` takes no
#: character of a longer one, so their least lengths stand in the pattern; one of `assign` may, so its length is looked at afterwards.
BASE = (
    ("assign", _ASSIGN + r"[A-Za-z0-9+/_.=-]++", r"(?i)passw|secret|token|api_?key"),
    ("access", r"AKIA[A-Z0-9]{14,}+", "AKIA"),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{16,}+", "[0-9a-f]{16}"),
)
LEAST_ASSIGNED = 12
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST = 16
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+={0,2}" % LEAST
#: Identifiers that are random by design, and not secret.
UUID = r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
#: Samples of either label at most; texts that give ordinary ones, about; made samples of either label.
EXAMPLES, TEXTS, MADE = 20_000, 4_000, 4_000
#: Added to each count of a pair; the share of ordinary samples above the threshold at most, and the least threshold (thousandths of a natural logarithm).
SMOOTHING, FALSE, FLOOR = 0.5, 0.0001, 15_000


def _none() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")


def _of_kind(text: Column, kind: int, pattern: str, needs: str) -> Column:
    span = lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value"))
    return F.when(text.rlike(needs), F.transform(_matches(text, pattern), span)).otherwise(_none())


def _base(text: Column) -> Column:
    """Structs of start, kind (its place in ALL), end, value of the base spans, in this order."""
    found = [_of_kind(text, k, pattern, needs) for k, (_, pattern, needs) in enumerate(BASE)]
    found[0] = F.filter(found[0], lambda s: F.length(assigned(s["value"])) >= LEAST_ASSIGNED)
    return F.array_sort(F.concat(*found))


def assigned(value: Column) -> Column:
    """The value in a match of `assign`."""
    return F.regexp_extract(value, "^" + _ASSIGN + "([A-Za-z0-9+/_.=-]++)$", 1)


def _candidates(text: Column) -> Column:
    found = _of_kind(text, len(KINDS), CANDIDATE, "[A-Za-z0-9+/_-]{%d}" % LEAST)
    return F.filter(found, lambda s: ~s["value"].rlike(UUID))


@dataclass(frozen=True)
class Model:
    """For each character before (0: none) and each character, both by place in ALPHABET from 1: the log ratio in thousandths; and the least sum of a secret."""

    ratios: tuple[tuple[int, ...], ...]
    least: int

    def score(self, value: Column) -> Column:
        """The sum of the ratios of a string's pairs; characters outside ALPHABET add nothing, and the next one has none before it."""
        table = F.array(*(F.lit(r) for row in self.ratios for r in row))
        places = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
        start = F.struct(F.lit(0).alias("before"), F.lit(0).cast("long").alias("sum"))
        add = lambda a, p: F.struct(p.alias("before"), (a["sum"] + F.get(table, a["before"] * (len(ALPHABET) + 1) + p)).alias("sum"))
        return F.aggregate(places, start, add, lambda a: a["sum"])


def made(seed: int = 13) -> list[tuple[str, bool]]:
    """MADE random strings over usual alphabets, as many numbers in groups, and each character again and again, and runs in the alphabet's order."""
    rng = random.Random(seed)
    upper, lower, digits = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
    kinds = [upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "_-", upper + digits, lower + digits, digits + "ABCDEF", digits + "abcdef"]
    out = [("".join(rng.choices(rng.choice(kinds), k=rng.randint(LEAST, 64))), True) for _ in range(MADE)]
    number = lambda n: "".join(rng.choices(digits, k=n))
    for _ in range(MADE):
        groups = [number(rng.choice((2, 2, 3, 4, 4, 6, 10))) for _ in range(rng.randint(2, 7))]
        out.append(("-_/+-"[len(groups) % 5].join(groups), False))
    out += [(c * n, False) for c in ALPHABET for n in range(LEAST, 3 * LEAST, 2)]
    return out + [(ALPHABET[at : at + n], False) for at in range(52) for n in range(LEAST, 26, 3)]


def samples(docs: DataFrame) -> DataFrame:
    """Labelled samples from docs (text): value, secret; distinct, at most EXAMPLES of either label, the first by hash.

    Secrets come from all texts, ordinary ones from about TEXTS texts, taken by hash.
    """
    text = F.translate(text_of(docs), _MARK, _OTHER).alias("text")
    texts = docs.select(text)
    needs = "|".join(f"(?:{n})" for _, _, n in BASE)
    spans = texts.where(F.col("text").rlike(needs)).select(F.explode(_base(F.col("text"))).alias("s"))
    value = F.when(F.col("s.kind") == 0, assigned(F.col("s.value"))).otherwise(F.col("s.value"))
    secrets = spans.select(value.alias("value")).where("value rlike '[0-9]' and value rlike '[A-Za-z]'")
    one_of = max(1, docs.count() // TEXTS)
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(one_of)) == 0)
    words = F.filter(F.split("text", "[^A-Za-z]+"), lambda w: w.rlike("^(?:[A-Z]?[a-z]{3,30}|[A-Z]{4,30})$"))
    pairs = some.select(words.alias("w")).select(F.explode(F.transform("w", lambda w, i: F.struct(w.alias("a"), F.coalesce(F.get(F.col("w"), i + 1), w).alias("b"), i.alias("i")))).alias("p"))
    a, b, n = F.col("p.a"), F.col("p.b"), F.col("p.i")
    shapes = [a, F.upper(a), F.concat(F.initcap(a), F.initcap(b)), F.concat(F.lower(a), F.initcap(b), n % 100), F.concat_ws("_", F.lower(a), F.lower(b), n), F.concat_ws("_", F.upper(a), F.upper(b)), F.concat_ws("-", F.lower(a), F.lower(b), n), F.concat_ws("/", F.lower(a), F.lower(b), a)]
    ordinary = pairs.select(F.element_at(F.array(*shapes), (F.pmod(F.xxhash64("p"), F.lit(len(shapes))) + 1).cast("int")).alias("value"))
    first = lambda rows: rows.distinct().orderBy(F.xxhash64("value"), "value").limit(EXAMPLES)
    return first(secrets).select("value", F.lit(True).alias("secret")).unionByName(first(ordinary).select("value", F.lit(False).alias("secret")))


def train(labelled: DataFrame) -> Model:
    """Models of labelled samples (value, secret); the driver gets their counts of pairs, and the threshold's place among the scores.

    Nulls in either column are left out. Where a label has no sample its model is even. Repeated samples count as often as they occur.
    """
    size = len(ALPHABET) + 1
    rows = labelled.where(F.col("value").isNotNull() & F.col("secret").isNotNull()).select("value", "secret", (F.pmod(F.xxhash64("value", F.lit(1)), F.lit(2)) == 0).alias("learn"))
    places = F.transform(F.split("value", ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = F.transform(places, lambda p, i: F.when(i == 0, p).otherwise(F.get(places, i - 1) * size + p))
    counted = rows.where("learn").select("secret", F.explode(pairs).alias("pair")).groupBy("secret", "pair").count()
    counts = {label: [[SMOOTHING] * size for _ in range(size)] for label in (False, True)}
    for r in counted.collect():
        counts[r.secret][r.pair // size][r.pair % size] += r["count"]

    def log(row: list[float], c: int) -> float:
        return math.log(row[c] / sum(row[1:]))

    table = [[0 if c == 0 else round(1000 * (log(counts[True][b], c) - log(counts[False][b], c))) for c in range(size)] for b in range(size)]
    model = Model(tuple(map(tuple, table)), FLOOR)
    others = rows.where(~F.col("learn") & ~F.col("secret"))
    reached = int(FALSE * others.count())
    above = others.select(model.score(F.col("value")).alias("score")).where(F.col("score") >= FLOOR).orderBy(F.col("score").desc()).limit(reached + 1).collect()
    return Model(model.ratios, above[reached].score + 1 if len(above) > reached else FLOOR)


def fit(docs: DataFrame) -> Model:
    """train() over samples() of docs (text) and the made ones."""
    spark = docs.sparkSession
    return train(written(samples(docs).unionByName(spark.createDataFrame(made(), "value string, secret boolean")), "secret-samples"))


def find(docs: DataFrame, keep: list[str], model: Model | None = None) -> DataFrame:
    """Each row of docs (text) with its secrets: arrays of start, kind (its place in ALL), end, value, by start, then kind.

    Returns row (a struct of the columns in keep), base and spans, which holds base and what the models add; base spans of different kinds may
    overlap. Without a model, one is fitted on docs. Offsets are code points, end exclusive. A null or empty text has no spans; equal
    texts get equal spans, repeated rows too. Columns may have any names. An empty table gives no rows. Very long texts and runs are worked on whole.
    """
    model = model or fit(docs)
    text = F.translate(text_of(docs), _MARK, _OTHER)

    def both(t: Column, base: Column) -> Column:
        free = F.filter(_candidates(t), lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        added = F.filter(free, lambda s: model.score(s["value"]) >= model.least)
        return F.struct(base.alias("base"), F.array_sort(F.concat(base, added)).alias("spans"))

    found = _let(text, lambda t: _let(_base(t), lambda b: both(t, b)))
    rows = docs.select(F.struct(*(docs[c] for c in keep)).alias("row"), found.alias("found"))
    return rows.select("row", "found.base", "found.spans")


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs, whatever its columns, with every span of find() in text replaced by its kind in brackets; of overlapping ones the first names the whole."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in ALL))
    text = F.col("row.text")

    def step(a: Column, s: Column) -> Column:
        apart = s["start"] >= a["at"]
        out = F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"])))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(apart, out).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate("spans", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    rows = find(docs, docs.columns, model)
    return rows.select(F.col("row").withField("text", F.when(F.size("spans") > 0, done).otherwise(text)).alias("row")).select("row.*")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, ALL))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op13_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The digest of find() over all documents; n_found counts all spans."""
    rows = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["doc_id"])
    counts = [F.size(F.filter("base", _one(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return rows.select("row.doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_found"))


def _one(kind: int):
    return lambda s: s["kind"] == kind

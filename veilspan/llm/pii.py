"""Personal data by candidate gradient boosting (DataFrame operations only on the main path).

Generators with high recall propose spans, which may overlap. Each candidate gets features of its format (digits, separators,
checksum, octets) and of its context (neighbouring characters, words near it); boosted trees, fitted in numpy on the driver
and compiled into column expressions, score it; and it is redacted if the score reaches its kind's
calibrated threshold. The spans of the fixed base patterns always stay; a selected candidate is added where it overlaps no
base span and no better candidate.

The trees learn from candidates of the documents at hand, at most EXAMPLES of one text in SAMPLE, which checks label (checksum, octets, number of
digits, the name before a secret), and from as many made examples, which have shapes that the documents may lack (addresses spelt
out, numbers without +) with the words that go with them. Thresholds are set on the half of both that the trees haven't seen.

Everything happens inside the row of a document, so nothing is shuffled. Matches are marked by regexp_replace and cut by
split, which take time in proportion to the text, and are put together in pieces of PIECE; offsets are in code points. Runs are matched
possessively and from their start, so long runs cost no retries. Only candidates are compared with each other, document by document.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import text_of

KINDS = ("email", "ip", "card", "phone")
#: Keys, tokens and passwords: found and redacted like the others, and reported apart.
ALL = (*KINDS, "secret")
_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: Equal to the base patterns, leftmost and without overlap: a run is entered at its start, or where the last match ended.
BASE = (
    ("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++"),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
#: Generators: looser or tighter than the base, whose failures and greed they make up for; their spans may overlap.
GENERATORS = (
    ("email", r"(?<![\w.%+-])[\w.%+-]++[\x20]?(?:@|\(at\)|\[at\])[\x20]?[\w-]++(?:\.[\w-]++)++"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]{4}){2}[\x20.-]?[0-9]{1,7}(?![0-9])|(?<![0-9])3[0-9]{3}[\x20.-]?[0-9]{6}[\x20.-]?[0-9]{5}(?![0-9])"),
    ("phone", r"(?<![0-9])(?:\+|00)[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![0-9])\([0-9]{3}\)[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])"),
)
SECRET = ("secret", r"(?<![\w+/=-])(?=[A-Za-z_+/=-]*+[0-9])[\w+/=-]{20,100}+(?![\w+/=-])")
#: Marks the ends of matches; in texts it is first exchanged for another private-use character.
_MARK, _OTHER = "\uE000", "\uE001"
#: Code points of context on either side.
NEAR = 24
HINTS = r"(?i)(?:card|visa|master|amex|credit|phone|call|tel|mobile|fax|contact|mail|write|reach|host|server|login|from)"
AGAINST = r"(?i)(?:version|release|v\.|isbn|token|order|invoice|serial|build|section|sha|hash|item|part)"
NAMED = r"(?i)(?:token|secret|passw|api.?key|access.?key|private.?key|credential|bearer)[\w-]*[\x22']?\s*[=:]?\s*[\x22']?$"
FEATURES = ("kind", "length", "digits", "marks", "luhn", "octets", "before", "after", "hint", "against", "plus", "groups", "glued", "named")
TREES, DEPTH, EXAMPLES = 16, 4, 4000
#: Texts, of which one gives candidates to learn from.
SAMPLE = 16
#: Parts of a text that are put together at once.
PIECE = 128
#: The share of true spans among the examples at a kind's threshold, at least.
PRECISION = 0.98


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check; for short strings."""
    turned = F.split(F.reverse(digits), "")
    doubled = F.transform(turned, lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2) - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _octets(value: Column) -> Column:
    return value.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.(?!$)|$)){4}$")


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _octets(value)
    return _let(_digits(value), (lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False)) if kind == "card" else (lambda d: F.length(d).between(9, 15)))


def _matches(text: Column, pattern: str) -> Column:
    """Structs of start, end, value for the matches of the pattern in a text without _MARK."""
    parts = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(a: Column, p: Column) -> Column:
        end = a["at"] + F.length(p)
        span = F.struct(a["at"].alias("start"), end.alias("end"), p.alias("value"))
        return F.struct(end.alias("at"), (~a["in"]).alias("in"), F.when(a["in"], F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    def piece(parts: Column, at: Column) -> Column:
        return F.aggregate(parts, F.struct(at.alias("at"), F.lit(False).alias("in"), empty.alias("out")), step, lambda a: a["out"])

    def pieces(p: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / PIECE).cast("int")), lambda k: F.slice(p, k * PIECE + 1, F.lit(PIECE)))
        starts = F.aggregate(cut, F.array(F.lit(0)), lambda a, c: F.concat(a, F.array(F.aggregate(c, F.element_at(a, -1), lambda n, x: n + F.length(x)))))
        return _let(starts, lambda at: F.flatten(F.transform(cut, lambda c, k: piece(c, F.get(at, k)))))

    return _let(parts, lambda p: F.when(F.size(p) > PIECE, pieces(p)).when(F.size(p) > 1, piece(p, F.lit(0))).otherwise(empty))


def _spans(text: Column, patterns: tuple[tuple[str, str], ...], keep) -> Column:
    """Structs of kind (its place in KINDS), start, end, value; keep(kind, value) filters."""

    def of_kind(kind: str, pattern: str) -> Column:
        found = F.filter(_matches(text, pattern), lambda s: keep(kind, s["value"]))
        found = F.transform(found, lambda s: F.struct(F.lit(ALL.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
        needs = text.rlike("[0-9]") if kind != "email" else F.contains(text, F.lit("@")) | (F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]")) if patterns is not BASE else F.lit(False))
        return F.when(needs, found).otherwise(_none())

    return F.concat(*(of_kind(kind, pattern) for kind, pattern in patterns))


def _none() -> Column:
    return F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")


def _one(body):
    """body as a function of exactly one argument, as higher-order functions tell by it what to pass."""
    return lambda x: body(x)


def _features(text: Column, s: Column) -> dict[str, Column]:
    digits = _digits(s["value"])
    before, after = F.substring(text, s["start"], F.lit(1)), F.substring(text, s["end"] + 1, F.lit(1))
    left = F.substring(text, F.greatest(s["start"] - NEAR, F.lit(0)) + 1, F.least(s["start"], F.lit(NEAR)))
    around = F.concat(left, F.lit(" "), F.substring(text, s["end"] + 1, F.lit(NEAR)))
    side = lambda c: F.when(c == "", 0).when(c.rlike(r"^\s"), 0).when(c.rlike(r"^\w"), 2).otherwise(1)
    flag = lambda c: F.when(c, 1).otherwise(0)
    return {
        "kind": s["kind"],
        "length": F.length(s["value"]),
        "digits": F.length(digits),
        "marks": F.length(F.regexp_replace(s["value"], r"\w+", "")),
        "luhn": flag(F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)),
        "octets": flag(_octets(s["value"])),
        "before": F.when(s["start"] == 0, 0).otherwise(side(before)),
        "after": side(after),
        "hint": flag(around.rlike(HINTS)),
        "against": flag(left.rlike(AGAINST)),
        "plus": flag(s["value"].startswith("+")),
        "groups": F.size(F.split(s["value"], r"[^0-9A-Za-z]+")),
        "glued": flag(F.when(s["start"] == 0, False).otherwise(before.rlike(r"[.,:/=_-]"))),
        "named": flag(left.rlike(NAMED)),
    }


def _luhn_ok(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def _example(rng: random.Random) -> tuple[int, str, str, str, int]:
    """kind, left context, value, right context, label: one made span."""
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    kind, good = rng.randrange(len(ALL)), rng.random() < 0.5
    hints = ["card ", "visa ", "phone ", "call ", "tel: ", "contact ", "mail ", "host ", "from "]
    against = ["version ", "release v.", "isbn ", "token=", "order ", "serial ", "build ", "section ", "sha:"]
    left = rng.choice(["", word() + " ", word() + ". ", word() + "\n", word() + ": ", "(", word() + ", "])
    right = rng.choice(["", " " + word(), ".", ", " + word(), "!!", "$$$", "###", ")", "\n"])
    if rng.random() < 0.25:
        left += rng.choice(hints if good or rng.random() < 0.3 else against)
    if kind == 0:
        value = f"{word()}{rng.choice(['.', '_', ''])}{number(rng.randint(0, 2))}{rng.choice(['@', '@', '@', ' (at) ', '[at]'])}{word()}.{rng.choice(['com', 'org', 'example.net', 'de'])}"
        if not good:
            value = f"{word()}@{rng.choice([number(1), '-'])}.{number(2)}"
            left += rng.choice(["git:", "pkg/", "token="])
    elif kind == 1:
        parts = [rng.randint(0, 255) for _ in range(4)]
        if not good:
            parts = rng.choice([[rng.randint(0, 12) for _ in range(4)], [rng.randint(256, 999), *parts[1:]], [*parts[:3], rng.randint(256, 999)]])
            left += rng.choice(["version ", "v.", "section ", "release "]) if max(parts) < 256 else ""
        value = ".".join(map(str, parts))
    elif kind == 2:
        d = number(rng.choice([16, 16, 16, 15, 13, 19]))
        d = next(d[:-1] + c for c in "0123456789" if _luhn_ok(d[:-1] + c) == good)
        cut = rng.choice(["", "", " ", "-", "."])
        value = cut.join([d[:4], d[4:8], d[8:12], d[12:]])
    elif kind == 4:
        letters = rng.choice(["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"])
        value = "1" + "".join(rng.choice(letters) for _ in range(rng.choice([20, 24, 32, 40, 40, 64])))
        left += rng.choice(['token = "', "api_key=", 'secret: "', "password: ", "Authorization: Bearer ", "access-key ", "token "]) if good else rng.choice(["sha256:", "commit ", "md5 ", "id=", "/v/", "", "hash "])
        right = rng.choice(['"', " " + word(), "", "\n"])
    else:
        cut = rng.choice([" ", "-", "."])
        value = rng.choice([f"+{number(1)} ({number(3)}) {number(3)}-{number(4)}", f"+{number(2)}{cut}{number(3)}{cut}{number(3)}{cut}{number(3)}", f"({number(3)}) {number(3)}-{number(4)}"])
        if not good:
            value = rng.choice([f"00{number(1)}{cut}{number(2)}{cut}{number(2)}{cut}{number(2)}", f"+{number(1)}{number(2)}{number(2)}{number(2)}", f"00{number(12)}"])
            left += rng.choice(["item ", "part ", "order ", "= ", "sum_"])
    return kind, left, value, right, int(good)


def _example_features(kind: int, left: str, value: str, right: str) -> list[float]:
    """_features() of an example, in Python."""
    digits = re.sub("[^0-9]", "", value)
    side = lambda c: 0 if not c or c.isspace() else 2 if c.isalnum() or c == "_" else 1
    near = left[-NEAR:]
    octets = re.fullmatch(r"[0-9]+(\.[0-9]+){3}", value) and all(int(p) <= 255 for p in value.split("."))
    return [
        kind,
        len(value),
        len(digits),
        len(re.sub(r"\w+", "", value)),
        13 <= len(digits) <= 19 and _luhn_ok(digits),
        bool(octets),
        side(left[-1:]),
        side(right[:1]),
        bool(re.search(HINTS, f"{near} {right[:NEAR]}")),
        bool(re.search(AGAINST, near)),
        value.startswith("+"),
        len(re.split("[^0-9A-Za-z]+", value)),
        bool(left[-1:] and left[-1] in ".,:/=_-"),
        bool(re.search(NAMED, near)),
    ]


@dataclass(frozen=True)
class Model:
    """Trees, and each kind's least margin."""

    trees: boosting.Boosted
    limits: tuple[float, ...]

    def margin(self, features: Column) -> Column:
        total = F.lit(self.trees.prior)
        for tree in self.trees.trees:
            leaf = None
            for terms, value in tree:
                holds = F.lit(True)
                for f, above, bound in terms:
                    holds &= (features[FEATURES[f]] > bound) if above else (features[FEATURES[f]] <= bound)
                leaf = F.when(holds, F.lit(value)) if leaf is None else leaf.when(holds, F.lit(value))
            total += leaf.otherwise(F.lit(0.0))
        return total


def _candidates(text: Column) -> Column:
    return _spans(text, (*GENERATORS, SECRET), lambda k, v: F.lit(True))


def seen(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most EXAMPLES candidates of one text in SAMPLE of docs (text), by hash; the checks label them."""
    text = F.translate(text_of(docs), _MARK, _OTHER)
    some = docs.where(F.pmod(F.xxhash64(text_of(docs)), F.lit(SAMPLE)) == 0).select(text.alias("text")).where(F.col("text").rlike("[0-9@]|\\(at\\)|\\[at\\]"))
    rows = some.select("text", F.explode(_candidates(F.col("text"))).alias("s"))
    f = F.struct(*(c.cast("double").alias(n) for n, c in _features(F.col("text"), F.col("s")).items()))
    rows = rows.select(f.alias("f"), F.col("s.value").alias("value"))
    kind = lambda k: F.col("f.kind") == ALL.index(k)
    address = F.col("value").rlike(rf"^[{_LOCAL}]+[\x20]?(?:@|\(at\)|\[at\])[\x20]?(?:[{_HOST}]+\.)+[A-Za-z]{{2,}}$")
    good = F.when(kind("email"), address).when(kind("ip"), (F.col("f.octets") == 1) & (F.col("f.against") == 0)).when(kind("card"), F.col("f.luhn") == 1).when(kind("phone"), F.col("f.digits").between(9, 15) & (F.col("f.plus") == 1)).otherwise(F.col("f.named") == 1)
    got = rows.select("f.*", good.cast("int").alias("y")).distinct().orderBy(F.xxhash64(*FEATURES), *FEATURES).limit(EXAMPLES).collect()
    return np.array([[r[c] for c in FEATURES] for r in got], float).reshape(len(got), len(FEATURES)), np.array([r.y for r in got], int)


def made(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of EXAMPLES made examples."""
    rng = random.Random(seed)
    examples = [_example(rng) for _ in range(EXAMPLES)]
    return np.array([_example_features(*e[:4]) for e in examples], float), np.array([e[4] for e in examples])


def fit(docs: DataFrame) -> Model:
    """Trees from every second example, and each kind's least margin with PRECISION over the others, of candidates of docs and made ones alike."""
    parts = [seen(docs), made()]
    x, y = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    learn = np.arange(len(x)) % 2 == 0
    trees = boosting.fit(x[learn], y[learn], TREES, DEPTH)
    margins, kinds, truth = trees.margins(x[~learn]), x[~learn, 0], y[~learn]
    out = []
    for k in range(len(ALL)):
        m, t = margins[kinds == k], truth[kinds == k]
        order = np.argsort(-m)
        right = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
        right[:-1][m[order][1:] == m[order][:-1]] = 0  # equal margins go together
        good = np.flatnonzero(right >= PRECISION)
        out.append(float(m[order][good[-1]]) if len(good) else float("inf"))
    return Model(trees, tuple(out))


def _selected(text: Column, candidates: Column, model: Model) -> Column:
    """Candidates with their margins, those that reach the threshold of their kind."""
    limits = F.array(*map(F.lit, model.limits))

    def scored(s: Column) -> Column:
        features = F.struct(*(c.cast("double").alias(n) for n, c in _features(text, s).items()))
        return _let(features, lambda f: F.struct((-model.margin(f)).alias("cost"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    return F.filter(F.transform(candidates, scored), lambda s: -s["cost"] >= F.get(limits, s["kind"]))


def _added(base: Column, chosen: Column) -> Column:
    """base and, best first, each chosen span that overlaps nothing before it."""

    def step(a: Column, s: Column) -> Column:
        clash = F.exists(a, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return F.when(clash, a).otherwise(F.concat(a, F.array(F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))))

    return F.when(F.size(chosen) > 0, F.aggregate(F.array_sort(chosen), base, step)).otherwise(base)


def find(docs: DataFrame, keep: list[str], model: Model | None = None) -> DataFrame:
    """Each row of docs (text) with its spans: arrays of kind (its place in ALL), start, end, value, ordered.

    Returns row (a struct of the columns in keep), base, spans (of KINDS) and secrets; without a model, one is fitted on docs. Offsets are code
    points of the text, end exclusive. A null or empty text has no spans; equal texts get equal spans. Columns may have any names. An
    empty table gives no rows. Very long texts are worked on whole.
    """
    model = model or fit(docs)
    text = F.translate(text_of(docs), _MARK, _OTHER)
    found = _let(text, lambda t: F.when(t.rlike("[0-9@]|\\(at\\)|\\[at\\]"), _let(_spans(t, BASE, _valid), lambda b: F.struct(b.alias("base"), _added(b, _selected(t, _candidates(t), model)).alias("spans")))))
    rows = docs.select(F.struct(*(docs[c] for c in keep)).alias("row"), found.alias("found"))
    base, spans = (F.coalesce(F.col("found")[c], _none()) for c in ("base", "spans"))
    rows = rows.select("row", base.alias("base"), F.array_sort(spans).alias("every"))
    secret = ALL.index("secret")
    return rows.select("row", "base", F.filter("every", lambda s: s["kind"] != secret).alias("spans"), F.filter("every", lambda s: s["kind"] == secret).alias("secrets"))


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs, whatever its columns, with every span and secret of find() in text replaced by its kind in brackets."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in ALL))
    out = find(docs, docs.columns, model)
    spans = F.array_sort(F.transform(F.concat("spans", "secrets"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    out = out.select("row", spans.alias("s"))
    text = F.col("row.text")
    done = F.aggregate(
        "s",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"]))).alias("out")),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))),
    )
    return out.select(F.col("row").withField("text", F.when(F.size("s") > 0, done).otherwise(text)).alias("row")).select("row.*")


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """The digest of find() over all documents; n_found counts spans and secrets."""
    rows = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["doc_id"])
    counts = [F.size(F.filter("base", _one(lambda s, k=k: s["kind"] == k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    more = [F.size("secrets").cast("long").alias("n_secret"), (F.size("spans") + F.size("secrets")).cast("long").alias("n_found")]
    return rows.select("row.doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), *more)

import random
import re
from collections import Counter, defaultdict

import pytest

from veilspan.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, top=D.TOP_TERMS):
    """audit() of (text, lang, source) in Python integers, pair by pair."""
    groups, df, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source, terms = lang or "", source or "", TERM.findall(lower(text or ""))
        groups[lang, source].update(terms)
        df[lang].update(set(terms))
        langs[lang].update(terms)
    out = set()
    for (lang, source), counts in groups.items():
        kept = [t for t, n in df[lang].items() if n >= D.MIN_DOCS]

        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        f = lambda p, q: (p - q) * (p - q) // q
        p, q = share(counts), share(langs[lang])
        values = {"pair": {}, "term": {t: f(p[t], q[t]) for t in kept if counts[t] and p[t] > q[t]}}
        for (other, item), theirs in groups.items():
            if other == lang and item != source:
                s = share(theirs)
                values["pair"][item] = sum(f(p[t], s[t]) for t in kept)
        for part, found in values.items():
            ranked = sorted(found.items(), key=lambda kv: (-kv[1], kv[0].encode()))
            out |= {(lang, source, part, k, v, i + 1) for i, (k, v) in enumerate(ranked) if part == "pair" or i < top}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["ÉTÉ", "é", "日本", "a_b", "x9y"]
    out = [(" ".join(rng.choices(words, k=rng.randint(0, 60))), rng.choice(("en", "en", "de", None)), rng.choice(("a", "b", "B", "é", "", None))) for _ in range(160)]
    out += [(None, "fr", "only"), ("", "xx", None), ("one two", "xx", "z"), ("three", "xx", "y"), ("same " * 40, "en", "hot")] + [("same same text", "en", "hot")] * 40
    return out


def get(df):
    return {tuple(r) for r in df.collect()}


def test_equals_plain_version(spark, rows):
    df = D.audit(spark.createDataFrame(rows, "text string, lang string, source string").repartition(3))
    got = get(df)
    assert got == plain(rows) and df.count() == len(got)
    assert ("xx", "z", "pair", "", 0, 1) in got  # a language without kept terms


def test_blocks_chunks_and_stripes_change_nothing(spark, rows, monkeypatch):
    for name, value in {"BLOCK": 2, "CHUNK": 8, "STRIPE": 3, "HELD": 50}.items():
        monkeypatch.setattr(D, name, value)
    assert get(D.audit(spark.createDataFrame(rows, "text string, lang string, source string"))) == plain(rows)


def test_top_terms_and_large_counts(spark):
    import numpy as np

    rows = [(" ".join(f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)), "en", s) for s in "abc"] + [(" ".join(f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)), "en", "a")]
    got = get(D.audit(spark.createDataFrame(rows, "text string, lang string, source string"), top_terms=20))
    assert got == plain(rows, 20)
    counts = np.array([[3 * 10**12, 0, 7]])
    total = counts.sum(1)
    assert D.shares(counts, total, 3).tolist() == [[1 + 10**9 * (int(c) + 1) // (int(total[0]) + 3) for c in counts[0]]]

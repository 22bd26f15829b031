import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilspan.llm import simhash, simhash_wide
from veilspan.llm.textbytes import mixed


def fingerprint(text, k=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    parts = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    counts = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for i in range(64):
            counts[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * counts[i] > len(parts))


def roots(prints, reach=2):
    """The smallest of each print's component, by comparing all pairs."""
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= reach:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def test_query_equals_plain_version(spark, folder, rows):
    got = simhash.op3_simhash_near_dedup(spark, folder).collect()
    prints = {f"{fingerprint(r[1]):016x}" for r in rows}
    root = roots(sorted(int(p, 16) for p in prints))
    least = {}
    for r in rows:
        key = root[fingerprint(r[1])]
        if r[0] is not None:
            least[key] = min(least.get(key, r[0]), r[0])
    want = sorted(((r[0], f"{fingerprint(r[1]):016x}", least.get(root[fingerprint(r[1])])) for r in rows), key=repr)
    assert sorted(map(tuple, got), key=repr) == want


@pytest.mark.parametrize("hot", [64, 3, 0])
def test_links_give_the_components_of_all_pairs(spark, hot):
    rng = random.Random(3)
    prints = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 30)):
            x = base
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            prints.add(np.int64(np.uint64(x)).item())
    prints = sorted(prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df, hot)).collect()}
    assert {p: got.get(p, p) for p in prints} == roots(prints)


@pytest.mark.parametrize("hot", [8, 2])
def test_crowded_fingerprints_are_split(spark, hot):
    """Many that agree in four bytes, some of which agree in six or are within two bits."""
    rng = random.Random(9)
    prints = {np.int64(np.uint64(0xABCD1234 << 32 | rng.getrandbits(32))).item() for _ in range(150)}
    prints |= {np.int64(np.uint64(p & (1 << 64) - 1 ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))).item() for p in list(prints)[:60]}
    prints |= {np.int64(np.uint64(0x1111111111110000 + rng.getrandbits(16))).item() for _ in range(60)}
    prints = sorted(prints)
    got = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), hot)).collect()}
    assert {p: got.get(p, p) for p in prints} == roots(prints)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def jaccard(a, b):
    s = [set(simhash.shingles(t.encode(), 5)) for t in (a, b)]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_one_of_each_keeps_one_of_a_group(spark, docs, rows):
    kept = simhash_wide.one_of_each(docs)
    assert kept.columns == docs.columns
    got = {(r.doc_id, r.text) for r in kept.collect()}
    assert kept.count() == len(got)
    texts = {r[0]: r[1] for r in rows}
    copies = {i for i in texts if i is not None and i < 75 and (texts[i] or "").strip() and jaccard(texts[i], texts[0]) >= 0.8}
    assert copies >= {0, 60, 61, 62, 63} and {i for i, _ in got} & copies == {0}
    assert set(range(1, 60)) <= {i for i, _ in got}  # ordinary texts stay
    assert len([1 for i, t in got if not (t or "").strip()]) == 1  # empty texts are copies of each other


def test_verification_drops_what_only_looks_alike(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(300)]
    texts = []
    for edits in (0, 1, 5, 30, 60):
        w = list(base)
        for i in range(edits):
            w[i * 5] = f"new{edits}x{i}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash_wide.one_of_each(docs).collect()}
    for i, t in enumerate(texts):
        if jaccard(t, texts[0]) < 0.8:
            assert i in kept
    assert 0 in kept and 1 not in kept and 2 not in kept


def test_empty_input(spark, docs):
    assert simhash_wide.one_of_each(docs.limit(0)).count() == 0


def near_components(texts):
    """The smallest id of each text's component, by the Jaccard similarity of all pairs."""
    parent = {i: i for i in texts}
    sets = {i: set(simhash.shingles(t.lower().encode(), 5)) for i, t in texts.items()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in texts:
        for j in texts:
            if j < i and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def jaccard_pairs(texts):
    """Pairs of ids with different sets of five-word shingles at a Jaccard similarity of 0.8 or more."""
    sets = {i: set(simhash.shingles(t.lower().encode(), 5)) for i, t in texts.items()}
    return {(i, j) for i in texts for j in texts if i < j and sets[i] != sets[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))}


def nodes_of(spark, texts):
    return spark.createDataFrame([(i, simhash_wide.fingerprint(t.encode())) for i, t in texts.items()], "fp long, simhash array<long>")


def met(listed):
    """Distinct pairs of members of a list that share a byte of the word that they carry."""
    x, y = (listed.selectExpr("name", f"fp as {side}", f"word as w{side}") for side in "ab")
    return x.join(y, "name").where("a < b").where(simhash_wide._touching(F.col("wa"), F.col("wb"))).select("a", "b").distinct()


def near_texts(rng, pairs, least=60):
    """Pairs of texts, changed word by word or in one block, by as much as a similarity of 0.8 allows or less."""
    texts, vocabulary = {}, [f"w{i}" for i in range(3000)]
    for _ in range(pairs):
        n = rng.randint(least, 400)
        base = rng.choices(vocabulary, k=n)
        other = list(base)
        if rng.random() < 0.5:
            for i in rng.sample(range(n), rng.randint(1, max(1, n // 46))):
                other[i] = rng.choice(vocabulary)
        else:
            k = rng.randint(1, max(1, n // 10))
            at = rng.randrange(n - k)
            other[at : at + k] = rng.choices(vocabulary, k=rng.choice((0, k)))
        texts[len(texts)] = " ".join(base)
        texts[len(texts)] = " ".join(other)
    return texts


def test_recall_by_pairs_of_the_index(spark):
    """Of all pairs at a similarity of 0.8 or more, nine in ten meet in a list at least, and all of these pass the count filter."""
    texts = near_texts(random.Random(31), 500)
    want = jaccard_pairs(texts)
    nodes = nodes_of(spark, texts)
    listed = simhash_wide.members(nodes, nodes.count())
    together = {(r.a, r.b) for r in met(listed).collect()}
    kept = {(r.a, r.b) for r in simhash_wide._counted(met(listed), nodes).collect()}
    assert len(want) > 400 and len(want & together) >= 0.9 * len(want)
    assert want & together == want & kept and len(kept) <= len(together)


def test_recall_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = near_components(texts)
    got = {r.doc_id: r.component_id for r in simhash_wide.near_duplicates(docs).collect()}
    assert all(want[i] == want[root] for i, root in got.items())  # nothing is linked that isn't near
    joined = lambda c: len(texts) - len(set(c.values()))
    assert joined(want) > 20 and joined(got) >= 0.9 * joined(want)


def test_what_meets_is_verified_exactly(spark):
    """Pairs just over and just under the limit: no link under it."""
    rng = random.Random(11)
    texts = {}
    for k in range(80):
        n = rng.randint(40, 200)
        shared = [f"k{k}w{rng.randrange(10**6)}" for _ in range(n)]
        own = (n - 4) // 8 + k % 3 - 1
        for side in "ab":
            texts[len(texts)] = " ".join(shared + [f"{side}{k}x{i}" for i in range(own)])
    want = near_components(texts)
    got = {r.doc_id: r.component_id for r in simhash_wide.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert all(want[i] == want[root] for i, root in got.items())
    joined = lambda c: len(texts) - len(set(c.values()))
    assert joined(want) > 20 and joined(got) >= 0.8 * joined(want)  # all at the limit, where the index is weakest


@pytest.mark.parametrize("hot", [16, 4, 0])
def test_long_lists_lose_no_pair(spark, hot):
    """Groups that share a passage, each with changed copies: the components are those of all pairs that meet, whatever the length of lists."""
    rng = random.Random(12)
    common = [f"common{i}" for i in range(60)]
    texts = {}
    for g in range(20):
        base = common + [f"g{g}w{i}" for i in range(30 + g)]
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(w)
    for _ in range(30):  # passage and a little more
        texts[len(texts)] = " ".join(common + [f"m{rng.randrange(10**6)}" for _ in range(rng.randint(1, 12))])
    near = {(min(a, b), max(a, b)) for a, b in jaccard_pairs(texts)}
    nodes = nodes_of(spark, texts)
    kept = {(r.a, r.b) for r in simhash_wide._counted(met(simhash_wide.members(nodes, nodes.count())), nodes).collect()}
    equal = [(i, j) for i in texts for j in texts if i < j and texts[i] == texts[j]]
    want = joined_by(texts, [p for p in near if p in kept] + equal)
    got = {r.doc_id: r.component_id for r in simhash_wide.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), hot=hot).collect()}
    assert got == want
    assert 20 < len(set(want.values())) < len(texts)


def joined_by(ids, links):
    """The smallest id of each id's component; ids with equal sets are not joined by it."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_rows_that_share_an_id_lose_no_group(spark):
    long_ = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    rows = [(5, long_[0]), (5, long_[1]), (3, long_[1]), (9, long_[0]), (None, long_[2]), (None, long_[2]), (7, None), (2, ""), (7, None), (4, long_[2] + " x"), (4, long_[2] + " x")]
    kept = simhash_wide.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(5, long_[0]), (3, long_[1]), (4, long_[2] + " x"), (2, "")], key=repr)


def edited(rng, groups):
    """Texts by id: groups of copies with up to 24 words changed of 400."""
    texts = {}
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(400)]
        for k in (0, 1, 2, 4, 8, 24):
            w = list(base)
            for i in rng.sample(range(400), k):
                w[i] = f"new{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(w)
    return texts


def wide_bytes(texts):
    return {i: b"".join((w & (1 << 64) - 1).to_bytes(8, "little") for w in simhash_wide.fingerprint(t.encode())) for i, t in texts.items()}


@pytest.mark.parametrize("nodes_count", [100, 1 << 25])
def test_simhash_index_equals_plain_version(spark, nodes_count):
    """Pairs that share a list and enough bytes; the choices of positions for more nodes too."""
    texts = edited(random.Random(21), 12)
    prints, chosen = wide_bytes(texts), simhash_wide.places(nodes_count)
    assert len(chosen) == (192 if nodes_count < 1 << 24 else 768) and {len(set(c)) for c in chosen} == {3 if nodes_count < 1 << 24 else 4}
    lists = {}
    for i, p in prints.items():
        for k, c in enumerate(chosen):
            lists.setdefault((k, *(p[x] for x in c)), []).append(i)
    others = [simhash_wide.other_word(k, c) for k, c in enumerate(chosen)]
    assert all(o not in {x // 8 for x in c} for o, c in zip(others, chosen))
    touching = lambda a, b, w: any(prints[a][8 * w + i] == prints[b][8 * w + i] for i in range(8))
    want = {(a, b) for (k, *_), m in lists.items() for a in m for b in m if a < b and touching(a, b, others[k])}
    want = {(a, b) for a, b in want if sum(x == y for x, y in zip(prints[a], prints[b])) >= simhash_wide.SHARED}
    nodes = nodes_of(spark, texts)
    listed = simhash_wide.members(nodes, nodes_count)
    assert {(r.a, r.b) for r in simhash_wide._counted(met(listed), nodes).collect()} == want and len(want) > 60
    assert sorted(r["size"] for r in listed.collect()) == sorted(len(m) for m in lists.values() if len(m) > 1 for _ in m)


def test_count_filter_is_the_guaranteed_minimum():
    """Fingerprints of BYTES bytes that differ in SURE bits agree in SHARED bytes at least, and may agree in no more."""
    assert simhash_wide.BYTES - simhash_wide.SURE == simhash_wide.SHARED > 0


def test_fingerprint_is_the_majority_of_the_hashes_of_runs():
    rng = random.Random(22)
    words = [f"w{rng.randrange(50)}" for _ in range(90)]
    a, b, c = (simhash_wide.fingerprint(" ".join(w).encode()) for w in (words, [w.upper() for w in words], words + words[:30]))
    assert a == b and a != c and len(set(a)) == simhash_wide.WORDS
    factor, mask = int(simhash_wide._FACTOR), (1 << 64) - 1
    h = [xxhash.xxh64_intdigest(w, 42) for w in words]
    runs = [(x * factor + y) & mask for x, y in zip(h, h[1:])]
    runs = [int(mixed(np.array([r ^ r >> 29], np.uint64))[0]) for r in runs]  # repeats included
    assert a[0] & mask == sum(1 << i for i in range(64) if 2 * sum(r >> i & 1 for r in runs) > len(runs))
    assert simhash_wide.fingerprint(b" \n") == [0] * simhash_wide.WORDS


def test_stage_is_decided_by_the_index(spark, monkeypatch):
    """Copies with words changed are found; without what meets in the index nothing is."""
    texts = edited(random.Random(23), 20)
    want = near_components(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in simhash_wide.one_of_each(docs).collect()} == set(want.values())
    monkeypatch.setattr(simhash_wide, "_counted", lambda pairs, nodes: pairs.limit(0))
    assert {r.doc_id for r in simhash_wide.one_of_each(docs).collect()} == set(texts)


def test_a_group_meets_in_its_first_lists(spark, monkeypatch):
    """A large group of near copies is joined in the lists of one shuffle of the positions: its members don't meet the centres of all their lists, in groups of two sizes."""
    given, stars = [], simhash_wide.stars
    monkeypatch.setattr(simhash_wide, "stars", lambda rows, *more: given.append(rows.count()) or stars(rows, *more))
    for size in (60, 120):
        rng = random.Random(size)
        base, texts = [f"w{rng.randrange(10**6)}" for _ in range(400)], {}
        for i in range(size):
            w = list(base)
            w[rng.randrange(400)] = f"new{i}"
            texts[i] = " ".join(w)
        given.clear()
        got = {r.doc_id: r.component_id for r in simhash_wide.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
        assert got == near_components(texts) and set(got.values()) == {0}
        assert 0 < sum(given) <= 22 * size  # of 192 lists


def test_pairs_that_meet_may_be_near_by_their_sketches(spark, monkeypatch):
    """Texts that share three in four of their words meet in lists, and none of their pairs is carried on to be verified."""
    rng, counted, seen = random.Random(33), simhash_wide._counted, []
    common, texts = [f"common{i}" for i in range(180)], {}
    for i in range(60):
        texts[i] = " ".join(common + [f"m{i}x{rng.randrange(10**6)}" for _ in range(60)])
    monkeypatch.setattr(simhash_wide, "_counted", lambda pairs, nodes: seen.append(pairs.count()) or counted(pairs, nodes))
    nodes = nodes_of(spark, texts)
    assert met(simhash_wide.members(nodes, nodes.count())).count() > 20
    got = {r.doc_id: r.component_id for r in simhash_wide.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {i: i for i in texts} and sum(seen) == 0


def test_what_the_first_lists_leave_is_joined_in_the_others(spark, monkeypatch):
    texts = edited(random.Random(24), 10)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    roots_of = lambda: {r.doc_id: r.component_id for r in simhash_wide.near_duplicates(docs).collect()}
    want = roots_of()
    monkeypatch.setattr(simhash_wide, "first_lists", lambda nodes_count: F.lit(False))
    assert roots_of() == want == near_components(texts)


@pytest.mark.parametrize("nodes_count, first", [(100, 21), (1 << 25, 16)])
def test_first_lists_are_those_of_the_first_shuffle(spark, nodes_count, first):
    chosen = simhash_wide.places(nodes_count)
    assert len({i for c in chosen[:first] for i in c}) == first * len(chosen[0]) <= simhash_wide.BYTES < (first + 1) * len(chosen[0])
    names = simhash_wide._postings(nodes_of(spark, {0: "a few words in a text"}), chosen).withColumn("first", simhash_wide.first_lists(nodes_count)).collect()
    assert [r["first"] for r in names] == [k < first for k in range(len(chosen))]

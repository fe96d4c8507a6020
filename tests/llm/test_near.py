"""BagMinHash: estimates, and classes against brute force."""

import random
from collections import Counter

import numpy as np
from greenframe.llm import near
from greenframe.llm.common import documents


def bag(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def classes(rows):
    """Smallest id of the component of each id, by comparing all pairs."""
    bags = {i: bag(t) for i, t in rows}
    root = {i: i for i in bags}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(bags)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = bags[i], bags[j]
            if (not a and not b) or (a and b and jaccard(a, b) >= 0.8):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_estimates_are_unbiased():
    rng = np.random.default_rng(5)
    for _ in range(6):
        elements = rng.integers(1, 1 << 60, 40).astype(np.uint64)
        a, b = rng.integers(0, 9, 40), rng.integers(0, 9, 40)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        got = near.bag_signatures([(elements[a > 0], a[a > 0]), (elements[b > 0], b[b > 0])], 4000)
        assert abs((got[0] == got[1]).mean() - want) < 0.04


def test_similarity():
    rng = random.Random(1)
    for _ in range(30):
        a = " ".join(rng.choice("ab") for _ in range(rng.randint(0, 30)))
        b = " ".join(rng.choice("ab") for _ in range(rng.randint(0, 30)))
        assert abs(near.similarity(near.bag_members(a.encode().split()), near.bag_members(b.encode().split())) - (jaccard(bag(a), bag(b)))) < 1e-12 or min(len(a.split()), len(b.split())) < 5


def test_parities_never_differ_more_than_members():
    rng = np.random.default_rng(3)
    for n in (0, 1, 50, 300, 5000):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: 4 * len(x) // 5], rng.integers(0, 1 << 63, n // 4).astype(np.uint64)]))
        odd = sum(bin(int(a) & (1 << 64) - 1).count("1") for a in near.parities(x) ^ near.parities(y))
        assert len(near.parities(x)) == near.PARITIES and odd <= len(np.setxor1d(x, y))


def test_classes_of_given_documents(spark, folder):
    docs = documents(spark, folder)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r["class_id"] for r in near.near_classes(docs).collect()}
    want = classes(rows)
    assert got == want and len(set(want.values())) < len(want)


def test_chains_and_edge_cases(spark):
    rng = random.Random(2)
    chain, rows = [f"w{i}" for i in range(120)], []
    for i in range(40):  # each differs from the next in one word, so far ones differ much
        rows.append((100 + (i * 17) % 40, " ".join(chain)))
        chain[rng.randrange(120)] = f"new{i}"
    rows += [(1, None), (2, ""), (3, " \n"), (4, "only three words"), (5, "only three  words"), (6, "x " * 30_000), (7, "x " * 29_000), (8, "x " * 10_000), (8, "x " * 10_000)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows] + [(None, "no id", "k")], "doc_id long, text string, key string")
    out = near.near_classes(df).collect()
    got = {r["doc_id"]: r["class_id"] for r in out}
    assert got.pop(None) is None
    assert got == classes(rows)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in out if r["doc_id"] is not None)
    assert len(out) == len(rows) + 1


def test_rows_that_share_an_id(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(100)) for x in "ab")
    rows = [(1, one), (2, two), (5, one + " more"), (5, two + " more"), (None, two + " end"), (None, "alone"), (7, one), (7, one)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, _gone int, number int")
    got = sorted(((r["doc_id"] or 0, r["class_id"] or 0, r["copy_of"] or 0, r["kept"]) for r in near.near_classes(df).collect()))
    assert got == [(0, 0, 0, True), (0, 2, 0, False), (1, 1, 1, True), (2, 2, 2, True), (5, 1, 5, False), (5, 2, 5, False), (7, 1, 1, False), (7, 1, 1, False)]
    kept = near.without_near_copies(df)
    assert kept.columns == df.columns and sorted(r["text"] for r in kept.collect()) == sorted([one, two, "alone"])


def test_kept_rows_of_chains(spark):
    rng = random.Random(2)
    chain, rows = [f"w{i}" for i in range(120)], []
    for i in range(40):
        rows.append((100 + (i * 17) % 40, " ".join(chain)))
        chain[rng.randrange(120)] = f"new{i}"
    rows += [(1, None), (2, ""), (3, " \n"), (4, "only three words"), (5, "only three  words"), (6, "x " * 30_000), (7, "x " * 29_000), (8, "x " * 10_000), (8, "x " * 10_000)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows] + [(None, "no id", "k")], "doc_id long, text string, key string")
    assert sorted(r["doc_id"] for r in near.without_near_copies(df).collect() if r["doc_id"] is not None) == [1, 2, 3, 4, 6, 8, 8, 100]
    assert near.near_classes(df.filter("false")).count() == 0


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, i) for i in range(101, 130)]
    rest = [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    for links in (chain + star + rest, star, []):
        root = {n: n for link in links for n in link}
        for _ in root:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        alone = {n for a, b in links if a == b for n in (a,)} - {n for a, b in links if a != b for n in (a, b)}
        got = near.components(spark.createDataFrame(links, "a long, b long"))
        assert sorted(map(tuple, got.collect())) == sorted((n, r) for n, r in root.items() if n not in alone)
    roots = near.components(spark.createDataFrame(star, "a long, b long"))
    more = near.joined(roots, spark.createDataFrame([(50, 120), (50, 51)], "a long, b long")).collect()
    assert {r["root"] for r in more} == {50} and len(more) == 32

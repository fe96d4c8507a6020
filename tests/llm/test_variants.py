"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from greenframe.llm import queries, variants
from greenframe.llm.common import documents

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_words(rows, every=97):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(words):
    near, by_key = {w: set() for w in words}, {}
    for w in words:
        for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_key.setdefault(k, set()).add(w)
    for group in by_key.values():
        for a in group:
            near[a] |= {b for b in group if distance_one(a, b)}
    form = {w: min(near[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: f if f and words[f] >= 2 * words[w] else None for w, f in form.items()}
    rows = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return rows


def rows_of(df):
    return [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]


def test_query(spark, folder):
    want = brute(brute_words([(r["doc_id"], r["text"]) for r in documents(spark, folder).collect()]))
    got = rows_of(queries.word_variants(spark, folder))
    assert len(got) == len(want) and set(got) == want
    assert any(form and root != form for _, form, root, *_ in got) or any(form for _, form, *_ in got)


@pytest.mark.parametrize("most,bucket", [(50_000, 24), (40, 2), (3, 1)])
def test_dense_words(spark, monkeypatch, most, bucket):
    # few letters, so that many words are near each other and many are anagrams
    monkeypatch.setattr(variants, "MOST_WORDS", most)
    monkeypatch.setattr(variants, "BUCKET", bucket)
    rng, words = random.Random(2), Counter()
    for _ in range(1500):
        words["".join(rng.choices("abcÿé", weights=[5, 5, 1, 1, 1], k=rng.randrange(5, 9)))] += rng.choice([3, 4, 9, 20, 50])
    rows = [(1, " ".join([w] * n)) for w, n in words.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(variants.spelling_variants(df, every=None))
    assert len(got) == len(words) and set(got) == brute(dict(words))


def test_many_anagrams_meet_by_halves():
    rng = random.Random(4)
    words = sorted({"".join(rng.sample("aaaabbbbcccc", 12)) for _ in range(500)})
    asked = [w[:3] + "x" + w[4:] for w in words[:200]] + [w[:-1] for w in words[:50]]
    code = lambda x: [w.encode("latin-1") for w in x]
    i, j = variants.halves(code(words), code(asked))
    found = {(a, b) for a, b in zip(i, j) if distance_one(words[a], asked[b])}
    assert found == {(a, b) for a in range(len(words)) for b in range(len(asked)) if distance_one(words[a], asked[b])}


def test_pairs_of_letters():
    rng = random.Random(6)
    words = ["".join(rng.choices("abc", k=rng.randrange(1, 7))) for _ in range(150)] + ["a" * 47, "a" * 48, "a" * 49, "a" * 50 + "b", "a" * 51]
    letters = variants.Letters([w.encode() for w in words])
    import numpy as np

    i, j = (x.ravel() for x in np.meshgrid(range(len(words)), range(len(words))))
    got = letters.one_edit(letters, i, j)
    assert got.tolist() == [distance_one(words[a], words[b]) for a, b in zip(i, j)]


def test_edge_cases(spark):
    schema = "doc_id long, text string, word string, n int"
    long = "x" * 70_000
    rows = [(1, "Hello hello HELLO hallo hallo hallo hallo hallo hallo"), (2, None), (3, ""), (None, "hellos hellos-hellos"), (None, "hellos"), (4, f"{long} {long} {long}y {long}y"),
            (4, f"{long} {long} {long}y {long}y"), (5, "élève élève élève Élève"), (6, "abc abc abc abcd abcd abcd")]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], schema)
    want = brute(brute_words(rows, None))
    got = rows_of(variants.spelling_variants(df, every=None))
    assert set(got) == want and len(got) == len(want)
    assert set(rows_of(variants.spelling_variants(df))) == brute(brute_words(rows))
    assert variants.spelling_variants(df.filter("false")).count() == 0
    with pytest.raises(ValueError):
        variants.spelling_variants(df, times=1)


def test_long_chains(spark):
    words = ["abcde", "abcdef", "abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"]
    df = spark.createDataFrame([(1, " ".join([w] * 3 * 2**i)) for i, w in enumerate(words)], "doc_id long, text string")
    got = {r["word"]: r["root"] for r in variants.spelling_variants(df, every=None).collect()}
    assert got == dict.fromkeys(words, words[-1])

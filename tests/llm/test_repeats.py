"""Repeated passages and strings against brute force."""

import random

import pytest
from greenframe.llm import passages, substrings
from greenframe.llm.common import documents


def covered(sequences, size):
    """sequences: (id, symbols); id None counts as the largest."""
    rank = lambda i: float("inf") if i is None else i
    first = {}
    for i, s in sequences:
        for k in range(len(s) - size + 1):
            w = tuple(s[k : k + size])
            first[w] = min(first.get(w, float("inf")), rank(i))
    out = []
    for i, s in sequences:
        gone = [False] * len(s)
        for k in range(len(s) - size + 1):
            if first[tuple(s[k : k + size])] < rank(i):
                gone[k : k + size] = [True] * size
        out.append(gone)
    return out


def words_expected(rows, size):
    seqs = [(i, (t or "").encode().split()) for i, t in rows]
    return sorted(((i, len(s), sum(g), b" ".join(w for w, x in zip(s, g) if not x)) for (i, s), g in zip(seqs, covered(seqs, size))), key=repr)


def bytes_expected(rows, size):
    seqs = [(i, (t or "").encode()) for i, t in rows]
    out = []
    for (i, s), g in zip(seqs, covered(seqs, size)):
        out.append((i, len(s), sum(g), sum(x and not y for x, y in zip(g, [False, *g])), bytes(w for w, x in zip(s, g) if not x)))
    return sorted(out, key=repr)


def same(df, expected, function, size, gram, **more):
    got = sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in function(df, size=size, gram=gram, **more).collect()), key=repr)
    assert got == expected


def made_up(seed, letters, joiner, n=60):
    rng = random.Random(seed)
    parts = [joiner.join(rng.choice(letters) for _ in range(rng.randint(3, 25))) for _ in range(8)]
    rows = []
    for i in rng.sample(range(1000), n):
        text = joiner.join(rng.choice(parts) if rng.random() < 0.6 else joiner.join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 8)))
        rows.append((i, text))
    return rows + rows[:3] + [(None, rows[4][1]), (None, None), (2000, ""), (rows[0][0], rows[1][1])]


@pytest.mark.parametrize("seed,very_many", [(1, 1000), (2, 3), (3, 1000), (4, 2)])
def test_made_up_words(spark, seed, very_many):
    rows = made_up(seed, ["a", "b", "cc", "É", "d."], [" ", "\n "][seed % 2])
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, block int")
    same(df, words_expected(rows, 6), passages.without_repeated_passages, 6, 3, very_many=very_many)


@pytest.mark.parametrize("seed,very_many", [(5, 1000), (6, 3), (7, 1000), (8, 2)])
def test_made_up_bytes(spark, seed, very_many):
    rows = made_up(seed, ["a", "b", "é"], "")
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, block int")
    same(df, bytes_expected(rows, 11), substrings.without_repeated_strings, 11, 4, very_many=very_many)


def test_given_documents(spark, folder):
    docs = documents(spark, folder)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    same(docs, words_expected(rows, 50), passages.without_repeated_passages, 50, 25)
    same(docs, words_expected(rows, 50), passages.without_repeated_passages, 50, 25, very_many=2)
    want = bytes_expected(rows, 50)
    assert any(r[2] for r in want)
    same(docs, want, substrings.without_repeated_strings, 50, 26)
    same(docs, want, substrings.without_repeated_strings, 50, 26, very_many=2)


def test_long_text_of_one_word_and_empty_table(spark):
    rows = [(1, "x " * 30_000), (2, "y " * 3000 + "x " * 60), (3, "x " * 49)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(df, words_expected(rows, 50), passages.without_repeated_passages, 50, 25)
    same(df, bytes_expected(rows, 50), substrings.without_repeated_strings, 50, 26)
    assert passages.without_repeated_passages(df.filter("false")).count() == substrings.without_repeated_strings(df.filter("false")).count() == 0


def test_matching_statistics():
    rng = random.Random(3)
    for _ in range(40):
        texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 15))) for _ in range(4)]
        shard = passages.SuffixAutomaton()
        for t in texts:
            shard.add(list(t))
        query = "".join(rng.choice("abcd") for _ in range(25))
        want = [max(n for n in range(i + 2) if n == 0 or any(query[i + 1 - n : i + 1] in t for t in texts)) for i in range(len(query))]
        assert list(shard.matching_statistics(list(query))) == want

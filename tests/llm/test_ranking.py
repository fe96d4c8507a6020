"""Ranked search against brute force; the query is compared with its SQL counterpart in test_queries."""

import math
import random
import re
from collections import Counter

import pytest
from greenframe.llm import ranking
from greenframe.llm.common import documents

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return Counter(TERM.findall((text or "").translate(LOW)))


def brute(docs, items, top=10):
    docs = [(i, c, c.total()) for i, c in ((i, terms(t)) for i, t in docs) if c]
    count, total = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked = {}
    for item, text in set(items):
        if item is not None:
            asked.setdefault(item, Counter()).update(terms(text))
    rows = []
    for item, wanted in asked.items():
        found = []
        for doc_id, c, n in docs:
            m = 100 - 75 + 75 * n * count // total
            score = sum(r * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, r in wanted.items() if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        rows += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(found)[:top])]
    return sorted(rows, key=str)


def rows_of(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("rows,wanted,items", [(16_384, 500_000, 512), (7, 500_000, 3), (5, 3, 512)])
def test_real_texts(spark, folder, monkeypatch, rows, wanted, items):
    for name, value in (("BLOCK_ROWS", rows), ("MOST_WANTED", wanted), ("ITEMS", items)):
        monkeypatch.setattr(ranking, name, value)
    docs, asked = documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet").limit(25)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in asked.collect()])
    assert rows_of(ranking.ranked(docs, asked)) == want


def test_edge_cases(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["red", "Blue", "été", "日本", "7", "x" * 9, "the"], weights=[1, 2, 1, 1, 2, 1, 20], k=rng.randrange(1, 30)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "..."), (None, "red red blue"), (5, "red"), (5, "red"), (103, "the " * 50_000 + "red")] + [(200 + i, "green tie") for i in range(40)]
    items = [(1, "Red, red & BLUE the", "a"), (1, "Red, red & BLUE the", "b"), (2, "été 日本"), (3, None), (4, "nowhere"), (None, "red"), (5, "tie"), (1, "seven 7"), (6, "the")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, term int, rank int")
    bench = spark.createDataFrame([(x[0], x[1], x[-1] or "") for x in items], "item_id long, text string, block string")
    got = rows_of(ranking.ranked(df, bench))
    assert got == brute(rows, [(x[0], x[1]) for x in items])
    assert [d for i, _, d, _ in got if i == 5] and {d for i, _, d, _ in got if i == 5} == set(range(200, 210))
    assert ranking.ranked(df.filter("false"), bench).count() == ranking.ranked(df, bench.filter("false")).count() == 0


def test_bundles_shed_documents(spark):
    # documents that cannot be among the best leave on the way, and the result stays whole
    import pyarrow as pa

    lists = lambda x: pa.array(x, pa.list_(pa.int32()))
    postings = pa.table({"term": ["a"], "w": pa.array([100]), "docs": lists([list(range(50))]), "tfs": lists([[1 + i % 9 for i in range(50)]]), "sizes": lists([[20] * 50])})
    bundle = {"block": ["0"], "part": [0], "item_id": [1], "terms": [[]], "docs": lists([None]), "scores": pa.array([None], pa.list_(pa.int64())), "least": [0]}
    one = ranking.scored(postings, pa.table(bundle | {"mine": [[{"term": "a", "repeats": 1}]], "rest": [10]}), 50, 1000, 5)
    assert len(one["docs"][0]) == 5 and one["best"][0].as_py() == sorted(one["scores"][0].as_py(), reverse=True)
    all_ = ranking.scored(postings, pa.table(bundle | {"mine": [[{"term": "a", "repeats": 1}]], "rest": [10**9]}), 50, 1000, 5)
    assert len(all_["docs"][0]) == 50

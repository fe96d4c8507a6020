"""The parts of the radix sort of strings against brute force, and what its workers hold."""

import random
import threading
import time

import numpy as np
import psutil
import pyarrow as pa
import pytest
from greenframe.llm import substrings
from pyspark.sql import functions as F
from test_repeats import bytes_expected, same


def texts_of(rows):
    return substrings.texts_of(pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.binary())}))


def test_first_equal():
    rng = random.Random(1)
    text = bytes(rng.choice(b"ab") for _ in range(300)) + bytes(20) + b"ab" * 40
    data = np.frombuffer(text + bytes(substrings.DIGIT), np.uint8)
    items = [(p, rng.randint(1, min(37, len(text) - p)), rng.randint(0, 2)) for p in rng.choices(range(len(text)), k=2000)]
    place, length, group = (np.array(x) for x in zip(*items))
    keys = [(text[p : p + n], g) for p, n, g in items]
    assert substrings.first_equal(data, place, length, group).tolist() == [keys.index(k) for k in keys]
    keys = [k for k, _ in keys]
    assert substrings.first_equal(data, place, length).tolist() == [keys.index(k) for k in keys]


def test_each_window_begins_in_one_chunk():
    rng = random.Random(2)
    rows = [(i, bytes(rng.choice(b"abcd ") for _ in range(rng.choice([0, 7, 49, 50, 51, 300, 9000])))) for i in range(40)] + [(50, b"x " * 9000)]
    texts = texts_of(rows)
    places, lengths, owners = substrings.chunks(texts, 50)
    got = [p for a, n in zip(places.tolist(), lengths.tolist()) for p in range(a, a + n - 49)]
    assert got == [p for a, b in zip(texts.starts[:-1].tolist(), texts.starts[1:].tolist()) for p in range(a, b - 49)]
    assert (places + lengths <= texts.starts[owners + 1]).all() and (lengths < substrings.CHUNK_MOST + 50).all()
    # what is put before a text moves its first chunks only
    more = texts_of([(1, rows[6][1] + b"a few more" + max((t for _, t in rows[:40]), key=len))])
    ends = lambda x: {bytes(x.data[a : a + n]) for a, n in zip(*(c.tolist() for c in substrings.chunks(x, 50)[:2]))}
    alone = ends(texts_of([(1, max((t for _, t in rows[:40]), key=len))]))
    assert len(alone & ends(more)) > 0.7 * len(alone)


@pytest.mark.parametrize("seed,very_many", [(1, 1000), (2, 3)])
def test_long_stretches(spark, seed, very_many):
    """Whole copies, copies with edits, stretches in other documents, ids that come twice."""
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    rows = [(i, letters(rng.choice([5, 200, 1500]))) for i in rng.sample(range(500), 12)]
    for i in rng.sample(range(500, 1000), 20) + rng.sample(range(500), 8):
        kind, (_, a), (_, b) = rng.randint(0, 3), rng.choice(rows), rng.choice(rows)
        at = rng.randint(0, len(a))
        rows.append((i, [a, a[:at] + "#" + a[at:], a[at:] + b[: rng.randint(0, len(b))], letters(100) + a + letters(30)][kind]))
    rows += [(rows[1][0], rows[2][1]), (None, rows[3][1]), (None, rows[3][1] + "!"), (None, None), (rows[4][0], rows[4][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(df, bytes_expected(rows, 20), substrings.without_repeated_strings, 20, 9, very_many=very_many)


def test_workers_hold_little_where_all_repeats(spark):
    """Two sets of documents with the same lines of 64 letters but other bytes between them."""
    lines = F.expr("transform(sequence(1, 150), k -> sha2(concat(id, ' ', k), 256))")
    half = lambda first, between: spark.range(0, 4000, 1, 1).select((F.col("id") + first).alias("doc_id"), F.concat_ws(between, lines).alias("text"))
    most, over = [0.0], threading.Event()

    def watch():
        while not over.is_set():
            for p in psutil.Process().children(recursive=True):
                try:
                    if "pyspark.daemon" in " ".join(p.cmdline()):
                        most[0] = max(most[0], p.memory_info().rss / 1e6)
                except psutil.Error:
                    pass
            time.sleep(0.02)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        found = substrings.without_repeated_strings(half(0, "x").union(half(4000, "y")))
        rows = found.groupBy(F.col("doc_id") >= 4000, "n_bytes", "n_removed", "n_spans", F.length("kept")).count().collect()
    finally:
        over.set()
        watcher.join()
    size = 150 * 64 + 149
    assert sorted(tuple(r) for r in rows) == [(False, size, 0, 0, size, 4000), (True, size, 150 * 64, 150, 149, 4000)]
    assert 50 < most[0] < 450

"""Exact duplicates, also with a hash that collides."""

import hashlib
import re

import pytest
from greenframe.llm import exact
from pyspark.sql import functions as F

ROWS = [(5, "a b"), (3, "a \n\tb"), (9, "a  b"), (4, "a b"), (1, None), (2, ""), (8, " "), (8, " "), (None, "a b"), (None, "lonely"), (7, "x" * 200_000), (6, "x" * 200_000), (10, "x" * 199_999 + "y"), (11, "A b")]


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("hash_of", [exact.content_hash, lambda t: F.unhex(F.md5(F.substring(t, 1, 1).cast("binary")))])
def test_groups(spark, hash_of):
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in ROWS], "doc_id long, text string, h int, keep_id string")
    got = sorted((tuple(r) for r in exact.exact_groups(df, hash_of=hash_of).collect()), key=repr)
    assert got == expected(ROWS)
    assert exact.exact_groups(df.filter("false"), hash_of=hash_of).count() == 0


def test_without_copies(spark):
    df = spark.createDataFrame([(i, t, "z") for i, t in ROWS if i is not None], "doc_id long, text string, h string")
    got = exact.without_copies(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3, 4, 6, 8, 8, 10, 11]

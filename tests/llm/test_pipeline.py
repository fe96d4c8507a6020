"""The stages of the pipeline, each against brute force on its own input."""

import re

import corpus_pipeline
from greenframe.llm.common import documents
from test_near import classes


def test_stages(spark, folder):
    docs, rows = documents(spark, folder), {}
    names = [name for name, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES:
        rows[name] = (docs.collect(), (out := stage(spark, docs, folder)).collect())
        if name != names[-1]:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(rows[name][1], docs.schema)
    given, kept = rows["language_id"]
    assert len(kept) == sum(any(c.isalpha() for c in r["text"]) for r in given)
    given, kept = rows["exact_dedup"]
    first = {}
    for r in given:
        key = re.sub("[\x20\x09-\x0d]+", " ", r["text"])
        first[key] = min(first.get(key, r["doc_id"]), r["doc_id"])
    assert {r["doc_id"] for r in kept} == set(first.values())
    given, kept = rows["near_dedup"]
    assert {r["doc_id"] for r in kept} == set(classes([(r["doc_id"], r["text"]) for r in given]).values())
    given, kept = rows["decontamination"]
    runs = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = r["text"].split()
        runs |= {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
    clean = {r["doc_id"] for r in given if not any(tuple(w[i : i + 13]) in runs for w in [r["text"].split()] for i in range(len(w) - 12))}
    assert {r["doc_id"] for r in kept} == clean and len(clean) < len(given)
    given, pieces = rows["packing"]
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in given}
    assert len({r["sequence_id"] for r in pieces}) <= -(-sum(r["length"] for r in pieces) // 2048) + 1


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_rows_without_an_id_and_of_one_id(spark):
    from greenframe.llm import exact, leaks, near

    text = " ".join(f"word{i}" for i in range(60))
    schema = "doc_id long, text string"
    left = lambda df: sorted(((r["doc_id"] or 0, r["text"]) for r in df.collect()))
    rows = [(1, "a"), (None, "a"), (None, "clean"), (2, "a"), (2, "other"), (None, "twice"), (None, "twice")]
    assert left(exact.without_copies(spark.createDataFrame(rows, schema))) == [(0, "clean"), (0, "twice"), (1, "a"), (2, "other")]
    rows = [(1, text), (None, text + " more"), (None, "clean"), (2, text + " end"), (2, "other"), (None, text + " again")]
    assert left(near.without_near_copies(spark.createDataFrame(rows, schema))) == [(0, "clean"), (1, text), (2, "other")]
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    rows = [(None, text), (None, "clean"), (2, text), (2, "other"), (3, None)]
    assert left(leaks.without_leaks(spark.createDataFrame(rows[:-1], schema), bench)) == [(0, "clean"), (2, "other")]

"""Language identification: held-out accuracy and edge cases."""

import numpy as np
import pytest
from greenframe.llm import language
from pyspark.sql import functions as F


def test_held_out_accuracy(spark, folder):
    folder = folder.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = language.held_out_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert 0.2 < len(held) / len(rows) < 0.3
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edge_cases(spark):
    english, german = "the cat and the dog with this thing that was there " * 4, "der Hund und die Katze mit dem Ding das nicht schön ist "
    rows = [(1, english, "en"), (2, german, "de"), (3, None, "en"), (4, "", None), (5, "123 !?", "en"), (None, english, "en"), (6, "the", None),
            (7, "語", None), (8, german * 3000, "de"), (9, english, None), (9, english, None)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = sorted(((r["doc_id"] or 0, r["lang_pred"], r["held_out"]) for r in language.held_out_languages(df).collect()))
    assert [(i, p) for i, p, _ in got] == [(0, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (7, got[8][1]), (8, "de"), (9, "en"), (9, "en")]
    assert language.held_out_languages(df.filter("false")).count() == 0
    unlabelled = language.held_out_languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in unlabelled} == {("und", 0.0)}
    with pytest.raises(ValueError):
        language.predict(df, language.fit(df))
    kept = language.with_language(df.drop("lang_pred", "score"))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 6, 7, 8, 9, 9] and kept.columns == ["doc_id", "text", "lang"]


def test_order_of_letters_counts():
    known = language.Vectors(4096)
    a, b = (known.bundle(language.trigrams(t)) for t in ("abc", "cba"))
    assert abs(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)) < 0.5
    assert language.trigrams("ab  cd").tolist() == language.trigrams("ab,cd").tolist() and not len(language.trigrams("1 2"))


def test_cache_that_starts_anew():
    small, large = language.Vectors(64, most=3), language.Vectors(64)
    for text in ("some words", "other words", "some words"):
        assert small.bundle(language.trigrams(text)).tolist() == large.bundle(language.trigrams(text)).tolist()


def plain_bundle(text, dimensions):
    """Bind, turn and bundle, one trigram after the other."""
    known, total = language.Vectors(dimensions), np.zeros(dimensions)
    slot = lambda c: language.letter_slots()[ord(c)] if c.isalpha() else 0
    word = [0]
    for c in [*text, " "]:
        if c.isalpha():
            word.append(int(slot(c)))
            continue
        word.append(0)
        for a, b, d in zip(word, word[1:], word[2:]):
            total += np.roll(known.letter(a).astype(int), 2) * np.roll(known.letter(b).astype(int), 1) * known.letter(d)
        word = [0]
    return total


def test_against_plain_formula(spark, folder):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{folder}/documents.parquet").limit(60).collect()]
    docs += [(900 + i, t, l) for i, (t, l) in enumerate([("Это просто текст на русском языке", "ru"), ("Αυτό είναι ένα κείμενο", "el"), ("语言 识别 文本", "zh"), ("Ещё один текст", None), ("naïve текст mixed", None)])]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.held_out_languages(df).collect()}
    sums = {}
    for i, text, label in docs:
        own = plain_bundle(text, language.DIMENSIONS)
        if label and not got[i]["held_out"] and own.any():
            sums[label] = sums.get(label, 0) + own / sum(len(w) for w in "".join(c if c.isalpha() else " " for c in text).split())
    for i, text, _ in docs:
        own = plain_bundle(text, language.DIMENSIONS)
        cosines = {k: v @ own / np.linalg.norm(v) / max(np.linalg.norm(own), 1e-9) for k, v in sums.items()}
        best = max(sorted(cosines), key=cosines.get)
        assert got[i]["lang_pred"] == (best if own.any() else "und")
        assert abs(got[i]["score"] - (max(0.0, cosines[best]) if own.any() else 0.0)) < 1e-4


def test_letters_have_vectors_of_their_own():
    slots = language.letter_slots()
    alphabets = [ord(c) for c in "abcdefghijklmnopqrstuvwxyzàéñßабвгдежзийклмнопрстуфхцчшщъыьэюяαβγδεζηθικλμνξοπρστυφχψωابتثجحخ語言文本"]
    assert len({int(slots[c]) for c in alphabets}) == len(alphabets)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", 1), (2, "123", 2), (3, None, 3), (4, "текст", 4)], "doc_id long, text string, _language int").withColumn("lang", F.lit(None).cast("string"))
    kept = language.with_language(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 4]
    assert language.with_language(df.filter("false")).count() == 0

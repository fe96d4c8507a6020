"""Template decontamination: planted, re-parameterised, inconsistent and clean texts."""

import random
import re

import pytest
from greenframe.llm import leaks
from greenframe.llm.common import documents

ITEM = "A train travels 60 km in 2 hours and then Alice drives back 60 km in 3 hours, so what is the average speed of the whole journey?"
SHORT = "Only seven words are in this item"
NINE = "the quick brown fox jumps over nine lazy dogs"


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, ITEM, 0), (1, ITEM, 0), (2, SHORT, 0), (3, None, 0), (4, "", 0), (5, NINE, 0), (None, NINE, 0)], "item_id long, text string, doc_id int")


def test_leaks(spark, bench):
    rows = [
        (1, f"Some words before. {ITEM} And more after it."),
        (2, "x y z " + ITEM.replace("60", "75").replace("Alice", "Bob").replace("2 hours", "4 hours")),
        (3, ITEM.replace("Alice", "Bob").replace("travels 60", "travels 10").replace("back 60", "back 20").replace("average speed of the whole journey", "mean")),
        (4, "Nothing of it is here, only a train and 60 km."),
        (5, None), (6, ""), (None, ITEM), (7, SHORT), (8, ITEM), (8, ITEM), (9, "w " * 50_000 + ITEM),
        (10, f"we saw {NINE.upper().lower()} today"), (11, "the quick brown fox jumps over nine red cats"), (12, ITEM.replace(" ", "\n")),
    ]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, item_id int")
    got = {(r["doc_id"], r["item_id"]): (r["n_words"], r["n_same"], r["reparameterised"]) for r in leaks.leaks(df, bench).collect()}
    # item 2 has seven words: it is found as a whole
    assert set(got) == {(1, 1), (2, 1), (3, 1), (7, 2), (8, 1), (9, 1), (10, 5), (12, 1)}
    assert not got[3, 1][2]
    n = len(ITEM.split())
    assert got[1, 1] == got[9, 1] == (n, n, False) and got[2, 1] == (n, n - 4, True)
    kept = leaks.without_leaks(df, bench)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [4, 5, 6, 11]  # the row without an id holds an item too


def test_inconsistent_slots(spark, bench):
    # one 60 became 10, the other 20: the same template, but no substitution of the question's values
    text = ITEM.replace("travels 60", "travels 10").replace("back 60", "back 20")
    df = spark.createDataFrame([(1, " ".join(text.split()[:14]))], "doc_id long, text string")
    assert leaks.leaks(df, bench, least_words=13).count() == 0


def test_empty_tables(spark, bench):
    df = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    assert leaks.leaks(df.filter("false"), bench).count() == leaks.leaks(df, bench.filter("false")).count() == 0


def test_index_too_large_to_broadcast(spark, bench, monkeypatch):
    monkeypatch.setattr(leaks, "MOST_BROADCAST", 1)
    df = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    assert [r["item_id"] for r in leaks.leaks(df, bench).collect()] == [1]


def test_every_shared_run_is_found(spark, folder):
    docs, bench = documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet")
    runs = {}
    for r in bench.collect():
        w = r["text"].split()
        for i in range(len(w) - 12):
            runs.setdefault(tuple(w[i : i + 13]), set()).add(r["item_id"])
    want = set()
    for r in docs.collect():
        w = r["text"].split()
        want |= {(r["doc_id"], item) for k in range(len(w) - 12) for item in runs.get(tuple(w[k : k + 13]), ())}
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(docs, bench).collect()}
    assert want and want <= got and {d for d, _ in got} == {d for d, _ in want}


def test_no_python_in_the_plan(spark, folder):
    plan = leaks.leaks(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_short_runs_at_every_alignment(spark):
    # 9 words before the changed one, so a run has two windows; the other item keeps the old stride wide
    item = "one red lantern hung above nine quiet river boats until morning came over all"
    bench = spark.createDataFrame([(1, item), (2, " ".join(f"w{chr(97 + i)}" for i in range(20)))], "item_id long, text string")
    df = spark.createDataFrame([(i, "x " * i + item.replace("until", "while")) for i in range(8)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in leaks.leaks(df, bench).collect()) == [*range(8)]


def test_copies_of_items_poor_in_words(spark):
    items = [
        (1, "Compute 12 + 35 + 48 - 7 + 9 + 16 + 21 + 4 + 90 + 18 + 33 + 2 + 5"),
        (2, "Which of London, Paris, Berlin, Madrid, Rome, Vienna, Prague, Warsaw, Lisbon, Dublin, Athens, Oslo or Bern is largest"),
        (3, "Name the largest moon"), (4, "..."), (5, "Zebra"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"so we ask, {t}? and then go on") for i, t in items] + [(6, items[0][1].replace("35", "36").replace("90", "91").replace("16", "61").replace("4 ", "8 ")), (7, "the largest moon has a name")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = leaks.leaks(df, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 1), (2, 2), (3, 3), (5, 5)]
    assert not any(r["reparameterised"] for r in got)


def plain(text):
    """Words and template of a text by the rules alone: one token after the other."""
    marked = re.sub(r"(?<=[^\W_][ ])(?=[A-ZÀ-Þ][^\W_])|(?<=[,;][ ])(?=[A-ZÀ-Þ][^\W_])", "\ue001", text)
    found = re.findall(r"\ue001?(?:\d+(?:[.,]\d+)+|[^\W_])+|(?:\d+(?:[.,]\d+)+|[^\W_])+", marked)
    words_, kinds = [], []
    for token in found:
        word = token.lstrip("\ue001").lower()
        rest = re.sub(r"[\d.,]", "", word) if word[0].isdigit() else None
        before = words_[-1] if words_ else ""
        kind = (
            "name" if token[0] == "\ue001" else "number" if rest == "" else "measure" if rest in leaks.UNITS
            else "unit" if word in leaks.UNITS and re.fullmatch(r"\d[\d.,]*", before) else word
        )
        words_.append(word)
        kinds.append(("slot", kind) if kind in ("name", "number", "measure", "unit") and kind != word else ("word", word))
    return words_, kinds


def brute(item, text):
    """(n_words, n_same) of the best place, of all places."""
    a, s = plain(item)
    b, t = plain(text)
    best = (0, 0)
    for shift in range(-len(a) + 1, len(b)):
        rows = [(i, i + shift) for i in range(len(a)) if 0 <= i + shift < len(b)]
        same = sum(a[i] == b[j] for i, j in rows)
        agree = sum(a[i] == b[j] or s[i] == t[j] for i, j in rows)
        slots = {(s[i], a[i], b[j]) for i, j in rows if s[i] == t[j] and s[i][0] == "slot"}
        consistent = len(slots) == len({(x, y) for x, y, _ in slots}) == len({(x, z) for x, _, z in slots})
        best = max(best, (agree if consistent else same, same))
    return best


def test_templates_and_slots_against_brute_force(spark):
    rng = random.Random(11)
    pool = "the a train drives from with and then total speed of boat river asks how many are left over when".split()
    slots = [["60", "75", "3.5", "1,200", "8"], ["km", "kg", "hours", "minutes", "km/h", "l"], ["Alice", "Bob", "Zoe Miller", "Ahmed"]]
    items, texts = [], []
    for k in range(40):
        shape = [rng.choice([None, None, None, 0, 1, 2]) for _ in range(rng.randrange(14, 30))]
        shape = [x if x != 1 or (i and shape[i - 1] == 0) else None for i, x in enumerate(shape)]
        word = [rng.choice(pool) for _ in shape]
        fill = lambda values: " ".join(w if x is None else values.setdefault((x, i % 3), rng.choice(slots[x])) for i, (x, w) in enumerate(zip(shape, word)))
        items.append((k, "so " + fill({})))
        texts += [f"before it. {items[-1][1]} and after", "now then so " + fill({}), "now " + fill({}) + ", done"]
        loose = [rng.choice(slots[x]) if x is not None else w for x, w in zip(shape, word)]
        texts.append("also " + " ".join(loose))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_words"], r["n_same"], r["reparameterised"]) for r in leaks.leaks(df, bench).collect()}
    for d, text in enumerate(texts):
        item = items[d // 4]
        size, (words_, same) = len(plain(item[1])[0]), brute(item[1], text)
        if (d, item[0]) in got:
            assert got[d, item[0]] == (words_, same, same < words_)
        else:
            # nothing is missed but what has no run of eight words
            assert words_ < min(13, 0.8 * size) or not shares_run(item[1], text)
    assert sum(r for _, _, r in got.values()) > 10 and len(got) > 60


def shares_run(item, text, size=8):
    _, s = plain(item)
    _, t = plain(text)
    runs = {tuple(s[i : i + size]) for i in range(len(s) - size + 1) if sum(k == "word" for k, _ in s[i : i + size]) >= 4}
    return any(tuple(t[i : i + size]) in runs for i in range(len(t)))


def test_units_with_a_stroke_stay_aligned(spark):
    item = "a car at 60 km/h needs 5 hours and 12 l for 300 km while a bus with 40 seats takes 7 hours for it"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    good = item.replace("60", "80").replace("300", "400").replace("40 seats", "50 seats")
    swapped = "a car at 7 km/h needs 7 hours and 7 l for 7 km while a bus with 7 seats takes 9 hours for it"
    df = spark.createDataFrame([(1, good), (2, " ".join(swapped.split()[:14]))], "doc_id long, text string")
    got = {r["doc_id"]: r["reparameterised"] for r in leaks.leaks(df, bench, least_words=13).collect()}
    assert got == {1: True}


def test_names_of_other_columns(spark, bench):
    df = spark.createDataFrame([(1, ITEM, 1, 2, 3), (2, "clean", 1, 2, 3)], "doc_id long, text string, _gone int, hash int, w int")
    left = leaks.without_leaks(df, bench)
    assert left.columns == df.columns and [r["doc_id"] for r in left.collect()] == [2]


def test_a_line_that_all_items_share(spark):
    line = "answer the next question with one single number and give no reason for it at all"
    bench = spark.createDataFrame([(i, f"{line} what about {' '.join(f'w{chr(97 + i % 26)}{chr(97 + k)}{chr(97 + i // 26)}' for k in range(30))}") for i in range(60)], "item_id long, text string")
    df = spark.createDataFrame([(i, f"{'x ' * i}{' '.join(line.split()[:11])} is what they said") for i in range(40)], "doc_id long, text string")
    assert leaks.leaks(df, bench).count() == 0

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from greenframe.operators import impute


def neighbours(rows, k):
    """Brute force: mean of the k nearest rows having the feature, ties by id."""
    d = len(rows[0]) - 1
    out = []
    for row in rows:
        filled = list(row)
        for f in range(d):
            if row[f + 1] is not None:
                continue
            near = []
            for other in rows:
                shared = [i for i in range(d) if row[i + 1] is not None and other[i + 1] is not None]
                if other[f + 1] is not None and shared:
                    total = 0.0
                    for i in range(d):
                        if i in shared:
                            total += (row[i + 1] - other[i + 1]) ** 2
                    near.append((total * d / len(shared), other[0], other[f + 1]))
            near.sort()
            column = [r[f + 1] for r in rows if r[f + 1] is not None]
            filled[f + 1] = float(np.mean([v for _, _, v in near[:k]])) if near else (float(np.mean(column)) if column else None)
        out.append(tuple(filled))
    return sorted(out)


@pytest.mark.parametrize("seed, k, cell", [(1, 5, 10), (2, 1, 30), (3, 3, 1000)])
def test_knn_equals_brute_force(spark, seed, k, cell):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        # a third of the rows are copies of one row, the others cluster
        base = (5.0, 5.0, 5.0, 1.0) if i % 3 == 0 else tuple(round(rng.gauss(rng.choice([0, 20, 100]), 3), 1) for _ in range(4))
        rows.append((i, *[None if rng.random() < 0.25 else v for v in base]))
    rows.append((400, None, None, None, None))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    got = sorted(tuple(r) for r in impute.impute_knn(df, "id", ["a", "b", "c", "d"], k, cell).collect())
    for have, want in zip(got, neighbours(rows, k)):
        assert have[0] == want[0] and np.allclose(have[1:], want[1:], rtol=1e-9)


def test_knn_keeps_observed_cells_and_other_columns(spark):
    df = spark.createDataFrame([(1, 1.0, None, "x"), (2, 2.0, 4.0, "y"), (3, None, None, "z")], "id int, a double, b double, t string")
    got = {r["id"]: r for r in impute.impute_knn(df, "id", ["a", "b"], 1).collect()}
    assert got[1]["b"] == 4.0 and got[2]["a"] == 2.0 and got[3]["a"] == 1.5 and got[3]["t"] == "z"
    whole = df.filter("id = 2")
    assert impute.impute_knn(whole, "id", ["a", "b"], 3).first()["b"] == 4.0


def test_simple_fills(spark):
    df = spark.createDataFrame([(1, 1.0, 3, "b"), (2, 4.0, None, None), (3, None, 3, "a"), (4, float("nan"), 9, "")], "id int, x double, n int, t string")
    assert [r["x"] for r in impute.impute_mean(df, ["x"]).orderBy("id").collect()] == [1.0, 4.0, 2.5, 2.5]
    assert [r["n"] for r in impute.impute_median(df, ["n"]).orderBy("id").collect()] == [3.0, 3.0, 3.0, 9.0]
    modes = impute.impute_mode(df, ["n", "t", "x"]).orderBy("id").collect()
    assert [r["n"] for r in modes] == [3, 3, 3, 9] and [r["t"] for r in modes] == ["b", "", "a", ""] and modes[2]["x"] == 1.0
    assert [r["x"] for r in impute.impute_constant(df, ["x"], "0").orderBy("id").collect()][2:] == [0.0, 0.0]
    assert impute.impute_constant(df, ["t"], "?").filter("id = 2").first()["t"] == "?"
    with pytest.raises(ValueError):
        impute.impute_mean(df, ["t"])
    first = impute.impute_simple(df, ["x"], "mean", row_limit=3, key=["id"])
    assert first.count() == 3 and first.filter("id = 3").first()["x"] == 2.5
    empty = impute.impute_mean(df.select("id", F.lit(None).cast("double").alias("e")), ["e"])
    assert empty.filter("e IS NULL").count() == 4


def test_iterative_recovers_a_linear_relation(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        a, b = rng.gauss(0, 2), rng.gauss(5, 1)
        rows.append([i, a, b, 3 * a - 2 * b + 1 + rng.gauss(0, 0.01)])
    truth = {r[0]: list(r) for r in rows}
    holed = [[i, a if i % 10 else None, b if i % 7 else None, c if i % 5 != 1 else None] for i, a, b, c in rows]
    df = spark.createDataFrame(holed, "id int, a double, b double, c double")
    got = impute.impute_iterative(df, ["a", "b", "c"], max_iter=30).collect()
    for r in got:
        for j, name in enumerate("abc", 1):
            if holed[r["id"]][j] is not None:
                assert r[name] == holed[r["id"]][j]
            elif sum(v is None for v in holed[r["id"]]) == 1:
                assert abs(r[name] - truth[r["id"]][j]) < 0.2


def test_bayesian_ridge_is_near_least_squares():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(scale=0.1, size=2000)
    xc, yc = x - x.mean(0), y - y.mean()
    coef = impute._bayesian_ridge(2000, xc.T @ xc / 2000, xc.T @ yc / 2000, float(yc @ yc / 2000))
    assert np.allclose(coef, np.linalg.lstsq(xc, yc, rcond=None)[0], atol=1e-3)


def test_review_queue(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, None), (3, "c", "x")], "id int, t string, u string")
    queue = impute.missing_cells(df, ["id"]).orderBy("id", "column").collect()
    assert [(r["id"], r["column"]) for r in queue] == [(1, "u"), (2, "t"), (2, "u")]
    assert queue[1]["row_data"] == '{"id":2,"t":"MISSING","u":null}'
    examples = impute.example_rows(df, ["id"], ["t", "u"], 5)
    assert examples.groupBy("column").count().orderBy("column").collect()[0]["count"] == 2
    again = impute.example_rows(df.repartition(4), ["id"], ["t", "u"], 1).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, impute.example_rows(df, ["id"], ["t", "u"], 1).collect()))
    decisions = spark.createDataFrame([(1, "u", " new ", True), (2, "t", "no", False)], "id int, column string, imputed string, accepted boolean")
    written = {r["id"]: (r["t"], r["u"]) for r in impute.apply_imputations(df, ["id"], decisions).collect()}
    assert written == {1: ("a", "new"), 2: (None, None), 3: ("c", "x")}
    every = impute.apply_imputations(df, ["id"], impute.review_all(decisions, True))
    assert every.filter("t = 'no'").count() == 1
    assert impute.apply_imputations(df, ["id"], impute.review_all(decisions, False)).filter("u = 'new'").count() == 0


def test_the_later_decision_wins(spark):
    df = spark.createDataFrame([(1, None)], "id int, n int")
    decisions = spark.createDataFrame([(1, "n", "9", True, 1), (1, "n", "10", True, 2), (1, "n", "11", False, 3)], "id int, column string, imputed string, accepted boolean, at int")
    assert impute.apply_imputations(df, ["id"], decisions, order="at").first()["n"] == 10
    assert impute.apply_imputations(df, ["id"], decisions.drop("at")).first()["n"] == 9


def test_row_limit_of_every_strategy(spark):
    rows = [(i, float(i % 7), None if i % 4 == 0 else 2.0 * (i % 7), 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    head = df.filter("id < 20")
    by_id = lambda x: [tuple(round(v, 9) for v in r) for r in x.orderBy("id").collect()]
    assert by_id(impute.impute_knn(df, "id", ["a", "b"], row_limit=20)) == by_id(impute.impute_knn(head, "id", ["a", "b"]))
    assert by_id(impute.impute_iterative(df, ["a", "b"], row_limit=20, key=["id"])) == by_id(impute.impute_iterative(head, ["a", "b"]))


def test_prompts_hold_examples_and_the_row(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else f"n{i}", None) for i in range(12)], "id long, name string, empty string")
    got = {(r["id"], r["column"]): r["prompt"] for r in impute.imputation_prompts(df, ["id"], n=3).collect()}
    assert len(got) == 4 + 12
    text = got[3, "name"]
    assert text.count('"name":"n') == 3 and '"id":3,"name":"MISSING"' in text and "none" in got[5, "empty"]
    assert impute.imputation_prompts(df.filter("false"), ["id"]).count() == 0

"""Profiling edges, each against a plain computation."""

import random
from datetime import datetime
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from greenframe.functions import fixed_values as fixed
from greenframe.operators import dependencies as dep
from greenframe.operators import privacy, profile, quality, quantiles
from greenframe.operators.moments import pair_moments
from greenframe.operators.quantiles import exact_quantiles


def as_dict(df, key="column"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_categories(spark):
    n = 100
    rows = [
        (i % 20, i % 21, f"w{i % 20}", f"w{i % 21}", str(i) if i < 60 else f"t{i}", str(i) if i < 59 else f"t{i}",
         str(i % 3) if i < 60 else None, f"{i}d", True, datetime(2024, 1, 1), [i], float("nan"), None)
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "n20 int, n21 int, w20 string, w21 string, num60 string, num59 string, few string, suffix string, "
                               "flag boolean, at timestamp, list array<int>, nan double, none string")
    found = {c: r["category"] for c, r in as_dict(profile.column_category(df)).items()}
    assert found == {"n20": "categorical", "n21": "numeric", "w20": "categorical", "w21": "text", "num60": "numeric", "num59": "text",
                     "few": "categorical", "suffix": "text", "flag": "boolean", "at": "datetime", "list": "other", "nan": "categorical",
                     "none": "categorical"}


def test_number_texts(spark):
    df = spark.createDataFrame([("1",), ("1.0",), (" 1e0 ",), ("1d",), ("NaN",), ("1.5f",), (".5",), ("+2.",)], "t string")
    numbers = sorted(r["number"] for r in profile.value_counts(df).collect() if r["number"] is not None)
    assert numbers == [0.5, 1.0, 1.0, 1.0, 2.0]


def test_metrics_and_duplicates(spark):
    rows = [(1, "a", 0.0)] * 5 + [(None, "a", float("nan"))] * 3 + [(1, None, -0.0), (2, "b", 1.0)]
    df = spark.createDataFrame(rows, "x int, t string, d double")
    got = profile.table_metrics(df).first()
    assert (got["rows"], got["cols"], got["missing_cells"], got["duplicate_rows"]) == (10, 3, 7, 6)
    assert abs(got["missing_pct"] - 7 / 30 * 100) < 1e-9
    empty = profile.table_metrics(df.filter("false")).first()
    assert (empty["rows"], empty["missing_pct"], empty["duplicate_rows"]) == (0, 0.0, 0)


def test_insights(spark):
    rows = [(3, None, "x" * 90), (1, None, None), (2, None, "y")] + [(10 + i, None, "z") for i in range(150)] + [(200, 7, "z")]
    df = spark.createDataFrame(rows, "id int, rare int, user_email string")
    for exact in (True, False):
        got = as_dict(profile.schema_insights(df, ["id"], exact))
        assert got["id"]["example"] == "1" and got["rare"]["example"] == "7" and got["user_email"]["example"] == "y"
        assert got["user_email"]["sensitive"] and "camelCase" in got["user_email"]["reasons"] and not got["id"]["sensitive"]
        assert got["rare"]["unique_pct"] == 100.0 and abs(got["rare"]["missing_pct"] - 153 / 154 * 100) < 1e-9
    long_first = profile.schema_insights(df.filter("id = 3"), ["id"]).filter("column = 'user_email'").first()["example"]
    assert long_first == "x" * 77 + "…"


@pytest.mark.parametrize("most", [200_000, 3])
def test_quantiles_by_radix(spark, monkeypatch, most):
    monkeypatch.setattr(quantiles, "MOST_SENT", most)
    rng = random.Random(5)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(4000)] + [("ties", float(i % 3)) for i in range(2000)] + [("few", 1.0), ("few", 2.0)]
    rows += [(None, float(i)) for i in range(3000)] + [("hot", None)] + [("zeros", x) for x in (-0.0, 0.0, -1e-320, 5e-324, 2.0**-1022)]
    rows += [("wide", x) for x in (-1.7e308, 1.7e308, 2.0**60, 2.0**60 + 512, -(2.0**-300), 0.1, 1 / 3, 3.0, 1e15)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: [r[f"q{i}"] for i in range(5)] for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    for g in ("hot", "ties", "few", None, "zeros", "wide"):
        values = [v for k, v in rows if k == g and v is not None]
        assert np.allclose(got[g], np.quantile(values, probs), rtol=1e-12, atol=0)
    whole = exact_quantiles(df, [], "v", probs).first()
    assert np.allclose([whole[f"q{i}"] for i in range(5)], np.quantile([v for _, v in rows if v is not None], probs), rtol=1e-12, atol=0)
    assert exact_quantiles(df.filter("false"), ["g"], "v", probs).count() == 0
    assert exact_quantiles(df.filter("false"), [], "v", probs).first()["q1"] is None


def test_quantiles_of_columns_are_counted_by_arrays(spark, monkeypatch):
    """No row is unfolded into a row per cell, and any number of columns is taken, some at a time."""
    monkeypatch.setattr(quantiles, "MOST_COLUMNS", 2)
    rng = random.Random(6)
    rows = [(rng.gauss(-3, 1e6), float(i % 3) - 1, None, rng.choice([-0.0, 0.0, 5e-324, None]), 2.0**60 + 512 * i) for i in range(3001)]
    df = spark.createDataFrame(rows, "`a.b` double, ties double, none double, zeros double, wide double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {r["column"]: [r[f"q{i}"] for i in range(5)] for r in quantiles.column_quantiles(df, probs).collect()}
    assert set(got) == {"a.b", "ties", "zeros", "wide"}
    for i, c in ((0, "a.b"), (1, "ties"), (3, "zeros"), (4, "wide")):
        assert np.allclose(got[c], np.quantile([r[i] for r in rows if r[i] is not None], probs), rtol=1e-12, atol=0)
    plan = quantiles.column_digit_counts(df.select("ties"), None, 0)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    last = quantiles.column_quantiles(spark.createDataFrame([(1.0,), (float("nan"),)], "v double"), [0.0, 1.0]).first()
    assert last["q0"] == 1.0 and np.isnan(last["q1"])
    assert quantiles.column_quantiles(df.filter("false"), probs).count() == 0


def test_keys_of_doubles_keep_order_and_bits(spark):
    rng = random.Random(8)
    values = [s * m * 2.0**e for s in (1, -1) for e in range(-1074, 1024, 37) for m in (1.0, 1.9999999999999998, rng.uniform(1, 2)) if m * 2.0**e < float("inf")]
    values += [0.0, 5e-324, -5e-324, 2.0**-1022, 1.7976931348623157e308, float("inf"), float("-inf")] + [float(2**k) for k in range(63)] + [2.0**k * (1 - 2.0**-53) for k in range(-50, 50)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", quantiles.ordered_key(F.col("v")).alias("k")).select("v", "k", quantiles.of_key(F.col("k")).alias("w")).collect()
    assert all(r["v"] == r["w"] for r in rows)
    by_key = sorted(rows, key=lambda r: r["k"])
    assert [r["v"] for r in by_key] == sorted(values) and len({r["k"] for r in rows}) == len(set(values))


def test_quantiles_shuffle_counts_only(spark):
    rows = spark.range(1000).selectExpr("struct(id % 3 AS g) AS _g", "id AS _k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = quantiles.digit_counts(rows, rows.selectExpr("_g", "0L AS _p").distinct(), 16, True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    main = text.split("BroadcastExchange")[0]
    assert "BroadcastHashJoin" in main and main.count("Exchange hashpartitioning") == 1
    # the only exchange of the rows' side has counts that are added up already
    assert main.index("partial_count") > main.index("Exchange hashpartitioning")


def test_correlation_edges(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"a": rng.normal(1e6, 1, 500), "flat": 7.1, "e": np.nan})
    frame["b"] = frame["a"] * 2 + rng.normal(0, 1, 500)
    frame["c"] = rng.normal(0, 1, 500)
    frame.loc[::3, "b"] = np.nan
    df = spark.createDataFrame(frame)
    got = {(r["a"], r["b"]): r["corr"] for r in profile.correlation_matrix(df).collect()}
    want = frame.corr()
    for x, y in combinations(frame.columns, 2):
        if np.isnan(want.loc[x, y]):
            assert got[(x, y)] is None
        else:
            assert abs(got[(x, y)] - want.loc[x, y]) < 1e-9
    top = profile.top_correlations(df, 2).collect()
    assert [(r["a"], r["b"]) for r in top] == [("a", "b"), ("b", "a")]
    assert profile.correlation_matrix(df.select("a")).count() == 0


def test_moments(spark):
    frame = pd.DataFrame(np.random.default_rng(2).normal(5, 2, (300, 3)), columns=list("xyz"))
    moments = pair_moments(spark.createDataFrame(frame).repartition(5))
    assert np.allclose(moments.cov, np.cov(frame.T, ddof=0)) and np.allclose(np.diag(moments.mean_x), frame.mean())


def test_shapes_and_outliers(spark):
    frame = pd.DataFrame({"a": [1.0, 2, 2, 3, 50, None], "flat": 3.0, "three": [1.0, 2, 4, None, None, None], "none": [None] * 6})
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "a double, flat double, three double, none double")
    shape = as_dict(quality.shape_stats(df))
    assert abs(shape["a"]["skewness"] - frame["a"].skew()) < 1e-9 and abs(shape["a"]["kurtosis"] - frame["a"].kurt()) < 1e-9
    assert abs(shape["three"]["skewness"] - frame["three"].skew()) < 1e-9 and shape["three"]["kurtosis"] is None
    assert shape["none"]["std"] is None and shape["flat"]["std"] == 0.0
    rates = as_dict(quality.zscore_outlier_rate(df, z=1.9))
    assert abs(rates["a"]["outlier_rate"] - 1 / 6) < 1e-12 and rates["flat"]["outlier_rate"] == 0.0 and rates["none"]["outlier_rate"] == 0.0
    report = as_dict(quality.anomaly_report(df, datetime(2024, 1, 1), 1.9))
    want = 1 / 6 * 0.35 + 1 / 6 * 0.35 + abs(frame["a"].skew()) / 10 * 0.15 + abs(frame["a"].kurt()) / 10 * 0.15
    assert abs(report["a"]["severity"] - round(want, 4)) < 1e-9
    assert report["flat"]["is_constant"] and not report["none"]["is_constant"] and report["none"]["severity"] == 0.35


def test_blank_counts_as_missing_in_the_report_only(spark):
    df = spark.createDataFrame([("",), (None,), ("x",), ("x",)], "t string")
    report = quality.anomaly_report(df, datetime(2024, 1, 1)).first()
    assert report["missing_pct"] == 50.0 and not report["is_constant"]
    assert profile.missing_by_column(df).first()["missing"] == 1


def test_dates(spark):
    df = spark.createDataFrame([(datetime(1850, 1, 1),), (datetime(2024, 1, 1),), (datetime(2024, 2, 2),), (None,)], "d timestamp")
    got = quality.date_anomalies(df, datetime(2024, 1, 1), 1900, 1).first()
    assert got["future_pct"] == 25.0 and got["ancient_pct"] == 25.0


def test_semantics(spark):
    df = spark.createDataFrame([("123456789", "a@b.io\n", datetime(2024, 1, 1)), ("987654321", "a@b.io", datetime(2024, 1, 2)), (None, None, None)],
                               "code string, mail string, day timestamp")
    got = {(r["column"], r["pattern"]): r["match_pct"] for r in quality.semantic_profile(df).collect()}
    assert got[("code", "passport_uk")] == got[("code", "passport_usa")] == got[("code", "tfn_australia")] == 100.0
    assert got[("mail", "email")] == 50.0 and got[("day", "postal_code_generic")] == 100.0
    assert ("code", "email") not in got
    first = {(r["column"], r["pattern"]): r["match_pct"] for r in quality.semantic_profile(df, ["mail"], 1, ["code"]).collect()}
    assert first == {}
    flags = {r["column"]: r["sensitive"] for r in quality.pii_flag(quality.semantic_profile(df)).collect()}
    assert flags["mail"] and flags["code"]


def test_lengths_of_patterns_leave_no_match_out(spark):
    """The shortest and longest texts of each pattern, by length within the bounds and no further."""
    ends = {
        "email": ("a@b.cd", "a" * 60 + "@example.org"), "phone_international": ("1234567", "+123456789012345"), "italian_tax_code": ("RSSMRA85T10A562S",) * 2,
        "iban": ("IT60X054281110", "IT60" + "X" * 30), "postal_code_generic": ("a-1", "a b-c d-e9"), "ssn_usa": ("123456789", "123-45-6789"), "nin_uk": ("AB123456C",) * 2,
        "sin_canada": ("123456789", "123 456 789"), "tfn_australia": ("12345678", "123456789"), "passport_generic": ("a23456", "a23456789"), "passport_uk": ("123456789",) * 2,
        "passport_usa": ("123456789",) * 2, "aadhaar_india": ("123412341234", "1234 1234 1234"), "credit_card": ("4123456789012", "4123456789012345"),
        "ipv4": ("1.2.3.4", "255.255.255.255"), "ipv6": ("1:2:3:4:5:6:7:8", ":".join(["abcd"] * 8)), "mac_address": ("00:11:22:33:44:55",) * 2,
    }
    assert set(ends) == set(fixed.SEMANTIC_PATTERNS) == set(fixed.SEMANTIC_LENGTHS)
    for label, (short, long) in ends.items():
        least, most = fixed.SEMANTIC_LENGTHS[label]
        assert len(short) == least and (most is None or len(long) == most)
        df = spark.createDataFrame([(short, long)], "s string, l string")
        assert {r["column"] for r in quality.semantic_profile(df).filter(F.col("pattern") == label).collect()} == {"s", "l"}


def test_sensitive_names(spark):
    names = ["città", "ETÀ", "userEmail", "e-mail", "codice_fiscale", "value", "telemetry", "hotel", "Birth day", "regional", "name"]
    df = spark.createDataFrame([(n,) for n in names], "column string")
    got = {r["column"]: r for r in privacy.sensitive_names(df).collect()}
    assert got["città"]["sensitive"] and got["ETÀ"]["sensitive"] and got["userEmail"]["score"] == 2 and got["e-mail"]["score"] == 4
    assert got["codice_fiscale"]["reasons"] == ["matched keyword in personal_identifier"]
    assert got["telemetry"]["sensitive"] and got["hotel"]["sensitive"]  # both contain "tel"
    assert got["Birth day"]["sensitive"] and not got["value"]["sensitive"] and not got["regional"]["sensitive"] and not got["name"]["sensitive"]


def test_entities(spark):
    df = spark.createDataFrame([(1, "Write to Ann@x.org. or 10.0.0.1, IBAN IT60X0542811101000000123456! plain words")], "id int, text string")
    got = {(r["label"], r["entity"]) for r in privacy.entities(df, "text").collect()}
    assert got == {("email", "Ann@x.org"), ("ipv4", "10.0.0.1"), ("iban", "IT60X0542811101000000123456")}


def test_types(spark):
    df = spark.createDataFrame([(1, 2**31, "x" * 50, "x" * 51, "x" * 256, 1.5, True, None)],
                               "a int, b long, s string, m string, l string, d double, f boolean, n long")
    got = {r["column"]: r["sql_type"] for r in profile.suggest_sql_type(df).collect()}
    assert got == {"a": "INT", "b": "BIGINT", "s": "VARCHAR(50)", "m": "VARCHAR(255)", "l": "TEXT", "d": "DECIMAL(18,6)", "f": "BOOLEAN", "n": "INT"}


def test_keys_and_dependencies(spark):
    rows = [(i, i // 2, i % 2, "k", None if i == 0 else i) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, half int, bit int, const string, gap int")
    keys = {r["key_columns"] for r in dep.candidate_keys(df, 2).collect()}
    assert keys == {"id", "half, bit"}
    fds = {(r["determinant"], r["dependent"]) for r in dep.functional_dependencies(df.drop("gap"), tolerance=0.0).collect()}
    assert fds == {("id", "half"), ("id", "bit"), ("id", "const"), ("half", "const"), ("bit", "const")}
    loose = dep.functional_dependencies(spark.createDataFrame([(1, "a")] * 99 + [(1, "b")], "x int, y string"), tolerance=0.01)
    assert [(r["determinant"], r["violation_rate"]) for r in loose.orderBy("determinant").collect()] == [("x", 0.01), ("y", 0.0)]
    other = spark.createDataFrame([(0.0,), (1.0,), (99.0,)], "v double")
    got = {r["a_column"]: r["coverage_pct"] for r in dep.inclusion_dependencies(df.select("bit", "half"), other).collect()}
    assert got == {"bit": 100.0, "half": 40.0}


def test_functional_dependencies_of_many_columns(spark):
    rows = [(i, i // 2, i // 4, i % 3, 7, str(i), i * 1.5, f"g{i // 4}", i % 2, None if i % 5 else i, (i // 2) % 7) for i in range(200)]
    names = [f"c{i}" for i in range(11)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, ["int"] * 5 + ["string", "double", "string", "int", "int", "int"])))
    got = {(r["determinant"], r["dependent"]): round(r["violation_rate"], 9) for r in dep.functional_dependencies(df, tolerance=0.05).collect()}
    want = {}
    for i, x in enumerate(names):
        for j, y in enumerate(names):
            groups = {}
            for r in rows:
                groups.setdefault(r[i], []).append(r[j])
            broken = sum(len(g) - max(map(g.count, g)) for g in groups.values()) / len(rows)
            if x != y and broken <= 0.05:
                want[x, y] = round(broken, 9)
    assert got == want and ("c7", "c2") in got and ("c0", "c10") in got
    assert dep.functional_dependencies(df.filter("false")).count() == 0


def test_inclusion_by_value(spark):
    a = spark.sql("SELECT * FROM VALUES (1.0E7D, 1.50BD, DATE'2020-01-02', 0.25D), (2.5E7D, 3.00BD, DATE'2020-01-03', 1e20D), (3D, 4.00BD, DATE'2020-01-04', -0.0D) AS t(d, m, day, f)")
    b = spark.sql("SELECT * FROM VALUES (10000000L, 1.5D, TIMESTAMP_NTZ'2020-01-02 00:00:00', 0), (25000000L, 3D, TIMESTAMP_NTZ'2020-01-03 00:00:00', 5), (3L, 4D, TIMESTAMP_NTZ'2020-01-04 10:00:00', 6) AS t(n, x, at, z)")
    got = {(r["a_column"], r["b_column"]): r["included"] for r in dep.inclusion_dependencies(a, b).collect()}
    assert got["d", "n"] == 3 and got["m", "x"] == 3 and got["day", "at"] == 2 and got["f", "z"] == 1


def test_inclusion_is_exact(spark):
    from decimal import Decimal

    a = spark.createDataFrame([(Decimal("1.00000000000000000001"), 2e16, 0.1), (Decimal("1.00000000000000000002"), 1.5e300, -0.0), (Decimal("0E-20"), 12345.678, 1e-7), (None, float("nan"), 100.0)], "d decimal(38,20), x double, f double")
    b = spark.createDataFrame([(Decimal("1.00000000000000000001"), 20_000_000_000_000_000, "n"), (Decimal("0.1"), 0, "m"), (Decimal("100"), 12345, None)], "e decimal(38,20), n long, t string")
    got = {(r["a_column"], r["b_column"]): (r["distinct_values"], r["included"]) for r in dep.inclusion_dependencies(a, b).collect()}
    assert got == {("d", "e"): (3, 1), ("d", "n"): (3, 1), ("x", "n"): (3, 1), ("f", "e"): (4, 2), ("f", "n"): (4, 1)}


def test_keys_of_doubles_are_read_not_worked_out(spark):
    rows = spark.createDataFrame([(1.5,), (None,), (float("nan"),), (-0.0,)], "v double").select(quantiles.ordered_key(F.col("v")).alias("k"))
    plan = rows._jdf.queryExecution().executedPlan().toString().lower()
    assert "arrowevalpython" in plan and "log2" not in plan and "pow" not in plan
    assert [r["k"] for r in rows.collect()] == [0x3FF8 << 48, None, (1 << 63) - 1, 0]


def test_values_in_one_form_by_parts_worked_out_once(spark):
    written = ["3", "3.00", "3.0E0", "-3", "0.00", "0E-20", "-0.0", "1.0E15", "1000000000000000", "12.50", "1.25E-5", "0.0000125", "Infinity", "-Infinity", "9007199254740993"]
    rows = spark.createDataFrame([("numeric", v) for v in written] + [("datetime", "2024-01-02 00:00:00"), ("text", "03.0E1")], "kind string, value string")
    found = dep._in_one_form(rows)
    assert [r["value"] for r in found.collect()] == [
        "3e0", "3e0", "3e0", "-3e0", "0", "0", "0", "1e15", "1e15", "125e1", "125e-5", "125e-5", "Infinity", "-Infinity", "9007199254740993e15", "2024-01-02", "03.0E1"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract" not in plan and plan.count("substring_index(value") == 1

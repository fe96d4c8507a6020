"""Energy formulas, SQL text and prompts on literal cases."""

import pytest
from pyspark.sql import functions as F

from greenframe.functions import energy, prompts, sqltext
from greenframe.operators import benchmark


def column(spark, values, schema, expression):
    return [r[0] for r in spark.createDataFrame(values, schema).select(expression).collect()]


def test_green_score(spark):
    cases = [(0.0, 10, 1.0, 100), (1.0, 10, 0.0, 100), (1.0, 0, 1.0, 0), (0.1, 1000, 0.1, 100), (10.0, 10, 10.0, 0),
             (1.0, 100, 1.0, 50), (1.0, 1, 1.0, 16), (0.00001, 1, 0.00001, 100), (1.0, -5, 1.0, 0)]
    got = column(spark, [c[:3] for c in cases], "c double, r long, s double", energy.green_score("c", "r", "s"))
    assert got == [c[3] for c in cases]


def test_zones_bands_and_hosts(spark):
    assert column(spark, [(80,), (79,), (60,), (40,), (39,)], "s int", energy.score_zone("s")) == ["Excellent", "Good", "Good", "Fair", "Poor"]
    assert column(spark, [(59.9,), (60.0,), (140.0,)], "w double", energy.power_band("w")) == ["low", "medium", "high"]
    assert column(spark, [(179.9,), (180.0,)], "w double", energy.power_alarm("w")) == [False, True]
    hosts = [(8, 4100.0, 125.0), (4, 4100.0, 95.0), (2, 4100.0, 65.0), (6, 3500.0, 65.0), (4, 3500.0, 45.0), (2, 3500.0, 65.0),
             (16, 3000.0, 65.0), (8, 4000.0, 65.0)]
    assert column(spark, [h[:2] for h in hosts], "c int, m double", energy.estimate_tdp("c", "m")) == [h[2] for h in hosts]


def test_power_and_equivalents(spark):
    assert column(spark, [(50.0,)], "p double", energy.cpu_power_w("p")) == [32.5]
    assert column(spark, [(50.0, None), (50.0, 20.0)], "p double, r double", energy.gpu_power_w("p", "r")) == [75.0, 20.0]
    assert column(spark, [(3600.0,)], "w double", F.round(energy.co2_g_per_s("w"), 9)) == [0.25]
    found = energy.co2_equivalents("g")
    assert column(spark, [(8.22,), (-1.0,)], "g double", found["phones"]) == [1.0, 0.0]
    assert column(spark, [(120.0,)], "g double", found["car_m"]) == [1000.0]
    assert column(spark, [(-1.0,)], "g double", found["led_hours"]) == [-100.0]


@pytest.mark.parametrize("text, sql", [
    ("Sure:\n```sql\nSELECT * FROM users\n```\nDone", "SELECT * FROM users"),
    ("```\nSELECT 1;\n```", "SELECT 1;"),
    ("```sql\n\n```", None),
    ("Here it is: select a from t; and more text", "select a from t;"),
    ("SELECT a FROM t\n### Test cases\nfoo", "SELECT a FROM t;"),
    ("SELECT a FROM t\n- a bullet", "SELECT a FROM t;"),
    ("SELECT a\nFROM t\n\nSELECT b FROM u", "SELECT a\nFROM t;"),
    ("WITH x AS (SELECT 1) SELECT * FROM x", "WITH x AS (SELECT 1) SELECT * FROM x;"),
    ("DELETE FROM t WHERE a = 1 for example", "DELETE FROM t WHERE a = 1 for;"),
    ("no query here", None),
    ("selection and updates", None),
    ("", None),
    (None, None),
])
def test_extract_sql(spark, text, sql):
    assert column(spark, [(text,)], "t string", sqltext.extract_sql("t")) == [sql]


def test_split_candidates(spark):
    text = "```sql\n" + ";\n".join(f"SELECT {i}" for i in range(7)) + ";\n;;```"
    df = spark.createDataFrame([(1, text), (2, " ; "), (3, "SELECT 9")], "id int, t string")
    found = sqltext.candidate_rows(df, "t").orderBy("id", "position").collect()
    assert [(r["id"], r["position"], r["sql"]) for r in found] == [(1, i + 1, f"SELECT {i}") for i in range(5)] + [(3, 1, "SELECT 9")]


def test_prompts(spark):
    table = spark.createDataFrame([(1, "x")], ["user id", "name"])
    context = prompts.context_text({"t": table})
    assert context == 'Table t: 1 rows, 2 columns\n  - "user id" (bigint)\n  - name (string)'
    asked = spark.createDataFrame([("How many?", "SELECT 1", 0.123456), ("Why?", "SELECT 2", None)], "q string, s string, g double")
    first = prompts.prompt_rows(asked, "q", context, "MySQL").first()["prompt"]
    assert "MySQL" in first and context in first and "How many?" in first
    rewrites = [r["prompt"] for r in prompts.prompt_rows(asked, "q", context, "MySQL", "s", "g").collect()]
    assert "0.1235 g" in rewrites[0] and "g of CO2" not in rewrites[1] and "SELECT 2" in rewrites[1]


def test_race(spark):
    def winner(rows):
        return tuple(benchmark.race_winner(spark.createDataFrame(rows, "model string, total_co2_g double")).first())
    assert winner([("A", 1.0), ("B", 4.0)]) == ("A", "B", 3.0, 75.0)
    assert winner([("A", 2.0), ("B", 2.0)]) == ("B", "A", 0.0, 0.0)
    assert winner([("A", 0.0), ("B", 0.0)]) == ("B", "A", 0.0, 0.0)


def test_match_quality(spark):
    generated = spark.createDataFrame([(1, "SELECT 1;"), (2, "  select A "), (3, None), (4, "SELECT 5"), (5, "SELECT 6")], "query_id int, generated_sql string")
    truth = spark.createDataFrame([(1, "select 1"), (2, "SELECT a;"), (3, "SELECT 3"), (4, "SELECT 4")], "query_id int, ground_truth_sql string")
    details = benchmark.match_details(generated, truth)
    assert {r["query_id"]: r["status"] for r in details.collect()} == {1: "Correct", 2: "Correct", 3: "Wrong", 4: "Wrong", 5: "Wrong"}
    quality = benchmark.match_quality(details).first().asDict()
    assert (quality["tp"], quality["fp"], quality["fn"], quality["accuracy"]) == (2, 2, 1, 40.0)
    assert quality["precision"] == 0.5 and quality["recall"] == 2 / 3 and abs(quality["f1"] - 4 / 7) < 1e-12
    empty = benchmark.match_quality(details.filter("false")).first().asDict()
    assert empty["accuracy"] == 0.0 and empty["f1"] == 0.0

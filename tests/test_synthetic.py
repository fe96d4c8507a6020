import pytest
from pyspark.sql import functions as F

from greenframe.functions import fixed_values as fixed
from greenframe.functions.numeric import (
    bisect_right,
    literal_array,
    normal_cdf,
    normal_quantile,
)
from greenframe.operators import synthetic as sy
from greenframe.plans.compare import results_equivalent


@pytest.mark.parametrize("locale", fixed.LOCALES)
def test_every_provider(spark, locale):
    columns = [(p, p) for p in sy.PROVIDERS]
    made = sy.generate_fake(spark, 50, columns, locale)
    assert len(columns) == 38 and made.count() == 50
    assert made.dropna().count() == 50


def test_same_seed_same_rows(spark):
    columns = [("n", "name"), ("m", "email"), ("n2", "name")]
    one = sy.generate_fake(spark, 200, columns, seed=1)
    assert results_equivalent(one, sy.generate_fake(spark, 200, columns, seed=1))
    assert not results_equivalent(one, sy.generate_fake(spark, 200, columns, seed=2))
    assert one.filter("n <> n2").count() > 0


@pytest.mark.parametrize("rows, columns, locale", [(0, [("a", "name")], "en_US"), (5, [], "en_US"), (5, [("a", "nope")], "en_US"),
                                                   (5, [("a", "name"), ("a", "city")], "en_US"), (5, [("a", "name")], "xx_XX")])
def test_bad_requests(spark, rows, columns, locale):
    with pytest.raises(ValueError):
        sy.generate_fake(spark, rows, columns, locale)


def test_normal_functions(spark):
    u = [0.001, 0.02, 0.3, 0.5, 0.9, 0.9999]
    rows = spark.createDataFrame([(x,) for x in u], "u double").select("u", normal_cdf(normal_quantile(F.col("u"))).alias("v")).collect()
    assert all(abs(r["u"] - r["v"]) < 1e-6 for r in rows)
    values = [1.0, 2.0, 2.0, 5.0]
    got = [r[0] for r in spark.createDataFrame([(0.0,), (1.0,), (2.0,), (4.9,), (9.0,)], "x double").select(bisect_right(literal_array(values), F.col("x"), 4)).collect()]
    assert got == [0, 1, 3, 3, 4]


def test_copula_keeps_margins_and_links(spark):
    real = spark.range(4000).select(
        (F.col("id") % 97).alias("k"), ((F.col("id") % 97) * 2 + F.col("id") % 5).cast("double").alias("linked"),
        F.when(F.col("id") % 4 == 0, None).otherwise(F.lit("yes")).alias("some"), F.when(F.col("id") % 10 < 7, "a").otherwise("b").alias("cat"),
        F.concat(F.lit("id"), F.col("id").cast("string")).alias("name"), (F.col("id") % 3 == 0).alias("flag"),
        F.timestamp_seconds(F.col("id") * 1000).alias("at"), F.lit(None).cast("double").alias("none"),
    )
    made = sy.generate_copula(real, 4000, seed=5)
    assert made.schema.simpleString() == real.schema.simpleString()
    row = made.agg(F.avg("k"), F.corr("k", "linked"), F.count("some") / 4000, F.count_if(F.col("cat") == "a") / 4000,
                   F.count_distinct("name"), F.min("k"), F.max("k"), F.count("none"), F.count_if("flag") / 4000).first()
    assert abs(row[0] - 48) < 2 and row[1] > 0.97 and abs(row[2] - 0.75) < 0.03 and abs(row[3] - 0.7) < 0.03
    assert row[4] == 4000 and row[5] >= 0 and row[6] <= 96 and row[7] == 0 and abs(row[8] - 1 / 3) < 0.03
    assert results_equivalent(made, sy.sample_copula(sy.fit_copula(real), spark.range(4000).repartition(7), "id", 5).drop("id"))
    report = sy.synthetic_report(real, made)
    assert report.filter("measure = 'mean'").count() == 3


def test_related_tables(spark):
    """One parent holds a third of all children, some have none; a second key and a self reference stay valid."""
    parents = spark.range(60).select(F.col("id").alias("pk"), (F.col("id") * 1.5).alias("x"))
    children = spark.range(900).select(
        (F.col("id") + 5000).alias("ck"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 30).cast("long").alias("p"),
        (F.col("id") % 4).alias("q"), F.col("id").alias("boss"), F.lit("t").alias("t"))
    kinds = spark.range(4).select(F.col("id").alias("kk"), F.lit(1).alias("w"))
    keys = [sy.ForeignKey("children", "p", "parents", "pk"), sy.ForeignKey("children", "q", "kinds", "kk"),
            sy.ForeignKey("children", "boss", "children", "ck")]
    made = sy.generate_relational({"children": children, "parents": parents, "kinds": kinds}, {"children": "ck", "parents": "pk", "kinds": "kk"}, keys, rows=1800)
    assert made["parents"].count() == 120 and made["kinds"].count() == 8
    kids = made["children"]
    n = kids.count()
    assert 300 < n < 6000 and kids.select("ck").distinct().count() == n and kids.agg(F.max("ck")).first()[0] == n - 1
    for column, table, key in (("p", "parents", "pk"), ("q", "kinds", "kk"), ("boss", "children", "ck")):
        assert kids.alias("a").join(made[table].select(F.col(key).alias("_z")), F.col(f"a.{column}") == F.col("_z"), "left_anti").count() == 0
    with pytest.raises(ValueError):
        sy.generate_relational({"a": parents, "b": kinds}, {"a": "pk", "b": "kk"}, [sy.ForeignKey("a", "x", "b", "kk"), sy.ForeignKey("b", "w", "a", "pk")])


def test_a_parent_of_very_many_children_is_cut_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sy, "BLOCK", 10)
    parents = spark.createDataFrame([(0, 3), (1, 0), (2, 95), (15, 7), (31, 1)], "id long, n long")
    rows, total = sy._numbered_children(parents, "id", "n")
    got = sorted((r["_id"], r["_parent"]) for r in rows.collect())
    assert total == 106 and [i for i, _ in got] == list(range(106))
    assert [p for _, p in got] == [0] * 3 + [2] * 95 + [15] * 7 + [31]


def test_the_largest_family_stays(spark):
    parents = spark.range(1000).selectExpr("concat('p', id) AS pk", "id % 3 AS v")
    kids = spark.range(3000).selectExpr("id AS ck", "CASE WHEN id < 2001 THEN 'p7' WHEN id % 10 = 0 THEN NULL ELSE concat('p', id % 1000) END AS p", "concat('p', id % 5) AS q", "id * 0.5 AS w")
    made = sy.generate_relational({"parents": parents, "kids": kids}, {"parents": "pk", "kids": "ck"}, [sy.ForeignKey("kids", "p", "parents", "pk"), sy.ForeignKey("kids", "q", "parents", "pk")])
    assert dict(made["kids"].dtypes)["p"] == "string" and dict(made["parents"].dtypes)["pk"] == "string"
    families = lambda df: sorted(r["n"] for r in df.filter("p IS NOT NULL").groupBy("p").agg(F.count("*").alias("n")).collect())
    assert families(made["kids"]) == families(kids) and max(families(kids)) > 2000
    assert made["kids"].filter("p IS NULL").count() == kids.filter("p IS NULL").count()
    assert made["kids"].select("ck").distinct().count() == 3000


def test_lines_compared_are_as_many_as_the_real_ones(spark, folder, monkeypatch):
    from greenframe.plans.queries import synthesis

    asked, generate = [], sy.generate_copula
    monkeypatch.setattr(synthesis.synthetic, "generate_copula", lambda df, rows: asked.append((rows, df.count())) or generate(df, rows))
    report = synthesis.synthetic_lines_compared(spark, folder)
    assert asked and all(rows == real for rows, real in asked) and all(r["near"] for r in report.collect())


@pytest.mark.parametrize("values", [480, 520, 5000])
def test_any_number_of_categories(spark, values):
    real = spark.range(20_000).select(F.concat(F.lit("v"), F.least(F.col("id") % (2 * values), F.lit(values - 1)).cast("string")).alias("c"), F.when(F.col("id") % 2 == 0, b"\xff").otherwise(b"\x00").alias("b"))
    model = sy.fit_copula(real)
    shares = model.margins[0].shares
    assert shares.values == values and shares.total == 20_000
    # ranges lie side by side from 0 to the number of rows, the commonest first
    rows = sorted((r["from"], r["n"]) for r in shares.table.collect())
    assert [f for f, _ in rows] == [sum(n for _, n in rows[:k]) for k in range(len(rows))] and rows[0][1] == max(n for _, n in rows)
    made = sy.generate_copula(real, 20_000, seed=3)
    assert dict(made.dtypes) == dict(real.dtypes) and made.count() == 20_000
    known = {r["c"]: r["count"] for r in real.groupBy("c").count().collect()}
    got = {r["c"]: r["count"] for r in made.groupBy("c").count().collect()}
    assert set(got) <= set(known) and abs(got[f"v{values - 1}"] - known[f"v{values - 1}"]) < 500
    assert {bytes(r["b"]) for r in made.select("b").distinct().collect()} == {b"\xff", b"\x00"}


def test_every_rank_has_one_category(spark):
    table = spark.createDataFrame([("a", 0, 7), ("b", 7, 2), ("c", 9, 1), ("d", 10, 1)], "value string, from long, n long")
    shares = sy.Shares(table, 4, 11)
    ranks = spark.range(11).select("id", shares.rank((F.col("id") + 0.5) / 11).alias("r"))
    got = [r["v"] for r in shares.at(ranks, "r", "v").orderBy("id").collect()]
    assert got == ["a"] * 7 + ["b"] * 2 + ["c", "d"]


@pytest.mark.parametrize("most, join", [(10, "BuildRight"), (2, "SortMergeJoin")])
def test_made_rows_are_never_sent_to_all_tasks(spark, monkeypatch, most, join):
    """Spark takes rows made from a few by explode() for a few."""
    monkeypatch.setattr(sy, "MOST_SENT", most)
    table = sy.checkpointed(spark.createDataFrame([("a", 0, 7), ("b", 7, 2), ("c", 9, 1), ("d", 10, 1)], "value string, from long, n long"))
    shares = sy.Shares(table, 4, 11)
    rows = spark.range(2).repartition(2).select("id", F.explode(F.sequence(F.lit(0), F.lit(4999))).alias("i")).select((F.col("i") % 11).alias("r"))
    joined = shares.at(rows, "r", "v")
    assert joined.count() == 10_000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert join in plan and "BuildLeft" not in plan


def test_ids_made_from_few_pieces_come_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(sy, "BLOCK", 10)
    wanted = sy._children_wanted(spark.range(1000).select((F.col("id") % 3).alias("_c")), 1000, 42)
    assert wanted.select(F.spark_partition_id()).distinct().count() > 1
    assert sorted(r["id"] for r in wanted.collect()) == list(range(1000))
    rows, total = sy._numbered_children(wanted, "id", "_wanted")
    assert total == 999 and rows.select(F.spark_partition_id()).distinct().count() > 1


def test_normal_functions_of_arrays_are_those_of_columns(spark):
    import numpy as np

    from greenframe.functions.numeric import normal_cdfs, normal_quantiles

    u = np.array([1e-6, 0.001, 0.02, 0.3, 0.5, 0.9, 0.98, 0.9999])
    rows = spark.createDataFrame([(float(x),) for x in u], "u double").select(normal_quantile(F.col("u")).alias("z"), normal_cdf(normal_quantile(F.col("u"))).alias("v")).collect()
    z = normal_quantiles(u)
    assert np.allclose(z, [r["z"] for r in rows], rtol=1e-12) and np.allclose(normal_cdfs(z), [r["v"] for r in rows], rtol=1e-12)
    assert np.isnan(normal_quantiles(np.array([np.nan])))[0]


@pytest.mark.parametrize("query", ["synthetic_lines_compared", "synthetic_categories_compared"])
def test_compared_rows_are_made_once(spark, folder, monkeypatch, query):
    from greenframe.plans.queries import synthesis

    made, whole = spark.sparkContext.accumulator(0), synthesis.synthetic.generate_copula

    def counted(real, rows):
        df = whole(real, rows)

        def passed(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        return df.mapInArrow(passed, df.schema)

    monkeypatch.setattr(synthesis.synthetic, "generate_copula", counted)
    synthesis.QUERIES[query](spark, folder).collect()
    assert made.value == spark.read.parquet(f"{folder}/lineitem.parquet").count()


def test_places_on_a_grid():
    import numpy as np

    """As by interpolation between knots, and the middle of knots that are equal."""
    for knots in (np.array([0.0, 1, 1, 1, 2, 5, 5]), np.array([3.0]), np.array([3.0, 3.0]), np.sort(np.random.default_rng(3).normal(size=401))):
        value = np.concatenate([knots, np.random.default_rng(4).uniform(-6, 6, 500), [np.nan, -1e308, 1e308]])
        left, right = np.searchsorted(knots, value, "left"), np.searchsorted(knots, value, "right")
        at = np.where(left == right, np.interp(value, knots, np.arange(len(knots))), (left + right - 1) / 2.0) / max(1, len(knots) - 1)
        assert np.allclose(sy._on_grid(value, knots), np.where(np.isnan(value), np.nan, at), rtol=1e-12, atol=1e-15, equal_nan=True)


def test_made_numbers_have_their_decimals(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    values = [float(x) for x in rng.normal(0, 1e5, 2000)] + [0.0, -0.0, 1e300, -1e300, 2.0**52 + 1, 123456789012.34567, float("nan")]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for digits in (0, 2, 6):
        for r in df.select(F.round("x", digits).alias("a"), sy._rounded(F.col("x"), digits).alias("b")).collect():
            assert r["a"] == r["b"] or np.isnan(r["a"]) and np.isnan(r["b"])

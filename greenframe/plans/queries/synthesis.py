"""Synthetic data queries: sized and fitted by the tables, checked by what must hold for every row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenframe.operators import synthetic
from greenframe.operators.profile import correlation_matrix
from greenframe.plans.queries.support import table
from greenframe.session import checkpointed, stored


def made_up_customers(spark, folder):
    """As many made-up people as there are customers."""
    columns = [("name", "name"), ("mail", "email"), ("phone", "phone_number"), ("iban", "iban"), ("born", "date"), ("ip", "ipv4")]
    return synthetic.generate_fake(spark, table(spark, folder, "customer").count(), columns, "it_IT", 7)


def made_up_customers_checked(spark, folder):
    columns = [(p, p) for p in synthetic.PROVIDERS]
    made = synthetic.generate_fake(spark, table(spark, folder, "orders").count(), columns, "en_US", 42)
    digits = F.sequence(F.lit(1), F.lit(16))
    luhn = F.aggregate(
        F.transform(digits, lambda i: (F.substr("credit_card_number", i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1))),
        F.lit(0), lambda a, b: a + F.floor(b / 10).cast("int") + b % 10)
    moved = F.concat(F.substr("iban", F.lit(5)), F.lit("3028"), F.substr("iban", F.lit(3), F.lit(2))).cast("decimal(38,0)")
    rules = {
        "mails": F.col("email").rlike(r"\A[a-z]+\d{4}@example\.(com|org|net)\z"),
        "cards": luhn % 10 == 0,
        "ibans": moved % 97 == 1,
        "addresses": F.col("ipv4").rlike(r"\A(\d{1,3}\.){3}\d{1,3}\z") & F.col("mac_address").rlike(r"\A([0-9a-f]{2}:){5}[0-9a-f]{2}\z"),
        "dates": F.to_date("date").between("1970-01-01", "2024-12-31"),
    }
    filled = F.lit(True)
    for p in synthetic.PROVIDERS:
        filled = filled & F.col(p).isNotNull()
    return made.agg(F.count(F.lit(1)).alias("n"), F.count_if(filled).alias("filled"), *[F.count_if(r).alias(k) for k, r in rules.items()])


def customers_without_names(spark, folder):
    """Customers under made-up names, their other columns as they are; one name for a customer wherever it comes."""
    real = table(spark, folder, "customer")
    made = synthetic.replace_personal(real, "c_custkey", {"c_name": "name"}, "de_DE", 7)
    again = synthetic.replace_personal(real.select("c_custkey", "c_name"), "c_custkey", {"c_name": "name"}, "de_DE", 7)
    names = real.select("c_custkey", F.col("c_name").alias("real")).join(again.withColumnRenamed("c_name", "again"), "c_custkey")
    both = made.join(names, "c_custkey")
    changed = (F.col("c_name") != F.col("real")) & F.col("c_name").rlike(r"^\p{L}+[ .\p{L}'-]+$")
    return both.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", changed.alias("changed"), (F.col("c_name") == F.col("again")).alias("repeated"))


def _lines(spark, folder):
    """Lines with a discount that follows the quantity, so that there is a correlation to keep."""
    return table(spark, folder, "lineitem", spread=True).select(
        "l_quantity", "l_extendedprice", (F.col("l_extendedprice") * 0.1 + F.col("l_quantity") * 100).alias("l_cost"),
        F.when(F.col("l_orderkey") % 4 != 0, F.col("l_tax")).alias("l_tax"), "l_returnflag", "l_shipdate",
    )


def synthetic_lines(spark, folder):
    real = _lines(spark, folder)
    return synthetic.generate_copula(real, real.count())


def synthetic_lines_compared(spark, folder):
    """Is each statistic of the synthetic lines near that of the real ones?"""
    real = _lines(spark, folder)
    made = stored(synthetic.generate_copula(real, real.count()), "made")
    report = synthetic.synthetic_report(real, made).filter(F.col("measure").isin("mean", "std", "q50", "missing_pct", "unique"))
    scale = F.greatest(F.abs("real"), F.lit(0.01))
    moments = report.select("column", "measure", (F.abs(F.col("real") - F.col("synthetic")) < 0.1 * scale + F.when(F.col("measure") == "missing_pct", 1.5).otherwise(0.0)).alias("near"))
    both = correlation_matrix(real).join(correlation_matrix(made).withColumnRenamed("corr", "made"), ["a", "b"])
    links = both.select(F.concat_ws("~", "a", "b").alias("column"), F.lit("corr").alias("measure"), (F.abs(F.col("corr") - F.col("made")) < 0.05).alias("near"))
    return moments.unionAll(links)


def synthetic_categories_compared(spark, folder):
    """A text column of thousands of values, one of which has a third of the rows: are values, shares and links kept?"""
    rare = F.concat(F.lit("order "), F.col("l_orderkey").cast("string"))
    real = table(spark, folder, "lineitem", spread=True).select(
        F.when(F.col("l_partkey") % 3 == 0, F.lit("common")).otherwise(rare).alias("label"), "l_quantity",
        F.when(F.col("l_partkey") % 3 == 0, F.col("l_quantity") + 60).otherwise(F.col("l_quantity")).alias("moved"),
    )
    rows = real.count()
    made = stored(synthetic.generate_copula(real, rows), "made")
    counts = real.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    both = counts.join(made.groupBy("label").agg(F.count(F.lit(1)).alias("m")), "label", "full").fillna(0)
    seen = F.sum((F.col("m") > 0).cast("double"))
    expected = F.sum(1 - F.exp(-F.col("n")))  # of the values, those that so many independent draws hit
    result = both.agg(
        F.count_if(F.col("n") > 0).alias("label_values"), F.sum("n").alias("all_rows"), F.sum("m").alias("made_rows"), F.count_if(F.col("n") == 0).alias("unknown_values"),
        (F.abs(F.max(F.when(F.col("label") == "common", F.col("m") - F.col("n")))) < 0.02 * F.sum("n")).alias("common_share_kept"),
        (F.abs(seen - expected) < 0.03 * expected).alias("rare_shares_kept"),
    )
    shift = lambda df, name: df.agg((F.avg(F.when(F.col("label") == "common", F.col("moved"))) - F.avg("moved")).alias(name))
    # the common label goes with large numbers, as it did
    linked = shift(real, "real_shift").crossJoin(F.broadcast(shift(made, "made_shift")))
    return result.crossJoin(F.broadcast(linked.select((F.col("made_shift") > 0.5 * F.col("real_shift")).alias("link_kept"))))


def _related(spark, folder):
    tables = {"customer": table(spark, folder, "customer"), "orders": table(spark, folder, "orders")}
    return synthetic.generate_relational(
        tables, {"customer": "c_custkey", "orders": "o_orderkey"},
        [synthetic.ForeignKey("orders", "o_custkey", "customer", "c_custkey")], rows=2 * tables["customer"].count(),
    )


def synthetic_orders(spark, folder):
    return _related(spark, folder)["orders"]


def synthetic_orders_checked(spark, folder):
    """Rows, orphans and repeated keys of twice as many customers and their orders."""
    made = _related(spark, folder)
    customers, orders = checkpointed(made["customer"]), checkpointed(made["orders"])
    orphans = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count(F.lit(1)).alias("rows"))
    parts = [
        customers.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("customers").alias("what"), "rows"),
        customers.agg(F.count_distinct("c_custkey").alias("rows")).select(F.lit("customer keys").alias("what"), "rows"),
        orphans.select(F.lit("orphans").alias("what"), "rows"),
        orders.agg((F.count(F.lit(1)) - F.count_distinct("o_orderkey")).alias("rows")).select(F.lit("repeated order keys").alias("what"), "rows"),
    ]
    families = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    parts += [
        orders.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("orders").alias("what"), "rows"),
        families.agg(F.max("n").alias("rows")).select(F.lit("largest family").alias("what"), "rows"),
        families.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("customers with orders").alias("what"), "rows"),
    ]
    return reduce(DataFrame.unionAll, parts)


QUERIES = {
    f.__name__: f
    for f in (
        made_up_customers, made_up_customers_checked, customers_without_names, synthetic_lines, synthetic_lines_compared, synthetic_categories_compared, synthetic_orders,
        synthetic_orders_checked,
    )
}

ORACLES = {
    "made_up_customers_checked": """SELECT count(*) AS n, count(*) AS filled, count(*) AS mails, count(*) AS cards, count(*) AS ibans,
  count(*) AS addresses, count(*) AS dates FROM orders""",
    "customers_without_names": "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, true AS changed, true AS repeated FROM customer",
    "synthetic_lines_compared": """WITH numbers AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_cost', 'l_tax']) AS c)
SELECT c AS "column", unnest(['mean', 'std', 'q50']) AS measure, true AS near FROM numbers
UNION ALL SELECT column_name, 'missing_pct', true FROM information_schema.columns
  WHERE table_name = 'lineitem' AND column_name IN ('l_quantity', 'l_extendedprice', 'l_tax', 'l_returnflag', 'l_shipdate')
UNION ALL SELECT 'l_cost', 'missing_pct', true UNION ALL SELECT 'l_returnflag', 'unique', true
UNION ALL SELECT a.c || '~' || b.c, 'corr', true FROM numbers a JOIN numbers b
  ON list_position(['l_quantity', 'l_extendedprice', 'l_cost', 'l_tax'], a.c) < list_position(['l_quantity', 'l_extendedprice', 'l_cost', 'l_tax'], b.c)""",
    "synthetic_categories_compared": """WITH labels AS (SELECT CASE WHEN l_partkey % 3 = 0 THEN 'common' ELSE 'order ' || l_orderkey END AS label FROM lineitem)
SELECT count(DISTINCT label) AS label_values, count(*) AS all_rows, count(*) AS made_rows, 0::BIGINT AS unknown_values, true AS common_share_kept, true AS rare_shares_kept,
  true AS link_kept FROM labels""",
    "synthetic_orders_checked": """SELECT 'customers' AS what, 2 * count(*) AS rows FROM customer
UNION ALL SELECT 'customer keys', 2 * count(*) FROM customer
UNION ALL SELECT 'orders', 2 * count(*) FROM orders
UNION ALL SELECT 'largest family', (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey))
UNION ALL SELECT 'customers with orders', (SELECT 2 * count(DISTINCT o_custkey) FROM orders)
UNION ALL SELECT 'orphans', 0 UNION ALL SELECT 'repeated order keys', 0""",
}

"""Imputation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from greenframe.operators import impute
from greenframe.plans.queries.profiling import LINES_SQL, lines
from greenframe.plans.queries.support import rounded, table

NUMBERS = ["l_quantity", "l_discount", "l_tax"]


def _shown(df, *extra):
    return df.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in NUMBERS], *extra)


def imputed_mean(spark, folder):
    return _shown(impute.impute_mean(lines(spark, folder), NUMBERS))


def imputed_median(spark, folder):
    return _shown(impute.impute_median(lines(spark, folder), NUMBERS))


def imputed_mode(spark, folder):
    return _shown(impute.impute_mode(lines(spark, folder), [*NUMBERS, "l_returnflag"]), "l_returnflag")


def imputed_constant(spark, folder):
    return _shown(impute.impute_constant(lines(spark, folder), NUMBERS, "0.5"))


def _orders(spark, folder):
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_orderpriority", F.when(key % 5 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 3 != 0, F.col("o_totalprice")).alias("o_totalprice"),
    )


_ORDERS_SQL = """
gaps AS (
  SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS o_totalprice FROM orders)"""


def imputed_first_rows(spark, folder):
    filled = impute.impute_simple(_orders(spark, folder), ["o_totalprice"], "mean", row_limit=100, key=["o_orderkey"])
    return filled.select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"))


def _parts(spark, folder):
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        "p_partkey", (key % 83).cast("double").alias("a"),
        F.when(key % 7 != 0, F.col("p_size")).cast("double").alias("b"),
        F.when(key % 11 != 0, F.col("p_retailprice") % 97).alias("c"),
    )


def imputed_neighbours(spark, folder):
    filled = impute.impute_knn(_parts(spark, folder), "p_partkey", ["a", "b", "c"], k=5, rows_per_cell=100)
    return filled.select("p_partkey", *[F.round(c, 6).alias(c) for c in ("a", "b", "c")])


def imputed_iteratively(spark, folder):
    """Prices and quantities of all lines; the gaps of each help to fill those of the others."""
    filled = impute.impute_iterative(
        lines(spark, folder).withColumn("l_extendedprice", F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice"))),
        ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], max_iter=5,
    )
    return _shown(filled, F.round("l_extendedprice", 2).alias("l_extendedprice"))


def imputed_neighbours_of_first_rows(spark, folder):
    filled = impute.impute_knn(_parts(spark, folder), "p_partkey", ["a", "b", "c"], k=5, rows_per_cell=100, row_limit=150)
    return filled.select("p_partkey", *[F.round(c, 6).alias(c) for c in ("a", "b", "c")])


def _dependent(spark, folder):
    """Lines with an amount that follows from two others, and gaps whose values are known."""
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), (F.col("l_quantity") * 3 + F.col("l_discount") * 500 + 10).alias("true_b"),
        (F.col("l_discount") * 100).alias("d"),
    )
    return rows.withColumn("b", F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 5 != 0, F.col("true_b")))


def _recovered(filled):
    """How many values come close to what they were."""
    near = F.abs(F.col("b") - F.col("true_b")) < 0.05 + 0.01 * F.abs("true_b")
    return filled.agg(F.count(F.lit(1)).alias("lines"), F.count_if(near).alias("near_b"))


def imputed_known_gaps(spark, folder):
    return _recovered(impute.impute_iterative(_dependent(spark, folder), ["a", "b", "d"], tolerance=1e-6))


def imputed_known_gaps_of_first_rows(spark, folder):
    order = ["l_orderkey", "l_linenumber"]
    return _recovered(impute.impute_iterative(_dependent(spark, folder), ["a", "b", "d"], tolerance=1e-6, row_limit=500, key=order))


def missing_cell_prompts(spark, folder):
    return impute.imputation_prompts(_orders(spark, folder), ["o_orderkey"], ["o_orderstatus"])


def missing_cell_queue(spark, folder):
    queue = impute.missing_cells(_orders(spark, folder), ["o_orderkey"])
    return queue.select(
        "o_orderkey", "column", F.get_json_object("row_data", "$.o_orderstatus").alias("marked"),
        F.get_json_object("row_data", "$.o_orderpriority").alias("priority"),
    )


def missing_cell_examples(spark, folder):
    return impute.example_rows(_orders(spark, folder), ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


def reviewed_values(spark, folder):
    """Every missing cell has a proposed value; those of even orders are accepted, some do not fit."""
    orders = _orders(spark, folder)
    status = orders.filter("o_orderstatus IS NULL").select("o_orderkey", F.lit("o_orderstatus").alias("column"), F.lit(" Z ").alias("imputed"))
    price = orders.filter("o_totalprice IS NULL").select(
        "o_orderkey", F.lit("o_totalprice").alias("column"),
        F.when(F.col("o_orderkey") % 4 == 0, "about ten").otherwise("12.5").alias("imputed"))
    decisions = status.unionAll(price).withColumn("accepted", F.col("o_orderkey") % 2 == 0)
    return impute.apply_imputations(orders, ["o_orderkey"], decisions)


QUERIES = {
    f.__name__: f
    for f in (
        imputed_mean, imputed_median, imputed_mode, imputed_constant, imputed_first_rows, imputed_neighbours,
        imputed_neighbours_of_first_rows, imputed_iteratively, imputed_known_gaps, imputed_known_gaps_of_first_rows,
        missing_cell_queue, missing_cell_examples, missing_cell_prompts, reviewed_values,
    )
}


def _fill_sql(values: dict[str, str], extra: str = "") -> str:
    cells = ", ".join(f"{rounded(f'coalesce({c}, {v})', 6)} AS {c}" for c, v in values.items())
    return f"WITH {LINES_SQL} SELECT l_orderkey, l_linenumber, {cells}{extra} FROM lines"


def _mode(c: str) -> str:
    return f"(SELECT {c} FROM lines WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def _knn_sql(source: str = "part") -> str:
    total = "coalesce((q.a - d.a) ** 2, 0.0) + coalesce((q.b - d.b) ** 2, 0.0) + coalesce((q.c - d.c) ** 2, 0.0)"
    shared = " + ".join(f"CASE WHEN q.{x} IS NOT NULL AND d.{x} IS NOT NULL THEN 1 ELSE 0 END" for x in "abc")
    near = ", ".join(
        f"""n{x} AS (SELECT id, avg(v) AS v FROM (
  SELECT q.id, d.{x} AS v, row_number() OVER (PARTITION BY q.id ORDER BY ({total}) * 3.0 / ({shared}), d.id) AS r
  FROM parts q JOIN parts d ON d.{x} IS NOT NULL WHERE q.{x} IS NULL AND ({shared}) > 0) WHERE r <= 5 GROUP BY id)"""
        for x in "bc"
    )
    return f"""WITH parts AS (
  SELECT p_partkey AS id, CAST(p_partkey % 83 AS DOUBLE) AS a, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS b,
    CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice % 97 END AS c FROM {source}),
{near}
SELECT p.id AS p_partkey, {rounded('p.a', 6)} AS a,
  {rounded('coalesce(p.b, nb.v, (SELECT avg(b) FROM parts))', 6)} AS b, {rounded('coalesce(p.c, nc.v, (SELECT avg(c) FROM parts))', 6)} AS c
FROM parts p LEFT JOIN nb ON nb.id = p.id LEFT JOIN nc ON nc.id = p.id"""


def _row_json(status: str) -> str:
    return f"""'{{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":' || coalesce('"' || {status} || '"', 'null')
  || ',"o_totalprice":' || coalesce(o_totalprice::VARCHAR, 'null') || '}}'"""


_EXAMPLES_SQL = f"""examples AS (
  SELECT name, o_orderkey, {_row_json('o_orderstatus')} AS row_data,
    row_number() OVER (PARTITION BY name ORDER BY md5(o_orderkey || '|42'), o_orderkey) AS nth
  FROM gaps, (VALUES ('o_orderstatus'), ('o_totalprice')) AS n(name)
  WHERE CASE name WHEN 'o_orderstatus' THEN o_orderstatus IS NOT NULL ELSE o_totalprice IS NOT NULL END)"""

ORACLES = {
    "imputed_mean": _fill_sql({c: f"(SELECT avg({c}) FROM lines)" for c in NUMBERS}),
    "imputed_median": _fill_sql({c: f"(SELECT quantile_cont({c}, 0.5) FROM lines)" for c in NUMBERS}),
    "imputed_mode": _fill_sql({c: _mode(c) for c in NUMBERS}, f", coalesce(l_returnflag, {_mode('l_returnflag')}) AS l_returnflag"),
    "imputed_constant": _fill_sql(dict.fromkeys(NUMBERS, "0.5")),
    "imputed_first_rows": f"""WITH {_ORDERS_SQL}, head AS (SELECT * FROM gaps ORDER BY o_orderkey LIMIT 100)
SELECT o_orderkey, {rounded('coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM head))', 4)} AS o_totalprice FROM head""",
    "imputed_neighbours": _knn_sql(),
    "imputed_neighbours_of_first_rows": _knn_sql("(SELECT * FROM part ORDER BY p_partkey LIMIT 150)"),
    "imputed_known_gaps": "SELECT count(*) AS lines, count(*) AS near_b FROM lineitem",
    "imputed_known_gaps_of_first_rows": "SELECT least(500, count(*)) AS lines, least(500, count(*)) AS near_b FROM lineitem",
    "missing_cell_examples": f"""WITH {_ORDERS_SQL}, {_EXAMPLES_SQL}
SELECT name AS "column", o_orderkey, row_data FROM examples WHERE nth <= 5""",
    "missing_cell_prompts": f"""WITH {_ORDERS_SQL}, {_EXAMPLES_SQL}
SELECT g.o_orderkey, 'o_orderstatus' AS "column", 'Give the value that is marked MISSING, and nothing else. Column: o_orderstatus
Rows that have it:
' || (SELECT string_agg(row_data, chr(10) ORDER BY nth) FROM examples WHERE nth <= 5 AND name = 'o_orderstatus') || '
Row:
' || {_row_json("'MISSING'")} AS prompt FROM gaps g WHERE o_orderstatus IS NULL""",
    "missing_cell_queue": f"""WITH {_ORDERS_SQL} SELECT o_orderkey, 'o_orderstatus' AS "column", 'MISSING' AS marked, o_orderpriority AS priority
FROM gaps WHERE o_orderstatus IS NULL""",
    "reviewed_values": f"""WITH {_ORDERS_SQL} SELECT o_orderkey, o_orderpriority,
  CASE WHEN o_orderstatus IS NULL AND o_orderkey % 2 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_totalprice IS NULL AND o_orderkey % 2 = 0 AND o_orderkey % 4 <> 0 THEN 12.5 ELSE o_totalprice END AS o_totalprice FROM gaps""",
}

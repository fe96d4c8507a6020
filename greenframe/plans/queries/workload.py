"""SQL pass-through, generated SQL text, sources and sinks."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenframe.functions import prompts, sqltext
from greenframe.plans import compare, execute
from greenframe.plans.export import export_profile
from greenframe.plans.queries.support import rounded, table
from greenframe.session import scratch_path
from greenframe.sources import files, tables as tbl


def _sql(text: str, *names: str):
    """A query handed to Spark as text, over views of the named tables."""

    def run(spark, folder):
        execute.register({name: table(spark, folder, name) for name in names})
        outcome = execute.run_sql(spark, text)
        if outcome.error is not None:
            raise RuntimeError(outcome.error)
        return outcome.dataframe

    return run


PLAIN_SQL = {
    "filter_equality": ("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'", ["customer"]),
    "filter_greater": ("SELECT * FROM lineitem WHERE l_quantity > 45", ["lineitem"]),
    "filter_at_least": ("SELECT * FROM part WHERE p_size >= 40", ["part"]),
    "filter_less": ("SELECT COUNT(*) AS cnt FROM lineitem WHERE l_quantity < 20", ["lineitem"]),
    "filter_two_predicates": ("SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 200000", ["orders"]),
    "filter_three_predicates": (
        "SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 AND l_discount > 0.05", ["lineitem"]),
    "filter_between": ("SELECT * FROM part WHERE p_size BETWEEN 10 AND 30", ["part"]),
    "filter_positive": ("SELECT * FROM lineitem WHERE l_tax > 0", ["lineitem"]),
    "aggregate_average": ("SELECT ROUND(AVG(l_quantity), 6) AS avg_quantity FROM lineitem", ["lineitem"]),
    "aggregate_average_filtered": (
        "SELECT ROUND(AVG(o_totalprice), 4) AS avg_price FROM orders WHERE o_orderstatus = 'P'", ["orders"]),
    "aggregate_maximum": ("SELECT MAX(o_totalprice) AS max_price FROM orders", ["orders"]),
    "aggregate_count_filtered": ("SELECT COUNT(*) AS cnt FROM customer WHERE c_acctbal > 0", ["customer"]),
    "count_distinct": ("SELECT COUNT(DISTINCT o_orderpriority) AS distinct_priorities FROM orders", ["orders"]),
    "count_by_one_key": ("SELECT c_mktsegment, COUNT(*) AS cnt FROM customer GROUP BY c_mktsegment", ["customer"]),
    "average_by_one_key": (
        "SELECT p_brand, ROUND(AVG(p_retailprice), 6) AS avg_price FROM part GROUP BY p_brand", ["part"]),
    "count_by_two_keys": (
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS cnt FROM lineitem GROUP BY l_returnflag, l_linestatus", ["lineitem"]),
    "average_by_two_keys": (
        "SELECT o_orderstatus, o_orderpriority, ROUND(AVG(o_totalprice), 4) AS avg_price FROM orders "
        "GROUP BY o_orderstatus, o_orderpriority", ["orders"]),
    "count_by_decade": (
        "SELECT CAST(FLOOR(p_size / 10) * 10 AS BIGINT) AS size_bucket, COUNT(*) AS cnt FROM part "
        "GROUP BY FLOOR(p_size / 10) * 10 ORDER BY size_bucket", ["part"]),
    "distinct_values": ("SELECT DISTINCT p_type FROM part", ["part"]),
    "distinct_values_except": ("SELECT DISTINCT p_brand FROM part WHERE p_brand <> 'Brand#1'", ["part"]),
    "join_through_sql": (
        "SELECT n_name, COUNT(*) AS orders, CAST(ROUND(SUM(o_totalprice), 2) AS DOUBLE) AS total FROM orders "
        "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
        ["orders", "customer", "nation"]),
    "rollup_through_sql": (
        "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS quantity FROM lineitem "
        "GROUP BY ROLLUP (l_returnflag, l_linestatus)", ["lineitem"]),
}


def quoted_identifiers(spark, folder):
    renamed = table(spark, folder, "customer").withColumnsRenamed({"c_acctbal": "acct-bal", "c_custkey": "cust-key"})
    execute.register({"customer_quoted": renamed})
    return execute.run_sql(
        spark, "SELECT `cust-key`, `acct-bal` FROM customer_quoted WHERE `acct-bal` > 5000;"
    ).dataframe


def workload_run(spark, folder):
    """One query per market segment and one that cannot run."""
    customer = table(spark, folder, "customer")
    execute.register({"customer": customer})
    segments = customer.select(F.col("c_mktsegment").alias("query_id")).distinct()
    good = segments.select(
        "query_id",
        F.concat(F.lit("SELECT * FROM customer WHERE c_mktsegment = '"), "query_id", F.lit("';")).alias("query"),
        F.lit("MySQL").alias("dbms"),
    )
    bad = segments.limit(1).select(
        F.lit("broken").alias("query_id"), F.lit("SELECT nothing FROM nowhere").alias("query"), F.lit("MySQL").alias("dbms")
    )
    results = execute.run_workload(good.unionAll(bad), spark)
    timed = (F.col("latency_s") > 0) & (F.col("co2_g") > 0)
    return results.select("query_id", "dbms", "rows", timed.alias("timed"), F.col("error").isNotNull().alias("failed"))


def workload_side_by_side(spark, folder):
    """A query per nation and segment, eight at a time, and one that would never end."""
    customer = table(spark, folder, "customer")
    execute.register({"customer": customer})
    groups = customer.select("c_nationkey", "c_mktsegment").distinct()
    name = F.format_string("%s in %d", "c_mktsegment", "c_nationkey")
    text = F.format_string("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = '%s' AND c_nationkey = %d", "c_mktsegment", "c_nationkey")
    many = groups.select(name.alias("query_id"), text.alias("query"), F.lit("spark").alias("dbms"))
    endless = groups.limit(1).select(F.lit("endless").alias("query_id"), F.lit("SELECT sum(id % 7) AS s FROM range(0, 1000000000000000000, 1, 2)").alias("query"), F.lit("spark").alias("dbms"))
    results = execute.run_workload(endless.unionAll(many), spark, at_once=8, limit_s=30.0)
    return results.select("query_id", "rows", (F.col("error") == "stopped after 30.0 s").alias("stopped"))


def _statement():
    return F.format_string("SELECT text FROM conversations WHERE conv_id = %d AND turn = %d", "conv_id", "turn")


def sql_from_answers(spark, folder):
    """Answers that wrap a statement in prose in five ways; the prose is the whole turn."""
    said, sql = F.col("text"), _statement()
    answer = (
        F.when(F.col("turn") % 5 == 0, F.concat(said, F.lit("\n```sql\n"), sql, F.lit("\n```\nDone.")))
        .when(F.col("turn") % 5 == 1, F.concat(said, F.lit("\n"), sql, F.lit(";\n"), said))
        .when(F.col("turn") % 5 == 2, F.concat(sql, F.lit("\n### Test cases\n"), said))
        .when(F.col("turn") % 5 == 3, F.concat(sql, F.lit("\nSELECT 1 FROM region")))
        .otherwise(F.concat(F.lit("- no statement\n"), said))
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", answer.alias("answer"))
    return rows.select("conv_id", "turn", sqltext.extract_sql("answer").alias("sql"))


def candidate_statements(spark, folder):
    """Each turn's text is an answer in a fenced block, its sentences the statements."""
    answer = F.concat(F.lit("```sql\n"), F.replace("text", F.lit(". "), F.lit(";\n")), F.lit("\n```"))
    rows = table(spark, folder, "conversations").select("conv_id", "turn", answer.alias("answer"))
    return sqltext.candidate_rows(rows, "answer").withColumn("position", F.col("position").cast("bigint"))


def _context_tables(spark, folder):
    return {name: table(spark, folder, name) for name in ("customer", "orders", "nation")}


def table_contexts(spark, folder):
    return prompts.schema_context(_context_tables(spark, folder))


def generation_prompts(spark, folder):
    questions = table(spark, folder, "benchmark")
    context = prompts.context_text({"nation": table(spark, folder, "nation")})
    return prompts.prompt_rows(questions, "text", context, "DuckDB").select("item_id", "prompt")


def rewrite_prompts(spark, folder):
    turns = table(spark, folder, "conversations").withColumn("sql", _statement()).withColumn(
        "co2", F.when(F.col("turn") % 2 == 0, F.col("conv_id") / 8)
    )
    context = prompts.context_text({"nation": table(spark, folder, "nation")})
    return prompts.prompt_rows(turns, "text", context, "SQLite", "sql", "co2").select("conv_id", "turn", "prompt")


def best_rewrites(spark, folder):
    """Every event is a rewrite of its user's query, whose duration is the user's mean value."""
    events = table(spark, folder, "events").withColumn("cents", F.col("value").cast("decimal(18,2)"))
    originals = events.groupBy("user_id").agg(
        F.avg("cents").cast("double").alias("duration"), (F.sum("cents").cast("double") / 1000).alias("co2_g")
    )
    candidates = events.select(
        "user_id", F.col("event_id").alias("position"), F.col("event_type").alias("sql"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        F.col("value").alias("duration"), F.length("props").cast("bigint").alias("rows"),
    )
    return compare.rank_alternatives(originals, candidates, ["user_id"]).select(
        "user_id", "position", "sql", "rows", "duration",
        *[F.round(c, 6).alias(c) for c in ("est_co2", "saving_g", "saving_pct")],
    )


def result_differences(spark, folder):
    """Customers by number of orders against customers: what is left are those without exactly one."""
    a = table(spark, folder, "orders").select(F.col("o_custkey").alias("custkey"))
    b = table(spark, folder, "customer").select(F.col("c_custkey").alias("custkey"))
    return compare.row_differences(a, b)


def rewrites_checked(spark, folder):
    """Is each rewrite equivalent to its original?"""
    execute.register({name: table(spark, folder, name) for name in ("customer", "orders")})
    pairs = [
        ("semi join for IN",
         "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
         "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey"),
        ("inner join for IN",
         "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
         "SELECT c_custkey FROM customer JOIN orders ON c_custkey = o_custkey"),
        ("column order",
         "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus",
         "SELECT COUNT(*) AS n, o_orderstatus FROM orders GROUP BY o_orderstatus"),
    ]
    checked = [(name, compare.results_equivalent(spark.sql(a), spark.sql(b))) for name, a, b in pairs]
    return spark.createDataFrame(checked, "rewrite string, equivalent boolean")


def selected_columns(spark, folder):
    picked = tbl.select_columns_across(
        {name: table(spark, folder, name) for name in ("customer", "supplier", "nation", "part")},
        ["c_nationkey", "s_nationkey", "n_nationkey"],
    )
    keys = [df.select(F.lit(name).alias("table_name"), F.col(df.columns[0]).alias("nationkey")) for name, df in picked.items()]
    return keys[0].unionAll(keys[1]).unionAll(keys[2])


def catalog_columns(spark, folder):
    names = ["customer", "orders", "lineitem", "events", "documents", "embeddings"]
    return tbl.catalog_profile(tbl.load_folder(spark, folder, names)).withColumn("position", F.col("position").cast("bigint"))


def catalog_tables(spark, folder):
    return tbl.row_counts(tbl.load_folder(spark, folder, ["region", "nation", "customer", "lineitem", "pages"]))


def first_rows(spark, folder):
    return files.preview(table(spark, folder, "orders"), ["o_orderkey"], 5)


def csv_round_trip(spark, folder):
    """Documents written as ``;`` separated text (line breaks and quotes included) and read back."""
    path = scratch_path(spark, "documents-csv")
    documents = table(spark, folder, "documents").withColumnRenamed("n_chars", "N chars")
    files.write_dataset(documents, path, "csv")
    back = files.read_delimited(spark, path, ";", fallback_encoding=None)
    return back.select("doc_id", "lang", "source", "n_chars", F.length("text").cast("bigint").alias("text_chars"), F.md5("text").alias("digest"))


def sniffed_delimiters(spark, folder):
    """Nations written with each delimiter; what the first lines tell of it."""
    nations, found = table(spark, folder, "nation"), []
    for sep in (";", ",", "|", "\t"):
        path = scratch_path(spark, "nation-csv")
        files.write_dataset(nations, path, "csv", sep)
        back = files.read_delimited(spark, path, files.sniff_delimiter(spark, path))
        found.append(back.select(F.lit(sep).alias("delimiter"), F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name"))
    return reduce(DataFrame.unionAll, found)


def exported_profile(spark, folder):
    """The profile bundle of two tables, written and read back."""
    path = scratch_path(spark, "profile")
    tables = {name: table(spark, folder, name) for name in ("customer", "orders")}
    export_profile(spark, tables, path, datetime(2024, 6, 1))
    parts = []
    for name in tables:
        metrics = spark.read.schema("rows long, cols long, missing_values_total long, duplicate_rows long").json(f"{path}/{name}/metrics.json")
        insights = spark.read.schema("column string").json(f"{path}/{name}/schema_insights.json").agg(F.count("column").alias("insights"))
        numbers = spark.read.option("header", True).schema("column string, count long").csv(f"{path}/{name}/descriptive_stats_numeric.csv").agg(F.sum("count").alias("numbers"))
        one = metrics.join(F.broadcast(insights), F.lit(True)).join(F.broadcast(numbers), F.lit(True))
        parts.append(one.select(F.lit(name).alias("table_name"), *one.columns))
    return reduce(DataFrame.unionAll, parts)


def saved_tables(spark, folder):
    """Tables saved under cleaned names and loaded again."""
    target = scratch_path(spark, "saved")
    outcome = tbl.save_tables({name: table(spark, folder, original) for name, original in
                               (("_order list", "orders"), ("supplier", "supplier"))}, folder=target)
    if any(outcome.values()):
        raise RuntimeError(outcome)
    return tbl.row_counts(tbl.load_folder(spark, target, list(outcome)))


QUERIES = {
    **{name: _sql(sql, *names) for name, (sql, names) in PLAIN_SQL.items()},
    "quoted_identifiers": quoted_identifiers,
    "workload_run": workload_run, "workload_side_by_side": workload_side_by_side,
    "sql_from_answers": sql_from_answers,
    "candidate_statements": candidate_statements,
    "table_contexts": table_contexts,
    "generation_prompts": generation_prompts,
    "rewrite_prompts": rewrite_prompts,
    "best_rewrites": best_rewrites,
    "result_differences": result_differences,
    "rewrites_checked": rewrites_checked,
    "selected_columns": selected_columns,
    "catalog_columns": catalog_columns,
    "catalog_tables": catalog_tables,
    "first_rows": first_rows,
    "csv_round_trip": csv_round_trip,
    "saved_tables": saved_tables,
    "sniffed_delimiters": sniffed_delimiters,
    "exported_profile": exported_profile,
}

_ADVICE = "\n".join(f"{i}. {text}" for i, text in enumerate(prompts.ADVICE, 1))
_NATION = "'Table nation: ' || (SELECT count(*) FROM nation) || ' rows, 3 columns\n  - n_nationkey (int)\n  - n_name (string)\n  - n_regionkey (int)'"
_STATEMENT_SQL = "'SELECT text FROM conversations WHERE conv_id = ' || conv_id || ' AND turn = ' || turn"

ORACLES = {
    **{name: sql for name, (sql, _) in PLAIN_SQL.items()},
    "aggregate_average": f"SELECT {rounded('AVG(l_quantity)', 6)} AS avg_quantity FROM lineitem",
    "aggregate_average_filtered": f"SELECT {rounded('AVG(o_totalprice)', 4)} AS avg_price FROM orders WHERE o_orderstatus = 'P'",
    "average_by_one_key": f"SELECT p_brand, {rounded('AVG(p_retailprice)', 6)} AS avg_price FROM part GROUP BY p_brand",
    "average_by_two_keys": f"""SELECT o_orderstatus, o_orderpriority, {rounded('AVG(o_totalprice)', 4)} AS avg_price
FROM orders GROUP BY o_orderstatus, o_orderpriority""",
    "join_through_sql": f"""SELECT n_name, COUNT(*) AS orders, {rounded('SUM(o_totalprice)', 2)} AS total FROM orders
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "quoted_identifiers": 'SELECT c_custkey AS "cust-key", c_acctbal AS "acct-bal" FROM customer WHERE c_acctbal > 5000',
    "workload_side_by_side": """SELECT c_mktsegment || ' in ' || c_nationkey AS query_id, count(*) AS rows, NULL::BOOLEAN AS stopped FROM customer GROUP BY 1
UNION ALL SELECT 'endless', 0, true""",
    "workload_run": """SELECT c_mktsegment AS query_id, 'MySQL' AS dbms, count(*) AS rows, true AS timed, false AS failed
FROM customer GROUP BY c_mktsegment
UNION ALL SELECT 'broken', 'MySQL', 0, true, true""",
    "sql_from_answers": rf"""WITH answers AS (
  SELECT conv_id, turn, CASE turn % 5
    WHEN 0 THEN text || chr(10) || '```sql' || chr(10) || {_STATEMENT_SQL} || chr(10) || '```' || chr(10) || 'Done.'
    WHEN 1 THEN text || chr(10) || {_STATEMENT_SQL} || ';' || chr(10) || text
    WHEN 2 THEN {_STATEMENT_SQL} || chr(10) || '### Test cases' || chr(10) || text
    WHEN 3 THEN {_STATEMENT_SQL} || chr(10) || 'SELECT 1 FROM region'
    ELSE '- no statement' || chr(10) || text END AS a FROM conversations),
tails AS (SELECT *, regexp_extract(a, '(?is)\b(SELECT|WITH|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)\b.*', 0) AS tail FROM answers),
cuts AS (SELECT *, regexp_extract(tail, '(?is)\A(.*?)(?:(?m:^\s*##)|(?m:^\s*[-*]\s)|```|\btest\s*cases?\b|\bexamples?\b)', 1) AS marked,
    regexp_extract(tail, '(?is)\A(.*?)\n\s*\b(SELECT|WITH|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)\b', 1) AS single FROM tails),
statements AS (SELECT conv_id, turn, a, regexp_replace(CASE WHEN contains(tail, ';') THEN split_part(tail, ';', 1) || ';'
    WHEN marked <> '' THEN marked WHEN single <> '' THEN single ELSE tail END, '\A\s+|\s+\z', '', 'g') AS s FROM cuts)
SELECT conv_id, turn, CASE WHEN contains(a, '```sql') THEN {_STATEMENT_SQL} WHEN s = '' THEN NULL
  WHEN s LIKE '%;' THEN s ELSE s || ';' END AS sql FROM statements""",
    "candidate_statements": r"""WITH parts AS (SELECT conv_id, turn,
  list_filter(list_transform(string_split(regexp_replace('```sql' || chr(10) || replace(text, '. ', ';' || chr(10)) || chr(10) || '```', '```sql|```', '', 'g'), ';'),
    lambda x: regexp_replace(x, '\A\s+|\s+\z', '', 'g')), lambda x: x <> '')[1:5] AS found FROM conversations)
SELECT conv_id, turn, unnest(range(1, len(found) + 1)) AS position, unnest(found) AS sql FROM parts""",
    "table_contexts": f"""SELECT 'nation' AS table_name, {_NATION} AS context
UNION ALL SELECT 'customer', 'Table customer: ' || (SELECT count(*) FROM customer) || ' rows, 5 columns
  - c_custkey (bigint)
  - c_name (string)
  - c_nationkey (int)
  - c_acctbal (double)
  - c_mktsegment (string)'
UNION ALL SELECT 'orders', 'Table orders: ' || (SELECT count(*) FROM orders) || ' rows, 6 columns
  - o_orderkey (bigint)
  - o_custkey (bigint)
  - o_orderstatus (string)
  - o_totalprice (double)
  - o_orderdate (timestamp_ntz)
  - o_orderpriority (string)'""",
    "generation_prompts": f"""SELECT item_id, 'Write one DuckDB SQL query that answers the question. Return only the query.
Schema:
' || {_NATION} || '
Question: ' || text || '
SQL:' AS prompt FROM benchmark""",
    "rewrite_prompts": f"""SELECT conv_id, turn, 'Give 3 to 5 SQLite queries that return the same rows with less work, separated by '';''.
{_ADVICE}' || CASE WHEN turn % 2 = 0 THEN '
The original emitted ' || printf('%.4f', conv_id / 8.0::DOUBLE) || ' g of CO2.' ELSE '' END || '
Schema:
' || {_NATION} || '
Question: ' || text || '
Original:
' || {_STATEMENT_SQL} || '
SQL:' AS prompt FROM conversations""",
    "best_rewrites": f"""WITH originals AS (
  SELECT user_id, {rounded('CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(*)', 6)} AS d,
    CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / 1000 AS g FROM events GROUP BY user_id),
priced AS (
  SELECT e.user_id, event_id AS position, event_type AS sql, length(props) AS rows, value AS duration, g * (value / d) AS est, g,
    row_number() OVER (PARTITION BY e.user_id ORDER BY value, event_id) AS rn
  FROM events e JOIN originals o ON e.user_id = o.user_id WHERE event_type <> 'error' AND value < d)
SELECT user_id, position, sql, rows, duration, {rounded('est', 6)} AS est_co2, {rounded('g - est', 6)} AS saving_g,
  {rounded('(g - est) / g * 100', 6)} AS saving_pct FROM priced WHERE rn = 1""",
    "result_differences": """WITH o AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1),
c AS (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY 1)
SELECT coalesce(o.k, c.k) AS custkey, coalesce(o.n, 0) - coalesce(c.n, 0) AS copies
FROM o FULL JOIN c ON o.k = c.k WHERE coalesce(o.n, 0) <> coalesce(c.n, 0)""",
    "rewrites_checked": """SELECT 'semi join for IN' AS rewrite, true AS equivalent
UNION ALL SELECT 'inner join for IN', (SELECT max(n) = 1 FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey))
UNION ALL SELECT 'column order', true""",
    "selected_columns": """SELECT 'customer' AS table_name, c_nationkey AS nationkey FROM customer
UNION ALL SELECT 'supplier', s_nationkey FROM supplier UNION ALL SELECT 'nation', n_nationkey FROM nation""",
    "catalog_columns": """WITH counts AS (
  SELECT 'customer' AS t, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders
  UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events
  UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings)
SELECT t AS table_name, n AS row_count, CAST(ordinal_position AS BIGINT) AS position, column_name,
  CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
    WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END AS column_type
FROM counts JOIN information_schema.columns ON table_name = t""",
    "catalog_tables": """SELECT 'region' AS table_name, count(*) AS row_count FROM region UNION ALL SELECT 'nation', count(*) FROM nation
UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'lineitem', count(*) FROM lineitem
UNION ALL SELECT 'pages', count(*) FROM pages""",
    "first_rows": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5",
    "csv_round_trip": """SELECT doc_id, lang, source, n_chars, length(text) AS text_chars, md5(text) AS digest FROM documents""",
    "sniffed_delimiters": """SELECT delimiter, n_nationkey, n_name FROM nation, (VALUES (';'), (','), ('|'), (chr(9))) AS d(delimiter)""",
    "exported_profile": """SELECT 'customer' AS table_name, count(*) AS rows, 5 AS cols, 0 AS missing_values_total, 0 AS duplicate_rows, 5 AS insights,
  count(c_custkey) + count(c_nationkey) + count(c_acctbal) AS numbers FROM customer
UNION ALL SELECT 'orders', count(*), 6, 0, 0, 6, count(o_orderkey) + count(o_custkey) + count(o_totalprice) FROM orders""",
    "saved_tables": """SELECT 'order_list' AS table_name, count(*) AS row_count FROM orders
UNION ALL SELECT 'supplier', count(*) FROM supplier""",
}

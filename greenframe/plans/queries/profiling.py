"""Profiling, data quality, privacy and dependency queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from greenframe.functions import fixed_values as fixed
from greenframe.operators import dependencies as dep
from greenframe.operators import privacy, profile, quality
from greenframe.plans.queries.support import TABLES, rounded, rounded_as_printed, table
from greenframe.sources.tables import catalog_profile, load_folder

AS_OF = datetime(1999, 6, 1)


def _r(digits, *columns):
    return [F.round(c, digits).alias(c) for c in columns]


def _big(*columns):
    return [F.col(c).cast("bigint").alias(c) for c in columns]


def lines(spark, folder):
    """``lineitem`` with missing and blank values put in by key."""
    key = F.col("l_orderkey")
    return table(spark, folder, "lineitem", spread=True).select(
        "l_orderkey", "l_linenumber",
        F.when(key % 7 != 0, F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        F.when(key % 11 != 0, F.col("l_discount")).alias("l_discount"),
        F.when(key % 17 != 0, F.col("l_tax")).when(key % 2 == 0, F.lit(float("nan"))).alias("l_tax"),
        F.when(key % 13 == 1, "").when(key % 13 != 0, F.col("l_returnflag")).alias("l_returnflag"),
        F.lit("same").alias("l_note"),
        F.when(key % 19 != 0, F.col("l_shipdate")).alias("l_shipdate"),
    )


LINES_SQL = """
lines AS (
  SELECT l_orderkey, l_linenumber,
    CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS l_quantity, l_extendedprice,
    CASE WHEN l_orderkey % 11 <> 0 THEN l_discount END AS l_discount,
    CASE WHEN l_orderkey % 17 <> 0 THEN l_tax END AS l_tax,
    CASE WHEN l_orderkey % 13 = 1 THEN '' WHEN l_orderkey % 13 <> 0 THEN l_returnflag END AS l_returnflag,
    'same' AS l_note,
    CASE WHEN l_orderkey % 19 <> 0 THEN l_shipdate END AS l_shipdate
  FROM lineitem)"""
LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_note", "l_shipdate"]
LINE_NUMBERS = LINE_COLUMNS[:6]


def clients(spark, folder):
    """``customer`` with two text columns that hold numbers in some of the rows."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment",
        F.when(key % 10 < 6, key.cast("string")).otherwise(F.col("c_name")).alias("mostly_numbers"),
        F.when(key % 10 < 5, key.cast("string")).otherwise(F.col("c_name")).alias("half_numbers"),
        F.when(key % 10 < 8, F.concat((key % 20).cast("string"), F.lit("d"))).alias("with_suffix"),
        F.when(key % 10 < 8, (key % 20).cast("string")).alias("few_numbers"),
        (F.col("c_acctbal") > 0).alias("in_credit"),
        F.concat(F.col("c_name"), F.repeat(F.lit("-long"), 20)).alias("long_name"),
    )


CLIENTS_SQL = """
clients AS (
  SELECT *, CASE WHEN c_custkey % 10 < 6 THEN CAST(c_custkey AS VARCHAR) ELSE c_name END AS mostly_numbers,
    CASE WHEN c_custkey % 10 < 5 THEN CAST(c_custkey AS VARCHAR) ELSE c_name END AS half_numbers,
    CASE WHEN c_custkey % 10 < 8 THEN (c_custkey % 20) || 'd' END AS with_suffix,
    CASE WHEN c_custkey % 10 < 8 THEN CAST(c_custkey % 20 AS VARCHAR) END AS few_numbers,
    c_acctbal > 0 AS in_credit, c_name || repeat('-long', 20) AS long_name
  FROM customer)"""
CLIENT_KINDS = {
    "c_custkey": "number", "c_name": "text", "c_nationkey": "number", "c_acctbal": "number", "c_mktsegment": "text",
    "mostly_numbers": "text", "half_numbers": "text", "with_suffix": "text", "few_numbers": "text",
    "in_credit": "boolean", "long_name": "text",
}


def table_metrics(spark, folder):
    return profile.table_metrics(lines(spark, folder)).select(
        "rows", "cols", "missing_cells", *_r(6, "missing_pct"), "duplicate_rows", *_r(6, "size_mb")
    )


def table_metrics_with_copies(spark, folder):
    few = lines(spark, folder).select("l_linenumber", "l_quantity", "l_returnflag", "l_tax")
    return profile.table_metrics(few).select("rows", "cols", "missing_cells", *_r(6, "missing_pct"), "duplicate_rows")


def column_categories(spark, folder):
    return profile.column_category(clients(spark, folder))


def schema_insights(spark, folder):
    return profile.schema_insights(clients(spark, folder), ["c_custkey"]).select(
        "column", "category", *_r(6, "unique_pct", "missing_pct"), "sensitive", "reasons", "example",
    )


def numeric_description(spark, folder):
    return profile.describe_numeric(lines(spark, folder)).select(
        "column", "count", *_r(4, "mean", "std", "min", "q25", "q50", "q75", "max")
    )


def text_description(spark, folder):
    return profile.describe_text(clients(spark, folder)).select(
        "column", "count", *_big("unique"), "top", *_big("freq"), *_r(6, "avg_len")
    )


def document_text_description(spark, folder):
    return profile.describe_text(table(spark, folder, "documents")).select(
        "column", "count", *_big("unique"), F.md5("top").alias("top"), *_big("freq"), *_r(4, "avg_len")
    )


def correlations(spark, folder):
    return profile.correlation_matrix(lines(spark, folder)).select("a", "b", *_r(6, "corr"))


def strongest_correlations(spark, folder):
    return profile.top_correlations(lines(spark, folder), 10).select("a", "b", *_r(6, "corr", "abs_corr"))


def constant_columns(spark, folder):
    return profile.constant_columns(lines(spark, folder))


def suggested_types(spark, folder):
    wide = clients(spark, folder).withColumn("big", F.col("c_custkey") * 100_000_000).withColumn(
        "opened", F.lit("2020-01-01").cast("timestamp"))
    return profile.suggest_sql_type(wide)


def missing_counts(spark, folder):
    return profile.missing_by_column(lines(spark, folder))


def missing_columns(spark, folder):
    return profile.columns_with_missing(lines(spark, folder))


def _order_gaps(spark, folder):
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        "o_orderkey", F.when(key % 5 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 3 != 0, F.col("o_totalprice")).alias("o_totalprice"), "o_orderdate",
    )


def missing_flags(spark, folder):
    return profile.missing_matrix(_order_gaps(spark, folder), ["o_orderkey"])


def missing_flags_sample(spark, folder):
    return profile.missing_matrix(_order_gaps(spark, folder), ["o_orderkey"], sample=200)


def value_kinds(spark, folder):
    pages = table(spark, folder, "pages").select(
        "url", "html", F.regexp_replace("url", "^http:/", "").alias("path"), F.concat(F.col("page_id").cast("string"), F.lit("@example.com")).alias("mail")
    )
    return profile.value_kind(pages)


def outlier_rates(spark, folder):
    prices = lines(spark, folder).withColumn("cubed", F.pow("l_extendedprice", F.lit(3))).withColumn("flat", F.lit(1.5))
    return quality.zscore_outlier_rate(prices, ["l_quantity", "l_extendedprice", "l_discount", "cubed", "flat"], 2.0).select(
        "column", *_r(8, "outlier_rate")
    )


def shapes(spark, folder):
    return quality.shape_stats(lines(spark, folder), LINE_NUMBERS).select("column", *_r(4, "std"), *_r(6, "skewness", "kurtosis"))


def date_anomalies(spark, folder):
    return quality.date_anomalies(lines(spark, folder), AS_OF, 1996, 30).select("column", *_r(6, "future_pct", "ancient_pct"))


def anomalies(spark, folder):
    return quality.anomaly_report(lines(spark, folder), AS_OF, 2.0, 1996, 30).select(
        "column", "missing_pct", "is_constant", "outlier_pct", *_r(4, "std"), *_r(6, "skewness", "kurtosis"),
        "future_pct", "ancient_pct", "severity",
    )


def _coded(spark, folder):
    """Customers with columns that look like contact and account data."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        "c_custkey", "c_mktsegment", "c_nationkey",
        F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.when(key % 3 == 0, "@example").otherwise("@example.org")).alias("mail"),
        F.concat_ws(".", F.lit("10"), (key % 256).cast("string"), (key % 7).cast("string"), F.lit("1")).alias("address"),
        F.format_string("+3906%07d", key).alias("phone"),
        F.when(key % 8 == 0, F.format_string("%09d", key)).otherwise(F.col("c_mktsegment")).alias("code"),
        F.concat(F.col("c_mktsegment"), F.lit("\n")).alias("broken"),
        F.expr("timestampadd(DAY, c_custkey, TIMESTAMP_NTZ'1970-01-01')").alias("since"),
    )


_CODED_SQL = r"""
coded AS (
  SELECT c_custkey, c_mktsegment, c_nationkey,
    lower(replace(c_name, '#', '.')) || CASE WHEN c_custkey % 3 = 0 THEN '@example' ELSE '@example.org' END AS mail,
    '10.' || (c_custkey % 256) || '.' || (c_custkey % 7) || '.1' AS address,
    '+3906' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS phone,
    CASE WHEN c_custkey % 8 = 0 THEN lpad(CAST(c_custkey AS VARCHAR), 9, '0') ELSE c_mktsegment END AS code,
    c_mktsegment || chr(10) AS broken,
    strftime(to_timestamp(c_custkey * 86400), '%Y-%m-%d') AS since
  FROM customer)"""
CODED_COLUMNS = ["c_custkey", "c_mktsegment", "c_nationkey", "mail", "address", "phone", "code", "broken", "since"]


def semantic_patterns(spark, folder):
    return quality.semantic_profile(_coded(spark, folder))


def semantic_patterns_of_texts(spark, folder):
    texts = table(spark, folder, "documents", spread=True).select("text", "lang", "source")
    return quality.semantic_profile(texts)


def semantic_patterns_sample(spark, folder):
    return quality.semantic_profile(_coded(spark, folder), sample_rows=200, key=["c_custkey"])


def pii_columns(spark, folder):
    return quality.pii_flag(quality.semantic_profile(_coded(spark, folder)))


def semantic_summary(spark, folder):
    return quality.semantic_report(_coded(spark, folder)).select(
        "column", "sql_type", "sensitive", F.size(F.map_keys("matches")).cast("bigint").alias("patterns")
    ).withColumn("patterns", F.when(F.col("patterns") > 0, F.col("patterns")).otherwise(0))


def sensitive_columns(spark, folder):
    """The column names of all tables, also as they would be written in full."""
    names = catalog_profile(load_folder(spark, folder, TABLES)).select("table_name", F.col("column_name").alias("column"))
    spelled = names.select("table_name", F.concat("table_name", F.lit("_"), F.regexp_replace("column", "^[a-z]_", "")).alias("column"))
    worded = names.select("table_name", F.concat(F.regexp_replace("column", "^[a-z]_", ""), F.lit(" Phone eMail address")).alias("column"))
    return privacy.sensitive_names(names.unionAll(spelled).unionAll(worded).distinct()).select(
        "table_name", "column", *_big("score"), "sensitive", F.array_join("reasons", ", ").alias("reasons")
    )


def entity_sensitivity(spark, folder):
    found = privacy.entities(table(spark, folder, "documents", spread=True).select("doc_id", "text"), "text")
    return privacy.entity_sensitivity(found).select("label", *_big("entities", "sensitive"), "examples")


def unique_keys(spark, folder):
    return dep.candidate_keys(table(spark, folder, "conversations").select("conv_id", "turn", "role"), 2).select(
        "key_columns", *_big("width")
    )


def part_keys(spark, folder):
    return dep.candidate_keys(table(spark, folder, "part"), 2).select("key_columns", *_big("width"))


def foreign_keys(spark, folder):
    a = table(spark, folder, "lineitem", spread=True).select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    b = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return dep.inclusion_dependencies(a, b).select("a_column", "b_column", *_big("distinct_values", "included"), *_r(6, "coverage_pct"))


def exact_inclusions(spark, folder):
    """Decimals of 20 places, doubles from 1e15 on against longs, dates against timestamps."""
    exact = lambda key, last: F.concat(F.col(key).cast("string"), F.lit(f".{'0' * 19}"), last).cast("decimal(38,20)")
    a = table(spark, folder, "lineitem", spread=True).select(
        exact("l_orderkey", F.col("l_linenumber").cast("string")).alias("l_exact"),
        (F.col("l_orderkey") * 1e12).alias("l_large"), F.to_date("l_shipdate").alias("l_day"),
    )
    b = table(spark, folder, "orders").select(
        exact("o_orderkey", F.lit("1")).alias("o_exact"),
        (F.col("o_orderkey") * 1_000_000_000_000).alias("o_large"), F.date_trunc("day", "o_orderdate").alias("o_day"),
    )
    return dep.inclusion_dependencies(a, b).select("a_column", "b_column", *_big("distinct_values", "included"), *_r(6, "coverage_pct"))


def functional_dependencies(spark, folder):
    joined = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", "c_mktsegment", "c_nationkey", "n_name", "n_regionkey", (F.col("c_custkey") % 200 == 0).alias("rare"))
    return dep.functional_dependencies(joined, tolerance=0.01).select("determinant", "dependent", *_r(8, "violation_rate"))


QUERIES = {
    f.__name__: f
    for f in (
        table_metrics, table_metrics_with_copies, column_categories, schema_insights, numeric_description, text_description,
        document_text_description, correlations, strongest_correlations, constant_columns, suggested_types, missing_counts,
        missing_columns, missing_flags, missing_flags_sample, value_kinds, outlier_rates, shapes, date_anomalies, anomalies,
        semantic_patterns, semantic_patterns_of_texts, semantic_patterns_sample, pii_columns, semantic_summary,
        sensitive_columns, entity_sensitivity, unique_keys, part_keys, foreign_keys, exact_inclusions, functional_dependencies,
    )
}


def _union(parts) -> str:
    return "\nUNION ALL ".join(parts)


def _category_sql(name: str, kind: str) -> str:
    if kind == "boolean":
        return "CASE WHEN count(*) >= 0 THEN 'boolean' END"
    if kind == "number":
        return f"CASE WHEN count(DISTINCT {name}) <= 20 THEN 'categorical' ELSE 'numeric' END"
    number = f"CASE WHEN regexp_matches({name}, '{fixed.NUMBER_PATTERN}') THEN CAST({name} AS DOUBLE) END"
    return (f"CASE WHEN count({number}) >= 0.6 * count(*) AND count(DISTINCT {number}) <= 20 THEN 'categorical' "
            f"WHEN count({number}) >= 0.6 * count(*) THEN 'numeric' "
            f"WHEN count(DISTINCT {name}) <= 20 THEN 'categorical' ELSE 'text' END")


def _insight_sql(name: str, kind: str) -> str:
    example = f"(SELECT CAST({name} AS VARCHAR) FROM clients WHERE {name} IS NOT NULL ORDER BY c_custkey LIMIT 1)"
    shown = f"CASE WHEN length({example}) > 80 THEN left({example}, 77) || '…' ELSE {example} END"
    return f"""SELECT '{name}' AS column, {_category_sql(name, kind)} AS category,
  {rounded(f'count(DISTINCT {name}) / count({name}) * 100.0', 6)} AS unique_pct,
  {rounded(f'(count(*) - count({name})) / count(*) * 100.0', 6)} AS missing_pct,
  false AS sensitive, '' AS reasons, {shown} AS example FROM clients"""


def _bias_corrected(name: str) -> str:
    return f"""{rounded(f'stddev_samp({name})', 4)} AS std, {rounded(f'skewness({name})', 6)} AS skewness,
  {rounded(f'kurtosis({name})', 6)} AS kurtosis"""


def _corr_sql() -> str:
    pairs = [(a, b) for i, a in enumerate(LINE_NUMBERS) for b in LINE_NUMBERS[i + 1:]]
    return _union(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM lines" for a, b in pairs)


def _anomaly_sql(name: str) -> str:
    blank = f"{name} IS NULL" + (f" OR {name} = ''" if name in ("l_returnflag", "l_note") else "")
    missing = f"avg(CASE WHEN {blank} THEN 1.0 ELSE 0.0 END)"
    constant = f"count(DISTINCT {name}) = 1"
    out = std = skew = kurt = future = ancient = "CAST(NULL AS DOUBLE)"
    if name in LINE_NUMBERS:
        mean, spread = f"(SELECT avg({name}) FROM lines)", f"(SELECT stddev_pop({name}) FROM lines)"
        out = f"avg(CASE WHEN abs(({name} - {mean}) / {spread}) > 2.0 THEN 1.0 ELSE 0.0 END)"
        std, skew, kurt = f"stddev_samp({name})", f"skewness({name})", f"kurtosis({name})"
    if name == "l_shipdate":
        future = f"avg(CASE WHEN {name} > TIMESTAMP '1999-07-01 00:00:00' THEN 1.0 ELSE 0.0 END)"
        ancient = f"avg(CASE WHEN {name} < TIMESTAMP '1996-01-01 00:00:00' THEN 1.0 ELSE 0.0 END)"
    return f"""SELECT '{name}' AS column, {missing} AS missing, {constant} AS is_constant, {out} AS o, {std} AS std,
  {skew} AS skewness, {kurt} AS kurtosis, {future} AS f, {ancient} AS p FROM lines"""


def _semantic_sql(columns: list[str], source: str, prefix: str = "") -> str:
    cells = _union(f"SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS v FROM {source}" for c in columns)
    shares = ", ".join(
        f"avg(CASE WHEN regexp_full_match(v, '{p}') THEN 1.0 ELSE 0.0 END) AS \"{label}\"" for label, p in fixed.SEMANTIC_PATTERNS.items()
    )
    labels = ", ".join(f'"{label}"' for label in fixed.SEMANTIC_PATTERNS)
    return f"""cells AS ({cells}),
shares AS (SELECT "column", {shares} FROM cells WHERE v IS NOT NULL GROUP BY "column"),
found AS (SELECT "column", pattern, {rounded('share * 100', 2)} AS match_pct
  FROM (UNPIVOT shares ON {labels} INTO NAME pattern VALUE share) WHERE {rounded('share * 100', 2)} > 0)"""


_NAMES_SQL = """
listed AS (SELECT table_name, column_name AS c, regexp_replace(column_name, '^[a-z]_', '') AS bare
  FROM information_schema.columns WHERE table_name IN ({tables})),
names AS (SELECT DISTINCT * FROM (
  SELECT table_name, c AS n FROM listed UNION ALL SELECT table_name, table_name || '_' || bare FROM listed
  UNION ALL SELECT table_name, bare || ' Phone eMail address' FROM listed)),
ready AS (SELECT *, replace(trim(n), '_', ' ') AS spaced, regexp_replace(n, '[^A-Za-z0-9]', '', 'g') AS joined FROM names)
""".format(tables=", ".join(f"'{t}'" for t in TABLES))


def _name_points(spaced: str, joined: str) -> tuple[str, str]:
    rules = [(f"regexp_matches({spaced}, '(?i){p}')", f"matched keyword in {c}") for c, p in fixed.SENSITIVE_KEYWORDS]
    rules += [(f"regexp_matches({joined}, '(?i){p}')", "matched keyword in contact (camelCase)") for p in fixed.SENSITIVE_SPELLINGS]
    points = " + ".join(f"CASE WHEN {hit} THEN 2 ELSE 0 END" for hit, _ in rules)
    reasons = ", ".join(f"CASE WHEN {hit} THEN '{why}' END" for hit, why in rules)
    listed = f"array_to_string(list_sort(list_distinct(list_filter([{reasons}], lambda x: x IS NOT NULL))), ', ')"
    return points, listed


_POINTS, _REASONS = _name_points("spaced", "joined")


def _entity_sql() -> str:
    labels = _union(
        f"SELECT '{label}' AS label, e FROM words WHERE regexp_full_match(e, '{fixed.SEMANTIC_PATTERNS[label]}')"
        for label in privacy.ENTITY_LABELS
    )
    points, _ = _name_points("replace(e, '_', ' ')", "regexp_replace(e, '[^A-Za-z0-9]', '', 'g')")
    return f"""WITH split AS (
  SELECT unnest(regexp_split_to_array(text, '[^A-Za-z0-9@._%+:-]+')) AS w FROM documents),
words AS (SELECT regexp_replace(w, '\\A[.:]+|[.:]+\\z', '', 'g') AS e FROM split WHERE length(w) > 0),
marked AS ({labels}),
judged AS (SELECT label, e, ({points}) >= 2 AS hit FROM marked),
firsts AS (SELECT label, e, row_number() OVER (PARTITION BY label ORDER BY e) AS r FROM (SELECT DISTINCT label, e FROM judged WHERE hit))
SELECT j.label, count(*) AS entities, count(*) FILTER (hit) AS sensitive,
  coalesce((SELECT string_agg(e, ', ' ORDER BY e) FROM firsts f WHERE f.label = j.label AND r <= 2), '') AS examples
FROM judged j GROUP BY j.label"""


_KIND_SQL = """pages_ AS (SELECT url, html, regexp_replace(url, '^http:/', '') AS path, page_id || '@example.com' AS mail FROM pages)"""
_FD_COLUMNS = ["c_custkey", "c_mktsegment", "c_nationkey", "n_name", "n_regionkey", "rare"]


def _fd_sql() -> str:
    rates = _union(
        f"""SELECT '{x}' AS determinant, '{y}' AS dependent, 1 - sum(kept) / sum(total) AS v FROM (
  SELECT {x}, max(n) AS kept, sum(n) AS total FROM (SELECT {x}, {y}, count(*) AS n FROM j GROUP BY ALL) GROUP BY {x})"""
        for x in _FD_COLUMNS for y in _FD_COLUMNS if x != y
    )
    return f"""WITH j AS (SELECT c_custkey, c_mktsegment, c_nationkey, n_name, n_regionkey, c_custkey % 200 = 0 AS rare
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
rates AS ({rates})
SELECT determinant, dependent, {rounded('v', 8)} AS violation_rate FROM rates WHERE v <= 0.01"""


def _inclusion_sql() -> str:
    a = {"l_orderkey": "lineitem", "l_partkey": "lineitem", "l_suppkey": "lineitem", "l_quantity": "lineitem"}
    b = {"o_orderkey": "orders", "o_custkey": "orders"}
    pairs = [(x, y) for x in a for y in b] + [("l_returnflag", "o_orderstatus")]
    return "SELECT * FROM (" + _union(
        f"""SELECT '{x}' AS a_column, '{y}' AS b_column, (SELECT count(DISTINCT {x}) FROM lineitem) AS distinct_values, count(*) AS included,
  {rounded(f'count(*) / (SELECT count(DISTINCT {x}) FROM lineitem) * 100', 6)} AS coverage_pct
  FROM (SELECT DISTINCT {x} AS v FROM lineitem) WHERE v IN (SELECT {y} FROM orders)"""
        for x, y in pairs
    ) + ") WHERE included > 0"


def _key_sql(source: str, columns: list[str]) -> str:
    single = {c: f"(SELECT count(DISTINCT {c}) = count(*) FROM {source})" for c in columns}
    rows = [f"SELECT '{c}' AS key_columns, 1 AS width WHERE {single[c]}" for c in columns]
    for i, a in enumerate(columns):
        for b in columns[i + 1:]:
            unique = f"(SELECT max(n) = 1 FROM (SELECT count(*) AS n FROM {source} GROUP BY {a}, {b}))"
            rows.append(f"SELECT '{a}, {b}', 2 WHERE {unique} AND NOT {single[a]} AND NOT {single[b]}")
    return "SELECT key_columns, CAST(width AS BIGINT) AS width FROM (" + _union(rows) + ")"


_TYPES = {"c_custkey": "INT", "c_nationkey": "INT", "c_acctbal": "DECIMAL(18,6)", "in_credit": "BOOLEAN", "opened": "TIMESTAMP"}
_WIDTH = {"l_linenumber": "4", "l_returnflag": "coalesce(strlen(l_returnflag), 0)", "l_note": "strlen(l_note)"}

ORACLES = {
    "table_metrics": f"""WITH {LINES_SQL},
m AS (SELECT count(*) AS n, {' + '.join(f'count(*) - count({c})' for c in LINE_COLUMNS)} AS missing,
  sum({' + '.join(_WIDTH.get(c, '8') for c in LINE_COLUMNS)}) / 1048576.0 AS mb FROM lines)
SELECT n AS rows, 9::BIGINT AS cols, missing AS missing_cells, {rounded('missing / (n * 9) * 100.0', 6)} AS missing_pct,
  n - (SELECT count(*) FROM (SELECT DISTINCT * FROM (SELECT * REPLACE (CASE WHEN l_orderkey % 17 = 0 AND l_orderkey % 2 = 0 THEN 'NaN'::DOUBLE ELSE l_tax END AS l_tax) FROM lines))) AS duplicate_rows,
  {rounded('mb', 6)} AS size_mb FROM m""",
    "table_metrics_with_copies": f"""WITH {LINES_SQL},
few AS (SELECT l_linenumber, l_quantity, l_returnflag,
  CASE WHEN l_orderkey % 17 = 0 AND l_orderkey % 2 = 0 THEN 'NaN'::DOUBLE ELSE l_tax END AS l_tax FROM lines),
m AS (SELECT count(*) AS n, count(*) FILTER (l_quantity IS NULL) + count(*) FILTER (l_returnflag IS NULL)
  + count(*) FILTER (l_tax IS NULL OR isnan(l_tax)) AS missing FROM few)
SELECT n AS rows, 4::BIGINT AS cols, missing AS missing_cells, {rounded('missing / (n * 4) * 100.0', 6)} AS missing_pct,
  n - (SELECT count(*) FROM (SELECT DISTINCT * FROM few)) AS duplicate_rows FROM m""",
    "column_categories": f"WITH {CLIENTS_SQL} " + _union(
        f"SELECT '{c}' AS column, {_category_sql(c, k)} AS category FROM clients" for c, k in CLIENT_KINDS.items()),
    "schema_insights": f"WITH {CLIENTS_SQL} " + _union(_insight_sql(c, k) for c, k in CLIENT_KINDS.items()),
    "numeric_description": f"WITH {LINES_SQL} " + _union(
        f"""SELECT '{c}' AS column, count({c}) AS count, {rounded(f'avg({c})', 4)} AS mean, {rounded(f'stddev_samp({c})', 4)} AS std,
  {rounded(f'min({c})', 4)} AS min, {', '.join(rounded(f'quantile_cont({c}, {q})', 4) + f' AS q{int(q * 100)}' for q in (0.25, 0.5, 0.75))},
  {rounded(f'max({c})', 4)} AS max FROM lines""" for c in LINE_NUMBERS),
    "text_description": f"WITH {CLIENTS_SQL} " + _union(
        f"""SELECT '{c}' AS column, count({c}) AS count, count(DISTINCT {c}) AS unique,
  (SELECT {c} FROM clients WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top,
  (SELECT count(*) FROM clients WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) AS freq,
  {rounded(f'avg(length({c}))', 6)} AS avg_len FROM clients""" for c, k in CLIENT_KINDS.items() if k == "text"),
    "document_text_description": _union(
        f"""SELECT '{c}' AS column, count({c}) AS count, count(DISTINCT {c}) AS unique,
  (SELECT md5({c}) FROM documents GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top,
  (SELECT count(*) FROM documents GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) AS freq,
  {rounded(f'avg(length({c}))', 4)} AS avg_len FROM documents""" for c in ("text", "lang", "source")),
    "correlations": f"WITH {LINES_SQL}, pairs AS ({_corr_sql()}) SELECT a, b, CASE WHEN NOT isnan(corr) THEN {rounded('corr', 6)} END AS corr FROM pairs",
    "strongest_correlations": f"""WITH {LINES_SQL}, pairs AS ({_corr_sql()}),
both_ways AS (SELECT a, b, corr FROM pairs WHERE NOT isnan(corr) UNION ALL SELECT b, a, corr FROM pairs WHERE NOT isnan(corr))
SELECT a, b, {rounded('corr', 6)} AS corr, {rounded('abs(corr)', 6)} AS abs_corr FROM both_ways ORDER BY abs(corr) DESC, a, b LIMIT 10""",
    "constant_columns": f"WITH {LINES_SQL} " + _union(f"SELECT '{c}' AS column, count(DISTINCT {c}) = 1 AS is_constant FROM lines" for c in LINE_COLUMNS),
    "suggested_types": f"WITH {CLIENTS_SQL} " + _union([
        *[f"SELECT '{c}' AS column, '{_TYPES[c]}' AS sql_type" if c in _TYPES else
          f"SELECT '{c}', CASE WHEN max(length({c})) <= 50 THEN 'VARCHAR(50)' WHEN max(length({c})) <= 255 THEN 'VARCHAR(255)' ELSE 'TEXT' END FROM clients"
          for c in CLIENT_KINDS],
        "SELECT 'big', CASE WHEN max(c_custkey * 100000000) > 2147483647 THEN 'BIGINT' ELSE 'INT' END FROM clients",
        "SELECT 'opened', 'TIMESTAMP'"]),
    "missing_counts": f"WITH {LINES_SQL} " + _union(f"SELECT '{c}' AS column, count(*) - count({c}) AS missing FROM lines" for c in LINE_COLUMNS),
    "missing_columns": f"WITH {LINES_SQL}, m AS (" + _union(
        f"SELECT '{c}' AS column, '{'numeric' if c in LINE_NUMBERS else 'text'}' AS kind, count(*) - count({c}) AS missing FROM lines" for c in LINE_COLUMNS
    ) + ") SELECT * FROM m WHERE missing > 0",
    "missing_flags": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS o_orderstatus,
  CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS o_totalprice, 0 AS o_orderdate FROM orders""",
    "value_kinds": f"WITH {_KIND_SQL} " + _union(
        f"SELECT '{c}' AS column, " + ", ".join(f"bool_or(regexp_matches({c}, '{p}')) AS is_{k}" for k, p in fixed.VALUE_KIND_PATTERNS.items()) + " FROM pages_"
        for c in ("url", "html", "path", "mail")),
    "outlier_rates": f"WITH {LINES_SQL}, cubes AS (SELECT *, l_extendedprice ** 3 AS cubed FROM lines) " + _union([
        *[f"""SELECT '{c}' AS column, {rounded(f"avg(CASE WHEN abs(({c} - (SELECT avg({c}) FROM cubes)) / (SELECT stddev_pop({c}) FROM cubes)) > 2.0 THEN 1.0 ELSE 0.0 END)", 8)} AS outlier_rate FROM cubes"""
          for c in ("l_quantity", "l_extendedprice", "l_discount", "cubed")],
        "SELECT 'flat', 0.0::DOUBLE"]),
    "shapes": f"WITH {LINES_SQL} " + _union(f"SELECT '{c}' AS column, {_bias_corrected(c)} FROM lines" for c in LINE_NUMBERS),
    "date_anomalies": f"""WITH {LINES_SQL} SELECT 'l_shipdate' AS column,
  {rounded("avg(CASE WHEN l_shipdate > TIMESTAMP '1999-07-01' THEN 1.0 ELSE 0.0 END) * 100", 6)} AS future_pct,
  {rounded("avg(CASE WHEN l_shipdate < TIMESTAMP '1996-01-01' THEN 1.0 ELSE 0.0 END) * 100", 6)} AS ancient_pct FROM lines""",
    "anomalies": f"WITH {LINES_SQL}, facts AS (" + _union(_anomaly_sql(c) for c in LINE_COLUMNS) + f""")
SELECT "column", {rounded('missing * 100', 2)} AS missing_pct, is_constant, {rounded('o * 100', 2)} AS outlier_pct, {rounded('std', 4)} AS std,
  {rounded('skewness', 6)} AS skewness, {rounded('kurtosis', 6)} AS kurtosis, {rounded('f * 100', 2)} AS future_pct,
  {rounded('p * 100', 2)} AS ancient_pct,
  {rounded_as_printed('missing * 0.35::DOUBLE + coalesce(o, 0) * 0.35::DOUBLE + coalesce(abs(skewness) / 10, 0) * 0.15::DOUBLE + coalesce(abs(kurtosis) / 10, 0) * 0.15::DOUBLE', 4)} AS severity
FROM facts""",
    "semantic_patterns": f"WITH {_CODED_SQL}, {_semantic_sql(CODED_COLUMNS, 'coded')} SELECT * FROM found",
    "semantic_patterns_of_texts": f"WITH {_semantic_sql(['text', 'lang', 'source'], 'documents')} SELECT * FROM found",
    "semantic_patterns_sample": f"WITH {_CODED_SQL}, head AS (SELECT * FROM coded ORDER BY c_custkey LIMIT 200), {_semantic_sql(CODED_COLUMNS, 'head')} SELECT * FROM found",
    "pii_columns": f"WITH {_CODED_SQL}, {_semantic_sql(CODED_COLUMNS, 'coded')} SELECT \"column\", max(match_pct) > 10 AS sensitive FROM found GROUP BY \"column\"",
    "semantic_summary": f"""WITH {_CODED_SQL}, {_semantic_sql(CODED_COLUMNS, 'coded')},
flags AS (SELECT "column", max(match_pct) > 10 AS sensitive, count(*) AS patterns FROM found GROUP BY "column")
SELECT t."column", t.sql_type, coalesce(f.sensitive, false) AS sensitive, coalesce(f.patterns, 0) AS patterns FROM (VALUES
  ('c_custkey', 'INT'), ('c_mktsegment', 'VARCHAR(50)'), ('c_nationkey', 'INT'), ('mail', 'VARCHAR(50)'), ('address', 'VARCHAR(50)'),
  ('phone', 'VARCHAR(50)'), ('code', 'VARCHAR(50)'), ('broken', 'VARCHAR(50)'), ('since', 'TIMESTAMP')) AS t("column", sql_type)
LEFT JOIN flags f ON t."column" = f."column" """,
    "sensitive_columns": f"""WITH {_NAMES_SQL}
SELECT table_name, n AS column, CAST({_POINTS} AS BIGINT) AS score, ({_POINTS}) >= 2 AS sensitive, {_REASONS} AS reasons FROM ready""",
    "entity_sensitivity": _entity_sql(),
    "unique_keys": _key_sql("conversations", ["conv_id", "turn", "role"]),
    "part_keys": _key_sql("part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
    "foreign_keys": _inclusion_sql(),
    "exact_inclusions": """WITH exact AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem),
large AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem),
found AS (
  SELECT 'l_exact' AS a_column, 'o_exact' AS b_column, count(*) AS distinct_values, count(*) FILTER (WHERE n = 1 AND k IN (SELECT o_orderkey FROM orders)) AS included FROM exact
  UNION ALL SELECT 'l_large', 'o_large', count(*), count(*) FILTER (WHERE k IN (SELECT o_orderkey FROM orders)) FROM large
  UNION ALL SELECT 'l_large', 'o_exact', count(*), 0 FROM large
  UNION ALL SELECT 'l_day', 'o_day', count(*), count(*) FILTER (WHERE d IN (SELECT CAST(o_orderdate AS DATE) FROM orders)) FROM days)
SELECT a_column, b_column, distinct_values, included, round(included / distinct_values * 100.0, 6) AS coverage_pct FROM found WHERE included > 0""",
    "functional_dependencies": _fd_sql(),
}

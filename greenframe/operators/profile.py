"""Table and column profiles.

Statistics that need one pass are one wide aggregate. Distinct values of many
columns are counted in one go by turning the columns into (column, value) rows,
which Spark adds up before the shuffle, so that a value shared by most rows
costs one row per task.
"""

from __future__ import annotations

from itertools import combinations
from math import isnan

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from greenframe.functions import fixed_values as fixed
from greenframe.operators.moments import pair_moments
from greenframe.operators.privacy import name_reasons, name_score
from greenframe.operators.quantiles import column_quantiles

FRACTIONAL = (T.FloatType, T.DoubleType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)
SHORT_TEXT = 64


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, TEMPORAL):
        return "datetime"
    if isinstance(data_type, (*FRACTIONAL, *INTEGRAL, T.DecimalType)):
        return "numeric"
    return "text" if isinstance(data_type, T.StringType) else "other"


def columns_of(df: DataFrame, *kinds: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind(f.dataType) in kinds]


def present(df: DataFrame, name: str) -> Column:
    """The value, or null where it is missing (NaN counts as missing)."""
    if isinstance(df.schema[name].dataType, FRACTIONAL):
        return F.when(~F.isnan(quoted(name)), quoted(name))
    return quoted(name)


def long_rows(per_column: list[list[Column]], df: DataFrame) -> DataFrame:
    """One row per input row and entry of ``per_column``; entries are equally named structs."""
    return df.select(F.inline(F.array(*[F.struct(*entry) for entry in per_column])))


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, number, n): copies of every distinct value that is not missing.

    Long texts are represented by a digest that no short text can equal;
    ``number`` is the numeric reading of a text that has one.
    """
    entries = []
    for name in columns or df.columns:
        value = present(df, name)
        number = F.lit(None).cast("double")
        if isinstance(df.schema[name].dataType, T.StringType):
            number = F.when(value.rlike(fixed.NUMBER_PATTERN), F.trim(F.regexp_replace(value, r"\s", "")).try_cast("double"))
            text = F.when(F.length(value) <= SHORT_TEXT, value).otherwise(F.concat(F.lit("#"), F.sha2(value, 256)))
        elif isinstance(df.schema[name].dataType, FRACTIONAL):
            text = (value + F.lit(0.0)).cast("string")  # -0.0 and 0.0 are one value
        elif kind(df.schema[name].dataType) == "other":
            text = F.when(value.isNotNull(), F.sha2(F.to_json(F.struct(value)), 256))
        else:
            text = value.cast("string")
        entries.append([F.lit(name).alias("column"), text.alias("value"), number.alias("number")])
    long = long_rows(entries, df).filter(F.col("value").isNotNull())
    return long.groupBy("column", "value", "number").agg(F.count(F.lit(1)).alias("n"))


def missing_by_column(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, missing)."""
    names = columns or df.columns
    counts = df.agg(*[F.count_if(present(df, c).isNull()).alias(c) for c in names])
    return counts.unpivot([], [quoted(c) for c in names], "column", "missing")


def columns_with_missing(df: DataFrame) -> DataFrame:
    """(column, kind, missing) of the columns that have missing values; kind is numeric or text."""
    kinds = F.lit("text")
    for name in columns_of(df, "numeric"):
        kinds = F.when(F.col("column") == name, "numeric").otherwise(kinds)
    return missing_by_column(df).filter("missing > 0").select("column", kinds.alias("kind"), "missing")


def _width(df: DataFrame, name: str) -> Column:
    data_type = df.schema[name].dataType
    if isinstance(data_type, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(quoted(name)).cast("long"), F.lit(0))
    sizes = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}
    if isinstance(data_type, T.ArrayType):
        return F.greatest(F.size(quoted(name)), F.lit(0)).cast("long") * sizes.get(type(data_type.elementType), 8)
    return F.lit(sizes.get(type(data_type), 8)).cast("long")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(duplicate_rows): rows equal to an earlier one, nulls being equal.

    Whole rows are compared only where a 64 bit hash occurs more than once, so
    a table without duplicates shuffles hashes instead of rows.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*[quoted(c) for c in df.columns]))
    repeated = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_hash")
    suspects = hashed.join(repeated, "_hash", "left_semi").drop("_hash")
    copies = suspects.groupBy(*[quoted(c) for c in df.columns]).agg((F.count(F.lit(1)) - 1).alias("_extra"))
    return copies.agg(F.coalesce(F.sum("_extra"), F.lit(0)).alias("duplicate_rows"))


def table_metrics(df: DataFrame) -> DataFrame:
    """One row: rows, cols, missing cells and their share, duplicate rows, size in MB."""
    cols = len(df.columns)
    totals = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(present(df, c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)],
        *[F.coalesce(F.sum(_width(df, c)), F.lit(0)).alias(f"b{i}") for i, c in enumerate(df.columns)],
    ).first()
    rows = totals["rows"]
    missing = sum(totals[f"m{i}"] for i in range(cols))
    size = sum(totals[f"b{i}"] for i in range(cols)) / 1024**2
    share = missing / (rows * max(1, cols)) * 100.0 if rows and cols else 0.0
    return duplicate_rows(df).select(
        F.lit(rows).cast("long").alias("rows"), F.lit(cols).cast("long").alias("cols"),
        F.lit(missing).cast("long").alias("missing_cells"), F.lit(float(share)).alias("missing_pct"),
        "duplicate_rows", F.lit(float(size)).alias("size_mb"),
    )


def column_category(df: DataFrame) -> DataFrame:
    """(column, category): boolean, datetime, numeric, categorical, text or other.

    Only "more than 20 distinct values or not" matters. A distinct-count sketch
    with 512 registers counts linearly while most of them are empty: 20 values
    never read as more than 21. Columns the sketch puts above that are settled;
    exact counts are needed for the few-valued rest only, where they are cheap.
    """
    limit = fixed.CATEGORICAL_LIMIT
    texts, numbers = columns_of(df, "text"), columns_of(df, "numeric")
    parsed = {c: F.when(quoted(c).rlike(fixed.NUMBER_PATTERN), F.regexp_replace(quoted(c), r"\s", "").try_cast("double")) for c in texts}
    first = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.approx_count_distinct(present(df, c), 0.05).alias(f"d_{c}") for c in [*texts, *numbers]],
        *[F.approx_count_distinct(parsed[c], 0.05).alias(f"p_{c}") for c in texts],
        *[F.count(parsed[c]).alias(f"n_{c}") for c in texts],
    ).first()
    rows = first["rows"]
    numeric_text = {c for c in texts if rows and first[f"n_{c}"] / rows >= fixed.NUMERIC_TEXT_SHARE}
    close = {
        c: (parsed[c] if c in numeric_text else present(df, c))
        for c in [*texts, *numbers]
        if first[f"p_{c}" if c in numeric_text else f"d_{c}"] <= limit + 1
    }
    few = set()
    if close:
        exact = df.agg(*[F.count_distinct(v).alias(f"e{i}") for i, v in enumerate(close.values())]).first()
        few = {c for i, c in enumerate(close) if exact[f"e{i}"] <= limit}
    named = []
    for field in df.schema.fields:
        category = kind(field.dataType)
        if category in ("text", "numeric"):
            many = "numeric" if category == "numeric" or field.name in numeric_text else "text"
            category = "categorical" if field.name in few else many
        named.append((field.name, category))
    return df.sparkSession.createDataFrame(named, "column string, category string")


def _examples(df: DataFrame, key: list[str], names: list[str], head: int = 100) -> dict[str, str]:
    """The first value by ``key`` of each column, cut to what a report shows.

    The first rows have one for most columns; the others are searched in one scan.
    """
    order = [quoted(k) for k in key]
    texts = {c: F.left(quoted(c).cast("string"), F.lit(81)) for c in names}
    first = df.orderBy(*order).limit(head).select(
        *[F.when(present(df, c).isNotNull(), texts[c]).alias(f"t{i}") for i, c in enumerate(names)]).collect()
    found = {c: next((row[i] for row in first if row[i] is not None), None) for i, c in enumerate(names)}
    rare = [c for c in names if found[c] is None]
    if rare:
        rest = df.agg(*[
            F.min_by(texts[c], F.when(present(df, c).isNotNull(), F.struct(*order))).alias(f"t{i}") for i, c in enumerate(rare)
        ]).first()
        found.update({c: rest[i] for i, c in enumerate(rare)})
    return found


def schema_insights(df: DataFrame, key: list[str], exact: bool = True) -> DataFrame:
    """Per column: category, unique %, missing %, sensitivity of its name, first example by ``key``.

    ``exact=False`` estimates the distinct counts behind unique % in one pass
    without a shuffle of values.
    """
    names = df.columns
    shape = [F.count(F.lit(1)).alias("rows"), *[F.count(present(df, c)).alias(f"filled_{c}") for c in names]]
    if not exact:
        shape += [F.approx_count_distinct(present(df, c), 0.02).alias(f"values_{c}") for c in names]
    counts = df.agg(*shape).first()
    examples = _examples(df, key, [c for c in names if counts[f"filled_{c}"]])
    known = [
        (c, counts["rows"], counts[f"filled_{c}"], None if exact else min(counts[f"values_{c}"], counts[f"filled_{c}"]), examples.get(c))
        for c in names
    ]
    base = df.sparkSession.createDataFrame(known, "column string, rows long, filled long, estimate long, sample string")
    joined = base.join(column_category(df), "column")
    if exact:
        counted = value_counts(df).groupBy("column").agg(F.count(F.lit(1)).alias("values"))
        joined = joined.join(counted, "column", "left")
    else:
        joined = joined.withColumnRenamed("estimate", "values")
    unique = F.when(F.col("filled") > 0, F.coalesce("values", F.lit(0)) / F.col("filled") * 100.0).otherwise(0.0)
    long_sample = F.concat(F.left("sample", F.lit(77)), F.lit("…"))
    return joined.select(
        "column", "category", unique.alias("unique_pct"),
        F.when(F.col("rows") > 0, (1 - F.col("filled") / F.col("rows")) * 100.0).otherwise(0.0).alias("missing_pct"),
        (name_score("column") >= fixed.SENSITIVE_THRESHOLD).alias("sensitive"),
        F.array_join(name_reasons("column"), ", ").alias("reasons"),
        F.when(F.length("sample") > 80, long_sample).otherwise(F.col("sample")).alias("example"),
    ).orderBy("column")


def describe_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per numeric column: count, mean, std, min, quartiles (interpolated, exact), max."""
    names = columns or columns_of(df, "numeric")
    quartiles = [0.25, 0.5, 0.75]
    stats = df.agg(*[
        F.struct(
            F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"), F.max(v).alias("max"),
        ).alias(c)
        for c in names
        for v in [present(df, c).cast("double")]
    ])
    base = stats.unpivot([], [quoted(c) for c in names], "column", "s").select("column", "s.*")
    quantiles = column_quantiles(df.select(*[present(df, c).cast("double").alias(c) for c in names]), quartiles)
    named = quantiles.withColumnsRenamed({"q0": "q25", "q1": "q50", "q2": "q75"})
    return base.join(named, "column", "left")


def describe_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per text column: count, unique, most frequent value (the smallest on ties), its count, mean length.

    Long texts are counted by their beginning and a digest, so that no whole
    text is shuffled. Only the winner's text has to be looked up again.
    """
    names = columns or columns_of(df, "text")

    def entry(name: str) -> list[Column]:
        value = quoted(name)
        digest = F.when(F.length(value) > SHORT_TEXT, F.sha2(value, 256))
        return [F.lit(name).alias("column"), F.left(value, F.lit(SHORT_TEXT)).alias("start"), digest.alias("digest"),
                F.length(value).alias("chars")]

    long = long_rows([entry(c) for c in names], df).filter(F.col("start").isNotNull())
    counted = long.groupBy("column", "start", "digest", "chars").agg(F.count(F.lit(1)).alias("n"))
    # texts order as their beginnings do, a text that ends there first
    top = F.min(F.struct((-F.col("n")).alias("minus"), "start", F.col("digest").isNotNull().alias("cut")))
    stats = counted.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), top.alias("t"),
        (F.sum(F.col("n") * F.col("chars")) / F.sum("n")).alias("avg_len"),
    ).collect()

    def winner(name: str, start: str, freq: int) -> str:
        same = df.select(quoted(name).alias("v")).filter(F.left("v", F.lit(SHORT_TEXT)) == F.lit(start))
        long_ones = same.filter(F.length("v") > SHORT_TEXT).groupBy(F.sha2("v", 256)).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
        return long_ones.filter(F.col("n") == freq).agg(F.min("v")).first()[0]

    found = [
        (r["column"], r["count"], r["unique"],
         winner(r["column"], r["t"]["start"], -r["t"]["minus"]) if r["t"]["cut"] else r["t"]["start"], -r["t"]["minus"], r["avg_len"])
        for r in stats
    ]
    return df.sparkSession.createDataFrame(found, "column string, count long, unique long, top string, freq long, avg_len double")


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(a, b, corr) for every pair of numeric columns, a before b in the table; null without variance.

    Rows where both values are present count.
    """
    names = columns or columns_of(df, "numeric")
    pairs = list(combinations(range(len(names)), 2))
    found = []
    if pairs:
        values = df.select(*[present(df, c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
        corr = pair_moments(values).correlation()
        found = [(names[i], names[j], None if isnan(corr[i, j]) else float(corr[i, j])) for i, j in pairs]
    return df.sparkSession.createDataFrame(found, "a string, b string, corr double")


def top_correlations(df: DataFrame, k: int = 50, columns: list[str] | None = None) -> DataFrame:
    """The ``k`` strongest pairs by absolute value, each in both directions."""
    pairs = correlation_matrix(df, columns).filter(F.col("corr").isNotNull())
    both = pairs.unionAll(pairs.select("b", "a", "corr")).withColumn("abs_corr", F.abs("corr"))
    return both.orderBy(F.desc("abs_corr"), "a", "b").limit(k)


def constant_columns(df: DataFrame) -> DataFrame:
    """(column, is_constant): exactly one distinct value, missing ones aside."""
    names = [f.name for f in df.schema.fields if kind(f.dataType) != "other"]
    wide = df.agg(*[
        F.coalesce(F.min(present(df, c)) == F.max(present(df, c)), F.lit(False)).alias(c) for c in names
    ])
    return wide.unpivot([], [quoted(c) for c in names], "column", "is_constant")


def suggest_sql_type(df: DataFrame) -> DataFrame:
    """(column, sql_type): the narrowest SQL type the values fit into."""
    int_max = 2**31 - 1
    wide = df.agg(*[
        (F.max(quoted(f.name)) if isinstance(f.dataType, INTEGRAL) else F.max(F.length(quoted(f.name)))
         if isinstance(f.dataType, T.StringType) else F.lit(0)).cast("long").alias(f.name)
        for f in df.schema.fields
    ])

    def named(field: T.StructField) -> Column:
        size = quoted(field.name)
        if isinstance(field.dataType, INTEGRAL):
            return F.when(size > int_max, "BIGINT").otherwise("INT")
        if isinstance(field.dataType, (*FRACTIONAL, T.DecimalType)):
            return F.lit("DECIMAL(18,6)")
        if isinstance(field.dataType, T.BooleanType):
            return F.lit("BOOLEAN")
        if isinstance(field.dataType, TEMPORAL):
            return F.lit("TIMESTAMP")
        if isinstance(field.dataType, T.StringType):
            # a column without values has nothing to measure and takes the shortest text type
            fit = F.coalesce(size, F.lit(0))
            return F.when(fit <= 50, "VARCHAR(50)").when(fit <= 255, "VARCHAR(255)").otherwise("TEXT")
        return F.lit("TEXT")

    return wide.select(*[named(f).alias(f.name) for f in df.schema.fields]).unpivot(
        [], [quoted(c) for c in df.columns], "column", "sql_type"
    )


def missing_matrix(df: DataFrame, key: list[str], sample: int | None = None, seed: int = 42) -> DataFrame:
    """``key`` and a 0/1 flag per column; with ``sample``, that many rows picked by a hash of ``key``."""
    names = [c for c in df.columns if c not in key]
    flags = df.select(*[quoted(k) for k in key], *[present(df, c).isNull().cast("int").alias(c) for c in names])
    if sample is None:
        return flags
    return flags.orderBy(F.xxhash64(*[quoted(k) for k in key], F.lit(seed)), *key).limit(sample)


def value_kind(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, is_url, is_path, is_email): does any value look like one?"""
    names = columns or columns_of(df, "text")
    wide = df.agg(*[
        F.struct(*[
            F.coalesce(F.bool_or(quoted(c).rlike(p)), F.lit(False)).alias(f"is_{k}")
            for k, p in fixed.VALUE_KIND_PATTERNS.items()
        ]).alias(c)
        for c in names
    ])
    return wide.unpivot([], [quoted(c) for c in names], "column", "k").select("column", "k.*")

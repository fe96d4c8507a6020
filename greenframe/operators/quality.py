"""Anomalies and semantic patterns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from greenframe.functions import fixed_values as fixed
from greenframe.operators.profile import (
    TEMPORAL,
    columns_of,
    kind,
    long_rows,
    present,
    quoted,
    suggest_sql_type,
)


def _blank_or_missing(df: DataFrame, name: str) -> Column:
    gone = present(df, name).isNull()
    return gone | (quoted(name) == "") if isinstance(df.schema[name].dataType, T.StringType) else gone


def _moments(df: DataFrame, names: list[str]) -> dict[str, tuple[float | None, float | None]]:
    """Mean and population deviation per column; one row comes to the driver."""
    if not names:
        return {}
    row = df.agg(*[
        f(present(df, c).cast("double")).alias(f"{k}{i}")
        for i, c in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop))
    ]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(names)}


def _outlier_share(df: DataFrame, name: str, moments: dict, z: float) -> Column:
    mean, spread = moments[name]
    if not spread:
        return F.lit(0.0)
    far = F.abs((present(df, name).cast("double") - F.lit(mean)) / F.lit(spread)) > z
    return F.avg(F.when(far, 1.0).otherwise(0.0))


def zscore_outlier_rate(df: DataFrame, columns: list[str] | None = None, z: float = 3.0) -> DataFrame:
    """(column, outlier_rate): share of all rows more than ``z`` deviations from the mean."""
    names = columns or columns_of(df, "numeric")
    moments = _moments(df, names)
    wide = df.agg(*[_outlier_share(df, c, moments, z).alias(c) for c in names])
    return wide.unpivot([], [quoted(c) for c in names], "column", "outlier_rate")


def sample_skewness(value: Column) -> Column:
    """Bias-corrected skewness; null below three values or without variance."""
    n = F.count(value).cast("double")
    return F.when(F.count(value) >= 3, F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(value))


def sample_kurtosis(value: Column) -> Column:
    """Bias-corrected excess kurtosis; null below four values or without variance."""
    n = F.count(value).cast("double")
    return F.when(
        F.count(value) >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6.0)
    )


def shape_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, std, skewness, kurtosis) of the numeric columns."""
    names = columns or columns_of(df, "numeric")
    wide = df.agg(*[
        F.struct(F.stddev_samp(v).alias("std"), sample_skewness(v).alias("skewness"), sample_kurtosis(v).alias("kurtosis")).alias(c)
        for c in names for v in [present(df, c).cast("double")]
    ])
    return wide.unpivot([], [quoted(c) for c in names], "column", "s").select("column", "s.*")


def _date_shares(name: str, as_of: datetime, min_year: int, future_days: int) -> tuple[Column, Column]:
    day = quoted(name).cast("timestamp")
    latest = F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp") + F.make_dt_interval(F.lit(future_days))
    earliest = F.lit(f"{min_year:04d}-01-01 00:00:00").cast("timestamp")
    return F.avg(F.when(day > latest, 1.0).otherwise(0.0)), F.avg(F.when(day < earliest, 1.0).otherwise(0.0))


def date_anomalies(df: DataFrame, as_of: datetime, min_year: int = 1900, future_days: int = 1,
                   columns: list[str] | None = None) -> DataFrame:
    """(column, future_pct, ancient_pct): shares of all rows, null dates included in the total."""
    names = columns or columns_of(df, "datetime")
    wide = df.agg(*[
        F.struct((future * 100).alias("future_pct"), (ancient * 100).alias("ancient_pct")).alias(c)
        for c in names for future, ancient in [_date_shares(c, as_of, min_year, future_days)]
    ])
    return wide.unpivot([], [quoted(c) for c in names], "column", "s").select("column", "s.*")


def _constant_texts(df: DataFrame) -> set[str]:
    names = columns_of(df, "text")
    if not names:
        return set()
    ends = df.agg(*[(F.min(quoted(c)) == F.max(quoted(c))).alias(f"c{i}") for i, c in enumerate(names)]).first()
    return {c for i, c in enumerate(names) if ends[f"c{i}"]}


def anomaly_report(df: DataFrame, as_of: datetime, z: float = 3.0, min_year: int = 1900,
                   future_days: int = 1) -> DataFrame:
    """One row per column: missing share, constancy, outliers, shape, odd dates and their weighted severity.

    Means and deviations come first, everything else with these as constants.
    Text columns, whose extremes cannot be kept in the fast aggregation, are
    compared on their own.
    """
    numeric = columns_of(df, "numeric")
    moments = _moments(df, numeric)
    constant_texts = _constant_texts(df)
    nothing = F.lit(None).cast("double")

    def facts(field: T.StructField) -> Column:
        name = field.name
        value = present(df, name)
        missing = F.avg(F.when(_blank_or_missing(df, name), 1.0).otherwise(0.0))
        if kind(field.dataType) in ("text", "other"):
            constant = F.lit(name in constant_texts)
        else:
            constant = F.coalesce(F.min(value) == F.max(value), F.lit(False))
        std = skew = kurt = outliers = future = ancient = nothing
        if name in moments:
            number = value.cast("double")
            std, skew, kurt = F.stddev_samp(number), sample_skewness(number), sample_kurtosis(number)
            outliers = _outlier_share(df, name, moments, z)
        if isinstance(field.dataType, TEMPORAL):
            future, ancient = _date_shares(name, as_of, min_year, future_days)
        return F.struct(
            missing.alias("missing"), constant.alias("is_constant"), outliers.alias("outliers"), std.alias("std"),
            skew.alias("skewness"), kurt.alias("kurtosis"), future.alias("future"), ancient.alias("ancient"),
        ).alias(name)

    wide = df.agg(*[facts(f) for f in df.schema.fields])
    long = wide.unpivot([], [quoted(c) for c in df.columns], "column", "f").select("column", "f.*")
    zero = F.lit(0.0)
    severity = (
        F.col("missing") * 0.35 + F.coalesce("outliers", zero) * 0.35
        + F.coalesce(F.abs("skewness") / 10, zero) * 0.15 + F.coalesce(F.abs("kurtosis") / 10, zero) * 0.15
    )
    return long.select(
        "column", F.round(F.col("missing") * 100, 2).alias("missing_pct"), "is_constant",
        F.round(F.col("outliers") * 100, 2).alias("outlier_pct"), "std", "skewness", "kurtosis",
        F.round(F.col("future") * 100, 2).alias("future_pct"), F.round(F.col("ancient") * 100, 2).alias("ancient_pct"),
        F.round(severity, 4).alias("severity"),
    )


def semantic_profile(df: DataFrame, columns: list[str] | None = None, sample_rows: int | None = None,
                     key: list[str] | None = None) -> DataFrame:
    """(column, pattern, match_pct) for every pattern that some value matches as a whole.

    All rows are read; ``sample_rows`` takes that many non-null values per
    column in the order of ``key`` instead. Timestamps are read as dates where
    all of a column are at midnight, else as date and time.
    """
    names = columns or [f.name for f in df.schema.fields if kind(f.dataType) != "other"]
    if sample_rows is not None and not key:
        raise ValueError("a sample needs a key to be taken by")

    def entries(frame: DataFrame, cols: list[str]) -> list[list[Column]]:
        made = []
        for c in cols:
            value = present(frame, c)
            if isinstance(frame.schema[c].dataType, (T.TimestampType, T.TimestampNTZType)):
                stamp = quoted(c).cast("timestamp")
                midnight = F.date_trunc("day", stamp) == stamp
                forms = [("date", F.date_format(stamp, "yyyy-MM-dd")), ("time", F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"))]
                made += [[F.lit(c).alias("column"), F.lit(form).alias("form"), midnight.alias("midnight"), text.alias("value")]
                         for form, text in forms]
            else:
                text = F.initcap(value.cast("string")) if kind(frame.schema[c].dataType) == "boolean" else value.cast("string")
                made.append([F.lit(c).alias("column"), F.lit("").alias("form"), F.lit(True).alias("midnight"), text.alias("value")])
        return made

    if sample_rows is None:
        long = long_rows(entries(df, names), df)
    else:
        parts = [
            long_rows(entries(head, [c]), head)
            for c in names
            for head in [df.filter(present(df, c).isNotNull()).orderBy(*key).limit(sample_rows)]
        ]
        long = parts[0]
        for part in parts[1:]:
            long = long.unionAll(part)
    patterns = fixed.SEMANTIC_PATTERNS

    def matches(label: str) -> Column:
        least, most = fixed.SEMANTIC_LENGTHS[label]
        there = F.col("length") >= least if most is None else F.col("length").between(least, most)
        return there & F.col("value").rlike(rf"\A(?:{patterns[label]})\z")

    matched = long.withColumn("length", F.length("value")).filter(F.col("value").isNotNull()).groupBy("column", "form").agg(
        F.bool_and("midnight").alias("midnight"),
        *[F.avg(F.when(matches(label), 1.0).otherwise(0.0)).alias(label) for label in patterns],
    )
    chosen = matched.filter(
        "form = '' OR (form = 'date' AND midnight) OR (form = 'time' AND NOT midnight)"
    ).drop("form", "midnight")
    shares = chosen.unpivot(["column"], list(patterns), "pattern", "share")
    return shares.select("column", "pattern", F.round(F.col("share") * 100, 2).alias("match_pct")).filter("match_pct > 0")


def pii_flag(semantic: DataFrame) -> DataFrame:
    """(column, sensitive): does any pattern fit more than a tenth of the values?"""
    return semantic.groupBy("column").agg((F.max("match_pct") > fixed.PII_SHARE_PCT).alias("sensitive"))


def semantic_report(df: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """Per column: type, suggested SQL type, sensitivity and the patterns found."""
    semantic = semantic if semantic is not None else semantic_profile(df)
    found = semantic.groupBy("column").agg(
        (F.max("match_pct") > fixed.PII_SHARE_PCT).alias("sensitive"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("pattern", "match_pct")))).alias("matches"),
    )
    types = F.lit(None).cast("string")
    for f in df.schema.fields:
        types = F.when(F.col("column") == f.name, f.dataType.simpleString()).otherwise(types)
    return suggest_sql_type(df).join(found, "column", "left").select(
        "column", types.alias("type"), "sql_type", F.coalesce("sensitive", F.lit(False)).alias("sensitive"), "matches"
    )

"""Delimited and Parquet files, telemetry records, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from greenframe.functions import fixed_values as fixed
from greenframe.sources.naming import normalize_columns

_LOAD = T.StructType([
    T.StructField("percent", T.DoubleType()),
    T.StructField("power_w", T.DoubleType()),
])
TELEMETRY_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("cpu", T.StructType([
        *_LOAD.fields, T.StructField("co2_gs_cpu", T.DoubleType()), T.StructField("co2_kgh_cpu", T.DoubleType()),
    ])),
    T.StructField("ram", T.StructType([T.StructField("percent", T.DoubleType())])),
    T.StructField("gpu", T.StructType([
        *_LOAD.fields, T.StructField("co2_gs_gpu", T.DoubleType()), T.StructField("co2_kgh_gpu", T.DoubleType()),
    ])),
])


def _typed(df: DataFrame) -> DataFrame:
    """Give every all-text column the narrowest of boolean, long, double and string it fits."""
    def text(c: str) -> Column:
        return F.col(f"`{c}`")

    integer, number, truth = r"^\s*[+-]?\d+\s*$", fixed.NUMBER_PATTERN, "^(True|False|TRUE|FALSE|true|false)$"
    counts = df.select(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(text(c)).alias(f"n_{i}") for i, c in enumerate(df.columns)],
        *[
            F.count_if(check(text(c))).alias(f"{kind}_{i}")
            for i, c in enumerate(df.columns)
            for kind, check in (
                ("long", lambda v: v.rlike(integer) & v.try_cast("bigint").isNotNull()),
                ("double", lambda v: v.rlike(number)),
                ("boolean", lambda v: v.rlike(truth)),
            )
        ],
    ).first()
    if counts["rows"] == 0:
        raise ValueError("the file holds no rows")

    def kind(i: int) -> str:
        present = counts[f"n_{i}"]
        # a column without any value is read as an (all missing) number
        fitting = [k for k in ("long", "double", "boolean") if counts[f"{k}_{i}"] == present]
        return ("double" if present == 0 else fitting[0]) if fitting else "string"

    kinds = [kind(i) for i in range(len(df.columns))]
    return df.select(
        *[text(c).try_cast(k).alias(c) if k != "string" else text(c) for c, k in zip(df.columns, kinds)]
    )


def read_delimited(spark: SparkSession, path: str, sep: str = ";", encoding: str = "UTF-8",
                   schema: T.StructType | None = None, normalize: bool = True, multi_line: bool | None = None,
                   fallback_encoding: str | None = "ISO-8859-1") -> DataFrame:
    """A CSV or text file with a header row.

    Without ``schema`` one pass over the file finds the column types. Rows with
    a wrong number of fields fail the read, and so does a file without rows.
    Bytes that are not valid in ``encoding`` make the whole file be read in
    ``fallback_encoding``; None leaves that check out. Files are split over
    tasks unless a line ends inside quotes, which one pass over the lines finds
    (``multi_line`` says so beforehand): then a file is one task's.
    """
    lines = spark.read.text(path)
    if fallback_encoding and encoding.upper() in ("UTF-8", "UTF8"):
        if not lines.filter(~F.is_valid_utf8("value")).isEmpty():
            encoding = fallback_encoding
    if multi_line is None:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multi_line = not lines.filter(quotes % 2 == 1).isEmpty()
    reader = spark.read.options(
        header=True, sep=sep, encoding=encoding, quote='"', escape='"', multiLine=multi_line, mode="FAILFAST",
        enforceSchema=schema is None,
    )
    if schema is not None:
        df = reader.schema(schema).csv(path)
        if df.isEmpty():
            raise ValueError("the file holds no rows")
    else:
        raw = reader.csv(path)
        missing = [F.when(~F.col(f"`{c}`").isin(fixed.MISSING_TOKENS), F.col(f"`{c}`")).alias(c) for c in raw.columns]
        df = _typed(raw.select(*missing))
    return normalize_columns(df) if normalize else df


def sniff_delimiter(spark: SparkSession, path: str, lines: int = 20) -> str | None:
    """The candidate that cuts the first lines into the most even number (> 1) of fields."""
    head = spark.read.text(path).limit(lines)
    fields = {f"d{i}": F.size(F.split("value", f"[{d}]" if d != "\t" else "\t")) for i, d in enumerate(fixed.DELIMITERS)}
    stats = head.select(*[c.alias(n) for n, c in fields.items()]).agg(
        *[f(n).alias(f"{k}_{n}") for n in fields for k, f in (("mean", F.avg), ("var", F.var_pop))]
    ).first()
    usable = [
        (stats[f"var_d{i}"], -stats[f"mean_d{i}"], d)
        for i, d in enumerate(fixed.DELIMITERS)
        if stats[f"mean_d{i}"] and stats[f"mean_d{i}"] > 1
    ]
    return min(usable)[2] if usable else None


FEW_SPLITS = 16


def spread_out(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input out to all cores.

    A file with one row group is read by one task whatever its size in rows.
    Inputs of more than a few splits, where dealing out would cost more than it
    brings, are left alone.
    """
    splits, cores = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if splits < min(cores, FEW_SPLITS) else df


def read_parquet(spark: SparkSession, path: str, spread: bool = False) -> DataFrame:
    """A Parquet table; ``spread`` deals a small one out to all cores, for work that is heavy per row."""
    df = spark.read.parquet(path)
    return spread_out(df) if spread else df


def write_dataset(df: DataFrame, path: str, fmt: str = "csv", sep: str = ";", mode: str = "overwrite") -> None:
    """CSV with a header, or Parquet."""
    if fmt == "csv":
        df.write.mode(mode).options(header=True, sep=sep, quote='"', escape='"').csv(path)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}: csv or parquet")


def flatten_telemetry(df: DataFrame, sample: str) -> DataFrame:
    """Nested samples (JSON text or struct) as flat ``cpu.percent``-style columns; no GPU counts as 0."""
    if dict(df.dtypes)[sample] == "string":
        df = df.withColumn(sample, F.from_json(sample, TELEMETRY_SCHEMA))
    flat = []
    for part in df.schema[sample].dataType.fields:
        if not isinstance(part.dataType, T.StructType):
            flat.append(F.col(f"{sample}.{part.name}").alias(part.name))
            continue
        for field in part.dataType.fields:
            value = F.col(f"{sample}.{part.name}.{field.name}")
            if isinstance(field.dataType, T.DoubleType):
                value = F.coalesce(value, F.lit(0.0))
            flat.append(value.alias(f"{part.name}.{field.name}"))
    return df.select(*[c for c in df.columns if c != sample], *flat)


def preview(df: DataFrame, key: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in the order of ``key``."""
    return df.orderBy(*key).limit(n)

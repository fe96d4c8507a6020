"""Collections of tables: loading, saving, selecting columns, describing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from greenframe.sources.naming import safe_table_name

Tables = dict[str, DataFrame]


def load_folder(spark: SparkSession, folder: str, names: list[str] | None = None) -> Tables:
    """The Parquet tables below ``folder``, or those of the given names. The store is listed by Spark's own reader of it."""
    if names is None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        names = sorted(x.getPath().getName().removesuffix(".parquet") for x in listed if x.getPath().getName().endswith(".parquet"))
        if not names:
            raise ValueError("the folder holds no tables")
    return {name.lower(): spark.read.parquet(f"{folder}/{name}.parquet") for name in names}


def load_database(spark: SparkSession, database: str | None = None) -> Tables:
    """Every table of a catalog database, by lower-case name. Temporary views, which belong to no database, are left out."""
    found = {
        entry.name.lower(): spark.table(f"`{database}`.`{entry.name}`" if database else f"`{entry.name}`")
        for entry in spark.catalog.listTables(database)
        if not entry.isTemporary and not entry.name.startswith("sqlite_")
    }
    if not found:
        raise ValueError("the database holds no tables")
    return found


def load_jdbc(spark: SparkSession, url: str, splits: dict[str, dict], **options: str) -> Tables:
    """Tables of a DBMS.

    ``splits`` names the tables, each with the JDBC options that make the read
    parallel: partitionColumn, lowerBound, upperBound and numPartitions.
    """
    if not splits:
        raise ValueError("no tables named")
    return {
        name.lower(): spark.read.format("jdbc").options(url=url, dbtable=name, **options, **split).load()
        for name, split in splits.items()
    }


def select_columns_across(tables: Tables, columns: list[str] | None = None) -> Tables:
    """Keep the wanted columns of every table and drop tables that have none of them."""
    if not columns:
        return dict(tables)
    wanted = set(columns)
    kept = {name: [c for c in df.columns if c in wanted] for name, df in tables.items()}
    return {name: tables[name].select(*cols) for name, cols in kept.items() if cols}


def _free_name(name: str, taken: set[str]) -> str:
    number = 2
    while f"{name}_{number}" in taken:
        number += 1
    return f"{name}_{number}"


def add_tables(present: Tables, new: Tables, on_duplicate: str = "keep_both") -> Tables:
    """Add ``new`` to ``present``: a taken name is suffixed, replaced or ignored."""
    if on_duplicate not in ("keep_both", "replace", "ignore"):
        raise ValueError(f"unknown policy {on_duplicate!r}")
    merged = dict(present)
    for name, df in new.items():
        if name not in merged or on_duplicate == "replace":
            merged[name] = df
        elif on_duplicate == "keep_both":
            merged[_free_name(name, set(merged))] = df
    return merged


def save_tables(tables: Tables, folder: str | None = None, database: str | None = None,
                jdbc: dict[str, str] | None = None) -> dict[str, str | None]:
    """Write each table, replacing what is there; returns name -> error text or None.

    The target is a folder of Parquet tables, a catalog database or a JDBC URL.
    A table that fails does not keep the others from being written.
    """
    outcome: dict[str, str | None] = {}
    for raw_name, df in tables.items():
        name = safe_table_name(raw_name)
        try:
            if folder is not None:
                df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
            elif jdbc is not None:
                df.write.mode("overwrite").format("jdbc").options(dbtable=name, batchsize="1000", **jdbc).save()
            else:
                df.write.mode("overwrite").saveAsTable(f"`{database}`.`{name}`" if database else f"`{name}`")
            outcome[name] = None
        except Exception as error:  # noqa: BLE001 - reported, the other tables go on
            outcome[name] = str(error)
    return outcome


def row_counts(tables: Tables) -> DataFrame:
    """(table_name, row_count); counting reads no column."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionAll, counts)


def catalog_profile(tables: Tables) -> DataFrame:
    """One row per column of every table: position, type, and the row count of its table."""
    columns = {
        name: F.array(*[
            F.struct(F.lit(i + 1).alias("position"), F.lit(f.name).alias("column_name"),
                     F.lit(f.dataType.simpleString()).alias("column_type"))
            for i, f in enumerate(df.schema.fields)
        ])
        for name, df in tables.items()
    }
    described = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", F.inline(columns[name])
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionAll, described)


def previews(tables: Tables, n: int = 5) -> Tables:
    return {name: df.limit(n) for name, df in tables.items()}

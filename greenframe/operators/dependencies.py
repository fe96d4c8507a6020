"""Keys, inclusion and functional dependencies."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenframe.operators.profile import kind, long_rows, quoted, value_counts

KEY_COLUMNS = "key_columns string, width int"


def _row_key(columns: tuple[str, ...] | list[str]) -> Column:
    """One text per combination of values; JSON keeps values and nulls apart."""
    packed = [quoted(c).cast("string").alias(f"v{i}") for i, c in enumerate(columns)]
    return F.to_json(F.struct(*packed), {"ignoreNullFields": "false"})


def candidate_keys(df: DataFrame, max_width: int = 2, columns: list[str] | None = None) -> DataFrame:
    """(key_columns, width) of the minimal combinations that are unique and never null.

    Wider combinations are tried only if they contain no smaller key and their
    columns have enough distinct values for all rows between them.
    """
    names = columns or [f.name for f in df.schema.fields if kind(f.dataType) != "other"]
    spark = df.sparkSession
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(names)]).first()
    rows = counts["rows"]
    filled = [c for i, c in enumerate(names) if counts[f"n{i}"] == rows]
    if not rows or not filled:
        return spark.createDataFrame([], KEY_COLUMNS)
    distinct = {r["column"]: r["values"] for r in value_counts(df, filled).groupBy("column").agg(
        F.count(F.lit(1)).alias("values")).collect()}
    keys: list[tuple[str, ...]] = [(c,) for c in filled if distinct.get(c) == rows]
    for width in range(2, max_width + 1):
        open_sets = []
        for combo in combinations(filled, width):
            room = 1
            for c in combo:
                room *= distinct.get(c, 0)
            if room >= rows and not any(set(k) <= set(combo) for k in keys):
                open_sets.append(combo)
        if not open_sets:
            continue
        tried = long_rows([[F.lit(i).alias("i"), _row_key(combo).alias("key")] for i, combo in enumerate(open_sets)], df)
        repeated = {r["i"] for r in tried.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("i").distinct().collect()}
        keys += [combo for i, combo in enumerate(open_sets) if i not in repeated]
    return spark.createDataFrame([(", ".join(k), len(k)) for k in keys], KEY_COLUMNS)


def _in_one_form(rows: DataFrame) -> DataFrame:
    """``rows`` (kind, value, ..) with equal values as equal texts, whatever their types: 3, 3.0, 3.00 and 3.0E0; a date and its midnight.

    A number, as Spark writes it, becomes its digits without zeros at either end and the power of ten of the first one,
    so without rounding. In steps, so that each part of a value is worked out once.
    """
    value, mark = F.col("value"), F.instr("value", "E")
    parts = rows.withColumns({"_m": F.substring_index("value", "E", 1), "_e": F.when(mark > 0, F.substr("value", mark + 1).try_cast("int")).otherwise(0)})
    parts = parts.withColumns({
        "_i": F.ltrim(F.substring_index("_m", ".", 1), F.lit("+-")), "_f": F.when(F.instr("_m", ".") > 0, F.substring_index("_m", ".", -1)).otherwise(""),
    })
    parts = parts.withColumn("_d", F.concat("_i", "_f")).withColumn("_k", F.ltrim("_d", F.lit("0")))
    power = F.length("_i") - 1 - (F.length("_d") - F.length("_k")) + F.col("_e")
    signed = F.concat(F.when(value.startswith("-"), "-").otherwise(""), F.rtrim("_k", F.lit("0")), F.lit("e"), power.cast("string"))
    number = F.when(value.endswith("Infinity"), value).when(F.col("_k") == "", "0").otherwise(signed)
    form = F.when(F.col("kind") == "numeric", number).when(F.col("kind") == "datetime", F.regexp_replace(value, r" 00:00:00(\.0+)?$", "")).otherwise(value)
    return parts.withColumn("value", form).drop("_m", "_e", "_i", "_f", "_d", "_k")


def inclusion_dependencies(a: DataFrame, b: DataFrame, min_coverage: float = 0.0) -> DataFrame:
    """(a_column, b_column, distinct_values, included, coverage_pct) for columns of the same kind.

    Both tables are reduced to distinct (column, value) rows and joined once on
    the value; a value meets at most one row per column, whatever its frequency.
    Numbers of different types are equal when they are written alike without
    exponent and idle zeros: decimals keep all digits, a double is what its
    shortest text says.
    """
    def values(df: DataFrame, side: str) -> DataFrame:
        kinds = F.lit("")
        usable = [f for f in df.schema.fields if kind(f.dataType) in ("numeric", "text", "datetime")]
        for f in usable:
            kinds = F.when(F.col("column") == f.name, kind(f.dataType)).otherwise(kinds)
        whole = value_counts(df, [f.name for f in usable]).select(
            F.col("column").alias(side), kinds.alias("kind"), "value"
        )
        # values of one column and type that differ still differ in their one form
        return _in_one_form(whole)

    left, right = values(a, "a_column"), values(b, "b_column")
    sizes = left.groupBy("a_column").agg(F.count(F.lit(1)).alias("distinct_values"))
    shared = left.join(right, ["kind", "value"]).groupBy("a_column", "b_column").agg(F.count(F.lit(1)).alias("included"))
    return shared.join(sizes, "a_column").select(
        "a_column", "b_column", "distinct_values", "included",
        (F.col("included") / F.col("distinct_values") * 100.0).alias("coverage_pct"),
    ).filter(F.col("coverage_pct") >= min_coverage)


def functional_dependencies(df: DataFrame, tolerance: float = 0.01, columns: list[str] | None = None) -> DataFrame:
    """(determinant, dependent, violation_rate) of the pairs x -> y that at most ``tolerance`` of the rows break.

    A row breaks x -> y if its y is not the most frequent one of its x. Each
    unordered pair of columns is counted once and serves both directions.

    All columns take part, but rows are counted only for pairs that their numbers of distinct values leave open: a
    unique column determines every other, and where y has so many more values than x that the rows beyond one y for
    each x are too many, x -> y cannot hold.
    """
    names = columns or [f.name for f in df.schema.fields if kind(f.dataType) != "other"]
    text = {c: quoted(c).cast("string") for c in names}
    texts = df.select(*[v.alias(c) for c, v in text.items()])
    first = texts.agg(F.count(F.lit(1)).alias("rows"), *[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(names)]).first()
    rows = first["rows"]
    found = {r["column"]: r["values"] for r in value_counts(texts, names).groupBy("column").agg(F.count(F.lit(1)).alias("values")).collect()}
    distinct = {c: found.get(c, 0) + (first[f"n{i}"] < rows) for i, c in enumerate(names)}
    unique = {c for i, c in enumerate(names) if rows and distinct[c] == rows}
    undecided = lambda x, y: x not in unique and (distinct[y] - distinct[x]) <= tolerance * rows
    certain = df.sparkSession.createDataFrame(
        [(x, y, 0.0) for x in names if x in unique for y in names if x != y and tolerance >= 0], "determinant string, dependent string, violation_rate double"
    )
    left = [(x, y) for x, y in combinations(names, 2) if undecided(x, y) or undecided(y, x)] if rows else []
    if not left:
        return certain
    pairs = long_rows([[F.lit(x).alias("x"), F.lit(y).alias("y"), text[x].alias("vx"), text[y].alias("vy")] for x, y in left], df)
    counted = pairs.groupBy("x", "y", "vx", "vy").agg(F.count(F.lit(1)).alias("n"))
    directed = counted.select(F.inline(F.array(
        F.struct(F.col("x").alias("determinant"), F.col("y").alias("dependent"), F.col("vx").alias("value"), F.col("n")),
        F.struct(F.col("y").alias("determinant"), F.col("x").alias("dependent"), F.col("vy").alias("value"), F.col("n")),
    )))
    per_value = directed.groupBy("determinant", "dependent", "value").agg(F.sum("n").alias("rows"), F.max("n").alias("kept"))
    rates = per_value.groupBy("determinant", "dependent").agg(
        ((F.sum("rows") - F.sum("kept")) / F.sum("rows")).alias("violation_rate")
    )
    return rates.filter((F.col("violation_rate") <= tolerance) & ~F.col("determinant").isin(sorted(unique))).unionByName(certain)

"""Missing values: simple fills, nearest neighbours, chained regression, and reviewed values."""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from greenframe.functions.numeric import bisect_right, literal_array
from greenframe.operators.moments import PairMoments, moments_of, pair_sums
from greenframe.operators.profile import (
    INTEGRAL,
    columns_of,
    kind,
    long_rows,
    present,
    quoted,
)
from greenframe.operators.quantiles import column_quantiles
from greenframe.session import checkpointed


def first_rows(df: DataFrame, key: list[str], limit: int | None) -> DataFrame:
    """The first ``limit`` rows by ``key``; all rows without a limit."""
    return df if not limit else df.orderBy(*key).limit(limit)


def _filled(df: DataFrame, values: dict[str, object], as_double: bool) -> DataFrame:
    """``df`` with missing cells of the columns in ``values`` replaced."""
    def cell(name: str) -> Column:
        if name not in values:
            return quoted(name)
        data_type = "double" if as_double else df.schema[name].dataType
        return F.coalesce(present(df, name).cast(data_type), F.lit(values[name]).cast(data_type)).alias(name)

    return df.select(*[cell(c) for c in df.columns])


def _numeric_only(df: DataFrame, columns: list[str]) -> None:
    wrong = [c for c in columns if kind(df.schema[c].dataType) != "numeric"]
    if wrong:
        raise ValueError(f"not numeric: {wrong}")


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    _numeric_only(df, columns)
    means = df.agg(*[F.avg(present(df, c).cast("double")).alias(c) for c in columns]).first()
    return _filled(df, means.asDict(), as_double=True)


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact median; the midpoint for an even number of values."""
    _numeric_only(df, columns)
    values = df.select(*[present(df, c).cast("double").alias(c) for c in dict.fromkeys(columns)])
    medians = {r["column"]: r["q0"] for r in column_quantiles(values, [0.5]).collect()} if columns else {}
    return _filled(df, {c: medians.get(c) for c in columns}, as_double=True)


def impute_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    """The most frequent value, the smallest on ties; numbers and texts alike."""
    def typed(name: str) -> list[Column]:
        value, data_type = present(df, name), df.schema[name].dataType
        whole = value.cast("long") if isinstance(data_type, INTEGRAL) else F.lit(None).cast("long")
        part = value.cast("double") if kind(data_type) == "numeric" and not isinstance(data_type, INTEGRAL) else F.lit(None).cast("double")
        text = value.cast("string") if kind(data_type) != "numeric" else F.lit(None).cast("string")
        return [F.lit(name).alias("column"), whole.alias("whole"), part.alias("part"), text.alias("text")]

    counted = long_rows([typed(c) for c in columns], df).filter(
        F.coalesce(F.col("whole").cast("string"), F.col("part").cast("string"), F.col("text")).isNotNull()
    ).groupBy("column", "whole", "part", "text").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("minus"), "whole", "part", "text")).alias("b"))
    modes = {r["column"]: next((v for v in (r["b"]["whole"], r["b"]["part"], r["b"]["text"]) if v is not None), None)
             for r in best.collect()}
    return _filled(df, {c: modes.get(c) for c in columns}, as_double=False)


def impute_constant(df: DataFrame, columns: list[str], value) -> DataFrame:
    """A fixed value; text is read as a number where all columns are numeric."""
    numeric = all(kind(df.schema[c].dataType) == "numeric" for c in columns)
    if numeric and isinstance(value, str):
        value = float(value)
    return _filled(df, dict.fromkeys(columns, value), as_double=numeric)


SIMPLE = {"mean": impute_mean, "median": impute_median, "most_frequent": impute_mode}


def impute_simple(df: DataFrame, columns: list[str], strategy: str, fill_value=None, row_limit: int | None = None,
                  key: list[str] | None = None) -> DataFrame:
    """mean, median, most_frequent or constant; with ``row_limit`` on (and from) the first rows by ``key`` only."""
    rows = first_rows(df, key or [], row_limit)
    if strategy == "constant":
        return impute_constant(rows, columns, fill_value)
    return SIMPLE[strategy](rows, columns)


# ---- nearest neighbours -----------------------------------------------------

GRID_COLUMNS = 3
ROWS_PER_CELL = 1000
MOST_BINS = 4095
REACHES = (0, 1, 4)
PATTERN_PAIRS = 10_000
CELL = ["dm", "s0", "s1", "s2", "c0", "c1", "c2"]


def _grid(donors: DataFrame, width: int, rows_per_cell: int) -> list[list[float]]:
    """Split points per coordinate, at quantiles, for cells of about ``rows_per_cell`` donors."""
    rows = donors.count()
    bins = min(MOST_BINS, max(1, ceil((rows / rows_per_cell) ** (1 / min(GRID_COLUMNS, max(1, width - 1))))))
    if bins == 1:
        return [[] for _ in range(width)]
    cuts = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = donors.agg(*[F.percentile_approx(F.col("v")[i], cuts, 10 * bins).alias(f"q{i}") for i in range(width)]).first()
    return [sorted(set(found[f"q{i}"] or [])) for i in range(width)]


class _Neighbours:
    """Exact k nearest donors by cells.

    A donor lies in the cell of its bins on up to three coordinates it shares
    with the searching row. The cells around a row give k donors and so an upper
    bound for the distance of the k-th; the cells within that distance hold all
    candidates. Pairs are formed within cells only.
    """

    def __init__(self, rows: DataFrame, width: int, k: int, rows_per_cell: int):
        self.width, self.k = width, k
        self.masks = [r["m"] for r in rows.select("m").distinct().collect()]
        # of equal rows only the first k can be among the k nearest
        copies = Window.partitionBy("vk").orderBy("id")
        donors = rows.filter(F.contains("m", F.lit("1"))).withColumn("_r", F.row_number().over(copies)).filter(F.col("_r") <= k)
        self.donors = checkpointed(donors.drop("_r"))
        self.splits = _grid(self.donors, width, rows_per_cell)
        self.longest = max(len(cuts) for cuts in self.splits)
        self.split_array = F.array(*[literal_array(cuts) for cuts in self.splits])
        vectors = rows.filter(F.contains("m", F.lit("0"))).select("vk", "v", "m").distinct()
        units = vectors.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).filter(
            F.get("v", F.col("f")).isNull()
        )
        self.units = checkpointed(units.withColumn("uid", F.monotonically_increasing_id()))
        by_spread = sorted(range(width), key=lambda i: -len(self.splits[i]))
        plan = []
        for m in self.masks:
            for dm in self.masks:
                shared = [i for i in by_spread if m[i] == "1" and dm[i] == "1"]
                if "0" in m and shared:
                    slots = (shared[:GRID_COLUMNS] + [-1] * GRID_COLUMNS)[:GRID_COLUMNS]
                    plan.append((m, dm, *slots, len(shared)))
        spark = rows.sparkSession
        self.plan = spark.createDataFrame(plan, "m string, dm string, s0 int, s1 int, s2 int, shared int")
        if len(plan) <= PATTERN_PAIRS:
            # a row per pair of patterns of missing columns, however many rows there are
            self.plan = F.broadcast(self.plan)
        placed = self.donors.join(self.plan.select("dm", "s0", "s1", "s2").distinct(), F.col("m") == F.col("dm"))
        self.placed = placed.select(
            "dm", "s0", "s1", "s2", "id", F.col("v").alias("dv"),
            *[self._at(F.col("v"), F.col(f"s{i}")).alias(f"c{i}") for i in range(GRID_COLUMNS)],
        )

    def _at(self, vector: Column, slot: Column, shift: Column | float = 0.0) -> Column:
        value = F.get(vector, slot) + shift
        return F.when(slot < 0, -1).otherwise(bisect_right(F.get(self.split_array, slot), value, self.longest))

    def _nearest(self, searches: DataFrame) -> DataFrame:
        """The k nearest donors per ``uid`` among the cells ``l0..h2``; (uid, f, distance, dv)."""
        cells = searches
        for i in range(GRID_COLUMNS):
            cells = cells.withColumn(f"c{i}", F.explode(F.sequence(f"l{i}", f"h{i}"))).drop(f"l{i}", f"h{i}")
        pairs = cells.join(self.placed, CELL)
        squares = F.lit(0.0)
        for i in range(self.width):
            gap = F.col("v")[i] - F.col("dv")[i]
            squares = squares + F.coalesce(gap * gap, F.lit(0.0))
        near = pairs.withColumn("distance", squares * F.lit(float(self.width)) / F.col("shared"))
        if "limit" in searches.columns:
            near = near.filter(F.col("limit").isNull() | (F.col("distance") <= F.col("limit")))
        order = Window.partitionBy("uid").orderBy("distance", "id")
        return near.select("uid", "f", "distance", "id", "dv").withColumn("_r", F.row_number().over(order)).filter(
            F.col("_r") <= self.k
        )

    def _searches(self, units: DataFrame) -> DataFrame:
        return units.join(self.plan, "m").filter(F.substr("dm", F.col("f") + 1, F.lit(1)) == "1")

    def _around(self, units: DataFrame, reach: int) -> DataFrame:
        rows = self._searches(units)
        for i in range(GRID_COLUMNS):
            home, slot = self._at(F.col("v"), F.col(f"s{i}")), F.col(f"s{i}")
            top = F.size(F.get(self.split_array, slot))
            rows = rows.withColumn(f"l{i}", F.when(slot < 0, -1).otherwise(F.greatest(home - reach, F.lit(0))))
            rows = rows.withColumn(f"h{i}", F.when(slot < 0, -1).otherwise(F.least(home + reach, top)))
        return rows

    def _within(self, units: DataFrame) -> DataFrame:
        rows = self._searches(units)
        # a hair more than the bound, for donors that lie exactly on it
        radius = F.sqrt(F.col("limit") * F.col("shared") / self.width) * (1 + 1e-9)
        for i in range(GRID_COLUMNS):
            slot = F.col(f"s{i}")
            top = F.size(F.get(self.split_array, slot))
            low, high = self._at(F.col("v"), slot, -radius), self._at(F.col("v"), slot, radius)
            rows = rows.withColumn(f"l{i}", F.when(slot < 0, -1).when(F.col("limit").isNull(), 0).otherwise(low))
            rows = rows.withColumn(f"h{i}", F.when(slot < 0, -1).when(F.col("limit").isNull(), top).otherwise(high))
        return rows

    def values(self) -> DataFrame:
        """(vk, f, value): mean of the k nearest donors' column f for every pattern of row and missing column."""
        waiting, bounds = self.units, None
        for reach in REACHES:
            near = self._nearest(self._around(waiting, reach)).groupBy("uid").agg(
                F.count(F.lit(1)).alias("n"), F.max("distance").alias("limit")
            )
            found = checkpointed(near.filter(F.col("n") >= self.k).select("uid", "limit"))
            bounds = found if bounds is None else bounds.unionAll(found)
            waiting = self.units.join(bounds, "uid", "left_anti")
            if waiting.isEmpty():
                break
        bounded = self.units.join(bounds, "uid", "left")
        chosen = self._nearest(self._within(bounded)).groupBy("uid").agg(F.avg(F.get("dv", F.col("f"))).alias("value"))
        return self.units.join(chosen, "uid").select("vk", "f", "value")


def impute_knn(df: DataFrame, key: str, columns: list[str], k: int = 5, rows_per_cell: int = ROWS_PER_CELL,
               row_limit: int | None = None) -> DataFrame:
    """Each missing cell becomes the mean of the k nearest rows that have the column.

    With ``row_limit`` on (and from) the first rows by ``key`` only.

    Distance is Euclidean over the coordinates both rows have, scaled up by
    total / shared; ties go to the smaller ``key``. A cell without any such row
    takes the column mean.
    """
    _numeric_only(df, columns)
    df = first_rows(df, [key], row_limit)
    cells = [present(df, c).cast("double") + F.lit(0.0) for c in columns]
    vector = F.array(*cells)
    mask = F.concat(*[F.when(c.isNotNull(), "1").otherwise("0") for c in cells])
    text = F.concat_ws(",", *[F.coalesce(c.cast("string"), F.lit("_")) for c in cells])
    tagged = df.withColumns({"_v": vector, "_m": mask, "_vk": text})
    rows = tagged.select(F.col("_vk").alias("vk"), F.col("_v").alias("v"), F.col("_m").alias("m"), quoted(key).alias("id"))
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cells)]).first()
    found = _Neighbours(rows, len(columns), k, rows_per_cell).values()
    wide = found.groupBy(F.col("vk").alias("_vk")).agg(
        *[F.max(F.when(F.col("f") == i, F.col("value"))).alias(f"_n{i}") for i in range(len(columns))]
    )
    joined = tagged.join(wide, "_vk", "left")
    filled = {
        c: F.coalesce(cells[i], F.col(f"_n{i}"), F.lit(means[f"m{i}"]).cast("double")) for i, c in enumerate(columns)
    }
    return joined.select(*[filled[c].alias(c) if c in filled else quoted(c) for c in df.columns])


# ---- chained regression -----------------------------------------------------

def _bayesian_ridge(n: int, cov_xx: np.ndarray, cov_xy: np.ndarray, var_y: float) -> np.ndarray:
    """Coefficients of Bayesian ridge regression from second moments.

    Evidence maximisation (MacKay 1992) with flat Gamma(1e-6, 1e-6) priors on
    noise and weight precision.
    """
    prior = 1e-6
    gram, target, total = cov_xx * n, cov_xy * n, var_y * n
    eigen, basis = np.linalg.eigh(gram)
    eigen = np.clip(eigen, 0.0, None)
    rotated = basis.T @ target
    noise, weight = 1.0 / (var_y + np.finfo(float).eps), 1.0
    coef = np.zeros(len(target))
    for step in range(300):
        previous = coef
        coef = basis @ (rotated / (eigen + weight / noise))
        residual = max(total - 2 * coef @ target + coef @ gram @ coef, 0.0)
        effective = float(np.sum(noise * eigen / (weight + noise * eigen)))
        weight = (effective + 2 * prior) / (float(coef @ coef) + 2 * prior)
        noise = (n - effective + 2 * prior) / (residual + 2 * prior)
        if step and np.abs(previous - coef).sum() < 1e-3:
            break
    return basis @ (rotated / (eigen + weight / noise))


def _regression(moments: PairMoments, target: int) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of column ``target`` on the others."""
    others = [i for i in range(len(moments.n)) if i != target]
    coef = _bayesian_ridge(
        int(moments.n[target, target]), moments.cov[np.ix_(others, others)], moments.cov[others, target],
        float(moments.cov[target, target]),
    )
    means = np.diag(moments.mean_x)
    return float(means[target] - coef @ means[others]), coef


def impute_iterative(df: DataFrame, columns: list[str], max_iter: int = 10, tolerance: float = 1e-3,
                     row_limit: int | None = None, key: list[str] | None = None) -> DataFrame:
    """Missing cells predicted from the other columns, round after round, from a mean start.

    With ``row_limit`` on (and from) the first rows by ``key`` only.

    Columns go by ascending number of missing cells. The rounds end when no row
    changed by more than ``tolerance`` times the largest observed magnitude.
    Rows without gaps never change: they are summed up once, and the rounds
    read and keep only the rows with gaps.
    """
    _numeric_only(df, columns)
    df = first_rows(df, key or [], row_limit)
    numbers = {c: present(df, c).cast("double") for c in columns}
    stats = df.agg(
        *[F.avg(numbers[c]).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.count_if(numbers[c].isNull()).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.max(F.abs(numbers[c])).alias(f"a{i}") for i, c in enumerate(columns)],
    ).first()
    usable = [i for i in range(len(columns)) if stats[f"m{i}"] is not None]
    gaps = sorted((i for i in usable if stats[f"n{i}"] > 0), key=lambda i: (stats[f"n{i}"], i))
    if not gaps or len(usable) < 2:
        return impute_mean(df, columns)
    names = {i: f"_x{i}" for i in usable}
    ordered, centers = [names[i] for i in usable], [stats[f"m{i}"] for i in usable]
    any_gap = F.lit(False)
    for i in gaps:
        any_gap = any_gap | numbers[columns[i]].isNull()
    complete = df.filter(~any_gap).withColumns({names[i]: numbers[columns[i]] for i in usable})
    fixed_sums = pair_sums(complete.select(*ordered), centers)
    state = checkpointed(df.filter(any_gap).withColumns({
        **{f"_gap{i}": numbers[columns[i]].isNull() for i in gaps},
        **{names[i]: F.coalesce(numbers[columns[i]], F.lit(stats[f"m{i}"])) for i in usable},
    }))
    limit = tolerance * max(stats[f"a{i}"] for i in usable)
    for _ in range(max_iter):
        state = state.withColumns({f"_old{i}": F.col(names[i]) for i in gaps})
        for i in gaps:
            observed = state.filter(~F.col(f"_gap{i}")).select(*ordered)
            moments = moments_of(fixed_sums + pair_sums(observed, centers), centers)
            intercept, coef = _regression(moments, usable.index(i))
            predicted = F.lit(intercept)
            for name, weight in zip([n for n in ordered if n != names[i]], coef):
                predicted = predicted + F.lit(float(weight)) * F.col(name)
            state = state.withColumn(names[i], F.when(F.col(f"_gap{i}"), predicted).otherwise(F.col(names[i])))
        state = checkpointed(state)
        moved = F.lit(0.0)
        for i in gaps:
            moved = moved + F.abs(F.col(names[i]) - F.col(f"_old{i}"))
        change = state.agg(F.max(moved)).first()[0]
        state = state.drop(*[f"_old{i}" for i in gaps])
        if change is not None and change < limit:
            break
    by_name = {columns[i]: names[i] for i in usable}
    shown = [F.col(by_name[c]).alias(c) if c in by_name else quoted(c) for c in df.columns]
    return complete.select(*shown).unionAll(state.select(*shown))


# ---- review queue -----------------------------------------------------------

def missing_cells(df: DataFrame, key: list[str], columns: list[str] | None = None) -> DataFrame:
    """(key, column, row_data) per missing text cell; ``row_data`` is the row as JSON with the cell marked."""
    names = columns or columns_of(df, "text")

    def context(name: str) -> Column:
        fields = [F.lit("MISSING").alias(c) if c == name else quoted(c).alias(c) for c in df.columns]
        return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})

    cells = F.array(*[
        F.when(quoted(c).isNull(), F.struct(F.lit(c).alias("column"), context(c).alias("row_data"))) for c in names
    ])
    return df.select(*key, F.explode(cells).alias("_c")).filter(F.col("_c").isNotNull()).select(*key, "_c.*")


def _drawn_rows(df: DataFrame, key: list[str], columns: list[str], n: int, seed: int) -> DataFrame:
    """(column, key, _nth): the first ``n`` keys of each column by their digest. Tasks send on their own first ones only."""
    has = F.array_compact(F.array(*[F.when(present(df, c).isNotNull(), F.lit(c)) for c in columns]))
    digest = F.md5(F.concat_ws("|", *key, F.lit(seed)))
    order = Window.partitionBy("column").orderBy(digest, *key)
    return df.select(*key, F.explode(has).alias("column")).withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= n)


def example_rows(df: DataFrame, key: list[str], columns: list[str], n: int = 5, seed: int = 42) -> DataFrame:
    """(column, key, row_data): up to ``n`` rows per column that have it, picked by the digest of ``key`` and ``seed``.

    One scan picks the keys for all columns, a second one reads the few rows picked. ``key`` is never null.
    """
    whole = F.to_json(F.struct(*[quoted(c) for c in df.columns]), {"ignoreNullFields": "false"})
    picked = _drawn_rows(df, key, columns, n, seed)
    return df.select(*key, whole.alias("row_data")).join(F.broadcast(picked), key).select("column", *key, "row_data")


def imputation_prompts(df: DataFrame, key: list[str], columns: list[str] | None = None, n: int = 5, seed: int = 42) -> DataFrame:
    """(key, column, prompt) per missing text cell: what is asked, up to ``n`` rows that have the column, and the row itself.

    The examples of a column, at most ``n`` rows, are put together once and sent to all its missing cells.
    """
    names = columns or columns_of(df, "text")
    drawn = _drawn_rows(df, key, names, n, seed)
    whole = F.to_json(F.struct(*[quoted(c) for c in df.columns]), {"ignoreNullFields": "false"})
    rows = df.select(*key, whole.alias("_row")).join(F.broadcast(drawn), key)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_nth", "_row"))), lambda x: x["_row"])
    examples = rows.groupBy("column").agg(F.array_join(listed, "\n").alias("_examples"))
    prompt = F.concat(
        F.lit("Give the value that is marked MISSING, and nothing else. Column: "), "column", F.lit("\nRows that have it:\n"),
        F.coalesce("_examples", F.lit("none")), F.lit("\nRow:\n"), "row_data",
    )
    return missing_cells(df, key, names).join(F.broadcast(examples), "column", "left").select(*key, "column", prompt.alias("prompt"))


def apply_imputations(df: DataFrame, key: list[str], decisions: DataFrame, order: str | None = None) -> DataFrame:
    """Write the accepted values of ``decisions`` (key, column, imputed, accepted) into their cells.

    Of several accepted values for one cell the one with the largest ``order``, a column of ``decisions`` such as the
    time of the decision, is written; without it, or where it is equal, the larger text. A value that does not fit the
    type of its column is left out.
    """
    names = [c for c in df.columns if c not in key]
    new, turn = F.trim("imputed"), F.col(order) if order else F.lit(0)
    written = decisions.filter("accepted").groupBy(*key).agg(*[
        F.max_by(new, F.when((F.col("column") == c) & new.isNotNull(), F.struct(turn, new))).alias(f"_new_{c}") for c in names
    ])
    joined = df.join(written, key, "left")

    def cell(name: str) -> Column:
        new = F.col(f"_new_{name}")
        if not isinstance(df.schema[name].dataType, T.StringType):
            new = new.try_cast(df.schema[name].dataType)
        return F.coalesce(new, quoted(name)).alias(name)

    return joined.select(*[quoted(c) if c in key else cell(c) for c in df.columns])


def review_all(decisions: DataFrame, accept: bool) -> DataFrame:
    """Accept or reject everything in the queue."""
    return decisions.withColumn("accepted", F.lit(accept))

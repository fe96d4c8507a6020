"""Exact quantiles (linear interpolation) by radix selection.

Doubles become 64-bit keys of the same order. Each scan counts, per group, the next digit of the keys that begin with
what is known of a wanted rank; the digit whose counts reach the rank is known then. After a fixed number of scans the
keys are known as a whole. Counts are added up per task, so no row is shuffled and no group is gathered.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from greenframe.session import checkpointed

#: Bits of a digit: four scans, and at most 65,536 counts per wanted value in each.
BITS = 16
#: What is known of the wanted ranks goes to all tasks while there are at most so many; beyond, it is joined by a shuffle.
MOST_SENT = 200_000
#: Columns that one scan counts, half a MB of a task for each wanted rank.
MOST_COLUMNS = 24


def _keys(values: np.ndarray) -> np.ndarray:
    bits = values.view("int64")
    keys = np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)
    return np.where(np.isnan(values), np.int64((1 << 63) - 1), keys)


@F.pandas_udf(T.LongType())
def _turned_bits(value: pd.Series) -> pd.Series:
    return pd.Series(_keys(value.to_numpy("float64")))


def ordered_key(value: Column) -> Column:
    """A long for each double, in the same order: its bits, turned for negative numbers; NaN is last.

    Read from memory, not worked out: as an expression of logarithms and powers it was most of the time of a scan.
    """
    return F.when(value.isNotNull(), _turned_bits(value + F.lit(0.0)))


def of_key(key: Column) -> Column:
    """The double of an ordered_key()."""
    bits = F.when(key < 0, -key - 1).otherwise(key)
    exponent, mantissa = F.shiftright(bits, 52), bits.bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    size = F.when(exponent == 0, mantissa * F.lit(2.0**-1074)).when(bits == F.lit(0x7FF << 52), F.lit(float("inf"))).otherwise(
        (1 + mantissa / F.lit(2.0**52)) * F.pow(F.lit(2.0), (exponent - 1023).cast("double"))
    )
    return F.when(key == F.lit((1 << 63) - 1), F.lit(float("nan"))).when(key < 0, -size).otherwise(size)


def digit_counts(rows: DataFrame, begins: DataFrame, known: int, sent: bool) -> DataFrame:
    """(_g, _p, _d, _c): how many keys (_g, _k) whose first ``known`` bits are in ``begins`` have which next digit."""
    begun = rows.withColumn("_p", F.shiftright("_k", 64 - known)).join(F.broadcast(begins) if sent else begins, ["_g", "_p"])
    digit = F.shiftright("_k", 64 - known - BITS).bitwiseAND(F.lit((1 << BITS) - 1))
    return begun.select("_g", "_p", digit.alias("_d")).groupBy("_g", "_p", "_d").agg(F.count(F.lit(1)).alias("_c"))


def column_digit_counts(df: DataFrame, begins: dict[str, list[int]] | None, known: int) -> DataFrame:
    """As digit_counts() where each column of ``df`` is a group and ``begins`` holds its first bits (none: no bits are known).

    A task counts whole arrays and sends at most 65,536 counts per column and beginning, so no row is unfolded into cells.
    """
    names, size = df.columns, 1 << BITS
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])  # Spark's functions of batches take no names with a point

    def counted(batches):
        found: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, column in zip(names, batch.columns):
                keys = _keys(column.drop_null().to_numpy(zero_copy_only=False) + 0.0)
                digits, first = keys >> (64 - known - BITS), keys >> (64 - known) if known else None
                # the first digit keeps the sign of the key; later ones are plain bits
                digits = digits + size // 2 if begins is None else digits & (size - 1)
                for begin in [0] if begins is None else begins.get(name, []):
                    part = digits if begins is None else digits[first == begin]
                    if len(part):
                        at = (name, begin)
                        found[at] = found.get(at, 0) + np.bincount(part, minlength=size)
        for (name, begin), counts in found.items():
            there = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(there)), pa.array(np.full(len(there), begin)), pa.array(there - size // 2 if begins is None else there), pa.array(counts[there])],
                ["name", "_p", "_d", "_c"],
            )

    sums = plain.mapInArrow(counted, "name string, _p long, _d long, _c long").groupBy("name", "_p", "_d").agg(F.sum("_c").alias("_c"))
    return sums.select(F.struct(F.col("name").alias("column")).alias("_g"), "_p", "_d", "_c")


def column_quantiles(df: DataFrame, probs: list[float]) -> DataFrame:
    """(column, q0, q1, ...): exact_quantiles() of every column of ``df`` that has values; NaN is the last value."""
    doubles = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in df.columns])

    lots = [doubles.columns[i : i + MOST_COLUMNS] for i in range(0, len(doubles.columns), MOST_COLUMNS)]

    def counts(wanted: DataFrame | None, known: int) -> DataFrame:
        begins = None
        if wanted is not None:  # two ranks per column and probability at most
            begins = {}
            for r in wanted.select("_g.column", "_p").distinct().collect():
                begins.setdefault(r["column"], []).append(r["_p"])
        return reduce(DataFrame.unionAll, [column_digit_counts(doubles.select(*[F.col(f"`{c}`") for c in lot]), begins, known) for lot in lots])

    return _selected(counts, ["column"], probs)


def exact_quantiles(df: DataFrame, group: list[str], value: str, probs: list[float]) -> DataFrame:
    """Per group one column ``q0, q1, ...`` per entry of ``probs``; nulls are left out.

    What is between two scans, a row per group and wanted rank, is kept with a checkpoint. Without ``group``, one row.
    """
    of = F.struct(*group) if group else F.struct(F.lit(1).alias("all"))
    there = df.select(*group, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    rows = there.select(of.alias("_g"), ordered_key(F.col("_v")).alias("_k"))
    sent: list[bool] = []

    def counts(wanted: DataFrame | None, known: int) -> DataFrame:
        if wanted is None:
            return rows.select("_g", F.shiftright("_k", 64 - BITS).alias("_d")).groupBy("_g", "_d").agg(F.count(F.lit(1)).alias("_c"))
        if not sent:
            sent.append(wanted.limit(MOST_SENT + 1).count() <= MOST_SENT)
        return digit_counts(rows, wanted.select("_g", "_p").distinct(), known, sent[0])

    return _selected(counts, group, probs)


def _selected(counts: Callable[[DataFrame | None, int], DataFrame], group: list[str], probs: list[float]) -> DataFrame:
    """The quantiles, given the digit counts of the keys that begin with what is known of the wanted ranks (at first nothing)."""
    position = lambda p: F.lit(p) * (F.col("_n") - 1)

    def reached(found: DataFrame, key: list[str], wanted: DataFrame | None) -> DataFrame:
        """The digit that each wanted rank falls into, and the rank among the values with it."""
        upto = F.sum("_c").over(Window.partitionBy(*key).orderBy("_d").rowsBetween(Window.unboundedPreceding, 0))
        steps = found.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_c"))
        if wanted is None:
            steps = steps.withColumn("_n", F.sum("_c").over(Window.partitionBy(*key)))
            ranks = [f(position(p)).cast("long") for p in probs for f in (F.floor, F.ceil)]
            steps = steps.withColumn("_rank", F.explode(F.array_distinct(F.array(*ranks)))).withColumn("_left", F.col("_rank"))
            steps = steps.withColumn("_p", F.lit(0).cast("long"))
        else:
            steps = steps.join(wanted, key)
        hit = steps.filter((F.col("_left") >= F.col("_from")) & (F.col("_left") < F.col("_to")))
        known = F.shiftleft("_p", BITS) + F.col("_d")
        return checkpointed(hit.select("_g", "_n", "_rank", known.alias("_p"), (F.col("_left") - F.col("_from")).alias("_left")))

    wanted = reached(counts(None, 0), ["_g"], None)
    for known in range(BITS, 64, BITS):
        wanted = reached(counts(wanted, known), ["_g", "_p"], wanted)
    found = wanted.select("_g", "_n", "_rank", of_key(F.col("_p")).alias("_v"))
    at = lambda rank: F.max(F.when(F.col("_rank") == rank, F.col("_v")))
    sides = [(F.floor(position(p)), F.ceil(position(p)), position(p) - F.floor(position(p))) for p in probs]
    ends = [x for i, (low, high, part) in enumerate(sides) for x in (at(low).alias(f"_l{i}"), at(high).alias(f"_h{i}"), F.max(part).alias(f"_s{i}"))]
    ends = found.groupBy("_g").agg(*ends) if group else found.agg(*ends)
    between = [F.when(F.col(f"_l{i}") == F.col(f"_h{i}"), F.col(f"_l{i}")).otherwise(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_s{i}")) for i in range(len(probs))]
    return ends.select(*([f"_g.{c}" for c in group] if group else []), *[x.alias(f"q{i}") for i, x in enumerate(between)])

"""Ordered per-run computations as a segmented scan: no run, however long or dense, is one task's.

``Window.partitionBy(run)`` sends one run to one task. A run with more than a fair share of all rows is cut at places
sampled from its own rows, so that each part holds about one share, whatever its time axis looks like (bursts and equal
times are cut by the tie breakers). Windows run per (run, part); what passes from part to part (last time, running
total, row count) is one carry row per part of such a run. There are at most twice as many of these as shares.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from greenframe.functions.numeric import bisect_right
from greenframe.session import checkpointed

PART = "_part"
KEY = "_run_part"
#: Sampled rows per share: a part is within a few tenths of a share.
SAMPLED = 64


def epoch_micros(df: DataFrame, time: str) -> Column:
    """Microseconds since the epoch; time zone free timestamps count as UTC."""
    kind = dict(df.dtypes)[time]
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(time))
    return F.unix_micros(F.col(time).cast("timestamp"))


def shares(df: DataFrame, parts: int | None = None) -> int:
    """Into how many shares the rows are thought cut: ``parts``, or as many as a shuffle has partitions."""
    return parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def place(df: DataFrame, time: str, tie: list[str]) -> Column:
    """Where a row stands in its run."""
    return F.struct(epoch_micros(df, time).alias("t"), *[F.col(c) for c in tie])


class Cuts:
    """Where the long runs of a table are cut: a small table (_of, _cuts), at most ``most`` cuts each."""

    def __init__(self, table: DataFrame, group: list[str], most: int, share: int):
        self.table, self.group, self.most, self.share = table, group, most, share


def long_runs(df: DataFrame, group: list[str], time: str, tie: list[str], parts: int | None = None) -> Cuts | None:
    """The cuts of runs with more than a fair share of the rows; None where there is no such run."""
    parts = shares(df, parts)
    of = F.struct(*group)
    sizes = df.groupBy(of.alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    total, longest = sizes.agg(F.sum("_n"), F.max("_n")).first()
    share = max(1, math.ceil((total or 0) / parts))
    if (longest or 0) <= share:
        return None
    # fewer than ``parts`` runs are longer than a share
    long = checkpointed(sizes.filter(F.col("_n") > share))
    rows = df.select(of.alias("_of"), place(df, time, tie).alias("_at")).join(F.broadcast(long), "_of")
    picked = rows.filter(F.pmod(F.xxhash64("_of", "_at"), F.lit(share)) < SAMPLED)
    marks = picked.groupBy("_of", "_n").agg(F.sort_array(F.collect_set("_at")).alias("_s"))
    pieces = F.ceil(F.col("_n") / share).cast("int")
    at = F.transform(F.sequence(F.lit(1), pieces - 1), lambda i: F.get("_s", F.floor(i * F.size("_s") / pieces).cast("int")))
    cuts = marks.filter(F.size("_s") > 1).select("_of", F.array_sort(F.array_distinct(at)).alias("_cuts"))
    return Cuts(checkpointed(cuts), list(group), math.ceil(longest / share), share)


class OrderedRuns:
    """Rows of ``df`` ordered by ``time`` and then ``tie`` within each ``group``.

    ``cuts`` is what :func:`long_runs` returned for these rows or for a superset of them, by all or some of the
    columns of ``group``; None stands for plain windows.
    """

    def __init__(self, df: DataFrame, group: list[str], time: str, tie: list[str], cuts: Cuts | None):
        self.group, self.order = list(group), [time, *tie]
        self.cut = cuts is not None
        if cuts:
            found = df.withColumn("_of", F.struct(*cuts.group)).join(F.broadcast(cuts.table), "_of", "left")
            part = F.when(F.col("_cuts").isNull(), F.lit(-1)).otherwise(bisect_right(F.col("_cuts"), place(df, time, tie), cuts.most))
            # one key column for windows, totals and the join back, so that the long side is shuffled once
            self.df = found.withColumn(KEY, F.struct(*self.group, part.alias(PART))).drop("_of", "_cuts")
            self.keys = [KEY]
        else:
            self.df, self.keys = df, self.group
        self.within = Window.partitionBy(*self.keys).orderBy(*self.order)
        self.across = Window.partitionBy(*self.group).orderBy(PART)

    def per_part(self, *aggregates: Column) -> DataFrame:
        """One row per part of a run: the key, its fields and ``aggregates``. Runs that are not cut are one part, -1."""
        totals = self.df.groupBy(KEY).agg(*aggregates)
        return totals.select(KEY, f"{KEY}.*", *[c for c in totals.columns if c != KEY])

    def carried(self, totals: DataFrame, *carries: Column) -> DataFrame:
        """What each part takes over from those before it; only parts of long runs have such a row."""
        return F.broadcast(totals.filter(F.col(PART) >= 0).select(KEY, *carries))

    def with_previous(self, value: Column, name: str) -> DataFrame:
        """Add ``name``: ``value`` of the row before, null for the first row of a group.

        ``value`` must not decrease along the order and must not be null.
        """
        rows = self.df.withColumn(name, F.lag(value).over(self.within))
        if not self.cut:
            return rows
        lasts = self.per_part(F.max(value).alias("_last"))
        carry = self.carried(lasts, F.lag("_last").over(self.across).alias("_carry"))
        return rows.join(carry, KEY, "left").withColumn(name, F.coalesce(name, "_carry")).drop(KEY, "_carry")

    def with_running_sums(self, sums: dict[str, Column]) -> DataFrame:
        """Add one running total per entry of ``sums``."""
        upto = self.within.rowsBetween(Window.unboundedPreceding, 0)
        rows = self.df.withColumns({name: F.sum(value).over(upto) for name, value in sums.items()})
        if not self.cut:
            return rows
        before = self.across.rowsBetween(Window.unboundedPreceding, -1)
        totals = self.per_part(*[F.sum(value).alias(f"_t_{name}") for name, value in sums.items()])
        carry = self.carried(totals, *[F.sum(f"_t_{name}").over(before).alias(f"_c_{name}") for name in sums])
        added = {
            name: F.coalesce(F.col(name) + F.col(f"_c_{name}"), F.col(name), F.col(f"_c_{name}"))
            for name in sums
        }
        return rows.join(carry, KEY, "left").withColumns(added).drop(KEY, *[f"_c_{name}" for name in sums])

    def with_row_numbers(self, name: str) -> DataFrame:
        if not self.cut:
            return self.df.withColumn(name, F.row_number().over(self.within).cast("long"))
        return self.with_running_sums({name: F.lit(1).cast("long")})

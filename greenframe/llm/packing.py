"""Packing of documents into sequences of bounded length by minimum bin slack.

The lengths of all pieces are counted first. Which lengths go together depends on these counts alone (one number per
possible length), so the bins are solved as patterns, each with the number of times it is used, and the pieces then
find their places in parallel by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL_BATCH, id_and_text, written
from .units import library_ids, tokenizer_path


def token_pieces(df: DataFrame, vocabulary: str, drops_space: bool, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document: its ids and then ``end_id``, cut from the end into pieces of ``capacity``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = library_ids(tokenizer_path(vocabulary), drops_space)
        for batch in batches:
            out = ([], [], [], [], [])
            for doc_id, found in zip(batch.column(0).to_pylist(), library.each(batch.column(1).to_pylist())):
                ids = np.append(found.astype("<u4"), np.uint32(end_id)).astype("<u4")
                starts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    for column, value in zip(out, (doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_text(df, id_col, text_col).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], order: list[int], capacity: int, first: int) -> dict[int, int]:
    """The lengths of a bin that holds ``first`` and is as full as the others allow.

    Subset sums as bits of one integer: bit s is set when some choice of lengths adds up to s. Each length enters in
    portions of 1, 2, 4, ... copies, and the walk back through the portions yields the choice.
    """
    room = capacity - first
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for length in order:
        copies = min(counts[length] - (length == first), room // length) if length <= room else 0
        portion = 1
        while copies > 0:
            take = min(portion, copies)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            copies -= take
            portion *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {first: 1}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


@dataclass
class Pattern:
    lengths: dict[int, int]
    bins: int


def minimum_slack(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Bins for so many pieces of each length: the largest length left, with what fills its bin best, as often as it goes."""
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths must be between 1 and {capacity}")
    left, patterns = {k: n for k, n in counts.items() if n}, []
    order = sorted(left, reverse=True)
    while order:
        chosen = fullest(left, order, capacity, order[0])
        times = min(left[k] // n for k, n in chosen.items())
        patterns.append(Pattern(chosen, times))
        for k, n in chosen.items():
            left[k] -= n * times
        order = [k for k in order if left[k]]
    return patterns


def pack(pieces: DataFrame, capacity: int, order_by: list[str]) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length`` of 1 to ``capacity``.

    ``pieces`` must give the same rows when read again (a written table); ``order_by`` tells its rows apart, as far as
    they differ. Ranks are counted within (length, salt) and moved up by the counts of the salts before, so a length
    that a third of all pieces has is spread over as many tasks as there are shuffle partitions.
    """
    spark = pieces.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order_by), F.lit(salts)).cast("int"))
    per_salt = written(rows.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    # one row per possible length: bounded by the capacity
    counts = {r["length"]: r["n"] for r in per_salt.groupBy("length").agg(F.sum("_n").alias("n")).collect()}

    slots, first_bin = [], 0  # length, first rank, copies in a bin, first bin, offset in the bin
    used = dict.fromkeys(counts, 0)
    for pattern in minimum_slack(counts, capacity):
        offset = 0
        for length, copies in pattern.lengths.items():
            slots.append((length, used[length], copies, first_bin, offset))
            used[length] += copies * pattern.bins
            offset += length * copies
        first_bin += pattern.bins
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 5).T
    shift = np.int64(1) << np.int64(44)
    keys = table[0] * shift + table[1]

    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = per_salt.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_salt").orderBy(*order_by)
    ranked = rows.withColumn("_rank", F.row_number().over(within).cast("long")).join(base, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_rank") - 1 + F.col("_base")).select(*pieces.columns, "_rank")
    schema = pieces.schema.simpleString()[len("struct<") : -1]

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            length, rank = frame["length"].to_numpy(np.int64), frame.pop("_rank").to_numpy(np.int64)
            at = np.searchsorted(keys, length * shift + rank, "right") - 1
            copies, nth = table[2][at], rank - table[1][at]
            yield frame.assign(sequence_id=table[3][at] + nth // copies, offset=table[4][at] + nth % copies * length)

    return ranked.mapInPandas(placed, f"{schema}, sequence_id long, offset long") if slots else pieces.selectExpr("*", "0L AS sequence_id", "0L AS offset")


def packed_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", drops_space: bool = False, end_id: int = 0, capacity: int = 2048
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents are tokenised, closed with ``end_id`` and, only if longer than ``capacity``, cut into pieces of
    ``capacity`` (the first one takes the remainder). Sequences have no gaps. Null and empty texts are one piece of one
    id. Repeated rows are packed each. An empty table gives no rows. ``doc_id`` may be null. To the driver come the
    counts per length only (at most ``capacity`` numbers), and the slots sent back are bounded by them.
    """
    pieces = written(token_pieces(df, vocabulary, drops_space, end_id, capacity, id_col, text_col), "pieces", batch=SMALL_BATCH)
    return pack(pieces, capacity, ["doc_id", "piece", "start", "ids_crc32"])

"""Exact duplicates: groups of one 128-bit content hash, whose members are compared byte by byte."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_and_text, one_space, written


def content_hash(text: Column) -> Column:
    """128 bits of the normalised text."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space; null counts as empty. The smallest
    id of a group stays. Ids and hashes alone are shuffled to find the groups (added up per task first, so a group with
    a third of all rows is no burden); only groups of two and more send their texts on, each member joined to the text
    of the row that stays. A member that differs from it (a collision of the hash) is grouped by its text itself.

    Defined results: an empty table gives no rows; rows with a null id never stay unless all ids of the group are null
    (keep_id is null then); rows that repeat both id and text are counted each and marked alike.
    """
    rows = id_and_text(df, id_col, text_col).withColumn("text", one_space(F.col("text")))
    rows = rows.select("doc_id", hash_of(F.col("text")).alias("h"), "text")
    sha256 = F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    # ids and hashes are kept, so that texts are read and hashed once for them and once for the groups
    light = written(rows.select("doc_id", "h", sha256), "hashes")
    groups = light.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    alone = light.join(groups.filter("n = 1").select("h"), "h").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )

    # nothing that needs all rows of a hash together stands above this join, so a large group can be split
    members = written(rows.join(groups.filter("n > 1").select("h", "first_id"), "h"), "members")
    stays = members.filter(F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("h").agg(F.min("text").alias("stays"))
    compared = written(
        members.join(stays, "h").select("doc_id", "h", F.when(F.col("text") != F.col("stays"), F.col("text")).alias("other"), sha256), "compared"
    )
    sizes = compared.groupBy("h", "other").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    sizes = sizes.select(F.col("h").alias("gh"), F.col("other").alias("go"), "keep_id", "group_size")
    together = compared.join(sizes, (F.col("h") == F.col("gh")) & F.col("other").eqNullSafe(F.col("go"))).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(together)


def without_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text has no equal with a smaller id, with all their columns.

    Rows go by id and text, so of rows that share an id, or have none, only the copies go. Of equal rows without an id,
    where no row with an id has their text, one stays.
    """
    gone, gone_text, sha256 = fresh("gone"), fresh("text"), fresh("sha256")
    dropped = exact_groups(df, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias(gone), F.col("text_sha256").alias(gone_text)).distinct()
    text = one_space(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    keyed = df.withColumn(sha256, F.sha2(text.cast("binary"), 256))
    left = keyed.join(dropped, F.col(id_col).cast("long").eqNullSafe(F.col(gone)) & (F.col(sha256) == F.col(gone_text)), "left_anti")
    nameless = left.filter(F.col(id_col).cast("long").isNull()).dropDuplicates([sha256])
    return left.filter(F.col(id_col).cast("long").isNotNull()).unionByName(nameless).drop(sha256)

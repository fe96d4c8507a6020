"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from greenframe.session import scratch_path

#: Characters 9 to 13 and 32, as a class of regular expressions.
SPACE = r"\x20\x09-\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns of fixed names, so that whatever else the table has cannot clash; null texts are empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def one_space(text: Column) -> Column:
    """Each run of white space as one space. Single spaces do not match the pattern, which keeps it cheap."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus).cast("long"))


def row_key(id_col: Column, text: Column) -> Column:
    """Id and digest of the text, so that rows without an id, or of one id and different texts, are told apart."""
    return F.concat_ws(":", F.coalesce(id_col.cast("long").cast("string"), F.lit("null")), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def fresh(label: str) -> str:
    """A column name that no table has."""
    return f"_{label}_{uuid.uuid4().hex}"


#: What this Python worker keeps from task to task, by what it is for: of one operator at a time.
_kept: dict[tuple, Any] = {}


def kept_by_worker(what: tuple, make: Callable[[], Any] = lambda: None) -> Any:
    """What ``make`` gave when this Python worker was first asked for ``what``.

    Workers live on from stage to stage and from query to query. When another operator's work begins, what the last one
    kept is let go, and the memory that Arrow holds in reserve is given back: else each worker would hold the memories
    of all operators it ever ran for.
    """
    if what not in _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()
        _kept[what] = make()
    return _kept[what]


#: Spark removes an execution's shuffle files at its end where this is set.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of the rows that go to a Python worker at once.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: So many, for operators whose workers make several times as much of a text.
SMALL_BATCH = 1 << 22


def written(df: DataFrame, label: str, codec: str | None = None, batch: int | None = None) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: cuts the lineage and survives lost executors.

    What was shuffled for it is of no use afterwards, so its files go when the write has ended. ``codec`` packs the
    files in another way than the session's; ``batch`` bounds the bytes that a Python worker gets at once.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    before = {CLEANED: spark.conf.get(CLEANED, "false")} | ({BATCH: spark.conf.get(BATCH)} if batch else {})
    spark.conf.set(CLEANED, "true")
    if batch:
        spark.conf.set(BATCH, str(batch))
    try:
        df.write.parquet(path, compression=codec)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


def block_count(df: DataFrame) -> int:
    """Blocks into which a table is dealt: follows the number of input splits, so a block stays a few dozen MB."""
    parallel = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(parallel, 2 * df.rdd.getNumPartitions())

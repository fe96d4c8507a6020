"""Token ids as files of length-delimited binary records with checksums, and an index of offsets beside each file.

A record is: payload length (8 bytes), masked checksum of these 8 bytes (4), payload, masked checksum of the payload
(4), all little-endian. The checksum is CRC-32 turned right by 15 bits plus 0xa282ead8, so that a checksum stored in
data is not taken for its own. The payload holds the document's id (8 bytes), whether it has one (1), the width of a
token id (1: 2 or 4 bytes) and the token ids. The index file holds for each record its offset and the number of token
ids before it in the file (8 bytes each), so a reader can visit the records in any order.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from greenframe.session import scratch_path

from .common import id_and_text
from .units import library_ids, tokenizer_path

MASK_DELTA = 0xA282EAD8
LISTED = ["part", "name", "records", "tokens", "bytes"]


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def payload_of(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return struct.pack("<qBB", doc_id or 0, doc_id is not None, width) + ids.astype(f"<u{width}").tobytes()


def content_of(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, known, width = struct.unpack_from("<qBB", payload)
    return (doc_id if known else None), np.frombuffer(payload, f"<u{width}", offset=10).astype("<u4")


def read_record(file) -> bytes | None:
    """The payload at the file's place, None at its end; ValueError when a checksum is wrong."""
    head = file.read(12)
    if not head:
        return None
    size, check = struct.unpack("<QI", head)
    if masked(head[:8]) != check:
        raise ValueError("damaged record length")
    payload, check = file.read(size), file.read(4)
    if len(payload) != size or len(check) != 4 or masked(payload) != struct.unpack("<I", check)[0]:
        raise ValueError("damaged record")
    return payload


def store(folder: str):
    """(file system, path) for a folder URI; any store that pyarrow reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_records(df: DataFrame, folder: str, encode: str, drops_space: bool, end_id: int, partitions: int | None = None) -> DataFrame:
    """Write ``df`` (doc_id, text) in ascending order of doc_id; the list of files, written beside them, is returned.

    Rows are dealt by ranges of (doc_id, crc32 of the text), so a task holds neighbours, rows that share an id are not
    bound to one task, and what is shuffled is text, not ids. Each attempt of a task writes files of its own name; the
    list names those of the attempts that succeeded, so repeated or lost tasks leave no double records.
    """
    spark = df.sparkSession
    count = partitions or max(2 * df.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.withColumn("tie", F.crc32(F.col("text").cast("binary"))).repartitionByRange(count, "doc_id", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        files, path = store(folder)
        library, records, tokens, place, index = library_ids(tokenizer_path(encode), drops_space), 0, 0, 0, []
        files.create_dir(path, recursive=True)
        with files.open_output_stream(f"{path}/{name}.rec") as out:
            for batch in batches:
                for doc_id, found in zip(batch.column(0).to_pylist(), library.each(batch.column(1).to_pylist())):
                    ids = np.append(found.astype("<u4"), np.uint32(end_id)).astype("<u4")
                    framed = frame(payload_of(doc_id, ids))
                    out.write(framed)
                    index.append((place, tokens))
                    place, records, tokens = place + len(framed), records + 1, tokens + len(ids)
        with files.open_output_stream(f"{path}/{name}.idx") as out:
            out.write(np.array(index, "<u8").tobytes())
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, name, records, tokens, place), kinds)], LISTED)

    listed = rows.sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text").mapInArrow(write, "part int, name string, records long, tokens long, bytes long")
    listed.write.parquet(f"{folder}/files")
    return spark.read.parquet(f"{folder}/files")


def visited(source, path: str, name: str, records: int, size: int, seed: int | None) -> Iterator[tuple[int, bytes]]:
    """(ids before it in the file, payload) of each record, in the file's order or, with ``seed``, in one drawn from it.

    Records are found by the index. ValueError where it does not fit the file: each record must begin at its offset and
    end at the next one, and its ids before must be those of the records before it.
    """
    index = np.frombuffer(source.open_input_file(f"{path}/{name}.idx").read(), "<u8").reshape(-1, 2).astype(np.int64)
    if len(index) != records:
        raise ValueError(f"{name}: {len(index)} of {records} records in the index")
    ends = np.append(index[1:, 0], size)
    order = np.arange(records) if seed is None else np.random.default_rng([seed, zlib.crc32(name.encode())]).permutation(records)
    with source.open_input_file(f"{path}/{name}.rec") as file:
        held, begin = b"", 0
        for k in order.tolist():
            first, last = int(index[k, 0]), int(ends[k])
            if not 0 <= first < last <= size:
                raise ValueError(f"{name}: offset {first} of record {k} is wrong")
            if not begin <= first <= last <= begin + len(held):
                # in order, many records are read at once
                file.seek(first)
                held, begin = file.read(max(last - first, 1 << 20 if seed is None else 0)), first
            record = io.BytesIO(held[first - begin : last - begin])
            payload = read_record(record)
            if record.read(1):
                raise ValueError(f"{name}: record {k} does not end at the next offset")
            before = int(index[k + 1, 1]) if k + 1 < records else None
            if before is not None and before - int(index[k, 1]) != len(content_of(payload)[1]):
                raise ValueError(f"{name}: ids before record {k + 1} are wrong")
            yield int(index[k, 1]), payload


def read_records(spark: SparkSession, folder: str, seed: int | None = None) -> DataFrame:
    """One row per record: doc_id, start (ids of all records before it), n_tokens, ids_crc32, ids.

    With ``seed``, each file's records come in an order drawn from it, found by the index; their rows are the same.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = spark.read.parquet(f"{folder}/files").filter("records > 0").withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    files = files.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "name")

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, path = store(folder)
        for batch in frames:
            for name, start, records, size in zip(*(batch.column(x).to_pylist() for x in ("name", "before", "records", "bytes"))):
                rows, held = [], 0
                for place, payload in visited(source, path, name, records, size, seed):
                    doc_id, ids = content_of(payload)
                    rows.append({"doc_id": doc_id, "start": start + place, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes()), "ids": ids})
                    held += len(ids)
                    if held > 1 << 20:
                        yield record_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield record_batch(rows)

    return files.select("name", "before", "records", "bytes").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def record_batch(rows: list[dict]) -> pa.RecordBatch:
    offsets = np.cumsum([0, *(len(r["ids"]) for r in rows)]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([r["ids"] for r in rows]).view(np.int32)))
    plain = [pa.array([r[c] for r in rows], pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")]
    return pa.RecordBatch.from_arrays([*plain, ids], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def stored_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", drops_space: bool = True, end_id: int = 1) -> DataFrame:
    """Write all documents as records below the shared folder and read them back; as read_records().

    Null and empty texts give a record of the end id alone; rows without an id come first and stay without; rows that
    repeat an id keep a fixed order (by text) and have a record each; an empty table gives files without records.
    """
    folder = scratch_path(df.sparkSession, "records")
    write_records(id_and_text(df, id_col, text_col), folder, vocabulary, drops_space, end_id)
    return read_records(df.sparkSession, folder)

"""Repeated byte strings: a depth-limited radix sort of suffixes, most significant digit first.

Like ``repeats``, whose anchors and buckets it shares, but by arrays over the bytes of a block, so that what a worker
holds follows the bytes it was given and not how many of them repeat:

1. Texts are cut into chunks at places that depend on a few bytes only. Blocks send the hashes of their chunks to
   buckets, then the text of those that another document has too. There they are radix-sorted to their whole length;
   the windows of a chunk that a smaller document also has are covered, and stand for nothing that it doesn't.
2. Of the windows left, blocks send the anchors, then the spans around anchors that occur in two and more documents;
   windows of an anchor in very many documents go one by one. Spans are radix-sorted to their whole length, and where
   an anchor has different ones the suffixes of each to the depth of a window.
3. Each block takes out what is covered.

Hashes only choose buckets and where to cut; what is equal is decided by the digits of the text.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, written
from .repeats import AGAIN, MIX, NO_ID, bucket_and_tag, gram_hashes, mixed, slices, smallest_within

BYTES, GRAM, VERY_MANY = 50, 26, 5000
DIGIT = 8
#: Bytes of text in a block, on average; symbols that are hashed at once.
BLOCK, SEGMENT = 1 << 23, 1 << 17
#: Spans that a block sends at once; spans sorted at once, about 13 windows each.
MOST_ITEMS, AT_ONCE = 1 << 17, 10_000
#: Bytes of a chunk: at least, at most, and how many more until the next place to cut, on average.
CHUNK_LEAST, CHUNK_MOST, CHUNK_MORE = 128, 2048, 256
NUMBERS = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)


def digits(data: np.ndarray) -> np.ndarray:
    """The digit (eight bytes) that begins at each place of ``data``, which ends with DIGIT zero bytes."""
    return np.lib.stride_tricks.as_strided(data, (len(data) - DIGIT + 1, DIGIT), (1, 1))


def first_equal(data: np.ndarray, place: np.ndarray, length: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """For each suffix, the first one of its group that has the same ``length`` and is equal to that depth (or itself).

    All are ordered by group and length, then each group of equals by the next digit, down to its length; what is
    alone in its group leaves after each pass.
    """
    eight, first = digits(data), np.arange(len(place))
    live, equal = first, length.astype(np.int64)
    if group is not None:
        equal = np.unique(group, return_inverse=True)[1] * (int(length.max(initial=0)) + 1) + equal
    order = np.argsort(equal, kind="stable")
    live, equal = live[order], equal[order]
    digit, depth = np.zeros(len(live), np.uint64), 0
    while len(live):
        begins = np.flatnonzero(np.append(True, (equal[1:] != equal[:-1]) | (digit[1:] != digit[:-1])))
        sizes = np.diff(np.append(begins, len(live)))
        # within a group suffixes keep their order, so its first one leads
        leads, equal = np.repeat(live[begins], sizes), np.repeat(np.arange(len(begins)), sizes)
        sorted_out = length[live] <= depth
        first[live[sorted_out]] = leads[sorted_out]
        stay = np.repeat(sizes > 1, sizes) & ~sorted_out
        live, equal = live[stay], equal[stay]
        digit = np.ascontiguousarray(eight[place[live] + depth]).view(">u8").ravel().astype(np.uint64)
        beyond = np.maximum(depth + DIGIT - length[live], 0).astype(np.uint64)
        digit >>= np.uint64(8) * beyond
        depth += DIGIT
        order = np.lexsort((digit, equal))
        live, equal, digit = live[order], equal[order], digit[order]
    return first


def window_ranges(data: np.ndarray, place: np.ndarray, length: np.ndarray, docs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(span, first byte, end) of the runs of windows of each span that a smaller document has too; spans by ascending document."""
    counts = length - size + 1
    owner = np.repeat(np.arange(len(place)), counts)
    window = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = first_equal(data, place[owner] + window, np.full(len(owner), size))
    hits = np.flatnonzero(docs[owner] > docs[owner[first]])
    edge = np.flatnonzero((np.diff(hits) != 1) | (np.diff(owner[hits]) != 0))
    begin, end = hits[np.append(0, edge + 1)[: len(hits)]], hits[np.append(edge, len(hits) - 1)[: len(hits)]]
    return owner[begin], window[begin], window[end] + size


@dataclass
class Texts:
    """The documents of a block, by id and then text: the same order in each pass."""

    docs: np.ndarray  # id of each document; without one: NO_ID
    starts: np.ndarray  # first byte of each document, and the end
    data: np.ndarray  # their bytes, and so many zero bytes that the last digit can be read

    @property
    def size(self) -> int:
        return int(self.starts[-1])


def texts_of(table: pa.Table) -> Texts:
    table = table.select(["doc_id", "text"]).take(pc.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")]))
    text = table.column("text").cast(pa.large_binary()).combine_chunks()
    text = pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.zeros(int(ends[-1] - ends[0]) + DIGIT, np.uint8)
    if len(data) > DIGIT:
        data[:-DIGIT] = np.frombuffer(text.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return Texts(table.column("doc_id").to_numpy().astype(np.int64), ends - ends[0], data)


def chunks(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, bytes, document's place) of each chunk: each window of ``size`` begins in one, which holds it whole."""
    places, lengths, owners = [], [], []
    eight = digits(texts.data)
    cuts: list[int] = []
    for begin in range(0, texts.size, SEGMENT):
        digit = np.ascontiguousarray(eight[begin : min(begin + SEGMENT, texts.size)]).view("<u8").ravel()
        cuts += (np.flatnonzero(mixed(digit * MIX) % np.uint64(CHUNK_MORE) == 0) + begin).tolist()
    for doc, (a, b) in enumerate(zip(texts.starts[:-1].tolist(), texts.starts[1:].tolist())):
        last, at = b - size, bisect_left(cuts, a)
        while a <= last:
            at = bisect_left(cuts, a + CHUNK_LEAST, at)
            end = min(cuts[at] if at < len(cuts) else b, a + CHUNK_MOST, last + 1)
            places.append(a)
            lengths.append(end - a + size - 1)
            owners.append(doc)
            a = end
    return np.array(places, np.int64), np.array(lengths, np.int64), np.array(owners, np.int64)


def chunk_keys(texts: Texts, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    view = memoryview(texts.data)
    found = [hashlib.blake2b(view[a : a + n], digest_size=8).digest() for a, n in zip(places.tolist(), lengths.tolist())]
    return np.frombuffer(b"".join(found), np.uint64)


class Ranges:
    """Ranges of the bytes of a block that do not overlap, in ascending order."""

    def __init__(self, begins: np.ndarray, ends: np.ndarray):
        order = np.argsort(begins)
        self.begins, self.ends = begins[order].astype(np.int64), ends[order].astype(np.int64)

    def mark(self, begin: int, end: int) -> np.ndarray:
        """Whether each byte from ``begin`` to ``end`` is in one."""
        some = slice(np.searchsorted(self.ends, begin, "right"), np.searchsorted(self.begins, end))
        change = np.zeros(end - begin + 1, np.int8)
        np.add.at(change, np.maximum(self.begins[some], begin) - begin, 1)
        np.add.at(change, np.minimum(self.ends[some], end) - begin, -1)
        return np.cumsum(change[:-1], dtype=np.int8) > 0


def windows(texts: Texts, size: int) -> Ranges:
    """Where windows begin: they must end in the same document."""
    long = np.diff(texts.starts) >= size
    return Ranges(texts.starts[:-1][long], texts.starts[1:][long] - size + 1)


@dataclass
class Anchors:
    """Runs of neighbouring windows with the same anchor, of a segment of a block."""

    first: np.ndarray  # first window, and how many
    count: np.ndarray
    key: np.ndarray  # 64-bit hash of the anchor
    doc: np.ndarray  # its document's place in the block


def anchors(texts: Texts, settled: Ranges, gram: int, size: int) -> Iterator[tuple[Anchors, np.ndarray]]:
    """Of the windows that are not settled, by segments, with the hashes of the segment's bytes."""
    inside, reach = windows(texts, size), size - gram + 1
    for begin in range(0, texts.size - size + 1, SEGMENT):
        symbols = NUMBERS[texts.data[begin : min(begin + SEGMENT + size - 1, texts.size)]]
        count = len(symbols) - size + 1
        there = np.flatnonzero(inside.mark(begin, begin + count) & ~settled.mark(begin, begin + count))
        if not len(there):
            continue
        grams = gram_hashes(symbols, gram)
        least = smallest_within((grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64), reach)
        at = (least[there] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        edge = np.append(0, np.flatnonzero((np.diff(at) != 0) | (np.diff(there) != 1)) + 1)
        first = there[edge] + begin
        doc = np.searchsorted(texts.starts, first, "right") - 1
        yield Anchors(first, np.diff(np.append(edge, len(there))), mixed(grams[at[edge]] * MIX), doc), symbols


def pack(values: np.ndarray, kind: type) -> bytes:
    return values.astype(kind).tobytes()


def unpacked(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts])


def table_of(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(x, kind) for x, kind in zip(zip(*rows) if rows else [()] * len(schema), schema.types)], schema=schema)


def columns(numbers: str, texts: str) -> pa.Schema:
    return pa.schema([(x, pa.int32()) for x in numbers.split()] + [(x, pa.binary()) for x in texts.split()])


def as_text(schema: pa.Schema) -> str:
    return ", ".join(f"{x.name} {'int' if x.type == pa.int32() else 'binary'}" for x in schema)


KEYS = columns("bucket block", "tags counts")
SHARED = columns("block bucket", "tags many")
ITEMS = columns("bucket block", "tags docs lengths held texts starts local_starts local_ends")
COVERS = columns("block", "starts ends")
#: Either of two kinds of answer to a block.
ANSWERS = columns("block bucket", "tags many starts ends")


def key_rows(block: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    """How many documents of a block have each key, by bucket."""
    bucket, tag = bucket_and_tag(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, tag, counts = bucket[order], tag[order], np.minimum(counts[order], 65535)
    return table_of(KEYS, [(b, block, tag[i:j].tobytes(), pack(counts[i:j], np.uint16)) for b, i, j in slices(bucket)])


def documents_of(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, and how many documents have each; the documents are in ascending order."""
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1]))[: len(keys)]
    return np.unique(keys[new], return_counts=True)


def shared_rows(bucket: int, sent: pa.Table, very_many: int) -> pa.Table:
    """For each block, those of its keys that two and more documents have, and whether very many do."""
    tags, counts = unpacked(sent.column("tags"), np.uint32), joined(unpacked(sent.column("counts"), np.uint16), np.uint16)
    inverse = np.unique(np.concatenate(tags), return_inverse=True)[1]
    total = np.bincount(inverse, counts)[inverse]
    rows, begin = [], 0
    for block, own in zip(sent.column("block").to_pylist(), tags):
        n = total[begin : begin + len(own)]
        begin += len(own)
        if (n > 1).any():
            rows.append((block, bucket, own[n > 1].tobytes(), (n[n > 1] >= very_many).tobytes()))
    return table_of(SHARED, rows)


class Wanted:
    """The keys of a block that other documents have too."""

    def __init__(self, shared: pa.Table, buckets: int):
        self.buckets = buckets
        found = [t.astype(np.uint64) | np.uint64(b) << np.uint64(32) for b, t in zip(shared.column("bucket").to_pylist(), unpacked(shared.column("tags"), np.uint32))]
        known, many = joined(found, np.uint64), joined(unpacked(shared.column("many"), bool), bool)
        order = np.argsort(known)
        self.known, self.many = known[order], many[order]

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is one of them, and in very many documents."""
        if not len(self.known):
            return np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        bucket, tag = bucket_and_tag(keys, self.buckets)
        own = tag.astype(np.uint64) | bucket.astype(np.uint64) << np.uint64(32)
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        there = self.known[at] == own
        return there, there & self.many[at]


def item_rows(block: int, texts: Texts, keys: np.ndarray, places: np.ndarray, lengths: np.ndarray, owners: np.ndarray, buckets: int) -> list[tuple]:
    """Stretches of text, by ascending document: equal ones go once, with the smallest document of the block.

    Those of its further documents are covered in any case.
    """
    first = first_equal(texts.data, places, lengths, keys)
    docs = texts.docs[owners]
    further = docs > docs[first]
    order = np.flatnonzero(~further)
    bucket, tag = bucket_and_tag(keys[order], buckets)
    order = order[np.lexsort((order, first[order], bucket))]
    bucket, tag = bucket_and_tag(keys[order], buckets)
    rows = []
    local = pack(places[further], np.uint32), pack((places + lengths)[further], np.uint32)
    for to, i, j in slices(bucket):
        own = order[i:j]
        new = np.flatnonzero(np.append(True, first[own[1:]] != first[own[:-1]]))
        lead = own[new]
        size = lengths[lead]
        index = np.arange(size.sum()) + np.repeat(places[lead] - np.cumsum(size) + size, size)
        held = np.diff(np.append(new, len(own)))
        rows.append((to, block, tag[i:j][new].tobytes(), pack(docs[lead], np.int64), pack(size, np.uint16), pack(held, np.uint32), texts.data[index].tobytes(), pack(places[own], np.uint32), *local))
        local = b"", b""
    return rows


def settled_rows(sent: pa.Table, size: int, by_window: bool) -> pa.Table:
    """For each block, what is covered of the stretches that it sent.

    A stretch equal to that of a smaller document is covered as a whole. With ``by_window`` different ones of one tag
    are also compared window by window.
    """
    tags, docs = unpacked(sent.column("tags"), np.uint32), joined(unpacked(sent.column("docs"), np.int64), np.int64)
    row = np.repeat(np.arange(len(tags)), [len(x) for x in tags])
    tag = joined(tags, np.uint32)
    length, held = (joined(unpacked(sent.column(x), kind), kind).astype(np.int64) for x, kind in (("lengths", np.uint16), ("held", np.uint32)))
    data = joined([*unpacked(sent.column("texts"), np.uint8), np.zeros(DIGIT, np.uint8)], np.uint8)
    starts = joined(unpacked(sent.column("starts"), np.uint32), np.uint32)
    place, at = np.cumsum(length) - length, np.cumsum(held) - held
    covers: list[tuple] = [([a], [b]) for a, b in zip(unpacked(sent.column("local_starts"), np.uint32), unpacked(sent.column("local_ends"), np.uint32))]

    def cover(items: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """From ``begin`` to ``end`` of each item, wherever it is."""
        order = np.argsort(row[items], kind="stable")
        items, begin, end = items[order], begin[order], end[order]
        for r, i, j in slices(row[items]):
            times = held[items[i:j]]
            index = np.arange(times.sum()) + np.repeat(at[items[i:j]] - np.cumsum(times) + times, times)
            covers[r][0].append((starts[index] + np.repeat(begin[i:j], times)).astype(np.uint32))
            covers[r][1].append((starts[index] + np.repeat(end[i:j], times)).astype(np.uint32))

    order = np.lexsort((docs, tag))
    edges = np.flatnonzero(np.diff(tag[order])) + 1
    begin, whole, parts = 0, [], []
    while begin < len(order):
        # whole tags, until there are AT_ONCE
        k = np.searchsorted(edges, begin + AT_ONCE)
        end = int(edges[k]) if k < len(edges) else len(order)
        own = order[begin:end]
        begin = end
        first = first_equal(data, place[own], length[own], tag[own])
        lead = own[first]
        whole.append(own[docs[own] > docs[lead]])
        if not by_window:
            continue
        alone = np.flatnonzero(first == np.arange(len(own)))  # one of each
        times = np.unique(tag[own[alone]], return_counts=True)[1]
        alone = alone[np.repeat(times > 1, times)]
        spans = own[alone]
        if not len(spans):
            continue
        span, a, b = window_ranges(data, place[spans], length[spans], docs[spans], size)
        if not len(span):
            continue
        # what holds of a span holds of the equal ones of the same document
        bounds = np.searchsorted(span, np.arange(len(spans) + 1))
        number = np.full(len(own), -1)
        number[alone] = np.arange(len(spans))
        same = np.flatnonzero((docs[own] == docs[lead]) & (number[first] >= 0))
        times = bounds[number[first[same]] + 1] - bounds[number[first[same]]]
        index = np.arange(times.sum()) + np.repeat(bounds[number[first[same]]] - np.cumsum(times) + times, times)
        parts.append((np.repeat(own[same], times), a[index], b[index]))
    items = joined(whole, np.int64)
    cover(items, np.zeros(len(items), np.int64), length[items])
    if parts:
        cover(*(np.concatenate(x) for x in zip(*parts)))
    rows = [(block, np.concatenate(a).tobytes(), np.concatenate(b).tobytes()) for block, (a, b) in zip(sent.column("block").to_pylist(), covers)]
    return table_of(COVERS, [x for x in rows if x[1]])


def settled_windows(answers: pa.Table, size: int) -> Ranges:
    """Windows of chunks that a smaller document has too."""
    begins, ends = (joined(unpacked(answers.column(x).drop_null(), np.uint32), np.uint32).astype(np.int64) for x in ("starts", "ends"))
    return Ranges(begins, ends - size + 1)


def span_items(texts: Texts, settled: Ranges, wanted: Wanted, gram: int, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, place, length, document's place) of what is sent of each segment."""
    for found, symbols in anchors(texts, settled, gram, size):
        there, many = wanted.of(found.key)
        one = there & ~many
        yield found.key[one], found.first[one], found.count[one] + size - 1, found.doc[one]
        if many.any():
            hashes, count = gram_hashes(symbols, size), found.count[many]
            place = np.repeat(found.first[many], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            key = mixed((hashes[place - place[0] // SEGMENT * SEGMENT] ^ AGAIN) * MIX)
            yield key, place, np.full(len(place), size), np.repeat(found.doc[many], count)


def kept_table(texts: Texts, covers: pa.Table, size: int) -> pa.Table:
    """One row per document: see without_repeated_strings()."""
    n, starts = texts.size, texts.starts
    # no window is covered twice, so a byte is covered a few times ``size`` at most
    change = np.zeros(n + 1, np.int16 if size < 1 << 12 else np.int64)
    for a, b in zip(covers.column("starts").drop_null(), covers.column("ends").drop_null()):
        np.add.at(change, np.frombuffer(a.as_buffer(), np.uint32), 1)
        np.add.at(change, np.frombuffer(b.as_buffer(), np.uint32), -1)
    gone = np.cumsum(change, out=change)[:-1] > 0
    del change
    heads = starts[:-1][np.diff(starts) > 0]
    edge = gone.copy()
    edge[1:] &= ~gone[:-1]
    edge[heads] = gone[heads]
    begins = np.flatnonzero(edge)
    edge = gone.copy()
    edge[:-1] &= ~gone[1:]
    edge[heads[1:] - 1] = gone[heads[1:] - 1]
    removed = np.cumsum(np.append(0, np.flatnonzero(edge) + 1 - begins))
    del edge
    runs = np.searchsorted(begins, starts)  # before each document
    kept = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts - removed[runs]), pa.py_buffer(texts.data[:n][~gone])])
    ids = pa.array(texts.docs, mask=texts.docs == NO_ID)
    return pa.table([ids, *map(pa.array, (np.diff(starts), np.diff(removed[runs]), np.diff(runs))), kept.cast(pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def block_total(rows: DataFrame) -> int:
    """Blocks into which the texts are dealt, by their bytes: input files may be packed well."""
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // BLOCK))


def without_repeated_strings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BYTES, gram: int = GRAM, very_many: int = VERY_MANY) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes left).

    Removed is each byte covered by a string of ``size`` bytes that also starts in a document with a smaller id.
    Suffixes are dealt out by chunks and anchors and radix-sorted where they meet: at the begin of a stretch to its
    whole length, else to the depth of ``size`` bytes.

    Null counts as empty; documents shorter than ``size`` lose nothing; a document without an id counts as the largest;
    rows that share an id never remove from one another; an empty table gives no rows.
    """
    rows = id_and_text(df, id_col, text_col).withColumn("text", F.col("text").cast("binary"))
    blocks = buckets = block_total(rows)
    dealt = rows.select(F.coalesce("doc_id", F.lit(int(NO_ID))).alias("doc_id"), "text")
    by_block = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block").groupBy("block")

    def send_chunks(key: tuple, table: pa.Table) -> pa.Table:
        texts = texts_of(table)
        places, lengths, owners = chunks(texts, size)
        return key_rows(key[0].as_py(), *documents_of(chunk_keys(texts, places, lengths), texts.docs[owners]), buckets)

    def send_texts(key: tuple, table: pa.Table, shared: pa.Table) -> pa.Table:
        if not len(table) or not len(shared):
            return ITEMS.empty_table()
        texts = texts_of(table)
        places, lengths, owners = chunks(texts, size)
        keys = chunk_keys(texts, places, lengths)
        there, _ = Wanted(shared, buckets).of(keys)
        return table_of(ITEMS, item_rows(key[0].as_py(), texts, keys[there], places[there], lengths[there], owners[there], buckets))

    def send_anchors(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return KEYS.empty_table()
        texts = texts_of(table)
        found = [(x.key, x.doc) for x, _ in anchors(texts, settled_windows(answers, size), gram, size)]
        keys, docs = joined([x for x, _ in found], np.uint64), joined([x.astype(np.int32) for _, x in found], np.int32)
        del found
        return key_rows(key[0].as_py(), *documents_of(keys, texts.docs[docs]), buckets)

    def send_spans(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        shared = answers.filter(pc.is_valid(answers.column("tags")))
        if not len(table) or not len(shared):
            return ITEMS.empty_table()
        texts, kinds = texts_of(table), (np.uint64, np.uint32, np.uint16, np.int32)
        rows, waiting, count = [], [], 0
        for items in span_items(texts, settled_windows(answers, size), Wanted(shared, buckets), gram, size):
            waiting.append([x.astype(kind) for x, kind in zip(items, kinds)])
            count += len(items[0])
            if count >= MOST_ITEMS:
                rows.append(table_of(ITEMS, sent(key, texts, waiting)))
                waiting, count = [], 0
        return pa.concat_tables([*rows, table_of(ITEMS, sent(key, texts, waiting))])

    def sent(key: tuple, texts: Texts, waiting: list) -> list[tuple]:
        if not waiting:
            return []
        keys, places, lengths, owners = (np.concatenate(x) for x in zip(*waiting))
        return item_rows(key[0].as_py(), texts, keys, places.astype(np.int64), lengths.astype(np.int64), owners, buckets)

    def share(many: int) -> Callable:
        return lambda key, table: shared_rows(key[0].as_py(), table, many)

    def to_blocks(*answers: DataFrame) -> DataFrame:
        """Answers of either kind, for cogroup()."""
        out = None
        for df in answers:
            there = set(df.columns)
            df = df.select(*(F.col(x.name) if x.name in there else F.lit(None).cast("int" if x.type == pa.int32() else "binary").alias(x.name) for x in ANSWERS))
            out = df if out is None else out.unionAll(df)
        return out.groupBy("block")

    told = by_block.applyInArrow(send_chunks, as_text(KEYS)).groupBy("bucket").applyInArrow(share(very_many), as_text(SHARED))
    stretches = by_block.cogroup(told.groupBy("block")).applyInArrow(send_texts, as_text(ITEMS))
    settled = written(stretches.groupBy("bucket").applyInArrow(lambda key, table: settled_rows(table, size, False), as_text(COVERS)), "settled")

    told = by_block.cogroup(to_blocks(settled)).applyInArrow(send_anchors, as_text(KEYS)).groupBy("bucket").applyInArrow(share(very_many), as_text(SHARED))
    stretches = by_block.cogroup(to_blocks(settled, told)).applyInArrow(send_spans, as_text(ITEMS))
    covers = stretches.groupBy("bucket").applyInArrow(lambda key, table: settled_rows(table, size, True), as_text(COVERS))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    empty = pa.schema([(x, pa.binary() if x == "kept" else pa.int64()) for x in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")]).empty_table()
    return by_block.cogroup(to_blocks(settled, covers)).applyInArrow(lambda key, table, answers: kept_table(texts_of(table), answers, size) if len(table) else empty, schema)

"""Stretches of documents that repeat in a document with a smaller id: what word and byte deduplication share.

Every window of ``threshold`` symbols (words or bytes) has one anchor: among the runs of ``gram`` symbols inside it,
the leftmost with the smallest hash. Equal windows have equal anchors, so only anchors are dealt out, about one for
every (threshold - gram) / 2 symbols. Documents lie in blocks; three passes read the blocks, which are shuffled once:

1. Each block sends its anchors, as packed hashes, to buckets; a bucket tells the blocks which anchors occur in two and
   more documents.
2. Each block sends the windows of such anchors, as spans of text, to the bucket of the anchor; equal spans of a block
   go once, with their smallest document. In the bucket a span equal to that of a smaller document is covered; spans
   that share an anchor but differ are compared window by window by the operator's own method (``Matcher``).
3. Each block takes out what is covered.

An anchor in very many documents (a line that a third of them has) would gather their differing spans in one bucket.
Such anchors are marked in pass 1, and in pass 2 their windows go out one by one, to the bucket of the window's own
hash, where only equal windows meet, one for each block. Nothing is dropped: windows are covered by exactly the same
rule on either way. Hashes only choose buckets; what is equal is decided on the text itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_count

Ranges = list[tuple[int, int]]
#: (spans, the smallest document of each, window size) -> first and last window of each covered run, by span.
Matcher = Callable[[list[bytes], list[int], int], list[Ranges]]

MIX = np.uint64(0x9E3779B97F4A7C15)
AGAIN = np.uint64(0xD6E8FEB86659FD93)
BASE = 0x5851F42D4C957F2D
SEGMENT = 1 << 19
NO_ID = np.iinfo(np.int64).max


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * AGAIN
    return x ^ (x >> np.uint64(29))


def gram_hashes(symbols: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` symbols, put together from runs of 1, 2, 4, ... symbols."""
    done, width, run, step = None, 0, symbols, 1
    while True:
        if size & step:
            if done is None:
                done = run
            else:
                n = len(run) - width
                done = done[:n] * np.uint64(pow(BASE, step, 1 << 64)) + run[width:]
            width += step
        if width == size:
            return mixed(done)
        run = run[:-step] * np.uint64(pow(BASE, step, 1 << 64)) + run[step:]
        step *= 2


def smallest_within(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each ``size`` neighbours."""
    step = 1
    while 2 * step <= size:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return np.minimum(values[: len(values) - (size - step)], values[size - step :])


@dataclass
class Block:
    """Documents of a block in fixed order: symbols side by side, and how to get at the text of a range of them."""

    docs: np.ndarray  # id of each document; without one: NO_ID
    starts: np.ndarray  # first symbol of each document, and the end
    hashes: np.ndarray  # one 64-bit hash per symbol
    text: Callable[[int, int], bytes]


def in_order(frame: pd.DataFrame) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts, by id and then text: the same order in each pass."""
    ids = frame["doc_id"].to_numpy(np.int64)
    texts = frame["text"].tolist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return ids[order], [texts[i] for i in order]


def windows_of(starts: np.ndarray, size: int) -> np.ndarray:
    """Whether a window begins at each symbol: it must end in the same document."""
    lengths = np.diff(starts)
    mark = np.zeros(starts[-1] + 1, np.int32)
    long = lengths >= size
    np.add.at(mark, starts[:-1][long], 1)
    np.add.at(mark, starts[:-1][long] + lengths[long] - size + 1, -1)
    return np.cumsum(mark[:-1]) > 0


@dataclass
class Anchors:
    first: np.ndarray  # first and last window with this anchor
    last: np.ndarray
    key: np.ndarray  # 64-bit hash of the anchor
    doc: np.ndarray  # its document's place in the block


def anchors(block: Block, gram: int, size: int) -> Anchors:
    """Runs of neighbouring windows with the same anchor."""
    is_window, reach = windows_of(block.starts, size), size - gram + 1
    firsts, lasts, keys = [], [], []
    for begin in range(0, max(0, int(block.starts[-1]) - size + 1), SEGMENT):
        symbols = block.hashes[begin : begin + SEGMENT + size - 1]
        grams = gram_hashes(symbols, gram)
        places = np.arange(len(grams), dtype=np.uint64)
        least = smallest_within((grams & np.uint64(0xFFFFFFFF00000000)) | places, reach)
        there = np.flatnonzero(is_window[begin : begin + len(least)])
        if not len(there):
            continue
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)[there]
        edge = np.flatnonzero((np.diff(at) != 0) | (np.diff(there) != 1))
        first, last = np.append(0, edge + 1), np.append(edge, len(there) - 1)
        firsts.append(there[first] + begin)
        lasts.append(there[last] + begin)
        keys.append(mixed(grams[at[first]] * MIX))
    none = np.zeros(0, np.int64)
    first = np.concatenate([none, *firsts])
    return Anchors(first, np.concatenate([none, *lasts]), np.concatenate([none.astype(np.uint64), *keys]), np.searchsorted(block.starts, first, "right") - 1)


def bucket_and_tag(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return (keys % np.uint64(buckets)).astype(np.int64), (keys >> np.uint64(32)).astype(np.uint32)


def slices(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of each run in a sorted array."""
    edge = np.flatnonzero(np.diff(values)) + 1
    for a, b in zip([0, *edge], [*edge, len(values)]) if len(values) else ():
        yield int(values[a]), int(a), int(b)


def covered_texts(
    df: DataFrame, as_block: Callable[[pd.DataFrame], Block], matcher: Matcher, finish: Callable[[Block, np.ndarray], Iterator[tuple]], finish_schema: str,
    threshold: int, gram: int, very_many: int, at_once: int = 1,
) -> DataFrame:
    """``matcher`` gets the spans of one anchor, or of several until there are ``at_once``.

    One row per row of ``df`` (doc_id, text as binary): what ``finish`` makes of a block and the mask of covered symbols."""
    blocks = block_count(df)
    buckets = 2 * blocks
    dealt = df.select(F.coalesce("doc_id", F.lit(int(NO_ID))).alias("doc_id"), "text")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    by_block = dealt.groupBy("block")

    def send_anchors(key, frame: pd.DataFrame) -> pd.DataFrame:
        found = anchors(as_block(frame), gram, threshold)
        order = np.argsort(found.key, kind="stable")  # within a key by document
        keys, doc = found.key[order], found.doc[order]
        new = np.append(True, (np.diff(keys) != 0) | (np.diff(doc) != 0))[: len(keys)]
        keys, counts = np.unique(keys[new], return_counts=True)
        bucket, tag = bucket_and_tag(keys, buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, tag, counts = bucket[order], tag[order], np.minimum(counts[order], 65535).astype(np.uint16)
        rows = [(b, key[0], tag[i:j].tobytes(), counts[i:j].tobytes()) for b, i, j in slices(bucket)]
        return pd.DataFrame(rows, columns=["bucket", "block", "tags", "counts"])

    def shared_anchors(key, frame: pd.DataFrame) -> pd.DataFrame:
        tags = [np.frombuffer(x, np.uint32) for x in frame["tags"]]
        counts = np.concatenate([np.frombuffer(x, np.uint16) for x in frame["counts"]])
        known, inverse = np.unique(np.concatenate(tags), return_inverse=True)
        total = np.bincount(inverse, counts)[inverse]
        rows, begin = [], 0
        for block, own in zip(frame["block"], tags):
            n = total[begin : begin + len(own)]
            begin += len(own)
            if (n > 1).any():
                rows.append((block, key[0], own[n > 1].tobytes(), (n[n > 1] >= very_many).tobytes()))
        return pd.DataFrame(rows, columns=["block", "bucket", "tags", "many"])

    def send_spans(key, frame: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "block", "tags", "docs", "lengths", "sizes", "texts", "places", "starts", "local_starts", "local_ends"]
        if not len(frame) or not len(shared):
            return pd.DataFrame([], columns=columns)
        block = as_block(frame)
        found = anchors(block, gram, threshold)
        wanted = np.concatenate([np.frombuffer(t, np.uint32).astype(np.uint64) | np.uint64(b) << np.uint64(32) for b, t in zip(shared["bucket"], shared["tags"])])
        many = np.concatenate([np.frombuffer(x, bool) for x in shared["many"]])
        order = np.argsort(wanted)
        wanted, many = wanted[order], many[order]
        bucket, tag = bucket_and_tag(found.key, buckets)
        own = tag.astype(np.uint64) | bucket.astype(np.uint64) << np.uint64(32)
        at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
        spans: dict[tuple, list[int]] = {}
        for i in np.flatnonzero(wanted[at] == own).tolist():
            a, b = int(found.first[i]), int(found.last[i])
            if many[at[i]]:
                for w in range(a, b + 1):
                    text = block.text(w, w + threshold)
                    spans.setdefault((-1, text), []).append((w, w + threshold, int(found.doc[i])))
            else:
                spans.setdefault((int(bucket[i]) << 32 | int(tag[i]), block.text(a, b + threshold)), []).append((a, b + threshold, int(found.doc[i])))
        out: dict[int, list] = {}
        docs = block.docs
        for (where, text), places in spans.items():
            if where < 0:
                to, mark = bucket_and_tag(text_key(text), buckets)
                to, mark = int(to[0]), int(mark[0])
            else:
                to, mark = where >> 32, where & 0xFFFFFFFF
            row = out.setdefault(to, [[] for _ in range(9)])
            least = int(docs[places[0][2]])  # documents are in ascending order
            held = 0
            for a, b, d in places:
                if docs[d] == least:
                    row[6].append(a)
                    held += 1
                else:
                    row[7].append(a)
                    row[8].append(b)
            for column, value in zip(row, (mark, least, len(text), places[0][1] - places[0][0], text, held)):
                column.append(value)
        pack = lambda x, kind: np.array(x, kind).tobytes()
        rows = [
            (to, key[0], pack(r[0], np.uint32), pack(r[1], np.int64), pack(r[2], np.uint32), pack(r[3], np.uint32), b"".join(r[4]), pack(r[5], np.uint32), pack(r[6], np.uint32), pack(r[7], np.uint32), pack(r[8], np.uint32))
            for to, r in out.items()
        ]
        return pd.DataFrame(rows, columns=columns)

    def match_spans(key, frame: pd.DataFrame) -> pd.DataFrame:
        groups: dict[int, dict[bytes, list]] = {}  # tag -> text -> [least document, (row, document, starts), ...]
        covers = []
        for row, x in enumerate(frame.itertuples(index=False)):
            covers.append(([np.frombuffer(x.local_starts, np.uint32)], [np.frombuffer(x.local_ends, np.uint32)]))
            tags, docs = np.frombuffer(x.tags, np.uint32).tolist(), np.frombuffer(x.docs, np.int64).tolist()
            sizes, starts = np.frombuffer(x.sizes, np.uint32).tolist(), np.frombuffer(x.starts, np.uint32)
            ends = np.cumsum(np.frombuffer(x.lengths, np.uint32), dtype=np.int64).tolist()
            places = np.cumsum(np.frombuffer(x.places, np.uint32), dtype=np.int64).tolist()
            begin = held = 0
            for tag, doc, size, end, place in zip(tags, docs, sizes, ends, places):
                groups.setdefault(tag, {}).setdefault(x.texts[begin:end], []).append((doc, row, size, starts[held:place]))
                begin, held = end, place

        def settle(batch: list[tuple[bytes, list]]) -> None:
            least = [min(doc for doc, *_ in owners) for _, owners in batch]
            windows = matcher([text for text, _ in batch], least, threshold) if len(batch) > 1 else [[]]
            for smallest, ranges, (_, owners) in zip(least, windows, batch):
                for doc, row, size, starts in owners:
                    for a, b in [(0, size - threshold)] if doc > smallest else ranges:
                        covers[row][0].append(starts + np.uint32(a))
                        covers[row][1].append(starts + np.uint32(b + threshold))

        waiting: list[tuple[bytes, list]] = []
        for group in groups.values():
            if len(group) == 1:
                settle(list(group.items()))
            else:
                waiting += group.items()
                if len(waiting) >= at_once:
                    settle(waiting)
                    waiting = []
        if waiting:
            settle(waiting)
        rows = [(block, np.concatenate(a).astype(np.uint32).tobytes(), np.concatenate(b).astype(np.uint32).tobytes()) for block, (a, b) in zip(frame["block"], covers)]
        return pd.DataFrame(rows, columns=["block", "starts", "ends"])

    names = [x.split()[0] for x in finish_schema.split(",")]

    def take_out(key, frame: pd.DataFrame, covers: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame([], columns=names)
        block = as_block(frame)
        change = np.zeros(int(block.starts[-1]) + 1, np.int32)
        for a, b in zip(covers["starts"], covers["ends"]):
            np.add.at(change, np.frombuffer(a, np.uint32), 1)
            np.add.at(change, np.frombuffer(b, np.uint32), -1)
        return pd.DataFrame(finish(block, np.cumsum(change[:-1]) > 0), columns=names)

    sent = by_block.applyInPandas(send_anchors, "bucket int, block int, tags binary, counts binary")
    shared = sent.groupBy("bucket").applyInPandas(shared_anchors, "block int, bucket int, tags binary, many binary")
    spans = by_block.cogroup(shared.groupBy("block")).applyInPandas(
        send_spans, "bucket int, block int, tags binary, docs binary, lengths binary, sizes binary, texts binary, places binary, starts binary, local_starts binary, local_ends binary"
    )
    covers = spans.groupBy("bucket").applyInPandas(match_spans, "block int, starts binary, ends binary")
    return by_block.cogroup(covers.groupBy("block")).applyInPandas(take_out, finish_schema)


def text_key(text: bytes) -> np.ndarray:
    """64-bit hash of a window's text."""
    import zlib

    return mixed(np.array([zlib.crc32(text) << 32 | zlib.adler32(text)], np.uint64) * MIX)


def without_id(docs: np.ndarray) -> list[int | None]:
    return [None if d == NO_ID else int(d) for d in docs]

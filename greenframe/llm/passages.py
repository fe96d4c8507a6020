"""Repeated word passages: suffix automata of reference shards, streamed for matching statistics."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import id_and_text

WORDS, GRAM, VERY_MANY = 50, 25, 2000


class SuffixAutomaton:
    """All stretches of the word sequences added so far."""

    def __init__(self):
        self.follow: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, follow: dict, link: int, length: int) -> int:
        self.follow.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The state for what leads from ``p`` by ``word``, set apart from longer stretches in ``q``."""
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._state(dict(self.follow[q]), self.link[q], self.length[p] + 1)
        while p >= 0 and self.follow[p].get(word) == q:
            self.follow[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words: list) -> None:
        last = 0
        for word in words:
            if word in self.follow[last]:  # known from an earlier sequence
                last = self._split(last, word, self.follow[last][word])
                continue
            p, new = last, self._state({}, 0, self.length[last] + 1)
            while p >= 0 and word not in self.follow[p]:
                self.follow[p][word] = new
                p = self.link[p]
            self.link[new] = 0 if p < 0 else self._split(p, word, self.follow[p][word])
            last = new

    def matching_statistics(self, words: list) -> Iterator[int]:
        """For each word: the longest stretch ending there that some added sequence holds."""
        state = matched = 0
        for word in words:
            while state and word not in self.follow[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.follow[state]:
                state, matched = self.follow[state][word], matched + 1
            yield matched


def by_automaton(spans: list[bytes], docs: list[int], size: int) -> list[repeats.Ranges]:
    """Covered windows of each span. Documents come in ascending order, each streamed through the shard of the smaller ones."""
    shard, found = SuffixAutomaton(), [[] for _ in spans]
    order = sorted(range(len(spans)), key=docs.__getitem__)
    at = 0
    while at < len(order):
        same = at
        while same < len(order) and docs[order[same]] == docs[order[at]]:
            same += 1
        if at:
            for i in order[at:same]:
                for end, matched in enumerate(shard.matching_statistics(spans[i].split())):
                    if matched >= size:
                        first = end - size + 1
                        if found[i] and found[i][-1][1] == first - 1:
                            found[i][-1] = (found[i][-1][0], first)
                        else:
                            found[i].append((first, first))
        if same < len(order):
            for i in order[at:same]:
                shard.add(spans[i].split())
        at = same
    return found


def word_block(frame: pd.DataFrame) -> repeats.Block:
    ids, texts = repeats.in_order(frame)
    words, starts = [], [0]
    for text in texts:
        words += text.split()  # the six white space characters of ASCII
        starts.append(len(words))
    hashes = repeats.mixed((np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(1)) * repeats.MIX)
    return repeats.Block(ids, np.array(starts), hashes, lambda a, b: b" ".join(words[a:b]))


def kept_words(block: repeats.Block, covered: np.ndarray) -> Iterator[tuple]:
    for doc, a, b in zip(repeats.without_id(block.docs), block.starts[:-1].tolist(), block.starts[1:].tolist()):
        gone = covered[a:b]
        edges = np.flatnonzero(np.diff(np.concatenate(([True], gone, [True]))))
        kept = b" ".join(block.text(a + i, a + j) for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()))
        yield doc, b - a, int(gone.sum()), kept


def without_repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, gram: int = GRAM, very_many: int = VERY_MANY) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words left, joined by one space, as bytes).

    Removed is each word covered by a window of ``size`` words that also starts in a document with a smaller id. The
    reference shard of an anchor holds the passages around it, as a suffix automaton that grows by ascending document;
    passages that are equal as a whole are settled without it, and so are those of anchors in ``very_many`` documents
    and more (see repeats).

    Null and empty texts have no words; documents shorter than a window lose none; a document without an id counts as
    the largest; rows that share an id never remove from one another; an empty table gives no rows.
    """
    rows = id_and_text(df, id_col, text_col).withColumn("text", F.col("text").cast("binary"))
    return repeats.covered_texts(rows, word_block, by_automaton, kept_words, "doc_id long, n_words long, n_removed long, kept binary", size, gram, very_many)

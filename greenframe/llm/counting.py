"""Token counts by byte-pair merging with a heap over a linked list; no identifiers are made."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text
from .units import Remembered, spaced_units, tokenizer_path, unit_text

WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: How byte-level vocabularies cut text before merging (a fixed value of the format).
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


def merged_count(symbols: list[int], pairs: dict[int, tuple[int, int]]) -> int:
    """Symbols left after all merges. ``pairs``: left << 32 | right -> (rank, merged symbol)."""
    n = left = len(symbols)
    if n < 2:
        return n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        found = pairs.get(symbols[i] << 32 | symbols[i + 1])
        if found:
            heap.append((found[0], i, found[1], symbols[i], symbols[i + 1]))
    heapq.heapify(heap)
    while heap:
        _, i, merged, a, b = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = merged, -1
        after[i] = k = after[j]
        left -= 1
        if k < n:
            before[k] = i
            found = pairs.get(merged << 32 | symbols[k])
            if found:
                heapq.heappush(heap, (found[0], i, found[1], merged, symbols[k]))
        h = before[i]
        if h >= 0:
            found = pairs.get(symbols[h] << 32 | merged)
            if found:
                heapq.heappush(heap, (found[0], h, found[1], symbols[h], merged))
    return left


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary files: itself if printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class MergeCounter:
    """count(text): tokens of a byte-level vocabulary, special strings counted as one each."""

    def __init__(self, path: str, most: int = 1_000_000):
        import regex

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, vocab = content["model"], content["model"]["vocab"]
        self.first = [vocab[x] for x in byte_letters()]
        self.pairs = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        specials = sorted((x["content"] for x in content["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.marks = [x[:2] for x in specials]
        self.pre_token = regex.compile(PRE_TOKEN)
        self.known = Remembered(most)

    def stretch(self, text: str) -> int:
        """Tokens of a text without special strings."""
        first, pairs = self.first, self.pairs
        return sum(merged_count([first[b] for b in x.encode("utf-8", "surrogatepass")], pairs) for x in self.pre_token.findall(text))

    def whole(self, text: str) -> int:
        if self.special and any(x in text for x in self.marks):
            parts = self.special.split(text)
            return sum(map(self.stretch, parts)) + len(parts) - 1
        return self.stretch(text)

    def count(self, text: str) -> int:
        units = spaced_units(text) if "\0" not in text else None
        if units is None:
            return self.whole(text)
        found = list(map(self.known.values.get, units))
        if None in found:
            got = {u: self.whole(unit_text(u)) for u in {u for u, x in zip(units, found) if x is None}}
            found = [got[u] if x is None else x for u, x in zip(units, found)]
            self.known.add(list(got), list(got.values()))
        return sum(found)


@lru_cache(maxsize=2)
def merge_counter(path: str) -> MergeCounter:
    """One per Python worker."""
    return MergeCounter(path)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Each pre-token is merged by repeatedly popping the adjacent pair of lowest rank (the leftmost of equals); the count
    is the initial symbols less the merges. One pass, no shuffle. Null and empty texts have 0 tokens, repeated rows are
    counted each, an empty table gives no rows.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merge_counter(tokenizer_path(vocabulary))
        for batch in batches:
            sizes, tokens = [], []
            for value in batch.column(1):
                text = value.as_py()
                sizes.append(len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass")))
                tokens.append(counter.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return id_and_text(df, id_col, text_col).mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

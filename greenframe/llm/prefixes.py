"""Byte-level BPE by dynamic programming over prefixes, its inverse, and encoding again near an edit.

Every prefix of a byte string has one encoding, and so one last token. That token is found from shorter prefixes: it is
the only vocabulary entry that ends the prefix and may stand after the last token of what is before it. Two tokens may
stand side by side when no merge across their border would have come before the merges that made them. The last tokens
of all prefixes stay valid when bytes are appended, and after an edit they are worked out again only until they repeat.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text
from .counting import PRE_TOKEN
from .units import UnitIds, spaced_line, tokenizer_path, unit_text

NEVER = 1 << 60
#: Documents that a task works on at a time.
ROWS = 800


class PrefixCoder:
    """Encoding of byte strings by ranks (token bytes -> rank; the rank is the id)."""

    def __init__(self, ranks: dict[bytes, int], most: int = 400_000):
        self.ranks, self.content = ranks, {rank: token for token, rank in ranks.items()}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a vocabulary needs a token for each byte")
        self.longest = max(map(len, ranks))
        #: Ending of four bytes, or of fewer where no longer token has it -> (size, token) of all tokens that end so,
        #: longest first; the token is None where it has to be looked up.
        self.endings: dict[bytes, tuple[tuple[int, int | None], ...]] = {}
        for token in sorted(ranks, key=len):
            ending = token[-4:]
            if len(token) <= 4:
                self.endings[ending] = ((len(token), ranks[token]), *self.shorter(ending))
            else:
                known = self.endings.get(ending) or self.shorter(ending)
                if known[0][0] != len(token):
                    self.endings[ending] = ((len(token), None), *known)
        #: What shorter() found for other endings.
        self.others: dict[bytes, tuple[tuple[int, int | None], ...]] = {}
        self.most = most
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.side_by_side: dict[int, bool] = {}

    def shorter(self, ending: bytes) -> tuple[tuple[int, int | None], ...]:
        """What ends a text with this ending, of tokens shorter than it."""
        return next((self.endings[ending[k:]] for k in range(1, len(ending)) if ending[k:] in self.endings), ())

    def other(self, ending: bytes) -> tuple[tuple[int, int | None], ...]:
        """shorter(), remembered."""
        if len(self.others) >= self.most // 4:
            self.others.clear()
        found = self.others[ending] = self.shorter(ending)
        return found

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that are merged into this one, None for a single byte.

        They are what the entries of lower rank make of its bytes; if that is not two tokens, no merge leads to this one.
        """
        if token not in self.parts:
            data, found = self.content[token], None
            if len(data) > 1:
                found = self.walk(self.last_tokens(data, [0], below=token))
                if len(found) != 2:
                    found = (-1, -1)
            self.parts[token] = found and (found[0], found[1])
        return self.parts[token]

    def borders(self, a: int, b: int, below: int = NEVER) -> bool:
        """Whether b may stand after a: the merges that made both are undone, latest first, and none across comes before."""
        above_a = above_b = below  # ranks of the merges that took in what is now left and right of the border
        content, merged, parts = self.content, self.ranks, self.parts
        while True:
            across = merged.get(content[a] + content[b])
            # of equal ranks the leftmost merge is first
            if across is not None and across < above_a and across <= above_b:
                return False
            of_a = parts[a] if a in parts else self.halves(a)
            of_b = parts[b] if b in parts else self.halves(b)
            if of_a and (not of_b or a > b):
                above_a, a = a, of_a[1]
            elif of_b:
                above_b, b = b, of_b[0]
            else:
                return True

    def fits(self, before: int, token: int, below: int) -> bool:
        """borders(), for tokens that merges lead to; ``before`` is -1 where nothing is before the token."""
        return self.halves(token) != (-1, -1) and (before < 0 or self.borders(before, token, below))

    def last_tokens(self, data: bytes, last: list[int] | None = None, upto: int | None = None, below: int = NEVER) -> list[int]:
        """The last token of each prefix (0 for the empty one); ``last`` holds those of the first prefixes and is extended.

        With ``below``, by the entries of lower rank alone.
        """
        last = [0] if last is None else last
        known = self.side_by_side if below == NEVER else {}
        if len(known) > self.most:
            known.clear()
        merged, endings, others = self.ranks, self.endings, self.others
        for end in range(len(last), (len(data) if upto is None else upto) + 1):
            ending = data[end - 4 : end] if end > 4 else data[:end]
            for back, token in endings.get(ending) or others.get(ending) or self.other(ending):
                if token is None:
                    token = merged.get(data[end - back : end]) if back <= end else None
                    if token is None:
                        continue
                if token >= below:
                    continue
                pair = (last[end - back] if back < end else -1) << 32 | token
                good = known.get(pair)
                if good is None:
                    good = known[pair] = self.fits(pair >> 32, token, below)
                if good:
                    last.append(token)
                    break
            else:
                raise ValueError("no token ends the prefix")
        return last

    def walk(self, last: list[int]) -> list[int]:
        """The tokens of the whole string, from the last tokens of its prefixes."""
        tokens, end = [], len(last) - 1
        while end:
            tokens.append(last[end])
            end -= len(self.content[last[end]])
        return tokens[::-1]

    def encode(self, data: bytes) -> list[int]:
        token = self.ranks.get(data)
        return self.walk(self.last_tokens(data)) if token is None else [token]

    def encode_sorted(self, strings: list[bytes]) -> Iterator[list[int]]:
        """Tokens of strings in ascending order: each keeps the last tokens of the beginning it shares with the one before."""
        before, last = b"", [0]
        for data in strings:
            token = self.ranks.get(data)
            if token is not None:
                yield [token]
                continue
            shared = 0
            for a, b in zip(before, data):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :]
            before = data
            yield self.walk(self.last_tokens(data, last))


class PrefixText:
    """A byte string that grows and changes, with the last token of each of its prefixes."""

    def __init__(self, coder: PrefixCoder, data: bytes = b""):
        self.coder, self.data, self.last = coder, data, coder.last_tokens(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.coder.last_tokens(self.data, self.last)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in the place of data[start:stop]; the number of prefixes worked out again."""
        old, moved = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        last, size, same = old[: start + 1], len(self.data), 0
        for end in range(start + 1, size + 1):
            self.coder.last_tokens(self.data, last, end)
            # a last token follows from those of at most ``longest`` prefixes before it, so as many equal ones settle the rest
            same = same + 1 if end - moved > stop and old[end - moved] == last[end] else 0
            if same > self.coder.longest:
                self.last = last + old[end + 1 - moved :]
                return end - start
        self.last = last
        return size - start

    def tokens(self) -> list[int]:
        token = self.coder.ranks.get(self.data)
        return self.coder.walk(self.last) if token is None else [token]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class PrefixIds(UnitIds):
    """Ids of texts: each pre-token by itself, through the memory of their units."""

    CHUNK = 1 << 22

    def __init__(self, path: str, most: int = 400_000):
        import regex

        self.coder = PrefixCoder(read_ranks(path))
        self.pre_token = regex.compile(PRE_TOKEN)
        super().__init__(spaced_line, self.packed_units, self.packed, "<u4", most)

    def packed_units(self, units: list[str]) -> list[bytes]:
        """Ids of the units' texts; each different pre-token is encoded once, beside those that begin alike."""
        texts = list(map(unit_text, units))
        cut = {t: self.pre_token.findall(t) for t in texts if not (t[1:].isalpha() and (t[0] == " " or t[0].isalpha()))}
        data = sorted(set(chain((t for t in texts if t not in cut), *cut.values())))  # the order of their bytes, too
        ids = self.coder.encode_sorted([x.encode("utf-8", "surrogatepass") for x in data])
        packed = {x: array("I", found).tobytes() for x, found in zip(data, ids)}
        return [b"".join(map(packed.__getitem__, cut[t])) if t in cut else packed[t] for t in texts]

    def packed(self, text: str) -> bytes:
        encode, ids = self.coder.encode, array("I")
        for piece in self.pre_token.findall(text):
            ids.extend(encode(piece.encode("utf-8", "surrogatepass")))
        return ids.tobytes()

    def edited(self, text: str, ids: np.ndarray, start: int, stop: int, new: str) -> tuple[str, np.ndarray]:
        """Text and ids after ``new`` took the place of text[start:stop]; what is not near it keeps its ids."""
        start, stop = min(start, len(text)), min(max(start, stop), len(text))
        first, last = start - 2, stop + 1
        while first > 0 and not border(text, first):
            first -= 1
        while last < len(text) and not border(text, last):
            last += 1
        first, last = max(first, 0), min(last, len(text))
        size = np.array([len(self.coder.content[i]) for i in ids.tolist()], np.int64)
        before = np.searchsorted(np.cumsum(size), len(text[:first].encode("utf-8", "surrogatepass")), "right")
        after = len(ids) - np.searchsorted(np.cumsum(size[::-1]), len(text[last:].encode("utf-8", "surrogatepass")), "right")
        between = np.frombuffer(self.packed(text[first:start] + new + text[stop:last]), "<u4")
        return text[:start] + new + text[stop:], np.concatenate((ids[:before], between, ids[after:]))


def border(text: str, at: int) -> bool:
    """Whether a pre-token begins at this place whatever stands further away: a single blank between letters."""
    return text[at] == " " and text[at - 1 : at].isalpha() and text[at + 1 : at + 2].isalpha()


@lru_cache(maxsize=2)
def prefix_ids(path: str) -> PrefixIds:
    """One per Python worker."""
    return PrefixIds(path)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> dict[int, bytes]:
    """One per Python worker."""
    return {rank: token for token, rank in read_ranks(path).items()}


def bytes_of(ids: bytes, tokens: dict[int, bytes]) -> bytes:
    try:
        return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    except KeyError as error:
        raise ValueError(f"{error.args[0]} is no token") from None


@lru_cache(maxsize=2)
def token_array(path: str) -> pa.Array:
    """The bytes of each rank; one per Python worker."""
    tokens = token_bytes(path)
    return pa.array(list(map(tokens.get, range(max(tokens) + 1))), pa.large_binary())


def bytes_of_each(column: pa.Array, path: str) -> pa.Array:
    """bytes_of() of a column, null where it is null; the tokens' bytes are copied by Arrow."""
    values, known, found = [x or b"" for x in column.to_pylist()], token_array(path), None
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
    if not sizes.any() or any(len(x) % 4 for x in values):
        return pa.array([None if x is None else bytes_of(x, token_bytes(path)) for x in column.to_pylist()], pa.binary())
    ids = np.frombuffer(b"".join(values), "<u4")
    if ids.max() < len(known):
        found = known.take(pa.array(ids))
    if found is None or found.null_count:
        for x in values:
            bytes_of(x, token_bytes(path))  # tells which id is no token
    _, offsets, data = found.buffers()
    places = np.frombuffer(offsets, np.int64)[np.append(0, np.cumsum(sizes))]
    return pa.Array.from_buffers(pa.large_binary(), len(values), [column.is_valid().buffers()[1], pa.py_buffer(places), data]).cast(pa.binary())


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, ROWS) for batch in batches for i in range(0, len(batch), ROWS))


def binary(values: list[np.ndarray]) -> pa.Array:
    return pa.array([x.astype("<u4").tobytes() for x in values], pa.binary())


def encoded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers).

    Texts are cut into pre-tokens, each encoded by itself; strings of special tokens are ordinary text. One pass, no
    shuffle. Null and empty texts have no ids; repeated rows are encoded each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = prefix_ids(tokenizer_path(vocabulary))
        for batch in sliced(batches):
            ids = list(coder.each(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, ids), pa.int64()), binary(ids)], ["doc_id", "n_tokens", "ids"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decoded(df: DataFrame, ids_col: str = "ids", to: str = "decoded", vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``df`` with the bytes of its ids as column ``to`` (which must be new). Null ids give null, empty ids no bytes;
    an id that is no token raises ValueError."""
    if to in df.columns:
        raise ValueError(f"{to} is taken")
    place = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path(vocabulary)
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, bytes_of_each(batch.column(place), path)], [*batch.schema.names, to])

    schema = df.select("*", F.lit(b"").alias(to)).schema
    return df.mapInArrow(run, schema)


def reencoded(df: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Edits of encoded texts: (doc_id, text, ids, start, stop, replacement) -> (doc_id, text, n_tokens, ids).

    The characters from ``start`` to before ``stop`` are replaced; only the words around them are encoded anew. Places
    beyond the end count as the end, so an append is an edit there. Null texts and ids count as empty, a null start as
    the end of the text, a null stop as start, a null replacement as empty.
    """
    end = F.length(F.coalesce("text", F.lit("")))
    rows = df.select(
        F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("ids", F.lit(b"")).alias("ids"),
        F.coalesce(F.col("start"), end).cast("long").alias("start"), F.coalesce(F.col("stop"), F.col("start"), end).cast("long").alias("stop"),
        F.coalesce("replacement", F.lit("")).alias("replacement"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = prefix_ids(tokenizer_path(vocabulary))
        for batch in batches:
            doc_id, *columns = batch.columns
            done = [coder.edited(t, np.frombuffer(x, "<u4"), a, b, new) for t, x, a, b, new in zip(*(c.to_pylist() for c in columns))]
            ids = [x for _, x in done]
            yield pa.RecordBatch.from_arrays([doc_id, pa.array([t for t, _ in done], pa.string()), pa.array(map(len, ids), pa.int64()), binary(ids)], ["doc_id", "text", "n_tokens", "ids"])

    return rows.mapInArrow(run, "doc_id long, text string, n_tokens long, ids binary")

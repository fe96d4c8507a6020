"""Token ids as the tokenizers library gives them, remembered per unit of text.

A unit is a stretch of text whose ids do not depend on what stands around it. Texts repeat most of their units, so a
bounded memory of them saves most calls of the library, which is still what turns every new unit into ids.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept_by_worker

#: White space other than blank and line feed; texts with it go to the library whole.
RARE_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Remembered:
    """dict of unit -> value of bounded size: it starts anew when full."""

    def __init__(self, most: int):
        self.most, self.values = most, {}

    def add(self, units, values) -> None:
        if len(self.values) + len(units) > self.most:
            self.values.clear()
        self.values.update(zip(units, values))


def even(text: str) -> bool:
    """Whether each blank and line feed stands alone between other characters, and no other white space occurs."""
    if not text:
        return True
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n"):
        return False
    return not RARE_SPACE.search(text)


def spaced_units(text: str) -> list[str] | None:
    """Cut before each blank or line feed that stands alone between other characters; None where others occur.

    A byte-level pre-token never has white space after other characters, so such a place always separates two tokens.
    """
    if not even(text):
        return None
    first, *rest = text.replace("\n", " \n").split(" ")
    # a unit that begins with a line feed has no blank before it; the first unit has neither
    return ["\0" + first, *rest]


def worded_units(text: str) -> list[str] | None:
    """Words, for tokenizers that drop white space; None where unusual white space occurs."""
    if RARE_SPACE.search(text):
        return None
    # such a tokenizer ignores case; special strings, which it looks for first, do not
    return (text.lower() if text.isascii() and "<|" not in text else text).split()


def unit_text(unit: str) -> str:
    """What a unit of spaced_units() stands for in the text."""
    return unit[1:] if unit[:1] == "\0" else unit if unit[:1] == "\n" else " " + unit


def spaced_line(text: str) -> str | None:
    """spaced_units() still joined by blanks."""
    if "\0" in text or "\1" in text or not even(text):
        return None
    return "\0" + text.replace("\n", " \n")


def worded_line(text: str) -> str | None:
    """Words as worded_units() gives them, still in one string with blanks or line feeds between them."""
    if RARE_SPACE.search(text):
        return None
    return (text.lower() if text.isascii() and "<|" not in text else text).replace("\n", " ")


class UnitMemory:
    """Units and their packed ids, one after the other in an array; a unit's code is its place among the units."""

    def __init__(self, width: str):
        self.codes: dict[str, int] = {}
        self.pool, self.starts = np.empty(1 << 12, width), np.zeros(1 << 10, np.int64)
        self.batches, self.seen = 0, np.zeros(1 << 10, np.int64)  # looked up so far, and the last one that had the unit

    def add(self, units: list[str], packed: list[bytes]) -> None:
        """Remember new units."""
        ids = np.frombuffer(b"".join(packed), self.pool.dtype)
        self.put(units, ids, np.fromiter(map(len, packed), np.int64, len(packed)) // self.pool.itemsize)

    def put(self, units: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, used = len(self.codes), self.starts[len(self.codes)]
        if n + len(units) >= len(self.starts):
            more = max(2 * len(self.starts), n + len(units) + 1)
            self.starts, self.seen = np.resize(self.starts, more), np.resize(self.seen, more)
        if used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, max(2 * len(self.pool), used + len(ids)))
        self.pool[used : used + len(ids)] = ids
        self.starts[n + 1 : n + 1 + len(units)] = used + np.cumsum(sizes)
        self.seen[n : n + len(units)] = self.batches
        self.codes.update(zip(units, range(n, n + len(units))))

    def latest(self, n: int) -> UnitMemory:
        """The ``n`` units seen last."""
        some = np.sort(np.argsort(self.seen[: len(self.codes)], kind="stable")[-n:]) if n else np.empty(0, np.int64)
        new, units, sizes = UnitMemory(self.pool.dtype), list(self.codes), self.sizes(some)
        new.put([units[i] for i in some.tolist()], self.ids(some, sizes), sizes)
        new.batches, new.seen[: len(some)] = self.batches, self.seen[some]
        return new

    def sizes(self, codes: np.ndarray) -> np.ndarray:
        return self.starts[codes + 1] - self.starts[codes]

    def ids(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of the units, one after the other."""
        ends = np.cumsum(sizes)
        return self.pool[np.repeat(self.starts[codes] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def packed(self, code: int) -> bytes:
        return self.pool[self.starts[code] : self.starts[code + 1]].tobytes()


class UnitIds:
    """Ids of texts, put together from those of their units.

    ``line`` gives a text's units joined by blanks, or None where the text has to go whole; ``encode`` turns new units
    into packed ids of ``width`` and ``whole`` does so for one text. The units of many texts are split and told apart by
    Arrow, so Python sees each different unit of a batch once; those known from earlier batches are not encoded again.
    When there is no room for a batch's new ones among ``most`` known units, the half seen last stays.
    """

    #: Characters of text whose units are held at a time.
    CHUNK = 1 << 24
    #: Units whose ids are put together at a time.
    GATHER = 1 << 17

    def __init__(self, line: Callable, encode: Callable, whole: Callable, width: str, most: int):
        self.line, self.encode, self.whole, self.width, self.most = line, encode, whole, width, most
        self.known = UnitMemory(width)
        self.points = {x: whole(x) for x in ".,"}

    def each(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        first = held = 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= self.CHUNK:
                yield from self._chunk(texts[first : i + 1])
                first, held = i + 1, 0
        if first < len(texts):
            yield from self._chunk(texts[first:])

    def known_codes(self, units: list[str]) -> np.ndarray:
        """The codes of different units, -1 for those that are new."""
        known, codes = self.known, np.fromiter(map(self.known.codes.get, units, repeat(-1)), np.int64, len(units))
        known.batches += 1
        known.seen[codes[codes >= 0]] = known.batches
        return codes

    def looked_up(self, units: list[str]) -> np.ndarray:
        """The codes of different units, from memory or encoded now."""
        codes = self.known_codes(units)
        new = np.flatnonzero(codes < 0)
        if not len(new):
            return codes
        if len(self.known.codes) + len(new) > self.most:
            self.known = self.known.latest(min(len(self.known.codes), max(self.most // 2, len(units) - len(new))))
            codes = self.known_codes(units)
            new = np.flatnonzero(codes < 0)
        known, fresh = self.known, [units[i] for i in new.tolist()]
        # letters and a point or comma after them are always different tokens, so only the letters are encoded
        points = self.points
        stems = [u[:-1] if u[-1:] in points and u[:-1].isalpha() else u for u in fresh]
        packed = {s: known.packed(known.codes[s]) if s in known.codes else None for s in stems}
        unknown = [s for s, x in packed.items() if x is None]
        packed.update(zip(unknown, self.encode(unknown)))
        codes[new] = np.arange(len(known.codes), len(known.codes) + len(new))
        known.add(fresh, [packed[s] if s is u else packed[s] + points[u[-1]] for u, s in zip(fresh, stems)])
        return codes

    def _chunk(self, texts: list[str]) -> Iterator[np.ndarray]:
        lines = [self.line(x) for x in texts]
        split = pc.split_pattern(pa.array([x for x in lines if x is not None], pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        codes = self.looked_up(coded.dictionary.to_pylist())
        bounds, units, known = split.offsets.to_numpy(), coded.indices.to_numpy(), self.known
        last = first = k = 0
        ids = ends = None
        for text, line in zip(texts, lines):
            if line is None:
                yield np.frombuffer(self.whole(text), self.width)
                continue
            if ids is None or bounds[k + 1] > last:
                first = bounds[k]
                last = max(bounds[k + 1], bounds[np.searchsorted(bounds, first + self.GATHER, "right") - 1])
                of = codes[units[first:last]]
                sizes = known.sizes(of)
                ids, ends = known.ids(of, sizes), np.append(0, np.cumsum(sizes))
            yield ids[ends[bounds[k] - first] : ends[bounds[k + 1] - first]]
            k += 1


class LibraryIds(UnitIds):
    """ids(text) is encode(text, add_special_tokens=False).ids of the tokenizers library, as unsigned 32-bit integers."""

    def __init__(self, path: str, drops_space: bool, most: int = 1_500_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder().values()
        self.specials = [x.content for x in added]
        line, encode = (worded_line, self._encode) if drops_space else (spaced_line, self._encode_spaced)
        if any(x.lstrip or x.rstrip or len(x.content.split()) != 1 for x in added):
            line = lambda text: None  # noqa: E731  special strings that reach over white space: no units
        super().__init__(line, encode, lambda text: self._encode([text])[0], "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4", most)
        self.feed = np.frombuffer(self.whole("\n"), self.width)

    def _encode(self, texts: list[str]) -> list[bytes]:
        out, kind = [], "H" if self.width == "<u2" else "I"
        for i in range(0, len(texts), 256):  # the library's results are large, so few are held
            out += [array(kind, x.ids).tobytes() for x in self.library.encode_batch_fast(texts[i : i + 256], add_special_tokens=False)]
        return out

    def _encode_spaced(self, units: list[str]) -> list[bytes]:
        """_encode() of the units' texts, many in one call: each behind a line feed, which is a token by itself there."""
        out = [b""] * len(units)
        held = " ".join(units)
        specials = [x for x in self.specials if x in held]
        alone = [i for i, u in enumerate(units) if u[0] == "\0" or (specials and any(x in u for x in specials))]
        for i, packed in zip(alone, self._encode([unit_text(units[i]) for i in alone])):
            out[i] = packed
        alone = set(alone)
        joined = [i for i in range(len(units)) if i not in alone] if alone else range(len(units))
        size = self.feed.itemsize
        for k in range(0, len(joined), 256):
            some = joined[k : k + 256]
            packed = self._encode(["".join([u if u[0] == "\n" else "\n " + u for u in map(units.__getitem__, some)])])[0]
            ids = np.frombuffer(packed, self.width)
            starts = np.flatnonzero(ids == self.feed)
            for i, a, b in zip(some, (starts * size).tolist(), (np.append(starts[1:], len(ids)) * size).tolist(), strict=True):
                out[i] = packed[a if units[i][0] == "\n" else a + size : b]
        return out

    def ids(self, text: str) -> np.ndarray:
        return next(self.each([text])).astype("<u4")


def library_ids(path: str, drops_space: bool) -> LibraryIds:
    """One per Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept_by_worker(("library", path, drops_space), lambda: LibraryIds(path, drops_space))


def tokenizer_path(name: str) -> str:
    """Place of a file of the public vocabularies, on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)

"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter trigram is the product of its letters' vectors, turned by two,
one and no places (so order counts); a text is the sum of its trigrams; a language is the sum of its texts, each scaled
to one per trigram. A text belongs to the language whose vector has the largest cosine with its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, kept_by_worker, remainder

DIMENSIONS = 1024
#: Letters below U+0180 have slots below this, others their code point above it.
SLOTS = 192
SMALL, BITS = SLOTS**3, 21
UNDETERMINED = "und"
#: More different labels than this are taken for a mistake: the profiles go to every task.
MOST_LANGUAGES = 2000


@lru_cache(maxsize=1)
def letter_slots() -> np.ndarray:
    """Slot of each code point: 0 if no letter, else a slot of its lower-case letter's own; Latin letters have the first ones."""
    latin = {}
    slots = np.zeros(0x110000, np.int64)
    for code in range(0x110000):
        letter = chr(code)
        if letter.isalpha():
            low = ord(letter.lower()[0])
            slots[code] = latin.setdefault(low, len(latin) + 1) if low < 0x180 else SLOTS + low
    assert len(latin) < SLOTS
    return slots


def trigrams(text: str) -> np.ndarray:
    """Codes of the letter trigrams of all words, the ends of a word included. Trigrams of the first slots have small codes."""
    slots = letter_slots()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    slots = np.concatenate(([0], slots, [0]))
    slots = slots[np.append((slots[1:] != 0) | (slots[:-1] != 0), True)]
    codes = (slots[:-2] * SLOTS + slots[1:-1]) * SLOTS + slots[2:]
    if slots.max() >= SLOTS:
        wide = np.maximum(np.maximum(slots[:-2], slots[1:-1]), slots[2:]) >= SLOTS
        codes = np.where(wide, SMALL + (slots[:-2] << 2 * BITS | slots[1:-1] << BITS | slots[2:]), codes)
    return codes[slots[1:-1] != 0]


class Vectors:
    """Vectors of trigrams, made when first met; at most ``most`` are held, then it starts anew."""

    def __init__(self, dimensions: int, most: int = 100_000):
        self.letters = np.random.default_rng(7).integers(0, 2, (SLOTS, dimensions), np.int8) * 2 - 1
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.row_of = np.full(SMALL, -1, np.int32)
        self.wide: dict[int, int] = {}
        self.others: dict[int, np.ndarray] = {}
        self.rows = np.empty((1024, self.letters.shape[1]), np.int8)
        self.used = 0

    def letter(self, slot: int) -> np.ndarray:
        """The vector of one letter; beyond the first slots, drawn from the letter itself."""
        if slot < SLOTS:
            return self.letters[slot]
        if slot not in self.others:
            self.others[slot] = np.random.default_rng((7, slot)).integers(0, 2, self.letters.shape[1], np.int8) * 2 - 1
        return self.others[slot]

    def add(self, new: np.ndarray) -> np.ndarray:
        """Rows for new trigrams: the letters' vectors turned by two, one and no places, and multiplied."""
        while self.used + len(new) > len(self.rows):
            self.rows = np.concatenate((self.rows, np.empty_like(self.rows)))
        small = new[new < SMALL]
        first, second, third = small // SLOTS**2, small // SLOTS % SLOTS, small % SLOTS
        made = [np.roll(self.letters[first], 2, 1) * np.roll(self.letters[second], 1, 1) * self.letters[third]]
        for code in (new[new >= SMALL] - SMALL).tolist():
            first, second, third = (self.letter(code >> k * BITS & (1 << BITS) - 1) for k in (2, 1, 0))
            made.append((np.roll(first, 2) * np.roll(second, 1) * third)[None])
        places = np.arange(self.used, self.used + len(new))
        self.rows[places] = np.concatenate(made)
        self.used += len(new)
        return places

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Row of each trigram."""
        wide = codes >= SMALL
        if wide.any():
            unique, at = np.unique(codes[wide], return_inverse=True)
            new = np.array([c for c in unique.tolist() if c not in self.wide], np.int64)
            self.wide.update(zip(new.tolist(), self.add(new).tolist()))
            places = np.empty(len(codes), np.int64)
            places[wide] = np.array([self.wide[c] for c in unique.tolist()])[at]
            places[~wide] = self.places(codes[~wide])
            return places
        places = self.row_of[codes]
        if (places < 0).any():
            new = np.unique(codes[places < 0])
            self.row_of[new] = self.add(new)
            places = self.row_of[codes]
        return places

    def bundle(self, codes: np.ndarray) -> np.ndarray:
        """Sum of the trigrams' vectors."""
        if self.used > self.most:
            self.clear()
        counts = np.bincount(self.places(codes))
        there = np.flatnonzero(counts)
        return counts[there].astype(np.float32) @ self.rows[there].astype(np.float32)


def vectors(dimensions: int) -> Vectors:
    """One per Python worker."""
    return kept_by_worker(("vectors", dimensions), lambda: Vectors(dimensions))


@dataclass
class Profiles:
    languages: list[str]
    matrix: np.ndarray  # a row of length 1 for each language

    def best(self, text: str | None) -> tuple[str, float]:
        codes = trigrams(text) if text else []
        if not len(codes) or not self.languages:
            return UNDETERMINED, 0.0
        own = vectors(self.matrix.shape[1]).bundle(codes)
        cosines = self.matrix @ own / max(float(np.linalg.norm(own)), 1e-9)
        k = int(np.argmax(cosines))
        return self.languages[k], float(min(1.0, max(0.0, cosines[k])))


def fit(df: DataFrame, text_col: str = "text", label_col: str = "lang", dimensions: int = DIMENSIONS) -> Profiles:
    """Learn from all rows that have a text and a label. Each task sends one vector per language."""

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = vectors(dimensions), {}
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                codes = trigrams(text.as_py())
                if len(codes):
                    sums.setdefault(label, np.zeros(dimensions))
                    sums[label] += known.bundle(codes) / np.float32(len(codes))
        flat = np.concatenate(list(sums.values())) if sums else np.zeros(0)
        names = [label for label in sums for _ in range(dimensions)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.tile(np.arange(dimensions, dtype=np.int32), len(sums))), pa.array(flat)], ["label", "place", "value"])

    rows = df.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label")).dropna()
    sums = rows.mapInArrow(bundled, "label string, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value"))
    found = sums.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("v")).limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels")
    found = sorted(found, key=lambda r: r["label"])
    matrix = np.array([[x["value"] for x in r["v"]] for r in found], np.float32).reshape(-1, dimensions)
    return Profiles([r["label"] for r in found], matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9))


def predict(df: DataFrame, profiles: Profiles, text_col: str = "text", label_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """``df`` with two more columns: the language (`und`: null text or no letter) and the cosine, 0 to 1. No shuffle."""

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.best(x.as_py()) for x in batch.column(text_col)]
            more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, label_as, score_as])

    if {label_as, score_as} & set(df.columns):
        raise ValueError(f"the table has a column {label_as} or {score_as} already")
    schema = df.schema.simpleString()[len("struct<") : -1]
    return df.mapInArrow(labelled, f"{schema}, {label_as} string, {score_as} double")


def held_out_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, lang_pred, score.

    Profiles are learned from all rows with a label whose crc32(id as text) mod 4 is not 2 (a null id is never held
    out, it has no remainder), and only the text is used to predict. A null text, or one without any letter, is `und`
    with score 0, and so is every text when there is nothing to learn from. Ties go to the first label in order.
    """
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(remainder(F.col(id_col), 4) == 2, F.lit(False)).alias("held_out"),
        F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"),
    )
    profiles = fit(rows.filter(~F.col("held_out")), "text", "label")
    return predict(rows.select("doc_id", "held_out", "text"), profiles).drop("text")


def with_language(df: DataFrame, text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The rows of ``df`` whose text has a language, with all their columns.

    Null and empty texts, and texts without any letter, are `und` and go. Where no row has a label, nothing can be told
    of a language, and all texts with a letter stay. Repeated rows stay as they are; an empty table gives no rows.
    """
    profiles = fit(df, text_col, label_col)
    found, likeness = fresh("language"), fresh("likeness")
    rows = predict(df, profiles, text_col, found, likeness)
    known = F.col(found) != UNDETERMINED if profiles.languages else F.col(text_col).rlike(r"\p{L}")
    return rows.filter(known).drop(found, likeness)

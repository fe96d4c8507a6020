"""Language-model scoring by prediction by partial matching over bytes, and a word baseline.

The model is a trie of byte contexts of up to ORDER bytes with the counts of what followed them. A symbol (a byte or
the end of the text) that followed the longest known context gets its share there; the rest of the probability, by
method C as many parts as there were different symbols, escapes to the context one byte shorter, in which all symbols
of the longer one are excluded. What is excluded depends on the longer context alone, so the probability of a symbol
in a context can be worked out once. The trie is a table per order, with every context of the training texts; chances
of the grams that occur are worked out by joins of these tables and joined to the grams of each block of texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, remainder, written

ORDER = 5
END, START, BITS = 256, 257, 9
SYMBOLS = 257  # bytes and the end
#: Bytes of text (and 8 a row) of a block, on average; a block's texts meet the chances of its grams in one task.
BLOCK = 1 << 23
#: Words whose counts go to every task: the most frequent ones, of at most LONGEST bytes.
FREQUENT, LONGEST = 100_000, 64
CHUNK = 1 << 20


def sequence(texts: list[bytes], order: int) -> np.ndarray:
    """Symbols of the texts side by side, each with ``order`` starts before and an end after it."""
    sizes = np.array([len(t) for t in texts])
    out = np.full(int(sizes.sum()) + len(texts) * (order + 1), START, np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    begins = np.cumsum(sizes + order + 1) - sizes - 1
    place = np.arange(len(data)) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
    out[place] = data
    out[begins + sizes] = END
    return out


def chunks(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text) + 8
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, inverse = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def codes_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each place of sequence() from ``order`` on, packed, and whether a symbol of a text is there."""
    symbols = sequence(texts, order)
    codes = reduce(lambda code, j: code << BITS | symbols[j : len(symbols) - order + j], range(1, order + 1), symbols[: len(symbols) - order])
    return codes, symbols[order:] != START


class Places:
    """The place of each of some distinct codes (none negative), by open addressing in arrays.

    A text's grams come in no order, so that a binary search in the codes of a block waits for memory at each step.
    """

    SPREAD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, codes: np.ndarray):
        bits = max(4, (2 * len(codes)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.keys = np.zeros(1 << bits, np.int64), np.full(1 << bits, -1)
        at, left = self._first(codes), np.arange(len(codes))
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]], self.slots[at[free]] = codes[left[free]], left[free]
            lost = self.keys[at] != codes[left]
            at, left = at[lost] + 1 & self.mask, left[lost]

    def _first(self, codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * self.SPREAD >> self.shift).astype(np.int64)

    def of(self, wanted: np.ndarray) -> np.ndarray:
        at = self._first(wanted)
        missed = np.flatnonzero(self.keys[at] != wanted)
        while len(missed):
            at[missed] = at[missed] + 1 & self.mask
            again = self.keys[at[missed]]
            if (again < 0).any():
                raise KeyError("a gram without a chance")
            missed = missed[again != wanted[missed]]
        return self.slots[at]


def block_grams(blocks: DataFrame, order: int) -> DataFrame:
    """(block, code, n): each gram of a block's texts, ``order`` symbols and the one after them, and its count in those to learn from."""

    def counted(table: pa.Table) -> pa.Table:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        held_out = table.column("held_out").to_numpy()
        for held in (True, False):
            for texts in chunks(x.as_py().lower() for x in table.column("text").filter(pa.array(held_out == held))):
                codes, inner = codes_of(texts, order)
                codes, n = np.unique(codes[inner], return_counts=True)
                parts.append((codes, n * (not held)))
                if sum(len(c) for c, _ in parts) > 4_000_000:
                    parts = [merged(parts)]
        codes, n = merged(parts)
        return pa.table({"block": np.full(len(codes), table.column("block")[0].as_py(), np.int64), "code": codes, "n": n})

    return blocks.groupBy("block").applyInArrow(counted, "block long, code long, n long")


def gram_chances(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(code, chance): log10 of the chance of each gram's last symbol after the others, from all counts ``n`` (0: unseen).

    A table per order has each gram as (context, symbol), the context's total and kinds of symbols. A symbol unseen
    after a known context has what is left there (escape) and its chance in the shorter context without the longer
    one's symbols (onward). All joins are by gram or context and a key has at most one row per symbol, whatever the corpus.
    """
    low = lambda k: F.lit((1 << BITS * (k + 1)) - 1)
    same = Window.partitionBy("context")
    tables = {}
    for k in range(order, -1, -1):
        counts = (grams if k == order else tables[k + 1].select(F.col("code").bitwiseAND(low(k)).alias("code"), "n")).groupBy("code").agg(F.sum("n").alias("n"))
        counts = counts.withColumn("context", F.shiftright("code", BITS))
        seen = F.col("n") > 0
        tables[k] = written(
            counts.select(
                "code", "n", F.sum("n").over(same).alias("total"), F.sum(seen.cast("long")).over(same).alias("kinds"), F.min("n").over(same).alias("least")
            ),
            "grams",
            "zstd",  # a window sorted them by context, so that neighbours have most bytes in common
        ).withColumn("context", F.shiftright("code", BITS))
    unseen = F.col("n") == 0
    escape = F.log10(F.col("kinds") / (F.col("total") + F.col("kinds")))
    direct = F.log10(F.col("n") / (F.col("total") + F.col("kinds")))
    out = None
    for k in range(order + 1):
        if k == 0:
            rest = tables[0].withColumn("onward", F.when(unseen, -F.log10(F.lit(SYMBOLS) - F.col("kinds"))))
            out = rest.withColumn("chance", F.when(~unseen, direct).otherwise(F.when(F.col("total") > 0, escape).otherwise(0.0) + F.col("onward")))
            continue
        shorter = tables[k - 1].select(F.col("code").alias("up"), F.col("n").alias("up_seen"))
        # what the shorter context counts of the symbols seen after the longer one
        excluded = tables[k].filter("n > 0 AND least = 0").withColumn("up", F.col("code").bitwiseAND(low(k - 1))).join(shorter, "up")
        excluded = excluded.groupBy("context").agg(F.sum("up_seen").alias("excluded"))
        up = out.select(
            F.col("code").alias("up"), F.col("n").alias("up_n"), F.col("total").alias("up_total"), F.col("kinds").alias("up_kinds"), F.col("onward").alias("up_onward"), F.col("chance").alias("up_chance")
        )
        rest = tables[k].filter(unseen).withColumn("up", F.col("code").bitwiseAND(low(k - 1))).join(up, "up").join(excluded, "context", "left")
        kinds = F.col("up_kinds") - F.col("kinds")
        parts = F.col("up_total") - F.col("excluded") + kinds
        onward = F.when(F.col("up_n") > 0, F.log10(F.col("up_n") / parts)).otherwise(F.when(kinds > 0, F.log10(kinds / parts)).otherwise(0.0) + F.col("up_onward"))
        rest = rest.withColumn("onward", F.when(F.col("total") > 0, onward))
        rest = rest.select("code", "n", "total", "kinds", "onward", F.when(F.col("total") > 0, escape + F.col("onward")).otherwise(F.col("up_chance")).alias("chance"))
        found = tables[k].filter(~unseen).select("code", "n", "total", "kinds", F.lit(None).cast("double").alias("onward"), direct.alias("chance"))
        out = found.unionByName(rest)
    return out.select("code", F.col("chance").cast("float").alias("chance"))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_counts(df: DataFrame) -> DataFrame:
    """(word, n) over all texts, in lower case. Added up per task first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(words_of(text.as_py()))
                if len(counts) > 500_000:
                    yield batch_of(counts)
                    counts = Counter()
        yield batch_of(counts)

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return df.select(F.col("text").cast("binary")).mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def scored_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Both models learn from the texts whose crc32(id as text) mod 7 is not 2 (a null id has no remainder and is learned
    from), in lower case (A-Z). score: log10 probability of the text's bytes and its end. base_score: sum over its
    words and one end of log10((c + 1) / (N + V + 1)). Counts of the FREQUENT words go to the tasks; other words meet
    their counts by a join, which has no word that is frequent.

    Texts are dealt into blocks by hash. A block's distinct grams are counted in one task, and meet their chances, and
    then its texts, by joins; every context that was counted is used.

    Null and empty texts are the end alone; repeated rows are scored each; with nothing to learn from all symbols are
    alike; an empty table gives no rows.
    """
    spark = df.sparkSession
    rows = id_and_text(df, id_col, text_col).withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False)))
    training = rows.filter(~F.col("held_out"))
    size = rows.agg(F.sum(F.octet_length("text") + 8).alias("n")).first()["n"] or 0
    blocks = rows.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-size // BLOCK)))).alias("block"), "doc_id", "held_out", F.col("text").cast("binary").alias("text")
    )
    grams = written(block_grams(blocks, order), "blocks", "zstd")
    # written by itself, so that what was shuffled for the chances is gone before the grams of the blocks are
    chances = grams.select("block", "code").join(written(gram_chances(grams.select("code", "n"), order), "chances", "zstd"), "code")
    counts = written(word_counts(training), "words")
    texts = training.count()
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, distinct = sums["n"] + texts, sums["v"] + (texts > 0)
    top = counts.filter(F.length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    shared = spark.sparkContext.broadcast(dict(zip(top.column("word").to_pylist(), top.column("n").to_pylist())))
    del top
    end = math.log10(texts + 1)

    def score(table: pa.Table, chances: pa.Table) -> pa.Table:
        logs = {w: math.log10(n + 1) for w, n in shared.value.items()}
        place = table.column("block")[0].as_py() << 32
        places, logs10 = Places(chances.column("code").to_numpy()), chances.column("chance").to_numpy()
        columns = ("place", "doc_id", "held_out", "n_tokens", "n_known", "logs", "score")
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        rows = iter(zip(table.column("doc_id").to_pylist(), table.column("held_out").to_pylist()))
        out: list[list] = [[] for _ in columns]
        rare_words, times, ends = [], [], [0]
        for texts in chunks(x.as_py().lower() for x in table.column("text")):
            wanted, inner = codes_of(texts, order)
            cost = np.zeros(len(wanted))
            cost[inner] = logs10[places.of(wanted[inner])]
            begins = np.cumsum([0, *(len(t) + order + 1 for t in texts)])[:-1]
            for text, ppm in zip(texts, np.add.reduceat(cost, begins).tolist()):
                doc_id, held_out = next(rows)
                words = text.split()
                found = list(map(logs.get, words))
                rest = Counter(w for w, x in zip(words, found) if x is None) if None in found else {}
                total = sum(x for x in found if x is not None) if rest else sum(found)
                known = len(words) - sum(rest.values()) + (end > 0)
                for column, value in zip(out, (place, doc_id, held_out, len(words) + 1, known, total + end, ppm)):
                    column.append(value)
                rare_words.extend(rest.keys())
                times.extend(rest.values())
                ends.append(len(times))
                place += 1
        lists = [pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), x).cast(pa.list_(x.type)) for x in (pa.array(rare_words, pa.binary()), pa.array(times, pa.int64()))]
        return pa.table([*(pa.array(x, t) for x, t in zip(out, kinds)), *lists], [*columns, "words", "times"])

    table = written(
        blocks.groupBy("block").cogroup(chances.groupBy("block")).applyInArrow(
            score, "place long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, words array<binary>, times array<long>"
        ),
        "scored",
    )
    rare = table.select("place", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("times").alias("times"))))
    rare = rare.join(counts, "word").groupBy("place").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_logs"))
    whole = table.drop("words", "times").join(rare, "place", "left")
    none = F.lit(0)
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", none)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rare_logs", none) - F.col("n_tokens") * math.log10(tokens + distinct + 1)).alias("base_score"), "score",
    )

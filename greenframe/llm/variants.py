"""Spelling variants: words one edit apart, found in a trie over counts of letter groups, and the form each one leads to.

A word is arranged by how often it has the letters of each group, one group per level. One edit raises the count of at
most one group by one (the surplus) and lowers that of at most one group by one (the deficit). A depth-first search
through the trie spends one of each; the words at the leaves it reaches are compared letter by letter. The upper levels
of the trie deal its subtrees to the tasks: each word is sent to the subtrees that its search would enter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Levels of the trie: letters whose code points agree modulo so many are one group.
GROUPS = 16
#: Levels that deal out the subtrees, at most; and words of a subtree that are still one task's.
MOST_DEALT, MOST_WORDS = 8, 50_000
#: Different words that a task adds up before it sends them on.
MOST_COUNTED = 500_000
#: Words longer than this are compared one by one instead of as rows of a matrix.
LONG = 48
#: Members of a node that the search compares at once instead of going deeper.
BUCKET = 24

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: A subtree's number is the sum of its counts times these, so that its neighbours' numbers are differences away.
_FACTORS = np.random.default_rng(12).integers(1 << 62, size=GROUPS, dtype=np.int64) * 2 + 1


def deleted(word: bytes, place: int) -> bytes:
    text = word.decode()
    return (text[:place] + text[place + 1 :]).encode()


def counted_words(df: DataFrame, id_col: str, text_col: str, least_letters: int, least_count: int, every: int | None) -> DataFrame:
    """(word, n): runs of letters of all texts; where ``every`` divides the checksum of id and run, one letter is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = defaultdict(int)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                start = zlib.crc32(f"{doc_id}:".encode())
                for word, n in Counter(_RUN.findall(text.as_py().encode("utf-8", "surrogatepass").lower())).items():
                    if len(word) < least_letters:
                        continue
                    if every and (h := zlib.crc32(word, start)) % every == 0:
                        word = deleted(word, h % (len(word) - word.count(b"\xc3")))
                    if len(word) - word.count(b"\xc3") >= least_letters:
                        total[word] += n
                if len(total) >= MOST_COUNTED:
                    yield counts(total)
                    total.clear()
        yield counts(total)

    def counts(total: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    texts = df.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text")).dropna(subset=["text"])
    texts = texts.withColumn("doc_id", F.coalesce("doc_id", F.lit("null")))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def letters_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words one after the other, and the length of each; words are Latin-1."""
    return np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))


def vectors(words: list[bytes], order: list[int]) -> np.ndarray:
    """Counts of each letter group, a row per word, levels in ``order``."""
    codes, sizes = letters_of(words)
    at = np.repeat(np.arange(len(words)), sizes) * GROUPS + codes % GROUPS
    return np.bincount(at, minlength=len(words) * GROUPS).reshape(-1, GROUPS)[:, order]


def latin(column) -> list[bytes]:
    return [x.encode("latin-1") for x in column]


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether exactly one letter was inserted, deleted or replaced."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[i + 1 :] == b[i + (len(a) == len(b)) :]


class Letters:
    """Words as rows of a matrix, for comparing many pairs at once."""

    def __init__(self, words: list[bytes]):
        self.words, self.size = words, np.fromiter(map(len, words), np.int64, len(words))
        self.matrix = np.frombuffer(b"".join(x[:LONG].ljust(LONG, b"\0") for x in words), np.uint8).reshape(-1, LONG)

    def one_edit(self, other: Letters, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        """Of the pairs (mine[k], theirs[k]), which are one edit apart."""
        good = np.zeros(len(mine), bool)
        long = (self.size[mine] > LONG) | (other.size[theirs] > LONG)
        for k in np.flatnonzero(long):
            good[k] = one_edit(self.words[mine[k]], other.words[theirs[k]])
        gap = self.size[mine] - other.size[theirs]
        same = np.flatnonzero(~long & (gap == 0))
        good[same] = (self.matrix[mine[same]] != other.matrix[theirs[same]]).sum(axis=1) == 1
        for sign in (1, -1):
            k = np.flatnonzero(~long & (gap == sign))
            longer, shorter = (self.matrix[mine[k]], other.matrix[theirs[k]])[::sign]
            size = np.minimum(self.size[mine[k]], other.size[theirs[k]])
            head = np.logical_and.accumulate(longer == shorter, axis=1).sum(axis=1)  # letters that agree from the start
            tail = np.logical_and.accumulate((longer[:, 1:] == shorter[:, :-1])[:, ::-1], axis=1).sum(axis=1)  # and from the end
            good[k] = np.minimum(head, size) + np.minimum(tail - (LONG - 1 - size), size) >= size
        return good


def halves(members: list[bytes], queries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that agree in their first or their last half, which one edit leaves as it is; members have one length."""
    found = set()
    for size in {min(len(members[0]), len(q)) // 2 for q in queries}:
        heads, tails = defaultdict(list), defaultdict(list)
        for i, x in enumerate(members):
            heads[x[:size]].append(i)
            tails[x[-size:]].append(i)
        for j, q in enumerate(queries):
            if min(len(members[0]), len(q)) // 2 == size:
                found.update((i, j) for i in {*heads.get(q[:size], ()), *tails.get(q[-size:], ())})
    pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def search(members: np.ndarray, queries: np.ndarray, words: list[bytes], asked: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (member, query) whose vectors differ by at most one surplus and one deficit.

    ``members`` are sorted, so a node of the trie is a stretch of rows. The search takes all queries that are still
    within their budget down to each child together.
    """
    stack = [(0, len(members), 0, np.arange(len(queries)), np.ones(len(queries), np.int8), np.ones(len(queries), np.int8))]
    while stack:
        low, high, level, q, surplus, deficit = stack.pop()
        if level == GROUPS:
            if (high - low) * len(q) > 4096:
                i, j = halves(words[low:high], [asked[k] for k in q])
            else:
                i, j = (x.ravel() for x in np.meshgrid(np.arange(high - low), np.arange(len(q)), indexing="ij"))
            yield low + i, q[j]
        elif high - low <= BUCKET:
            gap = members[low:high, None, level:] - queries[None, q, level:]
            more, less = np.maximum(gap, 0).sum(axis=2), np.maximum(-gap, 0).sum(axis=2)
            i, j = np.nonzero((more <= surplus) & (less <= deficit))
            yield low + i, q[j]
        else:
            column, wanted = members[low:high, level], queries[q, level]
            cuts = [0, *(np.flatnonzero(np.diff(column)) + 1), high - low]
            for a, b in zip(cuts, cuts[1:]):
                gap = column[a] - wanted
                alive = np.flatnonzero((gap == 0) | (gap == 1) & (surplus == 1) | (gap == -1) & (deficit == 1))
                if len(alive):
                    gap = gap[alive]
                    stack.append((low + a, low + b, level + 1, q[alive], surplus[alive] - (gap == 1), deficit[alive] - (gap == -1)))


NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])


def near_in_subtree(table: pa.Table, order: list[int]) -> pa.Table:
    """Rows (key, word, n, own): members have no ``own``, queries the number of their own subtree.

    Each pair of words is found in one place only, so it counts for both: (word, n_near, form_n, form) of both sides.
    """
    is_member = table["own"].is_null()
    sides = [table.filter(is_member), table.filter(pc.invert(is_member))]
    if not len(sides[0]) or not len(sides[1]):
        return NEAR.empty_table()
    words = latin(sides[0]["word"].to_pylist())
    rows = vectors(words, order).astype(np.int32)
    sort = np.lexsort(rows.T[::-1])
    sides[0], words, rows = sides[0].take(pa.array(sort)), [words[i] for i in sort], rows[sort]
    names, ns = [x["word"].to_pylist() for x in sides], [x["n"].to_numpy() for x in sides]
    asked = latin(names[1])
    own = pc.equal(sides[1]["own"], sides[1]["key"]).to_numpy()
    members, queries = Letters(words), Letters(asked)
    n_near = [np.zeros(len(x), np.int64) for x in names]
    best = [np.full(len(x), -1, np.int64) for x in names]

    def settle(i: np.ndarray, j: np.ndarray) -> None:
        good = members.one_edit(queries, i, j)
        i, j = i[good], j[good]
        first = np.array([not own[y] or names[1][y] < names[0][x] for x, y in zip(i, j)], bool)
        i, j = i[first], j[first]
        for side, a, b in ((0, i, j), (1, j, i)):
            other = 1 - side
            n_near[side] += np.bincount(a, minlength=len(n_near[side]))
            for k, x in zip(a, b):
                y = best[side][k]
                if y < 0 or (-ns[other][x], names[other][x]) < (-ns[other][y], names[other][y]):
                    best[side][k] = x

    held, size = [], 0
    for i, j in search(rows, vectors(asked, order).astype(np.int32), words, asked):
        held.append((i, j))
        size += len(i)
        if size > 200_000:
            settle(*(np.concatenate(x) for x in zip(*held)))
            held, size = [], 0
    if held:
        settle(*(np.concatenate(x) for x in zip(*held)))
    out = []
    for side in (0, 1):
        k = np.flatnonzero(n_near[side])
        x = best[side][k]
        columns = [[names[side][i] for i in k], n_near[side][k], ns[1 - side][x], [names[1 - side][i] for i in x]]
        out.append(pa.table(dict(zip(NEAR.names, columns)), NEAR))
    return pa.concat_tables(out)


def near_words(words: DataFrame) -> DataFrame:
    """Of a written table (word, n) of distinct Latin-1 words: word, n_near, form_n, form (the near word of largest n)."""

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, _ = letters_of(latin(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(range(GROUPS)), pa.array(np.bincount(codes % GROUPS, minlength=GROUPS))], ["g", "n"])

    # the commonest letters first, since they tell most words apart; one number per group
    totals = words.select("word").mapInArrow(letters, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()
    order = [r["g"] for r in sorted(totals, key=lambda r: (-r["n"], r["g"]))] or list(range(GROUPS))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.cumsum(vectors(latin(batch.column(0).to_pylist()), order)[:, :MOST_DEALT] * _FACTORS[:MOST_DEALT], axis=1)
            found = [np.unique(keys[:, k], return_counts=True) for k in range(MOST_DEALT)]
            columns = [np.repeat(range(MOST_DEALT), [len(x) for x, _ in found]), *map(np.concatenate, zip(*found))]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["level", "key", "n"])

    sizes = words.select("word").mapInArrow(prefixes, "level long, key long, n long").groupBy("level", "key").agg(F.sum("n").alias("n"))
    largest = {r["level"]: r["n"] for r in sizes.groupBy("level").agg(F.max("n").alias("n")).collect()}
    # one row per level at most; the fewest levels that make the subtrees small, for each level multiplies the queries
    dealt = next((k for k in range(MOST_DEALT) if largest.get(k, 0) <= MOST_WORDS), MOST_DEALT - 1) + 1
    crowded = largest.get(dealt - 1, 0) > MOST_WORDS

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _FACTORS[:dealt]
        for batch in batches:
            counts = vectors(latin(batch.column(0).to_pylist()), order)[:, :dealt]
            keys, rows = (counts * factors).sum(axis=1), np.arange(len(counts))
            out = [(rows, keys, None), (rows, keys, keys)]
            for up in range(-1, dealt):
                for down in range(-1, dealt):
                    if up != down:
                        there = keys + (factors[up] if up >= 0 else 0) - (factors[down] if down >= 0 else 0)
                        # of two subtrees, the words of one are sent to the other
                        go = (there < keys) & ((counts[:, down] > 0) if down >= 0 else True)
                        out.append((rows[go], there[go], keys[go]))
            for row, key, own in out:
                took = batch.take(pa.array(row))
                own = pa.nulls(len(row), pa.int64()) if own is None else pa.array(own)
                yield pa.RecordBatch.from_arrays([pa.array(key), *took.columns, own], ["key", "word", "n", "own"])

    dealt_out = words.select("word", "n").mapInArrow(sent, "key long, word string, n long, own long")
    if crowded:
        # a subtree too large for one task is cut into chunks of members, each of which all its queries visit
        chunks = sizes.filter((F.col("level") == dealt - 1) & (F.col("n") > MOST_WORDS)).select("key", F.ceil(F.col("n") / MOST_WORDS).cast("int").alias("chunks"))
        dealt_out = dealt_out.join(chunks, "key", "left").fillna(1, ["chunks"])
        one = F.array(F.pmod(F.xxhash64("word"), F.col("chunks").cast("long")).cast("int"))
        dealt_out = dealt_out.withColumn("chunk", F.explode(F.when(F.col("own").isNull(), one).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))))
    else:
        dealt_out = dealt_out.withColumn("chunk", F.lit(0))
    found = dealt_out.groupBy("key", "chunk").applyInArrow(lambda table: near_in_subtree(table, order), "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.m")).alias("form_n"), F.col("best.form").alias("form"))


def with_roots(links: DataFrame) -> DataFrame:
    """(word, form) to (word, root): forms followed to the last one, doubling the steps each time. Forms must not go in circles."""
    roots = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = written(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            return roots


def spelling_variants(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 5, least_count: int = 3, times: int = 2, every: int | None = 97
) -> DataFrame:
    """One row per word of at least ``least_letters`` letters and ``least_count`` occurrences in all texts together:
    word, form, root, n, n_near, form_n.

    Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; where ``every`` divides the checksum
    of ``<doc_id>:<word>``, one letter is left out (None: nowhere; a null id counts as ``null``). n_near: words exactly
    one inserted, deleted or replaced letter away. form: the near word of largest n (ties: the smallest), if its n is at
    least ``times`` (2 or more, so that forms cannot go in circles) the word's own. root: the last form of forms; the word itself if none.

    Null and empty texts have no words; repeated rows count each; an empty table gives no rows.
    """
    if times < 2:
        raise ValueError("times must be at least 2")
    words = written(counted_words(df, id_col, text_col, least_letters, least_count, every), "words")
    near = near_words(words)
    near = words.join(near.withColumnRenamed("form_n", "most"), "word", "left")
    is_form = F.col("most") >= F.col("n") * times
    near = written(
        near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("most")).alias("form_n")), "near"
    )
    roots = with_roots(near.filter(F.col("form").isNotNull()))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

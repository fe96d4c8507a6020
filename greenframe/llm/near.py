"""Near duplicates by BagMinHash: bags of five-word shingles, weighted Jaccard similarity of 0.8 and more.

A signature has one component per hash value. For each distinct shingle and each dyadic interval of weights below its
count, a Poisson process yields points in ascending order; a point has a random component and a random weight inside
the interval, and counts if that weight is below the shingle's count. A component is the point that comes first. Two
bags agree in a component with the probability of their weighted Jaccard similarity. Only points that can still come
first are made: beyond a bound that depends on the bag's size there are none, unless a component stays empty.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_BATCH, fresh, kept_by_worker, row_key, written
from .repeats import AGAIN, MIX, gram_hashes, mixed

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 40, 6  # a pair of similarity 0.8 is missed with a probability below 1e-5
AT_ONCE = 200_000
#: Longs of 64 parities each: members of a bag fall into as many cells.
PARITIES = 8
#: Bytes of the bags of a cell's pairs.
CELL = 1 << 22


def shingle_bag(words: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles and how often each occurs. A shorter text is one shingle."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    each = np.fromiter((zlib.crc32(w) << 20 ^ zlib.adler32(w) for w in words), np.uint64, len(words))
    return np.unique(gram_hashes(mixed((each + np.uint64(1)) * MIX), min(size, len(words))), return_counts=True)


def chance(seeds: np.ndarray, step: int, kind: int) -> np.ndarray:
    return mixed((seeds + np.uint64(step * 4 + kind + 1) * AGAIN) * MIX)


def bag_signatures(bags: list[tuple[np.ndarray, np.ndarray]], components: int) -> np.ndarray:
    """One row per non-empty bag: the identity of the first point of each component."""
    elements = np.concatenate([b[0] for b in bags])
    weights = np.concatenate([b[1] for b in bags])
    owner = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    totals = np.bincount(owner, weights)
    parts = []  # seed, bag, weight, lower end and size of the interval
    low, high = 0, 1
    while (there := np.flatnonzero(weights > low)).size:
        parts.append((mixed(elements[there] + np.uint64(low) * MIX), owner[there], weights[there], np.full(len(there), low), np.full(len(there), high - low)))
        low, high = high, 2 * high
    seeds, bag, weight, lower, size = (np.concatenate(x) for x in zip(*parts))
    signature = np.zeros((len(bags), components), np.uint64)
    pending, reach = np.ones(len(bags), bool), (math.log(components) + 4) / totals
    while pending.any():
        entry = np.flatnonzero(pending[bag])
        x, step, points = np.zeros(len(entry)), 0, []
        while len(entry):
            seed = seeds[entry]
            uniform = ((chance(seed, step, 0) >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)
            x = x - np.log(uniform) / (components * size[entry])
            near = x <= reach[bag[entry]]
            entry, x, seed = entry[near], x[near], seed[near]
            level = chance(seed, step, 2)
            counts = lower[entry] + (level % size[entry].astype(np.uint64)).astype(np.int64) < weight[entry]
            place = bag[entry] * components + (chance(seed, step, 1) % np.uint64(components)).astype(np.int64)
            points.append((x[counts], place[counts], (seed + np.uint64(step))[counts]))
            step += 1
        x, place, identity = (np.concatenate(p) for p in zip(*points))
        order = np.argsort(-x, kind="stable")  # the smallest is written last
        flat = np.zeros(len(bags) * components, np.uint64)
        filled = np.zeros(len(flat), bool)
        flat[place[order]] = mixed(identity[order]) | np.uint64(1)
        filled[place] = True
        done = pending & filled.reshape(signature.shape).all(1)
        signature[done] = flat.reshape(signature.shape)[done]
        pending &= ~done
        reach = np.where(pending, 2 * reach, reach)
    return signature


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * MIX, parts.shape[:2]).copy()
    for i in range(rows):
        key = mixed(key * AGAIN + parts[:, :, i])
    return key.view(np.int64)


def bag_members(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The bag as a sorted set: each further occurrence of a shingle is a member of its own."""
    elements, weights = shingle_bag(words, size)
    begins = np.repeat(np.cumsum(weights) - weights, weights)
    nth = (np.arange(len(begins)) - begins).astype(np.uint64)
    repeated = np.repeat(elements, weights)
    return np.sort(np.where(nth > 0, mixed(repeated + nth * MIX), repeated))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags, given by their members."""
    either = len(np.union1d(a, b))
    return (len(a) + len(b) - either) / max(1, either)


def parities(members: np.ndarray) -> np.ndarray:
    """Whether the number of members in each cell is odd. Two bags differ in at least as many members as cells."""
    cells = 64 * PARITIES
    return np.packbits(np.bincount((members % np.uint64(cells)).astype(np.int64), minlength=cells).astype(np.uint8) & 1).view(np.int64)


def signed(df: DataFrame) -> DataFrame:
    """doc_id, digest of the words, shingles in the bag, band keys. One pass, no shuffle."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            full = [i for i, b in enumerate(bags) if len(b[0])]
            keys: list = [[] for _ in bags]
            if full:
                for i, row in zip(full, band_keys(bag_signatures([bags[i] for i in full], BANDS * ROWS))):
                    keys[i] = row
            sizes = [int(b[1].sum()) for b in bags]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "digest", "size", "keys"])

        kept_by_worker(("near",))
        ids, digests, bags, held = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = text.as_py().split()
                ids.append(doc_id)
                digests.append(hashlib.md5(b" ".join(words)).digest())
                bags.append(shingle_bag(words))
                held += len(words) + 100
                if held >= AT_ONCE:
                    yield flush()
                    ids, digests, bags, held = [], [], [], 0
        if ids:
            yield flush()

    return df.select("doc_id", F.col("text").cast("binary")).mapInArrow(sign, "doc_id long, digest binary, size long, keys array<long>")


def bags_of(rows: DataFrame) -> DataFrame:
    """doc_id, the members of the bag, 8 bytes each, and their parities."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker(("near",))
        for batch in batches:
            bags = [bag_members(text.as_py().split()) for text in batch.column(1)]
            sides = [pa.array([x.tobytes() for x in bags], pa.binary()), pa.array([parities(x) for x in bags], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sides], ["doc_id", "bag", "parity"])

    return rows.select("doc_id", F.col("text").cast("binary")).mapInArrow(pack, "doc_id long, bag binary, parity array<long>")


def compared(pairs: DataFrame, bags: DataFrame, around: bool = False) -> DataFrame:
    """The pairs (a, b) with the similarity of their bags.

    Pairs are dealt into cells and each bag is sent once to each cell that needs it, however many pairs it is in there:
    by both documents, or, where many pairs lie ``around`` few documents a, by b alone. Cells are bounded by the bytes
    of their pairs' bags, on average.
    """
    pairs = written(pairs, "pairs")
    n = pairs.count()
    mean = bags.agg(F.avg(F.octet_length("bag"))).first()[0] or 0
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = math.isqrt(max(tasks, int(n * (mean + 8) / CELL))) + 1
    by_b = F.pmod(F.xxhash64("b"), F.lit(side * side if around else side))
    cell = by_b if around else F.pmod(F.xxhash64("a", F.lit(1)), F.lit(side)) * side + by_b
    dealt = pairs.withColumn("cell", cell)
    sides = [dealt.select(F.col("cell").alias("to"), F.col(x).alias("doc_id")).distinct() for x in ("a", "b")]
    needed = sides[0].unionByName(sides[1])
    sent = needed.join(bags.select("doc_id", "bag"), "doc_id").select("to", "doc_id", "bag")

    def compare(pairs: pa.Table, bags: pa.Table) -> pa.Table:
        kept_by_worker(("near",))
        members = {i: np.frombuffer(x.as_buffer(), np.uint64) for i, x in zip(bags["doc_id"].to_pylist(), bags["bag"])}
        a, b = pairs["a"].to_pylist(), pairs["b"].to_pylist()
        return pa.table({"a": pairs["a"], "b": pairs["b"], "s": pa.array([similarity(members[x], members[y]) for x, y in zip(a, b)], pa.float64())})

    return written(dealt.groupBy("cell").cogroup(sent.groupBy("to")).applyInArrow(compare, "a long, b long, s double"), "compared")


def settled(edges: DataFrame) -> bool:
    """Whether each node of the distinct edges (a > b) hangs on one other node, which itself hangs on none."""
    ends = F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("up")), F.struct(F.col("b").alias("n"), F.lit(0).alias("up")))
    nodes = edges.select(F.inline(ends)).groupBy("n").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return nodes.filter("ups > 1 OR (ups = 1 AND least = 0)").count() == 0


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the connected components; root is the smallest node.

    Large and small stars by turns: each node hangs its neighbours on the smallest of them, until all hang on a root.
    The number of rounds grows with the logarithm of the longest chain; each is written to the shared folder.
    """

    def star(edges: DataFrame, small: bool) -> DataFrame:
        near = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "n")
        hung = near.join(least, near["a"] == least["n"]).select("a", "b", "m")
        if small:
            out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(hung.select("a", F.col("m").alias("b")))
        else:
            out = hung.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.filter("a <> b").distinct()

    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = written(edges.distinct(), "links")
    while not settled(edges):
        edges = written(star(star(edges, False), True), "stars")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The classes of ``roots`` as (node, root) after further links."""
    return written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links)), "roots")


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its class), copy_of (smallest id with the same words), kept.

    Classes are the connected components of links of similarity ``least`` and more; the row of the smallest id is kept.
    Null and empty texts have no shingle and form one class; texts of one to four words are one shingle. Rows that
    repeat both id and text are one document with a row each. Rows of one id with different texts are documents of their
    own, and so are rows without an id: they come after all others in a class, and their class_id and copy_of are null
    where no row with an id is in it. An empty table gives no rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), row_key(F.col(id_col), F.col(text_col)).alias("key"))
    keys = written(rows.select("doc_id", "key").distinct(), "keys")
    firsts = keys.filter("doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("key"))
    odd = keys.join(firsts, "key", "left_anti")
    if odd.isEmpty():
        return classes_of(rows.drop("key"), least)
    # further texts of an id, and rows without one, go by numbers above all ids
    top = max(0, keys.agg(F.max("doc_id")).first()[0] or 0)
    odd = written(odd.select("key", (F.monotonically_increasing_id() + F.lit(top + 1)).alias("number")), "numbers")
    rows = rows.join(odd, "key", "left").withColumn("number", F.coalesce("number", "doc_id"))
    found = written(classes_of(rows.select(F.col("number").alias("doc_id"), "text"), least).distinct(), "classes")
    named = rows.select("doc_id", "number").join(found.withColumnRenamed("doc_id", "number"), "number")
    in_class = named.groupBy("class_id").agg(F.min("doc_id").alias("least_id"))
    same = named.groupBy("copy_of").agg(F.min("doc_id").alias("same_id"))
    return named.join(in_class, "class_id").join(same, "copy_of").select("doc_id", F.col("least_id").alias("class_id"), F.col("same_id").alias("copy_of"), "kept")


def classes_of(rows: DataFrame, least: float) -> DataFrame:
    """near_classes() of (doc_id, text) without nulls, in which rows of one id have one text.

    Documents with the same words are settled by a digest and stand for one. Of the others, the members of a band bucket
    are first compared with the smallest, then, where classes still differ, with two members drawn by a hash: a large
    group of near copies mostly becomes one class by a few comparisons each. What is in different classes even then is
    compared pair by pair, each pair in the first of its common buckets, but for pairs that cannot reach ``least``: by
    the sizes of their bags, by the parities of their members, fewer of which differ than members do, or because
    1 - similarity is a metric and their distances to the bucket's smallest member differ by more than 1 - ``least``.
    So no link between classes is lost.
    """
    table = written(signed(rows), "signed", batch=SMALL_BATCH)
    first = table.groupBy("digest").agg(F.min("doc_id").alias("copy_of"))
    members = written(table.select("doc_id", "digest").join(first, "digest").select("doc_id", "copy_of"), "members")
    distinct = table.join(first, (table["digest"] == first["digest"]) & (table["doc_id"] == first["copy_of"]), "left_semi")
    buckets = distinct.dropDuplicates(["doc_id"]).select("doc_id", "size", F.explode("keys").alias("key"))
    centres = buckets.groupBy("key").agg(F.min("doc_id").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "centre")
    buckets = written(buckets.join(centres, "key"), "buckets")
    wanted = buckets.select("doc_id").distinct()
    bags = written(bags_of(rows.join(wanted, "doc_id", "left_semi")).dropDuplicates(["doc_id"]), "bags", batch=SMALL_BATCH)

    differ = F.expr(" + ".join(f"bit_count(parity_a[{k}] ^ parity_b[{k}])" for k in range(PARITIES)))
    fits = (F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b")) & (differ <= (1 - least) / (1 + least) * (F.col("size_a") + F.col("size_b")) + 1e-9)

    def open_buckets(roots: DataFrame) -> DataFrame:
        """The buckets that still hold several classes, with the class of each member."""
        placed = buckets.join(roots, buckets["doc_id"] == roots["node"], "left").select("key", "centre", "doc_id", "size", F.coalesce("root", "doc_id").alias("root"))
        several = placed.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("key")
        return written(placed.join(several, "key").join(bags.select("doc_id", "parity"), "doc_id"), "open")

    def links_of(pairs: DataFrame) -> DataFrame:
        return pairs.filter(F.col("s") >= least).select("a", "b")

    stars = compared(buckets.filter("doc_id <> centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct(), bags, around=True)
    roots = written(components(links_of(stars)), "roots")
    still = open_buckets(roots)
    drawn = [F.min(F.struct(F.xxhash64("doc_id", F.lit(k)), "doc_id", "size", "root", "parity")).alias(f"d{k}") for k in range(2)]
    drawn = still.groupBy("key").agg(*drawn).select("key", F.explode(F.array("d0", "d1")).alias("d"))
    drawn = drawn.select("key", F.col("d.doc_id").alias("a"), F.col("d.size").alias("size_a"), F.col("d.root").alias("root_a"), F.col("d.parity").alias("parity_a"))
    others = still.select("key", F.col("doc_id").alias("b"), F.col("size").alias("size_b"), F.col("root").alias("root_b"), F.col("parity").alias("parity_b"))
    again = others.join(drawn, "key").filter(F.expr("root_a <> root_b") & fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    again = compared(again.join(stars, ["a", "b"], "left_anti"), bags)
    roots = joined(roots, links_of(again))

    # pairs of different classes, by slots of the distance to the bucket's smallest member
    reach = 1 - least + 1e-9
    far = stars.select(F.col("a").alias("centre"), F.col("b").alias("doc_id"), (1 - F.col("s")).alias("far"))
    still = open_buckets(roots)
    open_keys = still.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))
    still = still.join(far, ["centre", "doc_id"]).join(open_keys, "doc_id").withColumn("slot", F.floor(F.col("far") / reach))
    side = lambda x, slot: still.select("key", slot.alias("slot"), *[F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "size", "root", "far", "parity", "keys")])
    near_slots = F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1))
    across = side("a", near_slots).join(side("b", F.col("slot")), ["key", "slot"])
    in_first = F.col("key") == F.array_min(F.array_intersect("keys_a", "keys_b"))
    across = across.filter(F.expr(f"doc_id_a < doc_id_b AND root_a <> root_b AND abs(far_a - far_b) <= {reach}") & fits & in_first)
    across = across.select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"))
    more = compared(across.join(again, ["a", "b"], "left_anti"), bags)
    roots = joined(roots, links_of(more))

    out = members.join(roots, members["copy_of"] == roots["node"], "left")
    return out.select("doc_id", F.coalesce("root", "copy_of").alias("class_id"), "copy_of").withColumn("kept", F.col("doc_id") == F.col("class_id"))


def without_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stand for their class, with all their columns; texts without a word all stay.

    Rows are told apart by id and text: those without an id, and further texts of one id, are compared under numbers
    above all ids, so the others stand for a class before them.
    """
    key, name = row_key(F.col(id_col), F.col(text_col)), fresh("gone")
    rows = df.filter(F.col(text_col).rlike(r"[^\x20\x09-\x0D]")).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), key.alias("key"))
    keys = written(rows.select("doc_id", "key").distinct(), "keys")
    firsts = keys.filter("doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("key"))
    top = keys.agg(F.max("doc_id").alias("n")).first()["n"] or 0
    odd = keys.join(firsts, "key", "left_anti").select("key", (F.monotonically_increasing_id() + F.lit(max(top, 0) + 1)).alias("number"))
    odd = written(odd, "numbers")
    rows = rows.join(odd, "key", "left").select(F.coalesce("number", "doc_id").alias("doc_id"), "text")
    gone = classes_of(rows, LEAST).filter(~F.col("kept")).select("doc_id").distinct()
    numbered = keys.join(odd, "key", "left").select("key", F.coalesce("number", "doc_id").alias("doc_id"))
    gone = numbered.join(gone, "doc_id").select(F.col("key").alias(name))
    return df.join(gone, key == F.col(name), "left_anti")

"""Ranked lexical search by pipelined term partitioning.

Documents are indexed in blocks. The terms have owners, the rarest terms the first one. For each block and item that
share a term, a bundle goes from owner to owner: there it is cogrouped with the block's postings of that owner, adds
their integer contributions to the documents it carries, and drops documents that can no longer be among the best. What
is left after the last owner is ranked.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Documents of a block, and bytes of text after which a block ends earlier.
BLOCK_ROWS, BLOCK_BYTES = 16_384, 1 << 26
#: A term belongs to the first owner of which it is in at most this share of the documents, or to the last one.
SHARES = (0.001, 0.01, 0.1)
#: Different terms of all items that tasks look for directly; beyond, all terms are indexed and joined.
MOST_WANTED = 500_000

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
POSTINGS = "block string, term string, docs array<int>, tfs array<int>, sizes array<int>, most_tf int, least_size int, ids array<long>"
#: Items whose bundles of one block are one group.
ITEMS = 512


def terms_of(text: str) -> list[bytes]:
    """Runs of digits, ASCII letters and all other letters and signs beyond ASCII; A-Z lower-cased."""
    return _TERM.findall(text.encode("utf-8", "surrogatepass").lower())


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, term, repeats); rows that repeat an item count once, other texts of the same item are added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(terms_of(x)) for x in batch.column(1).to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(found)), list(map(len, found))).astype(np.int64))
            terms, counts = pa.array([t for c in found for t in c], pa.binary()).cast(pa.string()), pa.array([n for c in found for n in c.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), terms, counts], ["item_id", "term", "repeats"])

    rows = items.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).dropna().distinct()
    schema = rows.select("item_id", F.lit("").alias("term"), F.lit(0).cast("long").alias("repeats")).schema
    return rows.mapInArrow(run, schema).groupBy("item_id", "term").agg(F.sum("repeats").alias("repeats"))


def indexed(df: DataFrame, id_col: str, text_col: str, wanted: frozenset[bytes] | None, rows: int = BLOCK_ROWS, size: int = BLOCK_BYTES) -> DataFrame:
    """The documents as postings, block by block: one row per block and term (of ``wanted``, if given), with the places
    of the documents in the block, the term's occurrences in them and their terms; and one row without a term per
    block, with the ids of its documents in place of occurrences. Places follow the ids.

    A block is made by one task from rows that follow each other, so nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, taken = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                found = Counter(terms_of(text))
                if not found:
                    continue  # no term: not a document of the search
                n = found.total()
                held.append((doc_id, n, found if wanted is None else {t: found[t] for t in found.keys() & wanted}))
                taken += len(text)
                if len(held) >= rows or taken >= size:
                    yield block(f"{part}-{number}", held)
                    number, held, taken = number + 1, [], 0
        if held:
            yield block(f"{part}-{number}", held)

    def block(name: str, held: list) -> pa.RecordBatch:
        held.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        docs, tfs = defaultdict(list), defaultdict(list)
        for place, (_, _, found) in enumerate(held):
            for term, tf in found.items():
                docs[term].append(place)
                tfs[term].append(tf)
        sizes = np.array([n for _, n, _ in held], np.int32)
        places = [np.array(x, np.int32) for x in docs.values()] + [np.arange(len(held), dtype=np.int32)]
        of_places = [sizes[x] for x in places]
        lists = lambda x, kind: pa.array(x, pa.list_(kind))
        columns = [
            pa.array([name] * len(places)), pa.array([*docs, None], pa.binary()).cast(pa.string()), lists(places, pa.int32()),
            lists([*tfs.values(), None], pa.int32()), lists(of_places, pa.int32()), pa.array([*map(max, tfs.values()), None], pa.int32()),
            pa.array([int(x.min()) for x in of_places], pa.int32()), lists([None] * len(docs) + [[x for x, _, _ in held]], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["block", "term", "docs", "tfs", "sizes", "most_tf", "least_size", "ids"])

    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).dropna(subset=["text"])
    return texts.mapInArrow(run, POSTINGS)


def scored(postings: pa.Table, bundles: pa.Table, documents: int, terms: int, top: int) -> pa.Table:
    """One block at one owner: its postings (term, w, docs, tfs, sizes) add to the bundles (SCORED without ``best``).

    ``mine`` holds the item's terms of this owner as (term, repeats), ``rest`` what later owners can add to a document of
    the block at most, ``least`` a score that ``top`` documents are known to reach.
    """
    parts = {}
    for term, w, *lists in zip(postings["term"].to_pylist(), postings["w"].to_pylist(), *(postings[c] for c in ("docs", "tfs", "sizes"))):
        docs, tfs, sizes = (x.values.to_numpy().astype(np.int64) for x in lists)
        m = 100 - 75 + 75 * sizes * documents // terms
        parts[term] = docs, w * (1_000_000_000 * tfs // (1000 * tfs + 8 * m))
    carried = [[x.values.to_numpy() if x.is_valid else np.zeros(0, np.int64) for x in bundles[c]] for c in ("docs", "scores")]
    total = np.zeros(max([-1, *(int(x.max()) for x in (*(x for x, _ in parts.values()), *carried[0]) if len(x))]) + 1, np.int64)
    out = ([], [], [])
    for docs, scores, mine, rest, least in zip(*carried, *(bundles[c].to_pylist() for c in ("mine", "rest", "least"))):
        total[:] = 0
        total[docs] = scores
        for x in mine:
            at, part = parts[x["term"]]
            total[at] += part * x["repeats"]
        docs = np.flatnonzero(total)
        scores = total[docs]
        best = -np.sort(-(np.partition(scores, -top)[-top:] if len(scores) > top else scores))
        # a document stays while it can still reach a score that ``top`` others have already
        keep = scores + rest >= max(least, int(best[-1]) if len(best) == top else 0)
        docs, scores = docs[keep], scores[keep]
        if not rest and len(docs) > top:
            # nothing is added to them later, and places follow the ids
            order = np.lexsort((docs, -scores))[:top]
            docs, scores = docs[order], scores[order]
        for column, value in zip(out, (docs.astype(np.int32), scores, best)):
            column.append(value)
    lists = [pa.array(x, pa.list_(kind)) for x, kind in zip(out, (pa.int32(), pa.int64(), pa.int64()))]
    kept = ["block", "part", "item_id", "terms"]
    return pa.Table.from_arrays([*(bundles[c] for c in kept), *lists], [*kept, "docs", "scores", "best"])


def first_of(df: DataFrame, group: str, order: list[Column], top: int, name: str) -> DataFrame:
    """The first ``top`` rows of each group with their number; first within a number of parts, so that a large group is no single task's."""
    parts = df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(64)))
    parts = parts.withColumn(name, F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))).filter(F.col(name) <= top)
    return parts.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col(name) <= top).drop("_part")


def ranked(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = 10
) -> DataFrame:
    """The ``top`` documents of each item by score, highest first, equal scores by ascending id: item_id, rank, doc_id, score.

    With N documents that have a term, L terms in all of them, n in one, df documents that hold a term and tf of its
    occurrences in one: w = floor(1000 ln((2N+2) / (2df+1))), m = 25 + (75nN div L), and a document's score is the sum
    of w ((10^9 tf) div (1000 tf + 8m)) over the item's terms with their repeats. Only scores above 0 count.

    Null texts and texts without a term are no documents; each row is one, so rows that repeat an id are ranked one by
    one; null ids come last among equals. Items that repeat as a whole count once, texts of one item id are taken together, null item ids
    are left out, and items without a known term have no rows. Empty tables give none. A block's documents are bounded, so are
    the items that meet in one group; what goes to the driver are the items' terms, where there are at most MOST_WANTED.
    """
    spark = df.sparkSession
    asked = written(item_terms(items, item_col, item_text_col), "item_terms")
    distinct = asked.select("term").distinct()
    wanted = distinct.limit(MOST_WANTED + 1).collect()
    wanted = frozenset(r["term"].encode("utf-8", "surrogatepass") for r in wanted) if len(wanted) <= MOST_WANTED else None
    index = written(indexed(df, id_col, text_col, wanted), "index")
    blocks, postings = index.filter("term IS NULL"), index.filter("term IS NOT NULL").drop("ids")
    counted = blocks.select(F.sum(F.size("docs")).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
    documents, terms = counted["n"] or 0, counted["l"] or 0

    known = postings.groupBy("term").agg(F.sum(F.size("docs")).cast("long").alias("df")).join(distinct, "term")
    owner = F.lit(len(SHARES))
    for k in reversed(range(len(SHARES))):
        owner = F.when(F.col("df") <= SHARES[k] * documents, k).otherwise(owner)
    weight = F.floor(1000 * F.log((2 * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    known = written(known.select("term", weight.alias("w"), owner.alias("owner")), "terms")
    known = F.broadcast(known) if wanted is not None else known

    # bundles are made where an item and a block share a term
    spread = -(-max(1, asked.select("item_id").distinct().count()) // ITEMS)
    asked = asked.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(spread)).cast("int"))
    m = F.expr(f"25L + (75L * least_size * {documents}L) div {max(terms, 1)}L")
    bound = postings.select("block", "term", F.col("most_tf").cast("long").alias("tf"), m.alias("m")).join(known, "term")
    bound = bound.withColumn("bound", F.expr("w * ((1000000000L * tf) div (1000L * tf + 8L * m))"))
    bundles = bound.join(asked, "term").groupBy("block", "part", "item_id").agg(
        F.collect_list(F.struct("owner", "term", "repeats", (F.col("bound") * F.col("repeats")).alias("bound"))).alias("terms")
    )
    bundles = written(bundles, "bundles").select("*", F.lit(None).cast("array<int>").alias("docs"), F.lit(None).cast("array<bigint>").alias("scores"), F.lit(0).cast("long").alias("least"))
    schema = bundles.drop("least").withColumn("best", F.lit(None).cast("array<bigint>")).schema

    for k in range(len(SHARES) + 1):
        later = F.aggregate("terms", F.lit(0).cast("long"), lambda a, x: F.when(x["owner"] > k, a + x["bound"]).otherwise(a))
        mine = F.transform(F.filter("terms", lambda x: x["owner"] == k), lambda x: F.struct(x["term"], x["repeats"]))
        bundles = bundles.select("*", mine.alias("mine"), later.alias("rest"))
        owned = postings.join(known.filter(F.col("owner") == k), "term").select(
            "block", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("part"), "term", "w", "docs", "tfs", "sizes"
        )
        visited = owned.groupBy("block", "part").cogroup(bundles.groupBy("block", "part"))
        done = written(visited.applyInArrow(lambda left, right: scored(left, right, documents, terms, top), schema), "bundles")
        reached = first_of(done.select("item_id", F.explode("best").alias("score")), "item_id", [F.desc("score")], top, "place")
        reached = reached.filter(F.col("place") == top).select("item_id", F.col("score").alias("least"))
        bundles = done.drop("best").join(reached, "item_id", "left").fillna(0, ["least"])
        # a bundle ends where no document in it, and none that may still come, can be among the best
        open_ = F.aggregate("terms", F.lit(0).cast("long"), lambda a, x: F.when(x["owner"] > k, a + x["bound"]).otherwise(a)) >= F.greatest("least", F.lit(1))
        bundles = bundles.filter((F.size("docs") > 0) | open_)
    found = bundles.select("item_id", "block", "least", F.explode(F.arrays_zip("docs", "scores")).alias("x"))
    found = found.select("item_id", "block", "least", F.col("x.docs").alias("place"), F.col("x.scores").alias("score")).filter("score >= least AND score > 0")
    found = found.join(blocks.select("block", "ids"), "block").select("item_id", F.expr("ids[place]").alias("doc_id"), "score")
    best = first_of(found, "item_id", [F.desc("score"), F.asc_nulls_last("doc_id")], top, "rank")
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

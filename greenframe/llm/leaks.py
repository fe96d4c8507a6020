"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, units and names become typed placeholders. Windows of the templates are joined by hash, and where a window
meets, document and benchmark item are laid side by side: the same template with slots filled consistently (one value
for one value) is the item itself or the same question with other parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, row_key, written

#: Marks, one private character each: before a name, and for a point or comma inside a number.
NAME, POINT = "\ue001", "\ue002"
#: What stands for a name, a number, a number with its unit in one word, and a unit after a number.
NAMES, NUMBER, MEASURE, UNIT = 1, 2, 3, 4
UNITS = (
    "mm cm dm m km in ft yd mi mg g kg t lb oz ml cl l s sec min h hr hrs mph kmh kw kwh w v a hz c f k j n pa usd eur gbp "
    "meter meters metre metres kilometer kilometers inch inches foot feet yard yards mile miles gram grams kilogram kilograms pound pounds ounce ounces "
    "liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years degree degrees dollar dollars cent cents euro euros percent"
).split()
WINDOW = 8
#: Words side by side that must agree, or the share of a shorter item.
LEAST_WORDS, LEAST_SHARE = 13, 0.8
#: A window with fewer words that are no placeholder meets by its words themselves.
LEAST_LITERAL = 4
#: The index of the benchmark is broadcast up to so many windows (24 bytes each), else joined by a shuffle.
MOST_BROADCAST = 500_000


def split_text(text: Column) -> Column:
    """The words of a text in lower case, names marked; empty texts may stand at either end."""
    marked = F.regexp_replace(text, r"\p{Lu}(?<=[\p{L}\d,;] .)(?=[\p{L}\d])", f"{NAME}$0")
    pointed = F.regexp_replace(F.lower(marked), r"[.,](?<=\d.)(?=\d)", POINT)
    return F.split(pointed, rf"[^\p{{L}}\d{NAME}{POINT}]+")


def with_tokens(texts: DataFrame) -> DataFrame:
    """(doc_id, t) to (doc_id, tokens): words in lower case, of letters and digits; a point or comma between digits belongs to the number.

    A word that is a name (it begins with a capital, inside a sentence) is marked. Everything else about the words of a
    text is worked out from these tokens, one for one. Each step is a projection of its own, so that nothing is worked
    out more than once per text.
    """
    parts = texts.select("doc_id", split_text(F.col("t")).alias("parts"))
    first = F.when(F.get("parts", F.lit(0)) == "", 1).otherwise(0)
    last = F.when((F.element_at("parts", -1) == "") & (F.size("parts") > 1), 1).otherwise(0)
    return parts.select("doc_id", F.slice("parts", first + 1, F.greatest(F.size("parts") - first - last, F.lit(0))).alias("tokens"))


def words(tokens: Column) -> Column:
    """A number for each word, the same for equal words."""
    return F.transform(tokens, lambda t: F.xxhash64(F.ltrim(t, F.lit(NAME))))


def without_digits(token: Column) -> Column:
    return F.translate(token, f"0123456789{POINT}", "")


def template(tokens: Column) -> Column:
    """words() with one of the placeholders 1 to 4 for names, numbers and units."""

    def of(token: Column, i: Column) -> Column:
        rest, before = without_digits(token), F.get(tokens, i - 1)
        number = F.when(rest == "", NUMBER).when(rest.isin(UNITS), MEASURE)
        begins = (token >= "0") & (token < ":")
        unit = token.isin(UNITS) & (before >= "0") & (before < ":") & (without_digits(before) == "")
        placeholder = F.when(token >= NAME, F.when(F.startswith(token, F.lit(NAME)), NAMES)).when(begins, number).when(unit, UNIT)
        return F.coalesce(placeholder.cast("long"), F.xxhash64(token))

    return F.transform(tokens, of)


def literal(word: Column) -> Column:
    return ~word.between(NAMES, UNIT)


def windows(numbers: Column, size: int, kind: int) -> Column:
    """(place, hash) of each run of ``size`` numbers; ``kind`` keeps the hashes of words and of templates apart."""
    places = F.when(F.size(numbers) >= size, F.sequence(F.lit(0), F.size(numbers) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("place"), F.xxhash64(F.lit(kind), *[F.get(numbers, i + k) for k in range(size)]).alias("hash")))


def leaks(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    size: int = WINDOW, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE,
) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, n_words, n_same, reparameterised.

    n_same: words of the item that are the same, laid side by side; n_words: those that agree as templates, where the
    slots are consistent (one value for one value), else n_same. A leak has n_words of at least ``least_words``, or
    ``least_share`` of a shorter item; it is reparameterised where n_words is more than n_same. Items and documents are
    indexed at all places, so each run of ``size`` words meets wherever it stands, whatever other items the benchmark
    has. Windows with fewer than LEAST_LITERAL words that are no placeholder, and items of fewer than ``size`` words as
    a whole, meet only by the words themselves. Words agree where the templates do, or where they are the same (at the
    start of an item a capital says nothing).

    Documents are scanned once for the windows, which meet the index in the same stage while the benchmark is small
    enough to broadcast (its windows are counted first); only the documents found are laid beside the items. Words are
    compared by 64-bit hashes. Null or empty texts, and texts without a word, match nothing; rows with a null id are
    left out; repeated rows and repeated items give one row per pair of ids; empty tables give none.
    """
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).dropna()
    return items_found(texts, benchmark, item_col, item_text_col, size, least_words, least_share)


def items_found(
    texts: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text",
    size: int = WINDOW, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE,
) -> DataFrame:
    """leaks() of a table (doc_id, t) without nulls; doc_id of any type."""
    def read(rows: DataFrame) -> DataFrame:
        return with_tokens(rows).select("doc_id", words(F.col("tokens")).alias("words"), template(F.col("tokens")).alias("template"))

    items = benchmark.select(F.col(item_col).alias("doc_id"), F.col(item_text_col).cast("string").alias("t")).dropna()
    items = written(read(items).withColumnRenamed("doc_id", "item_id").filter(F.size("words") > 0).distinct(), "items")
    short = F.size("words") < size
    lengths = {r["n"] for r in items.filter(short).select(F.size("words").alias("n")).distinct().collect()}
    by_template = F.explode(windows(F.col("template"), size, 0)).alias("w")
    rich = F.size(F.filter(F.slice("template", F.col("w.place") + 1, F.lit(size)), literal)) >= LEAST_LITERAL
    by_template = items.select("item_id", "template", by_template).filter(rich)
    poor = items.select("item_id", "template", F.explode(windows(F.col("words"), size, size)).alias("w")).filter(~rich)
    whole = [items.filter(F.size("words") == n).select("item_id", "template", F.explode(windows(F.col("words"), n, n)).alias("w")) for n in lengths]
    index = by_template.unionByName(poor)
    for more in whole:
        index = index.unionByName(more)
    index = written(index.select("item_id", F.col("w.place").alias("item_place"), F.col("w.hash").alias("hash")), "index")
    small = index.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    if not poor.isEmpty():
        lengths = lengths | {size}

    # words of documents are needed here only where items meet by their words; an outer explode has no filter that would
    # work all windows out a second time
    numbers = with_tokens(texts).select("doc_id", template(F.col("tokens")).alias("template"), *([words(F.col("tokens")).alias("words")] if lengths else []))
    of_document = [windows(F.col("template"), size, 0), *(windows(F.col("words"), n, n) for n in sorted(lengths))]
    met = numbers.select("doc_id", (F.concat(*of_document) if lengths else of_document[0]).alias("w")).select("doc_id", F.explode_outer("w").alias("w"))
    met = met.select("doc_id", F.col("w.place").alias("place"), F.col("w.hash").alias("hash")).join(F.broadcast(index) if small else index, "hash")
    met = written(met.select("doc_id", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).distinct(), "met")

    # each document found is read once more, however many items it meets
    found = read(texts.join(met.select("doc_id").distinct(), "doc_id"))
    found = written(found.select("doc_id", F.col("words").alias("b"), F.col("template").alias("t")), "found")
    found = found.join(met, "doc_id").join(items.select("item_id", F.col("words").alias("a"), F.col("template").alias("s")), "item_id")
    first = F.greatest(F.lit(0), -F.col("shift"))
    many = F.least(F.size("a"), F.size("b") - F.col("shift")) - first
    side = lambda c, at: F.slice(c, at + 1, F.greatest(many, F.lit(0))).alias(c)
    beside = F.arrays_zip(side("a", first), side("s", first), side("b", first + F.col("shift")), side("t", first + F.col("shift")))
    agreeing = F.filter(beside, lambda p: (p["s"] == p["t"]) | (p["a"] == p["b"]))
    found = found.select("doc_id", "item_id", F.size("a").alias("item_size"), agreeing.alias("p"))
    slots = F.array_distinct(F.transform(F.filter("p", lambda p: (p["s"] == p["t"]) & ~literal(p["s"])), lambda p: F.struct(p["s"].alias("s"), p["a"].alias("a"), p["b"].alias("b"))))
    same = F.size(F.filter("p", lambda p: p["a"] == p["b"]))
    found = found.select("doc_id", "item_id", "item_size", F.size("p").alias("n_agreeing"), same.alias("n_same"), slots.alias("slots"))
    one_for_one = (F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda p: F.struct(p["s"], p["a"]))))) & (
        F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda p: F.struct(p["s"], p["b"]))))
    )
    found = found.withColumn("n_words", F.when(one_for_one, F.col("n_agreeing")).otherwise(F.col("n_same")))
    found = found.filter(F.col("n_words") >= F.least(F.lit(least_words).cast("double"), F.col("item_size") * least_share))
    # the place where most words agree
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", "n_same")).alias("m"))
    return best.select(
        "doc_id", "item_id", F.col("m.n_words").cast("long").alias("n_words"), F.col("m.n_same").cast("long").alias("n_same"),
        (F.col("m.n_same") < F.col("m.n_words")).alias("reparameterised"),
    )


def without_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` in which no benchmark item is found, with all their columns. Rows go by id and text, with or without an id."""
    key, name = row_key(F.col(id_col), F.col(text_col)), fresh("gone")
    gone = items_found(df.select(key.alias("doc_id"), F.col(text_col).cast("string").alias("t")).dropna(), benchmark).select(F.col("doc_id").alias(name)).distinct()
    return df.join(gone, key == F.col(name), "left_anti")

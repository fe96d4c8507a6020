"""Sensitive names and entities, by keyword rules applied as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from greenframe.functions import fixed_values as fixed

# patterns specific enough to mark a single word of running text
ENTITY_LABELS = [
    "email", "phone_international", "italian_tax_code", "iban", "ssn_usa", "nin_uk", "credit_card",
    "ipv4", "ipv6", "mac_address",
]
WORD_CHARACTERS = "A-Za-z0-9@._%+:-"
# every pattern above asks for a digit, @ or : somewhere in the word
LIKELY_WORD = f"(?<![{WORD_CHARACTERS}])[A-Za-z._%+-]*+[0-9@:][{WORD_CHARACTERS}]*+"


def _hits(name: str) -> list[tuple[Column, str]]:
    """(does the rule apply, reason) for every rule, in the order of the rules."""
    # (?U): letters outside ASCII are letters
    spaced = F.regexp_replace(F.trim(F.col(name)), "_", " ")
    joined = F.regexp_replace(F.col(name), "[^A-Za-z0-9]", "")
    words = [(spaced.rlike(f"(?iU){p}"), f"matched keyword in {category}") for category, p in fixed.SENSITIVE_KEYWORDS]
    parts = [(joined.rlike(f"(?i){p}"), "matched keyword in contact (camelCase)") for p in fixed.SENSITIVE_SPELLINGS]
    return [*words, *parts]


def name_score(name: str) -> Column:
    points = F.lit(0)
    for hit, _ in _hits(name):
        points = points + F.when(hit, fixed.SENSITIVE_POINTS).otherwise(0)
    return points


def name_reasons(name: str) -> Column:
    found = F.array_compact(F.array(*[F.when(hit, F.lit(reason)) for hit, reason in _hits(name)]))
    return F.array_sort(F.array_distinct(found))


def sensitive_names(names: DataFrame, name: str = "column") -> DataFrame:
    """Add ``score``, ``sensitive`` and ``reasons`` to a table of names, of any size."""
    return names.withColumns({"score": name_score(name), "reasons": name_reasons(name)}).withColumn(
        "sensitive", F.col("score") >= fixed.SENSITIVE_THRESHOLD
    )


def entities(df: DataFrame, text: str, labels: list[str] | None = None) -> DataFrame:
    """(label, entity) for every word of ``text`` that is an e-mail address, IBAN and so on."""
    kept = [c for c in df.columns if c != text]
    if labels is None:
        # most words are plain: take only those that could fit out of the text
        words = F.explode(F.regexp_extract_all(F.col(text), F.lit(LIKELY_WORD), F.lit(0)))
    else:
        words = F.explode(F.split(F.col(text), f"[^{WORD_CHARACTERS}]+"))
    likely = df.select(*kept, words.alias("entity"))
    bare = likely.withColumn("entity", F.regexp_replace("entity", r"\A[.:]+|[.:]+\z", ""))
    found = F.array(*[
        F.when(F.col("entity").rlike(rf"\A(?:{fixed.SEMANTIC_PATTERNS[label]})\z"), F.lit(label))
        for label in labels or ENTITY_LABELS
    ])
    return bare.select(*kept, "entity", F.explode(found).alias("label")).filter(F.col("label").isNotNull())


def entity_sensitivity(found: DataFrame, examples: int = 2) -> DataFrame:
    """Per label: entities, sensitive ones, and the first sensitive ones in text order.

    Equal entities are counted together first; the rules run once per distinct text.
    """
    counted = found.groupBy("label", "entity").agg(F.count(F.lit(1)).alias("n"))
    judged = counted.withColumn("hit", name_score("entity") >= fixed.SENSITIVE_THRESHOLD)
    totals = judged.groupBy("label").agg(
        F.sum("n").alias("entities"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("sensitive")
    )
    order = Window.partitionBy("label").orderBy("entity")
    # the rank limit is applied before the shuffle too, so a common label sends a few rows per task
    first = judged.filter("hit").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= examples)
    shown = first.groupBy("label").agg(F.array_join(F.array_sort(F.collect_list("entity")), ", ").alias("examples"))
    return totals.join(shown, "label", "left").withColumn("examples", F.coalesce("examples", F.lit("")))

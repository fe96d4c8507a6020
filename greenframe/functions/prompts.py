"""Prompt texts for an external SQL generator, one row per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from greenframe.sources.tables import Tables, row_counts

ADVICE = [
    "cut partitions away: compare partition columns with constants, not with expressions over them",
    "aggregate to the join key first when a join would multiply rows",
    "let one scan serve several aggregates with FILTER clauses or GROUPING SETS",
    "mark a side for broadcast only when it is known to stay small",
    "break up a join key that a large share of the rows has in common",
    "read nested and wide columns last, once few rows are left",
    "use semi and anti joins when only the existence of a match counts",
]


def _quoted(name: str) -> str:
    return f'"{name}"' if " " in name or ":" in name else name


def schema_context(tables: Tables) -> DataFrame:
    """(table_name, context): row count, column count and typed column list of each table."""
    columns = F.lit(None).cast("string")
    widths = F.lit(None).cast("int")
    for name, df in tables.items():
        listed = "\n".join(f"  - {_quoted(f.name)} ({f.dataType.simpleString()})" for f in df.schema.fields)
        this = F.col("table_name") == name
        columns = F.when(this, F.lit(listed)).otherwise(columns)
        widths = F.when(this, F.lit(len(df.columns))).otherwise(widths)
    return row_counts(tables).select(
        "table_name",
        F.concat(
            F.lit("Table "), "table_name", F.lit(": "), F.col("row_count").cast("string"), F.lit(" rows, "),
            widths.cast("string"), F.lit(" columns\n"), columns,
        ).alias("context"),
    )


def context_text(tables: Tables) -> str:
    """The contexts of all tables, in name order, as one text; its size depends on the schema only."""
    return "\n".join(row.context for row in schema_context(tables).orderBy("table_name").collect())


def generation_prompt(question: Column, context: str | Column, dialect: str) -> Column:
    context = F.lit(context) if isinstance(context, str) else context
    return F.concat(
        F.lit(f"Write one {dialect} SQL query that answers the question. Return only the query.\n"),
        F.lit("Schema:\n"), context, F.lit("\nQuestion: "), question, F.lit("\nSQL:"),
    )


def rewrite_prompt(question: Column, context: str | Column, dialect: str, sql: Column,
                   co2_g: Column | None = None) -> Column:
    context = F.lit(context) if isinstance(context, str) else context
    advice = "\n".join(f"{i}. {text}" for i, text in enumerate(ADVICE, 1))
    cost = F.lit("")
    if co2_g is not None:
        measured = F.concat(F.lit("\nThe original emitted "), F.format_string("%.4f", co2_g), F.lit(" g of CO2."))
        cost = F.when(co2_g.isNotNull(), measured).otherwise("")
    return F.concat(
        F.lit(f"Give 3 to 5 {dialect} queries that return the same rows with less work, separated by ';'.\n"),
        F.lit(advice), cost, F.lit("\nSchema:\n"), context,
        F.lit("\nQuestion: "), question, F.lit("\nOriginal:\n"), sql, F.lit("\nSQL:"),
    )


def prompt_rows(questions: DataFrame, question: str, context: str, dialect: str, sql: str | None = None,
                co2_g: str | None = None) -> DataFrame:
    """Add ``prompt``: for a new query, or for rewriting the one in column ``sql``."""
    if sql is None:
        prompt = generation_prompt(F.col(question), context, dialect)
    else:
        prompt = rewrite_prompt(F.col(question), context, dialect, F.col(sql), F.col(co2_g) if co2_g else None)
    return questions.withColumn("prompt", prompt)

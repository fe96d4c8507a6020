"""Column and table names a SQL engine accepts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def normalize_name(name: str) -> str:
    """Lower case, ``[a-z0-9_]`` only, no leading digit, single inner underscores."""
    text = re.sub("[^a-z0-9_]", "_", name.lower())
    if text[:1].isdigit():
        text = f"col_{text}"
    return re.sub("_+", "_", text).strip("_") or "col_unknown"


def distinct_names(names: list[str]) -> list[str]:
    """Names made unique with ``_2``, ``_3`` ..., the first holder keeping its name."""
    taken, out = set(names), []
    seen: set[str] = set()
    for name in names:
        candidate, number = name, 2
        while candidate in seen or (candidate != name and candidate in taken):
            candidate, number = f"{name}_{number}", number + 1
        seen.add(candidate)
        out.append(candidate)
    return out


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*distinct_names([normalize_name(c) for c in df.columns]))


def safe_table_name(name: str) -> str:
    return re.sub("[^0-9a-zA-Z_]", "_", str(name)).strip("_") or "table_unnamed"

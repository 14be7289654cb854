"""Names of inner columns that can't clash with a table's own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def inner(df: DataFrame, *names: str) -> list[str]:
    """``names`` behind a prefix that no column of ``df`` begins with."""
    prefix, taken = "_", [c.lower() for c in df.columns]
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return [prefix + n for n in names]

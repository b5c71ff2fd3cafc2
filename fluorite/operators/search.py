"""Identifier resolution and text search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_compound(table: DataFrame, identifier: str, key: str, columns: list[str]) -> DataFrame:
    """One row, the key that an identifier names: as a number first, then by each column in turn (smallest key wins)."""
    wanted = identifier.replace("_", "/")
    conditions = ([F.col(key) == int(identifier)] if identifier.isdigit() else []) + [F.col(c).isin(identifier, wanted) for c in columns]
    rank = reduce(lambda w, ic: w.when(ic[1], ic[0]), list(enumerate(conditions))[1:], F.when(conditions[0], 0))
    hits = table.where(reduce(lambda a, b: a | b, conditions))  # one scan with pushed predicates
    return hits.orderBy(rank, key).select(F.col(key).alias("mol_id")).limit(1)


def text_search(df: DataFrame, text: str, columns: list[str], limit: int = 50, key: str = "mol_id") -> DataFrame:
    """Rows in which any column holds the text, in any case; % and _ in it are wildcards."""
    return df.where(reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{text}%") for c in columns])).orderBy(key).limit(limit)

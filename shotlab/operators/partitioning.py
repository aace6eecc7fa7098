"""Placement of documents for text-heavy operators, and broadcasts behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of ids or small sample rows that may be broadcast (some 30 bytes each).
BROADCAST_ROWS = 1_000_000


def by_document(df: DataFrame, *key: str) -> DataFrame:
    """Documents hash-partitioned by their key: one shuffle of the texts, after which counts
    per (key, term) need none, whatever the table's size or file layout."""
    return df.repartition(*key)


def bounded_broadcast(df: DataFrame, rows: int | None) -> DataFrame:
    """Broadcast hint where the caller's parameters bound ``df`` to few rows; beyond that the
    join is left to Spark's statistics (shuffle join)."""
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else df


def sampled_docs(docs: DataFrame, ids: DataFrame, rows: int | None = None) -> DataFrame:
    """Documents whose id is in ``ids`` (at most ``rows`` of them, if known), hash-partitioned
    by id for the per-document work."""
    sel = docs.join(bounded_broadcast(ids.select("doc_id").distinct(), rows), "doc_id", "left_semi")
    return by_document(sel, "doc_id")

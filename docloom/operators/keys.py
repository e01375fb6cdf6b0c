"""The key of a node: its document and its id inside it.

Node ids are numbered inside a document, so tables over several documents carry ``doc_id`` too. Tables of one document
may leave it out; then the id alone is the key. Hits have the key of the tables they come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("doc_id", "node_id")


def key(rows: DataFrame) -> list[str]:
    """The key columns that a table has."""
    return [c for c in KEY if c in rows.columns]


def shared(a: DataFrame, b: DataFrame) -> list[str]:
    """The key columns of both tables: what they are joined on."""
    return [c for c in KEY if c in a.columns and c in b.columns]


def doc(*rows: DataFrame) -> list[str]:
    """``doc_id``, if all tables have it."""
    return ["doc_id"] if all("doc_id" in r.columns for r in rows) else []


def node(rows: DataFrame) -> Column:
    """The whole key as one value, for counting distinct nodes."""
    return F.struct(*key(rows))

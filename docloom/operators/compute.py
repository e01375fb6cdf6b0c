"""Filters, ranks and aggregates over extracted numeric rows.

Rows have ``node_id, label, value, unit, year`` and an order column ``ord``; values may be text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

COMPARATORS = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}
# Names of the aggregates.
OPERATIONS = {
    "sum": "sum", "total": "sum", "avg": "avg", "average": "avg", "mean": "avg", "max": "max", "maximum": "max", "min": "min", "minimum": "min",
    "count": "count", "len": "count", "range": "range", "spread": "range", "first": "first", "last": "last",
}


def number_of(df: DataFrame, column: str) -> Column:
    """A column as a number: text is parsed, numbers are taken as they are."""
    return T.to_number(F.col(column)) if dict(df.dtypes)[column] == "string" else F.col(column).cast("double")


def matching(rows: DataFrame, unit: str | None = None, year: int | None = None) -> DataFrame:
    """Rows with a number, not of another unit or year; a row that says neither passes."""
    out = rows.withColumn("number", number_of(rows, "value")).where("number IS NOT NULL")
    if unit and "unit" in rows.columns:
        out = out.where(F.coalesce(F.nullif(F.trim("unit"), F.lit("")) == unit, F.lit(True)))
    if year is not None and "year" in rows.columns:
        out = out.where(F.coalesce(F.col("year").cast("int") == year, F.lit(True)))
    return out


def compare(rows: DataFrame, threshold: float, comparator: str | None = ">", *, unit: str | None = None, year: int | None = None) -> DataFrame:
    """Rows whose value compares true with the threshold; an unknown comparator counts as ``>``."""
    op = {"=": "=="}.get((comparator or "").strip(), (comparator or "").strip())
    test = COMPARATORS.get(op, COMPARATORS[">"])
    return matching(rows, unit, year).where(test(F.col("number"), F.lit(float(threshold)))).drop("number")


def rank(rows: DataFrame, n: int, *, unit: str | None = None, year: int | None = None) -> DataFrame:
    """All rows that have the n-th largest value, where equal values take places of their own.

    The value is found by a top-n, not by sorting everything in one task.
    """
    fit = matching(rows, unit, year)
    top = fit.select("number").orderBy(F.desc("number")).limit(n)
    target = top.agg(F.when(F.count("*") == n, F.min("number")).alias("target"))
    return fit.join(F.broadcast(target), F.col("number") == F.col("target"), "left_semi").drop("number")


def numeric_records(rows: DataFrame, field: str = "value", *, order: str = "ord") -> DataFrame:
    """Rows with a number in ``field``; of equal (node, number, label, year) the first in order stays."""
    out = rows.withColumn("number", number_of(rows, field)).where("number IS NOT NULL")
    keys = [c for c in ("doc_id", "node_id", "number", "label", "year") if c in out.columns]
    return out.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("n = 1").drop("n")


def evaluate(records: DataFrame, operation: str = "sum", *, scale: float | None = None, digits: int | None = None, order: str = "ord", by: tuple[str, ...] = ()) -> DataFrame:
    """One aggregate of ``number``, overall or for each group; unknown operations count as sum."""
    op = OPERATIONS.get(operation.lower(), "sum")
    v = F.col("number")
    value = {
        "sum": F.sum(v),
        "avg": F.avg(v),
        "max": F.max(v),
        "min": F.min(v),
        "count": F.count(v).cast("double"),
        "range": F.max(v) - F.min(v),
        "first": F.min_by(v, F.col(order)),
        "last": F.max_by(v, F.col(order)),
    }[op]
    if scale is not None:
        value = value * scale
    if digits is not None:
        value = F.round(value, digits)
    return records.groupBy(*by).agg(value.alias("result"), F.count(v).alias("n_values"))


def plan_aggregate(rows: DataFrame, op: str, field: str | None = None, dedup_by: str | None = None) -> DataFrame:
    """Aggregates of plan steps: count, unique, exists, sum and avg, on distinct rows of a key if asked."""
    if dedup_by:
        rows = rows.dropDuplicates([dedup_by])
    value = {
        "count": lambda: F.count("*").cast("double"),
        "unique": lambda: F.countDistinct(field).cast("double"),
        "exists": lambda: F.when(F.count("*") > 0, 1.0).otherwise(0.0),
        "sum": lambda: F.sum(number_of(rows, field)),
        "avg": lambda: F.avg(number_of(rows, field)),
    }[op]()
    return rows.agg(value.alias("result"))

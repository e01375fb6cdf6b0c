"""Diversity-aware packing of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.keys import doc, key, node


def mmr_pack(hits: DataFrame, *, limit: int | None = 40, per_page: int = 2, trade: float = 0.72, penalty: float = 0.35, order: str | None = None) -> DataFrame:
    """Greedy maximal-marginal-relevance packing of hits (node_id, page_idx, score) in closed form.

    Pages are those of a document. A node counts once, by its best hit. A pick is penalised by ``penalty`` if its page was picked before,
    so within a page only the first pick has none, and picks of a page come in the order of their scores:
    the key is ``trade * score`` for a page's best and ``trade * score - (1 - trade) * penalty`` for the
    others. At most ``per_page`` of a page (0: any number); no page, no penalty and no cap. Ties: higher
    score, then ``order``.
    """
    limit = limit or 40
    own = key(hits)
    tie = [order, *own] if order and order not in own else [order] if order else own
    extra = [order] if order and order not in own else []
    best = hits.groupBy(*own).agg(F.max(F.struct("score", "page_idx")).alias("h"), *(F.min(c).alias(c) for c in extra)).select(*own, "h.score", "h.page_idx", *extra)
    place = F.when(F.col("page_idx").isNull(), 1).otherwise(F.row_number().over(Window.partitionBy(*doc(hits), "page_idx").orderBy(F.desc("score"), *tie)))
    worth = F.lit(trade) * F.col("score") - F.when(F.col("place") > 1, (1 - trade) * penalty).otherwise(0.0)
    placed = best.withColumn("place", place).withColumn("key", worth)
    if per_page > 0:
        placed = placed.where(F.col("page_idx").isNull() | (F.col("place") <= per_page))
    return placed.orderBy(F.desc("key"), F.desc("score"), *tie).limit(limit).select(*own, "page_idx", "score", "key")


def coverage(packed: DataFrame, target: int = 50) -> DataFrame:
    """One row ``coverage``: distinct nodes over the target, at most 1."""
    return packed.agg(F.least(F.lit(1.0), F.countDistinct(node(packed)) / F.lit(float(target or 50))).alias("coverage"))

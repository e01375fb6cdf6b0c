"""The document graph as an edge list: neighbours, expansion, hits of structure tools."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.keys import doc, key, shared

#: Relations of a seed's neighbours, the first of which counts.
RELATIONS = ("child", "parent", "sibling", "same_page")
#: Parts that the nodes below one parent or on one page are dealt into.
SALTS = 32

def neighbours(edges: DataFrame, seeds: DataFrame, *, types: list[str] | None = None, include_self: bool = False) -> DataFrame:
    """Children, parents, siblings and page mates of each seed: ``seed, node_id, relation``.

    Edges: src, dst, type; seeds: node_id. A node reached in several ways keeps the first of these
    relations. Every node carries its parents and pages, so that a pair can tell by itself whether it is the first of
    its kind: pairs are made once and never exchanged. Nodes below one parent are dealt over tasks.
    """
    in_doc = doc(edges, seeds)
    wanted = [k for k in RELATIONS if types is None or k in types]
    held = lambda kind, name: edges.where(F.col("type") == kind).groupBy(*in_doc, F.col("dst").alias("node_id")).agg(F.collect_set("src").alias(name))
    own = [*in_doc, "node_id"]
    none = F.array().cast(f"array<{dict(edges.dtypes)['src']}>")
    placed = held("child", "parents").join(held("same_page", "pages"), own, "full").select(*own, F.coalesce("parents", none).alias("parents"), F.coalesce("pages", none).alias("pages"))
    s = seeds.select(*own).distinct().join(placed, own, "left").select(*in_doc, F.col("node_id").alias("seed"), F.coalesce("parents", none).alias("seed_parents"), F.coalesce("pages", none).alias("seed_pages"))
    is_child, is_parent = F.array_contains("parents", F.col("seed")), F.array_contains("seed_parents", F.col("node_id"))
    other = F.lit(include_self) & F.col("node_id").isNull() | (F.col("seed") != F.col("node_id"))
    earlier = {"child": is_child, "parent": is_parent, "sibling": F.arrays_overlap("seed_parents", "parents")}
    n = 4 * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = (F.pmod(F.xxhash64("node_id"), F.lit(SALTS))).cast("int")

    def first(rows: DataFrame, kind: str) -> DataFrame:
        """Pairs that no earlier relation has."""
        for before in wanted[: wanted.index(kind)]:
            rows = rows.where(~F.coalesce(earlier[before], F.lit(False)))
        return rows.where(other).select(*in_doc, "seed", "node_id", F.lit(kind).alias("relation"))

    def through(name: str) -> DataFrame:
        """Pairs of a seed and a node with a common parent or page, met at the least of those."""
        left = placed.withColumn("via", F.explode(name)).withColumn("salt", salt).repartition(n, *in_doc, "via", "salt")
        right = s.withColumn("via", F.explode(f"seed_{name}")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).repartition(n, *in_doc, "via", "salt")
        return left.join(right, [*in_doc, "via", "salt"]).where(F.array_min(F.array_intersect(f"seed_{name}", name)) == F.col("via"))

    kinds = {
        "child": lambda: edges.where("type = 'child'").select(*in_doc, F.col("src").alias("seed"), F.col("dst").alias("node_id")).join(s.select(*in_doc, "seed"), [*in_doc, "seed"], "left_semi").distinct(),
        "parent": lambda: s.select(*in_doc, "seed", F.explode("seed_parents").alias("node_id"), "seed_parents").join(placed, own, "left"),
        "sibling": lambda: through("parents"),
        "same_page": lambda: through("pages"),
    }
    rows = [first(kinds[k](), k) for k in wanted]
    if include_self:
        rows.append(s.select(*in_doc, "seed", F.col("seed").alias("node_id"), F.lit("self").alias("relation")))
    return reduce(DataFrame.unionByName, rows)


def near_seeds(edges: DataFrame, seeds: DataFrame, *, include_self: bool = False) -> DataFrame:
    """The distinct nodes of :func:`neighbours`, without its pairs: what a parent or page holds counts its seeds once."""
    in_doc = doc(edges, seeds)
    s = seeds.select(*in_doc, F.col("node_id").alias("seed")).distinct()
    any_ = F.lit(include_self)
    child = edges.where("type = 'child'").select(*in_doc, "src", "dst")
    same_page = edges.where("type = 'same_page'").select(*in_doc, "src", "dst")
    # of the seeds below each parent or on each page, two tell whether one differs from a node
    some = lambda held: held.join(s.withColumnRenamed("seed", "dst"), [*in_doc, "dst"], "left_semi").groupBy(*in_doc, "src").agg(F.min("dst").alias("low"), F.max("dst").alias("high"))
    differs = lambda c: any_ | (F.col("low") != F.col(c)) | (F.col("high") != F.col(c))
    of = lambda c: [*in_doc, F.col(c).alias("node_id")]
    above = some(child)
    rows = [
        child.join(s.withColumnRenamed("seed", "src"), [*in_doc, "src"], "left_semi").where(any_ | (F.col("src") != F.col("dst"))).select(*of("dst")),
        above.where(differs("src")).select(*of("src")),
        child.join(above, [*in_doc, "src"]).where(differs("dst")).select(*of("dst")),
        same_page.join(some(same_page), [*in_doc, "src"]).where(differs("dst")).select(*of("dst")),
    ]
    if include_self:
        rows.append(s.select(*of("seed")))
    return reduce(DataFrame.unionByName, rows).distinct()


def expand_nodes(edges: DataFrame, base: DataFrame, types: list[str]) -> DataFrame:
    """The base nodes and what their edges of the given types lead to; ``parent`` follows child edges upwards."""
    in_doc = doc(edges, base)
    out = edges.where(F.col("type").isin(*types)).select(*in_doc, F.col("src").alias("node_id"), F.col("dst").alias("to"))
    if "parent" in types:
        out = out.unionByName(edges.where("type IN ('child', 'parent')").select(*in_doc, F.col("dst").alias("node_id"), F.col("src").alias("to")))
    own = [*in_doc, "node_id"]
    reached = base.select(*own).distinct().join(out, own).select(*in_doc, F.col("to").alias("node_id"))
    first = base.select(*own, F.lit(0).alias("hop"))
    return first.unionByName(reached.select(*own, F.lit(1).alias("hop"))).groupBy(*own).agg(F.min("hop").alias("hop"))


def expand_hits(edges: DataFrame, children: DataFrame, seeds: DataFrame, *, include_self: bool = False) -> DataFrame:
    """Hits of score 0.6 for all neighbours of the seeds and the children of seed headings (node_id, child)."""
    own = [*doc(edges, seeds), "node_id"]
    near = near_seeds(edges, seeds, include_self=include_self).select(*own)
    below = children.join(seeds.select(*own).distinct(), shared(children, seeds)).select(*own[:-1], F.col("child").alias("node_id"))
    return near.unionByName(below).distinct().withColumn("score", F.lit(0.6))


def children_hits(edges: DataFrame, seeds: DataFrame, *, role: str | None = None, roles: DataFrame | None = None) -> DataFrame:
    """Hits of score 0.7 for the children of the seeds, of one role if asked (roles: node_id, role)."""
    in_doc = doc(edges, seeds)
    kids = edges.where("type = 'child'").join(seeds.select(*in_doc, F.col("node_id").alias("src")), [*in_doc, "src"], "left_semi").select(*in_doc, F.col("dst").alias("node_id")).distinct()
    if role is not None:
        kids = kids.join(roles.where(F.col("role") == role), shared(kids, roles), "left_semi")
    return kids.withColumn("score", F.lit(0.7))


def unseen(hits: DataFrame, visited: DataFrame, *, n: int = 6) -> DataFrame:
    """The first ``n`` hits whose nodes were not visited."""
    return hits.join(visited, shared(hits, visited), "left_anti").orderBy(F.desc("score"), *key(hits)).limit(n)


def distinct_in_order(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the first in order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")

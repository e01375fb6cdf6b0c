import random
import time

import pytest
from pyspark.sql import functions as F

from docloom.operators import graph


def _brute(edges, seeds, include_self):
    """All pairs of a seed and a node with the first relation, from sets."""
    child, page = ({(s, d) for s, d, t in edges if t == kind} for kind in ("child", "same_page"))
    out = {}
    for s in seeds:
        parents = {a for a, b in child if b == s}
        pages = {a for a, b in page if b == s}
        kinds = [("self", {s} if include_self else set()), ("child", {b for a, b in child if a == s}), ("parent", parents), ("sibling", {b for a, b in child if a in parents}), ("same_page", {b for a, b in page if a in pages})]
        for relation, nodes in kinds:
            for n in nodes:
                if include_self or n != s:
                    out.setdefault((s, n), relation)
    return out


@pytest.mark.parametrize("include_self", [False, True])
def test_neighbours_and_hits_against_brute_force(spark, include_self):
    """Nodes with several parents and pages, cycles, loops and repeated edges."""
    rng = random.Random(7)
    edges = [(f"n{rng.randrange(14)}", f"n{rng.randrange(25)}", rng.choice(["child", "same_page", "ref"])) for _ in range(70)]
    edges += edges[:5] + [("n3", "n3", "child"), ("n1", "n2", "child"), ("n2", "n1", "child")]
    seeds = [f"n{i}" for i in (0, 1, 2, 3, 7, 20, 99)]
    e, s = spark.createDataFrame(edges, "src string, dst string, type string"), spark.createDataFrame([(x,) for x in [*seeds, "n1"]], "node_id string")
    want = _brute(edges, seeds, include_self)
    rows = [(r.seed, r.node_id, r.relation) for r in graph.neighbours(e, s, include_self=include_self).collect()]
    assert len(rows) == len(want) and {(a, b): k for a, b, k in rows} == want
    hits = [r.node_id for r in graph.expand_hits(e, spark.createDataFrame([], "node_id string, child string"), s, include_self=include_self).collect()]
    assert sorted(hits) == sorted({n for _, n in want})


def test_pairs_of_neighbours_are_not_exchanged(spark):
    """Pairs grow with the square of a parent's nodes: they used to be grouped, and so written whole."""
    edges = spark.createDataFrame([("p", "a", "child"), ("p", "b", "child")], "src string, dst string, type string")
    plan = graph.neighbours(edges, edges.select(F.col("dst").alias("node_id")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")


def test_hits_around_many_seeds_below_one_parent(spark):
    """20,000 seeds with one parent have 400 million pairs, but 20,001 hits."""
    edges = spark.range(20_000).select(F.lit("p").alias("src"), F.concat(F.lit("c"), "id").alias("dst"), F.lit("child").alias("type"))
    began = time.perf_counter()
    assert graph.expand_hits(edges, spark.createDataFrame([], "node_id string, child string"), edges.select(F.col("dst").alias("node_id"))).count() == 20_001
    assert time.perf_counter() - began < 30

import random

import pytest

from docloom.llm import mixing
from tests.llm.conftest import make_docs, words


def dealt_again(sizes, weights, total, cap):
    """Targets by dealing the excess again until no source is above its cap."""
    capped, share = set(), {}
    while True:
        left = total - sum(cap[s] for s in capped)
        open_ = [s for s in sizes if s not in capped]
        weight = sum(weights[s] for s in open_)
        share = {s: cap[s] for s in capped} | {s: left * weights[s] / weight for s in open_}
        over = [s for s in open_ if share[s] > cap[s] + 1e-9]
        if not over:
            return share
        capped |= set(over)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.choice([0, 3, 40, 200])), "en", rng.choice(["a"] * 12 + ["b", "c", "d", "e", None])) for i in range(900)]
    return make_docs(spark, rows).repartition(5)


def test_targets_and_taken(docs):
    rows = mixing.plan_mix(docs).collect()
    assert len(rows) == 900
    sizes, taken, biggest, target = {}, {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        biggest[r.source] = max(biggest.get(r.source, 0), r["size"])
        target[r.source] = r.target
        assert r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"] and len(r.times) == r.copies
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = dealt_again(sizes, weights, 1.5 * sum(sizes.values()), {s: 2 * n for s, n in sizes.items()})
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= biggest[s] / 2 + 1e-6


def test_curriculum_times(docs):
    rows = [r for r in mixing.plan_mix(docs).collect() if r.copies]
    firsts = [r.times[0] for r in rows]
    assert firsts == sorted(firsts) and 0 <= firsts[0] and max(t for r in rows for t in r.times) <= 1
    # the heaviest class leads early: by half time it has met 0.5625 of its demand, the lightest 0.375
    for rank, share in ((0, 0.5625), (2, 0.375)):
        source = sorted({r.source for r in rows if r.source})[rank]
        mine = [(t, r["size"]) for r in rows if r.source == source for t in r.times]
        early = sum(n for t, n in mine if t <= 0.5) / sum(n for _, n in mine)
        assert early == pytest.approx(share, abs=0.06)


def test_reruns_agree_whatever_the_partitions(docs):
    key = lambda df: sorted((r.doc_id, r.taken, tuple(r.times)) for r in df.collect())
    assert key(mixing.plan_mix(docs)) == key(mixing.plan_mix(docs.repartition(2)))


def test_training_order_keeps_columns(docs):
    plan = {r.doc_id: r.copies for r in mixing.plan_mix(docs).collect()}
    out = mixing.training_order(docs)
    assert out.columns == docs.columns
    seen = {}
    for r in out.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {k: n for k, n in plan.items() if n}


def test_odd_rows(odd, empty):
    rows = mixing.plan_mix(odd).collect()
    assert len(rows) == 12
    assert all(r.taken == 0 for r in rows if r["size"] == 0)
    assert mixing.training_order(odd).columns == odd.columns
    assert mixing.plan_mix(empty).count() == 0 and mixing.training_order(empty).count() == 0


def test_schedule_pieces(spark):
    from pyspark.sql import functions as F

    knots = ((0.0, 1.0), (0.5, 3.0), (1.0, 0.0))
    total = mixing.integral(knots)
    times = spark.range(101).select((F.col("id") / 100).alias("x")).select("x", mixing._time_of(F.col("x"), mixing._segments(knots)).alias("t")).collect()
    for x, t in times:
        area = t + 2 * t * t if t <= 0.5 else 1.0 + 3 * (t - 0.5) - 3 * (t - 0.5) ** 2
        assert area / total == pytest.approx(x, abs=1e-6)

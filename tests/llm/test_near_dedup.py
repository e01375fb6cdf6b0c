import random
import re

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import near_dedup
from tests.llm.conftest import make_docs, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n):
    """Every pair compared."""
    sets = [(-(1 << 63) if d is None else d, shingles(t, n)) for d, t, *_ in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            same = len(x & y)
            if x and y and 100 * same >= 80 * (len(x) + len(y) - same):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    back = lambda d: None if d == -(1 << 63) else d
    return sorted(((back(d), len(s), back(find(d)), find(d) == d) for d, s in sets), key=repr)


def got(df, n):
    return sorted((tuple(r) for r in near_dedup.near_duplicates(df, shingle=n).collect()), key=repr)


def edited(rng, text, k):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows, n = [], 0
    for _ in range(40):
        base = words(rng, rng.choice([5, 12, 40, 150]), 10**6)
        for _ in range(rng.choice([1, 1, 2, 6])):
            rows.append((n, edited(rng, base, rng.choice([0, 0, 1, 2, 4])) + rng.choice(["", " X"]), "en", "a"))
            n += 1
    rng.shuffle(rows)
    for size in (4, 5):
        assert got(make_docs(spark, rows).repartition(5), size) == brute(rows, size)


def test_large_group_around_the_threshold(spark):
    rng = random.Random(6)
    base = words(rng, 120, 10**6)
    rows = [(i, edited(rng, base, 1 + i % 8), "en", "a") for i in range(400)]
    rows += [(1000 + i, base + " " + words(rng, 60, 10**6), "en", "a") for i in range(60)]
    assert got(make_docs(spark, rows).repartition(4), 4) == brute(rows, 4)


def test_empty_blocks(spark, monkeypatch):
    """Few long texts in many blocks: most blocks have no member."""
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 100)
    rng = random.Random(8)
    base = words(rng, 400, 10**6)
    longer = base + " " + words(rng, 160, 10**6)  # similarity of about 0.71 to the base
    rows = [(0, base, "en", "a"), (1, longer, "en", "a"), (2, edited(rng, longer, 3), "en", "a"), (3, base + " " + words(rng, 170, 10**6), "en", "a")]
    assert got(make_docs(spark, rows), 4) == brute(rows, 4)


def test_small_blocks(spark, monkeypatch):
    """Buckets of several components, cut into many blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 5)
    rng = random.Random(13)
    base = words(rng, 100, 10**6)
    rows = [(i, edited(rng, edited(random.Random(i // 10), base, 12), 1), "en", "a") for i in range(80)]
    assert got(make_docs(spark, rows).repartition(3), 4) == brute(rows, 4)


def test_rows_of_one_large_bucket(spark):
    """20,000 unlinked classes of one bucket: sketches only, and no more rows than members times blocks."""
    ids = spark.range(20_000).select("id", F.lit(7).cast("long").alias("band"), F.lit(0).alias("nth"), F.col("id").alias("component"))
    classes = spark.range(20_000).select("id", F.lit(100).cast("long").alias("n_shingles"), F.lit(bytearray(2 * near_dedup.REGISTERS)).alias("sketch"))
    sent = near_dedup._blocked(ids, classes)
    assert "shingles" not in sent.columns
    assert sent.count() <= 20_000 * 21
    largest = sent.groupBy("band", "i", "j").count().agg(F.max("count")).head()[0]
    assert largest < 3 * near_dedup.BLOCK_MEMBERS


def test_bands_propose_what_is_linked():
    """Recall of the bands at the threshold, measured on registers of random sets."""
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(600):
        common = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 10, dtype=np.uint64)]) * np.uint64(2)) for _ in range(2))
        x, y = (near_dedup.registers(s)[: near_dedup.BANDS * near_dedup.BAND].reshape(near_dedup.BANDS, -1) for s in (a, b))
        met += bool((x == y).all(axis=1).any())
    assert met / 600 >= 0.99


def test_repeated_rows_leave_one(spark):
    text = "some text of more than five words " * 3
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (1, text, "fr", "b"), (2, text, "en", "a"), (None, None, "en", "a"), (None, None, "en", "a"), (None, "x y z", "en", "a")]
    kept = near_dedup.keep_representatives(make_docs(spark, rows, clash=True)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(1, text), (None, None), (None, "x y z")], key=repr)
    assert near_dedup.keep_representatives(make_docs(spark, rows).limit(0)).count() == 0


def test_odd_rows(odd, odd_rows, empty):
    assert got(odd, 4) == brute(odd_rows, 4)
    assert got(empty, 4) == []
    kept = near_dedup.keep_representatives(odd)
    assert kept.columns == odd.columns
    want = sorted(({(d, t) for (d, t, *_) in odd_rows for e, _, c, k in brute(odd_rows, 5) if k and e == d}), key=repr)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == want


def test_registers_estimate_similarity():
    rng = np.random.default_rng(0)
    for shared, own in ((900, 100), (60, 15), (9, 1), (400, 400)):
        errors = []
        for _ in range(40):
            common = rng.integers(0, 1 << 63, shared, dtype=np.uint64)
            a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, own, dtype=np.uint64)]) * np.uint64(2)) for _ in range(2))
            errors.append((near_dedup.registers(a) == near_dedup.registers(b)).mean() - shared / (shared + 2 * own))
        assert abs(np.mean(errors)) < 0.04


def test_components(spark):
    links = [(5, 3), (3, 9), (20, 21), (21, 22), (22, 23), (23, 24), (24, 20), (30, 30), (1, 40), (40, 50), (50, 60)]
    out = near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.id: r.component for r in out} == {3: 3, 5: 3, 9: 3, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20, 1: 1, 40: 1, 50: 1, 60: 1}
    chain = [(i, i + 1) for i in range(60)]
    out = near_dedup.components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r.component for r in out} == {0} and len(out) == 61

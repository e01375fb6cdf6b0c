import base64
import hashlib
import random
import re

import pytest

from docloom.llm import fingerprints
from docloom.llm.fingerprints import Sketch
from tests.llm.conftest import make_docs, words


def edited(own, following):
    half = len(own) // 2
    return own[: len(own) - half] + following[:half]


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (doc, text, *_) in enumerate(order):
        own, after = text or "", order[(i + 1) % len(order)][1] or ""
        a, e, n = Sketch.of_text(own), Sketch.of_text(edited(own, after)), Sketch.of_text(after)
        out.append((doc, len(own), hashlib.sha256(edited(own, after).encode()).hexdigest(), str(a), str(e), a.resemblance(e), a.resemblance(n)))
    return sorted(out, key=repr)


def got(df):
    rows = fingerprints.fingerprint_pairs(df).collect()
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in rows), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(10)
    rows = [(rng.randrange(10**6), rng.choice(["", "é😀 ", ""]) + words(rng, rng.choice([0, 1, 4, 5, 80, 300])), "en", "a") for _ in range(300)]
    rows = list({r[0]: r for r in rows}.values())
    assert got(make_docs(spark, rows).repartition(6)) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_few_rows(spark, n):
    rows = [(i * 7, f"text number {i} with some words", "en", "a") for i in range(n)]
    assert got(make_docs(spark, rows)) == brute(rows) if n else got(make_docs(spark, rows)) == []


def test_odd_rows(odd, odd_rows):
    assert got(odd) == brute(odd_rows)


def test_sketches_merge_and_estimate():
    rng = random.Random(11)
    a, b = [f"a{i}" for i in range(3000)], [f"b{i}" for i in range(3000)]
    left, right = " ".join(a), " ".join(b)
    both = Sketch.of_text(left, 256).merge(Sketch.of_text(right, 256))
    assert both.distinct() == pytest.approx(5992, rel=0.2)
    half = Sketch.of_text(" ".join(a[:1500]), 256)
    assert half.resemblance(Sketch.of_text(left, 256)) == pytest.approx(0.5, abs=0.12)
    assert half.containment(Sketch.of_text(left, 256)) == pytest.approx(1.0, abs=0.25)
    assert str(Sketch.from_string(str(both), 256)) == str(both)
    assert Sketch.of_text("").resemblance(Sketch.of_text(" \n")) == 1.0 and Sketch.of_text("x").resemblance(Sketch.of_text("")) == 0.0
    text = words(rng, 500)
    parts = Sketch.of_text(text[:1000]).merge(Sketch.of_text(text))
    assert str(Sketch.of_text(text)) == str(Sketch.of_text(text)) and len(parts.hashes) == 64


M64 = (1 << 64) - 1


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def plain_sketch(text, k=64, size=5):
    """The k smallest 48-bit shingle hashes, by whole numbers and sets alone."""
    base, found = 0x9E3779B97F4A7C15, []
    for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode()):
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
        value = sum(mixed(c + 1) * pow(base, i, 1 << 64) for i, c in enumerate(w)) & M64
        found.append(mixed((value + len(w) * 0xD6E8FEB86659FD93) & M64))
    if not found:
        return []
    factors = [mixed(1000 + i) | 1 for i in range(size)]
    if len(found) < size:
        shingles = {mixed((sum(h * f for h, f in zip(found, factors)) + len(found)) & M64)}
    else:
        shingles = {mixed(sum(h * f for h, f in zip(found[i : i + size], factors)) & M64) for i in range(len(found) - size + 1)}
    return sorted({h >> 16 for h in shingles})[:k]


def plain_likeness(a, b, k=64):
    union = sorted(set(a) | set(b))[:k]
    return 1.0 if not union else sum(h in set(a) and h in set(b) for h in union) / len(union)


def plain_string(sketch):
    return base64.b64encode(b"".join(h.to_bytes(6, "big") for h in sketch)).decode()


def test_against_sets_of_whole_numbers(spark, odd, odd_rows):
    """The query against sketches made without any of the operator's code."""
    rng = random.Random(15)
    rows = [(3 * i, rng.choice(["", "É😀 ", "A  b\t"]) + words(rng, rng.choice([0, 1, 4, 5, 9, 70, 200]), 50), "en", "a") for i in range(60)]
    for docs, source in ((make_docs(spark, rows).repartition(5), rows), (odd, odd_rows)):
        order = sorted(source, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        want = []
        for i, (doc, text, *_) in enumerate(order):
            own, after = text or "", order[(i + 1) % len(order)][1] or ""
            a, e, n = plain_sketch(own), plain_sketch(edited(own, after)), plain_sketch(after)
            want.append((doc, len(own), plain_string(a), plain_string(e), round(plain_likeness(a, e), 9), round(plain_likeness(a, n), 9)))
        rows_ = fingerprints.fingerprint_pairs(docs).collect()
        assert sorted(((r.doc_id, r.n_chars, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows_), key=repr) == sorted(want, key=repr)


def test_parts_of_a_text_merge_to_its_sketch():
    """Parts that overlap by all but one word of a shingle have the shingles of the whole between them."""
    rng = random.Random(16)
    for _ in range(20):
        w = words(rng, rng.randrange(30, 900), 400).split()
        cuts = sorted(rng.sample(range(10, len(w)), 3))
        whole = None
        for a, b in zip([0, *cuts], [*cuts, len(w)]):
            part = Sketch.of_text(" ".join(w[max(0, a - 4) : b]))
            whole = part if whole is None else part.merge(whole)
        assert str(whole) == str(Sketch.of_text(" ".join(w))) == plain_string(plain_sketch(" ".join(w)))


def test_many_ranges(spark):
    """More partitions than documents: every range has one document or none."""
    rows = [(i * i, words(random.Random(i), 12, 30), "en", "a") for i in range(25)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        assert got(make_docs(spark, rows)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

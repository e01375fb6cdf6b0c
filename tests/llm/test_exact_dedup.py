import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import exact_dedup
from docloom.llm.exact_dedup import CuckooIndex
from tests.llm.conftest import make_docs


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("id"), st.integers(0, 60)), max_size=300))
def test_index_is_a_set(operations):
    index, live = CuckooIndex(buckets=2), set()
    for op, n in operations:
        key = hashlib.sha256(str(n).encode()).digest()
        if op == "i" and key not in live:
            index.insert(key, n)
            live.add(key)
        elif op == "d":
            assert index.delete(key) == (key in live)
            live.discard(key)
        assert (index.find(key) is not None) == (key in live)
    assert {r[0] for r in index.records()} == live and index.size == len(live)


def test_overflow_resizes_and_keeps_all():
    index = CuckooIndex(buckets=2)
    keys = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(5000)]
    for i, k in enumerate(keys):
        index.insert(k, i)
    assert index.resizes > 5 and all(index.find(k)[1] == i for i, k in enumerate(keys))
    same_place = [b"\x07\x00" + b"\x00" * 6 + bytes([i]) * 24 for i in range(40)]
    for k in same_place[:6]:
        index.insert(k, k)
    assert all(index.find(k) for k in same_place[:6]) and not index.find(same_place[9])


def brute(rows):
    norm = {}
    for doc, text, *_ in rows:
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc)
    out = []
    for text, ids in norm.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in exact_dedup.exact_duplicates(df).collect()), key=repr)


def test_against_brute_force(spark, odd, odd_rows, empty):
    assert got(odd) == brute(odd_rows)
    assert got(empty) == []
    rng = random.Random(3)
    rows = [(i, rng.choice(["a  b", "a b", "a\tb ", "", None, "c", "hot"] + ["hot"] * 5), "en", "s") for i in range(2000)]
    assert got(make_docs(spark, rows).repartition(7)) == brute(rows)


def test_keep_first_takes_effect(odd, odd_rows, empty):
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    want = sorted({d for d, _, _, k, _ in brute(odd_rows) if k}, key=repr)  # repeated rows leave one
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == want
    assert exact_dedup.keep_first(empty).count() == 0


def test_copies_without_ids_leave_one(spark):
    rows = [(None, "same  text", "en", "a"), (None, "same text", "en", "b"), (None, "same text", "en", "b"), (None, "other", "en", "a"), (3, "third", "en", "a"), (None, "third", "en", "a"), (3, "fourth", "en", "a"), (None, None, "en", "a"), (None, "", "fr", "a")]
    docs = make_docs(spark, rows, clash=True)
    one, two = (sorted(((r.doc_id, r.text) for r in exact_dedup.keep_first(d).collect()), key=repr) for d in (docs, docs.repartition(4)))
    assert {(d, (t or "").replace("  ", " ")) for d, t in one} == {(3, "fourth"), (3, "third"), (None, "other"), (None, "same text"), (None, "")}
    assert one == two and len(one) == 5  # which of the equal texts stays does not depend on partitions


def test_deletion_of_live_digests(spark):
    docs = make_docs(spark, [(i, f"t{i % 4}", "en", "s") for i in range(20)])
    rows = exact_dedup.digests(docs)
    gone = rows.where("doc_id < 2").select("digest")
    left = exact_dedup.build_index(rows, gone).collect()
    assert sorted(r.keep_id for r in left) == [2, 3] and all(r.group_size == 5 for r in left)

import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from docloom.llm import bpe
from tests.llm.conftest import make_docs

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = ["", "a" * 3000, "ab" * 1500, "é" * 700, "日本語テキスト" * 120, " " * 2000 + "x", "\x1c\x1f\x85 　 a", "don't I'll  \n\n x", "😀" * 300, "=-" * 800, "mixed 123 wörds, and\tmore"]


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks(PATH), P.PATTERN)


def ids_of(encoder, words):
    return [int(i) for w in words for i in encoder.ids[w].split()]


def test_ids_and_round_trip(encoder, oracle):
    rng = random.Random(7)
    texts = [*TEXTS, *("".join(rng.choice("abcdeiou éß.,'\n7") for _ in range(400)) for _ in range(60)), "".join(rng.choice("abcdeiou") for _ in range(1500))]
    for text, words in zip(texts, encoder.encode(texts), strict=True):
        ids = ids_of(encoder, words)
        assert ids == oracle.encode_ordinary(text)
        assert encoder.decode([np.array(ids, dtype=np.int32)]) == [text.encode()]


def long_words():
    """Single words of many bytes: one pair everywhere, two in turn, few letters, all letters, CJK, base64."""
    rng = random.Random(8)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    return {
        "one letter": "a" * 20_000,
        "two letters": "ab" * 10_000,
        "four letters": pick("acgt", 20_000),
        "letters": pick("abcdefghijklmnopqrstuvwxyz", 20_000),
        "cjk": "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(100_000)),
        "base64": base64.b64encode(rng.randbytes(75_000)).decode(),
    }


@pytest.mark.parametrize("kind", long_words())
def test_long_words(encoder, oracle, kind):
    text = long_words()[kind]
    began = time.process_time()
    (words,) = encoder.encode([text])
    assert time.process_time() - began < 10  # a round a merge would take minutes
    assert ids_of(encoder, words) == oracle.encode_ordinary(text)


def test_a_million_letters_end(encoder):
    text = "".join(random.Random(9).choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    (words,) = encoder.encode([text])
    assert encoder.decode([np.array(ids_of(encoder, words), dtype=np.int32)]) == [text.encode()]


@pytest.mark.parametrize("text", ["a" * 5_000_000, "-" * 5_000_000, "=-" * 700_000 + "x", "ab" * 400_000 + "a" * 700_001])
def test_runs_of_any_length(encoder, oracle, text):
    """Parts far larger than a query may have, in DuckDB's usual memory; the library needs the same runs in pieces."""
    (words,) = encoder.encode([text])
    ids = ids_of(encoder, words)
    assert encoder.decode([np.array(ids, dtype=np.int32)]) == [text.encode()]
    unit = oracle.encode_ordinary(text[:4096])  # such runs repeat one token; both ends are compared with the library
    assert ids[: len(unit) // 2] == unit[: len(unit) // 2]
    if len(set(text)) == 1:
        assert len(ids) == -(-len(text) // len(encoder.decode([np.array(ids[:1], dtype=np.int32)])[0]))


def test_windows_change_nothing(oracle, monkeypatch):
    """Words cut into windows of a few places give the library's ids."""
    rng = random.Random(11)
    texts = ["a" * 301, "ab" * 150, "".join(rng.choices("ab", k=300)), "".join(rng.choices("acgt", k=400)), "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=400)), "=-" * 120, "é" * 90]
    for rows, size in ((1, 12), (2, 25), (5, 40), (40, 300), (299, 400)):
        monkeypatch.setattr(bpe, "ROWS", rows)
        small = bpe.Encoder(bpe.read_ranks(PATH), P.PATTERN)
        cut = [t[:size] for t in texts]
        for text, words in zip(cut, small.encode(cut), strict=True):
            assert ids_of(small, words) == oracle.encode_ordinary(text)


def test_windows_and_any_order_of_ranks(tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "ROWS", 4)
    rng = random.Random(12)
    for turn in range(3):
        made = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(40)}
        entries = [bytes([b]) for b in range(256)] + rng.sample(sorted(made), len(made))
        (tmp_path / str(turn)).write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(entries)))
        odd = bpe.Encoder(bpe.read_ranks(str(tmp_path / str(turn))), r"\p{L}+")
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 24))) for _ in range(12)]
        odd.learn(sorted(set(words)))
        ranks = {t: i for i, t in enumerate(entries)}
        assert all(odd.ids[w] == " ".join(map(str, brute(ranks, w))) for w in words)


def test_ten_long_runs_in_a_batch(spark):
    docs = make_docs(spark, [(i, ("-" if i % 2 else "a") * (1_500_000 + i), "en", "a") for i in range(10)]).coalesce(1)
    rows = bpe.encode(docs, PATH, P.PATTERN, outputs=("n_tokens", "decoded_sha256")).collect()
    assert {r.doc_id: r.decoded_sha256 for r in rows} == {i: hashlib.sha256((("-" if i % 2 else "a") * (1_500_000 + i)).encode()).hexdigest() for i in range(10)}


def brute(ranks, word):
    """One leftmost pair of minimum rank after another."""
    parts = [bytes([b]) for b in word.encode()]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_any_order_of_ranks(tmp_path):
    """Vocabularies whose tokens have pairs of lower rank than their own, with bounds that cut words into many queries."""
    rng = random.Random(10)
    for turn in range(12):
        made = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(40)}
        entries = [bytes([b]) for b in range(256)] + rng.sample(sorted(made), len(made))
        (tmp_path / str(turn)).write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(entries)))
        odd = bpe.Encoder(bpe.read_ranks(str(tmp_path / str(turn))), r"\p{L}+")
        words = ["".join(rng.choice("abc" if rng.random() < 0.9 else "xyz") for _ in range(rng.randrange(1, 60))) for _ in range(150)]
        odd.learn(sorted(set(words)))
        ranks = {t: i for i, t in enumerate(entries)}
        assert all(odd.ids[w] == " ".join(map(str, brute(ranks, w))) for w in words)


@pytest.mark.parametrize(("rows", "rounds"), [(7, 2), (100, 3), (10**6, 1)])
def test_bounds_change_nothing(oracle, monkeypatch, rows, rounds):
    monkeypatch.setattr(bpe, "ROWS", rows)
    monkeypatch.setattr(bpe, "ROUNDS", max(2, rounds))
    small = bpe.Encoder(bpe.read_ranks(PATH), P.PATTERN)
    text = "internationalisation of mississippi " + "ha" * 40 + " " + "strengths" * 6
    (words,) = small.encode([text])
    assert ids_of(small, words) == oracle.encode_ordinary(text)


def test_memory_of_words_is_bounded(oracle, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 50)
    small = bpe.Encoder(bpe.read_ranks(PATH), P.PATTERN)
    for i in range(8):
        text = " ".join(f"word{i}x{j}" for j in range(20))
        (words,) = small.encode([text])
        assert ids_of(small, words) == oracle.encode_ordinary(text)
    assert len(small.ids) <= 60
    small.close()
    assert not small.ids


def test_empty_and_null_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "doc_id long, ids array<int>")
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode(rows, PATH, P.PATTERN).collect()}
    assert got[1] == got[2] == b"" and len(got[3]) == 2
    assert bpe.decode(rows.limit(0), PATH, P.PATTERN).count() == 0


def test_frames(spark, odd, odd_rows, empty, oracle):
    rows = bpe.encode(odd, PATH, P.PATTERN, outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    want = sorted((d is None, d or 0, oracle.encode_ordinary(t or "")) for d, t, *_ in odd_rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in rows) == want
    text = {d: t or "" for d, t, *_ in odd_rows}
    for r in rows:
        assert bytes(r.decoded).decode() == text[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    encoded = bpe.encode(odd, PATH, P.PATTERN)
    back = bpe.decode(encoded, PATH, P.PATTERN).collect()
    assert {(r.doc_id, bytes(r.decoded).decode()) for r in back} == set(text.items())
    assert bpe.encode(empty, PATH, P.PATTERN).count() == 0

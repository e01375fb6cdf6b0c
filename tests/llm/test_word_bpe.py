import hashlib
import json
import random
import time
import unicodedata
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from docloom.llm import queries, word_bpe
from tests.llm.conftest import make_docs

PATH = P.path("word_bpe_49k.json")
TEXTS = ["", " \t", "a" * 3000, "ab" * 1500, "é" * 700, "日本語テキスト" * 120, " " * 2000 + "x", "\x1c\x1f\x85 　 a", "DON'T I'll  \n\n x", "😀" * 300, "=-" * 800, "ΑΣ ΑΣ. İstanbul ﬁ 5²½", "é é", "<|endoftext|>x<|startoftext|><|endoftext|>", "e<|endoftext|>́", "<| endoftext|>", "ᲉꟜ x࢏"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return word_bpe.Encoder(word_bpe.read_vocabulary(PATH))


def ids_of(encoder, texts):
    return [[int(i) for i in joined.split()] for joined in encoder.encode(texts)]


def want_of(library, texts):
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_ids_and_decoded_text(encoder, library):
    rng = random.Random(7)
    texts = TEXTS + ["".join(rng.choice("abcdeiou éß.,'\n7ΣЖ") for _ in range(400)) for _ in range(60)]
    got, want = ids_of(encoder, texts), want_of(library, texts)
    assert got == want
    assert [encoder.decode(np.array(x, dtype=np.int64)) for x in got] == library.decode_batch(want, skip_special_tokens=False)


def test_every_code_point(encoder, library):
    """Each between two letters; the library's own normaliser may know letters of a later Unicode."""
    texts = ["a" + chr(c) + "B" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0 or unicodedata.category(chr(c)) == "Lu")]
    assert ids_of(encoder, texts) == want_of(library, texts)


@pytest.mark.parametrize("letters", ["a", "ab", "acgt", "abcdefghijklmnopqrstuvwxyz", "aeinorst", "éa日", "-", "=-_"])
def test_long_words(encoder, library, letters):
    text = "".join(random.Random(8).choices(letters, k=20_000))
    assert ids_of(encoder, [text]) == want_of(library, [text])


def test_a_million_letters_end(encoder, library):
    texts = ["".join(random.Random(9).choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), "a" * 5_000_000]
    began = time.process_time()
    got = ids_of(encoder, texts)
    assert time.process_time() - began < 60
    name = lambda i: encoder.names[i].removesuffix("</w>")
    assert ["".join(map(name, x)) for x in got] == texts


def test_any_order_of_ranks():
    """Merge tables whose symbols have pairs of lower rank than their own, against one leftmost pair after another."""
    rng = random.Random(10)
    for _ in range(25):
        symbols, pairs = ["a", "b", "c", "a</w>", "b</w>", "c</w>"], []
        while len(pairs) < 30:
            x, y = rng.choice([s for s in symbols if not s.endswith("</w>")]), rng.choice(symbols)
            if len(x + y) < 12 and (x, y) not in pairs:
                pairs.append((x, y))
                if x + y not in symbols:
                    symbols.append(x + y)
        rng.shuffle(pairs)
        file = json.load(open(PATH))
        vocab = {t: i for i, t in enumerate(dict.fromkeys([*symbols, *word_bpe.byte_letters(), *(c + "</w>" for c in word_bpe.byte_letters())]))}
        file["model"] |= {"vocab": vocab, "merges": [list(p) for p in pairs]}
        file["added_tokens"] = []
        odd = word_bpe.Encoder(zlib.compress(json.dumps(file).encode()))
        rank = {p: i for i, p in enumerate(pairs)}
        for _ in range(60):
            word = "".join(rng.choice("abc" if rng.random() < 0.95 else "x") for _ in range(rng.randrange(1, 70)))
            parts = [*word[:-1], word[-1] + "</w>"]
            while found := [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]:
                i = min(found)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert odd.encode([word]) == [" ".join(str(vocab[p]) for p in parts)]


@pytest.mark.parametrize(("batch", "rounds"), [(1, 1), (50, 2), (10**6, 3)])
def test_bounds_change_nothing(library, monkeypatch, batch, rounds):
    monkeypatch.setattr(word_bpe, "BATCH", batch)
    monkeypatch.setattr(word_bpe, "ROUNDS", rounds)
    small = word_bpe.Encoder(word_bpe.read_vocabulary(PATH))
    texts = ["internationalisation of mississippi " + "ha" * 40 + " " + "strengths" * 6, "".join(random.Random(3).choices("abcdefghij", k=3000))]
    assert ids_of(small, texts) == want_of(library, texts)


def test_memory_of_words_is_bounded(library, monkeypatch):
    monkeypatch.setattr(word_bpe, "KEPT_WORDS", 50)
    small = word_bpe.Encoder(word_bpe.read_vocabulary(PATH))
    for i in range(8):
        text = "<|endoftext|> " + " ".join(f"word{chr(97 + i)}{chr(97 + j)}" for j in range(20))
        assert ids_of(small, [text]) == want_of(library, [text])
    assert len(small.ids) <= 60


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="word ends"):
        file = json.load(open(PATH))
        file["normalizer"]["normalizers"].pop()
        word_bpe.Encoder(zlib.compress(json.dumps(file).encode()))


def test_frames(spark, odd, odd_rows, empty, library):
    rows = word_bpe.encode(odd, PATH, outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    want = sorted((d is None, d or 0, x) for (d, *_), x in zip(odd_rows, want_of(library, [t or "" for _, t, *_ in odd_rows]), strict=True))
    assert sorted((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in rows) == want
    for r in rows:
        assert r.n_tokens == len(r.ids) and r.decoded == library.decode(r.ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    back = word_bpe.decode(word_bpe.encode(odd, PATH), PATH).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in back) == sorted((str(r.doc_id), r.decoded) for r in rows)
    assert word_bpe.encode(empty, PATH).count() == 0
    ids = spark.createDataFrame([(1, None), (2, []), (3, [49407, None, 10**6])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in word_bpe.decode(ids, PATH).collect()} == {1: "", 2: "", 3: "<|endoftext|>"}
    assert word_bpe.decode(ids.limit(0), PATH).count() == 0


def test_query_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {d: (len(x), sha(" ".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for (d, _), x in zip(docs, want_of(library, [t for _, t in docs]), strict=True)}
    assert {r.doc_id: tuple(r)[1:] for r in queries.op11_word_bpe(spark, sf).collect()} == want


def test_memory_of_a_document_with_clashing_names(spark):
    one = make_docs(spark, [(1, "x " * 10, "en", "a")], clash=True)
    assert word_bpe.encode(one, PATH).collect()[0].n_tokens == 10

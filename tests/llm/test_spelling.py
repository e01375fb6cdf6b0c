import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import queries, spelling
from docloom.llm.wavelet import WaveletTree
from tests.llm.conftest import make_docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_pairs(words):
    """Near pairs by patterns: the word without a letter, at each place."""
    by_pattern, by_word, near = defaultdict(set), set(words), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by_pattern[len(w), i, w[:i] + w[i + 1 :]].add(w)
            if (short := w[:i] + w[i + 1 :]) in by_word:
                near[w].add(short)
                near[short].add(w)
    for group in by_pattern.values():
        for w in group:
            near[w] |= group - {w}
    return near


def grouped(counts, ratio=10):
    near = near_pairs(counts)
    form = {}
    for w, n in counts.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= ratio * n:
                form[w] = best
    out = {}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None)
    return out


def as_rows(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 1000):
        numbers = rng.permutation(n) if n != 50 else rng.integers(0, 9, n)
        tree = WaveletTree(numbers)
        a, c = rng.integers(0, n + 1, 200), rng.integers(0, n + 1, 200)
        e, d = np.minimum(a + rng.integers(0, n + 1, 200), n), c + rng.integers(0, n + 1, 200)
        which, found = tree.report(a, e, c, d)
        want = sorted((q, int(x)) for q in range(200) for x in numbers[a[q] : e[q]] if c[q] <= x < d[q])
        assert sorted(zip(which.tolist(), found.tolist(), strict=True)) == want
    empty = WaveletTree(np.empty(0, dtype=np.int64)).report(*(np.zeros(1, dtype=np.int64),) * 4)
    assert not len(empty[0])


def made_words(rng, letters, sizes, n):
    out = set()
    while len(out) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.choice(sizes)))
        out.add(w)
        if rng.random() < 0.7:
            i = rng.randrange(len(w))
            out.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:]]) or "a")
    return {w: rng.choice([2, 3, 20, 30, 250, 4000, 41000, 500_000]) for w in sorted(out)}


@pytest.mark.parametrize(("large", "held", "asked"), [(1 << 16, 1 << 21, 1 << 20), (60, 3000, 50), (1, 1, 7)])
def test_groups_against_patterns(spark, monkeypatch, large, held, asked):
    """The bounds cut blocks to the last letter, pieces to one block and questions to a few; results stay."""
    monkeypatch.setattr(spelling, "LARGE", large)
    monkeypatch.setattr(spelling, "ASKED", asked)
    monkeypatch.setattr(spelling, "HELD", held)
    rng = random.Random(large)
    counts = made_words(rng, "ab", range(1, 9), 250) | made_words(rng, "abcdéÿß÷", range(5, 12), 400) | {"x" * 3000: 5, "x" * 2999: 80, "x" * 1500 + "y" + "x" * 1499: 900}
    got = as_rows(spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == grouped(counts)
    assert any(r[0] and r[1] != r[0] for r in got.values())


def test_a_third_of_the_words_share_half(spark):
    """Far more words than a block holds share their first letters."""
    rng = random.Random(4)
    counts = {"intermediate" + "".join(rng.choice("abcdefgh") for _ in range(8)): rng.choice([2, 40]) for _ in range(20_000)}
    assert as_rows(spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == grouped(counts)


def query_words(docs):
    counts = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            counts[run] += len(run) >= 7
    return {w: n for w, n in counts.items() if n >= 2}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    assert as_rows(queries.op13_spelling(spark, f"/root/testdata/{sf}")) == grouped(query_words(docs))


def test_odd_rows(spark, tmp_path, odd, odd_rows, empty):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    assert as_rows(queries.op13_spelling(spark, str(tmp_path))) == grouped(query_words([(d, t) for d, t, *_ in odd_rows]))
    none = spelling.group_variants(spelling.counted(spelling.runs(empty).select(F.col("run").alias("word")), least=7))
    assert none.count() == 0 and none.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_runs_are_maximal(spark):
    rows = make_docs(spark, [(1, "ÀBC-abÿ×z1 Ωmega", "en", "a"), (2, "", "en", "a"), (3, None, "en", "a")])
    assert sorted(r.run for r in spelling.runs(rows).collect()) == ["abÿ×z", "mega", "Àbc"]
    assert [r.run for r in spelling.runs(rows, least=5).collect()] == ["abÿ×z"]

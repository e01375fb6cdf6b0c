import math
import random
import re

import pytest

from docloom.llm import licenses
from docloom.llm.queries import op3_license_scan
from tests.llm.conftest import make_docs, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text):
    w = tokens(text)
    starts, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


SNIPPETS = ["Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "apache license", "mit\nLicense mit license", "CC-BY", "cc by by cc by", "gnu general public", "MİT License", "Kelvin K license", "mit licenses", "é mit license", "mité license", "license"]


def test_base_places(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice([*SNIPPETS, words(rng, 5), "x,y", ""]) for _ in range(rng.randrange(8))), "en", "a") for i in range(400)]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(make_docs(spark, rows).repartition(3)).collect()}
    assert got == {d: brute(t) for d, t, *_ in rows}


def test_notices_and_scores(spark):
    rows = [(0, "x " + SNIPPETS[0], "en", "a"), (1, SNIPPETS[1], "en", "a"), (2, "under apache license version 1", "en", "a"), (3, SNIPPETS[3], "en", "a"), (4, "apache version 2 0 license", "en", "a"), (5, "nothing here", "en", "a")]
    got = {r.doc_id: r for r in licenses.scan(make_docs(spark, rows)).collect()}
    assert got[0].labels == "apache,apache-2.0" and got[1].labels == "gpl,gpl-3.0" and got[2].labels == "apache"
    assert got[3].labels == "cc-by,cc-by-nc-4.0" and got[4].labels == "" and got[5].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {c.label: c.cover for c in got[0].covers}["apache-2.0"] > 0.99


def brute_notices(texts, least_cover=licenses.LEAST_COVER):
    """Labels, covers and score of every text, by trying every template at every place."""
    docs = [tokens(t) for t in texts]
    templates = licenses.templates_of(licenses.BASE, licenses.NOTICES)
    vocabulary = {w for t in templates for w in t["text"]}
    df = {w: sum(w in set(d) for d in docs) for w in vocabulary}
    idf = {w: 1 + math.log((len(docs) + 1) / (df[w] + 1)) for w in vocabulary}
    out = []
    for d in docs:
        covers = {}
        for t in templates:
            for at in range(len(d)):
                if d[at : at + len(t["key"])] != t["key"]:
                    continue
                start = at - t["shift"]
                inside = sum(idf[w] for j, w in enumerate(t["text"]) if 0 <= start + j < len(d) and d[start + j] == w)
                share = 1.0 if t["base"] else inside / sum(idf[w] for w in t["text"])
                if t["base"] or share >= least_cover:
                    covers[t["label"]] = max(covers.get(t["label"], 0), min(1.0, share))
        out.append((",".join(sorted(covers)), round(max(covers.values(), default=0.0), 9), {k: round(v, 9) for k, v in covers.items()}))
    return out


def damaged(rng, text):
    """A notice with words changed, cut off at either end, or repeated."""
    w = text.split()
    for _ in range(rng.choice([0, 0, 1, 3, 12])):
        w[rng.randrange(len(w))] = rng.choice(["changed", "license", "the"])
    a = rng.choice([0, 0, 0, 2, 9])
    return " ".join(w[a : len(w) - rng.choice([0, 0, 3, 15])])


def test_all_templates_against_brute_force(spark):
    rng = random.Random(14)
    rows = []
    for i in range(250):
        parts = [damaged(rng, rng.choice(licenses.NOTICES)[1]) if rng.random() < 0.6 else rng.choice([*SNIPPETS, words(rng, 6)]) for _ in range(rng.randrange(4))]
        rows.append((i, " ".join(parts), "en", "a"))
    got = {r.doc_id: (r.labels, round(r.score, 9), {c.label: round(c.cover, 9) for c in r.covers}) for r in licenses.scan(make_docs(spark, rows).repartition(3)).collect()}
    assert [got[d] for d, *_ in rows] == brute_notices([t for _, t, *_ in rows])
    assert len({k for _, _, covers in got.values() for k in covers}) > 15


def test_labels_of_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in op3_license_scan(spark, "/root/testdata/sf0.001").collect()}
    assert [got[r.doc_id] for r in rows] == [x[:2] for x in brute_notices([r.text for r in rows])]


def test_a_template_needs_its_key():
    with pytest.raises(ValueError, match="key phrase"):
        licenses.templates_of({}, (("x", "some text", "other"),))


def test_odd_rows(odd, odd_rows, empty):
    got = sorted((r.n_words, r.n_base) for r in licenses.scan(odd).collect())
    assert got == sorted((len(tokens(t)), 0) for _, t, *_ in odd_rows)
    assert licenses.scan(empty).count() == 0

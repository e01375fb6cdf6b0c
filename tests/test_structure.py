"""Closed forms over windows against plain folds."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import chunks, structure, tree


def test_parents_are_a_stack(spark):
    levels = [1, 3, 2, None, 1, None]
    rows = [("d", i, "text", "x", lv, 0) for i, lv in enumerate(levels)]
    df = spark.createDataFrame(rows, "doc_id string, ord int, type string, text string, text_level int, page_idx int")
    assert [r.parent_ord for r in tree.parents(df).orderBy("ord").collect()] == [None, 0, 0, 2, None, 4]


@pytest.mark.parametrize("seed", range(3))
def test_tree_against_a_stack(spark, seed):
    rng = random.Random(seed)
    rows = [(f"d{d}", i, "text", f"t{i}", rng.choice([None, None, 1, 2, 3, 4, 5]), i // 4) for d in range(6) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id string, ord int, type string, text string, text_level int, page_idx int")
    want = {}
    for d in range(6):
        stack = []
        for doc, i, _, _, lv, _ in rows:
            if doc != f"d{d}":
                continue
            if lv is not None:
                while stack and stack[-1][0] >= lv:
                    stack.pop()
            want[doc, i] = [n for _, n in stack]
            if lv is not None:
                stack.append((lv, i))
    nodes = tree.build_tree(df).collect()
    assert {(r.doc_id, r.ord): [int(a[4:]) for a in r.ancestors] for r in nodes} == want
    assert all(r.parent_id == (r.ancestors[-1] if r.ancestors else None) for r in nodes)
    slow = tree.ancestors(tree.build_tree(df).drop("ancestors"), most=6).collect()
    assert {(r.doc_id, r.node_id, r.ancestor, r.distance) for r in slow} == {(r.doc_id, r.node_id, r.ancestor, r.distance) for r in tree.ancestors(tree.build_tree(df)).collect()}


def test_level_normalisation(spark):
    rows = [("d", i, lv, f) for i, (lv, f) in enumerate([(3, False), (1, False), (4, False), (2, True), (4, False)])]
    df = spark.createDataFrame(rows, "doc_id string, ord int, level int, frozen boolean")
    assert [r.norm_level for r in structure.normalise_levels(df).orderBy("ord").collect()] == [1, 1, 2, 2, 3]


def test_page_run(spark):
    rows = [("d", p, n) for p, n in [(0, None), (1, 3), (2, 4), (4, 6), (5, 9)]]
    df = spark.createDataFrame(rows, "doc_id string, page_idx int, number int")
    r = structure.page_run(df).collect()[0]
    assert (r.offset, r.start, r.end) == (2, 1, 2)
    pages = {r.page_idx: r.logical_page for r in structure.logical_pages(df).collect()}
    assert pages == {0: "2", 1: "3", 2: "4", 4: "6", 5: "7"}
    shifted = spark.createDataFrame([("d", p, p - 1) for p in range(4)], "doc_id string, page_idx int, number int")
    assert [r.logical_page for r in structure.logical_pages(shifted).orderBy("page_idx").collect()] == ["cover", "cover", "1", "2"]


def test_greedy_merge(spark):
    rng = random.Random(3)
    rows = [("d", i, rng.random() < 0.6) for i in range(60)]
    df = spark.createDataFrame([(d, i, "x", 1, 1, ok) for d, i, ok in rows], "doc_id string, ord int, text string, page_idx int, level int, ok boolean")
    got = [r.absorbed for r in structure.merge_headings(df, allowed=df.ok).orderBy("ord").collect()]
    want, i = [False] * 60, 0
    while i < 60:
        if rows[i][2] and i + 1 < 60:
            want[i + 1] = True
            i += 1
        i += 1
    assert got == want


def test_caption_write_back(spark):
    items = spark.createDataFrame([("d", 0, "image", None, None, ["Line chart of sales"]), ("d", 1, "text", "Line chart of sales", 1, []), ("d", 2, "text", "Other heading", 1, [])], "doc_id string, ord int, type string, text string, level int, captions array<string>")
    roles = spark.createDataFrame([("d", 1, 0, "caption")], "doc_id string, ord int, media_ord int, role string")
    assert {r.ord: r.level for r in structure.apply_captions(items, roles).collect()} == {0: None, 1: 0, 2: 1}


def test_nested_trees(spark):
    raw = '{"node_id":"root","children":[{"node_id":"a","children":[{"node_id":"b"}]},{"node_id":"c"}]}'
    rows = tree.flatten_nested(spark.createDataFrame([("d", raw)], "doc_id string, root string"), levels=4).collect()
    assert {(r.node_id, r.parent_id, tuple(r.ord_path)) for r in rows} == {("root", None, ()), ("a", "root", (0,)), ("c", "root", (1,)), ("b", "a", (0, 0))}


def test_inherited_values(spark):
    df = spark.createDataFrame([("d", "a", None, "x"), ("d", "b", "a", None), ("d", "c", "b", "z"), ("d", "e", None, None)], "doc_id string, node_id string, parent_id string, lp string")
    assert {r.node_id: r.value for r in tree.inherited(df, "lp", most=3).collect()} == {"a": "x", "b": "x", "c": "z", "e": None}


def test_chunks():
    text = "word " * 400
    out = chunks.cut(text, limit=100, overlap=20)
    assert all(len(c) <= 100 for c in out) and out[0] == "word " * 19 + "word" and "".join(chunks.cut("x" * 250, limit=100, overlap=0)) == "x" * 250
    assert chunks.cut(None) == [] and chunks.cut("  a  b ") == ["a b"]


def test_section_chunks_stay_on_their_page(spark):
    rows = [("d", "s", "A > B", i, i // 3, f"n{i}", "x" * 700) for i in range(7)]
    df = spark.createDataFrame(rows, "doc_id string, section_id string, section_path string, ord int, page_idx int, node_id string, text string")
    out = chunks.section_chunks(df, most=1500, overlap=100).orderBy("chunk_idx").collect()
    assert all(r.text.startswith("[A > B]\n") for r in out)
    assert [(r.page_idx, list(r.source_node_ids)) for r in out] == [(0, ["n0", "n1"]), (0, ["n2"]), (1, ["n3", "n4"]), (1, ["n5"]), (2, ["n6"])]


def chunked(units, most, overlap):
    """Sections packed unit by unit, as lists of (ids, page, text)."""
    out, held = [], []
    for node, page, text in units:
        if not (text or "").strip():
            continue
        text = text.strip()
        if held and held[-1][1] is not None and held[-1][1] != page:
            out.append(held)
            held = []
        if held and sum(len(t) for _, _, t in held) + len(text) > most:
            out.append(held)
            tail, n = [], 0
            for u in reversed(held):
                if n + len(u[2]) + 1 > overlap:
                    break
                tail.insert(0, u)
                n += len(u[2]) + 1
            held = tail
        held = [*held, (node, page, text)]
    return [*out, held] if held else out


def test_section_chunks_keep_whole_units(spark):
    """Overlaps are whole units with their ids; blanks, nulls, null pages and units longer than a chunk included."""
    import random

    rng = random.Random(3)
    sections = {}
    for s in range(12):
        page = 0
        sections[f"s{s}"] = []
        for i in range(rng.randrange(1, 40)):
            page = None if rng.random() < 0.05 else (page or 0) + (rng.random() < 0.15)
            sections[f"s{s}"].append((f"n{i}", page, rng.choice([None, " \t", "x" * rng.randrange(1, 90), "é" * 30, "w " * rng.randrange(1, 60), "y" * 500])))
    rows = [("d", s, "P", i, p, n, t) for s, us in sections.items() for i, (n, p, t) in enumerate(us)]
    df = spark.createDataFrame(rows, "doc_id string, section_id string, section_path string, ord int, page_idx int, node_id string, text string")
    got = {}
    for r in chunks.section_chunks(df.repartition(5), most=200, overlap=90).orderBy("section_id", "chunk_idx").collect():
        got.setdefault(r.section_id, []).append((list(r.source_node_ids), r.text))
    want = {s: [([n for n, _, _ in c], "[P]\n" + "\n".join(t for _, _, t in c)) for c in found] for s, us in sections.items() if (found := chunked(us, 200, 90))}
    assert got == want and any(a[0][-1] == b[0][0] for cs in want.values() for a, b in zip(cs, cs[1:], strict=False))
    assert chunks.section_chunks(df.limit(0)).count() == 0


def test_trees_of_any_depth(spark):
    """Forty levels of headings, of nested nodes and of parents: none is lost or moved."""
    from docloom.operators import tree

    items = spark.createDataFrame([("d", i, "text", f"h{i}", i + 1, 0) for i in range(40)] + [("d", 40, "text", "body", None, 0)], "doc_id string, ord int, type string, text string, text_level int, page_idx int")
    rows = {r.ord: r for r in tree.build_tree(items, levels=None).collect()}
    assert all(rows[i].parent_id == f"sec_{i - 1}" and len(rows[i].ancestors) == i for i in range(1, 41))
    assert {r.ord for r in tree.build_tree(items, levels=40).collect()} == set(rows)
    with pytest.raises(Exception, match="deeper than levels=12"):
        tree.build_tree(items).collect()
    node = '{"node_id": "n39"}'
    for i in reversed(range(39)):
        node = f'{{"node_id": "n{i}", "children": [{node}]}}'
    flat = {r.node_id: r.parent_id for r in tree.flatten_nested(spark.createDataFrame([("d", node)], "doc_id string, root string")).collect()}
    assert flat == {"n0": None} | {f"n{i}": f"n{i - 1}" for i in range(1, 40)}
    plain = spark.createDataFrame([("d", f"n{i}", f"n{i - 1}" if i else None) for i in range(20)], "doc_id string, node_id string, parent_id string")
    assert tree.ancestors(plain).count() == sum(range(20))


def test_leaf_blocks(spark):
    rows = [("d", "s", 0, f"t_{i}", "y" * n) for i, n in enumerate([100, 100, 100, 900, 10])]
    df = spark.createDataFrame(rows, "doc_id string, parent_section string, page_idx int, node_id string, raw_text string")
    out = chunks.leaf_blocks(df).orderBy("block_idx").collect()
    assert [len(r.raw_text) for r in out] == [302, 720, 260, 10] and list(out[0].source_ids) == ["t_0", "t_1", "t_2"]


def test_chapter_blocks(spark):
    rows = [("d", 1, i, "T", "w " * 30, i) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id string, chapter int, ord int, title string, text string, page_idx int")
    out = chunks.chapter_blocks(df, most_words=70).orderBy("block").collect()
    assert [(r.word_count, r.element_count, r.page_lo, r.page_hi) for r in out] == [(60, 2, 0, 1), (60, 2, 2, 3), (30, 1, 4, 4)]


def test_summaries():
    s = ["Cats eat fish every single day.", "Cats eat fish every single day again.", "Dogs prefer bones to anything else."]
    assert chunks.summarise(s, k=2, budget=200).count(".") == 2 and "Dogs" in chunks.summarise(s, k=2, budget=200)
    assert chunks.summarise([], k=2) == "" and len(chunks.summarise(["a b c d e f g h " * 20], budget=50)) <= 50
    assert set(chunks.sentence_idf(["the cat and it", "a cat of the dogs"])) == {"cat", "dogs"}  # stop words have no weight
    # the order of choice, not of the text; the last choice may pass the budget and is cut
    words = ["ordinary words about nothing much here", "zebra quagga okapi tapir gnu", "zebra quagga okapi tapir gnu again"]
    assert chunks.summarise(words, k=1).startswith("zebra") and chunks.summarise(words, k=2).split(" ordinary")[0].startswith("zebra")
    assert chunks.summarise(words, k=3, budget=30) == "zebra quagga okapi tapir gnu" and len(chunks.summarise(words, k=3, budget=40)) <= 40
    alike = ["alpha beta gamma delta epsilon", "zeta eta theta iota kappa"]
    assert chunks.summarise(alike, k=1) == alike[0] and chunks.summarise(alike, k=1, keywords=("Iota",)) == alike[1]


def test_tasks_hold_so_many_bytes_however_large_the_input(spark, monkeypatch):
    rows = [(f"d{d}", i, "text", "x" * 900, 1 if i % 4 == 0 else None, i // 3) for d in range(40) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id string, ord int, type string, text string, text_level int, page_idx int")
    blocks = df.select("doc_id", "page_idx", F.lit(0).alias("pos"), F.lit(5).alias("bbox"))
    monkeypatch.setattr(tree, "TASK_BYTES", 20_000)
    for out in (tree.build_tree(df), tree.slide_tree(df)):
        assert out.rdd.getNumPartitions() == 20
    assert tree.with_layout(df.withColumn("bbox", F.lit(1)), blocks).rdd.getNumPartitions() == 4


def test_slides_without_pages_orders_or_titles(spark):
    rows = [("d", 0, "text", "- a bullet here", 2), ("d", 1, "text", "the later title", 2), ("d", 2, "text", " a fitting title ", 0), ("d", 3, "image", None, 0), ("d", 4, "text", "no page at all", None), ("e", 0, "text", "short", 7)]
    df = spark.createDataFrame(rows, "doc_id string, ord int, type string, text string, page_idx int")
    out = [(r.doc_id, r.node_idx, r.slide_number, r.type, r.text) for r in tree.slide_tree(df).orderBy("doc_id", "node_idx").collect()]
    assert out == [
        ("d", 0, 1, "slide", None), ("d", 1, 1, "heading", "Slide 1"), ("d", 2, 1, "text", "no page at all"),
        ("d", 3, 2, "slide", None), ("d", 4, 2, "heading", "a fitting title"), ("d", 5, 2, "text", " a fitting title "), ("d", 6, 2, "image", None),
        ("d", 7, 3, "slide", None), ("d", 8, 3, "heading", "the later title"), ("d", 9, 3, "text", "- a bullet here"), ("d", 10, 3, "text", "the later title"),
        ("e", 0, 1, "slide", None), ("e", 1, 1, "heading", "Slide 1"), ("e", 2, 1, "text", "short"),
    ]


def test_layout_boxes_with_shifts_gaps_and_repeats(spark):
    items = spark.createDataFrame([("a", 0, 0, 1), ("a", 1, 0, 2), ("a", 2, 1, 3), ("b", 0, 0, 4), ("c", 0, None, 5), ("z", 0, 0, None)], "doc_id string, ord int, page_idx int, bbox int")
    blocks = spark.createDataFrame([("a", 1, 1, 20), ("a", 2, 0, 30), ("b", 0, 0, 40), ("b", 0, 0, 41), ("c", None, 0, 9), ("y", 0, 0, 8)], "doc_id string, page_idx int, pos int, bbox int")
    got = sorted((r.doc_id, r.ord, -1 if r.page_idx is None else r.page_idx, r.bbox) for r in tree.with_layout(items, blocks).fillna(-1, ["bbox"]).collect())
    assert got == [("a", 0, 0, 1), ("a", 1, 0, 20), ("a", 2, 1, 30), ("b", 0, 0, 40), ("b", 0, 0, 41), ("c", 0, -1, 5), ("z", 0, 0, -1)]

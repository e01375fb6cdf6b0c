"""Model slots with fake models and with their rules; ports; plan choice, repair and image answers."""

import json

import pytest

from docloom.plans import ir, models, ports, router
from docloom.plans.ask import ask
from docloom.plans.executor import Catalog, Context, Executor, run_plan, stub_catalog

ITEMS = "doc_id string, ord int, page_idx int, type string, text string, level int, logical_page string"


@pytest.fixture
def book(spark):
    rows = [
        ("a", 0, 0, "text", "1 Intro .... 1\n1.1 Aims of it .... 1\n2 Methods used .... 2", None, None),
        ("a", 1, 1, "text", "Intro", 3, "1"),
        ("a", 2, 1, "text", "a long running text that says a lot of things", None, "1"),
        ("a", 3, 1, "text", "Aims of it", None, "1"),
        ("a", 4, 2, "text", "Methods used", 1, "2"),
        ("a", 5, 2, "image", "", None, "2"),
        ("a", 6, 2, "text", "Figure 1: what it is", 1, "2"),
        ("a", 7, 2, "text", "Source: ours", None, "2"),
        ("b", 0, 0, "text", "1.2 Only heading", 1, None),
        ("b", 1, 0, "text", "12", None, None),
    ]
    return spark.createDataFrame(rows, ITEMS)


def test_contents_by_rule(book):
    assert [(r.doc_id, r.page_idx) for r in models.contents_pages(book).collect()] == [("a", 0)]
    got = [(r.level, r.title, r.page) for r in models.toc_entries(book.where("doc_id = 'a' AND page_idx = 0")).orderBy("ord").collect()]
    assert got == [(1, "1 Intro", "1"), (2, "1.1 Aims of it", "1"), (1, "2 Methods used", "2")]
    out = {(r.doc_id, r.ord): (r.level, r.from_toc) for r in models.restructure(book).collect()}
    assert out["a", 1] == (1, True) and out["a", 3] == (2, True) and out["a", 4] == (1, True) and out["b", 0] == (2, False)


def test_contents_by_model(book):
    def model(prompts):
        return ['{"is_toc": %s, "items": [{"level": 1, "title": "Methods used", "page": "2"}, {"title": " "}]}' % json.dumps("...." in p) for p in prompts]

    assert [(r.doc_id, r.page_idx) for r in models.contents_pages(book, model).collect()] == [("a", 0)]
    out = {(r.doc_id, r.ord): (r.level, r.from_toc) for r in models.restructure(book, toc_model=model).collect()}
    assert out["a", 4] == (1, True) and out["a", 1] == (3, False)


def test_levels_by_model(book):
    def model(prompts):
        return ['note {"items": [{"ord": 4, "level": 5}, {"ord": 1, "keep": false}]} end' for _ in prompts]

    out = {r.ord: (r.level, r.chosen) for r in models.heading_levels(book.where("doc_id = 'a' AND level IS NOT NULL"), model).collect()}
    assert out == {1: (3, False), 4: (5, True), 6: (1, True)}
    broken = models.heading_levels(book.where("level IS NOT NULL"), lambda ps: ["?"] * len(ps))
    assert {r.chosen for r in broken.collect()} == {True}


def test_captions(book):
    want = {(6, 5, "caption"), (7, 5, "footnote")}
    assert {(r.ord, r.media_ord, r.role) for r in models.caption_roles(book).collect()} == want
    model = lambda ps: ['{"items": [{"ord": 6, "role": "caption"}, {"ord": 7, "role": "odd"}, {"ord": 99, "role": "caption"}]}'] * len(ps)
    assert {(r.ord, r.media_ord, r.role) for r in models.caption_roles(book, model).collect()} == {(6, 5, "caption")}
    items, counts = models.clean_captions(book)
    assert {r.ord: r.level for r in items.where("doc_id = 'a' AND level IS NOT NULL").collect()}[6] == 0
    assert [(r.n_captions, r.n_footnotes) for r in counts.collect()] == [(1, 1)]


def test_pages_slides_summaries_grades(spark, book):
    assert {(r.doc_id, r.page_idx): r.logical_page for r in models.page_numbers(book).collect()}["b", 0] == "12"
    told = models.page_numbers(book, lambda ps: ['{"page": "iv"}'] * len(ps)).collect()
    assert {r.logical_page for r in told} == {"iv"}
    titles = {(r.doc_id, r.page_idx): r.title for r in models.slide_titles(book, lambda ps: ['{"title": " "}'] * len(ps)).collect()}
    assert titles["a", 2] == "Methods used"
    nodes = spark.createDataFrame([("d", "n", "section", "T", "old", ["x"])], "doc_id string, node_id string, role string, title string, dense_text string, hints array<string>")
    assert models.summaries(nodes) is nodes
    new = models.summaries(nodes, lambda ps: ['{"summary": "new", "hints": [" ", "y"]}' for _ in ps]).head()
    assert (new.dense_text, new.hints) == ("new", ["y"])
    samples = spark.createDataFrame([("q", "12", "Thinking\n12", "Int")], "question string, answer string, pred string, answer_format string")
    assert models.graded(samples).head().score == 1.0
    assert models.graded(samples, lambda ps: ['{"extracted": "12", "score": 3}' for _ in ps]).head().score == 1.0


def test_plan_choice_repair_and_steps():
    a = ir.Plan((ir.Stage("t", "text", (ir.Node("bm25_node.search", {"query": "x"}, "found"),)),))
    assert ir.select_plan([a, ir.Plan(())]) is a
    with pytest.raises(ir.PlanError):
        ir.select_plan([])
    with pytest.raises(ir.PlanError):
        ir.select_plan([a], "best")
    assert ir.repair(a, {}, "x").stages[0].nodes[0].op == "hybrid.search"
    assert ir.repair(ir.repair(a, {}, "x"), {}, "x") is None
    nodes = (ir.Node("bm25_node.search", {}, "a"), ir.Node("structure.expand", {}, "b", ("a",)))
    stage = ir.Stage("s", "text", nodes, step_ids=("b",))
    assert ir.chosen_steps(stage) == nodes[1:] and ir.chosen_steps(ir.Stage("s", "text", nodes, step_ids=("none",))) == nodes
    assert [ir.action_of(n) for n in nodes] == ["retrieve", "move"] and ir.action_of(ir.Node("vlm.answer")) == "answer"
    planner = router.Planner(rewrite=lambda d: router.route("What is on page 3?"))
    assert planner.plan("anything").stages[0].nodes[0].op == "page_locator.locate"
    assert router.Planner(planlet=lambda d: a).plan("x") is a


def test_stub_catalog_and_seeds(spark):
    catalog = stub_catalog(spark, [("n1", "red apples"), ("n2", "green pears"), ("n3", "red pears")])
    rows, _ = run_plan(ir.Plan((ir.Stage("t", "text", (ir.Node("bm25_node.search", {"query": "red apples"}, "f"),)),)), catalog)
    assert [r.node_id for r in rows.collect()][0] == "n1"
    ids = Context(catalog).source({"source": ["n2", "n3", "n2"]})
    assert sorted(r.node_id for r in ids.collect()) == ["n2", "n3"]
    with pytest.raises(KeyError):
        Context(catalog).source({})
    catalog.rank = lambda query, hits: hits.withColumn("score", -hits.score)
    rows, _ = run_plan(ir.Plan((ir.Stage("t", "text", (ir.Node("bm25_node.search", {"query": "red apples"}, "f"),)),)), catalog)
    assert [r.node_id for r in rows.collect()][0] == "n3"
    catalog.rank = None
    assert ask("Where are the red apples?", catalog)["answer"] == "red apples"


def test_image_answers(spark):
    images = spark.createDataFrame([("i1", bytearray(b"cat")), ("i2", bytearray(b"dog")), ("i3", bytearray(b""))], "node_id string, content binary")
    hits = spark.createDataFrame([("i2", 0.9), ("i1", 0.5), ("i3", 0.1)], "node_id string, score double")

    def look(question, content):
        return {"answer": content.decode(), "confidence": 0.5, "thinking": question} if content else {}

    ctx = Context(Catalog(images=images, look=look), {"hits": hits})
    out = Executor().run(ctx, ir.Node("vlm.answer", {"question": "what?"}, "told", ("hits",)))
    row = out.rows.head()
    assert (row.answer, row.confidence, row.thinking, row.n_images) == ("dog\ncat", 0.5, "what?", 3)
    assert Executor().run(ctx, ir.Node("vlm.answer", {}, "told", ("hits",))).status == "error"
    assert Executor().run(Context(Catalog(images=images), {"hits": hits}), ir.Node("vlm.answer", {"question": "q"}, "t", ("hits",))).status == "error"


def test_back_ends(spark, tmp_path):
    rows = spark.createDataFrame([("n1", "red apples"), ("n2", "green pears")], "node_id string, text string")
    for back in (ports.KeywordBackend(), ports.VectorBackend(), ports.VectorBackend(lambda ts: [[float(t.count("p")), 1.0] for t in ts])):
        assert isinstance(back, ports.Retrieval)
        built = back.build(rows)
        built.persist(f"{tmp_path}/{id(back)}")
        assert [r.node_id for r in built.search("red apples", k=1).collect()] == [r.node_id for r in back.load(spark, f"{tmp_path}/{id(back)}").search("red apples", k=1).collect()]
    assert ports.KeywordBackend().build(rows).search("pears").head().node_id == "n2"

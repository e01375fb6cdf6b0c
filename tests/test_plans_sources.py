import json
import uuid

import pytest
from pyspark.sql import functions as F

from docloom.functions import scoring as S
from docloom.plans import ask, ir, router, slots
from docloom.plans.cache import StepCache, memoised, signature
from docloom.plans.executor import Catalog, Context, Executor, Registry, execute_policy, run_plan
from docloom.sources import io
from docloom.streaming import ingest


@pytest.fixture(scope="module")
def catalog(spark):
    tables = spark.createDataFrame([("tab_1", "Sales by region", ["Region", "Sales"], [["North", "10"], ["South", "5"]])], "node_id string, caption string, columns array<string>, rows array<array<string>>")
    nodes = spark.createDataFrame([("tab_1", 3, "table"), ("t_1", 1, "paragraph")], "node_id string, page_idx int, role string")
    sparse = spark.createDataFrame([("t_1", "paragraph", "trees", "a text about trees")], "node_id string, role string, title string, body string")
    evidence = spark.createDataFrame([("t_1", "text", "a text about trees"), ("tab_1", "table", "Region | Sales")], "node_id string, modality string, content string")
    figures = spark.createDataFrame([("img_1", ["sales"], 1)], "node_id string, tokens array<string>, page_idx int")
    index = spark.createDataFrame([("t_1", 1), ("tab_1", 3)], "node_id string, page int")
    labels = spark.createDataFrame([("Table 1", "tab_1")], "label string, node_id string")
    return Catalog(sparse=sparse, tables=tables, nodes=nodes, evidence=evidence, figure_tokens=figures, page_index=index, labels=labels, texts=evidence.select("node_id", F.col("content").alias("text")))


def test_validation():
    node = ir.Node("bm25_node.search", {"query": "x"})
    with pytest.raises(ir.PlanError):
        ir.validate(ir.Plan(()))
    with pytest.raises(ir.PlanError):
        ir.validate(ir.Plan((ir.Stage("s", "text", (node,) * 7),)))
    with pytest.raises(ir.PlanError):
        ir.validate(ir.Plan((ir.Stage("s", "text", (ir.Node("drop.table"),)),)))
    with pytest.raises(ir.PlanError):
        ir.validate(ir.Plan((ir.Stage("s", "text", (ir.Node("compute.eval", {}, None, ("nothing",)),)),)))
    assert ir.validate(ir.Plan((ir.Stage("s", "text", (ir.Node("sparse_search"),)),))).stages[0].nodes[0].op == "bm25_node.search"


def test_lowering():
    plan = ir.lower(ir.Plan((ir.Stage("t", "table", (ir.Node("table_index.search", {"keywords": ("a",)}),)),)))
    assert [s.name for s in plan.stages] == ["t", "chart_fallback"] and plan.stages[1].run_if == "prev_coverage < 0.5"
    assert plan.stages[0].nodes[-1].op == "pack.mmr_knapsack"


@pytest.mark.parametrize("condition, want", [("", True), ("prev_coverage < 0.5", True), ("prev_coverage >= 0.5", False), ("what ever", True), ("prev_coverage < x", True)])
def test_conditions(condition, want):
    assert ir.should_run(condition, {"prev_coverage": 0.2}) is want


def test_routing():
    d = router.route("How many regions on page 3 of Table 2 had more than 1,500 sales in 2014?")
    assert d.evidence == "table" and d.pages == (3,) and d.tables == ("Table 2",) and d.years == (2014,) and d.comparator == ">" and d.threshold == 1500 and d.operations == ("count",) and d.expected == "int"
    assert router.route("What does Figure 4 show?").evidence == "graphics" and router.policy("See Figure 4")["strategy"] == "direct_label"
    assert router.policy("what is on page 7")["strategy"] == "direct_page" and router.policy("x", k=999)["k"] == 200


def test_plan_runs(catalog):
    rows, outcomes = run_plan(router.plan(router.route("What is the total of sales in the table?")), catalog)
    assert rows.collect()[0].result == 15.0 and all(o.status == "ok" for v in outcomes.values() for o in v)


def test_failed_tools_are_outcomes(catalog):
    r = Registry()
    calls = []
    r.register("bm25_node.search", lambda c, a: calls.append(1) or 1 / 0)
    out = Executor(r, retries=2).run(Context(catalog), ir.Node("bm25_node.search"))
    assert out.status == "error" and out.attempts == 3 and len(calls) == 3 and "ZeroDivisionError" in out.error
    with pytest.raises(KeyError):
        Executor(r).run(Context(catalog), ir.Node("toc_anchor.locate"))
    with pytest.raises(ValueError):
        r.register("bm25_node.search", lambda c, a: None)


def test_policies(catalog):
    assert execute_policy(router.policy("Table 1"), catalog).collect()[0].node_id == "tab_1"
    assert execute_policy(router.policy("page 3"), catalog).collect()[0].node_id == "tab_1"
    assert execute_policy({"strategy": "sparse", "query": "trees", "k": 5}, catalog).collect()[0].node_id == "t_1"


def test_ask(catalog):
    out = ask.ask("What is the average of sales in the table?", catalog)
    assert out["answer"] == "7.5" and out["passed"]
    out = ask.ask("text about trees", catalog)
    assert "trees" in out["answer"] and out["evidence"] == ["t_1"]
    assert ask.ask("zebra", catalog)["answer"] == "Not answerable"


def test_slots(spark):
    assert slots.parse_ranking('noise {"hits": [{"node_id": "a#g", "base_id": "a", "score": 7}]}') == {"a": 1.0} and slots.parse_ranking("x") == {}
    assert slots.render("a {x} {y} {}", x=1) == "a 1 {y} {}"
    v = slots.merge_verdicts([{"passed": True, "score": 0.5, "issues": [], "recommendation": "accept"}, {"passed": False, "score": 0.1, "issues": ["fatal: x"], "recommendation": "replan"}])
    assert not v["passed"] and v["recommendation"] == "replan"
    media = spark.createDataFrame([(bytearray(b"x"), None, "c"), (bytearray(b"y"), "d", None)], "content binary, description string, caption string")
    rows = slots.describe_media(media, lambda b: [{"description": "new", "caption": "new"} for _ in b]).collect()
    assert [(r.description, r.caption) for r in rows] == [("new", "c"), ("d", "new")]


CASES = [
    ("5", "5.0", "Int", 1.0), ("5", "6", "Int", 0.0), ("5", "x", "Int", 0.0), ("0.5", "50%", "Float", 1.0), ("12.5", "12.6", "Float", 1.0), ("12.5", "13", "Float", 0.0),
    ("Paris", "paris", "Str", 1.0), ("abcd", "abxy", "Str", 0.0), ("abcd", "abcx", "Str", 0.75), ("page 3", "page 4", "Str", 0.0), ("Not answerable", "Not answerable", "None", 1.0),
    ("['a','b']", "['b','a']", "List", 1.0), ("['a','b']", "['a']", "List", 0.0), ("['1','2']", "['2','3']", "List", 0.0), ("3 miles", "3 mile", "Str", None),
]


@pytest.mark.parametrize("gold, pred, kind, want", CASES)
def test_answer_scores(spark, gold, pred, kind, want):
    got = spark.range(1).select(S.answer_score(F.lit(gold), F.lit(pred), F.lit(kind)).alias("s")).collect()[0].s
    assert got == (want if want is not None else got)


def test_formats(spark):
    check = lambda v, k: spark.range(1).select(S.format_conforms(F.lit(v), k).alias("v")).collect()[0].v
    assert check("1,200", "int") and not check("1.5", "int") and check("12.5%", "float") and check("a, b", "list") and not check("", "string")


def test_readers(spark, tmp_path):
    doc = tmp_path / "doc1" / "auto"
    doc.mkdir(parents=True)
    (doc / "doc1_content_list.json").write_text(json.dumps([{"type": "text", "text": "Title", "text_level": 1, "page_idx": 0}, {"type": "text", "text": "Body", "page_idx": 1}]))
    rows = io.read_content_lists(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.doc_id, r.ord, r.text, r.text_level) for r in rows] == [("auto", 0, "Title", 1), ("auto", 1, "Body", None)]
    (doc / "doc1_adapted.json").write_text("[]")
    files = io.list_files(spark, str(tmp_path), pattern="*.json")
    assert [r.name for r in io.preferred_inputs(files).collect()] == ["doc1_adapted.json"]
    lines = tmp_path / "x.jsonl"
    lines.write_text('{"id": "a", "title": " ", "body": "b"}\n\nbroken\n{"id": "c", "title": ""}\n')
    assert [r.node_id for r in io.read_sparse(spark, str(lines)).collect()] == ["a"]
    with pytest.raises(Exception):
        io.read_jsonl(spark, str(lines), io.SPARSE, strict=True).collect()
    io.write_view(spark.createDataFrame([("body", "x"), ("title", "y")], "field string, term string"), str(tmp_path / "postings"), by="field")
    assert spark.read.parquet(str(tmp_path / "postings")).where("field = 'title'").collect()[0].term == "y"


def test_layout_enrichment(spark):
    content = spark.createDataFrame([("a/fig1.png",), ("b/fig2.png",), ("c/none.png",)], "img_path string")
    layout = spark.createDataFrame([("x/fig1.png", [1.0]), ("x/page_fig2_big.jpg", [2.0])], "img_path string, bbox array<double>")
    assert {r.img_path: r.bbox for r in io.enrich_with_layout(content, layout).collect()} == {"a/fig1.png": [1.0], "b/fig2.png": [2.0], "c/none.png": None}


def test_step_cache(spark, tmp_path):
    cache, made = StepCache(spark, f"file://{tmp_path}/cache"), []
    make = lambda: made.append(1) or spark.range(3)
    first, sig = cache.load_or_compute("numbers", make, {"n": 3})
    again, _ = cache.load_or_compute("numbers", make, {"n": 3})
    assert first.count() == again.count() == 3 and len(made) == 1
    assert signature({"n": 3}, [], "v2") != sig
    with pytest.raises(FileNotFoundError):
        cache.load_or_compute("numbers", make, {"n": 4}, cache_only=True)
    known = spark.createDataFrame([("a", "A")], "key string, response string")
    asked = []

    def call(df):
        asked.extend(r.key for r in df.collect())
        return df.select("key", F.upper("key").alias("response"))

    every, new = memoised(spark.createDataFrame([("a", "x"), ("b", "y")], "key string, request string"), known, call)
    assert asked == ["b"] and {r.response for r in every.collect()} == {"A", "B"} and new.count() == 1
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def model(x):
        calls.add(1)
        return x + str(uuid.uuid4())

    twice = spark.createDataFrame([("c", "x"), ("d", "y"), ("c", "x")], "key string, request string")
    every, new = memoised(twice, known, lambda df: df.select("key", model("request").alias("response")))
    used = {r.key: r.response for r in every.collect()}
    assert calls.value == 2 and {r.key: r.response for r in new.collect()} == used and every.count() == 3 and calls.value == 2


def test_samples_round_trip(spark, tmp_path):
    """Samples read, joined with the pages found for them, written and read again: best pages first, at most k."""
    lines = [{"doc_id": "a", "question": "q1", "answer": "x", "evidence_pages": [1]}, {"doc_id": "b", "question": "q1"}, {"doc_id": "b", "question": "q2", "retrieved_pages": [9]}]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\nnot json\n")
    samples = io.read_samples(spark, f"{tmp_path}/in.jsonl")
    ids = {(r.doc_id, r.question): r.sample_id for r in samples.collect()}
    assert len(ids) == len(set(ids.values())) == 3
    hits = spark.createDataFrame([(ids["a", "q1"], p, s) for p, s in ((4, 0.5), (2, 0.9), (7, 0.5))] + [(ids["b", "q1"], 1, 0.1)], "sample_id string, page_idx int, score double")
    io.write_samples(samples, hits, f"{tmp_path}/out", k=2)
    back = {(r.doc_id, r.question): (r.retrieved_pages, r.retrieved_scores, r.answer) for r in io.read_samples(spark, f"{tmp_path}/out").collect()}
    assert back == {("a", "q1"): ([2, 4], [0.9, 0.5], "x"), ("b", "q1"): ([1], [0.1], None), ("b", "q2"): (None, None, None)}


def test_layout_names_stay_in_their_document(spark):
    """Equal names in two documents; the plan compares no name with all others."""
    content = spark.createDataFrame([("a", "x/1.png"), ("b", "x/1.png"), ("a", "2.png"), ("b", "no.png"), ("a", None)], "doc_id string, img_path string")
    layout = spark.createDataFrame([("a", "1.png", [1.0]), ("b", "1.png", [2.0]), ("b", "y/2.png", [3.0]), ("a", "fig_2_b.png", [4.0]), ("a", "fig_2_a.png", [5.0])], "doc_id string, img_path string, bbox array<double>")
    out = io.enrich_with_layout(content, layout)
    assert {(r.doc_id, r.img_path): r.bbox for r in out.collect()} == {("a", "x/1.png"): [1.0], ("b", "x/1.png"): [2.0], ("a", "2.png"): [5.0], ("b", "no.png"): None, ("a", None): None}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_streaming_view(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([("d1", "one"), ("d2", "two")], "doc_id string, text string").write.parquet(source)
    view = lambda df: df.select("doc_id", F.upper("text").alias("text"))
    stream = lambda: ingest.stream_files(spark, source, "doc_id string, text string")
    ingest.maintain_view(stream(), view, out, f"{tmp_path}/check").awaitTermination()
    spark.createDataFrame([("d2", "new")], "doc_id string, text string").write.mode("append").parquet(source)
    ingest.maintain_view(stream(), view, out, f"{tmp_path}/check").awaitTermination()
    assert {(r.doc_id, r.text) for r in ingest.read_view(spark, out).collect()} == {("d1", "ONE"), ("d2", "NEW")}


def test_streaming_windows(spark, tmp_path):
    path = f"{tmp_path}/events"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(path)
    stream = ingest.stream_files(spark, path, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    q = ingest.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = ingest.windowed_counts(spark.read.parquet(path))
    assert {tuple(r)[:3] for r in spark.table("win").collect()} == {tuple(r)[:3] for r in batch.collect()}


@pytest.mark.parametrize("few", [0, 64])
def test_layout_names_of_small_documents_are_compared_outright(spark, monkeypatch, few):
    """A document of many names uses the index of pieces, others none of it; both find the first name that contains a stem."""
    monkeypatch.setattr(io, "FEW_NAMES", few)
    names = [("a", f"page_{i}_x.jpg") for i in range(70)] + [("b", "page_3_x.jpg"), ("b", "page_3_a.jpg"), ("c", "3.png")]
    content = [(d, f"in/{n}.png") for d in "abcd" for n in ("3", "page_6", "69_x")]
    layout = spark.createDataFrame([(d, n, [float(i)]) for i, (d, n) in enumerate(names)], "doc_id string, img_path string, bbox array<double>")
    found = io.enrich_with_layout(spark.createDataFrame(content, "doc_id string, img_path string"), layout).collect()
    want = {}
    for d, p in content:
        stem = p[3:-4]
        held = sorted((n != stem + ".png", n.rsplit(".", 1)[0], i) for i, (x, n) in enumerate(names) if x == d and stem in n)
        want[d, p] = [float(held[0][2])] if held else None
    assert {(r.doc_id, r.img_path): r.bbox for r in found} == want and len(found) == len(content)

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import index, lookup, retrieval
from docloom.plans import ask, router
from tests.test_views_tools import nodes  # noqa: F401  the fixture


def test_build_write_load_and_ask(spark, nodes, tmp_path):  # noqa: F811
    path = f"{tmp_path}/index"
    index.write_index(nodes, path)
    n = {name: spark.read.parquet(f"{path}/{name}").count() for name in index.build_views(nodes)}
    assert n["dense_coarse"] == 8 and n["table_rows"] == 2 and n["tables"] == 1 and n["figure_spans"] == 8 and n["dense_leaf"] == 1
    catalog = index.load_catalog(spark, path, doc_id="d")
    assert ask.ask("What is the total latency in the table?", catalog)["answer"] == "30"
    assert ask.ask("Where is latency over time?", catalog)["evidence"]
    assert index.load_catalog(spark, path, doc_id="other").sparse.count() == 0
    out = spark.read.parquet(f"{path}/postings").where("field = 'caption'")
    assert "latency" in {r.term for r in out.collect()}


def test_embedding_slot(spark):
    df = spark.createDataFrame([("a", "x y"), ("b", None)], "node_id string, dense_text string")
    rows = index.embed(df, lambda texts: [[float(len(t)), 4.0] for t in texts]).collect()
    assert [round(v, 3) for v in rows[0].embedding] == [0.6, 0.8] and list(rows[1].embedding) == [0.0, 1.0]
    coded = df.where("node_id = 'a'").select(retrieval.hash_encode(F.col("dense_text"), 16).alias("v")).collect()[0].v
    assert len(coded) == 16 and abs(sum(x * x for x in coded) - 1) < 1e-9


def test_pages_by_text(spark):
    df = spark.createDataFrame([("a", 1, "cats and dogs"), ("b", 1, "birds"), ("c", 2, "fish")], "node_id string, page_idx int, text string")
    assert [r.node_id for r in index.bm25_pages(df, "birds").collect()] == ["1"]


def test_small_projections(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).collect()[0].v
    L = F.lit
    assert one(lookup.table_preview(T.strings(["a", "b"]), F.array(T.strings(["1", "2"])))) == "a: 1, b: 2"
    assert one(lookup.list_preview(T.strings([" x ", "", "y", "z"]))) == "x; y"
    assert one(lookup.image_summary(L("c"), L(None).cast("string"))) == "c"
    assert one(lookup.resolve_level(L(None).cast("int"), L("A > B > C"))) == 3 and one(lookup.resolve_level(L("2"), L("A > B"))) == 2
    assert one(lookup.has_keys(F.create_map(L("a"), L(1), L("b"), L(2)), ["a"])) and not one(lookup.has_keys(F.create_map(L("a"), L(1)), ["a", "c"]))
    assert one(T.sanitise_unicode(L("ﬁne​ １２"))) == "fine 12"


def test_aligned_in_order(spark):
    entries = spark.createDataFrame([("d", 0, "Alpha one"), ("d", 1, "Missing"), ("d", 2, "Beta two")], "doc_id string, ord int, title string")
    candidates = spark.createDataFrame([("d", 3, "beta two"), ("d", 5, "alpha one"), ("d", 8, "Beta two!"), ("d", 9, "beta two")], "doc_id string, ord int, text string")
    assert {r.ord: r.match_ord for r in lookup.align_in_order(entries, candidates).collect()} == {0: 5, 1: None, 2: 8}


def test_chapters(spark):
    df = spark.createDataFrame([("d", 0, None, True), ("d", 1, 0, False), ("d", 2, 0, True), ("d", 3, 2, False)], "doc_id string, ord int, chapter int, is_title boolean")
    assert {(r.chapter, r.ord) for r in lookup.chapter_elements(df).collect()} == {(0, 0), (0, 1), (2, 2), (2, 3)}
    assert [r.ord for r in lookup.leaf_chapters(df).collect()] == [2]


def test_images_and_context(spark):
    nodes = spark.createDataFrame([("a", "x/fig.png"), ("b", "none.png")], "node_id string, img_path string")
    files = spark.createDataFrame([("/r/y/fig.png", "fig.png"), ("/r/x/fig.png", "fig.png")], "path string, name string")
    assert {r.node_id: r.path for r in lookup.resolve_images(nodes, files).collect()} == {"a": "/r/x/fig.png", "b": None}
    rois = spark.createDataFrame([("a", 3, "Figure 1", None)], "node_id string, page_idx int, label string, caption string")
    assert lookup.roi_context(rois).collect()[0].context == "page: 3 | label: Figure 1"
    texts = lookup.candidate_texts(nodes, spark.createDataFrame([("a", " ")], "node_id string, text string"), spark.createDataFrame([("a", "second")], "node_id string, text string"))
    assert {r.node_id: r.text for r in texts.collect()} == {"a": "second", "b": None}
    spans = spark.createDataFrame([("a", 2, "figure_legend", "B"), ("a", 1, "figure_legend", "A")], "node_id string, ord int, role string, dense_text string")
    assert tuple(lookup.span_texts(spans, "figure_legend").collect()[0]) == ("a", "A", "A; B")


def test_driver_side_helpers():
    assert router.collect_queries({"query": " a  b ", "queries": ["c"], "keywords": ["k", "l"]}) == ["a b", "c", "k l", "k", "l"]
    d = router.decision_from_json({"signals": {"page_hint": ["3", "x"], "threshold": "1,500%", "comparator": "=", "keywords": " k ", "years": 2014}}, "q")
    assert d.pages == (3,) and d.threshold == 1500 and d.comparator == "==" and d.keywords == ("k",) and d.years == (2014,) and d.query == "q"
    assert "table_index.search" in router.describe(router.plan(router.route("total in the table")))

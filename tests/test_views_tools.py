import pytest
from pyspark.sql import functions as F

from docloom.operators import compute, graph, pack, retrieval, tools, tree, views

NODES = "doc_id string, ord int, node_id string, parent_id string, type string, level int, title string, text string, page_idx int, read_order int, kind string, description string, data string, legend array<string>, axis_labels map<string,string>, ocr_text string"
TABLE = "<table><thead><tr><th>Region</th><th>Latency (ms)</th><th>Year</th></tr></thead><tbody><tr><td>North</td><td>12</td><td>2013</td></tr><tr><td>South</td><td>18</td><td>2014</td></tr></tbody></table>"


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [
        ("d", 0, "sec_0", None, "section", 1, "Introduction", "Introduction", 1, 1, None, None, None, None, None, None),
        ("d", 1, "t_1", "sec_0", "text", None, None, "As Table 1 shows, latency was 12 ms in 2013.", 1, 2, None, None, None, None, None, None),
        ("d", 2, "sec_2", None, "section", 1, "Results", "Results", 2, 3, None, None, None, None, None, None),
        ("d", 3, "tab_3", "sec_2", "table", None, None, None, 2, 4, None, None, TABLE, None, None, None),
        ("d", 4, "cap_4", "tab_3", "caption", None, None, "Table 1: Latency by region", 2, 5, None, None, None, None, None, None),
        ("d", 5, "img_5", "sec_2", "image", None, None, None, 2, 6, "statistical", "A line chart", None, ["Series A", "Series B"], {"x": "Year", "y": "Latency (ms)"}, "2013; 2014"),
        ("d", 6, "cap_6", "img_5", "caption", None, None, "Figure 1: Latency over time", 2, 7, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, NODES).cache()


def test_section_variants(nodes):
    rows = views.section_views(nodes).collect()
    by = {}
    for r in rows:
        by.setdefault(r.base_id, {})[r.variant] = r
    assert set(by["sec_0"]) == {"heading", "gist", "child", "path"}
    assert by["sec_2"]["child"].routes_to_table and not by["sec_0"]["child"].routes_to_table
    assert by["sec_2"]["path"].dense_text == "Results" and by["sec_2"]["heading"].supports_trend
    assert "12 ms" in by["sec_0"]["gist"].dense_text


def test_rollup(nodes):
    r = views.section_rollup(nodes).where("node_id = 'sec_2'").collect()[0]
    assert (r.page_lo, r.page_hi, r.n_tables, r.n_images, r.top_table, r.top_image) == (2, 2, 1, 1, "tab_3", "img_5")
    assert r.child_labels == ["Table 1", "Figure 1"] and r.child_table_schema == ["Region", "Latency (ms)", "Year"] and r.units_set == ["ms"] and r.chart_types == ["statistical"]


def test_summary_nodes_and_maps(nodes):
    rows = {r.node_id: r for r in views.summary_nodes(nodes).collect()}
    assert rows["tab_3"].label == "Table 1" and rows["tab_3"].table_no == "1" and rows["tab_3"].hints[0] == "Table 1"
    assert rows["img_5"].figure_no == "1" and rows["img_5"].parent_title == "Results" and rows["t_1"].role == "paragraph"
    maps = {(r.kind, r.key): r.node_id for r in views.id_maps(views.summary_nodes(nodes)).collect()}
    assert maps["label", "Table 1"] == "tab_3" and maps["figure", "1"] == "img_5"


def test_sparse(nodes):
    rows = {r.node_id: r for r in views.sparse_docs(nodes).collect()}
    assert "Region" in rows["tab_3"].table_schema and rows["tab_3"].labels == "Table 1" and rows["sec_2"].title == "Results"
    assert views.sparse_docs(nodes, compat=True).where("node_id = 'sec_2'").collect()[0].title is None


def test_spans_and_tokens(nodes):
    rows = views.figure_spans(nodes).collect()
    assert {r.role for r in rows} == {"figure_caption", "figure_description", "figure_legend", "axis_label", "figure_ocr"}
    assert [r.years for r in rows if r.role == "figure_ocr"] == [["2013"], ["2014"]]
    tokens = views.span_tokens(views.figure_spans(nodes)).collect()[0].tokens
    assert "latency" in tokens and "line_chart" in tokens


def test_table_rows(spark, nodes):
    from docloom.functions.html import parse_table

    t = nodes.where("type = 'table'").select("doc_id", "node_id", parse_table("data").alias("t")).select("doc_id", "node_id", "t.columns", "t.rows")
    rows = views.table_rows(t).orderBy("row_index").collect()
    assert len(rows) == 2 and rows[0].row_label == "North" and rows[0].cells[1].unit == "ms" and rows[1].cells[2].year == 2014


def test_edges(nodes):
    chunk = nodes.where("type = 'text'").select("doc_id", F.concat("node_id", F.lit("#c0")).alias("node_id"), F.col("text").alias("raw_text"), "page_idx")
    rows = {(r.src, r.dst, r.type) for r in views.edges(nodes, chunk).collect()}
    assert ("t_1#c0", "tab_3", "ref") in rows and ("P1", "t_1#c0", "same_page") in rows and ("sec_2", "tab_3", "child") in rows
    assert ("tab_3", "tab_3:col:Region", "has_col") in rows and ("sec_0", "t_1", "prev_next") in rows and any(t == "has_span" for _, _, t in rows)


def test_heading_index_and_counts(nodes):
    rows = {r.keyword: list(r.sections) for r in views.heading_index(nodes).collect()}
    assert rows["results"] == ["sec_2"] and rows["introduction"] == ["sec_0"]
    n = {r.view: r.n for r in views.view_counts(spans=views.figure_spans(nodes), edges=views.edges(nodes)).collect()}
    assert n["spans"] == 8
    assert {r.node_id: r.children for r in views.heading_children(nodes).collect()}["sec_2"] == ["tab_3", "img_5"]


def test_page_index(nodes):
    assert {r.page for r in views.page_index(nodes.withColumn("logical_page", F.lit("iv"))).where("node_id = 'tab_3'").collect()} == {2, 3, 4}


def test_pack(spark):
    hits = spark.createDataFrame([("sec_1", 0.9, 1), ("sec_2", 0.8, 1)], "node_id string, score double, page_idx int")
    out = pack.mmr_pack(hits, limit=1, per_page=1)
    assert [r.node_id for r in out.collect()] == ["sec_1"] and pack.coverage(out, 1).head()[0] == 1.0


@pytest.mark.parametrize("seed", range(4))
def test_pack_against_greedy(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [(f"n{i:03}", round(rng.random(), 4), rng.choice([None, 1, 2, 3, 4])) for i in range(60)]
    left, chosen, pages = sorted(rows, key=lambda r: (-r[1], r[0])), [], {}
    while left and len(chosen) < 20:
        best = max(left, key=lambda r: (0.72 * r[1] - (0.28 * 0.35 if r[2] is not None and pages.get(r[2]) else 0), r[1], [-ord(c) for c in r[0]]))
        left.remove(best)
        if best[2] is not None and pages.get(best[2], 0) >= 2:
            continue
        pages[best[2]] = pages.get(best[2], 0) + 1
        chosen.append(best[0])
    df = spark.createDataFrame(rows, "node_id string, score double, page_idx int")
    assert [r.node_id for r in pack.mmr_pack(df, limit=20).collect()] == chosen


def test_compute(spark):
    rows = spark.createDataFrame([("tab_1", "a", "10", "%", None, 0), ("tab_2", "b", "5", "%", 2013, 1), ("tab_2", "b", "5", "%", 2013, 2), ("tab_3", "c", "n/a", None, None, 3)], "node_id string, label string, value string, unit string, year int, ord int")
    records = compute.numeric_records(rows)
    r = compute.evaluate(records).collect()[0]
    assert (r.result, r.n_values) == (15.0, 2)
    assert compute.evaluate(records, "avg", scale=2, digits=1).collect()[0].result == 15.0 and compute.evaluate(records, "last").collect()[0].result == 5.0
    assert compute.compare(rows, 6).count() == 1 and compute.compare(rows, 5, "=", unit="%", year=2013).count() == 2 and compute.compare(rows, 5, "!=", unit="ms").count() == 0


@pytest.mark.parametrize("n, want", [(1, [9.0, 9.0]), (2, [9.0, 9.0]), (3, [5.0]), (4, [])])
def test_rank_ties(spark, n, want):
    rows = spark.createDataFrame([("a", 9.0), ("b", 9.0), ("c", 5.0)], "node_id string, value double")
    assert [r.value for r in compute.rank(rows, n).collect()] == want


def test_table_index(spark):
    t = spark.createDataFrame([("tab_a", "Latency", ["Region", "Latency (ms)"], [["North", "12"], ["South", "18"], ["West", "9"]]), ("tab_b", "Other", ["Name", "Colour"], [["x", "red"]])], "node_id string, caption string, columns array<string>, rows array<array<string>>")
    out = tools.table_search(t, columns=["latency", "region"]).collect()
    assert [r.node_id for r in out] == ["tab_a"] and len(out[0].matched) == 3
    assert tools.table_search(t, rows=["south"]).collect()[0].matched[0].row_index == 1
    assert tools.table_search(t, rows=["nowhere"]).count() == 0 and tools.table_search(t, keywords=["north"], unit="kg").count() == 0
    cells = tools.extract_column(t, value_hints=["latency"], allowed=spark.createDataFrame([("tab_a", 1)], "node_id string, row_index int")).where("node_id = 'tab_a'").collect()
    assert [(c.cell_id, c.value, c.label) for c in cells] == [("tab_a:r2c2", 18.0, "South")]


def test_chart_index(spark):
    tokens = spark.createDataFrame([("img_42", ["sales", "growth", "2013", "2014"], 9), ("img_7", ["cost", "2013"], 3)], "node_id string, tokens array<string>, page_idx int")
    assert tools.chart_search(tokens, keywords=["sales"], years=[2013, 2014], pages=[9]).collect()[0].node_id == "img_42"
    assert tools.chart_search(tokens, keywords=["cost"], pages=[77]).collect()[0].node_id == "img_7"


def test_finder_and_screener(spark, nodes):
    table = nodes.select("node_id", F.col("type").alias("role"), "page_idx", F.lit("").alias("label"), F.col("description").alias("caption"))
    rois = tools.find_regions(table, pages=[2])
    spans = views.figure_spans(nodes).select("node_id", "role", "chart_type", "dense_text")
    out = tools.screen_charts(rois, spans).collect()
    assert [r.node_id for r in out] == ["img_5"] and out[0].has_chart and out[0].score == 1.0


def test_bm25f_by_hand(spark):
    import math

    docs = spark.createDataFrame([("a", "cat", "cat dog"), ("b", "", "dog dog bird"), ("c", "bird", "")], "node_id string, title string, body string")
    got = {r.node_id: r.score for r in retrieval.bm25f(docs, "dog cat", weights={"title": 2.0, "body": 1.0}).collect()}

    def part(n, df, tf, length, average):
        return math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))

    assert got["a"] == pytest.approx(2 * part(3, 1, 1, 1, 2 / 3) + part(3, 2, 1, 2, 5 / 3) + part(3, 1, 1, 2, 5 / 3))
    assert got["b"] == pytest.approx(part(3, 2, 2, 3, 5 / 3)) and "c" not in got
    assert retrieval.bm25f(docs, "", weights={"body": 1.0}).count() == 0


def test_rrf_by_hand(spark):
    a = spark.createDataFrame([("x", 0.9), ("y", 0.8)], "node_id string, score double")
    b = spark.createDataFrame([("y", 3.0), ("z", 2.0)], "node_id string, score double")
    got = {r.node_id: r.score for r in retrieval.rrf(a, b).collect()}
    assert got["y"] == pytest.approx(1 / 62 + 1 / 61) and got["x"] == pytest.approx(1 / 61 + 1 / 1000060)


def test_labels_pages_interaction(spark):
    labels = spark.createDataFrame([("Figure 3", "img_3"), ("Table 2", "tab_2")], "label string, node_id string")
    assert retrieval.lookup_label(labels, "fig. 3").collect()[0].node_id == "img_3" and retrieval.lookup_label(labels, "table 9").count() == 0
    nodes = spark.createDataFrame([("a", 1), ("b", 4), ("c", 4)], "node_id string, page_idx int")
    got = {(r.page, r.node_id, r.score) for r in retrieval.nearest_page(nodes, spark.createDataFrame([(3,), (1,)], "page int")).collect()}
    assert got == {(3, "b", 1.0), (3, "c", 0.9), (1, "a", 1.0)}
    pages = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]]), (2, [[0.5, 0.5]])], "page int, vectors array<array<double>>")
    assert [(r.node_id, r.score) for r in retrieval.late_interaction(pages, [[1.0, 0.0], [0.0, 1.0]]).collect()] == [(1, 2.0), (2, 1.0)]
    assert retrieval.hash_encode(F.lit("a b")) is not None


def test_graph(spark):
    edges = spark.createDataFrame([("s", "a", "child"), ("s", "b", "child"), ("P1", "a", "same_page"), ("P1", "c", "same_page")], "src string, dst string, type string")
    got = {(r.node_id, r.relation) for r in graph.neighbours(edges, spark.createDataFrame([("a",)], "node_id string")).collect()}
    assert got == {("s", "parent"), ("b", "sibling"), ("c", "same_page")}
    kids = graph.children_hits(edges, spark.createDataFrame([("s",)], "node_id string")).collect()
    assert {r.node_id for r in kids} == {"a", "b"} and {r.score for r in kids} == {0.7}


def test_regex_places(spark):
    rows = tools.extract_regex(spark.createDataFrame([("a", "x AB y ab"), ("b", None)], "node_id string, text string"), "ab").collect()
    assert [(r.match, r.start, r.end) for r in rows] == [("AB", 2, 4), ("ab", 7, 9)]


def test_html_pages_as_items(spark):
    from docloom.sources.io import page_items

    html = "<html><nav><li>menu</li></nav><article><h1>Title</h1><p>One<br>two</p><ul><li>x</li></ul></article><footer><p>f</p></footer></html>"
    rows = page_items(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("ord").collect()
    assert [(r.text, r.text_level) for r in rows] == [("Title", 1), ("One two", None), ("x", None)]
    assert tree.build_tree(page_items(spark.createDataFrame([(1, html)], "page_id long, html string"))).count() == 3

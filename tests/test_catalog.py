"""Indexes of several documents whose node ids are the same: every tool keeps documents apart."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import index
from docloom.operators.keys import key
from docloom.plans import ask, ir
from docloom.plans.executor import Context, Executor, execute_policy
from tests.test_views_tools import nodes  # noqa: F401  the fixture

DOCS = ("a", "b", "c")


@pytest.fixture(scope="module")
def many(spark, nodes, tmp_path_factory):  # noqa: F811
    """Three copies of one tree; the second has no word 'latency', the third ends after its first page."""
    wanted = ("summary", "sparse_coarse", "lists", "list_stats", "dense", "dense_leaf", "tables", "figure_tokens", "figure_terms", "figure_spans", "edges", "heading_children", "page_index", "id_maps")
    path = str(tmp_path_factory.mktemp("many") / "index")
    a = nodes.withColumn("doc_id", F.lit("a"))
    plain = [c for c, t in nodes.dtypes if t == "string" and c not in ("doc_id", "node_id", "parent_id", "type")]
    b = nodes.withColumn("doc_id", F.lit("b")).withColumns({c: F.regexp_replace(c, "(?i)latency", "duration") for c in plain})
    c = nodes.withColumn("doc_id", F.lit("c")).where("page_idx = 1")
    index.write_index(a.unionByName(b).unionByName(c), path, buckets=4, views=wanted)
    return path


HITS = {"source": "hits"}
TOOLS = {
    "table_index.search": {"columns": ("ms",), "keywords": ("latency", "table")},
    "chart_index.search": {"keywords": ("latency", "time"), "pages": (0, 1, 2)},
    "toc_anchor.locate": {"keywords": ("results", "method", "intro")},
    "page_locator.locate": {"pages": [1, 2]},
    "figure_finder.find_regions": {"kinds": ("image", "table"), "source": "hits"},
    "chart_screener.screen": {**HITS, "only_positive": False},
    "structure.expand": {**HITS, "include_self": True},
    "structure.children": HITS,
    "extract.column": HITS,
    "extract.chart_read_axis": HITS,
    "extract.regex": {**HITS, "pattern": r"[a-z]+"},
    "pack.mmr_knapsack": {**HITS, "limit": 1000, "per_page_limit": 2},
    "dense_node.search": {"query": "latency over time", "k": 1000},
}


def rows(df):
    return sorted((str({c: getattr(r, c) for c in sorted(df.columns)}) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def contexts(spark, many):
    """The whole index (None) and each of its documents, with all nodes as hits."""
    out = {}
    for doc_id in (None, *DOCS):
        catalog = index.load_catalog(spark, many, doc_id=doc_id)
        out[doc_id] = Context(catalog, {"hits": catalog.nodes.select("doc_id", "node_id", F.lit(1.0).alias("score"), F.col("caption"))})
    return out


@pytest.mark.parametrize("tool", sorted(set(TOOLS) - {"chart_index.search"}))
def test_whole_index_gives_every_document_its_own_hits(contexts, tool):
    """Tools whose scores do not depend on the rest of the corpus: the whole index is the union of its documents."""
    run = lambda doc_id: Executor(retries=0).run(contexts[doc_id], ir.Node(tool, TOOLS[tool], "out"))
    whole, single = run(None), [run(d) for d in DOCS]
    assert all(o.status == "ok" for o in [whole, *single]), whole.error
    assert key(whole.rows) == ["doc_id", "node_id"]
    assert rows(whole.rows) == sorted(r for o in single for r in rows(o.rows)) and rows(whole.rows)


@pytest.mark.parametrize("tool", ["bm25_node.search", "hybrid.search", "chart_index.search"])
def test_searches_with_statistics_of_the_index(contexts, tool):
    args = TOOLS.get(tool) or {"query": "latency over time", "k": 100}
    out = Executor(retries=0).run(contexts[None], ir.Node(tool, args, "out"))
    assert out.status == "ok", out.error
    found = [(r.doc_id, r.node_id) for r in out.rows.collect()]
    assert len(found) == len(set(found)) and {d for d, _ in found} >= {"a"}
    if tool == "bm25_node.search":
        top = {(r.doc_id, r.node_id): r.score for r in out.rows.collect()}
        same = [n for d, n in top if d == "a" and ("c", n) in top]
        assert same and len({d for d, _ in found}) >= 2


def test_equal_nodes_are_not_one(contexts):
    """Two documents with the same title under the same id: two hits, each with its own score."""
    both = [r for r in Executor().run(contexts[None], ir.Node("toc_anchor.locate", {"keywords": ()}, "out")).rows.collect() if r.node_id == "sec_0"]
    assert sorted(r.doc_id for r in both) == ["a", "b", "c"]


def test_ids_alone_mean_the_nodes_of_every_document(contexts):
    out = Executor(retries=0).run(contexts[None], ir.Node("structure.expand", {"node_ids": ["sec_0"], "include_self": True}, "out")).rows
    assert {r.doc_id for r in out.where("node_id = 'sec_0'").collect()} == set(DOCS)


def test_policies_and_questions(contexts):
    catalog = contexts[None].catalog
    label = catalog.labels.head()
    found = execute_policy({"strategy": "direct_label", "labels": [label.label], "k": 5}, catalog).collect()
    assert {(r.doc_id, r.node_id) for r in found} == {(r.doc_id, r.node_id) for r in catalog.labels.where(F.col("label") == label.label).collect()}
    for policy in ({"strategy": "direct_page", "pages": [1]}, {"strategy": "sparse", "query": "latency"}, {"strategy": "dense", "query": "latency"}, {"strategy": "heading", "keywords": ["intro"]}, {"strategy": "hybrid", "query": "latency"}):
        assert execute_policy({"k": 50, **policy}, catalog).columns == ["doc_id", "node_id", "score"]
    memory = ask.Memory()
    said = ask.ask("Where is latency over time?", catalog, memory=memory)
    assert said["evidence"] and all("/" in e for e in said["evidence"]) and all(len(v) == 2 for v in memory.visited)


def test_layout_prunes_and_joins_without_exchange(spark, contexts):
    """One document reads one bucket of four; views meet on their keys without a shuffle."""
    one = contexts["b"].catalog
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # or plans without joins do not say what they skip
    assert "SelectedBucketsCount: 1 out of 4" in one.nodes.select("node_id")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    whole = contexts[None].catalog
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = whole.nodes.join(whole.evidence, ["doc_id", "node_id"]).join(whole.figure_spans, ["doc_id", "node_id"], "left")
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
        assert plan.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_views_that_were_not_written_are_absent(spark, nodes, tmp_path):  # noqa: F811
    path = f"{tmp_path}/part"
    index.write_index(nodes, path, views=("summary",), buckets=2)
    index.write_index(nodes, path, views=("summary",), buckets=2)  # a rerun replaces it
    catalog = index.load_catalog(spark, path)
    assert catalog.dense is None and catalog.lists is None and catalog.texts.count() == catalog.nodes.count() > 0

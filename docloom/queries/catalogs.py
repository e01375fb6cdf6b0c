"""Whole-index searches over the trees of all documents, whose node ids are numbered inside each document."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import index, retrieval
from docloom.plans import ir
from docloom.plans.executor import Catalog, Context, Executor, execute_policy
from docloom.queries.base import Family
from docloom.queries.retrieval import QUERY, _bm25f_sql
from docloom.queries.tree import TREE_SQL
from docloom.queries.views import nodes
from docloom.session import new_path

FAMILY = Family()


def _catalog(spark, sf_dir, *views: str) -> Catalog:
    path = new_path(spark, "index")
    index.write_index(nodes(spark, sf_dir), path, views=views, buckets=8)
    return index.load_catalog(spark, path)


def _run(catalog: Catalog, *steps: ir.Node):
    """The rows of the last of some steps."""
    ctx, executor = Context(catalog), Executor(retries=0)
    for step in steps:
        out = executor.run(ctx, step)
        if out.error:
            raise RuntimeError(out.error)
    return out.rows


@FAMILY.add(
    f"""WITH {TREE_SQL} SELECT DISTINCT n.doc_id, n.node_id, 0.7::DOUBLE AS score FROM nodes n JOIN nodes s ON s.doc_id = n.doc_id AND s.node_id = n.parent_id
WHERE n.type = 'image' AND contains(lower(s.title), 'and')"""
)
def catalog_headings_children(spark, sf_dir):
    """Of every document: the images under headings that have the letters of a keyword."""
    catalog = _catalog(spark, sf_dir, "summary", "edges")
    return _run(catalog, ir.Node("toc_anchor.locate", {"keywords": ("and",)}, "heads"), ir.Node("structure.children", {}, "kids", ("heads",))).select("doc_id", "node_id", "score")


@FAMILY.add(
    f"""WITH {TREE_SQL}, hits AS (SELECT doc_id, node_id, page_idx FROM nodes WHERE type = 'section' AND page_idx IN (2, 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY node_id) AS place FROM hits)
SELECT doc_id, node_id, page_idx::BIGINT AS page_idx, round(CASE WHEN place = 1 THEN 0.72 ELSE 0.72 - 0.28 * 0.35 END, 9)::DOUBLE AS key FROM placed WHERE place <= 2 ORDER BY key DESC, doc_id, node_id LIMIT 500"""
)
def catalog_page_regions(spark, sf_dir):
    """The first 500 sections on the pages that page 3 may mean in any document, at most two a page, the second with a penalty."""
    catalog = _catalog(spark, sf_dir, "summary", "page_index")
    steps = (
        ir.Node("page_locator.locate", {"pages": [3]}, "page"),
        ir.Node("figure_finder.find_regions", {"kinds": ("section",)}, "regions", ("page",)),
        ir.Node("pack.mmr_knapsack", {"limit": 500, "per_page_limit": 2}, "packed", ("regions",)),
    )
    return _run(catalog, *steps).select("doc_id", "node_id", F.col("page_idx").cast("long").alias("page_idx"), F.round("key", 9).alias("key"))


@FAMILY.add(
    f"""WITH {TREE_SQL}, dn AS (SELECT doc_id || '/' || node_id AS node_id, type AS role, coalesce(title, '') AS title, coalesce(text, '') AS body FROM nodes), {_bm25f_sql(200, {'title': 2.0, 'body': 1.0}, source='dn')}
SELECT split_part(node_id, '/', 1) AS doc_id, split_part(node_id, '/', 2) AS node_id, round(score, 6) AS score FROM bm25f WHERE score > 0"""
)
def catalog_sparse_search(spark, sf_dir):
    """The best nodes of all trees by BM25F over the index's posting lists."""
    rows = nodes(spark, sf_dir).select("doc_id", "node_id", F.col("type").alias("role"), "title", F.col("text").alias("body"))
    lists, stats = retrieval.posting_lists(rows, ["title", "body"])
    found = execute_policy({"strategy": "sparse", "query": QUERY, "k": 200}, Catalog(lists=lists, list_stats=stats))
    return found.select("doc_id", "node_id", F.round("score", 6).alias("score"))

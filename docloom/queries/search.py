"""Queries of written indexes: posting lists, fused search, whole query tables, policies and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import pack, retrieval, tools
from docloom.plans import ir
from docloom.plans.executor import Catalog, execute_policy, run_plan
from docloom.queries.base import Family, table
from docloom.queries.retrieval import _DENSE_SQL, _DOCS_SQL, _VECTOR, QUERY, _bm25f_sql, _docs, _vectors
from docloom.queries.views import TABLES_SQL, tables

FAMILY = Family()
_TWO = {"title": 2.0, "body": 1.0}


def _lists(spark, sf_dir):
    return retrieval.posting_lists(_docs(spark, sf_dir), ["title", "body"])


@FAMILY.add(f"WITH {_DOCS_SQL}, {_bm25f_sql(200, _TWO)} SELECT node_id, role, round(score, 6) AS score FROM bm25f WHERE score > 0")
def index_bm25f(spark, sf_dir):
    """The same search as by scan, from posting lists."""
    return retrieval.bm25f_lists(*_lists(spark, sf_dir), QUERY, weights=_TWO, k=200).select("node_id", "role", F.round("score", 6).alias("score"))


@FAMILY.add(
    r"""
WITH tok AS (SELECT doc_id, field, unnest(regexp_extract_all(lower(v), '[a-z0-9%.\-]+')) AS term FROM (SELECT doc_id, 'title' AS field, source AS v FROM documents UNION ALL SELECT doc_id, 'body', text FROM documents)),
tf AS (SELECT doc_id, field, term, count(*) AS tf, FROM tok GROUP BY ALL), len AS (SELECT doc_id, field, count(*) AS n FROM tok GROUP BY ALL),
st AS (SELECT 'title' AS field, 2.0::DOUBLE AS w, (SELECT count(*) FROM documents) AS n_docs, (SELECT count(*) FROM tok WHERE field = 'title') / (SELECT count(*) FROM documents) AS avg_len
       UNION ALL SELECT 'body', 1.0, (SELECT count(*) FROM documents), (SELECT count(*) FROM tok WHERE field = 'body') / (SELECT count(*) FROM documents)),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
q AS (SELECT doc_id AS query_id, term, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9%.\-]+')) AS term FROM documents WHERE doc_id % 100 = 0) GROUP BY ALL),
s AS (SELECT query_id, tf.doc_id, sum(times * w * ln((n_docs - df + 0.5) / (df + 0.5) + 1.0) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * n / avg_len))) AS score
      FROM q JOIN tf USING (term) JOIN df USING (field, term) JOIN st USING (field) JOIN len ON len.doc_id = tf.doc_id AND len.field = tf.field GROUP BY ALL)
SELECT query_id, 'd' || doc_id AS node_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, 'd' || doc_id) AS place FROM s) WHERE place <= 20"""
)
def bm25f_search_all(spark, sf_dir):
    """Top 20 documents by BM25F for the whole text of every document whose id is divisible by 100."""
    asked = table(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return retrieval.bm25f_all(_docs(spark, sf_dir), asked, weights=_TWO, k=20).select("query_id", "node_id", F.round("score", 6).alias("score"))


@FAMILY.add(
    f"""WITH {_DOCS_SQL}, {_bm25f_sql(100, _TWO)}, {_DENSE_SQL},
l AS (SELECT node_id, row_number() OVER (ORDER BY score DESC, node_id) AS b FROM bm25f WHERE score > 0),
v2 AS (SELECT 'd' || substr(node_id, 2) AS node_id, score FROM (SELECT * FROM sims ORDER BY score DESC, node_id LIMIT 100)),
a AS (SELECT node_id, row_number() OVER (ORDER BY score DESC, node_id) AS a FROM v2),
f AS (SELECT node_id, 1.0::DOUBLE / (60 + coalesce(a, 1000000)) + 1.0::DOUBLE / (60 + coalesce(b, 1000000)) AS score FROM a FULL JOIN l USING (node_id))
SELECT node_id, round(score, 9) AS score FROM f ORDER BY f.score DESC, node_id LIMIT 20"""
)
def index_hybrid_search(spark, sf_dir):
    """Vectors and posting lists of a catalog, fused by rank."""
    lists, stats = _lists(spark, sf_dir)
    vectors = _vectors(spark, sf_dir).withColumn("node_id", F.concat(F.lit("d"), F.substring("node_id", 2, 20)))
    catalog = Catalog(dense=vectors, lists=lists.withColumn("field", F.col("field")), list_stats=stats, encode=lambda query: _VECTOR)
    return execute_policy({"strategy": "hybrid", "k": 20, "query": QUERY}, catalog).select("node_id", F.round("score", 9).alias("score"))


@FAMILY.add("SELECT 'c' || c_custkey AS node_id, 1.0::DOUBLE AS score FROM customer WHERE 'Figure ' || c_custkey = 'Figure 12'")
def policy_label(spark, sf_dir):
    """A policy that goes straight to a label, spelt in another way."""
    labels = table(spark, sf_dir, "customer").select(F.concat(F.lit("Figure "), "c_custkey").alias("label"), F.concat(F.lit("c"), "c_custkey").alias("node_id"))
    return execute_policy({"strategy": "direct_label", "labels": ["fig.  12"], "k": 5}, Catalog(labels=labels))


@FAMILY.add("SELECT node_id, max(score) AS score FROM (SELECT 'c' || o_custkey AS node_id, (o_orderkey % 100) / 100.0::DOUBLE AS score FROM orders UNION ALL SELECT 'c' || c_custkey, (c_custkey % 50) / 50.0::DOUBLE FROM customer) GROUP BY node_id")
def search_best_per_node(spark, sf_dir):
    """The best hit of each node over two lists."""
    a = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("node_id"), ((F.col("o_orderkey") % 100) / 100.0).cast("double").alias("score"))
    b = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node_id"), ((F.col("c_custkey") % 50) / 50.0).cast("double").alias("score"))
    return retrieval.best_per_node(a.unionByName(b)).select("node_id", "score")


@FAMILY.add(
    """WITH p AS (SELECT vec_id // 4 AS page, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IN (1, 5, 9)),
m AS (SELECT page, q.vec_id, max(list_dot_product(p.e, q.e)) AS best FROM p, q GROUP BY ALL)
SELECT page::VARCHAR AS page, round(score, 5) AS score FROM (SELECT page, sum(best) AS score FROM m GROUP BY page ORDER BY score DESC, page::VARCHAR LIMIT 10)"""
)
def late_interaction_pages(spark, sf_dir):
    """Pages of four vectors each by late interaction with three query vectors."""
    v = table(spark, sf_dir, "embeddings")
    pages = v.groupBy(F.floor(F.col("vec_id") / 4).cast("string").alias("page")).agg(F.collect_list(F.col("embedding").cast("array<double>")).alias("vectors"))
    asked = [[float(x) for x in r.embedding] for r in v.where("vec_id IN (1, 5, 9)").orderBy("vec_id").collect()]  # three rows
    return retrieval.late_interaction(pages, asked, k=10).select(F.col("node_id").alias("page"), F.round("score", 5).alias("score"))


@FAMILY.add("SELECT least(1.0, count(DISTINCT o_custkey) / 400.0)::DOUBLE AS coverage FROM orders WHERE o_orderkey % 7 = 0")
def search_coverage(spark, sf_dir):
    """How much of the wanted number of nodes the hits cover."""
    hits = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.col("o_custkey").cast("string").alias("node_id"))
    return pack.coverage(hits, 400)


@FAMILY.add(
    f"""WITH {TABLES_SQL}, r AS (SELECT node_id, unnest(rows_) AS row_ FROM tabs)
SELECT count(*) AS n_values, round(max(replace(row_[4], '%', '')::DOUBLE), 2) AS result FROM (SELECT DISTINCT node_id, row_[1], row_[4] FROM r) q(node_id, label, v), LATERAL (SELECT ['', '', '', v] AS row_)"""
)
def plan_with_fallback(spark, sf_dir):
    """A plan whose first stage fails, so that its second stage answers: the largest share of all tables."""
    steps = (
        ir.Node("table_index.search", {"columns": ("share",)}, "found"),
        ir.Node("extract.column", {"value_hints": ("share",)}, "cells", ("found",)),
        ir.Node("compute.eval", {"operation": "max", "round": 2}, "top", ("cells",)),
    )
    broken = ir.Stage("figures", "graphics", (ir.Node("chart_index.search", {"keywords": ("share",)}, "charts"),))
    plan = ir.validate(ir.Plan((broken, ir.Stage("table", "table", steps, "prev_coverage < 0.5"))))
    rows, _ = run_plan(plan, Catalog(tables=tables(spark, sf_dir)))
    return rows.select("n_values", "result")


@FAMILY.add("SELECT node_id, score, modality, content FROM (SELECT 'c' || c_custkey AS node_id, (c_custkey % 97)::DOUBLE AS score, CASE WHEN c_custkey % 2 = 0 THEN 'table' ELSE 'text' END AS modality, c_name AS content FROM customer WHERE c_custkey % 5 <> 0 ORDER BY score DESC, node_id LIMIT 6)")
def observe_unseen(spark, sf_dir):
    """Evidence of the best hits that were not visited."""
    c = table(spark, sf_dir, "customer").withColumn("node_id", F.concat(F.lit("c"), "c_custkey"))
    evidence = c.select("node_id", F.when(F.col("c_custkey") % 2 == 0, "table").otherwise("text").alias("modality"), F.col("c_name").alias("content"))
    return tools.observe(c.select("node_id", (F.col("c_custkey") % 97).cast("double").alias("score")), evidence, c.where("c_custkey % 5 = 0").select("node_id"))


@FAMILY.add("""SELECT '[' || string_agg('{"node_id":"c' || c_custkey || '","modality":"text","content":"' || substr(c_name, 1, 12) || '"}', ',' ORDER BY c_custkey % 97 DESC, 'c' || c_custkey) || ']' AS context FROM customer WHERE c_custkey <= 40""")
def context_of_observations(spark, sf_dir):
    """Observations as one JSON text, best first."""
    c = table(spark, sf_dir, "customer").where("c_custkey <= 40")
    rows = c.select(F.concat(F.lit("c"), "c_custkey").alias("node_id"), (F.col("c_custkey") % 97).cast("double").alias("score"), F.lit("text").alias("modality"), F.col("c_name").alias("content"))
    return tools.pack_context(rows, chars=12)


@FAMILY.add("SELECT 'i' || p_partkey AS node_id FROM part WHERE p_partkey % 50 IN (7, 6) OR p_size::VARCHAR = '7'")
def images_on_pages(spark, sf_dir):
    """Images on a page by its index, its number from one, or its logical number, when none is named."""
    images = table(spark, sf_dir, "part").select(F.concat(F.lit("i"), "p_partkey").alias("node_id"), F.concat(F.lit("Figure "), "p_partkey").alias("label"), (F.col("p_partkey") % 50).cast("int").alias("page_idx"), F.col("p_size").cast("string").alias("logical_page"))
    return tools.match_label_or_pages(images, labels=["Figure none"], pages=[7])


@FAMILY.add("SELECT o_custkey AS doc_id, min(o_orderkey % 13) AS page_idx FROM orders GROUP BY o_custkey HAVING min(o_orderkey % 13) = 0")
def sample_first_pages(spark, sf_dir):
    """A sample of one page a document is its page 0, where it has one."""
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 13).alias("page_idx")).distinct()
    return tools.sample_pages(pages, 1, seed=3).where("page_idx = 0").select("doc_id", "page_idx")


@FAMILY.add(
    """WITH e AS (SELECT 's' || c_nationkey AS src, 'c' || c_custkey AS dst FROM customer), seeds AS (SELECT 'c' || c_custkey AS node_id FROM customer WHERE c_custkey % 100 = 0),
par AS (SELECT DISTINCT src FROM e JOIN seeds ON dst = node_id)
SELECT DISTINCT node_id, 0.6::DOUBLE AS score FROM (SELECT src AS node_id FROM par UNION ALL SELECT dst FROM e JOIN par USING (src) WHERE dst NOT IN (SELECT node_id FROM seeds) UNION ALL SELECT e2.dst FROM seeds s JOIN e e1 ON e1.dst = s.node_id JOIN e e2 ON e2.src = e1.src WHERE e2.dst <> s.node_id)"""
)
def expand_hits_around(spark, sf_dir):
    """Neighbours of seeds as hits: parents and siblings."""
    from docloom.operators import graph

    c = table(spark, sf_dir, "customer")
    edges = c.select(F.concat(F.lit("s"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"), F.lit("child").alias("type"))
    none = spark.createDataFrame([], "node_id string, child string")
    return graph.expand_hits(edges, none, c.where("c_custkey % 100 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("node_id")))


@FAMILY.add("SELECT 'c' || c_custkey AS node_id, 0.7::DOUBLE AS score FROM customer WHERE c_nationkey IN (3, 4) AND c_custkey % 2 = 0")
def children_of_hits(spark, sf_dir):
    """Children of seeds of one role."""
    from docloom.operators import graph

    c = table(spark, sf_dir, "customer").withColumn("node_id", F.concat(F.lit("c"), "c_custkey"))
    edges = c.select(F.concat(F.lit("s"), "c_nationkey").alias("src"), F.col("node_id").alias("dst"), F.lit("child").alias("type"))
    seeds = spark.createDataFrame([("s3",), ("s4",)], "node_id string")
    return graph.children_hits(edges, seeds, role="even", roles=c.select("node_id", F.when(F.col("c_custkey") % 2 == 0, "even").otherwise("odd").alias("role")))

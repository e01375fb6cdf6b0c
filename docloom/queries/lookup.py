"""Queries of lookups, outlines and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import lookup, structure
from docloom.queries.base import Family, table
from docloom.queries.tree import ITEMS_SQL, items

FAMILY = Family()


@FAMILY.add("SELECT 'p' || p_partkey AS node_id FROM part WHERE p_type = 'SMALL' AND contains(lower(p_name), 'ring') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def lookup_filter_nodes(spark, sf_dir):
    """Nodes by role, attributes and scope."""
    nodes = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node_id"), F.lit("table").alias("role"), "p_type", "p_name")
    scope = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.concat(F.lit("p"), "l_partkey").alias("node_id"))
    return lookup.filter_nodes(nodes, role="table", filters=[{"field": "p_type", "value": "SMALL"}, {"field": "p_name", "op": "contains", "value": "Ring"}], scope=scope).select("node_id")


@FAMILY.add("SELECT c_custkey::VARCHAR AS node_id, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 2 = 0 THEN c_name END) AS value FROM customer")
def lookup_attribute(spark, sf_dir):
    """An attribute from two views by priority."""
    c = table(spark, sf_dir, "customer").withColumn("node_id", F.col("c_custkey").cast("string"))
    return lookup.attribute(c, c.where("c_custkey % 3 = 0").select("node_id", F.col("c_mktsegment").alias("a")), c.where("c_custkey % 2 = 0").select("node_id", F.col("c_name").alias("a")), "a")


@FAMILY.add("SELECT coalesce(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 17 END, o_custkey % 10)::BIGINT AS page, count(*) AS n FROM orders GROUP BY ALL")
def lookup_hit_pages(spark, sf_dir):
    """Pages of hits by provenance, else by node."""
    k = F.col("o_orderkey")
    hits = table(spark, sf_dir, "orders").select(F.concat(F.lit("n"), "o_custkey").alias("node_id"), F.when(k % 4 == 0, F.create_map(F.lit("page_idx"), (k % 17).cast("string"))).alias("provenance"))
    nodes = table(spark, sf_dir, "orders").select(F.concat(F.lit("n"), "o_custkey").alias("node_id"), (F.col("o_custkey") % 10).cast("int").alias("page_idx")).distinct()
    return lookup.pages_of_hits(hits, nodes).select(F.col("page").cast("long").alias("page"), "n")


@FAMILY.add(f"WITH {ITEMS_SQL} SELECT doc_id, string_agg(repeat('  ', (text_level - 1)::INT) || '- L' || text_level || ' idx=' || ord || ': ' || trim(regexp_replace(text, '\\s+', ' ', 'g')), chr(10) ORDER BY ord) AS outline FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS r FROM items WHERE text_level IS NOT NULL) WHERE r <= 200 GROUP BY doc_id")
def lookup_outline(spark, sf_dir):
    """Outlines of documents."""
    heads = items(spark, sf_dir).where("text_level IS NOT NULL").withColumnRenamed("text_level", "level").withColumn("logical_page", F.lit(None).cast("string"))
    return lookup.outline(heads)


@FAMILY.add(f"WITH {ITEMS_SQL}, e AS (SELECT doc_id, bool_or(ord % 2 = 1 AND length(text) % 5 = 0) AS paged FROM items WHERE doc_id::BIGINT % 3 > 0 GROUP BY doc_id) SELECT d.doc_id, CASE WHEN paged THEN 1 WHEN paged IS NOT NULL THEN 2 ELSE 3 END AS toc_case FROM (SELECT DISTINCT doc_id FROM items) d LEFT JOIN e USING (doc_id)")
def lookup_toc_case(spark, sf_dir):
    """Which kind of contents a document has."""
    rows = items(spark, sf_dir)
    entries = rows.where(F.col("doc_id").cast("long") % 3 > 0).withColumn("page", F.when((F.col("ord") % 2 == 1) & (F.length("text") % 5 == 0), F.col("ord")))
    return lookup.toc_case(entries, rows)


@FAMILY.add(f"WITH {ITEMS_SQL}, ins AS (SELECT doc_id, min(ord) AS ord, page_idx, 'Inserted' AS text FROM items WHERE page_idx = 1 GROUP BY doc_id, page_idx), u AS (SELECT doc_id, ord, 1 AS layer, text FROM items UNION ALL SELECT doc_id, ord, 0, text FROM ins) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord, layer) - 1 AS node_idx, text FROM u")
def lookup_insert_headings(spark, sf_dir):
    """A heading put at the start of page 1."""
    rows = items(spark, sf_dir).withColumnRenamed("text_level", "level")
    missing = rows.select("doc_id").distinct().select("doc_id", F.lit(1).alias("page_idx"), F.lit(2).alias("level"), F.lit("Inserted").alias("title"))
    return lookup.insert_headings(rows, missing).select("doc_id", F.col("node_idx").cast("long").alias("node_idx"), "text")


@FAMILY.add("SELECT o_custkey, string_agg(o_orderpriority, chr(10) ORDER BY o_orderkey) AS answer, round(avg(o_orderkey % 10), 6) AS confidence FROM orders GROUP BY o_custkey")
def lookup_combine_answers(spark, sf_dir):
    """Answers of several calls as one for each customer."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("answer"), (F.col("o_orderkey") % 10).alias("confidence"), F.lit(None).cast("string").alias("thinking"))
    return lookup.combine_answers(rows, "o_custkey").select("o_custkey", "answer", F.round("confidence", 6).alias("confidence"))


@FAMILY.add(f"WITH {ITEMS_SQL} SELECT doc_id, count(DISTINCT ord) AS n_media FROM items WHERE type = 'image' AND EXISTS (SELECT 1 FROM items t WHERE t.doc_id = items.doc_id AND t.page_idx = items.page_idx AND t.type = 'text') GROUP BY doc_id")
def lookup_caption_statistics(spark, sf_dir):
    """Media that have texts near them."""
    near = structure.media_neighbours(items(spark, sf_dir), k=20)
    return lookup.caption_statistics(near.withColumn("role", F.lit("caption"))).select("doc_id", "n_media")


@FAMILY.add("SELECT s_suppkey, substr(regexp_replace(s_name || chr(10) || ' x ' || chr(10) || s_name, '\\s*\\n\\s*', ' ', 'g'), 1, 15) AS text FROM supplier")
def lookup_page_text(spark, sf_dir):
    """Page texts on one line."""
    return lookup.page_text(table(spark, sf_dir, "supplier").select("s_suppkey", F.concat("s_name", F.lit("\n x \n"), "s_name").alias("text")), most=15)


@FAMILY.add(
    rf"""WITH RECURSIVE {ITEMS_SQL},
w AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM items),
e AS (SELECT doc_id, ord, w, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM w WHERE text_level = 1),
c AS (SELECT doc_id, list({{'ord': ord, 'w': w}} ORDER BY ord) AS c FROM w WHERE type = 'text' GROUP BY doc_id),
f AS (SELECT doc_id, 0::BIGINT AS k, 0::BIGINT AS pos, NULL::BIGINT AS ord, NULL::BIGINT AS match_ord FROM (SELECT DISTINCT doc_id FROM e)
  UNION ALL SELECT doc_id, k, CASE WHEN best.s >= 0.5 THEN best.i ELSE pos END, ord, CASE WHEN best.s >= 0.5 THEN c[best.i].ord END
  FROM (SELECT f.doc_id, e.k, f.pos, e.ord, c.c, list_reduce(list_transform(range(f.pos + 1, least(f.pos + 20, len(c.c)) + 1), lambda i: {{'s': coalesce(len(list_intersect(c.c[i].w, e.w)) / nullif(len(list_distinct(list_concat(c.c[i].w, e.w))), 0), 0), 'i': i}}), lambda a, b: CASE WHEN b.s > a.s THEN b ELSE a END, {{'s': -1.0::DOUBLE, 'i': 0::BIGINT}}) AS best
        FROM f JOIN e ON e.doc_id = f.doc_id AND e.k = f.k + 1 JOIN c ON c.doc_id = f.doc_id))
SELECT doc_id, ord, match_ord FROM f WHERE k > 0"""
)
def lookup_align_in_order(spark, sf_dir):
    """Contents entries aligned with the texts of every document, in order."""
    rows = items(spark, sf_dir)
    entries = rows.where("text_level = 1").select("doc_id", "ord", F.col("text").alias("title"))
    found = lookup.align_in_order(entries, rows.where("type = 'text'").select("doc_id", "ord", "text"))
    return found.select("doc_id", F.col("ord").cast("long").alias("ord"), "match_ord")


@FAMILY.add("WITH w AS (SELECT l_orderkey AS doc_id, 'n' || l_linenumber AS node_id, min(l_partkey) AS ord FROM lineitem WHERE l_quantity > 40 GROUP BY ALL), b AS (SELECT DISTINCT l_orderkey AS doc_id, 'n' || l_linenumber AS node_id FROM lineitem) SELECT b.doc_id, b.node_id, ord FROM b JOIN w USING (doc_id, node_id)")
def lookup_blocks_by_id(spark, sf_dir):
    """Blocks by id inside each document, with the first place that asks for them."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("n"), "l_linenumber").alias("node_id"), F.col("l_partkey").alias("ord"), "l_quantity")
    return lookup.blocks_by_id(rows.select("doc_id", "node_id").distinct(), rows.where("l_quantity > 40")).select("doc_id", "node_id", "ord")


@FAMILY.add(
    """WITH h AS (SELECT o_custkey AS doc_id, (o_orderkey % 13)::INT AS page_idx, max(o_totalprice)::DOUBLE AS score FROM orders GROUP BY ALL)
SELECT doc_id, page_idx, round(score, 2) AS score FROM h WHERE (doc_id + page_idx) % 3 > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page_idx) <= 2"""
)
def lookup_allowed_top(spark, sf_dir):
    """The best two pages of each document among those that are allowed."""
    hits = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 13).cast("int").alias("page_idx")).agg(F.max("o_totalprice").cast("double").alias("score"))
    allowed = hits.where((F.col("doc_id") + F.col("page_idx")) % 3 > 0)
    return lookup.allowed_top(hits, allowed.select("doc_id", "page_idx"), 2).select("doc_id", "page_idx", F.round("score", 2).alias("score"))

"""Queries of items and trees, over web pages as documents and a synthetic outline of documents' lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import structure, tree
from docloom.queries.base import Family, table
from docloom.sources.io import page_items

FAMILY = Family()

# Lines of documents as items: every fifth line a heading of a level that depends on it, some media between.
ITEMS_SQL = """
ln AS (SELECT doc_id::VARCHAR AS doc_id, unnest(string_split(text, chr(10))) AS line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS ord FROM documents),
items AS (SELECT doc_id, ord, CASE WHEN ord % 7 = 3 THEN 'image' ELSE 'text' END AS type, line AS text, CASE WHEN ord % 5 = 0 THEN ((length(line) + ord) % 4 + 1)::INT END AS text_level, (ord // 6)::INT AS page_idx FROM ln)"""


def items(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    level = F.when(F.col("ord") % 5 == 0, (F.length("text") + F.col("ord")) % 4 + 1)
    return rows.select("doc_id", "ord", F.when(F.col("ord") % 7 == 3, "image").otherwise("text").alias("type"), "text", level.cast("int").alias("text_level"), F.floor(F.col("ord") / 6).cast("int").alias("page_idx"))


_HEAD = "(type = 'text' AND coalesce(text_level, -1) >= 1)"
# The parent by its definition: the latest earlier section of a smaller level (any, for what is no section).
TREE_SQL = f"""{ITEMS_SQL},
marked AS (SELECT *, {_HEAD} AS is_section FROM items),
secs AS (SELECT doc_id, ord, coalesce(text_level, 1) AS lvl FROM marked WHERE is_section),
par AS (SELECT m.doc_id, m.ord, max(s.ord) AS parent_ord FROM marked m LEFT JOIN secs s ON s.doc_id = m.doc_id AND s.ord < m.ord AND (NOT m.is_section OR s.lvl < coalesce(m.text_level, 1)) GROUP BY ALL),
nodes AS (SELECT m.doc_id, m.ord, CASE WHEN m.is_section THEN 'sec_' WHEN type = 'image' THEN 'img_' ELSE 't_' END || m.ord AS node_id, 'sec_' || parent_ord AS parent_id, CASE WHEN m.is_section THEN 'section' ELSE type END AS type, CASE WHEN m.is_section THEN text_level END AS level, CASE WHEN m.is_section THEN trim(text) END AS title, text, page_idx FROM marked m JOIN par USING (doc_id, ord))"""


@FAMILY.add(f"WITH {TREE_SQL} SELECT doc_id, ord::BIGINT AS ord, node_id, parent_id, type, level::BIGINT AS level, title FROM nodes")
def tree_build(spark, sf_dir):
    """Document trees of lines posing as items."""
    t = tree.build_tree(items(spark, sf_dir))
    return t.select("doc_id", F.col("ord").cast("long").alias("ord"), "node_id", "parent_id", "type", F.col("level").cast("long").alias("level"), "title")


@FAMILY.add(f"WITH {TREE_SQL} SELECT doc_id, node_id AS src, lead(node_id) OVER (PARTITION BY doc_id, page_idx ORDER BY ord) AS dst, 'prev_next' AS type FROM nodes QUALIFY dst IS NOT NULL")
def tree_prev_next(spark, sf_dir):
    """Edges between neighbours on a page."""
    return tree.prev_next(tree.build_tree(items(spark, sf_dir)))


@FAMILY.add(
    f"""WITH RECURSIVE {TREE_SQL},
up AS (SELECT doc_id, node_id, parent_id AS ancestor, 1 AS distance FROM nodes WHERE parent_id IS NOT NULL UNION ALL SELECT u.doc_id, u.node_id, n.parent_id, distance + 1 FROM up u JOIN nodes n ON n.doc_id = u.doc_id AND n.node_id = u.ancestor WHERE n.parent_id IS NOT NULL)
SELECT n.doc_id, n.node_id, coalesce(string_agg(a.title, ' > ' ORDER BY distance DESC), '') AS path FROM nodes n LEFT JOIN up USING (doc_id, node_id) LEFT JOIN nodes a ON a.doc_id = n.doc_id AND a.node_id = up.ancestor GROUP BY ALL"""
)
def tree_paths(spark, sf_dir):
    """Titles above each node."""
    return tree.paths(tree.build_tree(items(spark, sf_dir)), most=4)


@FAMILY.add(
    f"""WITH RECURSIVE {TREE_SQL},
up AS (SELECT doc_id, node_id, parent_id AS ancestor, 1 AS distance FROM nodes WHERE parent_id IS NOT NULL UNION ALL SELECT u.doc_id, u.node_id, n.parent_id, distance + 1 FROM up u JOIN nodes n ON n.doc_id = u.doc_id AND n.node_id = u.ancestor WHERE n.parent_id IS NOT NULL),
dep AS (SELECT n.doc_id, n.node_id, coalesce(max(distance), 0) AS depth FROM nodes n LEFT JOIN up USING (doc_id, node_id) GROUP BY ALL),
kid AS (SELECT doc_id, parent_id AS node_id, count(*) AS k FROM nodes WHERE parent_id IS NOT NULL GROUP BY ALL)
SELECT depth, count(*) AS total, count(*) FILTER (WHERE coalesce(k, 0) = 0) AS leaves, round(count(*) FILTER (WHERE coalesce(k, 0) = 0) / count(*), 3) AS leaf_ratio, round(coalesce(avg(k), 0), 3) AS avg_children FROM dep LEFT JOIN kid USING (doc_id, node_id) GROUP BY depth"""
)
def tree_level_statistics(spark, sf_dir):
    """Nodes, leaves and children by depth."""
    return tree.level_statistics(tree.build_tree(items(spark, sf_dir)), most=4)


@FAMILY.add(f"WITH {TREE_SQL} SELECT doc_id, type, count(*) AS n FROM nodes GROUP BY ALL")
def tree_type_counts(spark, sf_dir):
    """Nodes by type."""
    return tree.type_counts(tree.build_tree(items(spark, sf_dir)))


@FAMILY.add(f"WITH {ITEMS_SQL} SELECT doc_id, page_idx, string_agg(ord, ',' ORDER BY ord) AS ords FROM items GROUP BY ALL")
def tree_pages(spark, sf_dir):
    """Items of each page."""
    return tree.page_tree(items(spark, sf_dir)).select("doc_id", "page_idx", F.array_join("ords", ",").alias("ords"))


@FAMILY.add(f"WITH {ITEMS_SQL} SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS node_idx, coalesce(text_level, -1) AS node_level FROM items WHERE NOT (type = 'text' AND trim(text) = '')")
def adapt_items(spark, sf_dir):
    """Items without empty texts, numbered anew."""
    return tree.adapt_items(items(spark, sf_dir)).select("doc_id", "ord", F.col("node_idx").cast("long").alias("node_idx"), "node_level")


@FAMILY.add(f"WITH {ITEMS_SQL}, b AS (SELECT doc_id, page_idx + 1 AS page_idx, (row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY ord) - 1) AS pos, ord * 10 AS box FROM items WHERE ord % 4 <> 1) SELECT i.doc_id, i.ord, b.box FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY ord) - 1 AS pos FROM items) i LEFT JOIN b ON b.doc_id = i.doc_id AND b.page_idx - 1 = i.page_idx AND b.pos = i.pos")
def layout_join(spark, sf_dir):
    """Items with the layout block at the same place of their page; block pages count from 1."""
    from pyspark.sql import Window

    rows = items(spark, sf_dir).withColumn("bbox", F.lit(None).cast("int"))
    blocks = rows.where("ord % 4 <> 1").withColumn("pos", F.row_number().over(Window.partitionBy("doc_id", "page_idx").orderBy("ord")) - 1)
    blocks = blocks.select("doc_id", (F.col("page_idx") + 1).alias("page_idx"), "pos", (F.col("ord") * 10).alias("bbox"))
    return tree.with_layout(rows, blocks).select("doc_id", "ord", F.col("bbox").alias("box"))


@FAMILY.add(f"WITH {ITEMS_SQL}, a AS (SELECT doc_id, page_idx, count(*) AS n_items FROM items GROUP BY ALL), b AS (SELECT doc_id, page_idx, count(*) AS n_blocks FROM items WHERE ord % 11 <> 5 GROUP BY ALL) SELECT doc_id, page_idx, n_items, coalesce(n_blocks, 0) AS n_blocks FROM a LEFT JOIN b USING (doc_id, page_idx) WHERE n_items <> coalesce(n_blocks, 0)")
def layout_misaligned(spark, sf_dir):
    """Pages with different numbers of items and blocks."""
    rows = items(spark, sf_dir)
    return tree.misaligned_pages(rows, rows.where("ord % 11 <> 5"))


@FAMILY.add(f"WITH {ITEMS_SQL} SELECT doc_id, page_idx, arg_min(trim(text), ord) AS title FROM items WHERE type = 'text' AND length(trim(text)) BETWEEN 8 AND 80 AND NOT regexp_matches(trim(text), '^[-*•·▪‣]') GROUP BY ALL")
def slide_titles(spark, sf_dir):
    """Heuristic titles of pages as slides."""
    return tree.slide_titles(items(spark, sf_dir))


@FAMILY.add(f"WITH {ITEMS_SQL} SELECT doc_id, ord, dense_rank() OVER (PARTITION BY doc_id ORDER BY page_idx) AS slide_number FROM items")
def slide_numbers(spark, sf_dir):
    """Slide number of each item."""
    return tree.slides(items(spark, sf_dir)).select("doc_id", "ord", F.col("slide_number").cast("long").alias("slide_number"))


@FAMILY.add(
    r"""
WITH b AS (SELECT page_id, regexp_replace(html, '(?is)(<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<footer\b.*?</footer>|<!--.*?-->)', ' ', 'g') AS h FROM pages),
p AS (SELECT page_id, regexp_split_to_array(regexp_replace(regexp_replace(h, '(?i)(<(?:h[1-6]|p|li)\b)', chr(1) || '\1', 'g'), '(?i)(</(?:article|body|html)\b)', chr(2) || '\1', 'g'), chr(1)) AS parts FROM b),
e AS (SELECT page_id, unnest(parts[2:]) AS part, generate_subscripts(parts[2:], 1) - 1 AS ord FROM p),
t AS (SELECT page_id::VARCHAR AS doc_id, ord, trim(regexp_replace(regexp_replace(string_split(part, chr(2))[1], '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text, try_cast(regexp_extract(part, '(?i)^<h([1-6])', 1) AS INT) AS text_level FROM e)
SELECT doc_id, ord, text, text_level FROM t WHERE text <> ''"""
)
def page_items_scan(spark, sf_dir):
    """Web pages as items."""
    return page_items(table(spark, sf_dir, "pages")).select("doc_id", F.col("ord").cast("long").alias("ord"), "text", "text_level")


@FAMILY.add(f"WITH {TREE_SQL}, c AS (SELECT *, CASE WHEN is_section AND coalesce(text_level, 1) > 2 THEN false ELSE is_section END AS sec FROM marked) SELECT m.doc_id, m.ord, coalesce(max(s.ord), CASE WHEN NOT m.sec THEN -1 END) AS parent_ord FROM c m LEFT JOIN c s ON s.doc_id = m.doc_id AND s.sec AND s.ord < m.ord AND (NOT m.sec OR s.text_level < m.text_level) GROUP BY m.doc_id, m.ord, m.sec UNION ALL SELECT DISTINCT doc_id, -1, NULL FROM items")
def chapter_tree(spark, sf_dir):
    """Chapters of two levels, with a preface."""
    return tree.chapter_tree(items(spark, sf_dir), most=2).select("doc_id", "ord", "parent_ord")


@FAMILY.add(f"WITH {ITEMS_SQL} SELECT doc_id, page_idx, string_agg(ord, ',' ORDER BY ord) AS ords, count(*) AS n FROM items WHERE coalesce(text_level, -1) = -1 AND type <> 'title' GROUP BY ALL")
def orphan_groups(spark, sf_dir):
    """Elements without a chapter by page."""
    rows = items(spark, sf_dir).withColumn("parent", F.coalesce("text_level", F.lit(-1)))
    return structure.orphan_groups(rows).select("doc_id", "page_idx", F.array_join("ords", ",").alias("ords"), "n")

"""Queries of scalars, lookups, layout, trees and views that no other family has."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import html, scoring
from docloom.functions import text as T
from docloom.operators import lookup, structure, tree, views
from docloom.queries.base import Family, table
from docloom.queries.tree import ITEMS_SQL, TREE_SQL, items
from docloom.queries.views import nodes
from docloom.sources import io

FAMILY = Family()


def _c(spark, sf_dir):
    return table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey"))


def _s(k="k"):
    return F.col(k).cast("string")


# Scalars


@FAMILY.add(
    """WITH a AS (SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN c_custkey || ',000' WHEN 1 THEN '5.' WHEN 2 THEN '1e5' WHEN 3 THEN 'a; b' WHEN 4 THEN '  ' ELSE '12%' END AS answer FROM customer)
SELECT k, (k % 6 = 0)::INT::DOUBLE AS as_int, (k % 6 IN (0, 1, 2, 5))::INT::DOUBLE AS as_float, (k % 6 IN (0, 3))::INT::DOUBLE AS as_list, (k % 6 <> 4)::INT::DOUBLE AS as_string, (k % 6 IN (0, 3))::INT::DOUBLE AS as_either, 0.0::DOUBLE AS as_other FROM a"""
)
def score_format_conforms(spark, sf_dir):
    """Answers against formats and alternatives."""
    k = F.col("k") % 6
    a = _c(spark, sf_dir).withColumn("answer", F.when(k == 0, F.concat(_s(), F.lit(",000"))).when(k == 1, "5.").when(k == 2, "1e5").when(k == 3, "a; b").when(k == 4, "  ").otherwise("12%"))
    f = lambda spec: scoring.format_conforms(F.col("answer"), spec)
    return a.select("k", f("int").alias("as_int"), f("float").alias("as_float"), f("list").alias("as_list"), f(" string ").alias("as_string"), f("int | list").alias("as_either"), f("date").alias("as_other"))


@FAMILY.add("SELECT c_nationkey AS nation, max(CASE WHEN c_custkey % 11 = 0 THEN 1.0 WHEN c_custkey % 3 = 0 THEN 0.6 ELSE 0.3 END)::DOUBLE AS priority FROM customer WHERE c_nationkey = 5 GROUP BY c_nationkey")
def score_source_priority(spark, sf_dir):
    """The best kind of source among hits."""
    hits = _c(spark, sf_dir).where("c_nationkey = 5").withColumn("role", F.when(F.col("k") % 11 == 0, "table").when(F.col("k") % 3 == 0, "image").otherwise("section"))
    return scoring.source_priority(hits).select(F.lit(5).alias("nation"), "priority")


@FAMILY.add("SELECT c_custkey AS k, round(0.25 * (c_custkey % 5) / 4.0 + 0.15 * (c_custkey % 2) + 0.4 * (c_custkey % 7) / 6.0 + 0.1 * 0.6 + 0.1 * (c_custkey % 3) / 2.0, 9)::DOUBLE AS quality FROM customer")
def score_quality(spark, sf_dir):
    """Weighted quality of answers."""
    k = F.col("k")
    return _c(spark, sf_dir).select("k", F.round(scoring.quality(k % 5 / 4.0, k % 2, k % 7 / 6.0, F.lit(0.6), k % 3 / 2.0), 9).alias("quality"))


@FAMILY.add("SELECT c_custkey AS k, 'Figure ' || c_custkey || ',Table A' || (c_custkey % 7) AS aliases, 'Figure 12B' AS label FROM customer")
def text_caption_aliases(spark, sf_dir):
    """All figures and tables that a caption names, once each; a label's spelling."""
    caption = F.concat(F.lit("See fig "), _s(), F.lit(", Figure "), _s(), F.lit(" and TABLE A"), (F.col("k") % 7).cast("string"), F.lit("."))
    return _c(spark, sf_dir).select("k", F.array_join(T.caption_aliases(caption), ",").alias("aliases"), T.normalise_label(F.lit(" fig.  12b")).alias("label"))


@FAMILY.add("SELECT c_custkey AS k, nullif(concat_ws(' ', CASE WHEN c_custkey % 2 = 0 THEN 'percent pct' END, CASE WHEN c_custkey % 3 = 0 THEN 'acc accuracy' END, CASE WHEN c_custkey % 5 = 0 THEN 'f1 f1-score' END), '') AS aliases FROM customer")
def text_alias_words(spark, sf_dir):
    """Words that stand for percent, accuracy and F1 mentions."""
    k = F.col("k")
    rows = _c(spark, sf_dir).select("k", F.when(k % 2 == 0, "Proportion of x").alias("a"), F.concat_ws(", ", F.when(k % 3 == 0, "acc"), F.when(k % 5 == 0, "F1-score")).alias("b"))
    return rows.select("k", F.nullif(T.aliases(F.col("a"), F.col("b")), F.lit("")).alias("aliases"))


@FAMILY.add(
    """SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'numeric' WHEN 1 THEN 'roman' WHEN 2 THEN 'alpha' ELSE 'none' END AS kind, CASE c_custkey % 4 WHEN 0 THEN 3 WHEN 3 THEN 0 ELSE 1 END::INT AS depth,
  CASE c_custkey % 4 WHEN 0 THEN '(3)' WHEN 1 THEN 'iv.' WHEN 2 THEN '-' END AS marker, CASE c_custkey % 4 WHEN 3 THEN 'Plain ' || c_custkey ELSE 'item ' || c_custkey END AS item FROM customer"""
)
def text_numbering(spark, sf_dir):
    """Kinds and depths of heading numbers, and list markers."""
    k = F.col("k") % 4
    head = F.when(k == 0, F.concat((F.col("k") % 9).cast("string"), F.lit(".2.1 Title"))).when(k == 1, "IV. Title").when(k == 2, "b) Title").otherwise("Title only")
    line = F.when(k == 0, "  (3) item ").when(k == 1, "iv. item ").when(k == 2, "- item ").otherwise("Plain ")
    n, m = T.numbering(head), T.list_marker(F.concat(line, _s()))
    return _c(spark, sf_dir).select("k", n["kind"].alias("kind"), n["depth"].alias("depth"), m["marker"].alias("marker"), m["item"].alias("item"))


@FAMILY.add("SELECT c_custkey AS k, '1 Intro|2.1 Methods of v' || c_custkey || '|IV. End' AS entries, 'a line of ' || c_custkey AS told, 'Heading ' || c_custkey AS title FROM customer")
def text_contents_lines(spark, sf_dir):
    """Contents lines taken apart, descriptions without their opening, headings' first lines."""
    line = F.concat(F.lit(" 1 Intro  2.1 Methods of v"), _s(), F.lit(" IV. End "))
    told = F.concat(F.lit("The chart shows a line of "), _s())
    return _c(spark, sf_dir).select("k", F.array_join(T.split_toc_line(line), "|").alias("entries"), T.strip_description_prefix(told).alias("told"), T.section_title(F.concat(F.lit(" Heading "), _s(), F.lit("\nand more"))).alias("title"))


@FAMILY.add(
    """SELECT c_custkey AS k, c_custkey AS parsed, CASE WHEN c_custkey % 2 = 0 THEN 'a' || c_custkey || '|b' ELSE '' END AS listed, CASE WHEN c_custkey % 3 = 0 THEN '7|-2' ELSE '' END AS ints,
  sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}') AS hash FROM customer"""
)
def text_loose_values(spark, sf_dir):
    """JSON inside prose, list literals, integers of lists, content hashes."""
    k = F.col("k")
    raw = F.concat(F.lit('Sure: {"n": '), _s(), F.lit("} done"))
    listed = F.when(k % 2 == 0, F.concat(F.lit("['a"), _s(), F.lit("', \"b\"]"))).otherwise("none")
    ints = F.when(k % 3 == 0, F.lit('["7", "x", "-2"]')).otherwise("[")
    return _c(spark, sf_dir).select("k", T.loose_json(raw, "n long")["n"].alias("parsed"), F.array_join(T.list_literal(listed), "|").alias("listed"), F.array_join(T.int_list_literal(ints).cast("array<string>"), "|").alias("ints"), T.content_hash(F.col("c_custkey"), F.col("c_name")).alias("hash"))


@FAMILY.add("SELECT c_custkey AS k, c_custkey % 9 = 3 OR c_custkey % 9 = 5 AS named, 'sec_' || c_custkey AS base, 'h' AS variant, c_custkey AS page FROM customer")
def text_pages_and_views(spark, sf_dir):
    """Logical pages and ranges, parts of view ids, pages named in text."""
    named = F.concat((F.col("k") % 9).cast("string"), F.lit(" - 5"))
    named = F.when(F.col("k") % 9 == 3, F.lit("3-5")).when(F.col("k") % 9 == 5, F.lit("4 - 5")).otherwise(F.concat((F.col("k") % 9).cast("string"), F.lit("x")))
    view = F.concat(F.lit("sec_"), _s(), F.lit("#h"))
    wanted = F.when(F.col("k") % 9 == 3, 3).otherwise(5)
    return _c(spark, sf_dir).select("k", T.logical_page_matches(named, wanted).alias("named"), T.base_id(view).alias("base"), T.view_variant(view).alias("variant"), T.page_of_text(F.concat(F.lit("on Slide "), _s())).cast("long").alias("page"))


@FAMILY.add("SELECT c_custkey AS k, 'line ' || c_custkey || chr(10) || chr(10) || 'next' AS clean, 'ab|cd' AS kept FROM customer")
def text_sanitise(spark, sf_dir):
    """Text without control characters, zero-width signs, letter runs and blank runs."""
    dirty = F.concat(F.lit(" line \t "), _s(), F.lit("​\x07 \n\n\n\n x y z w v next "))
    return _c(spark, sf_dir).select("k", T.sanitise(dirty).alias("clean"), F.array_join(T.sanitise_list(F.array(F.lit("ab"), F.lit(" a "), F.lit("cd"), F.lit("ab "))), "|").alias("kept"))


@FAMILY.add(
    """SELECT p_partkey AS k, 'Name|Price|Price_2|col4' AS columns, p_name || '|' || p_size || '|9|' AS first, '| Name | Price | Price | col4 |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || '| ' || p_name || ' | ' || p_size || ' | 9 |  |' AS markdown,
  'Name: ' || p_name || ', Price: ' || p_size || ', Price_2: 9, col4: ' AS preview FROM part"""
)
def html_tables(spark, sf_dir):
    """HTML tables as columns and rows, as Markdown and as a preview."""
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    text = F.concat(F.lit("<table><tr><th>Name</th><th>Price</th><th>Price</th><th> </th></tr><tr>"), cell(F.col("p_name")), cell(F.col("p_size").cast("string")), cell(F.lit("9")), F.lit("</tr></table>"))
    rows = html.dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey").select(F.col("p_partkey").alias("k"), text.alias("h"))
    parsed = rows.select("k", html.parse_table("h").alias("t"), html.table_markdown("h").alias("markdown"))
    return parsed.select("k", F.array_join("t.columns", "|").alias("columns"), F.array_join(F.get("t.rows", F.lit(0)), "|").alias("first"), "markdown", lookup.table_preview(F.col("t.columns"), F.col("t.rows")).alias("preview"))


@FAMILY.add("SELECT c_custkey AS k, c_name || '; second' AS items, CASE WHEN c_custkey % 2 = 0 THEN c_name || '; ' ELSE '' END || 'described' AS image FROM customer")
def lookup_previews(spark, sf_dir):
    """Previews of lists and images."""
    listed = F.array(F.lit(" "), F.col("c_name"), F.lit(" second "), F.lit("third"))
    return _c(spark, sf_dir).select("k", lookup.list_preview(listed).alias("items"), lookup.image_summary(F.when(F.col("k") % 2 == 0, F.col("c_name")), F.lit(" described ")).alias("image"))


# Lookups


@FAMILY.add("SELECT 'c' || o_custkey AS node_id, arg_min(o_orderpriority, o_orderkey) AS first, string_agg(o_orderpriority, '; ' ORDER BY o_orderkey) AS joined FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey")
def lookup_span_texts(spark, sf_dir):
    """First text and all texts of a role among spans."""
    spans = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("node_id"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderstatus") == "O", "figure_caption").otherwise("axis_label").alias("role"), F.col("o_orderpriority").alias("dense_text"))
    return lookup.span_texts(spans, "figure_caption")


@FAMILY.add("SELECT c_custkey AS k, concat_ws(' | ', 'page: ' || c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 'label: Figure ' || c_custkey END, 'caption: ' || c_name) AS context, c_custkey % 3 = 0 AS has_all, CASE c_custkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 7 END::INT AS level, c_custkey % 100 >= 50 AS large FROM customer")
def lookup_region_contexts(spark, sf_dir):
    """Contexts of regions; required keys; levels from several sources; sizes."""
    k = F.col("k")
    rois = _c(spark, sf_dir).select("k", F.col("c_nationkey").alias("page_idx"), F.when(k % 2 == 0, F.concat(F.lit("Figure "), _s())).alias("label"), F.col("c_name").alias("caption"), (k % 100).alias("width"), F.lit(80).alias("height"))
    keys = F.when(k % 3 == 0, F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))).otherwise(F.create_map(F.lit("a"), F.lit(1)))
    level = lookup.resolve_level(F.when(k % 3 == 0, "4"), F.when(k % 3 == 1, "A > B > C"), F.lit(7))
    return lookup.roi_context(rois).select("k", "context", lookup.has_keys(keys, ["a", "b"]).alias("has_all"), level.alias("level"), lookup.large_enough().alias("large"))


@FAMILY.add("SELECT 'c' || c_custkey AS node_id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 2 = 0 THEN c_name END AS text FROM customer")
def lookup_candidate_texts(spark, sf_dir):
    """Texts of candidates from the first store that has one."""
    c = _c(spark, sf_dir).withColumn("node_id", F.concat(F.lit("c"), "c_custkey"))
    first = c.select("node_id", F.when(F.col("k") % 3 == 0, F.col("c_mktsegment")).otherwise(" ").alias("text"))
    return lookup.candidate_texts(c.select("node_id"), first, c.where("k % 2 = 0").select("node_id", F.col("c_name").alias("text")))


@FAMILY.add("SELECT 'c' || c_custkey AS node_id, 0.5::DOUBLE AS score, 'en' AS lang FROM customer UNION ALL SELECT 'c' || c_custkey, 0.25::DOUBLE, NULL FROM customer")
def lookup_unite(spark, sf_dir):
    """Two hit lists as one, with the columns of either."""
    c = _c(spark, sf_dir).select(F.concat(F.lit("c"), "c_custkey").alias("node_id"))
    return lookup.unite(c.withColumn("score", F.lit(0.5)).withColumn("lang", F.lit("en")), c.withColumn("score", F.lit(0.25)))


@FAMILY.add("WITH e AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, o_orderkey % 4 = 0 AS is_title, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey - o_orderkey % 8 END AS chapter FROM orders) SELECT doc_id, ord AS chapter, ord, 'own' AS kind FROM e WHERE is_title UNION ALL SELECT doc_id, chapter, ord, 'own' FROM e WHERE NOT is_title UNION ALL SELECT doc_id, NULL, ord, 'leaf' FROM e WHERE is_title AND NOT EXISTS (SELECT 1 FROM e i WHERE i.is_title AND i.doc_id = e.doc_id AND i.chapter = e.ord)")
def lookup_chapter_elements(spark, sf_dir):
    """Own elements of chapters, and chapters without subchapters."""
    k = F.col("o_orderkey")
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("ord"), (k % 4 == 0).alias("is_title"), F.when(k % 8 != 0, k - k % 8).alias("chapter"))
    own = lookup.chapter_elements(e).select("doc_id", "chapter", "ord", F.lit("own").alias("kind"))
    return own.unionByName(lookup.leaf_chapters(e).select("doc_id", F.lit(None).cast("long").alias("chapter"), "ord", F.lit("leaf").alias("kind")))


@FAMILY.add(
    f"""WITH {ITEMS_SQL}, t AS (SELECT doc_id, ord, page_idx, regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g') AS t FROM items WHERE type = 'text'),
w AS (SELECT doc_id, ord, page_idx, list_distinct(list_filter(string_split(t, ' '), lambda x: x <> '')) AS ws FROM t),
e AS (SELECT * FROM w WHERE ord % 5 = 0),
p AS (SELECT e.doc_id, e.ord, w.ord AS m, len(list_intersect(e.ws, w.ws)) / nullif(len(list_distinct(list_concat(e.ws, w.ws))), 0) AS s FROM e JOIN w ON w.doc_id = e.doc_id AND w.page_idx = e.page_idx AND w.ord <> e.ord),
b AS (SELECT doc_id, ord, m, s, row_number() OVER (PARTITION BY doc_id, ord ORDER BY s DESC, m) AS r FROM p WHERE s >= 0.1)
SELECT e.doc_id, e.ord::BIGINT AS ord, b.m::BIGINT AS match_ord, round(b.s, 6)::DOUBLE AS similarity FROM e LEFT JOIN (SELECT * FROM b WHERE r = 1) b USING (doc_id, ord)"""
)
def toc_matches(spark, sf_dir):
    """Contents entries with the most similar other text of their page."""
    rows = items(spark, sf_dir).where("type = 'text'")
    entries = rows.where("ord % 5 = 0").select("doc_id", "ord", F.col("text").alias("title"), F.concat_ws("/", F.col("page_idx").cast("string"), (F.col("ord") % 5).cast("string")).alias("page"))
    # an entry's own line is no candidate for it: entries look among the lines that are none, and among other entries
    plain = rows.where("ord % 5 <> 0").select("doc_id", "ord", "text", F.concat(F.col("page_idx").cast("string"), F.lit("/0")).alias("logical_page"))
    other = rows.where("ord % 5 = 0").alias("a").join(rows.where("ord % 5 = 0").select("doc_id", "page_idx", F.col("ord").alias("o")), ["doc_id", "page_idx"]).where("o <> ord")
    keyed = entries.withColumn("page", F.concat(F.col("page"), F.lit(":"), F.col("ord").cast("string")))
    spread = plain.withColumn("p", F.substring_index("logical_page", "/", 1)).join(entries.select("doc_id", F.substring_index("page", "/", 1).alias("p"), F.col("ord").alias("e")), ["doc_id", "p"])
    spread = spread.select("doc_id", "ord", "text", F.concat(F.col("logical_page"), F.lit(":"), F.col("e").cast("string")).alias("logical_page"))
    other = other.select("doc_id", "ord", "text", F.concat(F.col("page_idx").cast("string"), F.lit("/0:"), F.col("o").cast("string")).alias("logical_page"))
    found = structure.toc_matches(keyed, spread.unionByName(other), least=0.1)
    return found.select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("match_ord").cast("long").alias("match_ord"), F.round("similarity", 6).alias("similarity"))


# Layout and trees


@FAMILY.add("SELECT o_custkey AS doc_id, bool_or(o_orderkey % 11 = 0 OR o_orderstatus = 'P') AS is_new FROM orders GROUP BY o_custkey")
def tree_new_format(spark, sf_dir):
    """Which documents come from the newer parser: boxes or its types."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderkey") % 11 == 0, F.array(F.lit(1.0))).alias("bbox"), F.when(F.col("o_orderstatus") == "P", "aside_text").otherwise("text").alias("type"))
    return tree.new_format(rows)


@FAMILY.add("SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN c_custkey WHEN 1 THEN c_custkey + 1 ELSE c_custkey + 2 END::DOUBLE AS x0 FROM customer")
def tree_block_boxes(spark, sf_dir):
    """Boxes of blocks, else of their first line, else of its first span."""
    k = F.col("k")
    box = lambda add: F.array((k + add).cast("double"))
    none = F.lit(None).cast("array<double>")
    line = F.struct(F.when(k % 3 == 1, box(1)).otherwise(none).alias("bbox"), F.array(F.struct(box(2).alias("bbox"))).alias("spans"))
    block = F.struct(F.when(k % 3 == 0, box(0)).otherwise(none).alias("bbox"), F.array(line).alias("lines"))
    return _c(spark, sf_dir).select("k", tree.block_bbox(block)[0].alias("x0"))


@FAMILY.add("SELECT o_custkey AS doc_id, min(o_orderkey) AS x0, min(o_orderkey % 50) AS y0, max(o_orderkey + 3) AS x1, max(o_orderkey % 70) AS y1 FROM orders GROUP BY o_custkey")
def tree_union_boxes(spark, sf_dir):
    """The smallest box around spans."""
    k = F.col("o_orderkey")
    return tree.union_bbox(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("x0"), (k % 50).alias("y0"), (k + 3).alias("x1"), (k % 70).alias("y1")), "doc_id")


@FAMILY.add("WITH i AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, (o_orderkey % 3)::INT AS page_idx, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey) - 1 AS pos FROM orders) SELECT doc_id, ord, CASE WHEN pos % 2 = 0 THEN doc_id * 1000 + page_idx * 100 + pos ELSE -1 END::DOUBLE AS x0 FROM i")
def layout_shifted_pages(spark, sf_dir):
    """Boxes of layout blocks whose pages are numbered from one; items without a block keep their own."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 3).cast("int").alias("page_idx"))
    own = o.withColumn("bbox", F.array(F.lit(-1.0)))
    pos = F.row_number().over(Window.partitionBy("doc_id", "page_idx").orderBy("ord")) - 1
    placed = tree.by_document(o).withColumn("lo", F.min("page_idx").over(Window.partitionBy("doc_id"))).withColumn("pos", pos)
    box = F.array((F.col("doc_id") * 1000 + F.col("page_idx") * 100 + F.col("pos")).cast("double"))
    shift = F.when(F.col("lo") == 0, 1).otherwise(0)  # documents without a page 0 are left as they are, for their lowest page is not 1 by numbering
    blocks = placed.where("pos % 2 = 0").select("doc_id", (F.col("page_idx") + shift).alias("page_idx"), "pos", box.alias("bbox"))
    # an empty block on page 0 keeps the numbering of documents without that page
    mark = o.groupBy("doc_id").agg(F.min("page_idx").alias("lo")).where("lo > 0").select("doc_id", F.lit(0).alias("page_idx"), F.lit(9999).alias("pos"), F.array(F.lit(0.0)).alias("bbox"))
    return tree.with_layout(own, blocks.unionByName(mark)).select("doc_id", "ord", F.col("bbox")[0].alias("x0"))


@FAMILY.add(
    f"""WITH RECURSIVE {TREE_SQL}, own AS (SELECT doc_id, node_id, parent_id, CASE WHEN ord % 5 = 0 AND length(text) % 2 = 0 THEN ord END AS v FROM nodes),
up AS (SELECT doc_id, node_id, v, parent_id, 0 AS d FROM own UNION ALL SELECT up.doc_id, up.node_id, o.v, o.parent_id, d + 1 FROM up JOIN own o ON o.doc_id = up.doc_id AND o.node_id = up.parent_id WHERE up.v IS NULL)
SELECT doc_id, node_id, arg_min(v, d) FILTER (WHERE v IS NOT NULL)::BIGINT AS value FROM up GROUP BY ALL"""
)
def tree_inherited(spark, sf_dir):
    """Values of nodes or of their nearest ancestors that have one."""
    rows = nodes(spark, sf_dir).withColumn("v", F.when((F.col("ord") % 5 == 0) & (F.length("text") % 2 == 0), F.col("ord")))
    return tree.inherited(rows, "v").select("doc_id", "node_id", F.col("value").cast("long").alias("value"))


@FAMILY.add("SELECT c_custkey AS doc_id, 'r' AS node_id, NULL AS parent_id, '' AS path FROM customer UNION ALL SELECT c_custkey, 'a' || i, 'r', i::VARCHAR FROM customer, range(2) t(i) UNION ALL SELECT c_custkey, 'b', 'a1', '1.0' FROM customer")
def tree_flatten_nested(spark, sf_dir):
    """Nested trees as rows."""
    root = '{"node_id": "r", "children": [{"node_id": "a0"}, {"node_id": "a1", "children": [{"node_id": "b", "children": []}]}]}'
    flat = tree.flatten_nested(_c(spark, sf_dir).select(F.col("k").alias("doc_id"), F.lit(root).alias("root")), levels=3)
    return flat.select("doc_id", "node_id", "parent_id", F.array_join(F.col("ord_path").cast("array<string>"), ".").alias("path"))


@FAMILY.add(
    f"""WITH {ITEMS_SQL}, p AS (SELECT DISTINCT doc_id, page_idx, dense_rank() OVER (PARTITION BY doc_id ORDER BY page_idx) AS n FROM items),
t AS (SELECT doc_id, page_idx, arg_min(trim(text), ord) AS title FROM items WHERE type = 'text' AND length(trim(text)) BETWEEN 8 AND 80 AND NOT regexp_matches(trim(text), '^[-*•·▪‣]') GROUP BY ALL),
u AS (SELECT doc_id, n, 0 AS layer, -1 AS ord, 'slide' AS type, NULL AS text FROM p UNION ALL SELECT doc_id, n, 1, -1, 'heading', coalesce(title, 'Slide ' || n) FROM p LEFT JOIN t USING (doc_id, page_idx) UNION ALL SELECT doc_id, n, 2, ord, type, text FROM items JOIN p USING (doc_id, page_idx))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, layer, ord) - 1 AS node_idx, type, text FROM u"""
)
def tree_slides(spark, sf_dir):
    """Slides as containers of their title and items."""
    return tree.slide_tree(items(spark, sf_dir)).select("doc_id", F.col("node_idx").cast("long").alias("node_idx"), "type", "text")


@FAMILY.add("SELECT o_custkey AS doc_id, o_orderkey AS ord, CASE WHEN o_orderkey % 4 = 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END WHEN o_orderkey % 2 = 0 THEN 1 END::INT AS level FROM orders")
def captions_applied(spark, sf_dir):
    """Headings that repeat a caption of their medium lose their level."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("ord"), F.concat(F.lit("caption of order "), (k % 3).cast("string")).alias("text"), F.when((k % 4 == 1) | (k % 2 == 0), 1).alias("level"), F.array(F.lit("Caption of order 0"), F.lit("other words here entirely")).alias("captions"))
    least = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.min("o_orderkey").alias("media_ord"))
    roles = rows.where("ord % 4 = 1").join(least, "doc_id").select("doc_id", "ord", "media_ord", F.lit("caption").alias("role"))
    return structure.apply_captions(rows, roles, least=0.9).select("doc_id", "ord", "level")


@FAMILY.add(f"WITH {ITEMS_SQL} SELECT doc_id, ord::BIGINT AS ord, CASE WHEN ord = min(CASE WHEN type = 'image' THEN ord END) OVER (PARTITION BY doc_id, ord // 10) THEN 2 END AS promoted FROM items")
def media_promoted(spark, sf_dir):
    """The first medium of each span gets the span's heading level."""
    rows = items(spark, sf_dir)
    start = (F.floor(F.col("ord") / 10) * 10).cast("int")
    spans = rows.select("doc_id", start.alias("start"), (start + 9).alias("end"), F.lit(2).alias("level")).distinct()
    return structure.promote_media(rows, spans).select("doc_id", F.col("ord").cast("long").alias("ord"), "promoted")


@FAMILY.add("SELECT c_custkey AS k, greatest(0, least(10, c_custkey % 20 + 10) - c_custkey % 20) / 10.0 >= 0.3 AS same FROM customer")
def boxes_in_one_column(spark, sf_dir):
    """Boxes that overlap sideways."""
    box = lambda x0: F.struct(x0.cast("double").alias("x0"), (x0 + 10).cast("double").alias("x1"))
    rows = _c(spark, sf_dir).select("k", box(F.lit(0)).alias("a"), box(F.col("k") % 20).alias("b"))
    return rows.select("k", structure.same_column("a", "b").alias("same"))


# Views


@FAMILY.add(f"WITH {TREE_SQL} SELECT n.doc_id, n.node_id, s.title AS parent_title FROM nodes n LEFT JOIN nodes s ON s.doc_id = n.doc_id AND s.node_id = n.parent_id AND s.type = 'section'")
def view_parent_titles(spark, sf_dir):
    """Titles of the sections that nodes lie in."""
    return views.parent_titles(nodes(spark, sf_dir)).select("doc_id", "node_id", "parent_title")


@FAMILY.add(f"WITH {TREE_SQL} SELECT doc_id, node_id, CASE WHEN type = 'text' THEN 'paragraph' ELSE type END AS role, title, page_idx, CASE WHEN type <> 'section' THEN parent_id END AS parent_section FROM nodes WHERE type IN ('section', 'text')")
def view_summary_nodes(spark, sf_dir):
    """Which nodes are summarised, their roles and places."""
    return views.summary_nodes(nodes(spark, sf_dir)).select("doc_id", "node_id", "role", "title", "page_idx", "parent_section")


@FAMILY.add(
    f"""WITH {TREE_SQL}, t AS (SELECT 'sections' AS view, doc_id FROM nodes WHERE type = 'section' UNION ALL SELECT 'images', doc_id FROM nodes WHERE type = 'image') SELECT doc_id, view, count(*) AS n FROM t GROUP BY ALL"""
)
def view_counts(spark, sf_dir):
    """Rows of views by document."""
    n = nodes(spark, sf_dir)
    return views.view_counts(sections=n.where("type = 'section'"), images=n.where("type = 'image'"))


@FAMILY.add(
    """WITH m AS (SELECT c_nationkey::VARCHAR AS doc_id, c_custkey FROM customer)
SELECT doc_id, 'c' || c_custkey AS node_id, 'Figure ' || c_custkey AS label, 'img_' || c_custkey AS target FROM m WHERE c_custkey % 3 = 0
UNION ALL SELECT doc_id, 'c' || c_custkey, 'Table ' || c_custkey, 'tab_' || c_custkey FROM m WHERE c_custkey % 3 = 1"""
)
def view_references(spark, sf_dir):
    """What chunks refer to, by label, else by number."""
    c = _c(spark, sf_dir).withColumn("doc_id", F.col("c_nationkey").cast("string"))
    said = F.when(F.col("k") % 3 == 0, F.concat(F.lit("as Fig "), _s(), F.lit(" shows"))).when(F.col("k") % 3 == 1, F.concat(F.lit("see table "), _s())).otherwise("nothing")
    chunks = c.select("doc_id", F.concat(F.lit("c"), "c_custkey").alias("node_id"), said.alias("raw_text"))
    figures = c.where("k % 3 = 0").select("doc_id", F.lit("label").alias("kind"), F.concat(F.lit("Figure "), _s()).alias("key"), F.concat(F.lit("img_"), _s()).alias("node_id"))
    numbers = c.where("k % 3 = 1").select("doc_id", F.lit("table").alias("kind"), _s().alias("key"), F.concat(F.lit("tab_"), _s()).alias("node_id"))
    return views.references(chunks, figures.unionByName(numbers))


@FAMILY.add("SELECT 's' || s_suppkey AS src, 's' || s_suppkey || ':row:' || i AS dst, 'has_row' AS type FROM supplier, range(2) t(i) UNION ALL SELECT 's' || s_suppkey, 's' || s_suppkey || ':col:' || c, 'has_col' FROM supplier, (VALUES ('Name'), ('Key')) v(c)")
def view_table_edges(spark, sf_dir):
    """Edges from tables to their rows and columns."""
    row = lambda a, b: F.concat(F.lit("<tr><td>"), a, F.lit("</td><td>"), b, F.lit("</td></tr>"))
    data = F.concat(F.lit("<table>"), row(F.lit("Name"), F.lit("Key")), row(F.col("s_name"), F.lit("1")), row(F.lit("x"), F.lit("2")), F.lit("</table>"))
    t = table(spark, sf_dir, "supplier").select(F.lit("d").alias("doc_id"), F.concat(F.lit("s"), "s_suppkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("s_suppkey").alias("ord"), F.col("s_suppkey").alias("read_order"), F.lit("table").alias("type"), F.lit(None).cast("int").alias("page_idx"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("title"), data.alias("data"))
    return views.edges(t).select("src", "dst", "type")


@FAMILY.add("SELECT c_custkey AS k, concat_ws('; ', 'c_name: ' || c_name, CASE WHEN c_custkey % 2 = 0 THEN 'seg: ' || c_mktsegment END) AS text FROM customer")
def view_collapsed_fields(spark, sf_dir):
    """Fields of a sparse document as one text."""
    return _c(spark, sf_dir).withColumn("seg", F.when(F.col("k") % 2 == 0, F.col("c_mktsegment")).otherwise(" ")).select("k", views.collapse_fields(["c_name", "seg"]).alias("text"))


# Sources


@FAMILY.add("SELECT folder, arg_min(name, r) AS name FROM (SELECT 'f' || c_nationkey AS folder, CASE c_custkey % 3 WHEN 0 THEN 'x_{0}' WHEN 1 THEN 'x_{1}' ELSE 'other.txt' END AS name, c_custkey % 3 AS r FROM customer) WHERE r < 2 GROUP BY folder".format(*io.PREFERENCE[:2]))
def source_preferred_inputs(spark, sf_dir):
    """The best stage file of each folder."""
    k = F.col("k") % 3
    name = F.when(k == 0, f"x_{io.PREFERENCE[0]}").when(k == 1, f"x_{io.PREFERENCE[1]}").otherwise("other.txt")
    return io.preferred_inputs(_c(spark, sf_dir).select(F.concat(F.lit("f"), "c_nationkey").alias("folder"), name.alias("name"))).select("folder", "name")


@FAMILY.add("SELECT 'p/page_' || c_custkey || '.png' AS path, c_custkey - 1 AS page_idx FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT NULL, c_custkey - 1 FROM customer WHERE c_custkey % 2 = 1")
def source_page_images(spark, sf_dir):
    """Page numbers of image files, and the pages without one."""
    c = _c(spark, sf_dir)
    files = c.where("k % 2 = 0").select(F.concat(F.lit("p/page_"), _s(), F.lit(".png")).alias("path"), F.concat(F.lit("page_"), _s(), F.lit(".png")).alias("name"))
    images = io.page_images(files)
    missing = io.missing_pages(c.select((F.col("k") - 1).cast("int").alias("page_idx")), images)
    return images.unionByName(missing.select(F.lit(None).cast("string").alias("path"), "page_idx")).select("path", F.col("page_idx").cast("long").alias("page_idx"))


@FAMILY.add(
    """WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, max(l_quantity)::DOUBLE AS q, min(l_partkey) AS k FROM lineitem GROUP BY ALL),
c AS (SELECT doc_id, n, 'a/img_' || n || '.png' AS img_path FROM r),
l AS (SELECT doc_id, CASE WHEN n % 2 = 1 THEN 'img_' || n ELSE 'page_img_' || n || '_' || (k % 3) END AS other, q AS box FROM r WHERE n % 3 > 0)
SELECT c.doc_id, c.img_path, arg_min(l.box, (l.other <> 'img_' || c.n, l.other)) AS box FROM c LEFT JOIN l ON l.doc_id = c.doc_id AND contains(l.other, 'img_' || c.n) GROUP BY ALL"""
)
def source_layout_boxes(spark, sf_dir):
    """Boxes of a layout by file name inside each document: the same name, else a name that contains it."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n")).agg(F.max("l_quantity").cast("double").alias("q"), F.min("l_partkey").alias("k"))
    content = rows.select("doc_id", F.concat(F.lit("a/img_"), "n", F.lit(".png")).alias("img_path"))
    name = F.when(F.col("n") % 2 == 1, F.concat(F.lit("b/img_"), "n", F.lit(".png"))).otherwise(F.concat(F.lit("b/page_img_"), "n", F.lit("_"), F.col("k") % 3, F.lit(".jpg")))
    layout = rows.where("n % 3 > 0").select("doc_id", name.alias("img_path"), F.array("q").alias("bbox"))
    return io.enrich_with_layout(content, layout).select("doc_id", "img_path", F.get("bbox", F.lit(0)).alias("box"))

"""Queries of index views over trees of documents' lines, and of tables made from the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chunks, tree, views
from docloom.queries.base import Family, sql_list, table
from docloom.queries.tree import TREE_SQL, items

FAMILY = Family()


def nodes(spark, sf_dir):
    return tree.build_tree(items(spark, sf_dir))


# Tables of parts: one a brand, its parts as rows.
TABLES_SQL = """tabs AS (SELECT 'tab_' || p_brand AS node_id, 'Table ' || replace(p_brand, 'Brand#', '') || ': parts by price' AS caption, ['Part', 'Price (usd)', 'Size', 'Share %'] AS columns,
  list([p_name, printf('%.2f', p_retailprice), p_size::VARCHAR, (p_partkey % 100)::VARCHAR || '%'] ORDER BY p_partkey) AS rows_ FROM part GROUP BY p_brand)"""


def tables(spark, sf_dir):
    row = F.struct("p_partkey", F.array("p_name", F.format_string("%.2f", "p_retailprice"), F.col("p_size").cast("string"), F.concat((F.col("p_partkey") % 100).cast("string"), F.lit("%"))).alias("r"))
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"])
    out = table(spark, sf_dir, "part").groupBy("p_brand").agg(rows.alias("rows"))
    return out.select(F.lit("d").alias("doc_id"), F.concat(F.lit("tab_"), "p_brand").alias("node_id"), F.concat(F.lit("Table "), F.regexp_replace("p_brand", "Brand#", ""), F.lit(": parts by price")).alias("caption"), T.strings(["Part", "Price (usd)", "Size", "Share %"]).alias("columns"), "rows")


@FAMILY.add(
    f"""WITH {TABLES_SQL}, r AS (SELECT node_id, unnest(rows_) AS row_, generate_subscripts(rows_, 1) - 1 AS row_index FROM tabs)
SELECT node_id || ':row:' || row_index AS row_id, row_[1] AS row_label, 'Part=' || row_[1] || '; Price (usd)=' || row_[2] || '; Size=' || row_[3] || '; Share %=' || row_[4] AS dense_text, 'usd,%' AS units FROM r"""
)
def view_table_rows(spark, sf_dir):
    """Row records of tables of parts."""
    out = views.table_rows(tables(spark, sf_dir))
    return out.select("row_id", "row_label", "dense_text", F.array_join(F.filter(F.transform("cells", lambda c: c["unit"]), lambda u: u.isNotNull()), ",").alias("units"))


@FAMILY.add(
    f"""WITH {TABLES_SQL}, r AS (SELECT node_id, unnest(rows_) AS row_, generate_subscripts(rows_, 1) - 1 AS row_index FROM tabs),
w AS (SELECT node_id || ':row:' || row_index AS row_id, list_concat(regexp_extract_all(lower(row_[1]), '[a-z0-9][a-z0-9_\\-\\.%/]*'), ['part', 'price', 'usd', 'size', 'share', '%'], regexp_extract_all(lower(row_[2] || ' ' || row_[3] || ' ' || row_[4]), '[a-z0-9][a-z0-9_\\-\\.%/]*')) AS w FROM r)
SELECT row_id, len(list_distinct(w))::BIGINT AS n_tokens FROM w"""
)
def view_table_row_tokens(spark, sf_dir):
    """Number of distinct tokens of each row record; the unit of a percent value counts as one."""
    out = views.table_rows(tables(spark, sf_dir))
    return out.select("row_id", F.size("tokens").cast("long").alias("n_tokens"))


@FAMILY.add(
    f"""WITH RECURSIVE {TREE_SQL},
up AS (SELECT doc_id, node_id, node_id AS sec FROM nodes WHERE type = 'section' UNION ALL SELECT doc_id, node_id, parent_id FROM nodes WHERE parent_id IS NOT NULL UNION ALL SELECT u.doc_id, u.node_id, n.parent_id FROM up u JOIN nodes n ON n.doc_id = u.doc_id AND n.node_id = u.sec WHERE n.parent_id IS NOT NULL AND u.sec <> u.node_id),
m AS (SELECT up.doc_id, up.sec, n.* EXCLUDE (doc_id) FROM (SELECT DISTINCT * FROM up) up JOIN nodes n ON n.doc_id = up.doc_id AND n.node_id = up.node_id)
SELECT doc_id, sec AS node_id, min(page_idx)::BIGINT AS page_lo, max(page_idx)::BIGINT AS page_hi, count(*) FILTER (WHERE type = 'section') AS n_sections, count(*) FILTER (WHERE type = 'image') AS n_images, count(*) FILTER (WHERE type = 'text') AS n_paragraphs,
       arg_min(node_id, ord) FILTER (WHERE type = 'image') AS top_image, arg_min(node_id, ord) FILTER (WHERE type = 'text') AS top_paragraph FROM m GROUP BY ALL"""
)
def view_section_rollup(spark, sf_dir):
    """Subtree counts, spans and first members of sections."""
    out = views.section_rollup(nodes(spark, sf_dir))
    return out.select("doc_id", "node_id", F.col("page_lo").cast("long").alias("page_lo"), F.col("page_hi").cast("long").alias("page_hi"), "n_sections", "n_images", "n_paragraphs", "top_image", "top_paragraph")


@FAMILY.add(f"WITH {TREE_SQL} SELECT doc_id, s.node_id || v.mark AS node_id, v.variant AS variant, CASE WHEN v.variant = 'heading' THEN title END AS heading FROM nodes s, (VALUES ('heading', '#h'), ('gist', '#g'), ('child', '#c'), ('path', '#p')) v(variant, mark) WHERE type = 'section'")
def view_section_variants(spark, sf_dir):
    """Four dense variants of each section."""
    out = views.section_views(nodes(spark, sf_dir))
    return out.select("doc_id", "node_id", "variant", F.when(F.col("variant") == "heading", F.col("dense_text")).alias("heading"))


@FAMILY.add(
    f"""WITH {TREE_SQL}, kids AS (SELECT doc_id, parent_id AS node_id, string_agg(node_id, ',' ORDER BY ord) AS children FROM nodes WHERE parent_id IS NOT NULL GROUP BY ALL)
SELECT doc_id, node_id, title, children FROM nodes LEFT JOIN kids USING (doc_id, node_id) WHERE type = 'section'"""
)
def view_heading_children(spark, sf_dir):
    """Children of each section in order."""
    return views.heading_children(nodes(spark, sf_dir)).select("doc_id", "node_id", "title", F.array_join("children", ",").alias("children"))


@FAMILY.add(
    f"""WITH {TREE_SQL}, e AS (SELECT doc_id, parent_id AS src, node_id AS dst, 'child' AS type FROM nodes WHERE type = 'image' AND parent_id IS NOT NULL
  UNION ALL SELECT doc_id, node_id, lead(node_id) OVER (PARTITION BY doc_id, page_idx ORDER BY ord), 'prev_next' FROM nodes)
SELECT * FROM e WHERE dst IS NOT NULL"""
)
def view_edges(spark, sf_dir):
    """The graph of trees of lines."""
    return views.edges(nodes(spark, sf_dir)).select("doc_id", "src", "dst", "type")


@FAMILY.add(
    """
WITH img AS (SELECT 'img_' || s_suppkey AS node_id, 'Line chart of sales by ' || s_name || '; Y axis: 18.5 ms' AS caption, s_suppkey % 3 > 0 AS described FROM supplier)
SELECT node_id || ':figure_caption:0' AS span_id, 'figure_caption' AS role, caption AS dense_text, 'ms' AS units FROM img
UNION ALL SELECT node_id || ':figure_description:1', 'figure_description', 'A Bar Chart', '' FROM img WHERE described
UNION ALL SELECT node_id || ':figure_legend:' || (1 + described::INT), 'figure_legend', 'Series A', '' FROM img
UNION ALL SELECT node_id || ':axis_label:' || (2 + described::INT), 'axis_label', 'Year', '' FROM img"""
)
def view_figure_spans(spark, sf_dir):
    """Spans of images made from suppliers."""
    s = table(spark, sf_dir, "supplier")
    image = F.concat(F.lit("img_"), "s_suppkey")
    base = s.select(F.lit("d").alias("doc_id"), image.alias("node_id"), F.lit("sec_0").alias("parent_id"), (F.col("s_suppkey") * 2).alias("ord"), F.lit("image").alias("type"), F.lit(0).alias("page_idx"), F.lit(None).cast("string").alias("text"), F.when(F.col("s_suppkey") % 3 > 0, "A Bar Chart").alias("description"), F.array(F.lit("Series A")).alias("legend"), F.create_map(F.lit("x"), F.lit("Year")).alias("axis_labels"))
    caption = s.select(F.lit("d").alias("doc_id"), F.concat(F.lit("t_"), "s_suppkey").alias("node_id"), image.alias("parent_id"), (F.col("s_suppkey") * 2 + 1).alias("ord"), F.lit("text").alias("type"), F.lit(0).alias("page_idx"), F.concat(F.lit("Line chart of sales by "), "s_name", F.lit("; Y axis: 18.5 ms")).alias("text"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("array<string>").alias("legend"), F.lit(None).cast("map<string,string>").alias("axis_labels"))
    return views.figure_spans(base.unionByName(caption)).select("span_id", "role", "dense_text", F.array_join("units_set", ",").alias("units"))


@FAMILY.add("WITH p AS (SELECT c_custkey, (c_custkey % 40)::INT AS pg, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 40 + 5)::VARCHAR END AS lp FROM customer) SELECT DISTINCT 'c' || c_custkey AS node_id, unnest(list_filter([pg, pg + 1, lp::INT], lambda x: x IS NOT NULL))::BIGINT AS page FROM p")
def view_page_index(spark, sf_dir):
    """Pages under which nodes are found."""
    k = F.col("c_custkey") % 40
    rows = table(spark, sf_dir, "customer").select(F.lit("d").alias("doc_id"), F.concat(F.lit("c"), "c_custkey").alias("node_id"), k.cast("int").alias("page_idx"), F.when(F.col("c_custkey") % 3 == 0, (k + 5).cast("string")).alias("logical_page"))
    return views.page_index(rows).select("node_id", F.col("page").cast("long").alias("page"))


@FAMILY.add(
    """
WITH l AS (SELECT doc_id, 'first' AS modality, source AS content, 0 AS layer FROM documents UNION ALL SELECT doc_id, 'second', lang, 1 FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id::VARCHAR AS node_id, modality, content FROM l QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY layer DESC) = 1"""
)
def view_evidence_store(spark, sf_dir):
    """Evidence of several stores, later ones first."""
    docs = table(spark, sf_dir, "documents")
    row = lambda d, m, c: d.select(F.lit("x").alias("doc_id"), F.col("doc_id").cast("string").alias("node_id"), F.lit(m).alias("modality"), F.col(c).alias("content"))
    return views.evidence(row(docs, "first", "source"), row(docs.where("doc_id % 3 = 0"), "second", "lang")).select("node_id", "modality", "content")


_CHUNK_SQL = """
WITH RECURSIVE s AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents),
c AS (SELECT doc_id, s, 0 AS i, 0 AS start, least(600, length(s)) AS lim FROM s WHERE s <> ''
  UNION ALL SELECT doc_id, s, i + 1, greatest(fin - 80, 0), least(greatest(fin - 80, 0) + 600, length(s)) FROM (
    SELECT *, CASE WHEN lim < length(s) AND strpos(reverse(s[start + 361:lim]), ' ') > 0 THEN lim - strpos(reverse(s[start + 361:lim]), ' ') ELSE lim END AS fin FROM c) WHERE fin < length(s)),
e AS (SELECT *, CASE WHEN lim < length(s) AND strpos(reverse(s[start + 361:lim]), ' ') > 0 THEN lim - strpos(reverse(s[start + 361:lim]), ' ') ELSE lim END AS fin FROM c)
SELECT doc_id || '#c' || i AS node_id, trim(s[start + 1:fin]) AS raw_text FROM e"""


@FAMILY.add(_CHUNK_SQL)
def chunk_texts(spark, sf_dir):
    """Whole documents cut into overlapping chunks."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("node_id"), "text")
    return chunks.chunk_texts(docs).select("node_id", "raw_text")


@FAMILY.add("SELECT doc_id, (ord // 4)::INT AS block, sum(CASE WHEN trim(line) = '' THEN 0 ELSE len(regexp_split_to_array(trim(line), '\\s+')) END)::BIGINT AS word_count, count(*) AS element_count FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents) GROUP BY ALL")
def block_statistics(spark, sf_dir):
    """Words and elements of blocks of four lines."""
    rows = items(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.floor(F.col("ord") / 4).cast("int").alias("block"), "text", "type", "page_idx")
    return chunks.block_stats(rows).select("doc_id", "block", "word_count", "element_count")


# One unit after another: a chunk is given out when a unit turns the page or no longer fits, and its last whole units open the next one.
_SECTION_CHUNK_SQL = rf"""WITH RECURSIVE {TREE_SQL},
u AS (SELECT doc_id, coalesce(parent_id, 'root') AS section_id, row_number() OVER (PARTITION BY doc_id, coalesce(parent_id, 'root') ORDER BY ord) AS k, {{{{'t': t, 'id': node_id, 'p': page_idx}}}} AS u
      FROM (SELECT *, regexp_replace(text, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t FROM nodes WHERE type = 'text') WHERE t <> ''),
f AS (SELECT doc_id, section_id, k, [u] AS held, CASE WHEN false THEN [u] END AS out FROM u WHERE k = 1
  UNION ALL SELECT doc_id, section_id, k, list_append(CASE WHEN turned THEN [] WHEN full_ THEN held[len(held) - fits + 1:] ELSE held END, u), CASE WHEN turned OR full_ THEN held END
  FROM (SELECT *, NOT turned AND list_sum(list_transform(held, lambda x: length(x.t))) + length(u.t) > 1800 AS full_,
               list_max(list_filter(range(0, len(held) + 1), lambda n: coalesce(list_sum(list_transform(held[len(held) - n + 1:], lambda x: length(x.t) + 1)), 0) <= 300)) AS fits
        FROM (SELECT f.doc_id, f.section_id, u.k, f.held, u.u, f.held[-1].p IS DISTINCT FROM u.u.p AS turned FROM f JOIN u ON f.doc_id = u.doc_id AND f.section_id = u.section_id AND u.k = f.k + 1))),
c AS (SELECT doc_id, section_id, k, out AS c FROM f WHERE out IS NOT NULL UNION ALL SELECT doc_id, section_id, 1000000000, arg_max(held, k) FROM f GROUP BY ALL)
SELECT doc_id, section_id, (row_number() OVER (PARTITION BY doc_id, section_id ORDER BY k) - 1)::BIGINT AS chunk_idx, c[1].p::BIGINT AS page_idx, (3 + list_sum(list_transform(c, lambda x: length(x.t))) + len(c) - 1)::BIGINT AS n_chars, array_to_string(list_transform(c, lambda x: x.id), ',') AS ids FROM c"""


@FAMILY.add(_SECTION_CHUNK_SQL.replace("{{", "{").replace("}}", "}"))
def section_chunks(spark, sf_dir):
    """Retrieval chunks of the sections of all trees, with the ids of their units."""
    n = nodes(spark, sf_dir).where("type = 'text'")
    units = n.select("doc_id", F.coalesce("parent_id", F.lit("root")).alias("section_id"), F.lit("").alias("section_path"), "ord", "page_idx", "node_id", "text")
    out = chunks.section_chunks(units)
    return out.select("doc_id", "section_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.col("page_idx").cast("long").alias("page_idx"), F.length("text").cast("long").alias("n_chars"), F.array_join("source_node_ids", ",").alias("ids"))


# One leaf after another: a block of enough characters is given out when the next leaf comes.
_LEAF_BLOCK_SQL = f"""WITH RECURSIVE {TREE_SQL},
u AS (SELECT doc_id, coalesce(parent_id, 'root') AS sec, page_idx, row_number() OVER (PARTITION BY doc_id, coalesce(parent_id, 'root'), page_idx ORDER BY node_id) AS k, node_id AS id, coalesce(text, '') AS t FROM nodes WHERE type = 'text'),
f AS (SELECT doc_id, sec, page_idx, k, [t] AS held, [id] AS ids, length(t) AS n, CASE WHEN false THEN [t] END AS out, CASE WHEN false THEN [id] END AS out_ids FROM u WHERE k = 1
  UNION ALL SELECT f.doc_id, f.sec, f.page_idx, u.k, CASE WHEN f.n >= 280 THEN [u.t] WHEN u.t = '' THEN held ELSE list_append(held, u.t) END, CASE WHEN f.n >= 280 THEN [u.id] WHEN u.t = '' THEN ids ELSE list_append(ids, u.id) END,
    CASE WHEN f.n >= 280 THEN length(u.t) WHEN u.t = '' THEN f.n ELSE f.n + length(u.t) + 1 END, CASE WHEN f.n >= 280 THEN held END, CASE WHEN f.n >= 280 THEN ids END
  FROM f JOIN u ON f.doc_id = u.doc_id AND f.sec = u.sec AND f.page_idx = u.page_idx AND u.k = f.k + 1),
b AS (SELECT doc_id, sec, page_idx, k, array_to_string(list_filter(out, lambda x: x <> ''), ' ') AS t, out_ids AS ids FROM f WHERE out IS NOT NULL
  UNION ALL SELECT doc_id, sec, page_idx, 1000000000, array_to_string(list_filter(arg_max(held, k), lambda x: x <> ''), ' '), arg_max(ids, k) FROM f GROUP BY ALL),
p AS (SELECT *, list_transform(range(0, ceil(greatest(0, length(t) - 720) / 640)::BIGINT + 1), lambda i: substr(t, i * 640 + 1, 720)) AS pieces FROM b),
e AS (SELECT doc_id, sec, page_idx, k, ids, unnest(pieces) AS piece, unnest(range(len(pieces))) AS i, coalesce(nullif(list_position(list_transform(pieces, lambda x: NOT regexp_matches(x, '\\S')), true), 0), 1000000000) AS blank FROM p)
SELECT doc_id, sec AS parent_section, page_idx::BIGINT AS page_idx, (row_number() OVER (PARTITION BY doc_id, sec, page_idx ORDER BY k, i) - 1)::BIGINT AS block_idx, length(piece)::BIGINT AS n_chars, array_to_string(ids, ',') AS ids FROM e WHERE i + 1 < blank"""


@FAMILY.add(_LEAF_BLOCK_SQL)
def leaf_blocks(spark, sf_dir):
    """Raw leaf blocks of the sections and pages of all trees, with the ids of their leaves."""
    n = nodes(spark, sf_dir).where("type = 'text'")
    rows = n.select("doc_id", F.coalesce("parent_id", F.lit("root")).alias("parent_section"), "page_idx", "node_id", F.col("text").alias("raw_text"))
    out = chunks.leaf_blocks(rows)
    return out.select("doc_id", "parent_section", F.col("page_idx").cast("long").alias("page_idx"), F.col("block_idx").cast("long").alias("block_idx"), F.length("raw_text").cast("long").alias("n_chars"), F.array_join("source_ids", ",").alias("ids"))


# The greedy choice written out for three sentences: each takes the best of relevance less likeness to those before it.
_SUMMARY_SQL = rf"""
WITH parts AS (SELECT doc_id, trim(text) AS t, list_transform(regexp_split_to_array(regexp_replace(trim(text, ' '), '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))) AS p FROM documents),
kept AS (SELECT doc_id, CASE WHEN t = '' THEN [] WHEN len(list_filter(p, lambda x: length(x) >= 20)) = 0 THEN [t] ELSE list_filter(p, lambda x: length(x) >= 20)[:30] END AS s FROM parts),
s AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS i, len(s) AS n FROM kept),
tok AS (SELECT doc_id, i, n, unnest(regexp_extract_all(lower(s), '[a-z][a-z0-9_\-]+')) AS t FROM s),
size AS (SELECT doc_id, i, count(*) AS size FROM tok GROUP BY ALL),
tf AS (SELECT doc_id, i, n, t, count(*) AS tf FROM tok WHERE t NOT IN ({sql_list(T.STOPWORDS)}) GROUP BY ALL),
df AS (SELECT doc_id, t, count(*) AS df FROM tf GROUP BY ALL),
v AS (SELECT doc_id, i, t, tf * (1 + greatest(0, ln((1 + n) / (1 + df)))) AS x FROM tf JOIN df USING (doc_id, t)),
norm AS (SELECT doc_id, i, sqrt(sum(x * x)) AS norm, sum(x) AS total FROM v GROUP BY ALL),
r AS (SELECT s.doc_id, s.i, s.s, 0.75 * coalesce(total, 0) / greatest(5, coalesce(size, 0)) AS rel, coalesce(norm, 1.0) AS norm FROM s LEFT JOIN size USING (doc_id, i) LEFT JOIN norm USING (doc_id, i)),
c1 AS (SELECT doc_id, i, s, norm, s AS told FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(rel, 9) DESC, i) = 1),
d1 AS (SELECT a.doc_id, a.i, sum(a.x * b.x) AS dot FROM v a JOIN c1 ON a.doc_id = c1.doc_id JOIN v b ON b.doc_id = c1.doc_id AND b.i = c1.i AND b.t = a.t GROUP BY ALL),
r2 AS (SELECT r.*, coalesce(dot / (r.norm * c1.norm), 0) AS sim, c1.i AS i1, c1.told FROM r JOIN c1 USING (doc_id) LEFT JOIN d1 ON d1.doc_id = r.doc_id AND d1.i = r.i),
c2 AS (SELECT doc_id, i, norm, told || ' ' || s AS told FROM r2 WHERE i <> i1 AND length(told) < 360 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(rel - 0.25 * sim, 9) DESC, i) = 1),
d2 AS (SELECT a.doc_id, a.i, sum(a.x * b.x) AS dot FROM v a JOIN c2 ON a.doc_id = c2.doc_id JOIN v b ON b.doc_id = c2.doc_id AND b.i = c2.i AND b.t = a.t GROUP BY ALL),
r3 AS (SELECT r2.* EXCLUDE (sim, told), greatest(sim, coalesce(dot / (r2.norm * c2.norm), 0)) AS sim, c2.i AS i2, c2.told FROM r2 JOIN c2 USING (doc_id) LEFT JOIN d2 ON d2.doc_id = r2.doc_id AND d2.i = r2.i),
c3 AS (SELECT doc_id, told || ' ' || s AS told FROM r3 WHERE i <> i1 AND i <> i2 AND length(told) < 360 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(rel - 0.25 * sim, 9) DESC, i) = 1),
told AS (SELECT doc_id, coalesce(c3.told, c2.told, c1.told, '') AS told FROM kept LEFT JOIN c1 USING (doc_id) LEFT JOIN c2 USING (doc_id) LEFT JOIN c3 USING (doc_id))
SELECT doc_id, CASE WHEN length(told) <= 360 THEN trim(told) WHEN contains(told[:360], ' ') THEN trim(told[:360 - strpos(reverse(told[:360]), ' ')]) ELSE told[:360] END AS summary FROM told"""


@FAMILY.add(_SUMMARY_SQL)
def extractive_summaries(spark, sf_dir):
    """Sentences chosen by relevance and difference from every whole document's sentences."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return chunks.summarise_texts(docs, "s").select("doc_id", "summary")

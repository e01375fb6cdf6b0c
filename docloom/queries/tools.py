"""Queries of retrieval and extraction tools over tables of parts and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import tools
from docloom.queries.base import Family, table
from docloom.queries.views import TABLES_SQL, tables

FAMILY = Family()


@FAMILY.add(
    f"""WITH {TABLES_SQL}, r AS (SELECT node_id, unnest(rows_) AS row_, generate_subscripts(rows_, 1) - 1 AS i FROM tabs),
s AS (SELECT node_id, i, CASE WHEN NOT (contains(lower(row_[1]), 'widget') OR len(list_filter(row_, lambda c: contains(lower(c), 'widget'))) > 0) THEN 0.0
   ELSE CASE WHEN contains(lower(row_[1]), 'widget') THEN 3.0 ELSE 2.0 END + 2.0
     + CASE WHEN len(list_filter(row_, lambda c: contains(lower(c), 'price'))) > 0 THEN 1.5 ELSE 1.0 END + CASE WHEN len(list_filter(row_, lambda c: contains(lower(c), 'widget'))) > 0 THEN 1.5 ELSE 0 END END AS score FROM r)
SELECT node_id, round(least(1.0, max(score) / 5), 6)::DOUBLE AS score, count(*) FILTER (WHERE score > 0) AS n_rows FROM s GROUP BY node_id HAVING max(score) > 0"""
)
def table_search(spark, sf_dir):
    """Tables by row and column terms."""
    out = tools.table_search(tables(spark, sf_dir), columns=["price"], rows=["widget"])
    return out.select("node_id", F.round("score", 6).alias("score"), F.size("matched").cast("long").alias("n_rows"))


@FAMILY.add(f"WITH {TABLES_SQL} SELECT node_id, round(least(1.0, 3.0 / 5), 6)::DOUBLE AS score FROM tabs WHERE contains(lower(caption), 'table 1')")
def table_search_by_caption(spark, sf_dir):
    """Tables that match by caption alone."""
    out = tools.table_search(tables(spark, sf_dir), keywords=["table 1", "parts by price"])
    return out.where(F.lower("caption").contains("table 1")).select("node_id", F.round("score", 6).alias("score"))


@FAMILY.add(
    f"""WITH {TABLES_SQL}, r AS (SELECT node_id, unnest(rows_) AS row_, generate_subscripts(rows_, 1) - 1 AS i FROM tabs),
c AS (SELECT node_id, i, row_[1] AS label, unnest([2, 4]) AS idx, row_ FROM r)
SELECT node_id || ':r' || (i + 1) || 'c' || idx AS cell_id, label, regexp_replace(row_[idx], '%$', '')::DOUBLE AS value, CASE WHEN idx = 4 THEN '%' END AS unit FROM c"""
)
def extract_column(spark, sf_dir):
    """Cells of the price and percent columns."""
    return tools.extract_column(tables(spark, sf_dir), value_hints=["price"]).select("cell_id", "label", "value", "unit")


_TOKENS_SQL = "tk AS (SELECT 'd' || doc_id AS node_id, regexp_extract_all(lower(source || ' ' || lang || ' ' || text), '[a-z0-9]+') AS w, doc_id % 10 AS page_idx FROM documents), tok AS (SELECT node_id, page_idx, list_concat(w, list_transform(list_zip(w[:-2], w[2:]), lambda z: z[1] || '_' || z[2])) AS t FROM tk)"
_WANTED = tools.query_terms([*tools.query_terms(["src3 en", "the ofs"])])


def _figure_tokens(spark, sf_dir):
    words = T.tokens(F.concat_ws(" ", "source", "lang", "text"), T.PLAIN_TOKEN)
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("node_id"), T.with_bigrams(words).alias("tokens"), (F.col("doc_id") % 10).cast("int").alias("page_idx"))


def _bm25_sql(where: str) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf_{i}" for i, w in enumerate(_WANTED))
    parts = " + ".join(f"CASE WHEN tf_{i} > 0 THEN ln((n - df_{i} + 0.5) / (df_{i} + 0.5) + 1) * tf_{i} * 2.5 / (tf_{i} + 1.5 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END" for i in range(len(_WANTED)))
    df = ", ".join(f"count(*) FILTER (WHERE tf_{i} > 0) AS df_{i}" for i in range(len(_WANTED)))
    return f"""WITH {_TOKENS_SQL}, cand AS (SELECT * FROM tok WHERE {where}), cnt AS (SELECT node_id, len(t) AS dl, {tf} FROM cand), st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM cnt),
low AS (SELECT min(df) AS least FROM (SELECT w, count(DISTINCT node_id) AS df FROM (SELECT node_id, unnest(t) AS w FROM cand) GROUP BY w)),
sc AS (SELECT node_id, ({parts})::DOUBLE AS raw, ln((n - least + 0.5) / (least + 0.5) + 1) AS top FROM cnt, st, low)
SELECT node_id, round(raw, 6) AS raw, round(least(1.0, raw / (top + 1e-9)), 6) AS score FROM sc WHERE raw > 0 ORDER BY sc.raw DESC, node_id LIMIT 6"""


@FAMILY.add(_bm25_sql("true"))
def chart_search(spark, sf_dir):
    """Figures by BM25 over their tokens and token pairs."""
    return tools.chart_search(_figure_tokens(spark, sf_dir), keywords=["src3 en", "the ofs"]).select("node_id", F.round("raw", 6).alias("raw"), F.round("score", 6).alias("score"))


@FAMILY.add(_bm25_sql("page_idx IN (3, 4)"))
def chart_search_on_pages(spark, sf_dir):
    """The same on two pages, with their own statistics."""
    return tools.chart_search(_figure_tokens(spark, sf_dir), keywords=["src3 en", "the ofs"], pages=[3, 4]).select("node_id", F.round("raw", 6).alias("raw"), F.round("score", 6).alias("score"))


@FAMILY.add(
    """
WITH h AS (SELECT 'p' || p_partkey AS node_id, lower(trim(regexp_replace(p_name || ' ' || p_type, '\\s+', ' ', 'g'))) AS k FROM part),
s AS (SELECT node_id, (contains(k, 'red widget'))::INT + (contains(k, 'small economy'))::INT AS ph, (contains(k, 'red'))::INT + (contains(k, 'widget'))::INT + (contains(k, 'small'))::INT + (contains(k, 'economy'))::INT AS wd FROM h)
SELECT node_id, round(least(1.0, CASE WHEN ph > 0 THEN ph ELSE wd END / 2.0), 6)::DOUBLE AS score FROM s WHERE ph > 0 OR wd > 0"""
)
def locate_headings(spark, sf_dir):
    """Parts as headings, by phrases, else by words."""
    heads = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node_id"), F.concat_ws(" ", "p_name", "p_type").alias("heading"))
    return tools.locate_headings(heads, ["Red widget", "small  economy"]).select("node_id", F.round("score", 6).alias("score"))


@FAMILY.add(
    """
WITH m AS (SELECT doc_id, regexp_extract_all(text, '(?i)(licen[cs]ed?|token)') AS m, string_split_regex(text, '(?i)licen[cs]ed?|token') AS gap FROM documents),
e AS (SELECT doc_id, unnest(m) AS match, generate_subscripts(m, 1) AS i, m, gap FROM m)
SELECT doc_id::VARCHAR AS node_id, match, (list_sum(list_transform(gap[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0))::BIGINT AS start FROM e"""
)
def extract_regex(spark, sf_dir):
    """Matches in whole documents with their places."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("node_id"), "text")
    return tools.extract_regex(rows, "licen[cs]ed?|token").select("node_id", "match", F.col("start").cast("long").alias("start"))


@FAMILY.add(
    """
WITH t AS (SELECT s_suppkey::VARCHAR AS node_id, unnest(['Sales: ' || (s_suppkey * 1000)::VARCHAR || '%', 'Costs: ' || s_suppkey || '.50 pct', 'none']) AS line FROM supplier)
SELECT node_id, trim(regexp_extract(line, '^([A-Za-z]+)', 1)) AS label, regexp_extract(line, '(\\d+(?:\\.\\d+)?)', 1)::DOUBLE AS value, '%' AS unit FROM t WHERE line <> 'none'"""
)
def extract_series(spark, sf_dir):
    """Chart readings from descriptions."""
    k = F.col("s_suppkey")
    text = F.concat(F.lit("Sales: "), (k * 1000).cast("string"), F.lit("%; Costs: "), k.cast("string"), F.lit(".50 pct\nnone"))
    rows = table(spark, sf_dir, "supplier").select(k.cast("string").alias("node_id"), text.alias("text"))
    return tools.extract_series(rows).select("node_id", "label", "value", "unit")


@FAMILY.add(
    """
WITH t AS (SELECT s_suppkey::VARCHAR AS node_id, unnest(['Growth - ' || s_suppkey || '%', 'Year 2015: 1,' || (100 + s_suppkey)::VARCHAR]) AS line, unnest(['Growth', 'Year']) AS label, unnest([s_suppkey::DOUBLE, 2015]) AS value, unnest(['%', NULL]) AS unit FROM supplier)
SELECT node_id, label, value, unit, CASE WHEN contains(line, '2015') THEN 2015 END AS year FROM t"""
)
def extract_lines(spark, sf_dir):
    """Numbers in lines of plain text."""
    k = F.col("s_suppkey")
    text = F.concat(F.lit("Growth - "), k.cast("string"), F.lit("%\nYear 2015: 1,"), (100 + k).cast("string"))
    rows = table(spark, sf_dir, "supplier").select(k.cast("string").alias("node_id"), text.alias("text"))
    return tools.extract_lines(rows, years=[2015]).select("node_id", "label", "value", "unit", "year")


@FAMILY.add(
    """
WITH r AS (SELECT 'i' || c_custkey AS node_id, CASE WHEN c_custkey % 4 = 0 THEN 'A plot' ELSE 'photo' END AS caption FROM customer),
s AS (SELECT 'i' || o_custkey AS node_id, bool_or(o_orderpriority = '1-URGENT') AS axis FROM orders GROUP BY o_custkey)
SELECT node_id, CASE WHEN coalesce(axis, false) OR caption = 'A plot' THEN 1.0 ELSE 0.2 END::DOUBLE AS score FROM r LEFT JOIN s USING (node_id)"""
)
def screen_charts(spark, sf_dir):
    """Customers as regions, urgent orders as their axis labels."""
    rois = table(spark, sf_dir, "customer").select(F.concat(F.lit("i"), "c_custkey").alias("node_id"), F.when(F.col("c_custkey") % 4 == 0, "A plot").otherwise("photo").alias("caption"))
    spans = table(spark, sf_dir, "orders").select(F.concat(F.lit("i"), "o_custkey").alias("node_id"), F.lit(None).cast("string").alias("chart_type"), F.when(F.col("o_orderpriority") == "1-URGENT", "axis_label").otherwise("figure_ocr").alias("role"), F.lit("x").alias("dense_text"))
    return tools.screen_charts(rois, spans, only_positive=False).select("node_id", "score")


@FAMILY.add("SELECT 'c' || c_custkey AS node_id, 'graphics' AS evidence_type, c_nationkey::INT AS page_idx FROM customer WHERE c_custkey % 5 = 0 AND c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 100 = 0)")
def find_regions(spark, sf_dir):
    """Images on the pages of hits: customers whose id is divisible by 100."""
    nodes = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node_id"), F.when(F.col("c_custkey") % 5 == 0, "image").otherwise("text").alias("role"), F.col("c_nationkey").cast("int").alias("page_idx"), F.lit("").alias("label"), F.lit("").alias("caption"), "c_custkey")
    source = nodes.where("c_custkey % 100 = 0").select("node_id")
    return tools.find_regions(nodes, source=source).select("node_id", "evidence_type", "page_idx")


@FAMILY.add("SELECT 'c' || c_custkey AS node_id, CASE WHEN c_custkey % 5 = 0 THEN 'graphics' ELSE 'text' END AS evidence_type FROM customer WHERE c_nationkey IN (3, 7)")
def locate_pages(spark, sf_dir):
    """Nodes on two pages with their evidence types."""
    c = table(spark, sf_dir, "customer")
    index = c.select(F.concat(F.lit("c"), "c_custkey").alias("node_id"), F.col("c_nationkey").alias("page"))
    roles = c.select(F.concat(F.lit("c"), "c_custkey").alias("node_id"), F.when(F.col("c_custkey") % 5 == 0, "image").otherwise("paragraph").alias("role"))
    return tools.locate_pages(index, roles, [3, 7]).select("node_id", "evidence_type")

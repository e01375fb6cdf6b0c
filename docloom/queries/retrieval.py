"""Queries of search, fusion, expansion and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import graph, pack, retrieval, vector_index
from docloom.queries.base import Family, table

FAMILY = Family()
QUERY = "the nicht license und benchmark thanedble of"
_TERMS = retrieval.query_tokens(QUERY)


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("node_id"), F.col("source").alias("title"), F.col("text").alias("body"), F.when(F.col("lang") == "en", "section").otherwise("table").alias("role"), F.pmod("doc_id", F.lit(20)).cast("int").alias("page_idx"))


def _bm25f_sql(k: int, fields: dict[str, float], source: str = "d", name: str = "bm25f", roles: str = "true") -> str:
    tok = lambda f: f"regexp_extract_all(lower({f}), '[a-z0-9%.\\-]+')"
    count = lambda f, t: f"len(list_filter(t_{f}, lambda x: x = '{t}'))"
    distinct = list(dict.fromkeys(_TERMS))
    toks = ", ".join(f"{tok(f)} AS t_{f}" for f in fields)
    cols = ", ".join([f"len(t_{f}) AS n_{f}" for f in fields] + [f"{count(f, t)} AS tf_{f}_{i}" for f in fields for i, t in enumerate(distinct)])
    stats = ", ".join(["count(*) AS n"] + [f"avg(n_{f}) AS avg_{f}" for f in fields] + [f"count(*) FILTER (WHERE tf_{f}_{i} > 0) AS df_{f}_{i}" for f in fields for i in range(len(distinct))])
    parts = []
    for f, w in fields.items():
        for t in _TERMS:
            i = distinct.index(t)
            tf, df = f"tf_{f}_{i}", f"df_{f}_{i}"
            parts.append(f"CASE WHEN {tf} > 0 THEN {w} * ln((n - {df} + 0.5) / ({df} + 0.5) + 1.0) * ({tf} * 2.2) / ({tf} + 1.2 * (0.25 + 0.75 * n_{f} / CASE WHEN avg_{f} > 0 THEN avg_{f} ELSE 1.0 END)) ELSE 0.0 END")
    return f"""{name}_t AS (SELECT node_id, role, {toks} FROM {source}), {name}_c AS (SELECT node_id, role, {cols} FROM {name}_t), {name}_s AS (SELECT {stats} FROM {name}_c),
{name} AS (SELECT node_id, role, ({' + '.join(parts)})::DOUBLE AS score FROM {name}_c, {name}_s WHERE {roles} ORDER BY score DESC, node_id LIMIT {k})"""


_DOCS_SQL = "d AS (SELECT 'd' || doc_id AS node_id, source AS title, text AS body, CASE WHEN lang = 'en' THEN 'section' ELSE 'table' END AS role, (doc_id % 20)::INT AS page_idx FROM documents)"
_VECTOR = [((i * 37) % 11 - 5) / 7.0 for i in range(64)]
_VECTOR_SQL = "[" + ", ".join(f"{v!r}::DOUBLE" for v in _VECTOR) + "]"
_DENSE_SQL = f"v AS (SELECT 'v' || vec_id AS node_id, label % 3 AS role, embedding::DOUBLE[] AS e FROM embeddings), sims AS (SELECT node_id, role, list_dot_product(e, {_VECTOR_SQL}) / ((sqrt(list_dot_product(e, e)) + 1e-8) * ({sum(x * x for x in _VECTOR) ** 0.5!r} + 1e-8)) AS score FROM v)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id")).alias("node_id"), (F.col("label") % 3).alias("role"), "embedding")


@FAMILY.add(f"WITH {_DOCS_SQL}, {_bm25f_sql(200, {'title': 2.0, 'body': 1.0})} SELECT node_id, role, round(score, 6) AS score FROM bm25f WHERE score > 0")
def bm25f_search(spark, sf_dir):
    """Top 200 documents by BM25F over source and text."""
    return retrieval.bm25f(_docs(spark, sf_dir), QUERY, k=200).select("node_id", "role", F.round("score", 6).alias("score"))


@FAMILY.add(f"WITH {_DOCS_SQL}, {_bm25f_sql(50, {'title': 2.0, 'body': 1.0}, roles='role = ' + chr(39) + 'table' + chr(39))} SELECT node_id, round(score, 6) AS score FROM bm25f WHERE score > 0")
def bm25f_search_role(spark, sf_dir):
    """BM25F restricted to one role, with corpus statistics of all."""
    return retrieval.bm25f(_docs(spark, sf_dir), QUERY, k=50, roles=["table"]).select("node_id", F.round("score", 6).alias("score"))


@FAMILY.add(
    r"""
WITH p AS (SELECT doc_id, field, unnest(regexp_extract_all(lower(v), '[a-z0-9_\-]+')) AS term FROM (SELECT doc_id, 'title' AS field, source AS v FROM documents UNION ALL SELECT doc_id, 'body', text FROM documents))
SELECT field, term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY ALL"""
)
def bm25f_postings(spark, sf_dir):
    """Document and collection frequency of every term by field."""
    posted = retrieval.postings(_docs(spark, sf_dir), ["title", "body"])
    return retrieval.document_frequency(posted).select("field", "term", "df", "cf")


@FAMILY.add(
    r"""
SELECT field, count(*) AS n_docs, round(avg(n), 6) AS avg_len FROM (
  SELECT 'title' AS field, len(regexp_extract_all(lower(source), '[a-z0-9_\-]+')) AS n FROM documents UNION ALL SELECT 'body', len(regexp_extract_all(lower(text), '[a-z0-9_\-]+')) FROM documents) GROUP BY field"""
)
def bm25f_lengths(spark, sf_dir):
    """Average field lengths."""
    return retrieval.field_lengths(_docs(spark, sf_dir), ["title", "body"]).select("field", "n_docs", F.round("avg_len", 6).alias("avg_len"))


@FAMILY.add(f"WITH {_DENSE_SQL} SELECT node_id, role, round(score, 6) AS score FROM (SELECT * FROM sims ORDER BY score DESC, node_id LIMIT 100) WHERE role IN (0, 2)")
def dense_search(spark, sf_dir):
    """Top 100 vectors by cosine, roles filtered after the cut."""
    return retrieval.dense(_vectors(spark, sf_dir), _VECTOR, k=100, roles=[0, 2]).select("node_id", "role", F.round("score", 6).alias("score"))


@FAMILY.add(f"WITH {_DENSE_SQL} SELECT node_id, round(score, 6) AS score FROM sims WHERE role = 1 ORDER BY sims.score DESC, node_id LIMIT 20")
def dense_search_roles_first(spark, sf_dir):
    """Top 20 vectors of one role by cosine."""
    return retrieval.dense(_vectors(spark, sf_dir), _VECTOR, k=20, roles=[1], roles_first=True).select("node_id", F.round("score", 6).alias("score"))


@FAMILY.add(f"WITH v AS (SELECT 'v' || vec_id AS node_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT node_id, round(list_dot_product(e, {_VECTOR_SQL}) / sqrt(list_dot_product(e, e)) / {sum(x * x for x in _VECTOR) ** 0.5!r}, 6) AS score FROM v ORDER BY list_dot_product(e, {_VECTOR_SQL}) / sqrt(list_dot_product(e, e)) DESC, node_id LIMIT 8")
def inner_product_search(spark, sf_dir):
    """Top 8 by inner product of normalised vectors."""
    return retrieval.inner_product(_vectors(spark, sf_dir), _VECTOR).select("node_id", F.round("score", 6).alias("score"))


def _vector_queries(spark, sf_dir):
    """Every vector whose id is divisible by 100."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


_ALL_SQL = "v AS (SELECT 'v' || vec_id AS node_id, vec_id, label % 3 AS role, embedding::DOUBLE[] AS e FROM embeddings), pairs AS (SELECT q.vec_id AS query_id, v.node_id, v.role, round(list_dot_product(q.e, v.e) / ((sqrt(list_dot_product(q.e, q.e)) + {tiny}) * (sqrt(list_dot_product(v.e, v.e)) + {tiny})), 9) AS score FROM v q, v WHERE q.vec_id % 100 = 0), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS place FROM pairs WHERE {where})"


@FAMILY.add(f"WITH {_ALL_SQL.format(tiny='1e-8', where='true')} SELECT query_id, node_id, role, round(score, 6) AS score FROM placed WHERE place <= 100 AND role IN (0, 2)")
def dense_search_all(spark, sf_dir):
    """Top 100 vectors by cosine of every query row, roles filtered after the cut."""
    return retrieval.nearest(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), k=100, roles=[0, 2]).select("query_id", "node_id", "role", F.round("score", 6).alias("score"))


@FAMILY.add(f"WITH {_ALL_SQL.format(tiny='1e-8', where='true')} SELECT query_id, node_id, role, round(score, 6) AS score FROM placed WHERE place <= 50")
def vector_index_search_all(spark, sf_dir):
    """Top 50 vectors by cosine of every query row from lists by centroid: those most like it, then all that could hold a better one."""
    built = vector_index.build(_vectors(spark, sf_dir))
    return vector_index.search(built, _vector_queries(spark, sf_dir), k=50, probes=8, exact=True).select("query_id", "node_id", "role", F.round("score", 6).alias("score"))


@FAMILY.add(f"WITH {_ALL_SQL.format(tiny='1e-8', where='role = 1')} SELECT query_id, node_id, round(score, 6) AS score FROM placed WHERE place <= 20")
def dense_search_roles_first_all(spark, sf_dir):
    """Top 20 vectors of one role by cosine of every query row."""
    return retrieval.nearest(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), k=20, roles=[1], roles_first=True).select("query_id", "node_id", F.round("score", 6).alias("score"))


@FAMILY.add(f"WITH {_ALL_SQL.format(tiny='0.0', where='true')} SELECT query_id, node_id, round(score, 6) AS score FROM placed WHERE place <= 8")
def inner_product_search_all(spark, sf_dir):
    """Top 8 by inner product of normalised vectors of every query row."""
    return retrieval.nearest(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), k=8, measure="inner").select("query_id", "node_id", F.round("score", 6).alias("score"))


def _count_vector_hits(docs, k):
    """A second ranking of documents: cosine of their counts of the query's terms with all ones."""
    terms = list(dict.fromkeys(_TERMS))
    counts = docs.select("node_id", T.tokens(F.col("body"), T.SEARCH_TOKEN).alias("t")).select("node_id", F.array(*(F.size(F.filter("t", retrieval._is(x))).cast("double") for x in terms)).alias("c"))
    return retrieval.top_k(counts.select("node_id", F.round(retrieval.cosine(F.col("c"), retrieval.vector([1.0] * len(terms))), 9).alias("score")), k)


_COUNT_SQL = "cv AS (SELECT node_id, [{c}]::DOUBLE[] AS c FROM (SELECT node_id, regexp_extract_all(lower(body), '[a-z0-9%.\\-]+') AS t FROM d)), dense AS (SELECT node_id, round(list_sum(c) / ((sqrt(list_dot_product(c, c)) + 1e-8) * (sqrt({n}) + 1e-8)), 9) AS score FROM cv ORDER BY score DESC, node_id LIMIT 200)".format(c=", ".join(f"len(list_filter(t, lambda x: x = '{t}'))" for t in dict.fromkeys(_TERMS)), n=len(set(_TERMS)))
_RRF_SQL = "rd AS (SELECT node_id, row_number() OVER (ORDER BY score DESC, node_id) AS r FROM dense), rs AS (SELECT node_id, row_number() OVER (ORDER BY score DESC, node_id) AS r FROM sparse_), rrf AS (SELECT coalesce(rd.node_id, rs.node_id) AS node_id, 1.0::DOUBLE / (60 + coalesce(rd.r, 1000000)) + 1.0::DOUBLE / (60 + coalesce(rs.r, 1000000)) AS score FROM rd FULL JOIN rs ON rd.node_id = rs.node_id)"
_SPARSE = _bm25f_sql(200, {"body": 1.0})


def _fused(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    sparse = retrieval.bm25f(docs.drop("title"), QUERY, k=200).withColumn("score", F.round("score", 9))
    return docs, retrieval.rrf(_count_vector_hits(docs, 200), sparse)


@FAMILY.add(f"WITH {_DOCS_SQL}, {_SPARSE}, sparse_ AS (SELECT node_id, round(score, 9) AS score FROM bm25f WHERE score > 0), {_COUNT_SQL}, {_RRF_SQL} SELECT node_id, round(score, 9) AS score FROM rrf")
def rrf_fusion(spark, sf_dir):
    """Reciprocal-rank fusion of a lexical and a count-vector ranking."""
    return _fused(spark, sf_dir)[1].select("node_id", F.round("score", 9).alias("score"))


_PACK_SQL = """best AS (SELECT node_id, max(score) AS score, any_value(page_idx) AS page_idx FROM {hits} GROUP BY node_id),
placed AS (SELECT *, CASE WHEN page_idx IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY page_idx ORDER BY score DESC, node_id) END AS place FROM best),
keyed AS (SELECT *, 0.72 * score - CASE WHEN place > 1 THEN {pen!r} ELSE 0.0 END AS key FROM placed WHERE page_idx IS NULL OR place <= 2),
packed AS (SELECT * FROM keyed ORDER BY key DESC, score DESC, node_id LIMIT 40)""".format(hits="hits", pen=(1 - 0.72) * 0.35)


@FAMILY.add(f"WITH {_DOCS_SQL}, {_SPARSE}, sparse_ AS (SELECT node_id, round(score, 9) AS score FROM bm25f WHERE score > 0), {_COUNT_SQL}, {_RRF_SQL}, hits AS (SELECT rrf.node_id, round(rrf.score, 9) AS score, d.page_idx FROM rrf JOIN d USING (node_id)), {_PACK_SQL} SELECT row_number() OVER (ORDER BY key DESC, score DESC, node_id) AS rank, node_id, score FROM packed")
def hybrid_search(spark, sf_dir):
    """Hybrid document search: BM25, count vectors, fusion, page-diverse packing."""
    docs, fused = _fused(spark, sf_dir)
    hits = fused.select("node_id", F.round("score", 9).alias("score")).join(docs.select("node_id", "page_idx"), "node_id")
    packed = pack.mmr_pack(hits)
    from pyspark.sql import Window

    return packed.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("key"), F.desc("score"), "node_id")).cast("long")).select("rank", "node_id", "score")


@FAMILY.add(f"WITH hits AS (SELECT 'v' || vec_id AS node_id, label AS page_idx, round(embedding[1]::DOUBLE, 6) AS score FROM embeddings), {_PACK_SQL} SELECT node_id, page_idx, score FROM packed")
def mmr_pack(spark, sf_dir):
    """Packing of vectors by their first component, labels as pages."""
    hits = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id")).alias("node_id"), F.col("label").alias("page_idx"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("score"))
    return pack.mmr_pack(hits).select("node_id", "page_idx", "score")


def _edges(spark, sf_dir):
    """Region, nation, customer and order as a containment graph; customers of a nation share a page."""
    n = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    nation, customer, orders = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    out = nation.select(n("sec_r", "n_regionkey").alias("src"), n("sec_n", "n_nationkey").alias("dst"), F.lit("child").alias("type"))
    out = out.unionByName(customer.select(n("sec_n", "c_nationkey").alias("src"), n("img_c", "c_custkey").alias("dst"), F.lit("child").alias("type")))
    out = out.unionByName(customer.select(n("P", "c_nationkey").alias("src"), n("img_c", "c_custkey").alias("dst"), F.lit("same_page").alias("type")))
    return out.unionByName(orders.select(n("img_c", "o_custkey").alias("src"), n("tab_o", "o_orderkey").alias("dst"), F.lit("ref").alias("type")))


_EDGES_SQL = """edges AS (SELECT 'sec_r' || n_regionkey AS src, 'sec_n' || n_nationkey AS dst, 'child' AS type FROM nation
  UNION ALL SELECT 'sec_n' || c_nationkey, 'img_c' || c_custkey, 'child' FROM customer UNION ALL SELECT 'P' || c_nationkey, 'img_c' || c_custkey, 'same_page' FROM customer
  UNION ALL SELECT 'img_c' || o_custkey, 'tab_o' || o_orderkey, 'ref' FROM orders)"""
_HITS_SQL = "hits AS (SELECT 'sec_n' || n_nationkey AS node_id, 'section' AS role, (1.0 - n_nationkey / 100.0)::DOUBLE AS score FROM nation UNION ALL SELECT 'img_c' || c_custkey, 'image', (0.99 - c_custkey / 1000000.0)::DOUBLE FROM customer WHERE c_custkey % 100 = 0)"


def _graph_hits(spark, sf_dir):
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    a = nation.select(F.concat(F.lit("sec_n"), F.col("n_nationkey").cast("string")).alias("node_id"), F.lit("section").alias("role"), (F.lit(1.0) - F.col("n_nationkey") / 100.0).alias("score"))
    b = customer.where("c_custkey % 100 = 0").select(F.concat(F.lit("img_c"), F.col("c_custkey").cast("string")).alias("node_id"), F.lit("image").alias("role"), (F.lit(0.99) - F.col("c_custkey") / 1000000.0).alias("score"))
    return a.unionByName(b)


@FAMILY.add(
    f"""
WITH {_EDGES_SQL}, {_HITS_SQL}, seeds AS (SELECT *, row_number() OVER (ORDER BY score DESC, node_id) AS rank FROM hits QUALIFY rank <= 10),
reach AS (SELECT src AS origin, dst AS "to", type FROM edges UNION ALL SELECT dst, src, 'parent' FROM edges WHERE type IN ('child', 'parent')),
found AS (SELECT "to" AS node_id, CASE WHEN role <> 'section' THEN 'section' WHEN "to" LIKE 'img#_%' ESCAPE '#' THEN 'image' WHEN "to" LIKE 'tab#_%' ESCAPE '#' THEN 'table' ELSE 'section' END AS role, score * CASE WHEN role = 'section' THEN 0.6 ELSE 0.5 END AS score, rank, type
  FROM seeds JOIN reach ON origin = node_id WHERE (role = 'section' AND type IN ('child', 'same_page')) OR (role IN ('image', 'table') AND type IN ('parent', 'ref', 'same_page'))),
firsts AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY rank, type) = 1),
every AS (SELECT node_id, role, score FROM hits UNION ALL SELECT node_id, role, score FROM firsts WHERE node_id NOT IN (SELECT node_id FROM hits))
SELECT node_id, role, round(score, 6) AS score FROM every ORDER BY every.score DESC, node_id LIMIT 80"""
)
def graph_expansion(spark, sf_dir):
    """Neighbours of the ten best hits, discounted, in the best eighty."""
    return retrieval.graph_expand(_graph_hits(spark, sf_dir), _edges(spark, sf_dir)).select("node_id", "role", F.round("score", 6).alias("score"))


@FAMILY.add(
    f"""
WITH {_EDGES_SQL}, s AS (SELECT 'sec_n' || n_nationkey AS seed FROM nation UNION ALL SELECT 'img_c' || c_custkey FROM customer WHERE c_custkey % 100 = 0),
c AS (SELECT src, dst FROM edges WHERE type = 'child'), pg AS (SELECT src, dst FROM edges WHERE type = 'same_page'),
par AS (SELECT seed, src AS node_id FROM s JOIN c ON seed = dst),
every AS (SELECT seed, dst AS node_id, 0 AS p, 'child' AS relation FROM s JOIN c ON seed = src UNION ALL SELECT seed, node_id, 1, 'parent' FROM par UNION ALL SELECT seed, dst, 2, 'sibling' FROM par JOIN c ON par.node_id = c.src
  UNION ALL SELECT seed, b.dst, 3, 'same_page' FROM s JOIN pg a ON seed = a.dst JOIN pg b ON a.src = b.src)
SELECT seed, node_id, arg_min(relation, p) AS relation FROM every WHERE seed <> node_id GROUP BY ALL"""
)
def graph_neighbours(spark, sf_dir):
    """Children, parents, siblings and page mates of all nations, and of customers whose id is divisible by 100."""
    return graph.neighbours(_edges(spark, sf_dir), _graph_hits(spark, sf_dir)).select("seed", "node_id", "relation")


@FAMILY.add(
    f"""
WITH {_EDGES_SQL}, base AS (SELECT 'sec_n' || n_nationkey AS node_id FROM nation WHERE n_nationkey % 3 = 0),
out AS (SELECT src, dst FROM edges WHERE type = 'child' UNION ALL SELECT dst, src FROM edges WHERE type = 'child')
SELECT node_id, min(hop) AS hop FROM (SELECT node_id, 0 AS hop FROM base UNION ALL SELECT dst, 1 FROM base JOIN out ON node_id = src) GROUP BY node_id"""
)
def graph_expand_nodes(spark, sf_dir):
    """Nodes and what lies one edge below or above them."""
    base = table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select(F.concat(F.lit("sec_n"), F.col("n_nationkey").cast("string")).alias("node_id"))
    return graph.expand_nodes(_edges(spark, sf_dir), base, ["child", "parent"])


@FAMILY.add(
    """
WITH h AS (SELECT 'p' || p_partkey AS node_id, p_retailprice / 3000 AS score, CASE p_partkey % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'table' ELSE 'section' END AS role, 'Table ' || (p_partkey % 9) AS label, p_partkey % 4 = 0 AS comparable, p_partkey % 5 = 0 AS pct FROM part)
SELECT node_id, round(score + CASE WHEN contains('compare figure and table 7 by % rate', lower(label)) THEN 0.6 ELSE 0 END + CASE WHEN pct THEN 0.2 ELSE 0 END + CASE WHEN comparable THEN 0.2 ELSE 0 END + CASE WHEN role IN ('image', 'table') THEN 0.2 ELSE 0 END, 6) AS score
FROM h ORDER BY score + CASE WHEN contains('compare figure and table 7 by % rate', lower(label)) THEN 0.6 ELSE 0 END + CASE WHEN pct THEN 0.2 ELSE 0 END + CASE WHEN comparable THEN 0.2 ELSE 0 END + CASE WHEN role IN ('image', 'table') THEN 0.2 ELSE 0 END DESC, node_id LIMIT 40"""
)
def rerank(spark, sf_dir):
    """Additive re-ranking of parts posing as hits."""
    k = F.col("p_partkey")
    hits = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), k).alias("node_id"), (F.col("p_retailprice") / 3000).alias("score"), F.when(k % 3 == 0, "image").when(k % 3 == 1, "table").otherwise("section").alias("role"), F.concat(F.lit("Table "), (k % 9).cast("string")).alias("label"), F.when(k % 5 == 0, F.array(F.lit("%"))).alias("units"), (k % 4 == 0).alias("comparable"))
    return retrieval.rerank(hits, "Compare figure and table 7 by % rate").select("node_id", F.round("score", 6).alias("score"))


@FAMILY.add("SELECT label AS page, round(max(embedding[1]::DOUBLE), 6) AS score, arg_max('v' || vec_id, embedding[1]::DOUBLE) AS node_id, count(*) AS n_chunks FROM embeddings GROUP BY label ORDER BY max(embedding[1]::DOUBLE) DESC, label LIMIT 5")
def page_collapse(spark, sf_dir):
    """Vectors collapsed to labels by their best first component."""
    chunks = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id")).alias("node_id"), F.get("embedding", F.lit(0)).cast("double").alias("score"), "label")
    out = retrieval.page_collapse(chunks, page_col="label")
    return out.withColumn("score", F.round("score", 6))


@FAMILY.add(
    """
WITH chunks AS (SELECT 'e' || event_id AS node_id, 'u' || user_id || '_' || event_type AS parent_id, event_id % 3 = 0 AS hit, round(value, 6) + event_id / 1e7 AS score FROM events),
g AS (SELECT parent_id, count(*) AS n, count(*) FILTER (WHERE hit) AS h, avg(score) FILTER (WHERE hit) AS mean FROM chunks GROUP BY parent_id),
m AS (SELECT * FROM g WHERE h > 0 AND h / n > 0.35)
SELECT node_id, round(score, 6) AS score FROM (SELECT node_id, score FROM chunks WHERE hit AND parent_id NOT IN (SELECT parent_id FROM m) UNION ALL SELECT parent_id, mean FROM m) u ORDER BY u.score DESC, node_id LIMIT 400"""
)
def auto_merge(spark, sf_dir):
    """Events merged into their user and type where enough of them were hit."""
    chunks = table(spark, sf_dir, "events").select(F.concat(F.lit("e"), "event_id").alias("node_id"), F.concat(F.lit("u"), "user_id", F.lit("_"), "event_type").alias("parent_id"), (F.round("value", 6) + F.col("event_id") / 1e7).alias("score"), "event_id")
    return retrieval.auto_merge(chunks.where("event_id % 3 = 0").select("node_id", "score"), chunks, k=400).select("node_id", F.round("score", 6).alias("score"))


@FAMILY.add(
    """
WITH u AS (SELECT p_partkey, p_retailprice AS score FROM part WHERE p_size < 20 UNION ALL SELECT p_partkey, p_size * 50.0 FROM part WHERE p_size > 10)
SELECT 'p' || p_partkey AS node_id, max(score)::DOUBLE AS score FROM u GROUP BY p_partkey ORDER BY max(score) DESC, node_id LIMIT 100"""
)
def multi_query(spark, sf_dir):
    """Best score of each part over two searches."""
    part = table(spark, sf_dir, "part").withColumn("node_id", F.concat(F.lit("p"), "p_partkey"))
    a = part.where("p_size < 20").select("node_id", F.col("p_retailprice").alias("score"))
    b = part.where("p_size > 10").select("node_id", (F.col("p_size") * 50.0).alias("score"))
    return retrieval.multi_query([a, b], 100)


@FAMILY.add(
    """
WITH nodes AS (SELECT 'p' || p_partkey AS node_id, (p_size * 3)::INT AS page_idx FROM part), wanted AS (SELECT n_nationkey * 7 AS page FROM nation),
gaps AS (SELECT page, page_idx, row_number() OVER (PARTITION BY page ORDER BY abs(page_idx - page), page_idx) AS r FROM wanted, (SELECT DISTINCT page_idx FROM nodes))
SELECT page, page_idx, node_id, round(greatest(0.5, 1.0 - 0.1 * (row_number() OVER (PARTITION BY page ORDER BY node_id) - 1)), 6)::DOUBLE AS score FROM gaps JOIN nodes USING (page_idx) WHERE r = 1"""
)
def nearest_page(spark, sf_dir):
    """Parts on the page nearest to each wanted page."""
    nodes = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node_id"), (F.col("p_size") * 3).cast("int").alias("page_idx"))
    wanted = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 7).alias("page"))
    return retrieval.nearest_page(nodes, wanted).withColumn("score", F.round("score", 6))


@FAMILY.add(
    f"WITH {_DOCS_SQL}, {_bm25f_sql(30, {'body': 1.0})}, t AS (SELECT role FROM bm25f WHERE score > 0 ORDER BY score DESC, node_id LIMIT 20) SELECT count(*) < 10 OR count(*) FILTER (WHERE role = 'table') <= 2 AS weak FROM t"
)
def recall_diagnosis(spark, sf_dir):
    """Whether a search brought too little of what was asked for."""
    return retrieval.recall_weak(retrieval.bm25f(_docs(spark, sf_dir).drop("title"), QUERY, k=30), table=True)

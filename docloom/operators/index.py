"""Building and loading a document index: all views of all documents in one job each."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import html
from docloom.operators import chunks, retrieval, tree, views
from docloom.plans.executor import Catalog

SPARSE_FIELDS = ["title", "caption", "table_schema", "labels", "aliases", "body"]


def build_views(nodes: DataFrame, *, compat: bool = False, encode: Callable[[list[str]], list[list[float]]] | None = None) -> dict[str, DataFrame]:
    """Every view of trees (rows of ``build_tree`` with optional media columns), lazily.

    ``encode`` makes the vectors of the dense view from batches of texts; without it they are hashed bags of words.
    """
    leaves = nodes.where("type IN ('text', 'paragraph', 'list', 'equation')")
    leaf = chunks.chunk_texts(leaves.select("doc_id", "node_id", "page_idx", F.col("parent_id").alias("parent_section"), "text")).drop("text")
    full = views.with_columns(nodes, data="string")
    parsed = full.where("type = 'table'").select("doc_id", "node_id", "page_idx", "data", html.parse_table("data").alias("t"))
    tables = parsed.join(tree.captions(nodes), ["doc_id", "node_id"], "left").select("doc_id", "node_id", "page_idx", "caption", "t.columns", "t.rows")
    sparse = views.sparse_docs(nodes, compat=compat)
    spans = views.figure_spans(nodes)
    summary = views.summary_nodes(nodes)
    lists, list_stats = retrieval.posting_lists(sparse, SPARSE_FIELDS)
    figure_tokens = views.span_tokens(spans).join(nodes.select("doc_id", "node_id", "page_idx"), ["doc_id", "node_id"])
    return {
        "summary": summary,
        "dense_coarse": views.section_views(nodes),
        "dense_leaf": leaf,
        "sparse_coarse": sparse,
        "postings": retrieval.postings(sparse, SPARSE_FIELDS),
        "tables": tables,
        "table_rows": views.table_rows(tables),
        "figure_spans": spans,
        "figure_tokens": figure_tokens,
        "figure_terms": figure_tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df")),
        "dense": dense_view(summary, encode),
        "lists": lists,
        "list_stats": list_stats,
        "edges": views.edges(nodes, leaf),
        "heading_index": views.heading_index(nodes),
        "heading_children": views.heading_children(nodes),
        "id_maps": views.id_maps(summary),
        "page_index": views.page_index(nodes),
    }


#: Views that searches read by field and term, and small ones: not by document.
BY_FIELD, SMALL = ("postings", "lists"), ("list_stats", "figure_terms")


def write_index(nodes: DataFrame, path: str, *, compat: bool = False, encode: Callable[[list[str]], list[list[float]]] | None = None, buckets: int = 16, views: Sequence[str] | None = None) -> None:
    """Write all views (or those named) below ``path``; a rerun replaces them.

    Postings and posting lists lie by field, in order of their terms. All other views are bucketed by ``doc_id``, each
    bucket one file in order of it: a search of one document reads one bucket of each, and joins of views on their
    documents need no exchange. Buckets should hold a few hundred MB of the largest view; their number is written too.
    """
    from docloom.sources.io import write_bucketed, write_view

    for name, view in build_views(nodes, compat=compat, encode=encode).items():
        if views is not None and name not in views:
            continue
        if name in BY_FIELD or name in SMALL:
            write_view(view, f"{path}/{name}", by="field" if name in BY_FIELD else None)
        else:
            write_bucketed(view, f"{path}/{name}", "doc_id", buckets)
    layout = nodes.sparkSession.range(1).select(F.lit(buckets).alias("buckets"))
    layout.coalesce(1).write.mode("overwrite").json(f"{path}/layout")


def load_catalog(spark: SparkSession, path: str, *, doc_id: str | None = None, encode: Callable[[str], list[float]] | None = None) -> Catalog:
    """The catalog of a written index, of one document if asked.

    A node's key is its document and its id, in every table and in all hits. ``encode`` must be the encoder of the
    index for one text; without it, queries are hashed as the default view is. The statistics of posting lists and
    figures are those of the whole index; one document's searches scan its own bucket. Views that were not written are
    absent. Joins on the whole key can use the buckets once ``spark.sql.requireAllClusterKeysForCoPartition`` is false,
    which this sets.
    """
    from docloom.sources.io import exists, read_bucketed

    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    buckets = spark.read.schema("buckets int").json(f"{path}/layout").head()[0]
    there: dict[str, DataFrame | None] = {}

    def view(name: str) -> DataFrame | None:
        if name not in there:
            where = f"{path}/{name}"
            if not exists(spark, where):
                there[name] = None
            elif name in BY_FIELD or name in SMALL:
                there[name] = spark.read.parquet(where)
            else:
                df = read_bucketed(spark, where, "doc_id", buckets)
                there[name] = df if doc_id is None else df.where(F.col("doc_id") == doc_id)
        return there[name]

    def made(name: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
        return None if (df := view(name)) is None else make(df)

    texts = [t for t in (made("dense_leaf", lambda d: d.select("doc_id", "node_id", F.col("raw_text").alias("text"))), made("summary", lambda d: d.select("doc_id", "node_id", F.col("dense_text").alias("text")))) if t is not None]
    modality = F.when(F.col("role").isin("table", "image"), F.col("role")).otherwise("text")
    return Catalog(
        sparse=view("sparse_coarse"),
        dense=view("dense"),
        lists=view("lists") if doc_id is None else None,
        list_stats=view("list_stats"),
        figure_least=made("figure_terms", lambda d: d.agg(F.min("df").alias("least_df"))) if doc_id is None else None,
        tables=view("tables"),
        figure_tokens=view("figure_tokens"),
        figure_spans=view("figure_spans"),
        edges=view("edges"),
        children=made("heading_children", lambda d: d.select("doc_id", "node_id", F.explode("children").alias("child"))),
        headings=made("summary", lambda d: d.where("role = 'section'").select("doc_id", "node_id", F.col("title").alias("heading"))),
        page_index=view("page_index"),
        nodes=made("summary", lambda d: d.select("doc_id", "node_id", "role", "page_idx", "label", F.col("dense_text").alias("caption"))),
        texts=reduce(DataFrame.unionByName, texts) if texts else None,
        evidence=made("summary", lambda d: d.select("doc_id", "node_id", modality.alias("modality"), F.col("dense_text").alias("content"))),
        labels=made("id_maps", lambda d: d.where("kind = 'label'").select("doc_id", F.col("key").alias("label"), "node_id")),
        encode=encode or (lambda query: encode_query(spark, query)),
    )


def dense_view(summary: DataFrame, encode: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """Summary rows with ``embedding``: their dense text by an encoder, by default the hashed bag of words."""
    kept = [c for c in ("doc_id", "node_id", "role", "page_idx") if c in summary.columns]
    if encode is not None:
        return embed(summary.select(*kept, "dense_text"), encode).select(*kept, "embedding")
    return summary.select(*kept, F.transform(retrieval.hash_encode(F.col("dense_text")), lambda x: x.cast("float")).alias("embedding"))


def encode_query(spark: SparkSession, query: str, encode: Callable[[list[str]], list[list[float]]] | None = None) -> list[float]:
    """The vector of a query, by the same encoder as :func:`dense_view`."""
    if encode is not None:
        return [float(x) for x in encode([query])[0]]
    return list(spark.range(1).select(retrieval.hash_encode(F.lit(query))).head()[0])


def embed(rows: DataFrame, encode: Callable[[list[str]], list[list[float]]], *, text_col: str = "dense_text") -> DataFrame:
    """Add ``embedding``, normalised, by an encoder that takes batches of texts."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(encode([t or "" for t in batch])))

    raw = rows.withColumn("embedding", run(F.col(text_col)))
    return raw.withColumn("embedding", F.transform(retrieval.l2_normalise(F.col("embedding")), lambda x: x.cast("float")))


def bm25_pages(chunks_: DataFrame, query: str, *, k: int = 5) -> DataFrame:
    """Top k pages by BM25 over their whole text: ``node_id, doc_id, page_idx, score, why``.

    A page is one of its document; ``node_id`` is ``doc:page``. Without a ``doc_id`` column the chunks are one
    document's, and ``node_id`` is the page.
    """
    keys = [c for c in ("doc_id", "page_idx") if c in chunks_.columns]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]), " ")
    pages = chunks_.groupBy(*keys).agg(text.alias("body")).withColumn("node_id", F.concat_ws(":", *(F.col(c).cast("string") for c in keys)))
    hits = retrieval.bm25f(pages, query, weights={"body": 1.0}, k=k)
    return hits.join(pages.select("node_id", *keys), "node_id").select("node_id", *keys, "score", "why")

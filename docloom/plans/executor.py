"""Running plans: every step becomes a lazy DataFrame, so that a stage is one query for the optimiser.

Only a stage's coverage is computed between stages, because the next stage may depend on it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import compute, graph, lookup, pack, retrieval, tools
from docloom.operators.keys import doc, key, shared
from docloom.plans.ir import Node, Plan, Stage, chosen_steps, should_run
from docloom.session import stored

Tool = Callable[["Context", dict[str, Any]], DataFrame]


@dataclass
class Catalog:
    """The tables a plan can search; absent views are None.

    Tables of several documents have ``doc_id`` beside ``node_id``, all of them; then hits have it too.
    """

    sparse: DataFrame | None = None
    dense: DataFrame | None = None
    tables: DataFrame | None = None
    figure_tokens: DataFrame | None = None
    figure_spans: DataFrame | None = None
    edges: DataFrame | None = None
    children: DataFrame | None = None
    headings: DataFrame | None = None
    page_index: DataFrame | None = None
    nodes: DataFrame | None = None
    texts: DataFrame | None = None
    evidence: DataFrame | None = None
    labels: DataFrame | None = None
    encode: Callable[[str], list[float]] | None = None
    #: Posting lists and their statistics (``retrieval.posting_lists``); lexical search reads them if they are there.
    lists: DataFrame | None = None
    list_stats: DataFrame | None = None
    #: ``least_df`` of the figures' tokens.
    figure_least: DataFrame | None = None
    #: Image bytes by node (node_id, content), and a model that looks at one: (question, content) to answer, confidence, thinking.
    images: DataFrame | None = None
    look: Callable[[str, bytes], dict] | None = None
    #: Reorders hits (node_id, role, score) of a search step for its query.
    rank: Callable[[str, DataFrame], DataFrame] | None = None


@dataclass
class Context:
    catalog: Catalog
    results: dict[str, DataFrame] = field(default_factory=dict)

    def source(self, args: dict[str, Any]) -> DataFrame:
        """Rows of an earlier step, or of the node ids that ``source`` or ``node_ids`` list."""
        named = args.get("source")
        if isinstance(named, str) and named in self.results:
            return self.results[named]
        ids = args.get("node_ids") or ([named] if isinstance(named, str) else named)
        if not ids:
            raise KeyError(f"no step has saved {named!r}")
        if (nodes := self.catalog.nodes) is not None and doc(nodes):  # the nodes of these ids in every document
            return nodes.where(F.col("node_id").isin(*map(str, ids))).select("doc_id", "node_id", F.lit(1.0).alias("score")).distinct()
        spark = next(t for t in vars(self.catalog).values() if isinstance(t, DataFrame)).sparkSession
        return spark.createDataFrame([(str(i), 1.0) for i in dict.fromkeys(ids)], "node_id string, score double")


class Registry:
    """Tools by operation name."""

    def __init__(self) -> None:
        self._tools: dict[str, Tool] = {}

    def register(self, name: str, tool: Tool, *, replace: bool = False) -> None:
        if name in self._tools and not replace:
            raise ValueError(f"{name} is registered already")
        self._tools[name] = tool

    def register_all(self, tools: dict[str, Tool]) -> None:
        for name, tool in tools.items():
            self.register(name, tool)

    def get(self, name: str) -> Tool:
        return self._tools[name]

    def names(self) -> list[str]:
        return sorted(self._tools)


def _eval(ctx: Context, a: dict[str, Any]) -> DataFrame:
    rows = ctx.source(a)
    if "ord" not in rows.columns:
        rows = rows.withColumn("ord", F.lit(0))
    return compute.evaluate(compute.numeric_records(rows, a.get("field", "value")), a.get("operation", "sum"), scale=a.get("scale"), digits=a.get("round"))


def _filter(ctx: Context, a: dict[str, Any]) -> DataFrame:
    rows = ctx.source(a)
    if a.get("comparator") == "rank" or a.get("operation") == "rank":
        return compute.rank(rows, int(a["rank"]), unit=a.get("unit"), year=a.get("year"))
    return compute.compare(rows, float(a["threshold"]), a.get("comparator"), unit=a.get("unit"), year=a.get("year"))


def _column(ctx: Context, a: dict[str, Any]) -> DataFrame:
    hits = ctx.source(a)
    tables = ctx.catalog.tables.join(hits, shared(ctx.catalog.tables, hits), "left_semi")
    allowed = hits.select(*key(hits), F.explode("matched").alias("m")).select(*key(hits), F.col("m.row_index").alias("row_index")) if "matched" in hits.columns else None
    return tools.extract_column(tables, value_hints=a.get("value_hints", ()), label_hints=a.get("label_hints", ()), unit=a.get("unit"), years=a.get("years", ()), allowed=allowed)


def _texts(ctx: Context, a: dict[str, Any]) -> DataFrame:
    hits = ctx.source(a)
    return ctx.catalog.texts.join(hits, shared(ctx.catalog.texts, hits), "left_semi")


def _pack(ctx: Context, a: dict[str, Any]) -> DataFrame:
    hits = ctx.source(a)
    if "page_idx" not in hits.columns:
        pages = ctx.catalog.nodes.select(*key(ctx.catalog.nodes), "page_idx") if ctx.catalog.nodes is not None else None
        hits = hits.join(pages, shared(hits, pages), "left") if pages is not None else hits.withColumn("page_idx", F.lit(None).cast("int"))
    return pack.mmr_pack(hits.select(*key(hits), "page_idx", "score"), limit=a.get("limit"), per_page=a.get("per_page_limit", 2), trade=a.get("lambda", 0.72))


def _dense(ctx: Context, a: dict[str, Any]) -> DataFrame:
    if ctx.catalog.dense is None:
        raise ValueError("the catalog has no vectors")
    return retrieval.dense(ctx.catalog.dense, a.get("vector") or ctx.catalog.encode(a["query"]), k=a.get("k", 20), roles=a.get("roles"))


def _sparse(ctx: Context, a: dict[str, Any]) -> DataFrame:
    if ctx.catalog.lists is not None:
        return retrieval.bm25f_lists(ctx.catalog.lists, ctx.catalog.list_stats, a["query"], roles=a.get("roles"), k=a.get("k", 20))
    return retrieval.bm25f(ctx.catalog.sparse, a["query"], roles=a.get("roles"), k=a.get("k", 20))


def _hybrid(ctx: Context, a: dict[str, Any]) -> DataFrame:
    wide = {**a, "k": 5 * a.get("k", 20)}  # more than is wanted, since fusion reorders
    return retrieval.top_k(retrieval.rrf(_dense(ctx, wide), _sparse(ctx, wide)), a.get("k", 20))


def _ranked(search: Tool) -> Tool:
    """A search whose hits the catalog's ranker puts in order, if there is one."""

    def run(ctx: Context, a: dict[str, Any]) -> DataFrame:
        hits = search(ctx, a)
        return hits if ctx.catalog.rank is None else retrieval.top_k(ctx.catalog.rank(a["query"], hits), a.get("k", 20))

    return run


def _look(ctx: Context, a: dict[str, Any]) -> DataFrame:
    """One row ``answer, confidence, thinking, n_images`` of a model that looks at the images of the hits, in their order."""
    question, look = " ".join(str(a.get("question") or "").split()), ctx.catalog.look
    if not question:
        raise ValueError("a question is required")
    if look is None or ctx.catalog.images is None:
        raise ValueError("the catalog has no images, or no model for them")
    hits = ctx.source(a)
    score = F.max("score") if "score" in hits.columns else F.lit(0.0)
    own = shared(hits, ctx.catalog.images)
    wanted = retrieval.ranked(hits.groupBy(*own).agg(score.alias("score"))).select(*own, F.col("rank").alias("ord"))
    rows = ctx.catalog.images.select(*own, "content").join(wanted, own).select("ord", "content")

    def run(batches):
        import pandas as pd

        for batch in batches:
            said = [look(question, bytes(c)) if c is not None else {} for c in batch["content"]]
            yield pd.DataFrame({"ord": batch["ord"], "answer": [str(s.get("answer") or "") for s in said], "confidence": [float(s.get("confidence") or 0.0) for s in said], "thinking": [s.get("thinking") for s in said]})

    told = stored(rows.mapInPandas(run, "ord int, answer string, confidence double, thinking string"), "told")  # each image once
    count = told.agg(F.count("*").alias("n_images"))
    return lookup.combine_answers(told.where("answer <> ''")).crossJoin(F.broadcast(count))  # one row each


def default_registry() -> Registry:
    """All tools; ``vlm.answer`` needs the catalog's model."""
    r = Registry()
    r.register_all(
        {
            "bm25_node.search": _ranked(_sparse),
            "dense_node.search": _ranked(_dense),
            "hybrid.search": _ranked(_hybrid),
            "vlm.answer": _look,
            "table_index.search": lambda c, a: tools.table_search(c.catalog.tables, columns=a.get("columns", ()), rows=a.get("rows", ()), keywords=a.get("keywords", ()), query=a.get("query"), unit=a.get("unit"), years=a.get("years", ())),
            "chart_index.search": lambda c, a: tools.chart_search(c.catalog.figure_tokens, keywords=a.get("keywords", ()), units=a.get("units", ()), years=a.get("years", ()), chart_types=a.get("chart_types", ()), pages=a.get("pages", ()), k=a.get("top_k", 6), least_df=c.catalog.figure_least),
            "toc_anchor.locate": lambda c, a: tools.locate_headings(c.catalog.headings, a.get("keywords", ())),
            "page_locator.locate": lambda c, a: tools.locate_pages(c.catalog.page_index, c.catalog.nodes, a.get("pages")),
            "figure_finder.find_regions": lambda c, a: tools.find_regions(c.catalog.nodes, source=c.results.get(a.get("source")), pages=a.get("pages"), kinds=a.get("kinds", ("image",)), label=a.get("label")),
            "chart_screener.screen": lambda c, a: tools.screen_charts(c.source(a), c.catalog.figure_spans, only_positive=a.get("only_positive", True)),
            "structure.expand": lambda c, a: graph.expand_hits(c.catalog.edges, c.catalog.children, c.source(a), include_self=bool(a.get("include_self"))),
            "structure.children": lambda c, a: graph.children_hits(c.catalog.edges, c.source(a), role=a.get("role"), roles=c.catalog.nodes),
            "extract.column": _column,
            "extract.chart_read_axis": lambda c, a: tools.extract_series(_texts(c, a)),
            "extract.regex": lambda c, a: tools.extract_regex(_texts(c, a), a["pattern"]),
            "compute.filter": _filter,
            "compute.eval": _eval,
            "pack.mmr_knapsack": _pack,
        }
    )
    return r


@dataclass
class Outcome:
    """A step's result: its lazy rows, or what went wrong."""

    name: str
    status: str
    rows: DataFrame | None = None
    error: str | None = None
    attempts: int = 1
    seconds: float = 0.0


class Executor:
    """Runs steps with retries; an unknown tool is an error of the caller, any other a failed outcome."""

    def __init__(self, registry: Registry | None = None, *, retries: int = 1):
        self.registry, self.retries = registry or default_registry(), retries

    def run(self, ctx: Context, node: Node) -> Outcome:
        tool = self.registry.get(node.op)
        args = dict(node.args)
        if node.uses:
            args.setdefault("source", node.uses[0])
        began, error = time.monotonic(), None
        for attempt in range(1, self.retries + 2):
            try:
                rows = tool(ctx, args)
            except Exception as e:  # a failed tool is an outcome that the plan can go on from
                error = f"{type(e).__name__}: {e}"
                continue
            ctx.results[node.save_as or node.op] = rows
            return Outcome(node.save_as or node.op, "ok", rows, None, attempt, time.monotonic() - began)
        return Outcome(node.save_as or node.op, "error", None, error, self.retries + 1, time.monotonic() - began)

    def run_stage(self, ctx: Context, stage: Stage) -> list[Outcome]:
        return [self.run(ctx, node) for node in chosen_steps(stage)]


def run_plan(plan: Plan, catalog: Catalog, executor: Executor | None = None, *, enough: float = 0.75) -> tuple[DataFrame | None, dict[str, list[Outcome]]]:
    """Run stages until one covers enough; returns the rows that cover most, and all outcomes by stage.

    A stage's coverage is the number of its distinct nodes over ``k_nodes``, at most 1; it is known to
    the next stage as ``prev_coverage``.
    """
    executor, ctx = executor or Executor(), Context(catalog)
    facts: dict[str, float] = {"prev_coverage": 0.0}
    outcomes: dict[str, list[Outcome]] = {}
    best, most = None, -1.0
    for i, stage in enumerate(plan.stages):
        if not should_run(stage.run_if, facts):
            continue
        outcomes[stage.name] = executor.run_stage(ctx, stage)
        rows = next((o.rows for o in reversed(outcomes[stage.name]) if o.status == "ok"), None)
        if rows is None:
            continue
        if not key(rows):  # a computed or told value covers the question
            covered = 1.0
        elif i + 1 < len(plan.stages) or best is not None:
            rows = stored(rows, "stage")  # its coverage and its rows come from one run
            covered = pack.coverage(rows, stage.k_nodes).head()[0] or 0.0
        else:
            covered = 0.0
        facts["prev_coverage"] = covered
        if covered > most:
            best, most = rows, covered
        if covered >= enough:
            break
    return best, outcomes


def execute_policy(policy: dict, catalog: Catalog) -> DataFrame:
    """Hits of a retrieval policy (see :func:`docloom.plans.router.policy`)."""
    ctx, k = Context(catalog), policy["k"]
    match policy["strategy"]:
        case "direct_label":
            found = retrieval.lookup_label(catalog.labels, policy["labels"][0]).withColumn("score", F.lit(1.0))
        case "direct_page":
            found = tools.locate_pages(catalog.page_index, catalog.nodes, policy["pages"])
        case "sparse" | "leaf":
            found = _sparse(ctx, policy)
        case "dense":
            found = _dense(ctx, policy)
        case "heading":
            found = retrieval.top_k(tools.locate_headings(catalog.headings, policy["keywords"]), k)
        case _:
            found = _hybrid(ctx, policy)
    return found.select(*key(found), "score")


def stub_catalog(spark: SparkSession, pairs: list[tuple[str, str]], *, role: str = "paragraph") -> Catalog:
    """A catalog of (node_id, text) pairs alone, for tests and small uses."""
    rows = spark.createDataFrame([(str(n), str(t)) for n, t in pairs], "node_id string, text string")
    named = rows.withColumn("role", F.lit(role))
    return Catalog(
        sparse=named.withColumnRenamed("text", "body"),
        nodes=named.select("node_id", "role", F.lit(None).cast("int").alias("page_idx"), F.lit(None).cast("string").alias("label"), F.col("text").alias("caption")),
        texts=rows,
        evidence=rows.select("node_id", F.lit("text").alias("modality"), F.col("text").alias("content")),
    )

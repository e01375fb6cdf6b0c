"""Retrieval and extraction tools over the index views.

Tools return hits: ``node_id, evidence_type, modality, score`` and columns of their own, with ``doc_id`` where the
tables they search are of several documents (:mod:`docloom.operators.keys`). Search terms are
driver-side literals; what they are compared with are columns.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import retrieval
from docloom.operators.keys import doc, key, shared

NUMBER = r"-?\d[\d,]*(?:\.\d+)?"
# Evidence type and modality by role.
EVIDENCE = {"image": "graphics", "figure": "graphics", "chart": "graphics", "table": "table", "section": "layout", "heading": "layout"}
MODALITY = {"image": "image", "figure": "image", "chart": "chart", "table": "table"}


def terms(value) -> list[str]:
    """Argument values as distinct trimmed lower-cased terms."""
    values = [value] if isinstance(value, str) else list(value or [])
    return list(dict.fromkeys(v.strip().lower() for v in values if isinstance(v, str) and v.strip()))


def query_terms(value) -> list[str]:
    """Terms as tokens, adjacent pairs and naive stems."""
    out: list[str] = []
    for term in terms(value):
        words = re.findall(T.PLAIN_TOKEN, term)
        out += words + [f"{a}_{b}" for a, b in zip(words, words[1:], strict=False)] + [stem(w) for w in words]
    return list(dict.fromkeys(out))


def stem(word: str) -> str:
    """Naive plural stem of one word; the Column form is :func:`docloom.functions.text.simple_stem`."""
    for end, put in (("ies", "y"), ("es", ""), ("s", "")):
        if word.endswith(end) and len(word) > 3:
            return word[: -len(end)] + put
    return word


def by_role(mapping: dict[str, str], role: Column, default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in mapping.items() for x in p)), role), F.lit(default))


def clamp(score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def shape_hits(rows: DataFrame, *, view: str | None = None) -> DataFrame:
    """Hits of one shape from (node_id, role, score): evidence type and modality by role or view, score in 0..1."""
    role = F.col("role") if view is None else F.lit(view)
    return rows.select(*key(rows), by_role(EVIDENCE, role, "text").alias("evidence_type"), by_role(MODALITY, role, "text").alias("modality"), clamp(F.coalesce("score", F.lit(0.0))).alias("score"))


def _any(cells: Column, term: str) -> Column:
    return F.exists(cells, lambda c: F.contains(c, F.lit(term)))


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def row_score(cells: Column, columns: Column, *, column_terms=(), row_terms=(), keywords=(), units=(), years=()) -> Column:
    """Score of a table row (lower-cased cells and columns).

    Row terms 3 in the label or 2 in a cell; column terms 2; keywords 1.5 in the row or 1 in a column;
    units and years 1 each. Asked units, years or row terms that are nowhere make it 0.
    """
    label = F.coalesce(F.get(cells, F.lit(0)), F.lit(""))
    rows = [F.when(label.contains(t), 3.0).when(_any(cells, t), 2.0).otherwise(0.0) for t in row_terms]
    cols = [F.when(_any(columns, t), 2.0).otherwise(0.0) for t in column_terms]
    keys = [F.when(_any(cells, t), 1.5).when(_any(columns, t), 1.0).otherwise(0.0) for t in keywords]
    need = []
    for group in (units, years):
        if group:
            need.append(reduce(lambda a, b: a | b, [_any(cells, t) | _any(columns, t) for t in group]))
    if row_terms:
        need.append(_sum(rows) > 0)
    score = _sum(rows + cols + keys) + float(bool(units)) + float(bool(years))
    return F.when(reduce(lambda a, b: a & b, need, F.lit(True)), score).otherwise(0.0)


def table_score(caption: Column, columns: Column, *, column_terms=(), keywords=(), units=(), years=()) -> Column:
    """Score of a table by its caption and columns alone."""
    cols = [F.when(_any(columns, t), 2.0).otherwise(0.0) for t in column_terms]
    keys = [F.when(caption.contains(t) | _any(columns, t), 1.5).otherwise(0.0) for t in keywords]
    groups = [F.when(reduce(lambda a, b: a | b, [_any(columns, t) for t in g]), 1.0).otherwise(0.0) for g in (units, years) if g]
    return _sum(cols + keys + groups)


def table_search(tables: DataFrame, *, columns=(), rows=(), keywords=(), query: str | None = None, unit: str | None = None, years=()) -> DataFrame:
    """Tables (node_id, caption, columns, rows) with the rows that match.

    A table scores its best row over 5, at most 1. Without row terms, a table without matching rows may
    match by caption and columns. ``matched`` lists (row_index, row_label, score).
    """
    asked_rows = terms(rows)
    column_terms = terms(columns)
    keys = list(dict.fromkeys([*terms(keywords), *terms(query), *column_terms, *asked_rows]))
    units, year_terms = terms(unit), [str(y) for y in years]
    lower = lambda a: F.transform(a, lambda c: F.lower(T.text(c)))
    args = dict(column_terms=column_terms, keywords=keys, units=units, years=year_terms)
    scored = F.transform("rows", lambda r, i: F.struct(i.alias("row_index"), F.get(r, F.lit(0)).alias("row_label"), row_score(lower(r), lower(F.col("columns")), row_terms=asked_rows, **args).alias("score")))
    found = tables.select(*key(tables), "caption", "columns", F.filter(scored, lambda s: s["score"] > 0).alias("matched"))
    by_table = F.lit(0.0) if asked_rows else table_score(F.lower(T.text(F.col("caption"))), lower(F.col("columns")), **args)
    best = F.coalesce(F.array_max(F.transform("matched", lambda m: m["score"])), by_table)
    return found.withColumn("best", best).where("best > 0").select(*key(tables), F.lit("table").alias("evidence_type"), F.lit("table").alias("modality"), F.least(F.lit(1.0), F.col("best") / 5.0).alias("score"), "caption", "columns", "matched")


def chart_search(tokens: DataFrame, *, keywords=(), units=(), years=(), chart_types=(), pages=(), parent: str | None = None, k: int = 6, meta: DataFrame | None = None, least_df: DataFrame | None = None) -> DataFrame:
    """Figures by BM25 over their span tokens (node_id, tokens, page_idx).

    Pages, if any figure is on them, narrow the corpus before its statistics are taken. Terms are
    tokenised, stemmed, and tokenised once more, as the indexed side expects. ``parent`` narrows the hits to a
    section's figures (``meta``: node_id, parent_section); ``least_df`` is the whole corpus's, from its index.
    """
    wanted = query_terms([*query_terms(keywords), *query_terms(units), *[str(y) for y in years], *query_terms(chart_types)])
    candidates = tokens
    if pages:
        on_page = F.col("page_idx").isin(*[int(p) for p in pages])
        any_there = tokens.agg(F.coalesce(F.bool_or(on_page), F.lit(False)).alias("__any"))
        candidates = tokens.crossJoin(F.broadcast(any_there)).where(on_page | ~F.col("__any")).drop("__any")  # one row
    among = None if parent is None else meta.where(F.col("parent_section") == parent)
    return retrieval.bm25_tokens(candidates, wanted, k=k, among=among, least_df=None if pages else least_df)


def figure_metadata(images: DataFrame, spans: DataFrame) -> DataFrame:
    """Images with caption and chart type of their own, else of their first spans, and their span roles."""
    first = lambda c, cond: F.min_by(F.when(cond, F.col(c)), F.when(cond, F.col("ord")))
    held = spans.groupBy(*shared(images, spans)).agg(first("dense_text", F.col("role") == "figure_caption").alias("span_caption"), first("chart_type", F.col("chart_type").isNotNull()).alias("span_type"), F.array_sort(F.collect_set("role")).alias("span_roles"))
    return images.join(held, shared(images, held), "left").withColumn("caption", F.coalesce("caption", "span_caption")).withColumn("chart_type", F.coalesce("chart_type", "span_type")).drop("span_caption", "span_type")


def heading_score(heading: Column, keywords: list[str]) -> Column:
    """Whole phrases in a heading, else single words, over the number of keywords; 1 for any heading without keywords."""
    if not keywords:
        return F.when(heading != "", 1.0).otherwise(0.0)
    phrases = _sum([F.when(heading.contains(k), 1.0).otherwise(0.0) for k in keywords])
    words = _sum([F.when(heading.contains(w), 1.0).otherwise(0.0) for k in keywords for w in k.split()])
    return F.when(phrases > 0, phrases).otherwise(words) / float(len(keywords))


def locate_headings(headings: DataFrame, keywords=()) -> DataFrame:
    """Sections (node_id, heading) by their best-scored heading, at most 1."""
    wanted = list(dict.fromkeys(" ".join(k.lower().split()) for k in ([keywords] if isinstance(keywords, str) else keywords) if k.strip()))
    scored = headings.withColumn("s", heading_score(T.heading_key(F.col("heading")), wanted)).where("s > 0")
    best = scored.groupBy(*key(headings)).agg(F.max(F.struct("s", "heading")).alias("b"))
    return best.select(*key(headings), F.lit("layout").alias("evidence_type"), F.lit("text").alias("modality"), F.least(F.lit(1.0), F.col("b.s")).alias("score"), F.col("b.heading").alias("heading"))


def locate_pages(page_index: DataFrame, roles: DataFrame, pages: list[int] | str | None) -> DataFrame:
    """Nodes on pages: a list of numbers, ``all``, or text such as ``slide 3``."""
    rows = page_index
    if isinstance(pages, str):
        found = re.search(r"(?:page|slide)\s*(\d+)", pages.lower()) or re.fullmatch(r"\s*(\d+)\s*", pages)
        pages = None if pages.strip().lower() == "all" else [int(found[1])] if found else []
    if pages is not None:
        rows = rows.where(F.col("page").isin(*pages)) if pages else rows.limit(0)
    own = shared(page_index, roles)
    first = rows.groupBy(*own).agg(F.min("page").alias("page")).join(roles.select(*own, "role"), own, "left")
    return shape_hits(first.withColumn("score", F.lit(1.0)))


def find_regions(nodes: DataFrame, *, source: DataFrame | None = None, pages: list[int] | None = None, kinds=("image",), label: str | None = None) -> DataFrame:
    """Regions of interest: nodes (node_id, role, page_idx, label, caption) of some kinds, from source hits, pages, or everywhere."""
    rows = nodes.where(F.col("role").isin(*kinds))
    if source is not None:
        own, in_doc = shared(source, nodes), doc(source, nodes)
        on = source.select(*own).distinct().join(nodes.select(*own, "page_idx"), own).select(*in_doc, "page_idx").distinct()
        rows = rows.join(source.select(*own).distinct().withColumn("__hit", F.lit(1)), own, "left").join(on.withColumn("__page", F.lit(1)), [*in_doc, "page_idx"], "left").where("__hit = 1 OR __page = 1").drop("__hit", "__page")
    if pages:
        rows = rows.where(F.col("page_idx").isin(*pages))
    if label:
        rows = rows.where(T.normalise_label(F.col("label")) == T.normalise_label(F.lit(label)))
    return rows.select(*key(nodes), F.lit("graphics").alias("evidence_type"), F.lit("image").alias("modality"), F.lit(1.0).alias("score"), "page_idx", "label", "caption").orderBy(*key(nodes))


def screen_charts(rois: DataFrame, spans: DataFrame, *, only_positive: bool = True) -> DataFrame:
    """Which regions show charts: a chart type, axis labels, a legend, or a telling word; 1.0, else 0.2."""
    held = spans.groupBy(*shared(rois, spans)).agg(
        F.bool_or(F.col("chart_type").isNotNull()).alias("typed"),
        F.bool_or(F.col("role") == "axis_label").alias("has_axis"),
        F.bool_or(F.col("role") == "figure_legend").alias("has_legend"),
        F.bool_or(F.lower("dense_text").rlike("chart|graph|plot|diagram")).alias("told"),
    )
    rows = rois.join(held, shared(rois, held), "left").fillna(False, ["typed", "has_axis", "has_legend", "told"])
    chart = F.col("typed") | F.col("has_axis") | F.col("has_legend") | F.col("told") | F.lower(T.text(F.col("caption"))).rlike("chart|graph|plot|diagram")
    out = rows.withColumn("has_chart", chart).withColumn("score", F.when(chart, 1.0).otherwise(0.2))
    return out.where("has_chart") if only_positive else out


def extract_regex(texts: DataFrame, pattern: str, *, around: int = 40) -> DataFrame:
    """All matches (case-insensitive) in texts (node_id, text): ``match, start, end, snippet``.

    Offsets come from lengths of what lies between matches: the text is split at the pattern.
    """
    rule = f"(?i){pattern}"
    matches = F.regexp_extract_all(T.text(F.col("text")), F.lit(f"(?i)({pattern})"), F.lit(1))
    between = F.split(T.text(F.col("text")), rule)
    pairs = F.zip_with(matches, F.slice(between, F.lit(1), F.greatest(F.size(matches), F.lit(0))), lambda m, b: F.struct(m.alias("match"), F.length(b).alias("gap")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<match:string,start:int>>").alias("out"))
    step = lambda a, p: F.struct((a["at"] + p["gap"] + F.length(p["match"])).alias("at"), F.concat(a["out"], F.array(F.struct(p["match"].alias("match"), (a["at"] + p["gap"]).alias("start")))).alias("out"))
    rows = texts.withColumn("m", F.explode(F.aggregate(pairs, start, step)["out"])).where("m.match IS NOT NULL AND m.match <> ''")
    end = F.col("m.start") + F.length("m.match")
    low = F.greatest(F.lit(0), F.col("m.start") - around)
    return rows.select(*key(texts), F.col("m.match").alias("match"), F.col("m.start").alias("start"), end.alias("end"), F.substring(F.col("text"), low + 1, end + around - low).alias("snippet"))


def _segments(c: Column) -> Column:
    return F.filter(F.transform(F.split(T.text(c), "[\n;•]+"), lambda x: F.trim(x)), lambda s: s != "")


def extract_series(texts: DataFrame) -> DataFrame:
    """Chart readings in texts (node_id, text): ``label: number unit`` of each segment."""
    rule = rf"([A-Za-z0-9\s\-]+):?\s*({NUMBER})\s*(%|percent|pct)?"
    rows = texts.select(*key(texts), F.posexplode(_segments(F.col("text"))).alias("ord", "line"))
    value = F.regexp_extract("line", rule, 2)
    unit = F.when((F.regexp_extract("line", rule, 3) != "") | F.col("line").contains("%"), F.lit("%"))
    return rows.where(value != "").select(*key(texts), "ord", F.trim(F.regexp_extract("line", rule, 1)).alias("label"), F.regexp_replace(value, ",", "").cast("double").alias("value"), unit.alias("unit"), F.col("line").alias("text"))


def extract_lines(texts: DataFrame, *, value_hints=(), label_hints=(), unit: str | None = None, years=()) -> DataFrame:
    """Numbers in the segments of plain texts (node_id, text), with label, unit and year."""
    values, labels = terms(value_hints), terms(label_hints)
    rows = texts.select(*key(texts), F.posexplode(_segments(F.col("text"))).alias("ord", "line"))
    low = F.lower("line")
    rule = rf"({NUMBER})\s*(%|percent|pct)?"
    if values:
        rows = rows.where(reduce(lambda a, b: a | b, [low.contains(v) for v in values]) | low.rlike(r"[%\d]"))
    rows = rows.withColumn("raw", F.regexp_extract("line", rule, 1)).where("raw <> ''")
    head = F.regexp_replace(F.substring(F.col("line"), F.lit(1), F.instr(F.col("line"), F.col("raw")) - 1), r"^[ :•\-]+|[ :•\-]+$", "")
    rows = rows.withColumn("label", F.when(head == "", F.col("line")).otherwise(head))
    if labels and not values:
        rows = rows.where(reduce(lambda a, b: a | b, [F.lower("label").contains(x) for x in labels]))
    found = F.when((F.regexp_extract("line", rule, 2) != "") | F.col("line").contains("%"), F.lit("%"))
    year = F.coalesce(*(F.when(F.col("line").contains(str(y)), F.lit(int(y))) for y in years), F.lit(None).cast("int"))
    return rows.select(*key(texts), "ord", "label", F.regexp_replace("raw", ",", "").cast("double").alias("value"), (F.lit(unit) if unit else found).alias("unit"), year.alias("year"), F.col("line").alias("text"))


def extract_column(tables: DataFrame, *, value_hints=(), label_hints=(), unit: str | None = None, years=(), allowed: DataFrame | None = None) -> DataFrame:
    """Numbers of structured tables (node_id, columns, rows): one row per numeric cell.

    Value columns are those that a hint names or that speak of percents; without any, all with a digit.
    Column 0 is the label. ``allowed`` (node_id, row_index) restricts the rows of the tables it has.
    """
    values, labels = terms(value_hints), terms(label_hints)
    hinted = lambda c: reduce(lambda a, b: a | b, [F.lower(c).contains(v) for v in values], F.lower(c).rlike("%|percent"))
    indexes = F.filter(F.sequence(F.lit(1), F.greatest(F.size("columns") - 1, F.lit(1))), lambda i: i < F.size("columns"))
    named = F.filter(indexes, lambda i: hinted(F.get("columns", i)))
    numeric = F.filter(indexes, lambda i: F.exists("rows", lambda r: F.coalesce(F.get(r, i).rlike(NUMBER), F.lit(False))))
    percent = F.transform("columns", lambda _, i: F.exists("rows", lambda r: F.coalesce(F.get(r, i).contains("%"), F.lit(False))))
    wide = tables.withColumns({"idxs": F.when(F.size(named) > 0, named).otherwise(numeric), "pct": percent})
    rows = wide.select(*key(tables), "columns", "idxs", "pct", F.posexplode("rows").alias("row_index", "row"))
    if allowed is not None:
        own = shared(tables, allowed)
        listed = allowed.select(*own).distinct().withColumn("__listed", F.lit(1))
        ok = allowed.select(*own, "row_index").distinct().withColumn("__ok", F.lit(1))
        rows = rows.join(listed, own, "left").join(ok, [*own, "row_index"], "left").where("__listed IS NULL OR __ok = 1").drop("__listed", "__ok")
    rows = rows.withColumn("label", F.trim(F.get("row", F.lit(0)))).where("label IS NOT NULL")
    if labels:
        rows = rows.where((F.col("label") == "") | reduce(lambda a, b: a | b, [F.lower("label").contains(x) for x in labels]))
    cells = rows.withColumn("idx", F.explode("idxs")).withColumn("cell", F.trim(F.get("row", F.col("idx"))))
    value = T.to_number(F.col("cell"))
    year = F.coalesce(*(F.when(F.col("cell").contains(str(y)) | F.col("label").contains(str(y)), F.lit(int(y))) for y in years), F.lit(None).cast("int"))
    found = F.when(F.get("pct", F.col("idx")), F.lit("%"))
    return cells.where(value.isNotNull()).select(
        *key(tables),
        F.concat("node_id", F.lit(":r"), F.col("row_index") + 1, F.lit("c"), F.col("idx") + 1).alias("cell_id"),
        "label",
        value.alias("value"),
        (F.lit(unit) if unit else found).alias("unit"),
        year.alias("year"),
        F.col("cell").alias("text"),
        F.get("columns", F.col("idx")).alias("column"),
        (F.col("row_index") * 1000 + F.col("idx")).alias("ord"),
    )


def observe(hits: DataFrame, evidence: DataFrame, visited: DataFrame, *, n: int = 6) -> DataFrame:
    """Evidence of the first ``n`` unseen hits."""
    fresh = hits.join(visited, shared(hits, visited), "left_anti").orderBy(F.desc("score"), *key(hits)).limit(n)
    return fresh.select(*key(hits), "score").join(evidence, shared(hits, evidence), "left")


def pack_context(observations: DataFrame, *, rows: int = 6, chars: int = 280) -> DataFrame:
    """One row ``context``: observations as JSON, texts cut to ``chars``, tables to ``rows`` lines."""
    short = F.when(F.col("modality") == "table", F.substring_index("content", "\n", rows)).otherwise(F.substring("content", 1, chars))
    told = [*key(observations), "modality", "content"]
    item = F.struct((-F.col("score")).alias("s"), *key(observations), "modality", short.alias("content"))
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(*(x[c].alias(c) for c in told)))
    return observations.agg(F.to_json(ordered).alias("context"))


def match_label_or_pages(images: DataFrame, *, labels: list[str] = (), pages: list[int] = ()) -> DataFrame:
    """Images (node_id, label, page_idx, logical_page) for a question: named ones, else those on its pages.

    A page number is meant as logical, physical or counted from one; the three joins are a union. Images of several
    documents count by document: one that names none of its images gives those on the pages.
    """
    wanted = [T.normalise_label(F.lit(x)) for x in labels]
    named = images.where(reduce(lambda a, b: a | b, [T.normalise_label(F.col("label")) == w for w in wanted], F.lit(False)))
    on = F.col("page_idx").isin(*pages, *[p - 1 for p in pages]) | F.col("logical_page").isin(*[str(p) for p in pages]) if pages else F.lit(False)
    if doc(images):
        return named.select(*key(images)).unionByName(images.where(on).join(named.select("doc_id").distinct(), "doc_id", "left_anti").select(*key(images))).distinct()
    count = named.agg((F.count("*") > 0).alias("__named"))
    return named.select("node_id").unionByName(images.where(on).crossJoin(F.broadcast(count)).where("NOT __named").select("node_id")).distinct()  # one row


def sample_pages(pages: DataFrame, n: int, *, seed: int = 0) -> DataFrame:
    """``n`` pages of each document: page 0, then others in a seeded order (a sampling operator)."""
    order = Window.partitionBy("doc_id").orderBy(F.when(F.col("page_idx") == 0, 0).otherwise(1), F.xxhash64("page_idx", F.lit(seed)), "page_idx")
    return pages.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")

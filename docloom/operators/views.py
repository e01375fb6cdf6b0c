"""Index views of document trees: one DataFrame per view, one function each.

Nodes are the rows of :func:`docloom.operators.tree.build_tree`, with optional ``kind``, ``description``,
``data`` (HTML of a table), ``legend``, ``axis_labels`` and ``ocr_text`` columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import html
from docloom.functions import text as T
from docloom.operators import tree


def _empty() -> Column:
    return F.array().cast("array<string>")


def with_columns(nodes: DataFrame, **kinds: str) -> DataFrame:
    """Nodes with the optional columns, null where they are absent."""
    return nodes.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in nodes.columns})


def _full(nodes: DataFrame) -> DataFrame:
    return with_columns(nodes, kind="string", description="string", data="string", legend="array<string>", axis_labels="map<string,string>", ocr_text="string", title="string")


def should_summarise(*, leaves: bool = False) -> Column:
    """Sections and tables; images that are charts or diagrams by kind or description; leaves if asked."""
    chart = F.lower(T.text(F.col("kind"))).isin("statistical", "diagram") | F.lower(T.text(F.col("description"))).rlike("chart|plot|graph|diagram")
    return F.col("type").isin("section", "table") | ((F.col("type") == "image") & chart) | (F.lit(leaves) & F.col("type").isin("text", "paragraph", "list", "equation"))


def parent_titles(nodes: DataFrame) -> DataFrame:
    """Add ``parent_title``: the title of the section a node lies in."""
    titles = nodes.where("type = 'section'").select("doc_id", F.col("node_id").alias("parent_id"), F.col("title").alias("parent_title"))
    return nodes.join(titles, ["doc_id", "parent_id"], "left")


def snippets(nodes: DataFrame, *, most: int = 400) -> DataFrame:
    """``doc_id, node_id, snippet``: the paragraphs of a section in order, joined and cut."""
    texts = nodes.where(F.col("type").isin("text", "paragraph") & (F.trim(T.text(F.col("text"))) != ""))
    joined = texts.where("parent_id IS NOT NULL").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("ord", F.substring(F.trim("text"), 1, most).alias("t")))).alias("ts"))
    return joined.select("doc_id", "node_id", F.substring(T.collapse(F.array_join(F.transform("ts", lambda x: x["t"]), " ")), 1, most).alias("snippet"))


def summary_nodes(nodes: DataFrame, *, leaves: bool = True) -> DataFrame:
    """One record per summarised node: role, title, page, label and number, dense text, hints, parent.

    The dense text is the heuristic summary: a section's title and paragraphs; an image's title, caption
    and description; a table's title, caption and a sample of its data; a leaf's own text.
    """
    full = parent_titles(_full(nodes)).where(should_summarise(leaves=leaves))
    rows = full.join(tree.captions(nodes), ["doc_id", "node_id"], "left").join(snippets(nodes), ["doc_id", "node_id"], "left")
    title, caption, data = T.text(F.col("title")), T.text(F.col("caption")), T.text(F.col("data"))
    named = T.clean_join(title, caption)
    section = F.when(T.text(F.col("snippet")) != "", F.concat(title, F.lit(": "), F.col("snippet"))).otherwise(F.when(title != "", title).otherwise("Section summary"))
    described = T.clean_join(title, caption, T.text(F.col("description")))
    image = F.when(described != "", described).otherwise("Image content; describe axes/series if present.")
    base = F.when(named != "", named).otherwise("Table comparing key variables; summarize columns and rows.")
    table = F.when(data != "", F.concat(base, F.lit(". Sample: "), F.substring(data, 1, 200))).otherwise(base)
    dense = F.when(F.col("type") == "section", section).when(F.col("type") == "image", image).when(F.col("type") == "table", table).otherwise(T.clip(T.collapse(F.col("text"))))
    hint_text = F.when(F.col("type") == "section", F.concat_ws(" ", title, F.col("snippet"))).when(F.col("type") == "table", F.concat_ws(" ", named, T.strip_tags(data))).otherwise(dense)
    headers = F.when(F.col("type") == "table", T.table_headers(data)).otherwise(_empty())
    media = F.col("type").isin("image", "table")
    own = T.label(named)
    own = F.when(media, own).otherwise(T.label(F.lit("")))
    rows = rows.withColumns({"dense_text": dense, "own": own, "keywords": F.slice(F.array_distinct(F.concat(headers, T.hints(hint_text))), 1, 6)})
    relevant = F.col("own.kind") == F.when(F.col("type") == "image", "figure").otherwise("table")
    hints = F.when(F.coalesce(relevant, F.lit(False)), F.slice(F.array_distinct(F.concat(F.array("own.label"), "keywords")), 1, 8)).otherwise(F.col("keywords"))
    return rows.select(
        "doc_id",
        "node_id",
        F.when(F.col("type") == "text", "paragraph").otherwise(F.col("type")).alias("role"),
        "level",
        "title",
        "page_idx",
        "dense_text",
        hints.alias("hints"),
        F.col("own.label").alias("label"),
        F.when(relevant & (F.col("own.kind") == "figure"), F.col("own.number")).alias("figure_no"),
        F.when(relevant & (F.col("own.kind") == "table"), F.col("own.number")).alias("table_no"),
        F.when(F.col("type") != "section", F.col("parent_id")).alias("parent_section"),
        F.when(F.col("type") != "section", F.col("parent_title")).alias("parent_title"),
    )


def id_maps(summary: DataFrame) -> DataFrame:
    """``doc_id, kind, key, node_id``: labels, figure numbers and table numbers; of several, the last node."""
    each = F.array(
        F.struct(F.lit("label").alias("kind"), F.col("label").alias("key")),
        F.struct(F.lit("figure").alias("kind"), F.col("figure_no").alias("key")),
        F.struct(F.lit("table").alias("kind"), F.col("table_no").alias("key")),
    )
    rows = summary.select("doc_id", "node_id", F.explode(each).alias("e")).where("e.key IS NOT NULL")
    return rows.groupBy("doc_id", "e.kind", "e.key").agg(F.max("node_id").alias("node_id"))


def section_rollup(nodes: DataFrame) -> DataFrame:
    """What the whole subtree of each section holds, one row per section.

    Page span, labels, table schemas, captions, chart types, units, counts by type, first image, table and
    paragraph, headings of direct subsections, and keywords of these. Lists keep document order.
    """
    full = _full(nodes).join(tree.captions(nodes), ["doc_id", "node_id"], "left")
    above = tree.ancestors(nodes).select("doc_id", "node_id", F.col("ancestor").alias("section"), "distance")
    self_ = nodes.where("type = 'section'").select("doc_id", "node_id", F.col("node_id").alias("section"), F.lit(0).alias("distance"))
    member = above.unionByName(self_).join(full, ["doc_id", "node_id"])
    media = F.col("type").isin("image", "table")
    label = F.when(media, T.label(T.clean_join(F.col("title"), F.col("caption")))["label"])
    headers = F.when(F.col("type") == "table", T.table_headers(F.col("data"))).otherwise(_empty())
    units = F.when(media, F.array_union(T.units_set(F.col("caption")), F.filter(F.transform(headers, T.header_unit), lambda u: u.isNotNull()))).when(F.col("type").isin("text", "paragraph"), T.units_set(F.col("text"))).otherwise(_empty())
    first = lambda kind: F.min_by(F.when(F.col("type").isin(*kind), F.col("node_id")), F.when(F.col("type").isin(*kind), F.col("ord")))
    of = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("ord", c.alias("v"))))), lambda x: x["v"])
    count = lambda *kinds: F.count_if(F.col("type").isin(*kinds))
    out = member.groupBy("doc_id", F.col("section").alias("node_id")).agg(
        F.min("page_idx").alias("page_lo"),
        F.max("page_idx").alias("page_hi"),
        F.array_distinct(of(label)).alias("child_labels"),
        F.array_distinct(F.flatten(of(F.when(F.size(headers) > 0, headers)))).alias("child_table_schema"),
        F.array_distinct(of(F.when(media, F.col("caption")))).alias("captions"),
        F.array_sort(F.collect_set(F.when((F.col("type") == "image") & (T.text(F.col("kind")) != ""), F.lower("kind")))).alias("chart_types"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(units)))).alias("units_set"),
        count("section").alias("n_sections"),
        count("image").alias("n_images"),
        count("table").alias("n_tables"),
        count("equation").alias("n_equations"),
        count("text", "paragraph").alias("n_paragraphs"),
        first(["image"]).alias("top_image"),
        first(["table"]).alias("top_table"),
        first(["text", "paragraph"]).alias("top_paragraph"),
        of(F.when((F.col("distance") == 1) & (F.col("type") == "section"), F.col("title"))).alias("child_headings"),
    )
    joined = lambda c, n: F.array_join(F.slice(c, 1, n), "; ")
    basis = F.array_join(F.filter(F.array(joined("child_headings", 8), joined("captions", 12), joined("child_table_schema", 12)), lambda x: x != ""), "; ")
    return out.withColumn("child_surface", basis).withColumn("caption_bag", joined("captions", 20)).withColumn("keywords", T.hints(F.col("child_surface")))


def section_views(nodes: DataFrame) -> DataFrame:
    """Dense variants of each section: ``node_id`` with #h, #g, #c, #p for heading, gist, child and path."""
    sections = nodes.where("type = 'section'").select("doc_id", "node_id", "title", "level", "page_idx")
    rows = sections.join(section_rollup(nodes), ["doc_id", "node_id"]).join(tree.paths(nodes), ["doc_id", "node_id"]).join(snippets(nodes), ["doc_id", "node_id"], "left")
    title = T.text(F.col("title"))
    gist = T.clip(F.concat_ws(": ", F.nullif(title, F.lit("")), F.nullif(T.text(F.col("snippet")), F.lit(""))), 360)
    child = T.clip(F.concat_ws(": ", F.nullif(title, F.lit("")), F.nullif(F.col("child_surface"), F.lit(""))), 360)
    path = F.concat_ws(" > ", F.nullif(F.col("path"), F.lit("")), title)
    variants = F.array(*(F.struct(F.lit(name).alias("variant"), F.lit(mark).alias("mark"), t.alias("dense_text")) for name, mark, t in (("heading", "#h", title), ("gist", "#g", gist), ("child", "#c", child), ("path", "#p", path))))
    rows = rows.withColumns({"gist": gist, "v": variants})
    exploded = rows.withColumn("v", F.explode("v"))
    return exploded.select(
        "doc_id",
        F.concat("node_id", "v.mark").alias("node_id"),
        F.col("node_id").alias("base_id"),
        "v.variant",
        F.lit("section").alias("role"),
        "v.dense_text",
        "page_idx",
        "level",
        "page_lo",
        "page_hi",
        "chart_types",
        "units_set",
        ((F.size("units_set") > 0) | F.col("gist").rlike(r"\d")).alias("has_numbers"),
        ((F.col("n_tables") > 0) | (F.col("n_images") > 0)).alias("supports_compare"),
        (F.col("n_tables") > 0).alias("supports_lookup"),
        F.array_contains("chart_types", "statistical").alias("supports_trend"),
        (F.col("n_images") > 0).alias("routes_to_image"),
        (F.col("n_tables") > 0).alias("routes_to_table"),
    )


def sparse_docs(nodes: DataFrame, *, compat: bool = False) -> DataFrame:
    """Fielded sparse documents: ``doc_id, node_id, role, title, caption, table_schema, labels, aliases, body``.

    Sections map heading, captions, schemas and labels of their subtree onto the fields; ``compat`` leaves
    those fields empty for sections, as indexes built elsewhere do.
    """
    summary = summary_nodes(nodes, leaves=False)
    captions = tree.captions(nodes)
    data = _full(nodes).select("doc_id", "node_id", "data")
    media = summary.where("role IN ('image', 'table')").join(captions, ["doc_id", "node_id"], "left").join(data, ["doc_id", "node_id"])
    schema = F.nullif(F.array_join(T.table_headers(F.col("data")), "; "), F.lit(""))
    media = media.select("doc_id", "node_id", "role", "title", "caption", schema.alias("table_schema"), F.col("label").alias("labels"), T.aliases(F.coalesce(schema, F.col("dense_text")), F.col("title")).alias("aliases"), F.col("dense_text").alias("body"))
    sections = summary.where("role = 'section'").join(section_rollup(nodes), ["doc_id", "node_id"])
    joined = lambda c: F.nullif(F.array_join(c, "; "), F.lit(""))
    keep = (lambda c: F.lit(None).cast("string")) if compat else (lambda c: c)
    sections = sections.select("doc_id", "node_id", "role", keep(F.col("title")).alias("title"), keep(F.nullif(F.col("caption_bag"), F.lit(""))).alias("caption"), keep(joined("child_table_schema")).alias("table_schema"), keep(joined("child_labels")).alias("labels"), T.aliases(joined("child_table_schema"), F.col("caption_bag")).alias("aliases"), F.col("dense_text").alias("body"))
    return media.unionByName(sections)


def pipe_table(data: Column) -> Column:
    """Struct (columns, rows) of a table written with ``|``, one line a row; the first is the header."""
    lines = F.filter(F.transform(F.split(T.text(data), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    cells = F.transform(lines, lambda x: F.split(x, r"\s*\|\s*"))
    return F.struct(F.coalesce(F.get(cells, F.lit(0)), _empty()).alias("columns"), F.filter(cells, lambda _, i: i > 0).alias("rows"))


def table_rows(tables: DataFrame) -> DataFrame:
    """One record per table row, from ``doc_id, node_id, columns, rows`` (arrays of texts).

    ``row_id, row_index, row_label, cells`` (name, index, value, unit, year), ``dense_text, tokens``. The
    unit is the header's, else the value's; the year is the first in header, then value.
    """
    padded = lambda row: F.transform("columns", lambda _, i: F.coalesce(F.get(row, i), F.lit("")))
    rows = tables.select("doc_id", "node_id", "columns", F.posexplode("rows").alias("row_index", "raw")).withColumn("row", padded(F.col("raw")))

    def cell(name: Column, i: Column) -> Column:
        value = F.get("row", i)
        return F.struct(name.alias("name"), i.alias("index"), value.alias("value"), F.coalesce(T.header_unit(name), F.get(T.units_set(value), F.lit(0))).alias("unit"), T.first_year(name, value).alias("year"))

    cells = F.transform("columns", cell)
    label = F.get("row", F.lit(0))
    text = F.array_join(F.zip_with("columns", "row", lambda c, v: F.concat(c, F.lit("="), v)), "; ")
    rows = rows.withColumns({"cells": cells, "row_label": F.nullif(label, F.lit("")), "text": text})
    words = F.flatten(F.transform("cells", lambda c: F.concat(T.tokens(c["name"], T.CELL_TOKEN), T.tokens(c["value"], T.CELL_TOKEN), F.filter(F.array(c["unit"]), lambda u: u.isNotNull()))))
    return rows.select(
        "doc_id",
        "node_id",
        F.concat("node_id", F.lit(":row:"), F.col("row_index")).alias("row_id"),
        "row_index",
        "row_label",
        "cells",
        F.when(F.col("row_label").isNotNull() & ~F.col("text").contains(F.col("row_label")), F.concat("row_label", F.lit(": "), F.col("text"))).otherwise(F.col("text")).alias("dense_text"),
        F.array_distinct(F.concat(T.tokens(F.col("row_label"), T.CELL_TOKEN), words)).alias("tokens"),
    )


def figure_spans(nodes: DataFrame) -> DataFrame:
    """Text spans of images: caption, description, legend, axis labels, OCR; numbered within each image."""
    images = _full(nodes).where("type = 'image'").join(tree.captions(nodes), ["doc_id", "node_id"], "left")
    one = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), c.alias("t")))
    many = lambda role, c: F.transform(F.coalesce(c, _empty()), lambda t: F.struct(F.lit(role).alias("role"), t.alias("t")))
    axes = F.transform(T.strings(["x", "y", "z", "x_axis", "y_axis", "z_axis"]), lambda k: F.try_element_at("axis_labels", k))
    spans = F.concat(one("figure_caption", F.col("caption")), one("figure_description", F.col("description")), many("figure_legend", F.col("legend")), many("axis_label", axes), many("figure_ocr", F.split("ocr_text", r"[;\n]+")))
    full = F.filter(spans, lambda s: F.trim(T.text(s["t"])) != "")
    rows = images.select("doc_id", "node_id", "page_idx", F.col("parent_id").alias("parent_section"), F.nullif(F.lower(T.text(F.col("kind"))), F.lit("")).alias("chart_type"), F.posexplode(full).alias("i", "s"))
    text = F.trim("s.t")
    return rows.select("doc_id", "node_id", F.concat_ws(":", "node_id", "s.role", "i").alias("span_id"), F.col("i").alias("ord"), "s.role", "chart_type", "page_idx", "parent_section", text.alias("dense_text"), T.tokens(text, T.CELL_TOKEN).alias("sparse_tokens"), T.entities(text).alias("entities"), T.units_set(text).alias("units_set"), T.years(text).alias("years"))


def span_tokens(spans: DataFrame) -> DataFrame:
    """``doc_id, node_id, tokens``: plain tokens and adjacent pairs of all spans of an image, in order."""
    gathered = spans.groupBy("doc_id", "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "dense_text"))), lambda x: x["dense_text"]), " ").alias("t"))
    words = F.regexp_extract_all(F.lower("t"), F.lit(f"({T.PLAIN_TOKEN})"), F.lit(1))
    return gathered.select("doc_id", "node_id", T.with_bigrams(words).alias("tokens"))


def edges(nodes: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """The document graph: ``doc_id, src, dst, type, label``.

    child (section to image or table), has_col, has_row and has_span (from their views), ref (a chunk to
    what its first label names), same_page (page to chunk) and prev_next.
    """
    full = _full(nodes)
    edge = lambda rows, src, dst, kind, label=None: rows.select("doc_id", src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), (F.lit(None) if label is None else label).cast("string").alias("label"))
    out = [edge(full.where("type IN ('image', 'table') AND parent_id IS NOT NULL"), F.col("parent_id"), F.col("node_id"), "child")]
    columns = full.where("type = 'table'").select("doc_id", "node_id", F.explode(T.table_headers(F.col("data"))).alias("c"))
    out.append(edge(columns, F.col("node_id"), F.concat("node_id", F.lit(":col:"), "c"), "has_col", T.header_unit(F.col("c"))))
    parsed = full.where("type = 'table' AND data IS NOT NULL").select("doc_id", "node_id", html.parse_table("data").alias("t"))
    row_ids = F.explode(F.transform(F.sequence(F.lit(0), F.size("t.rows") - 1), lambda i: F.concat(F.col("node_id"), F.lit(":row:"), i.cast("string"))))
    out.append(edge(parsed.where("size(t.rows) > 0").select("doc_id", "node_id", row_ids.alias("row_id")), F.col("node_id"), F.col("row_id"), "has_row"))
    spans = figure_spans(nodes)
    out.append(edge(spans, F.col("node_id"), F.col("span_id"), "has_span", F.col("role")))
    out.append(edge(tree.prev_next(nodes), F.col("src"), F.col("dst"), "prev_next"))
    if chunks is not None:
        out.append(edge(chunks.where("page_idx IS NOT NULL"), F.concat(F.lit("P"), "page_idx"), F.col("node_id"), "same_page"))
        out.append(edge(references(chunks, id_maps(summary_nodes(nodes, leaves=False))), F.col("node_id"), F.col("target"), "ref", F.col("label")))
    return reduce(DataFrame.unionByName, out)


def references(chunks: DataFrame, maps: DataFrame) -> DataFrame:
    """``doc_id, node_id, label, target``: what the first label in a chunk names, by label, else by number."""
    named = chunks.select("doc_id", "node_id", T.label(F.col("raw_text")).alias("l")).where("l.label IS NOT NULL").select("doc_id", "node_id", "l.*")
    of = lambda kind, key, name: maps.where(F.col("kind") == kind).select("doc_id", F.col("key").alias(key), F.col("node_id").alias(name))
    joined = named.join(of("label", "label", "a"), ["doc_id", "label"], "left").join(of("figure", "number", "f"), ["doc_id", "number"], "left").join(of("table", "number", "t"), ["doc_id", "number"], "left")
    target = F.coalesce("a", F.when(F.col("kind") == "figure", F.col("f")).when(F.col("kind") == "table", F.col("t")))
    return joined.select("doc_id", "node_id", "label", target.alias("target")).where("target IS NOT NULL")


def heading_index(nodes: DataFrame) -> DataFrame:
    """``doc_id, keyword, sections``: sections by the words of their titles and their subtree's keywords."""
    rolled = section_rollup(nodes).select("doc_id", "node_id", "keywords")
    titled = nodes.where("type = 'section'").select("doc_id", "node_id", "ord", T.tokens(F.col("title"), T.SUMMARY_TOKEN).alias("words"))
    words = titled.join(rolled, ["doc_id", "node_id"]).select("doc_id", "node_id", "ord", F.explode(F.array_distinct(F.concat(F.transform("keywords", F.lower), "words"))).alias("keyword"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "node_id"))), lambda x: x["node_id"])
    return words.groupBy("doc_id", "keyword").agg(ordered.alias("sections"))


def heading_children(nodes: DataFrame) -> DataFrame:
    """``doc_id, node_id, title, children``: direct children of each section in order."""
    kids = nodes.where("parent_id IS NOT NULL").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "node_id"))), lambda x: x["node_id"]).alias("children"))
    return nodes.where("type = 'section'").select("doc_id", "node_id", "title").join(kids, ["doc_id", "node_id"], "left")


def view_counts(**views: DataFrame) -> DataFrame:
    """``doc_id, view, n`` over all views."""
    return reduce(DataFrame.unionByName, [v.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit(name).alias("view"), "n") for name, v in views.items()])


def page_index(nodes: DataFrame) -> DataFrame:
    """``doc_id, page, node_id``: a node is found under its page, the page after it and its logical page's numbers."""
    logical = T.logical_page_bounds(F.col("logical_page")) if "logical_page" in nodes.columns else F.struct(F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))
    rows = nodes.withColumn("lp", logical)
    numbers = F.array("page_idx", F.col("page_idx") + 1, F.col("lp.lo"), F.col("lp.hi"))
    return rows.select("doc_id", "node_id", F.explode(F.array_distinct(F.filter(numbers, lambda p: p.isNotNull()))).alias("page"))


def evidence(*layers: DataFrame) -> DataFrame:
    """Rows ``doc_id, node_id, modality, content`` of several stores; of one node, the last store wins."""
    numbered = [layer.select("doc_id", "node_id", "modality", "content", F.lit(i).alias("layer")) for i, layer in enumerate(layers)]
    best = F.row_number().over(Window.partitionBy("doc_id", "node_id").orderBy(F.desc("layer")))
    return reduce(DataFrame.unionByName, numbered).withColumn("r", best).where("r = 1").drop("r", "layer")


def prune_sparse(docs: DataFrame, fields: list[str]) -> DataFrame:
    """Sparse documents with blank fields as null, and none that has nothing."""
    clean = docs.withColumns({f: F.nullif(F.trim(f), F.lit("")) for f in fields})
    return clean.where(reduce(lambda a, b: a | b, [F.col(f).isNotNull() for f in fields]))


def collapse_fields(fields: list[str]) -> Column:
    """``name: value; name: value`` of the fields that have one."""
    return F.concat_ws("; ", *(F.when(F.trim(T.text(F.col(f))) != "", F.concat(F.lit(f"{f}: "), F.col(f))) for f in fields))

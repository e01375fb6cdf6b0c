"""Lookups, filters and small projections over nodes and hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.keys import shared


def filter_nodes(nodes: DataFrame, *, role: str | None = None, filters: list[dict] = (), scope: DataFrame | None = None) -> DataFrame:
    """Nodes of a role whose attributes meet all filters (field, op ``=`` or ``contains``, value), within a scope.

    Values are compared as text, ``contains`` without case; a missing attribute is the empty text.
    """
    out = nodes if role is None else nodes.where(F.col("role") == role)
    for f in filters:
        if f.get("field") is None:
            continue
        has = T.text(F.col(f["field"]).cast("string")) if f["field"] in nodes.columns else F.lit("")
        value = str(f.get("value") or "")
        out = out.where(F.lower(has).contains(value.lower()) if f.get("op", "=") == "contains" else has == value)
    return out if scope is None else out.join(scope.select("node_id").distinct(), "node_id", "left_semi")


def attribute(nodes: DataFrame, dense: DataFrame, sparse: DataFrame, name: str) -> DataFrame:
    """``node_id, value`` of an attribute: the dense view's, else the sparse view's."""
    a = dense.select("node_id", F.col(name).alias("a")).dropDuplicates(["node_id"])
    b = sparse.select("node_id", F.col(name).alias("b")).dropDuplicates(["node_id"])
    return nodes.select("node_id").join(a, "node_id", "left").join(b, "node_id", "left").select("node_id", F.coalesce("a", "b").alias("value"))


def candidate_texts(nodes: DataFrame, *layers: DataFrame) -> DataFrame:
    """``node_id, text``: of several stores (node_id, text) the first that has a text for a node."""
    joined = nodes.select("node_id")
    for i, layer in enumerate(layers):
        joined = joined.join(layer.groupBy("node_id").agg(F.min(F.nullif(F.trim("text"), F.lit(""))).alias(f"t{i}")), "node_id", "left")
    return joined.select("node_id", F.coalesce(*(f"t{i}" for i in range(len(layers)))).alias("text"))


def hit_pages(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits with ``page``: their provenance's, else their meta's ``page_idx`` or ``page``, else their node's."""
    from_map = lambda c, k: F.try_element_at(c, F.lit(k)).try_cast("int") if c in hits.columns else F.lit(None).cast("int")
    own = F.coalesce(from_map("provenance", "page_idx"), from_map("meta", "page_idx"), from_map("meta", "page"))
    where = nodes.select("node_id", F.col("page_idx").alias("__page")).dropDuplicates(["node_id"])
    return hits.join(where, "node_id", "left").withColumn("page", F.coalesce(own, "__page")).drop("__page")


def pages_of_hits(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """``page, n``: pages of the hits with their number of hits."""
    return hit_pages(hits, nodes).where("page IS NOT NULL").groupBy("page").agg(F.count("*").alias("n"))


def span_texts(spans: DataFrame, role: str, *, sep: str = "; ") -> DataFrame:
    """``node_id, first, joined``: the first text of a role among a figure's spans, and all of them."""
    mine = spans.where((F.col("role") == role) & (F.trim("dense_text") != ""))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "dense_text"))), lambda x: x["dense_text"])
    return mine.groupBy("node_id").agg(F.min_by("dense_text", "ord").alias("first"), F.array_join(ordered, sep).alias("joined"))


def roi_context(rois: DataFrame) -> DataFrame:
    """Regions with ``context``: page, label, caption and description, those that are known."""
    part = lambda name, c: F.when(T.text(F.col(c).cast("string")) != "", F.concat(F.lit(f"{name}: "), F.col(c).cast("string")))
    return rois.withColumn("context", F.concat_ws(" | ", part("page", "page_idx"), part("label", "label"), part("caption", "caption")))


def combine_answers(answers: DataFrame, *by: str) -> DataFrame:
    """Several model answers (ord, answer, confidence, thinking) as one, overall or for each key: joined, mean, first."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "answer"))), lambda x: x["answer"])
    thought = F.when(T.text(F.col("thinking")) != "", F.col("thinking"))
    return answers.groupBy(*by).agg(F.array_join(ordered, "\n").alias("answer"), F.avg("confidence").alias("confidence"), F.min_by(thought, F.when(thought.isNotNull(), F.col("ord"))).alias("thinking"))


def has_keys(c: Column, keys: list[str]) -> Column:
    """Whether a map has all keys."""
    return F.size(F.array_except(T.strings(keys), F.map_keys(c))) == 0


def table_preview(columns: Column, rows: Column) -> Column:
    """``col: value, ...`` of the first row."""
    first = F.get(rows, F.lit(0))
    return F.coalesce(F.array_join(F.zip_with(columns, first, lambda c, v: F.concat(c, F.lit(": "), F.coalesce(v, F.lit("")))), ", "), F.lit(""))


def list_preview(items: Column) -> Column:
    """The first two items that are not blank."""
    kept = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.slice(kept, 1, 2), "; ")


def image_summary(caption: Column, description: Column) -> Column:
    """Caption and description, those that are known."""
    return F.concat_ws("; ", F.nullif(F.trim(T.text(caption)), F.lit("")), F.nullif(F.trim(T.text(description)), F.lit("")))


def resolve_images(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes (img_path) with the file of that name (path, name) whose folder is longest in common; null if there is none."""
    found = nodes.withColumn("name", F.substring_index("img_path", "/", -1)).join(files.select("path", "name"), "name", "left")
    best = found.groupBy("node_id").agg(F.max_by("path", F.struct(F.col("path").endswith(F.col("img_path")), "path")).alias("path"))
    return nodes.join(best, "node_id", "left")


def frozen_heading() -> Column:
    """Headings whose level a contents entry has fixed."""
    return F.coalesce("from_toc", F.lit(False)) & F.col("level").isNotNull()


def heading_candidate() -> Column:
    """Texts that may be headings without a contents entry: marked by the parser, not frozen, not running text."""
    return (F.col("type") == "text") & (F.coalesce("level", F.lit(-1)) >= 1) & ~frozen_heading() & T.is_heading_text(F.col("text"))


def large_enough(width: str = "width", height: str = "height", *, least: int = 50) -> Column:
    """Images of at least ``least`` pixels on both sides."""
    return (F.col(width) >= least) & (F.col(height) >= least)


def chapter_elements(elements: DataFrame) -> DataFrame:
    """Each chapter's own elements (doc_id, ord, chapter, is_title): its title and direct members, no titles of subchapters."""
    member = elements.where(~F.col("is_title")).select("doc_id", "chapter", "ord")
    own = elements.where("is_title").select("doc_id", F.col("ord").alias("chapter"), "ord")
    return own.unionByName(member)


def leaf_chapters(elements: DataFrame) -> DataFrame:
    """Chapters (doc_id, ord) without subchapters."""
    titles = elements.where("is_title")
    inner = titles.where("chapter IS NOT NULL").select("doc_id", F.col("chapter").alias("ord")).distinct()
    return titles.select("doc_id", "ord").join(inner, ["doc_id", "ord"], "left_anti")


def insert_headings(items: DataFrame, missing: DataFrame) -> DataFrame:
    """Put headings (doc_id, page_idx, level, title) before the first item of their page, and number anew."""
    first = items.groupBy("doc_id", "page_idx").agg(F.min("ord").alias("ord"))
    new = missing.join(first, ["doc_id", "page_idx"]).select("doc_id", "ord", F.lit(0).alias("layer"), "page_idx", F.lit("text").alias("type"), F.col("title").alias("text"), "level")
    rows = items.select("doc_id", "ord", F.lit(1).alias("layer"), "page_idx", "type", "text", "level").unionByName(new)
    return rows.withColumn("node_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "layer", "level", "text")) - 1).drop("layer")


def align_in_order(entries: DataFrame, candidates: DataFrame, *, window: int = 20, least: float = 0.5) -> DataFrame:
    """Contents entries matched to candidates in order: ``doc_id, ord, match_ord``.

    A pointer moves through the candidates; each entry takes the most similar of the next ``window`` (token
    Jaccard; the first of equal ones), if it is ``least`` similar, and the pointer goes behind it. A document's entries
    are folded with the pointer as state, over its candidates as an array.
    """
    words = lambda c: F.array_distinct(T.tokens(c, T.PLAIN_TOKEN))
    kind = dict(candidates.dtypes)["ord"]
    pack = lambda df, text: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", words(F.col(text)).alias("w")))).alias(text))
    both = pack(entries.select("doc_id", "ord", "title"), "title").join(pack(candidates.select("doc_id", "ord", "text"), "text"), "doc_id", "left")
    listed = F.coalesce("text", F.array().cast(f"array<struct<ord:{kind},w:array<string>>>"))

    def step(state, entry):
        def scored(c, i):
            union = F.size(F.array_union(c["w"], entry["w"]))
            like = F.when(union > 0, F.size(F.array_intersect(c["w"], entry["w"])) / union).otherwise(0.0)
            return F.struct(like.alias("like"), (-i).alias("i"), c["ord"].alias("ord"))

        best = F.array_max(F.transform(F.slice(listed, state["at"] + 1, F.lit(window)), scored))
        found = F.coalesce(best["like"] >= least, F.lit(False))
        match = F.struct(entry["ord"].alias("ord"), F.when(found, best["ord"]).cast("long").alias("match_ord"))
        return F.struct(F.when(found, state["at"] - best["i"] + 1).otherwise(state["at"]).alias("at"), F.concat(state["out"], F.array(match)).alias("out"))

    own = dict(entries.dtypes)["ord"]
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<ord:{own},match_ord:bigint>>").alias("out"))
    return both.select("doc_id", F.inline(F.aggregate("title", start, step, lambda s: s["out"])))


def outline(headings: DataFrame, *, most: int = 200) -> DataFrame:
    """``doc_id, outline``: headings indented by level, with index and logical page, at most ``most`` lines."""
    line = F.concat(F.expr("repeat('  ', greatest(0, least(level, 6) - 1))"), F.lit("- L"), F.col("level").cast("string"), F.lit(" idx="), F.col("ord").cast("string"), F.coalesce(F.concat(F.lit(" lp="), "logical_page"), F.lit("")), F.lit(": "), T.collapse(F.col("text")))
    placed = headings.withColumn("__r", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).where(F.col("__r") <= most)
    return placed.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("outline"))


def resolve_level(*sources: Column) -> Column:
    """A level from the first source that has one: a number, or the number of ``>`` in a path, plus one."""
    each = [F.coalesce(s.cast("string").try_cast("int"), F.when(s.cast("string").contains(">"), F.length(s.cast("string")) - F.length(F.replace(s.cast("string"), F.lit(">"), F.lit(""))) + 1)) for s in sources]
    return F.coalesce(*each)


def toc_payload(items: DataFrame) -> DataFrame:
    """``doc_id, page_idx, payload``: a page's lines as JSON, for a contents model."""
    lines = items.select("doc_id", "page_idx", "ord", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("trim(line) <> ''")
    entry = F.struct("ord", "line_no", F.trim("line").alias("text"))
    return lines.groupBy("doc_id", "page_idx").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("payload"))


def toc_case(entries: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, toc_case``: 1 with page numbers in the contents, 2 without, 3 without contents."""
    told = entries.groupBy("doc_id").agg(F.bool_or(F.col("page").isNotNull()).alias("paged"))
    return docs.select("doc_id").distinct().join(told, "doc_id", "left").select("doc_id", F.when(F.col("paged"), 1).when(F.col("paged").isNotNull(), 2).otherwise(3).alias("toc_case"))


def caption_payload(neighbours: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, media_ord, payload``: the texts around a medium as JSON, for a caption model."""
    rows = neighbours.join(items.select("doc_id", "ord", "text"), ["doc_id", "ord"])
    entry = F.struct("side", "distance", "ord", F.substring("text", 1, 300).alias("text"))
    return rows.groupBy("doc_id", "media_ord").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("payload"))


def caption_statistics(roles: DataFrame) -> DataFrame:
    """``doc_id, n_media, n_captions, n_footnotes`` of assigned roles."""
    return roles.groupBy("doc_id").agg(F.countDistinct("media_ord").alias("n_media"), F.count_if(F.col("role") == "caption").alias("n_captions"), F.count_if(F.col("role") == "footnote").alias("n_footnotes"))


def page_text(pages: DataFrame, *, most: int = 4000) -> DataFrame:
    """Pages with their text on one line, cut to ``most`` characters."""
    return pages.withColumn("text", F.substring(F.regexp_replace(T.text(F.col("text")), r"\s*\n\s*", " "), 1, most))


def unite(*frames: DataFrame) -> DataFrame:
    """All rows of several hit lists, none dropped."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def blocks_by_id(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """Blocks (node_id, ...) of the wanted ids (node_id, ord), with their first place; a wanted id without block is left out.

    Ids are those of a document where both tables have ``doc_id``.
    """
    own = shared(blocks, ids)
    return blocks.join(ids.groupBy(*own).agg(F.min("ord").alias("ord")), own)


def allowed_top(hits: DataFrame, allowed: DataFrame, k: int) -> DataFrame:
    """Top k hits (doc_id, page_idx, score) of each document among its allowed pages (doc_id, page_idx)."""
    kept = hits.join(allowed.select("doc_id", "page_idx").distinct(), ["doc_id", "page_idx"], "left_semi")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "page_idx"))
    return kept.withColumn("place", place).where(F.col("place") <= k).drop("place")

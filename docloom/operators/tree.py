"""From layout items to document trees, as adjacency tables.

Items are rows ``doc_id, ord, type, text, text_level, page_idx, bbox, ...``; a tree is rows ``doc_id, ord,
node_id, parent_ord, ...``. Every window is partitioned by doc_id and ordered by ord, so documents are
independent and each shuffles once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.session import stored

#: Heading levels that are told apart without looking at the items first.
MOST_LEVELS = 12
#: Bytes of items that one task sorts.
TASK_BYTES = 32 << 20
# Id prefixes by item type.
PREFIX = {"section": "sec_", "text": "t_", "paragraph": "t_", "image": "img_", "table": "tab_", "caption": "cap_", "equation": "eq_", "list": "lst_"}


def in_order(*by: str) -> Window:
    return Window.partitionBy("doc_id").orderBy(*(by or ("ord",)))


def by_document(items: DataFrame) -> DataFrame:
    """Items dealt by document over so many tasks that one sorts some ``TASK_BYTES`` of them, or one longer document.

    A job sums their sizes first; the session's number of shuffle partitions would give each task more as the input grows.
    """
    if items.isStreaming:
        return items
    size = F.lit(100) + (F.coalesce(F.octet_length("text"), F.lit(0)) if "text" in items.columns else F.lit(0))
    total = items.agg(F.sum(size.cast("long"))).head()[0] or 0
    return items.repartition(max(items.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES)), "doc_id")


def reindex(items: DataFrame, *, order: str = "ord", column: str = "node_idx") -> DataFrame:
    """Number the rows of each document from 0 in their order, with ids ``doc#n``."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(order)) - 1
    return items.withColumn(column, n).withColumn("uid", F.concat("doc_id", F.lit("#"), F.col(column)))


def adapt_items(items: DataFrame) -> DataFrame:
    """Parser items as nodes: empty texts dropped, levels and captions defaulted, numbered anew.

    ``node_level`` is the text level, -1 for anything that is no heading; media get their bbox as outline.
    """
    kept = items.where(~((F.col("type") == "text") & (F.trim(T.text(F.col("text"))) == "")))
    media = F.col("type").isin("image", "table")
    out = reindex(kept).withColumn("node_level", F.coalesce("text_level", F.lit(-1)))
    return out.withColumn("outline", F.when(media, F.col("bbox"))) if "bbox" in items.columns else out


def new_format(items: DataFrame) -> DataFrame:
    """``doc_id, is_new``: whether a document's items have boxes or types of the newer parser."""
    return items.groupBy("doc_id").agg(F.bool_or(F.col("bbox").isNotNull() | F.col("type").isin("header", "footer", "page_number", "aside_text", "page_footnote", "list", "code")).alias("is_new"))


def with_layout(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """Items with the box of the layout block at the same place of their page; a block's box wins.

    ``blocks`` has ``doc_id, page_idx, pos, bbox``; pages numbered from 1 are shifted to 0.
    """
    item = F.struct(*items.columns)
    left = items.select("doc_id", "page_idx", "ord", F.lit(None).cast("long").alias("place"), item.alias("item"), F.lit(None).cast(blocks.schema["bbox"].dataType).alias("block_bbox"))
    right = blocks.where("doc_id IS NOT NULL AND page_idx IS NOT NULL").select("doc_id", "page_idx", F.lit(None).alias("ord"), F.col("pos").cast("long").alias("place"), F.lit(None).alias("item"), F.col("bbox").alias("block_bbox"))
    block = F.col("item").isNull()
    lowest = F.min(F.when(block, F.col("page_idx"))).over(Window.partitionBy("doc_id"))
    rows = by_document(left.union(right)).withColumn("page_idx", F.col("page_idx") - F.when(block & (lowest == 1), 1).otherwise(0)).withColumn("block", block)
    place = F.row_number().over(Window.partitionBy("doc_id", "page_idx", "block").orderBy("ord")) - 1
    placed = rows.withColumn("place", F.when(F.col("block"), F.col("place")).otherwise(place))
    boxes = F.collect_list(F.when(F.col("block"), F.struct("block_bbox"))).over(Window.partitionBy("doc_id", "page_idx", "place"))
    joined = placed.withColumn("boxes", boxes).where(~F.col("block")).withColumn("boxes", F.when(F.col("doc_id").isNotNull() & F.col("page_idx").isNotNull(), F.col("boxes")))
    return joined.select("item.*", F.explode_outer("boxes").alias("b")).withColumn("bbox", F.coalesce("b.block_bbox", "bbox")).drop("b")


def misaligned_pages(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pages whose numbers of items and blocks differ."""
    a = items.groupBy("doc_id", "page_idx").agg(F.count("*").alias("n_items"))
    b = blocks.groupBy("doc_id", "page_idx").agg(F.count("*").alias("n_blocks"))
    both = a.join(b, ["doc_id", "page_idx"], "full").fillna(0, ["n_items", "n_blocks"])
    return both.where("n_items <> n_blocks")


def block_bbox(block: Column) -> Column:
    """A block's box, else its first line's, else that line's first span's."""
    line = F.get(block["lines"], F.lit(0))
    return F.coalesce(block["bbox"], line["bbox"], F.get(line["spans"], F.lit(0))["bbox"])


def union_bbox(spans: DataFrame, *keys: str) -> DataFrame:
    """Smallest box around the boxes (x0, y0, x1, y1) of each key."""
    return spans.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def is_heading() -> Column:
    """Items that open a section: headings, and texts of level 1 or deeper."""
    return (F.col("type") == "heading") | ((F.col("type") == "text") & (F.coalesce("text_level", F.lit(-1)) >= 1))


def parents(items: DataFrame, *, heading: Column | None = None, level: str = "text_level", levels: int | None = MOST_LEVELS) -> DataFrame:
    """Add ``is_section``, ``parent_ord`` and ``open_ords``, the sections a row lies in from the top.

    A section lies in the latest section before it of a smaller level, anything else in the latest
    section. The latest section of each level is a running last value; the parent is the largest of those
    that qualify, so no stack is kept. ``levels`` is the deepest level there may be; a deeper one is an error when the
    rows are computed. None looks for it in the items first, with a job of its own.
    """
    section = F.coalesce(heading if heading is not None else is_heading(), F.lit(False))
    depth = F.greatest(F.lit(0), F.coalesce(level, F.lit(1))).cast("int")
    if levels is None:
        levels = items.agg(F.max(F.when(section, depth))).head()[0] or 0
    deeper = F.raise_error(F.concat(F.lit("heading level "), depth.cast("string"), F.lit(f" is deeper than levels={levels}")))
    depth = F.when(section & (depth > levels), deeper).otherwise(depth).cast("int")
    before = in_order().rowsBetween(Window.unboundedPreceding, -1)
    rows = by_document(items).withColumn("is_section", section).withColumn("depth_level", depth)
    latest = {n: F.last(F.when(F.col("is_section") & (F.col("depth_level") == n), F.col("ord")), ignorenulls=True).over(before) for n in range(levels + 1)}
    rows = rows.withColumns({f"latest_{n}": c for n, c in latest.items()})
    fits = [F.when(~F.col("is_section") | (F.col("depth_level") > n), F.col(f"latest_{n}")) for n in latest]
    # a level's latest section is still open if no section of a smaller level came after it
    opened = [F.when(F.coalesce(F.col(f"latest_{n}") > F.greatest(F.lit(-1), *fits[:n]), F.lit(False)), fits[n]) if n else fits[0] for n in latest]
    rows = rows.withColumn("parent_ord", F.greatest(*fits)).withColumn("open_ords", F.filter(F.array(*opened), lambda o: o.isNotNull()))
    return rows.drop("depth_level", *(f"latest_{n}" for n in latest))


def build_tree(items: DataFrame, *, levels: int | None = MOST_LEVELS) -> DataFrame:
    """The document tree: ``doc_id, ord, node_id, parent_id, type, level, title, text, page_idx, read_order``.

    Unknown types are dropped; list items become text joined by line breaks. A section's title is the
    first line of its text. ``levels`` as in :func:`parents`.
    """
    known = [*PREFIX, "heading"]
    placed = parents(items.where(F.col("type").isin(*known)), levels=levels)
    kind = F.when(F.col("is_section"), "section").otherwise(F.col("type"))
    prefix = F.create_map(*(F.lit(x) for pair in PREFIX.items() for x in pair))
    named = placed.withColumn("node_type", kind).withColumn("node_id", F.concat(F.element_at(prefix, kind), F.col("ord").cast("string")))
    body = F.when(F.col("type") == "list", F.array_join("list_items", "\n")).otherwise(F.col("text")) if "list_items" in items.columns else F.col("text")
    return named.select(
        "doc_id",
        "ord",
        "node_id",
        F.concat(F.lit("sec_"), F.col("parent_ord").cast("string")).alias("parent_id"),
        F.col("node_type").alias("type"),
        F.when(F.col("is_section"), F.coalesce("text_level", F.lit(1))).alias("level"),
        F.when(F.col("is_section"), T.section_title(F.col("text"))).alias("title"),
        body.alias("text"),
        "page_idx",
        F.row_number().over(in_order()).alias("read_order"),
        F.transform("open_ords", lambda o: F.concat(F.lit("sec_"), o.cast("string"))).alias("ancestors"),
    )


def chapter_tree(items: DataFrame, *, most: int = 3) -> DataFrame:
    """Chapters only: headings up to level ``most``, and a chapter 0 ``Preface`` (ord -1) for what comes first."""
    placed = parents(items, heading=is_heading() & (F.coalesce("text_level", F.lit(1)) <= most))
    preface = placed.groupBy("doc_id").agg(F.min("page_idx").alias("page_idx")).select("doc_id", F.lit(-1).alias("ord"), F.lit(None).cast("int").alias("parent_ord"), F.lit(True).alias("is_section"), F.lit("Preface").alias("title"), F.lit(0).alias("level"), "page_idx")
    rows = placed.select("doc_id", "ord", F.coalesce("parent_ord", F.when(~F.col("is_section"), -1)).alias("parent_ord"), "is_section", F.when(F.col("is_section"), T.section_title(F.col("text"))).alias("title"), F.when(F.col("is_section"), F.coalesce("text_level", F.lit(1))).alias("level"), "page_idx")
    return preface.unionByName(rows)


def page_tree(items: DataFrame) -> DataFrame:
    """``doc_id, page_idx, ords``: the items of each page in order."""
    return items.groupBy("doc_id", "page_idx").agg(F.array_sort(F.collect_list("ord")).alias("ords"))


def slides(items: DataFrame) -> DataFrame:
    """Add ``slide_number``: the place of the item's page among its document's pages, from 1."""
    return items.withColumn("slide_number", F.dense_rank().over(in_order("page_idx")))


def slide_titles(items: DataFrame) -> DataFrame:
    """``doc_id, page_idx, title``: the first text of 8 to 80 characters that is no bullet."""
    return items.where(_titles()).groupBy("doc_id", "page_idx").agg(F.min_by(F.trim("text"), "ord").alias("title"))


def _titles() -> Column:
    return (F.col("type") == "text") & F.length(F.trim("text")).between(8, 80) & ~F.trim("text").rlike(r"^[-*•·▪‣]")


def slide_tree(items: DataFrame) -> DataFrame:
    """Slides as containers: a container, its title and its items for each page, numbered in pre-order."""
    page, order = Window.partitionBy("doc_id", "page_idx").orderBy("ord"), in_order("page_idx", "ord")  # both are met in one sort
    running, whole = order.rowsBetween(Window.unboundedPreceding, 0), page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    title = F.first(F.when(F.col("page_idx").isNotNull() & F.col("ord").isNotNull() & _titles(), F.trim("text")), ignorenulls=True).over(whole)
    rows = by_document(items.select("doc_id", "page_idx", "ord", "type", "text")).withColumn("on_page", F.row_number().over(page)).withColumn("title", title)
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("slide_number", F.count_if(F.col("on_page") == 1).over(running).cast("int"))
    row = lambda ord_, kind, text, n: F.struct(ord_.cast(items.schema["ord"].dataType).alias("ord"), kind.alias("type"), text.alias("text"), n.alias("node_idx"))
    n = F.col("at") + 2 * F.col("slide_number") - 1
    top = row(F.lit(-1), F.lit("slide"), F.lit(None).cast("string"), n - 2)
    title = row(F.lit(-1), F.lit("heading"), F.coalesce("title", F.concat(F.lit("Slide "), F.col("slide_number"))), n - 1)
    body = row(F.col("ord"), F.col("type"), F.col("text"), n)
    return rows.select("doc_id", "page_idx", "slide_number", F.inline(F.when(F.col("on_page") == 1, F.array(top, title, body)).otherwise(F.array(body))))


def prev_next(nodes: DataFrame, *, order: str = "read_order") -> DataFrame:
    """Edges between neighbours on a page: ``doc_id, src, dst, type``."""
    following = F.lead("node_id").over(Window.partitionBy("doc_id", "page_idx").orderBy(order, "ord"))
    rows = nodes.where(F.col("page_idx").isNotNull()).select("doc_id", F.col("node_id").alias("src"), following.alias("dst"))
    return rows.where("dst IS NOT NULL").withColumn("type", F.lit("prev_next"))


def ancestors(nodes: DataFrame, *, most: int | None = None) -> DataFrame:
    """``doc_id, node_id, ancestor, distance`` for every section above a node; distance 1 is the parent.

    Trees that carry ``ancestors`` (from the top) need no join. For others the closure grows by one level a step, each
    a join on (doc_id, node), until ``most`` or, without it, until no node has a further one; then each step is written.
    """
    if "ancestors" in nodes.columns:
        above = nodes.select("doc_id", "node_id", F.size("ancestors").alias("n"), F.posexplode("ancestors").alias("i", "ancestor"))
        return above.select("doc_id", "node_id", "ancestor", (F.col("n") - F.col("i")).alias("distance")).where(F.lit(True) if most is None else F.col("distance") <= most)
    up = nodes.where("parent_id IS NOT NULL").select("doc_id", F.col("node_id").alias("ancestor"), F.col("parent_id").alias("above"))
    steps = [nodes.where("parent_id IS NOT NULL").select("doc_id", "node_id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("distance"))]
    n = 1
    while most is None or n < most:
        n += 1
        step = steps[-1].join(up, ["doc_id", "ancestor"]).select("doc_id", "node_id", F.col("above").alias("ancestor"), F.lit(n).alias("distance"))
        if most is None and (step := stored(step, "ancestors")).isEmpty():
            break
        steps.append(step)
    return reduce(DataFrame.unionByName, steps)


def paths(nodes: DataFrame, *, sep: str = " > ", most: int | None = None) -> DataFrame:
    """``doc_id, node_id, path``: titles of the sections above a node, from the top."""
    above = ancestors(nodes, most=most)
    titles = nodes.where(F.col("title").isNotNull()).select("doc_id", F.col("node_id").alias("ancestor"), "title")
    gathered = above.join(titles, ["doc_id", "ancestor"]).groupBy("doc_id", "node_id").agg(F.collect_list(F.struct((-F.col("distance")).alias("d"), "title")).alias("t"))
    path = F.array_join(F.transform(F.array_sort("t"), lambda x: x["title"]), sep)
    return nodes.select("doc_id", "node_id").join(gathered.select("doc_id", "node_id", path.alias("path")), ["doc_id", "node_id"], "left").fillna("", ["path"])


def depths(nodes: DataFrame, *, most: int | None = None) -> DataFrame:
    """``doc_id, node_id, depth``: sections above a node."""
    deep = ancestors(nodes, most=most).groupBy("doc_id", "node_id").agg(F.max("distance").alias("depth"))
    return nodes.select("doc_id", "node_id").join(deep, ["doc_id", "node_id"], "left").fillna(0, ["depth"])


def level_statistics(nodes: DataFrame, *, most: int | None = None) -> DataFrame:
    """For each depth: nodes, leaves, leaf ratio and mean children of inner nodes, to three places."""
    children = nodes.where("parent_id IS NOT NULL").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n_children"))
    each = depths(nodes, most=most).join(children, ["doc_id", "node_id"], "left").fillna(0, ["n_children"])
    leaves = F.count_if(F.col("n_children") == 0)
    return each.groupBy("depth").agg(
        F.count("*").alias("total"),
        leaves.alias("leaves"),
        F.round(leaves / F.count("*"), 3).alias("leaf_ratio"),
        F.round(F.coalesce(F.avg(F.when(F.col("n_children") > 0, F.col("n_children"))), F.lit(0.0)), 3).alias("avg_children"),
    )


def type_counts(nodes: DataFrame) -> DataFrame:
    """Nodes of each type and document."""
    return nodes.groupBy("doc_id", "type").agg(F.count("*").alias("n"))


def inherited(nodes: DataFrame, column: str, *, most: int | None = None) -> DataFrame:
    """``doc_id, node_id, value``: a node's own value of a column, else its nearest ancestor's."""
    own = nodes.select("doc_id", "node_id", F.lit(0).alias("distance"), F.col(column).alias("value"))
    above = ancestors(nodes, most=most).join(nodes.select("doc_id", F.col("node_id").alias("ancestor"), F.col(column).alias("value")), ["doc_id", "ancestor"])
    both = own.unionByName(above.select("doc_id", "node_id", "distance", "value")).where("value IS NOT NULL")
    found = both.groupBy("doc_id", "node_id").agg(F.min_by("value", "distance").alias("value"))
    return nodes.select("doc_id", "node_id").join(found, ["doc_id", "node_id"], "left")


def flatten_nested(trees: DataFrame, *, levels: int | None = None, root: str = "root") -> DataFrame:
    """Adjacency rows of trees nested as JSON text: ``doc_id, node_id, parent_id, ord_path, node``.

    ``root`` holds a JSON object with ``children``; each level is one explode over parsed arrays of JSON
    texts, ``levels`` of them below the root or, without that, as many as there are; then each level is written. ``node`` is the node's JSON, to be read with a schema of choice.
    """
    row = lambda level: level.select("doc_id", F.get_json_object("node", "$.node_id").alias("node_id"), "parent_id", "ord_path", "node")
    level = trees.select("doc_id", F.lit(None).cast("string").alias("parent_id"), F.array().cast("array<int>").alias("ord_path"), F.col(root).alias("node"))
    out = [row(level)]
    while levels is None or len(out) <= levels:
        kids = F.from_json(F.get_json_object("node", "$.children"), "array<string>")
        level = level.select("doc_id", F.get_json_object("node", "$.node_id").alias("parent_id"), "ord_path", F.posexplode(kids).alias("i", "child"))
        level = level.select("doc_id", "parent_id", F.concat("ord_path", F.array("i")).alias("ord_path"), F.col("child").alias("node"))
        if levels is None and (level := stored(level, "nested")).isEmpty():
            break
        out.append(row(level))
    return reduce(DataFrame.unionByName, out)


def captions(nodes: DataFrame) -> DataFrame:
    """``doc_id, node_id, caption``: the first caption or text below an image or table."""
    texts = nodes.where(F.col("type").isin("caption", "text") & (F.trim(T.text(F.col("text"))) != ""))
    return texts.where("parent_id IS NOT NULL").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.min_by(F.trim("text"), "ord").alias("caption"))

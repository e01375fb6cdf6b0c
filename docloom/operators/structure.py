"""Headings, pages and captions: the order-dependent steps as window expressions.

Each of the sequential rules has a closed form over windows partitioned by document, which the tests
compare with a plain fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.tree import in_order

_PRECEDING = (Window.unboundedPreceding, 0)


def normalise_levels(headings: DataFrame, *, most: int = 6) -> DataFrame:
    """Add ``norm_level``: levels clamped to 1..most that rise by at most 1 from heading to heading.

    Frozen headings keep theirs and restart the rule. With i the heading's number and d its clamped
    level, the result is i plus the running minimum of d - i since the last frozen heading (before any,
    a virtual level 0 at 0 counts).
    """
    i = F.row_number().over(in_order())
    d = F.greatest(F.lit(1), F.least(F.col("level"), F.lit(most)))
    frozen = F.coalesce("frozen", F.lit(False))
    rows = headings.withColumns({"i": i, "d": d}).withColumn("g", F.sum(frozen.cast("int")).over(in_order().rowsBetween(*_PRECEDING)))
    low = F.min(F.col("d") - F.col("i")).over(Window.partitionBy("doc_id", "g").orderBy("ord").rowsBetween(*_PRECEDING))
    rows = rows.withColumn("m", low)
    level = F.col("i") + F.when(F.col("g") == 0, F.least("m", F.lit(0))).otherwise(F.col("m"))
    return rows.withColumn("norm_level", level.cast("int")).drop("i", "d", "g", "m")


def merge_headings(headings: DataFrame, *, allowed: Column | None = None) -> DataFrame:
    """Merge neighbours pairwise: add ``merged_text`` (of the first) and ``absorbed`` (of the second).

    Two neighbours may merge when they stand on one page with level 1 and read as continued, or as
    ``allowed`` says. Pairs are taken from the left without overlap: within a run of allowed pairs, every
    second one.
    """
    after = {c: F.lead(c).over(in_order()) for c in ("text", "page_idx", "level")}
    default = (F.col("page_idx") == after["page_idx"]) & (F.col("level") == 1) & (after["level"] == 1) & T.should_merge_headings(F.col("text"), after["text"])
    can = F.coalesce(allowed if allowed is not None else default, F.lit(False)) & after["text"].isNotNull()
    rows = headings.withColumns({"i": F.row_number().over(in_order()), "can": can, "next_text": after["text"]})
    start = F.coalesce(F.last(F.when(~F.col("can"), F.col("i")), ignorenulls=True).over(in_order().rowsBetween(*_PRECEDING)), F.lit(0)) + 1
    rows = rows.withColumn("start", start)
    rows = rows.withColumn("first", F.col("can") & ((F.col("i") - F.col("start")) % 2 == 0))
    rows = rows.withColumn("absorbed", F.coalesce(F.lag("first").over(in_order()), F.lit(False)))
    merged = F.when(F.col("first"), T.collapse(F.concat_ws(" ", "text", "next_text"))).otherwise(F.col("text"))
    return rows.withColumn("merged_text", merged).drop("i", "can", "next_text", "start", "first")


def anchor_groups(headings: DataFrame) -> DataFrame:
    """Add ``anchor_group``: number of frozen headings up to and with this one."""
    return headings.withColumn("anchor_group", F.sum(F.coalesce("frozen", F.lit(False)).cast("int")).over(in_order().rowsBetween(*_PRECEDING)))


def following_preview(items: DataFrame, *, most: int = 160) -> DataFrame:
    """Add ``preview``: first sentence of the next body text."""
    body = F.when((F.col("type") == "text") & (F.coalesce("level", F.lit(0)) < 1) & (F.trim("text") != ""), F.col("text"))
    following = F.first(body, ignorenulls=True).over(in_order().rowsBetween(1, Window.unboundedFollowing))
    sentence = F.get(F.split(F.trim(following), r"(?<=[.!?])\s+|\n+"), F.lit(0))
    return items.withColumn("preview", F.substring(sentence, 1, most))


def predecessors(headings: DataFrame, *, n: int = 5) -> DataFrame:
    """Add ``before``: the titles of the last ``n`` headings."""
    return headings.withColumn("before", F.collect_list("text").over(in_order().rowsBetween(-n, -1)))


def duplicate_titles(headings: DataFrame) -> DataFrame:
    """Titles that occur twice or more in a document: ``doc_id, title, n, auto``; ``auto`` for up to four words."""
    norm = T.title_norm(F.col("text"))
    counted = headings.where(F.length(norm) <= 60).groupBy("doc_id", norm.alias("title")).agg(F.count("*").alias("n"))
    return counted.where("n >= 2").withColumn("auto", F.size(F.split("title", " ")) <= 4)


def page_run(pages: DataFrame) -> DataFrame:
    """The longest run of consecutive pages whose detected number keeps one offset to the page.

    ``pages``: doc_id, page_idx, number (null: none detected). Result: ``doc_id, offset, start, end, n``.
    Ties: the offset seen first, then the earlier run.
    """
    seen = pages.where("number IS NOT NULL").select("doc_id", "page_idx", (F.col("number") - F.col("page_idx")).alias("offset")).distinct()
    seen = seen.withColumn("seen", F.min("page_idx").over(Window.partitionBy("doc_id", "offset")))
    island = F.col("page_idx") - F.row_number().over(Window.partitionBy("doc_id", "offset").orderBy("page_idx"))
    runs = seen.withColumn("island", island).groupBy("doc_id", "offset", "seen", "island").agg(F.min("page_idx").alias("start"), F.max("page_idx").alias("end"), F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "seen", "start"))
    return runs.withColumn("r", best).where("r = 1").select("doc_id", "offset", "start", "end", "n")


def logical_pages(pages: DataFrame, *, least_run: int = 2, two_up: bool = False) -> DataFrame:
    """Logical page of every page: ``doc_id, page_idx, logical_page``.

    With a run of at least ``least_run`` pages of one offset, a page shows page + offset; two-up scans
    show two numbers, ``a-b``. Pages before number 1 are ``cover``; without a run nothing is known.
    """
    numbered = pages.withColumn("number", F.col("number") - F.col("page_idx")) if two_up else pages
    run = page_run(numbered).where(F.col("n") >= least_run).select("doc_id", "offset")
    joined = pages.join(run, "doc_id", "left")
    if two_up:
        first = 2 * F.col("page_idx") + F.col("offset")
        shown = F.when(first + 1 < 1, F.lit("cover")).otherwise(F.concat(first.cast("string"), F.lit("-"), (first + 1).cast("string")))
    else:
        first = F.col("page_idx") + F.col("offset")
        shown = F.when(first < 1, F.lit("cover")).otherwise(first.cast("string"))
    return joined.select("doc_id", "page_idx", F.when(F.col("offset").isNotNull(), shown).alias("logical_page"))


def toc_pages(pages: DataFrame, *, most: int = 20) -> DataFrame:
    """The contents pages: the first run of consecutive hits among the first ``most`` pages (doc_id, page_idx, is_toc)."""
    hits = pages.where(F.col("is_toc") & (F.col("page_idx") < most))
    island = F.col("page_idx") - F.row_number().over(in_order("page_idx"))
    return hits.withColumn("island", island).withColumn("first", F.min("island").over(Window.partitionBy("doc_id"))).where("island = first").select("doc_id", "page_idx")


def consolidate_toc(items: DataFrame, spans: DataFrame) -> DataFrame:
    """Replace each document's items from ``start`` to ``end`` by one item of type toc, and number anew."""
    joined = items.join(spans.select("doc_id", "start", "end"), "doc_id", "left")
    inside = F.col("ord").between(F.col("start"), F.col("end"))
    kept = joined.where(~F.coalesce(inside, F.lit(False))).select("doc_id", "ord", "type", "text", "page_idx")
    lines = joined.where(inside).groupBy("doc_id").agg(F.min("ord").alias("ord"), F.lit("toc").alias("type"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("text"), F.min("page_idx").alias("page_idx"))
    return kept.unionByName(lines).withColumn("node_idx", F.row_number().over(in_order()) - 1)


def toc_sections(entries: DataFrame, sections: DataFrame) -> DataFrame:
    """Contents entries with the section of the same level and title; of several, the last."""
    target = sections.groupBy("doc_id", "level", T.title_norm(F.col("title")).alias("key")).agg(F.max_by("node_id", "ord").alias("section_id"))
    return entries.withColumn("key", T.title_norm(F.col("title"))).join(target, ["doc_id", "level", "key"], "left").drop("key")


def toc_matches(entries: DataFrame, candidates: DataFrame, *, least: float = 0.3) -> DataFrame:
    """Contents entries with the most similar text of the same logical page (token Jaccard, ties by order).

    Entries without a candidate of at least ``least`` keep a null ``match_ord``: a heading is to be put in.
    """
    words = lambda c: F.array_distinct(T.caption_tokens(F.col(c)))
    asked = entries.select("doc_id", "page", F.col("ord").alias("entry_ord"), words("title").alias("a"))
    pairs = asked.join(candidates.select("doc_id", F.col("logical_page").alias("page"), "ord", words("text").alias("b")), ["doc_id", "page"])
    common = pairs.select("doc_id", "entry_ord", "ord", F.size(F.array_intersect("a", "b")).alias("common"), (F.size("a") + F.size("b")).alias("both"))
    likeness = F.when(F.col("both") == 0, F.lit(0.0)).otherwise(F.col("common") / F.nullif(F.col("both") - F.col("common"), F.lit(0)))
    scored = common.withColumn("similarity", likeness).where(F.col("similarity") >= least)
    best = scored.groupBy("doc_id", "entry_ord").agg(F.max(F.struct("similarity", (-F.col("ord")).alias("o"))).alias("b"))
    found = best.select("doc_id", F.col("entry_ord").alias("ord"), (-F.col("b.o")).alias("match_ord"), F.col("b.similarity").alias("similarity"))
    return entries.join(found, ["doc_id", "ord"], "left")


def media_neighbours(items: DataFrame, *, k: int = 3) -> DataFrame:
    """Texts around each image or table: ``doc_id, media_ord, ord, side, distance``.

    Up to ``k`` texts before and after, on the same run of a page and not beyond the next medium. A
    running count of media names the gap between two of them: texts before a medium lie in the gap
    with one less, texts after it in its own.
    """
    media = F.col("type").isin("image", "table")
    change = F.coalesce((F.col("page_idx") != F.lag("page_idx").over(in_order())).cast("int"), F.lit(0))
    rows = items.withColumns({"is_media": media, "change": change})
    running = in_order().rowsBetween(*_PRECEDING)
    rows = rows.withColumns({"run": F.sum("change").over(running), "gap": F.sum(F.col("is_media").cast("int")).over(running)})
    texts = rows.where(F.col("type") == "text").select("doc_id", "run", "gap", "ord")
    owners = rows.where("is_media").select("doc_id", "run", "gap", F.col("ord").alias("media_ord"))
    before = owners.withColumn("gap", F.col("gap") - 1).join(texts, ["doc_id", "run", "gap"]).where("ord < media_ord").withColumn("side", F.lit("before"))
    after = owners.join(texts, ["doc_id", "run", "gap"]).where("ord > media_ord").withColumn("side", F.lit("after"))
    both = before.unionByName(after)
    distance = F.row_number().over(Window.partitionBy("doc_id", "media_ord", "side").orderBy(F.abs(F.col("ord") - F.col("media_ord"))))
    return both.withColumn("distance", distance).where(F.col("distance") <= k).select("doc_id", "media_ord", "ord", "side", "distance")


def overlap_1d(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two intervals over the shorter one's length; 0 without length."""
    shared = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    shorter = F.least(a1 - a0, b1 - b0)
    return F.when(shorter > 0, shared / F.nullif(shorter, F.lit(0.0))).otherwise(0.0)


def same_column(a: str, b: str, *, least: float = 0.3) -> Column:
    """Whether boxes ``a`` and ``b`` (structs x0..y1) overlap sideways by at least ``least``."""
    return overlap_1d(F.col(f"{a}.x0"), F.col(f"{a}.x1"), F.col(f"{b}.x0"), F.col(f"{b}.x1")) >= least


def area(box: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(f"{box}.x1") - F.col(f"{box}.x0")) * F.greatest(F.lit(0.0), F.col(f"{box}.y1") - F.col(f"{box}.y0"))


def skip_media(box: str, width: Column, height: Column, *, least: float = 0.005, most: float = 0.9, edge: float = 2.0) -> Column:
    """Media to skip: too small a share of the page, or nearly all of it and touching three edges."""
    ratio = area(box) / F.nullif(width * height, F.lit(0.0))
    touching = sum(((c).cast("int") for c in (F.col(f"{box}.x0") <= edge, F.col(f"{box}.y0") <= edge, F.col(f"{box}.x1") >= width - edge, F.col(f"{box}.y1") >= height - edge)), F.lit(0))
    return (ratio < least) | ((ratio > most) & (touching >= 3))


def strip_repeated_title(captions: DataFrame) -> DataFrame:
    """Add ``stripped``: a caption without the previous row's text where it starts with it, on the same page.

    White space does not count in the comparison: ``Fig. 1 (a)`` starts with ``Fig.1``.
    """
    before = F.regexp_replace(F.lag("text").over(Window.partitionBy("doc_id", "page_idx").orderBy("ord")), r"\s+", "")
    dense = F.regexp_replace(F.col("text"), r"\s+", "")
    starts = (F.length(before) > 0) & F.startswith(dense, before) & (F.length(dense) > F.length(before))
    # the place in the caption behind as many characters that are no white space
    count = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("at"))
    step = lambda a, c: F.when(a["seen"] >= F.length("__before"), a).otherwise(F.struct((a["seen"] + F.when(c.rlike(r"^\s$"), 0).otherwise(1)).alias("seen"), (a["at"] + 1).alias("at")))
    cut = F.aggregate(F.filter(F.split("text", ""), lambda c: c != ""), count, step)["at"]
    rows = captions.withColumn("__before", F.when(starts, before))
    return rows.withColumn("stripped", F.when(F.col("__before").isNotNull(), F.trim(F.substring(F.col("text"), cut + 1, F.length("text")))).otherwise(F.col("text"))).drop("__before")


def apply_captions(items: DataFrame, roles: DataFrame, *, least: float = 0.5) -> DataFrame:
    """Write caption roles (doc_id, ord, media_ord, role) to items and take the heading off captions.

    A text of level 1 that repeats one of its medium's captions (token Jaccard at least ``least``) becomes
    level 0.
    """
    texts = items.select("doc_id", F.col("ord").alias("media_ord"), F.col("captions"))
    joined = items.drop("captions").join(roles, ["doc_id", "ord"], "left").join(texts, ["doc_id", "media_ord"], "left")
    similar = F.exists(F.coalesce("captions", F.array().cast("array<string>")), lambda c: T.jaccard(T.caption_tokens(c), T.caption_tokens(F.col("text"))) >= least)
    level = F.when((F.col("level") == 1) & F.col("role").isNotNull() & similar, 0).otherwise(F.col("level"))
    return joined.withColumn("level", level).drop("captions")


def promote_media(items: DataFrame, spans: DataFrame) -> DataFrame:
    """Give the first medium with a caption in each span (doc_id, start, end, level) the span's heading level."""
    inside = items.join(spans, "doc_id").where(F.col("ord").between(F.col("start"), F.col("end")) & F.col("type").isin("image", "table"))
    first = inside.groupBy("doc_id", "start").agg(F.min("ord").alias("ord"), F.first("level").alias("promoted"))
    return items.join(first.select("doc_id", "ord", "promoted"), ["doc_id", "ord"], "left")


def orphan_groups(elements: DataFrame) -> DataFrame:
    """Elements without a chapter that are no title, grouped by page: ``doc_id, page_idx, ords, n``."""
    lost = elements.where((F.col("parent") == -1) & (F.col("type") != "title"))
    return lost.groupBy("doc_id", "page_idx").agg(F.array_sort(F.collect_list("ord")).alias("ords"), F.count("*").alias("n"))

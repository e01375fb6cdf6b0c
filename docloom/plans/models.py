"""Steps that a language or vision model decides, as slots over DataFrames.

A model is a callable from prompts to replies, a batch of texts at a time. Every step builds one payload a
row, asks the model in Arrow batches, reads the JSON of the reply with a schema, and drops what is malformed:
a reply that cannot be read changes nothing. Without a model each step has a rule to fall back on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import lookup, structure, tree
from docloom.session import stored

Model = Callable[[list[str]], list[str]]


def ask_model(payloads: DataFrame, model: Model, *, prompt: str = "{payload}", batch: int = 16) -> DataFrame:
    """Rows with ``reply``: what the model says to the prompt with each row's ``payload`` put in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = [prompt.replace("{payload}", p or "") for p in rows["payload"]]
            replies = [r for at in range(0, len(texts), batch) for r in model(texts[at : at + batch])]
            yield rows.assign(reply=replies)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in payloads.schema)
    return payloads.mapInPandas(run, f"{fields}, reply string")


def _read(replies: DataFrame, item: str, *keys: str) -> DataFrame:
    """One row for each item of the replies' ``items`` list, with its place ``n``."""
    parsed = T.loose_json(F.col("reply"), f"items array<struct<{item}>>")
    return replies.select(*keys, F.posexplode(parsed["items"]).alias("n", "x")).select(*keys, "n", "x.*")


def toc_entries(items: DataFrame, model: Model | None = None) -> DataFrame:
    """Contents entries of contents pages: ``doc_id, ord, level, title, page``.

    Without a model, lines of contents pages with a page number at their end are entries, their level the
    depth of their numbering, at least 1. ``ord`` is the entry's place among the document's.
    """
    if model is not None:
        found = _read(ask_model(lookup.toc_payload(items), model), "level:int,title:string,page:string", "doc_id", "page_idx")
        found = found.where("trim(title) <> ''")
    else:
        lines = items.select("doc_id", "page_idx", "ord", F.posexplode(F.split("text", "\n")).alias("i", "line"))
        pattern = r"^\s*(.*?\S)[\s.·…]*\s(\d+|[ivxlc]+)\s*$"
        lines = lines.where(F.col("line").rlike(pattern))
        title = F.regexp_extract("line", pattern, 1)
        found = lines.select("doc_id", "page_idx", F.struct("ord", "i").alias("n"), F.greatest(F.lit(1), T.numbering(title)["depth"]).alias("level"), title.alias("title"), F.regexp_extract("line", pattern, 2).alias("page"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_idx", "n")) - 1
    return found.withColumn("ord", place).select("doc_id", "ord", "level", "title", "page")


def contents_pages(items: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, page_idx``: pages that hold contents, as the model says, else those with three entries or more."""
    if model is None:
        entries = items.select("doc_id", "page_idx", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"\S[\s.·…]*\s(\d+|[ivxlc]+)\s*$"))
        return entries.groupBy("doc_id", "page_idx").agg(F.count("*").alias("n")).where("n >= 3").select("doc_id", "page_idx")
    told = ask_model(lookup.toc_payload(items), model)
    return told.where(T.loose_json(F.col("reply"), "is_toc boolean")["is_toc"]).select("doc_id", "page_idx")


def heading_levels(headings: DataFrame, model: Model | None = None) -> DataFrame:
    """Headings (doc_id, ord, text, level) with ``chosen`` and ``level`` as a model decides over each document's list.

    Without a model a heading is chosen if its text reads like one, and its level is the depth of its
    numbering, else its own. What the model does not name keeps its level and is chosen.
    """
    if model is None:
        depth = T.numbering(F.col("text"))["depth"]
        return headings.withColumn("chosen", T.is_heading_text(F.col("text"))).withColumn("level", F.when(depth > 0, depth).otherwise(F.col("level")))
    lines = F.to_json(F.array_sort(F.collect_list(F.struct("ord", "level", "text"))))
    told = _read(ask_model(headings.groupBy("doc_id").agg(lines.alias("payload")), model), "ord:long,level:int,keep:boolean", "doc_id")
    told = told.dropDuplicates(["doc_id", "ord"]).select("doc_id", "ord", F.col("level").alias("__level"), "keep")
    joined = headings.join(told, ["doc_id", "ord"], "left")
    return joined.withColumn("chosen", F.coalesce("keep", F.lit(True))).withColumn("level", F.coalesce("__level", "level")).drop("__level", "keep")


def restructure(items: DataFrame, *, toc_model: Model | None = None, level_model: Model | None = None) -> DataFrame:
    """Items (doc_id, ord, page_idx, type, text, level, logical_page) with the levels that their document's contents give.

    Case 1, contents with page numbers: an entry's heading is the most similar text of its logical page, and
    takes the entry's level. Case 2, contents without: entries are aligned with texts in order. Case 3, no
    contents: headings are chosen and levelled by themselves. Adds ``from_toc``.
    """
    pages = contents_pages(items, toc_model)
    entries = toc_entries(items.join(pages, ["doc_id", "page_idx"], "left_semi"), toc_model)
    cases = lookup.toc_case(entries, items)
    rest = items.join(pages, ["doc_id", "page_idx"], "left_anti").where("type = 'text'")
    of = lambda case: cases.where(F.col("toc_case") == case).select("doc_id")
    paged = structure.toc_matches(entries.join(of(1), "doc_id", "left_semi"), rest).select("doc_id", F.col("match_ord").alias("ord"), F.col("level").alias("__level"))
    second = entries.join(of(2), "doc_id", "left_semi")
    ordered = lookup.align_in_order(second, rest).join(second.select("doc_id", "ord", "level"), ["doc_id", "ord"]).select("doc_id", F.col("match_ord").alias("ord"), F.col("level").alias("__level"))
    found = paged.unionByName(ordered).where("ord IS NOT NULL").groupBy("doc_id", "ord").agg(F.min("__level").alias("__level"))
    marked = items.join(found, ["doc_id", "ord"], "left").withColumn("from_toc", F.col("__level").isNotNull()).withColumn("level", F.coalesce("__level", "level")).drop("__level")
    alone = marked.join(of(3), "doc_id", "left_semi").where(lookup.heading_candidate())
    levelled = heading_levels(alone.select("doc_id", "ord", "text", "level"), level_model).select("doc_id", "ord", F.when(F.col("chosen"), F.col("level")).otherwise(0).alias("__own"))
    return marked.join(levelled, ["doc_id", "ord"], "left").withColumn("level", F.coalesce("__own", "level")).drop("__own")


def caption_roles(items: DataFrame, model: Model | None = None, *, k: int = 3) -> DataFrame:
    """``doc_id, ord, media_ord, role``: which texts around a medium are its captions or footnotes.

    Without a model, a neighbour that opens with a figure or table label is a caption, one that opens with a
    source or note mark a footnote. A text belongs to its nearest medium.
    """
    near = structure.media_neighbours(items, k=k)
    if model is None:
        texts = near.join(items.select("doc_id", "ord", "text"), ["doc_id", "ord"])
        role = F.when(F.col("text").rlike(r"(?i)^\s*(fig(ure)?|table|图|表)\b?\.?\s*[A-Za-z]*\d"), "caption").when(F.col("text").rlike(r"(?i)^\s*(source|notes?)\s*[:：]"), "footnote")
        told = texts.withColumn("role", role).where("role IS NOT NULL").select("doc_id", "media_ord", "ord", "role", "distance")
    else:
        said = _read(ask_model(lookup.caption_payload(near, items), model), "ord:int,role:string", "doc_id", "media_ord").where("role IN ('caption', 'footnote')").drop("n")
        told = said.join(near.select("doc_id", "media_ord", "ord", "distance"), ["doc_id", "media_ord", "ord"])
    first = F.row_number().over(Window.partitionBy("doc_id", "ord").orderBy("distance", "media_ord"))
    return told.withColumn("__r", first).where("__r = 1").select("doc_id", "ord", "media_ord", "role")


def clean_captions(items: DataFrame, model: Model | None = None, *, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Items with their caption roles written and captions taken off the headings, and the counts of what was found."""
    roles = caption_roles(items, model, k=k)
    if model is not None:
        roles = stored(roles, "caption-roles")  # the model is asked once for both results
    texts = roles.where("role = 'caption'").join(items.select("doc_id", "ord", "text"), ["doc_id", "ord"])
    held = texts.groupBy("doc_id", F.col("media_ord").alias("ord")).agg(F.array_sort(F.collect_set("text")).alias("captions"))
    return structure.apply_captions(items.join(held, ["doc_id", "ord"], "left"), roles), lookup.caption_statistics(roles)


def page_numbers(items: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, page_idx, logical_page``: the number printed on each page, else null.

    Without a model it is the last item that is a number or Roman numeral alone.
    """
    if model is None:
        number = F.when(T.logical_page_bounds(F.col("text"))["lo"].isNotNull(), F.trim("text"))
        return items.groupBy("doc_id", "page_idx").agg(F.max_by(number, F.when(number.isNotNull(), F.col("ord"))).alias("logical_page"))
    told = ask_model(lookup.toc_payload(items), model)
    return told.select("doc_id", "page_idx", F.nullif(F.trim(T.loose_json(F.col("reply"), "page string")["page"]), F.lit("")).alias("logical_page"))


def slide_titles(items: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, page_idx, title`` of slides; what the model does not tell is found by rule."""
    own = tree.slide_titles(items)
    if model is None:
        return own
    told = ask_model(lookup.toc_payload(items), model).select("doc_id", "page_idx", F.nullif(F.trim(T.loose_json(F.col("reply"), "title string")["title"]), F.lit("")).alias("told"))
    return told.join(own, ["doc_id", "page_idx"], "full").select("doc_id", "page_idx", F.coalesce("told", "title").alias("title")).where("title IS NOT NULL")


def summaries(summary: DataFrame, model: Model | None = None) -> DataFrame:
    """Summary nodes with the model's ``dense_text`` and ``hints`` where it gives them."""
    if model is None:
        return summary
    payload = F.to_json(F.struct("role", "title", F.col("dense_text").alias("text")))
    told = ask_model(summary.select("doc_id", "node_id", payload.alias("payload")), model)
    told = told.select("doc_id", "node_id", T.loose_json(F.col("reply"), "summary string, hints array<string>").alias("t"))
    joined = summary.join(told, ["doc_id", "node_id"], "left")
    text, hints = F.nullif(F.trim("t.summary"), F.lit("")), F.filter("t.hints", lambda h: F.trim(h) != "")
    return joined.withColumn("dense_text", F.coalesce(text, "dense_text")).withColumn("hints", F.when(F.size(hints) > 0, F.slice(hints, 1, 8)).otherwise(F.col("hints"))).drop("t")


def graded(samples: DataFrame, model: Model | None = None) -> DataFrame:
    """Samples (question, answer, pred) with ``extracted`` (the short answer in a long one) and ``score``.

    Without a model the extracted answer is the prediction's last line, and the score the metric's.
    """
    from docloom.functions import scoring

    if model is None:
        last = F.trim(F.element_at(F.split(F.trim(T.text(F.col("pred"))), "\n"), -1))
        return samples.withColumn("extracted", last).withColumn("score", scoring.answer_score(F.col("answer"), F.col("extracted"), F.col("answer_format")))
    told = ask_model(samples.withColumn("payload", F.to_json(F.struct("question", "answer", "pred"))), model)
    t = T.loose_json(F.col("reply"), "extracted string, score double")
    return told.withColumn("extracted", F.coalesce(t["extracted"], "pred")).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t["score"], F.lit(0.0))))).drop("payload", "reply")

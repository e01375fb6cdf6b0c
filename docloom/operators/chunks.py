"""Cutting texts into chunks.

Where a chunk ends depends on the text before it, so these are folds. They run in Arrow batches, one
text or one section at a time; sections of one document never share a fold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.session import ship_package


def cut(text: str | None, *, limit: int = 600, overlap: int = 80) -> list[str]:
    """Chunks of at most ``limit`` characters, ended at the last space beyond 60 % where there is one."""
    s = re.sub(r"\s+", " ", (text or "").strip())
    out, start = [], 0
    while start < len(s):
        end = min(start + limit, len(s))
        if end < len(s):
            space = s.rfind(" ", start + int(0.6 * limit), end)
            end = space if space > start else end
        out.append(s[start:end].strip())
        if end >= len(s):
            break
        start = max(end - overlap, 0)
    return [c for c in out if c]


def chunk_texts(rows: DataFrame, *, text_col: str = "text", limit: int = 600, overlap: int = 80) -> DataFrame:
    """Rows exploded into ``chunk_idx`` and ``raw_text``, with ids ``node#cN``."""

    ship_package(rows.sparkSession)

    @F.pandas_udf("array<string>")
    def pieces(text: pd.Series) -> pd.Series:
        return text.map(lambda t: cut(t, limit=limit, overlap=overlap))

    out = rows.select("*", F.posexplode(pieces(F.col(text_col))).alias("chunk_idx", "raw_text"))
    return out.withColumn("orig_node_id", F.col("node_id")).withColumn("node_id", F.concat("node_id", F.lit("#c"), F.col("chunk_idx")))


def leaf_blocks(leaves: DataFrame, *, least: int = 280, most: int = 720, overlap: int = 80) -> DataFrame:
    """Raw blocks of leaves (doc_id, parent_section, page_idx, node_id, raw_text): merged, then split.

    Leaves of a section and page, in the order of their ids as texts (of ``orig_node_id`` and ``chunk_idx`` first, where
    they are given), are joined by a space until a block has ``least`` characters; a leaf without text only opens a
    block. Blocks over ``most`` are split with an overlap, up to a piece that is blank. Texts keep their blanks. The
    leaves of a section and page are one array, folded with the block so far as state.
    """
    origin = F.coalesce("orig_node_id", F.lit("")) if "orig_node_id" in leaves.columns else F.col("node_id")
    place = F.coalesce(F.col("chunk_idx").cast("int"), F.lit(0)) if "chunk_idx" in leaves.columns else F.lit(0)
    leaf = F.struct(origin.alias("o"), place.alias("c"), F.col("node_id").alias("id"), F.coalesce("raw_text", F.lit("")).alias("t"))
    kind = "array<struct<id:string,t:string>>"
    groups = leaves.groupBy("doc_id", "parent_section", "page_idx").agg(F.transform(F.array_sort(F.collect_list(leaf)), lambda u: F.struct(u["id"].alias("id"), u["t"].alias("t"))).cast(kind).alias("leaves"))

    def step(state, u):
        held, n = state["held"], F.length(u["t"])
        opens, full = F.size(held) == 0, state["n"] >= least
        kept = F.when(opens | full, F.array(u)).when(n == 0, held).otherwise(F.concat(held, F.array(u)))
        size = F.when(opens | full, n).when(n == 0, state["n"]).otherwise(state["n"] + n + 1)
        return F.struct(kept.alias("held"), size.alias("n"), F.when(~opens & full, F.concat(state["out"], F.array(held))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.array().cast(kind).alias("held"), F.lit(0).alias("n"), F.array().cast(f"array<{kind}>").alias("out"))
    blocks = F.aggregate("leaves", start, step, lambda s: F.concat(s["out"], F.array(s["held"])))
    stride = most - overlap

    def split(block):
        joined = F.array_join(F.filter(F.transform(block, lambda u: u["t"]), lambda t: t != ""), " ")
        more = F.ceil(F.greatest(F.lit(0), F.length(joined) - most) / F.lit(stride)).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), more), lambda i: F.substring(joined, i * stride + 1, F.lit(most)))
        blank = F.array_position(F.transform(pieces, lambda p: ~p.rlike(r"\S")), True)
        told = F.when(blank > 0, F.slice(pieces, F.lit(1), (blank - 1).cast("int"))).otherwise(pieces)
        ids = F.transform(block, lambda u: u["id"])
        return F.transform(told, lambda p: F.struct(F.get(ids, F.lit(0)).alias("node_id"), p.alias("raw_text"), ids.alias("source_ids")))

    out = groups.select("doc_id", "parent_section", "page_idx", F.posexplode(F.flatten(F.transform(blocks, split))).alias("block_idx", "b"))
    return out.select("doc_id", "parent_section", "page_idx", "b.node_id", "block_idx", "b.raw_text", "b.source_ids")


def section_chunks(units: DataFrame, *, most: int = 1800, overlap: int = 300, across_pages: bool = False) -> DataFrame:
    """Retrieval chunks of sections (doc_id, section_id, section_path, ord, page_idx, node_id, text).

    Units are packed in reading order until the next one would pass ``most`` characters; the chunk after that starts
    with the last whole units that ``overlap`` characters hold, a line break each, and their ids. A new page starts a
    new chunk without overlap, unless chunks may go ``across_pages``. Each chunk begins with its section's path;
    ``page_idx`` is its page, null if it has several, ``page_lo`` and ``page_hi`` the first and last. Blank units and
    nulls are left out. A section's units are one array, folded with an array of the chunk so far as state.
    """
    kind = dict(units.dtypes)
    text = F.regexp_replace("text", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    unit = f"array<struct<t:string,id:string,p:{kind['page_idx']}>>"
    rows = units.withColumn("t", text).where("t <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("ord", "node_id", "page_idx", "t")))
    sections = rows.groupBy("doc_id", "section_id").agg(F.min_by("section_path", "ord").alias("path"), F.transform(ordered, lambda u: F.struct(u["t"].alias("t"), u["node_id"].alias("id"), u["page_idx"].alias("p"))).alias("units"))
    size = lambda us: F.aggregate(us, F.lit(0), lambda n, u: n + F.length(u["t"]))

    def tail(us):
        last = lambda k: F.slice(us, F.size(us) - k + 1, k)
        fits = F.filter(F.sequence(F.lit(0), F.size(us)), lambda k: size(last(k)) + k <= overlap)
        return last(F.array_max(fits))

    def step(state, u):
        held = state["held"]
        page = F.element_at(held, -1)["p"]
        turned = F.lit(False) if across_pages else (F.size(held) > 0) & F.coalesce(page.isNotNull() & ~page.eqNullSafe(u["p"]), F.lit(False))
        full = (F.size(held) > 0) & (size(held) + F.length(u["t"]) > most)
        kept = F.when(turned, F.slice(held, 1, 0)).when(full, tail(held)).otherwise(held)
        return F.struct(F.concat(kept, F.array(u)).alias("held"), F.when(turned | full, F.concat(state["out"], F.array(held))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.array().cast(unit).alias("held"), F.array().cast(f"array<{unit}>").alias("out"))
    folded = F.aggregate(F.col("units").cast(unit), start, step, lambda s: F.concat(s["out"], F.array(s["held"])))
    chunk = sections.select("doc_id", "section_id", "path", F.posexplode(folded).alias("chunk_idx", "c"))
    pages = F.filter(F.transform("c", lambda u: u["p"]), lambda p: p.isNotNull())
    joined = F.array_join(F.transform("c", lambda u: u["t"]), "\n")
    lo, hi = F.array_min(pages), F.array_max(pages)
    return chunk.select("doc_id", "section_id", "chunk_idx", F.concat(F.lit("["), F.coalesce("path", F.lit("")), F.lit("]\n"), joined).alias("text"), F.when(lo == hi, lo).alias("page_idx"), lo.alias("page_lo"), hi.alias("page_hi"), F.transform("c", lambda u: u["id"]).alias("source_node_ids"))


def chapter_blocks(elements: DataFrame, *, most_words: int = 400) -> DataFrame:
    """Blocks of chapters (doc_id, chapter, ord, title, text, page_idx): split when ``most_words`` would be passed.

    Each block repeats the chapter's title; ``word_count, element_count, page_lo, page_hi`` and the
    elements' orders come with it.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord")
        blocks, held, words = [], [], 0
        for row in group.itertuples():
            n = len((row.text or "").split())
            if held and words + n > most_words:
                blocks.append((held, words))
                held, words = [], 0
            held.append(row)
            words += n
        if held:
            blocks.append((held, words))
        title = group["title"].iloc[0]
        rows = [(i, title, w, len(h), min(r.page_idx for r in h), max(r.page_idx for r in h), [r.ord for r in h]) for i, (h, w) in enumerate(blocks)]
        frame = pd.DataFrame(rows, columns=["block", "title", "word_count", "element_count", "page_lo", "page_hi", "ords"])
        frame.insert(0, "chapter", group["chapter"].iloc[0])
        frame.insert(0, "doc_id", group["doc_id"].iloc[0])
        return frame

    kind = dict(elements.dtypes)
    schema = f"doc_id {kind['doc_id']}, chapter {kind['chapter']}, block int, title string, word_count int, element_count int, page_lo {kind['page_idx']}, page_hi {kind['page_idx']}, ords array<{kind['ord']}>"
    return elements.groupBy("doc_id", "chapter").applyInPandas(fold, schema)


def block_stats(elements: DataFrame) -> DataFrame:
    """``doc_id, block, word_count, element_count, page_lo, page_hi, n_text, n_table, n_figure``."""
    words = F.sum(F.when(F.trim("text") == "", 0).otherwise(F.size(F.split(F.trim("text"), r"\s+"))))
    of = lambda *k: F.count_if(F.col("type").isin(*k))
    return elements.groupBy("doc_id", "block").agg(F.coalesce(words, F.lit(0)).alias("word_count"), F.count("*").alias("element_count"), F.min("page_idx").alias("page_lo"), F.max("page_idx").alias("page_hi"), of("text", "paragraph").alias("n_text"), of("table").alias("n_table"), of("image", "figure").alias("n_figure"))


_WORD = re.compile(T.SUMMARY_TOKEN)
STOP = frozenset(T.STOPWORDS)


def sentence_idf(sentences: list[str]) -> dict[str, float]:
    """IDF of words over sentences, stop words left out: 1 + max(0, ln((1 + n) / (1 + df)))."""
    df = Counter(w for s in sentences for w in {w.lower() for w in _WORD.findall(s)} - STOP)
    return {w: 1.0 + max(0.0, math.log((1 + len(sentences)) / (1 + n))) for w, n in df.items()}


def sentence_idfs(rows: DataFrame, sentences_col: str, *keys: str) -> DataFrame:
    """:func:`sentence_idf` of every row's array of sentences: ``keys, word, df, idf``; ``keys`` name a row.

    Rows are dealt by their keys first, so that sentences are exchanged once, not the words of each.
    """
    each = rows.select(*keys, sentences_col).repartition(*keys).select(*keys, F.size(sentences_col).alias("n"), F.explode(sentences_col).alias("sentence"))
    single = each.select(*keys, "n", F.explode(F.array_distinct(T.tokens(F.col("sentence"), T.SUMMARY_TOKEN))).alias("word")).where(~F.col("word").isin(*STOP))
    idf = 1 + F.greatest(F.lit(0.0), F.ln((1 + F.col("n")) / (1 + F.col("df"))))
    return single.groupBy(*keys, "n", "word").agg(F.count("*").alias("df")).select(*keys, "word", "df", idf.alias("idf"))


def summarise(sentences: list[str], *, k: int = 3, budget: int = 360, trade: float = 0.75, keywords: tuple[str, ...] = ()) -> str:
    """At most ``k`` sentences, in the order of their choice: relevant, and unlike those chosen before.

    Relevance is the sum of a sentence's TF-IDF weights over its words (5 at least), up to half as much again for
    ``keywords`` in it. Each choice takes the best ``trade * relevance - (1 - trade) * most similar chosen one``, at nine
    decimals, the earlier sentence if equal. Choosing ends once ``budget`` characters are reached; a longer text is cut
    at its last space within them.
    """
    idf, wanted = sentence_idf(sentences), {w.lower() for w in keywords}
    words = [[w.lower() for w in _WORD.findall(s)] for s in sentences]
    vectors = [{w: n * idf[w] for w, n in Counter(x for x in ws if x not in STOP).items()} for ws in words]
    norms = [math.sqrt(sum(v * v for v in x.values())) or 1.0 for x in vectors]
    boost = [1 + min(0.5, 0.1 * sum(w in wanted for w in ws)) for ws in words]
    relevance = [b * sum(x.values()) / max(5, len(ws)) for x, ws, b in zip(vectors, words, boost, strict=True)]
    closest = [0.0] * len(sentences)
    chosen: list[int] = []
    while len(chosen) < min(k, len(sentences)):
        worth = [(-round(trade * relevance[i] - (1 - trade) * closest[i], 9), i) for i in range(len(sentences)) if i not in chosen]
        last = min(worth)[1]
        chosen.append(last)
        if len(" ".join(sentences[i] for i in chosen)) >= budget:
            break
        for i, x in enumerate(vectors):
            near = sum(v * vectors[last].get(w, 0.0) for w, v in x.items()) / (norms[i] * norms[last])
            closest[i] = near if len(chosen) == 1 else max(closest[i], near)
    text = " ".join(sentences[i] for i in chosen)
    return (text if len(text) <= budget else text[:budget].rsplit(" ", 1)[0]).strip()


def summarise_texts(rows: DataFrame, sentences_col: str, *, k: int = 3, budget: int = 360) -> DataFrame:
    """Add ``summary`` from an array of sentences."""

    ship_package(rows.sparkSession)

    @F.pandas_udf("string")
    def pick(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda s: summarise([x for x in s if x], k=k, budget=budget) if s is not None else "")

    return rows.withColumn("summary", pick(F.col(sentences_col)))

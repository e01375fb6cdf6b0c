"""Queries of headings, logical pages, contents and captions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import structure
from docloom.queries.base import Family
from docloom.queries.tree import ITEMS_SQL, items

FAMILY = Family()

_HEADS = f"{ITEMS_SQL}, heads AS (SELECT doc_id, ord, text, page_idx, ((length(text) + ord) % 9 + 1)::INT AS level, ord % 23 = 7 AS frozen, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM items WHERE type = 'text')"


def _heads(spark, sf_dir):
    level = (F.length("text") + F.col("ord")) % 9 + 1
    return items(spark, sf_dir).where("type = 'text'").select("doc_id", "ord", "text", "page_idx", level.cast("int").alias("level"), (F.col("ord") % 23 == 7).alias("frozen"))


@FAMILY.add(
    f"""WITH RECURSIVE {_HEADS},
fold AS (SELECT doc_id, ord, i, CASE WHEN frozen THEN greatest(1, least(level, 6)) ELSE least(greatest(1, least(level, 6)), 1) END AS n FROM heads WHERE i = 1
  UNION ALL SELECT h.doc_id, h.ord, h.i, CASE WHEN h.frozen THEN greatest(1, least(h.level, 6)) ELSE least(greatest(1, least(h.level, 6)), f.n + 1) END FROM fold f JOIN heads h ON h.doc_id = f.doc_id AND h.i = f.i + 1)
SELECT doc_id, ord, n::BIGINT AS norm_level FROM fold"""
)
def heading_levels(spark, sf_dir):
    """Heading levels without jumps, checked against the sequential rule."""
    return structure.normalise_levels(_heads(spark, sf_dir)).select("doc_id", "ord", F.col("norm_level").cast("long").alias("norm_level"))


@FAMILY.add(
    f"""WITH RECURSIVE {_HEADS},
can AS (SELECT doc_id, ord, i, lead(page_idx) OVER w = page_idx AND length(text) % 2 = 0 AS c FROM heads WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
fold AS (SELECT doc_id, ord, i, coalesce(c, false) AS first, false AS absorbed FROM can WHERE i = 1
  UNION ALL SELECT n.doc_id, n.ord, n.i, coalesce(n.c, false) AND NOT f.first, f.first FROM fold f JOIN can n ON n.doc_id = f.doc_id AND n.i = f.i + 1)
SELECT doc_id, ord, absorbed FROM fold"""
)
def heading_merge(spark, sf_dir):
    """Which headings are absorbed by the one before, checked against the sequential rule."""
    heads = _heads(spark, sf_dir)
    allowed = (F.lead("page_idx").over(structure.in_order()) == F.col("page_idx")) & (F.length("text") % 2 == 0)
    return structure.merge_headings(heads, allowed=allowed).select("doc_id", "ord", "absorbed")


@FAMILY.add(f"WITH {_HEADS} SELECT doc_id, ord, sum(frozen::INT) OVER (PARTITION BY doc_id ORDER BY ord)::BIGINT AS anchor_group FROM heads")
def heading_anchor_groups(spark, sf_dir):
    """Headings grouped between frozen ones."""
    return structure.anchor_groups(_heads(spark, sf_dir)).select("doc_id", "ord", "anchor_group")


@FAMILY.add(f"WITH {_HEADS} SELECT doc_id, ord, coalesce(array_to_string(list(text) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '|'), '') AS before FROM heads")
def heading_predecessors(spark, sf_dir):
    """The five headings before each."""
    return structure.predecessors(_heads(spark, sf_dir)).select("doc_id", "ord", F.array_join("before", "|").alias("before"))


@FAMILY.add(
    f"""WITH {ITEMS_SQL}, b AS (SELECT doc_id, ord, CASE WHEN type = 'text' AND coalesce(text_level, 0) < 1 AND trim(text) <> '' THEN text END AS body FROM items)
SELECT doc_id, ord, substr(string_split(regexp_replace(trim(first_value(body IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), '([.!?])\\s+', '\\1' || chr(10)), chr(10))[1], 1, 160) AS preview FROM b"""
)
def heading_preview(spark, sf_dir):
    """First sentence of the next body text."""
    rows = items(spark, sf_dir).withColumnRenamed("text_level", "level")
    return structure.following_preview(rows).select("doc_id", "ord", "preview")


@FAMILY.add(f"WITH {_HEADS}, t AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS title FROM heads) SELECT doc_id, title, count(*) AS n, len(string_split(title, ' ')) <= 4 AS auto FROM t WHERE length(title) <= 60 GROUP BY doc_id, title HAVING count(*) >= 2")
def heading_duplicates(spark, sf_dir):
    """Titles that repeat in a document."""
    return structure.duplicate_titles(_heads(spark, sf_dir))


_NUMBERED = f"{ITEMS_SQL}, pg AS (SELECT DISTINCT doc_id, page_idx, CASE WHEN page_idx % 5 = 4 THEN NULL ELSE page_idx + 3 - (page_idx // 7) * 2 END AS number FROM items)"
_RUN = """seen AS (SELECT doc_id, page_idx, number - page_idx AS off, min(page_idx) OVER (PARTITION BY doc_id, number - page_idx) AS seen FROM pg WHERE number IS NOT NULL),
isl AS (SELECT *, page_idx - row_number() OVER (PARTITION BY doc_id, off ORDER BY page_idx) AS island FROM seen),
run AS (SELECT doc_id, off AS "offset", min(page_idx) AS start, max(page_idx) AS "end", count(*) AS n FROM isl GROUP BY doc_id, off, seen, island QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, seen, min(page_idx)) = 1)"""


def _numbered(spark, sf_dir):
    p = F.col("page_idx")
    number = F.when(p % 5 == 4, None).otherwise(p + 3 - F.floor(p / 7).cast("int") * 2)
    return items(spark, sf_dir).select("doc_id", "page_idx").distinct().withColumn("number", number)


@FAMILY.add(f'WITH {_NUMBERED}, {_RUN} SELECT doc_id, "offset"::BIGINT AS "offset", start::BIGINT AS start, "end"::BIGINT AS "end", n FROM run')
def page_runs(spark, sf_dir):
    """Longest run of pages with a constant offset to their numbers."""
    out = structure.page_run(_numbered(spark, sf_dir))
    return out.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("offset", "start", "end")), "n")


@FAMILY.add(f"""WITH {_NUMBERED}, {_RUN} SELECT doc_id, page_idx, CASE WHEN "offset" IS NULL THEN NULL WHEN page_idx + "offset" < 1 THEN 'cover' ELSE (page_idx + "offset")::VARCHAR END AS logical_page FROM pg LEFT JOIN (SELECT * FROM run WHERE n >= 2) r USING (doc_id)""")
def logical_pages(spark, sf_dir):
    """Logical page of every page."""
    return structure.logical_pages(_numbered(spark, sf_dir))


@FAMILY.add(
    f"""WITH {ITEMS_SQL}, hit AS (SELECT DISTINCT doc_id, page_idx FROM items WHERE page_idx > 0 AND page_idx < 20 AND length(text) % 3 > 0),
g AS (SELECT *, page_idx - row_number() OVER (PARTITION BY doc_id ORDER BY page_idx) AS island FROM hit) SELECT doc_id, page_idx FROM g QUALIFY island = min(island) OVER (PARTITION BY doc_id)"""
)
def toc_pages(spark, sf_dir):
    """First run of contents pages."""
    p = items(spark, sf_dir).groupBy("doc_id", "page_idx").agg((F.bool_or(F.length("text") % 3 > 0) & (F.col("page_idx") > 0)).alias("is_toc"))
    return structure.toc_pages(p)


@FAMILY.add(
    f"""WITH {ITEMS_SQL}, x AS (SELECT *, coalesce((page_idx <> lag(page_idx) OVER w)::INT, 0) AS ch FROM items WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
media AS (SELECT doc_id, ord AS media_ord, page_idx FROM items WHERE type = 'image'),
pairs AS (SELECT m.doc_id, m.media_ord, t.ord, CASE WHEN t.ord < m.media_ord THEN 'before' ELSE 'after' END AS side FROM media m JOIN items t ON t.doc_id = m.doc_id AND t.page_idx = m.page_idx AND t.type = 'text'
  WHERE NOT EXISTS (SELECT 1 FROM media o WHERE o.doc_id = m.doc_id AND o.media_ord <> m.media_ord AND o.media_ord BETWEEN least(t.ord, m.media_ord) AND greatest(t.ord, m.media_ord)))
SELECT doc_id, media_ord, ord, side, row_number() OVER (PARTITION BY doc_id, media_ord, side ORDER BY abs(ord - media_ord)) AS distance FROM pairs QUALIFY distance <= 3"""
)
def media_neighbours(spark, sf_dir):
    """Texts around each image, by the definition: same page, no other medium between."""
    return structure.media_neighbours(items(spark, sf_dir)).withColumn("distance", F.col("distance").cast("long"))


@FAMILY.add(
    f"""WITH {ITEMS_SQL}, span AS (SELECT doc_id, 2 AS s, 4 AS e FROM documents_ids), documents_ids AS (SELECT DISTINCT doc_id FROM items),
kept AS (SELECT doc_id, ord, type, text FROM items WHERE ord NOT BETWEEN 2 AND 4 UNION ALL SELECT doc_id, min(ord), 'toc', string_agg(text, chr(10) ORDER BY ord) FROM items WHERE ord BETWEEN 2 AND 4 GROUP BY doc_id)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS node_idx, type, text FROM kept"""
)
def toc_consolidation(spark, sf_dir):
    """Lines 2 to 4 of each document replaced by one contents item."""
    rows = items(spark, sf_dir)
    spans = rows.select("doc_id").distinct().select("doc_id", F.lit(2).alias("start"), F.lit(4).alias("end"))
    return structure.consolidate_toc(rows, spans).select("doc_id", F.col("node_idx").cast("long").alias("node_idx"), "type", "text")


@FAMILY.add(
    f"""WITH {_HEADS}, k AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS key FROM heads), target AS (SELECT doc_id, level, key, arg_max('s' || ord, ord) AS section_id FROM k GROUP BY ALL)
SELECT k.doc_id, k.ord, section_id FROM k LEFT JOIN target USING (doc_id, level, key)"""
)
def toc_sections(spark, sf_dir):
    """Entries matched to the last section of their level and title."""
    heads = _heads(spark, sf_dir)
    sections = heads.select("doc_id", "level", F.col("text").alias("title"), F.concat(F.lit("s"), "ord").alias("node_id"), "ord")
    entries = heads.select("doc_id", "ord", "level", F.col("text").alias("title"))
    return structure.toc_sections(entries, sections).select("doc_id", "ord", "section_id")


@FAMILY.add(
    f"""WITH {ITEMS_SQL}, b AS (SELECT doc_id, ord, page_idx, text, substr(text, 1, 20) AS prev FROM items)
SELECT doc_id, ord, CASE WHEN length(p) > 0 AND starts_with(text, p) AND length(text) > length(p) THEN trim(text[length(p) + 1:]) ELSE text END AS stripped FROM (SELECT doc_id, ord, text, lag(text) OVER (PARTITION BY doc_id, page_idx ORDER BY ord) AS p FROM items)"""
)
def caption_prefixes(spark, sf_dir):
    """Texts without the previous text where they repeat it."""
    return structure.strip_repeated_title(items(spark, sf_dir)).select("doc_id", "ord", "stripped")


_BOXES = "bx AS (SELECT p_partkey, {'x0': (p_partkey * 7) % 90, 'y0': (p_partkey * 13) % 95} AS a, (p_size % 40 + 1)::DOUBLE AS w, (p_partkey % 60 + 1)::DOUBLE AS h FROM part)"


@FAMILY.add(
    f"""WITH {_BOXES}, r AS (SELECT p_partkey, a.x0 AS x0, a.y0 AS y0, a.x0 + w AS x1, a.y0 + h AS y1 FROM bx)
SELECT p_partkey, round(greatest(0, least(x1, 60) - greatest(x0, 20)) / least(x1 - x0, 40), 6)::DOUBLE AS overlap,
       ((x1 - x0) * (y1 - y0) / 10000 < 0.005) OR ((x1 - x0) * (y1 - y0) / 10000 > 0.2 AND (x0 <= 2)::INT + (y0 <= 2)::INT + (x1 >= 98)::INT + (y1 >= 98)::INT >= 3) AS skip FROM r"""
)
def box_predicates(spark, sf_dir):
    """Overlap of boxes with a column, and boxes to skip."""
    from docloom.queries.base import table

    k = F.col("p_partkey")
    x0, y0 = (k * 7 % 90).cast("double"), (k * 13 % 95).cast("double")
    box = F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + F.col("p_size") % 40 + 1).alias("x1"), (y0 + k % 60 + 1).alias("y1"))
    rows = table(spark, sf_dir, "part").select("p_partkey", box.alias("b"))
    overlap = structure.overlap_1d(F.col("b.x0"), F.col("b.x1"), F.lit(20.0), F.lit(60.0))
    return rows.select("p_partkey", F.round(overlap, 6).alias("overlap"), structure.skip_media("b", F.lit(100.0), F.lit(100.0), most=0.2).alias("skip"))

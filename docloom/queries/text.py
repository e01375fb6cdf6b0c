"""Queries of the text functions over documents, pages and generated cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chunks
from docloom.queries.base import Family, sql_list, table

FAMILY = Family()

#: Lines of documents: what stands between line breaks, numbered from 0.
LINES_SQL = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents)"


def lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))


@FAMILY.add(
    r"""
SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9%.\-]+'))::BIGINT AS n_search, len(regexp_extract_all(lower(text), '[a-z0-9_\-]+'))::BIGINT AS n_build,
       len(regexp_extract_all(lower(text), '[a-z][a-z0-9_\-]+'))::BIGINT AS n_summary, len(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_\-\.%/]*'))::BIGINT AS n_cell,
       len(regexp_extract_all(lower(text), '[a-z0-9]+'))::BIGINT AS n_plain
FROM documents"""
)
def text_tokens(spark, sf_dir):
    """Tokens of each document by each of the token patterns."""
    n = lambda p: F.size(T.tokens(F.col("text"), p)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", n(T.SEARCH_TOKEN).alias("n_search"), n(T.BUILD_TOKEN).alias("n_build"), n(T.SUMMARY_TOKEN).alias("n_summary"), n(T.CELL_TOKEN).alias("n_cell"), n(T.PLAIN_TOKEN).alias("n_plain"))


_PAIRS = "[" + ", ".join(f"{{'a': '{a}', 'b': '{b}'}}" for a, b in T.UNITS.items()) + "]"


@FAMILY.add(
    rf"""
WITH cells AS (SELECT l_orderkey, l_linenumber, concat('Took ', l_quantity::BIGINT::VARCHAR, ' ms at ', (l_extendedprice::BIGINT % 97)::VARCHAR, '% in ', (1990 + l_partkey % 30)::VARCHAR, ' and 5 KHz; Table ', (l_suppkey % 7)::VARCHAR) AS c FROM lineitem)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
       array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(lower(c), '\d[\d\.,]*\s*(%|ms|s|kbps|mbps|gbps|bps|hz|khz|mhz|ghz|usd|€|\$|°c|℃)', 1), lambda x: list_filter({_PAIRS}, lambda p: p.a = x)[1].b), lambda y: y IS NOT NULL))), ',') AS units,
       array_to_string(regexp_extract_all(c, '\b(?:19|20)\d\d\b'), ',') AS years,
       'Table ' || regexp_extract(c, 'Table (\d+)', 1) AS label
FROM cells"""
)
def text_units_years_labels(spark, sf_dir):
    """Units, years and labels in sentences made from order lines."""
    cell = F.concat(F.lit("Took "), F.col("l_quantity").cast("long").cast("string"), F.lit(" ms at "), F.pmod(F.round("l_extendedprice").cast("long"), F.lit(97)).cast("string"), F.lit("% in "), (1990 + F.col("l_partkey") % 30).cast("string"), F.lit(" and 5 KHz; Table "), (F.col("l_suppkey") % 7).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), cell.alias("c"))
    return rows.select("l_orderkey", "l_linenumber", F.array_join(T.units_set(F.col("c")), ",").alias("units"), F.array_join(T.years(F.col("c")), ",").alias("years"), T.label(F.col("c"))["label"].alias("label"))


@FAMILY.add(
    rf"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9_\-]+')) AS t, generate_subscripts(regexp_extract_all(lower(text), '[a-z][a-z0-9_\-]+'), 1) AS i FROM documents),
counted AS (SELECT doc_id, t, count(*) AS n, min(i) AS i FROM words GROUP BY ALL),
usable AS (SELECT *, t IN ({sql_list(T.HINT_WORDS)}) AS listed FROM counted WHERE t IN ({sql_list(T.HINT_WORDS)}) OR (t NOT IN ({sql_list(T.STOPWORDS)}) AND length(t) >= 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY listed DESC, CASE WHEN listed THEN 0 ELSE -n END, i) AS r FROM usable)
SELECT doc_id, string_agg(t, ' ' ORDER BY r) AS hints FROM placed WHERE r <= 6 GROUP BY doc_id"""
)
def text_hints(spark, sf_dir):
    """Keywords of each whole document."""
    return T.text_hints(table(spark, sf_dir, "documents"), "text", key="doc_id").select("doc_id", F.array_join("hints", " ").alias("hints"))


@FAMILY.add(
    r"""
WITH parts AS (SELECT doc_id, trim(text) AS t, list_transform(regexp_split_to_array(regexp_replace(trim(text, ' '), '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))) AS p FROM documents),
kept AS (SELECT doc_id, CASE WHEN len(list_filter(p, lambda x: length(x) >= 20)) = 0 THEN [t] ELSE list_filter(p, lambda x: length(x) >= 20) END AS s FROM parts)
SELECT doc_id, len(s[:30])::BIGINT AS n_sentences, list_sum(list_transform(s[:30], lambda x: length(x)))::BIGINT AS n_chars FROM kept"""
)
def text_sentences(spark, sf_dir):
    """Number and length of the sentences of each document."""
    s = T.sentences(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", s.alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_chars"))


@FAMILY.add(
    rf"""
WITH {LINES_SQL}
SELECT doc_id, ord, trim(line) <> '' AND (len(regexp_split_to_array(trim(line), '\s+')) <= 1
         OR (len(regexp_split_to_array(trim(line), '\s+')) <= 5 AND NOT regexp_matches(trim(line), '[.!?;:。！？；：]$'))
         OR (length(regexp_replace(trim(line), '[^A-Za-z]', '', 'g')) > 0 AND length(regexp_replace(trim(line), '[^A-Z]', '', 'g')) >= 0.7 * length(regexp_replace(trim(line), '[^A-Za-z]', '', 'g')))
         OR regexp_matches(trim(line), '^(\d+(\.\d+)*|[IVXLCM]+\.?|[A-Z]\.)\s+')) AS heading
FROM lines"""
)
def text_heading_lines(spark, sf_dir):
    """Which lines of documents read like headings."""
    return lines(spark, sf_dir).select("doc_id", F.col("ord").cast("long").alias("ord"), T.is_heading_text(F.col("line")).alias("heading"))


@FAMILY.add(
    r"""
SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text,
       len(regexp_extract_all(html, '<li>'))::BIGINT AS n_items FROM pages"""
)
def text_strip_tags(spark, sf_dir):
    """Text of web pages without tags."""
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"), F.regexp_count("html", F.lit("<li>")).cast("long").alias("n_items"))


@FAMILY.add(
    r"""
WITH cells AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN printf('%,d', (p_retailprice * 100)::BIGINT) WHEN 1 THEN printf('%.2f%%', p_retailprice) WHEN 2 THEN 'n/a' ELSE p_size::VARCHAR END AS c FROM part)
SELECT p_partkey, try_cast(regexp_replace(replace(c, ',', ''), '%$', '') AS DOUBLE) AS value FROM cells"""
)
def text_to_number(spark, sf_dir):
    """Numbers read from cells with thousands, percents and blanks."""
    k, price = F.col("p_partkey") % 4, F.col("p_retailprice")
    cell = F.when(k == 0, F.format_number((price * 100).cast("decimal(20,0)"), 0)).when(k == 1, F.concat(F.format_string("%.2f", price), F.lit("%"))).when(k == 2, "n/a").otherwise(F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", T.to_number(cell).alias("value"))


@FAMILY.add(
    r"""
WITH a AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents)
SELECT x.doc_id, round(CASE WHEN len(list_distinct(list_concat(x.w, y.w))) = 0 THEN 0.0 ELSE len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) END, 6) AS similarity
FROM a x JOIN a y ON y.doc_id = x.doc_id + 1"""
)
def text_neighbour_jaccard(spark, sf_dir):
    """Token-set Jaccard of each document and the one with the next id."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(T.tokens(F.col("text"), T.PLAIN_TOKEN)).alias("w"))
    after = words.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("w2"))
    return words.join(after, "doc_id").select("doc_id", F.round(T.jaccard(F.col("w"), F.col("w2")), 6).alias("similarity"))


@FAMILY.add(
    r"""
WITH h AS (SELECT s_suppkey, concat('<table><thead><tr><th>Name</th><th> Latency (ms) </th><th></th><th>Year<br>', (s_suppkey % 30 + 1990)::VARCHAR, '</th></tr></thead><tr><td>', s_name, '</td></tr></table>') AS html FROM supplier)
SELECT s_suppkey, array_to_string(list_filter(list_transform(regexp_extract_all(regexp_extract(html, '(?is)(<tr.*?</tr>)', 1), '(?is)<t[hd][^>]*>(.*?)</t[hd]>', 1), lambda c: trim(regexp_replace(regexp_replace(c, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))), lambda c: c <> ''), '|') AS headers FROM h"""
)
def text_table_headers(spark, sf_dir):
    """Headers of HTML tables made from suppliers."""
    html = F.concat(F.lit("<table><thead><tr><th>Name</th><th> Latency (ms) </th><th></th><th>Year<br>"), (F.col("s_suppkey") % 30 + 1990).cast("string"), F.lit("</th></tr></thead><tr><td>"), "s_name", F.lit("</td></tr></table>"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(T.table_headers(html), "|").alias("headers"))


@FAMILY.add(
    r"""
SELECT doc_id, array_to_string(list_distinct_in_order, '|') AS entities FROM (
  SELECT doc_id, list_filter(m, lambda x, i: list_position(m, x) = i) AS list_distinct_in_order FROM (
    SELECT doc_id, regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '\b([A-Z][A-Za-z0-9]+(?:\s+[A-Z][A-Za-z0-9]+)*)\b', 1) AS m FROM documents))"""
)
def text_entities(spark, sf_dir):
    """Capitalised word runs of documents (other letters as ``_``: engines differ on word edges there)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.entities(F.regexp_replace("text", r"[^\x00-\x7F]", "_")), "|").alias("entities"))


@FAMILY.add(
    r"""
SELECT doc_id, CASE WHEN length(t) <= 768 THEN t ELSE rtrim(t[:CASE WHEN strpos(reverse(t[729:768]), ' ') > 0 THEN 768 - strpos(reverse(t[729:768]), ' ') ELSE 768 END]) END AS clipped
FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)"""
)
def text_clip(spark, sf_dir):
    """Texts collapsed and cut near a space."""
    return table(spark, sf_dir, "documents").select("doc_id", T.clip(T.collapse(F.col("text"))).alias("clipped"))


@FAMILY.add(
    r"""
WITH r AS (SELECT o_orderkey, o_orderkey % 400 AS n FROM orders),
d AS (SELECT o_orderkey, n, repeat('c', (n // 100)::INT) || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][((n // 10) % 10 + 1)::INT] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][(n % 10 + 1)::INT] AS roman FROM r)
SELECT o_orderkey, roman, CASE WHEN roman = '' THEN NULL ELSE n::BIGINT END AS value FROM d"""
)
def text_roman(spark, sf_dir):
    """Values of Roman numerals made from order keys."""
    n = F.col("o_orderkey") % 400
    tens, ones = T.strings(["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"]), T.strings(["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"])
    roman = F.concat(F.expr("repeat('c', cast((o_orderkey % 400) div 100 as int))"), F.get(tens, ((n / 10).cast("int") % 10)), F.get(ones, (n % 10).cast("int")))
    return table(spark, sf_dir, "orders").select("o_orderkey", roman.alias("roman"), T.roman_to_int(roman).cast("long").alias("value"))


@FAMILY.add(
    rf"""
WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\n]+[.!?]')) AS s FROM documents),
w AS (SELECT doc_id, s, list_distinct(regexp_extract_all(lower(s), '[a-z][a-z0-9_\-]+')) AS w FROM s),
n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
df AS (SELECT doc_id, t, count(*) AS df FROM (SELECT doc_id, unnest(w) AS t FROM w) WHERE t NOT IN ({sql_list(T.STOPWORDS)}) GROUP BY doc_id, t)
SELECT doc_id, count(*) AS n_words, round(sum(1 + greatest(0, ln((1 + n) / (1 + df)))), 6) AS idf_sum FROM df JOIN n USING (doc_id) GROUP BY doc_id"""
)
def text_sentence_idf(spark, sf_dir):
    """Sum of the sentence IDF of each document's words, stop words left out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.regexp_extract_all("text", F.lit(r"([^.!?\n]+[.!?]?)"), F.lit(1)), lambda x: F.substring(x, -1, 1).isin(".", "!", "?")).alias("s"))  # a run without an end is passed over at once
    return chunks.sentence_idfs(docs, "s", "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_words"), F.round(F.sum("idf"), 6).alias("idf_sum"))

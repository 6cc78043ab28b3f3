"""HTML tables as rows: a table function for lateral joins that gives the cells of every table of a page."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

# The table function goes to the workers by value, so that they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The widest and the tallest span that HTML allows.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534
CELLS = "tbl int, row int, col int, header string, cell string"


class _Tables(HTMLParser):
    """The tables of a page in the order in which they begin, each a list of (kind, cells); kind is head, foot or body, a
    cell (text, is header, columns, rows). End tags may be missing; a table within a cell is a table of its own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list] = []
        self.open: list[dict] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "template"):
            self.hidden += 1
        elif tag == "table":
            self.tables.append([])
            self.open.append({"rows": self.tables[-1], "kind": "body", "row": None, "cell": None})
        elif self.open:
            top = self.open[-1]
            if tag in ("thead", "tbody", "tfoot"):
                self._end_row(top)
                top["kind"] = {"thead": "head", "tfoot": "foot"}.get(tag, "body")
            elif tag == "tr":
                self._end_row(top)
                top["row"] = []
            elif tag in ("td", "th"):
                self._end_cell(top)
                if top["row"] is None:
                    top["row"] = []
                named = dict(attrs)
                top["cell"] = [[], tag == "th", self._span(named.get("colspan"), MAX_COLSPAN) or 1, self._span(named.get("rowspan"), MAX_ROWSPAN)]
            elif tag in ("br", "p", "div", "li") and top["cell"]:
                top["cell"][0].append(" ")

    @staticmethod
    def _span(value: str | None, most: int) -> int:
        digits = (value or "1").strip()
        return min(int(digits), most) if digits.isascii() and digits.isdigit() else 1

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "template"):
            self.hidden = max(0, self.hidden - 1)
        elif self.open:
            top = self.open[-1]
            if tag == "table":
                self._end_row(top)
                self.open.pop()
            elif tag in ("tr", "thead", "tbody", "tfoot"):
                self._end_row(top)
                top["kind"] = top["kind"] if tag == "tr" else "body"
            elif tag in ("td", "th"):
                self._end_cell(top)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["cell"] and not self.hidden:
            self.open[-1]["cell"][0].append(data)

    @staticmethod
    def _end_cell(top: dict) -> None:
        if top["cell"]:
            words, head, wide, tall = top["cell"]
            top["row"].append((" ".join("".join(words).split()), head, wide, tall))
            top["cell"] = None

    def _end_row(self, top: dict) -> None:
        self._end_cell(top)
        if top["row"] is not None:  # without cells of its own it may still be under a span
            top["rows"].append((top["kind"], top["row"]))
        top["row"] = None

    def finished(self) -> list[list]:
        self.close()
        while self.open:
            self._end_row(self.open.pop())
        return self.tables


def _grid(rows: list) -> Iterator[tuple[str, dict[int, tuple[str, bool]]]]:
    """(kind, column -> (text, is header)) of each row: a cell is in every row and column that it spans. One that spans no
    rows by its number goes on to the end."""
    hanging: dict[int, list] = {}
    for kind, cells in rows:
        line = {c: (text, head) for c, (text, head, _) in hanging.items()}
        hanging = {c: [text, head, left - 1] for c, (text, head, left) in hanging.items() if left != 1}
        at = 0
        for text, head, wide, tall in cells:
            while at in line:
                at += 1
            for c in range(at, at + wide):
                if c in line:  # what hangs down from above was there first
                    continue
                line[c] = (text, head)
                if tall != 1:
                    hanging[c] = [text, head, tall - 1 if tall else 0]
            at += wide
        yield kind, line


class _Cells:
    def eval(self, html: str) -> Iterator[tuple]:
        parser = _Tables()
        parser.feed(html or "")
        for number, rows in enumerate(parser.finished()):
            lines = [x for x in _grid(rows) if x[1]]
            if not any(kind == "head" for kind, _ in lines):
                lead = next((i for i, (_, line) in enumerate(lines) if not all(head for _, head in line.values())), len(lines))
                lines = [("head", line) for _, line in lines[:lead]] + lines[lead:]
            titles: dict[int, list[str]] = {}
            for _, line in (x for x in lines if x[0] == "head"):
                for c, (text, _) in line.items():
                    if text and text not in titles.setdefault(c, []):
                        titles[c].append(text)
            body = [line for kind, line in lines if kind != "head"]
            for r, line in enumerate(body):
                for c in sorted(line):
                    yield number, r, c, " ".join(titles.get(c, [])) or None, line[c][0]


def cells(pages: DataFrame, html: str = "html") -> DataFrame:
    """The rows of ``pages`` (without ``html``) for each cell of their tables: (tbl, row, col, header, cell).

    Tables count from 0 in the order in which they begin, nested ones too, whose text is not the outer cell's. Header rows
    are those of thead, else the leading rows of th only; a column's header are their different texts. A cell that spans
    rows or columns is given in each. Null and broken pages give the cells that there are.
    """
    spark = pages.sparkSession
    spark.udtf.register("tidemark_html_cells", udtf(_Cells, returnType=CELLS))
    rest = ", ".join(f"p.`{c}`" for c in pages.columns if c != html)
    return spark.sql(f"SELECT {rest}, t.* FROM {{pages}} p, LATERAL tidemark_html_cells(p.`{html}`) t", pages=pages)


def constituents(found: DataFrame, keys: list[str], hints: tuple[str, ...], normal: Column, least: int = 10) -> DataFrame:
    """(keys, ord, symbol): the symbols of the first column, by table and place, whose header has one of the hints and at
    least ``least`` cells that ``normal`` (null for what is no symbol) takes."""
    named = F.lit(False)
    for hint in hints:
        named = named | F.contains(F.lower("header"), F.lit(hint.lower()))
    taken = found.where(named).withColumn("symbol", normal).where("symbol IS NOT NULL")
    first = taken.groupBy(*keys, "tbl", "col").agg(F.count("*").alias("n")).where(F.col("n") >= least).groupBy(*keys).agg(F.min(F.struct("tbl", "col")).alias("first"))
    rows = taken.join(first, keys).where((F.col("tbl") == F.col("first.tbl")) & (F.col("col") == F.col("first.col")))
    return rows.select(*keys, F.col("row").alias("ord"), "symbol")

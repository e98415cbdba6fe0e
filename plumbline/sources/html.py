"""Pages as a table of tokens: titles, headings, text runs, links and table cells in page order.

The parser below only turns markup into rows; sections, links, grids and record rows are Spark
expressions over those rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: where the content of a page is looked for, and what is never content
ROOT_TAGS = ("main", "article", "body")
DROP_TAGS = ("script", "style", "noscript", "iframe", "header", "footer", "nav", "aside", "form")
MAX_ROWSPAN, MAX_COLSPAN = 65534, 1000
#: Tokens a task hands on at once (those of a longer page together).
FRAME_ROWS = 10_000

TOKEN_SCHEMA = (
    "page_id long, pos int, inside boolean, kind string, text string, href string, tbl int, r int, c int, rs int, cs int"
)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Tokens(HTMLParser):
    """Collects tokens with the best content element each one lies in (-1 when none)."""

    def __init__(self, base: str, headings: tuple[str, ...], drop: tuple[str, ...]) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.headings, self.drop = base, headings, drop
        self.rows: list[list] = []
        self.stack: list[str] = []
        self.roots: dict[str, int] = {}
        self.tables = 0
        self.open: list[tuple[str, list]] = []
        self.cell: list | None = None
        self.table: dict | None = None

    def _root(self) -> int:
        inside = [ROOT_TAGS.index(t) for t in self.stack if t in ROOT_TAGS]
        return min(inside) if inside else -1

    def _add(self, kind: str, text: str = "", href: str = "") -> list:
        row = [len(self.rows), self._root(), kind, text, href, -1, -1, -1, 1, 1]
        self.rows.append(row)
        return row

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            return
        self.stack.append(tag)
        if any(t in self.drop for t in self.stack):
            return
        values = dict(attrs)
        if tag == "title" or tag in self.headings:
            self.open.append((tag, self._add("title" if tag == "title" else "heading")))
        elif tag == "a" and values.get("href"):
            href = urljoin(self.base, values["href"].strip())
            self.open.append((tag, self._add("link", "", href)))
            if self.cell is not None and not self.cell[4]:
                self.cell[4] = href
        elif tag == "table" and self.table is None:
            self.table = {"r": -1, "taken": {}, "no": self.tables, "depth": self.stack.count("table")}
            self.tables += 1
        elif tag == "tr" and self._outer():
            self.table["r"] += 1
            self.table["c"] = 0
        elif tag in ("td", "th") and self._outer() and self.table["r"] >= 0:
            self._open_cell(values)

    def _outer(self) -> bool:
        return self.table is not None and self.stack.count("table") == self.table["depth"]

    def _open_cell(self, values: dict) -> None:
        table = self.table
        size = lambda key, top: min(max(int(values[key]), 1), top) if str(values.get(key, "")).isdigit() else 1
        rs, cs = size("rowspan", MAX_ROWSPAN), size("colspan", MAX_COLSPAN)
        # A slot is taken while an earlier cell of the column still spans this row.
        while table["taken"].get(table["c"], 0) > table["r"]:
            table["c"] += 1
        self.cell = self._add("cell")
        self.cell[5:] = [table["no"], table["r"], table["c"], rs, cs]
        for c in range(table["c"], table["c"] + cs):
            table["taken"][c] = max(table["taken"].get(c, 0), table["r"] + rs)
        table["c"] += cs

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.stack:
            return
        while self.stack and self.stack.pop() != tag:
            pass
        if tag in ("td", "th") and self._outer():
            self.cell = None
        if tag == "table" and self.table is not None and self.stack.count("table") < self.table["depth"]:
            self.table = self.cell = None
        self.open = [(t, row) for t, row in self.open if t in self.stack]

    def handle_data(self, data: str) -> None:
        text = " ".join(data.split())
        if not text or any(t in self.drop for t in self.stack):
            return
        for _, row in self.open:
            row[3] = f"{row[3]} {text}".strip()
        if self.cell is not None:
            self.cell[3] = f"{self.cell[3]} {text}".strip()
        elif not any(t == "title" or t in self.headings for t, _ in self.open):
            self._add("text", text)


_NAMES = ("pos", "inside", "kind", "text", "href", "tbl", "r", "c", "rs", "cs")
HEADINGS = ("h1", "h2", "h3")


def _page_rows(url: str | None, html: str | None, headings: tuple[str, ...], drop: tuple[str, ...]) -> list[list]:
    """Token rows of one page, `inside` told by its best content element."""
    parser = _Tokens(url or "", headings, drop)
    parser.feed(html or "")
    parser.close()
    at = _NAMES.index("inside")
    best = min((row[at] for row in parser.rows if row[at] >= 0), default=None)
    return [[*row[:at], row[at] == best, *row[at + 1 :]] for row in parser.rows]


def html_tokens(
    pages: DataFrame, headings: tuple[str, ...] = HEADINGS, drop: tuple[str, ...] = DROP_TAGS
) -> DataFrame:
    """Tokens of every page of (page_id, url, html); nothing inside the `drop` elements.

    `inside` marks the tokens of the page's best content element.
    """

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # a batch may hold ten thousand pages: their tokens leave in small frames
            rows: list[list] = []
            for page_id, url, html in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                rows += ([page_id, *row] for row in _page_rows(url, html, headings, drop))
                if len(rows) >= FRAME_ROWS:
                    yield pd.DataFrame(rows, columns=["page_id", *_NAMES])
                    rows = []
            yield pd.DataFrame(rows, columns=["page_id", *_NAMES])

    return pages.select("page_id", "url", "html").mapInPandas(tokens, TOKEN_SCHEMA)


class _PageTokens:
    """Body of the table function `page_tokens(url, html)`."""

    def eval(self, url: str, html: str) -> Iterator[tuple]:
        for row in _page_rows(url, html, HEADINGS, DROP_TAGS):
            yield tuple(row)


def register_page_tokens(spark: SparkSession, name: str = "page_tokens") -> None:
    """Make the tokens of a page a table function of SQL: `FROM pages, LATERAL page_tokens(url, html)`."""
    spark.udtf.register(name, F.udtf(_PageTokens, returnType=TOKEN_SCHEMA.removeprefix("page_id long, ")))

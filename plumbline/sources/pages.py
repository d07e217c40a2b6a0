"""Tables in web pages: the first table; else delimited text; else list items of two parts or more.

A page that can't be read as a table is tried as text, then as a list; what still goes wrong with it becomes the reason of a
row of its own and never another page's trouble.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.shipping import ship_package
from plumbline.functions.values import col
from plumbline.sources.delimited import find_separator, records

Cell = tuple[str, int, str | None, str | None]  # method, row, field, value

#: Pages of more bytes than this are dealt to tasks of about LARGE_TASK bytes; the others are read where they lie.
LARGE_PAGE, LARGE_TASK = 1 << 20, 16 << 20
#: Cells that a worker holds before it passes them on.
MOST_CELLS = 100_000


class _Page(HTMLParser):
    """Cells of the first table, text nodes, and where each list item's text nodes begin and end."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables, self.depth = 0, 0
        self.rows: list[list[tuple[bool, list[str]]]] = []
        self.cell: list[str] | None = None
        self.text: list[str] = []
        self.nodes: list[str] = []
        self.items: list[list[int]] = []
        self.open_items: list[list[int]] = []
        self.hidden = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Marked sections of any kind are passed over like comments."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        if tag == "table":
            self.tables += 1
            self.depth += 1
        elif self.tables == 1 and self.depth == 1 and tag == "tr":
            self.rows.append([])
            self.cell = None
        elif self.tables == 1 and self.depth == 1 and tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            self.cell = []
            self.rows[-1].append((tag == "th", self.cell))
        if tag == "li":
            self.items.append([len(self.nodes), -1])
            self.open_items.append(self.items[-1])

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if tag == "table":
            self.depth = max(0, self.depth - 1)
            self.cell = None
        elif tag in ("td", "th") and self.depth == 1:
            self.cell = None
        elif tag == "li" and self.open_items:
            self.open_items.pop()[1] = len(self.nodes)

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        self.text.append(data)
        if self.cell is not None:
            self.cell.append(data)
        if data.strip():
            self.nodes.append(data.strip())


def _from_table(page: _Page) -> list[Cell]:
    rows = [[(head, " ".join("".join(parts).split())) for head, parts in row] for row in page.rows if row]
    if not rows:
        return []
    named = all(head for head, _ in rows[0])
    names = [text for _, text in rows[0]] if named else [str(i) for i in range(max(map(len, rows)))]
    body = rows[1:] if named else rows
    return [("table", i, names[j], row[j][1] if j < len(row) and row[j][1] else None) for i, row in enumerate(body) for j in range(len(names))]


def _from_text(text: str) -> list[Cell]:
    text = text.strip()
    if "\n" not in text or not ("," in text or "\t" in text):
        return []
    names, *rows = records(text, find_separator(text))
    if any(len(row) > len(names) for row in rows):
        return []
    return [("text", i, names[j], (row[j] or None) if j < len(row) else None) for i, row in enumerate(rows) for j in range(len(names))]


def _two_parts(nodes: list[str], first: int, last: int) -> list[str]:
    """The first two of an item's parts; its texts are parts, and bars in them part them too."""
    parts: list[str] = []
    for i in range(first, last):
        parts += nodes[i].split("|", 2)
        if len(parts) >= 2:
            break
    return parts


def _from_items(page: _Page) -> list[Cell]:
    found = (_two_parts(page.nodes, a, b if b >= 0 else len(page.nodes)) for a, b in page.items)
    return [("list", i, p[0], p[1]) for i, p in enumerate(p for p in found if len(p) >= 2)]


def extract(html: str | None) -> tuple[list[Cell], str | None]:
    """(cells, reason): why there are none, if there are none."""
    page, trouble = _Page(), []
    try:
        page.feed(html or "")
        page.close()
    except Exception as e:  # what was read up to there still counts
        trouble.append(f"not read to its end: {type(e).__name__}")
    for way in (lambda: _from_table(page), lambda: _from_text("".join(page.text)), lambda: _from_items(page)):
        try:
            if cells := way():
                return cells, None
        except Exception as e:
            trouble.append(f"{type(e).__name__}: {e}"[:200])
    return [], "; ".join(trouble) or "no table, delimited text or list"


def _dealt(rows: DataFrame) -> DataFrame:
    """The pages (page_id, html), the large ones dealt to tasks by their bytes."""
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    large = rows.where(size > LARGE_PAGE)
    total = large.agg(F.sum(size.cast("long")).alias("bytes")).first()["bytes"]
    if not total:
        return rows
    return rows.where(size <= LARGE_PAGE).unionByName(large.repartition(max(1, -(-total // LARGE_TASK))))


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["page_id", "method", "row", "field", "value", "reason"]
    held: list[tuple] = []
    for batch in batches:
        for i, body in zip(batch["page_id"], batch["html"], strict=True):
            cells, reason = extract(body)
            held += [(i, *cell, None) for cell in cells] if cells else [(i, None, None, None, None, reason)]
            if len(held) >= MOST_CELLS:
                for at in range(0, len(held), MOST_CELLS):
                    yield pd.DataFrame(held[at : at + MOST_CELLS], columns=names).astype({"row": "Int32"})
                held = []
    yield pd.DataFrame(held, columns=names).astype({"row": "Int32"})


def read_pages(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, method, row, field, value, reason): the cells of each page; of a page without any, one row whose reason says
    why.  A null page is an empty one."""
    ship_package(pages.sparkSession)
    rows = pages.select(col(page_id).alias("page_id"), col(html).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return _dealt(rows).mapInPandas(_run, f"page_id {kind}, method string, row int, field string, value string, reason string")


def extract_pages(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, method, row, field, value) of each page; a page that holds nothing of the kind gives no row."""
    return read_pages(pages, page_id, html).where("method is not null").drop("reason")


def page_reports(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, method, rows, fields, reason): one row a page_id: how it was read, or why it wasn't."""
    rows = read_pages(pages, page_id, html)
    n = F.coalesce(F.max("row") + 1, F.lit(0)).cast("long").alias("rows")
    return rows.groupBy("page_id").agg(F.max("method").alias("method"), n, F.count_if(F.col("row") == 0).alias("fields"), F.min("reason").alias("reason"))


def html_tables(pages: DataFrame) -> DataFrame:
    return extract_pages(pages).where("method = 'table'")


def html_text_csv(pages: DataFrame) -> DataFrame:
    return extract_pages(pages).where("method = 'text'")


def html_list_pairs(pages: DataFrame) -> DataFrame:
    return extract_pages(pages).where(F.col("method") == "list")

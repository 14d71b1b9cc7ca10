"""HTML tables as rows (X-15, X-32)."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql.functions import udtf


class _Grid(HTMLParser):
    """Cells of the first level of tables, spans laid out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cells: list[tuple[int, int, int, int, bool, str]] = []
        self.row, self.taken, self.open = -1, set(), None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self._close()
            self.row += 1
        elif tag in ("td", "th"):
            self._close()
            a = dict(attrs)
            self.row = max(self.row, 0)
            spans = [min(int(a[k]), 1000) if (a.get(k) or "").isdigit() and int(a[k]) > 0 else 1 for k in ("rowspan", "colspan")]
            col = 0
            while (self.row, col) in self.taken:
                col += 1
            self.taken.update((self.row + i, col + j) for i in range(spans[0]) for j in range(spans[1]))
            self.open = [self.row, col, *spans, tag == "th", ""]
        elif tag == "br" and self.open:
            self.open[5] += "\n"

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._close()

    def handle_data(self, data):
        if self.open:
            self.open[5] += data

    def _close(self):
        if self.open:
            self.cells.append((*self.open[:5], self.open[5].strip()))
            self.open = None


def cells_of(html: str | None) -> list[tuple[int, int, int, int, bool, str]]:
    """(row, col, row_span, col_span, is_header, text) of an HTML table; [] for null, empty or other texts."""
    grid = _Grid()
    grid.feed(html or "")
    grid.close()
    grid._close()
    return grid.cells


def table_cells_udtf():
    """A table function (html) -> row, col, row_span, col_span, is_header, text."""

    @udtf(returnType="row int, col int, row_span int, col_span int, is_header boolean, text string")
    class TableCells:
        def eval(self, html: str) -> Iterator[tuple]:
            yield from cells_of(html)

    return TableCells

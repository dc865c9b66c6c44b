"""Text of HTML pages, a line for each block."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groupforge.plans.storage import ship

BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
HIDDEN = frozenset(("script", "style", "noscript", "template"))


class _Blocks(HTMLParser):
    """One line for each block; cells of a table row are joined by ` | `, and breaks inside a cell become spaces."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.text: list[str] = []
        self.cells: list[str] | None = None
        self.hidden = 0

    def _take(self) -> str:
        text, self.text = " ".join("".join(self.text).split()), []
        return text

    def flush(self) -> None:
        if self.cells is None and (line := self._take()):
            self.lines.append(line)

    def handle_starttag(self, tag, attrs) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "tr":
            self.flush()
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.text = []
        elif tag in BLOCKS:
            if self.cells is None:
                self.flush()
            else:
                self.text.append(" ")

    def handle_endtag(self, tag) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append(self._take())
        elif tag == "tr" and self.cells is not None:
            line, self.cells = " | ".join(self.cells).strip(), None
            if line.strip("| "):
                self.lines.append(line)
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data) -> None:
        if not self.hidden:
            self.text.append(data)


def page_lines(html: str | None) -> list[str]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.cells = None
    parser.flush()
    return parser.lines


def html_lines(html: Column) -> Column:
    return F.pandas_udf(lambda pages: pages.map(page_lines), "array<string>")(html)


def text_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, line, text: the lines of each page."""
    ship(pages.sparkSession)
    return pages.select(id_col, F.posexplode(html_lines(F.col(html_col))).alias("line", "text"))

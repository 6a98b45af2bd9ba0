"""HTML pages as a table of nodes, one row an element.

Spark has no lenient HTML parser, so this one step runs in Python, per page and in Arrow batches;
everything after it is joins, windows and aggregates over the node table.  Only the columns that a query
reads are made.  Pages of plain tags, attributes and text are cut by one pattern; all others go through `HTMLParser`.
"""

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: elements without content, and which open elements a start tag closes
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "option": {"select"}}
CLOSE_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SILENT = {"script", "style", "noscript", "template"}
#: `above` is the parent's tag, `within` that of the nearest table or cell around a node, `table` the nearest table of a row, cell or caption, `gap` the white space before a node, `raw` a text as written.
SCHEMA = (
    "pre int, post int, parent int, depth int, tag string, above string, within string, id string, class string, role string, level string, aria string, href string, start string, "
    "table int, row int, col int, rows int, cols int, gap string, text string, raw string"
)
# fixed values: how many columns and rows a cell spans at most by the HTML standard
MOST = {"colspan": 1_000, "rowspan": 65_534}
LARGEST = (1 << 31) - 1


def _span(a: dict, name: str) -> int:
    """Rows or columns that a cell spans; those beyond its table have no effect (see `render`)."""
    value = a.get(name) or ""
    return min(max(1, int(value)), MOST[name]) if value.isdigit() and value.isascii() and len(value) < 20 else 1


#: What every node has, besides its number and its end.
ROW = ["parent", "depth", "tag", "above", "within", "gap", "raw"]
WITHIN = ROW.index("within")
#: What a column holds for nodes that have no such thing.
EMPTY = {"id": "", "class": "", "role": "", "level": "", "aria": "", "href": "", "start": "", "table": -1, "row": -1, "col": -1, "rows": 1, "cols": 1}
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
CELLS = {"table", "td", "th"}
GRID = {"table", "row", "col", "rows", "cols"}
# what needs no parser: text and tags without references, comments, declarations or elements of raw text
_NAME, _ATTRIBUTES = r"[a-zA-Z][a-zA-Z0-9]*+", r"""(?:[ \t\r\n\f]++[a-zA-Z][a-zA-Z0-9_-]*+=(?:"[^"<>&]*+"|[a-zA-Z0-9_-]++))*+"""
_RAW = r"(?!(?i:script|style|textarea|title|iframe|noembed|noframes|noscript|xmp|plaintext)\b)"
TOKEN = re.compile(rf"([^<&]++)|</({_NAME})>|<({_RAW}{_NAME})({_ATTRIBUTES})>")
PLAIN = re.compile(rf"(?:[^<&]++|</{_NAME}>|<{_RAW}{_NAME}{_ATTRIBUTES}>)*+")
ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z0-9_-]*)=(?:"([^"]*)"|([a-zA-Z0-9_-]+))""")


class _Tree(HTMLParser):
    """The nodes of some pages by column; numbers are within a page, `post` is the last `pre` below an element."""

    def __init__(self, columns: list[str] = COLUMNS) -> None:
        super().__init__(convert_charrefs=True)
        self.columns = columns
        self.sizes: list[int] = []
        self.rows: list[tuple] = []
        self.post: list[int] = []
        #: what few nodes have, by the place of the node
        self.some: dict[str, dict[int, str | int]] = {name: {} for name in EMPTY if name in columns}
        self.gridded = not GRID.isdisjoint(columns)
        self._begin()

    def _begin(self) -> None:
        self.first, self.space = len(self.rows), ""
        self.open: list[int] = []
        self.names: list[str] = []
        self.grids: dict[int, dict] = {}

    def page(self, html: str) -> None:
        """Adds a page."""
        self._begin()
        if PLAIN.fullmatch(html):
            for text, end, start, attrs in TOKEN.findall(html):
                if text:
                    self.handle_data(text)
                elif end:
                    self.handle_endtag(end.lower())
                else:
                    self.handle_starttag(start.lower(), [(name.lower(), quoted or bare) for name, quoted, bare in ATTRIBUTE.findall(attrs)] if attrs else [])
        else:
            self.reset()
            self.feed(html)
            self.close()
        self._close(0)
        self.sizes.append(len(self.rows) - self.first)

    def values(self, name: str) -> list:
        """A column of all nodes."""
        if name == "pre":
            return [pre for size in self.sizes for pre in range(size)]
        if name == "post":
            return self.post
        if name == "text":
            return [" ".join(raw.split()) if raw else "" for raw in self.values("raw")]
        if name in ROW:
            k = ROW.index(name)
            return [row[k] for row in self.rows]
        out = [EMPTY[name]] * len(self.rows)
        for k, value in self.some[name].items():
            out[k] = value
        return out

    def _close(self, n: int) -> None:
        last = len(self.rows) - 1 - self.first
        for i in self.open[n:]:
            self.post[i] = last
        del self.open[n:], self.names[n:]

    def _close_tags(self, tags: set[str], scope: set[str]) -> None:
        for n in range(len(self.names) - 1, -1, -1):
            tag = self.names[n]
            if tag in scope:
                return
            if tag in tags:
                self._close(n)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSE_P and "p" in self.names:
            self._close_tags({"p"}, {"td", "th", "div", "section", "article", "blockquote", "li"})
        if tag in CLOSES:
            self._close_tags(CLOSES[tag], SCOPES[tag])
        a, n = dict(attrs) if attrs else {}, len(self.rows)
        if self.gridded and tag in ("tr", "td", "th", "caption"):
            table = next((self.open[i] - self.first for i in range(len(self.open) - 1, -1, -1) if self.names[i] == "table"), -1)
            row, col = self._cell(table, tag, a) if tag != "caption" else (-1, -1)
            self._set(n, {"table": table, "row": row, "col": col})
        self._add(tag)
        if a:  # most elements have none
            self._set(n, {"id": a.get("id") or "", "class": a.get("class") or "", "role": a.get("role") or "", "level": a.get("aria-level") or "", "aria": a.get("aria-label") or "", "href": a.get("href") or ""})
            self._set(n, {"start": a.get("start") or a.get("value") or "", "rows": _span(a, "rowspan"), "cols": _span(a, "colspan")})
        if tag not in VOID:
            self.open.append(n)
            self.names.append(tag)

    def _set(self, n: int, values: dict[str, str | int]) -> None:
        for name, value in values.items():
            if name in self.some:
                self.some[name][n] = value

    def _add(self, tag: str, raw: str = "") -> None:
        """A new node below the innermost open element, whose tag is `above`."""
        n = len(self.rows)
        if self.open:
            up, above = self.open[-1], self.names[-1]
            self.rows.append((up - self.first, len(self.open), tag, above, above if above in CELLS else self.rows[up][WITHIN], self.space, raw))
        else:
            self.rows.append((-1, 0, tag, "", "", self.space, raw))
        self.post.append(n - self.first)
        self.space = ""

    def updatepos(self, i: int, j: int) -> int:
        """Lines and columns of the source are of no use here."""
        return j

    def _cell(self, table: int, tag: str, a: dict) -> tuple[int, int]:
        """The grid place of a row or cell in its table; cells step over those that reach down from above."""
        grid = self.grids.setdefault(table, {"row": -1, "col": 0, "down": []})
        if tag == "tr":
            grid["row"], grid["col"] = grid["row"] + 1, 0
            grid["down"] = [d for d in grid["down"] if d[2] > grid["row"]]
            return grid["row"], -1
        row, col = max(grid["row"], 0), grid["col"]
        while over := next((d for d in grid["down"] if d[0] <= col < d[1] and d[2] > row), None):
            col = over[1]
        rows, cols = (_span(a, k) for k in ("rowspan", "colspan"))
        if rows > 1:
            grid["down"].append((col, col + cols, row + rows))
        grid["col"] = col + cols
        return row, min(col, LARGEST)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if self.names and self.names[-1] == tag:  # as most do
            self.names.pop()
            self.post[self.open.pop()] = len(self.rows) - 1 - self.first
        elif tag in self.names:
            n = len(self.names) - 1
            while self.names[n] != tag:
                n -= 1
            self._close(n)

    def handle_data(self, data: str) -> None:
        """Text between elements is a row of its own, so that document order is kept."""
        if self.open and self.names[-1] not in SILENT:
            if data.strip():
                self._add("#text", data)
            else:
                self.space += data


def parse(html: str | None) -> list[dict]:
    """The nodes of one page."""
    tree = _Tree()
    tree.page(html or "")
    return [dict(zip(COLUMNS, row, strict=True)) for row in zip(*(tree.values(name) for name in COLUMNS), strict=True)]


def nodes(pages: DataFrame, key: str = "page_id", html: str = "html", flush: int = 20_000, columns: list[str] = COLUMNS) -> DataFrame:
    """key and the node columns, all or some; `a` is an ancestor of `d` if a.pre < d.pre <= a.post."""
    kind = pages.schema[key].dataType.simpleString()
    kinds = {"int": pa.int32(), "string": pa.string()}
    fields = [(name, of) for name, of in (c.split() for c in SCHEMA.split(", ")) if name in columns]
    names = [name for name, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tree, first = _Tree(names), 0

            def made(b: pa.RecordBatch, tree: _Tree, first: int) -> pa.RecordBatch:
                at = np.repeat(np.arange(first, first + len(tree.sizes)), tree.sizes)
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(tree.values(name), kinds[of]) for name, of in fields)], [key, *names])

            for k, page in enumerate(b.column(1)):
                tree.page(page.as_py() or "")
                if len(tree.rows) >= flush:
                    yield made(b, tree, first)
                    tree, first = _Tree(names), k + 1
            yield made(b, tree, first)

    return pages.select(key, html).mapInArrow(run, ", ".join([f"`{key}` {kind}", *(f"{name} {of}" for name, of in fields)]))

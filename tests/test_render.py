"""Page text against a plain recursive walk: known cases, random pages, and all pages of a table."""

import random
import re

import pytest

from recordloom.dom import nodes as dom
from recordloom.dom import render
from recordloom.dom.regions import HEADINGS

SF = "/root/testdata/sf0.001"


class Walk:
    """The text of one page, element by element."""

    def __init__(self, rows):
        self.rows, self.kids = rows, {}
        for r in rows:
            self.kids.setdefault(r["parent"], []).append(r)

    def children(self, n):
        return [c for c in self.kids.get(n["pre"], []) if c["tag"] not in render.SILENT]

    def inline(self, n, breaks=True):
        gap, tag = re.sub("[ \t\r\f\v\xa0]+", " ", n["gap"]), n["tag"]
        if tag == "#text":
            return gap + re.sub("[ \t\r\f\v\xa0]+", " ", n["raw"])
        if tag == "br":
            return gap + ("\n" if breaks else " ")
        if tag in render.NESTING:
            return gap + " "
        text = "".join(self.inline(c, breaks) for c in self.children(n))
        if tag == "sup":
            text = text.strip()
            return gap + (f"[{text}]" if 0 < len(text) <= 4 else text)
        if tag == "a":
            text = text.strip()
            return gap + (f"{text} [{n['href']}]" if text and self.informative(n["href"], text) else text)
        return gap + text

    @staticmethod
    def informative(href, text):
        target = href.strip()
        path = re.match("(?i)https?://[^/?#]*([^#]*)", target)
        if not path or any(p in path[1] for p in render.INSIDE):
            return False
        said = text.strip().rstrip("/").lower()
        return not (said and said in target.rstrip("/").lower())

    @staticmethod
    def tidy(text):
        return [x for x in (re.sub(r"\s+", " ", line).strip() for line in text.split("\n")) if x]

    def own(self, n, breaks=True):
        return self.tidy("".join(self.inline(c, breaks) for c in self.children(n)))

    def flow(self, n):
        """Blocks of a container."""
        out, run = [], []

        def flush():
            lines = self.tidy("".join(run))
            if lines:
                out.append("\n".join(lines))
            run.clear()

        for c in self.children(n):
            if c["tag"] in render.BLOCKS:
                flush()
                out += self.block(c)
            else:
                run.append(self.inline(c))
        flush()
        return out

    def block(self, n):
        tag = n["tag"]
        if tag in HEADINGS:
            lines = self.own(n, False)
            return ["#" * int(tag[1]) + " " + "\n".join(lines)] if lines else []
        if tag == "hr":
            return ["---"]
        if tag in ("ul", "ol"):
            lines = self.items(n)
            return ["\n".join(lines)] if lines else []
        if tag == "dl":
            lines = self.terms(n)
            return ["\n".join(lines)] if lines else []
        if tag == "table":
            if self.layout(n):
                return [b for tr in self.table_rows(n) for c in self.children(tr) if c["tag"] in ("td", "th") for b in self.flow(c)]
            return ["\n".join(self.table(n))]
        if tag == "blockquote":
            return ["\n".join("  " + line for line in b.split("\n")) for b in self.flow(n)]
        if tag == "pre":
            text = self.written(n).strip("\n")
            return [text] if text.strip() else []
        if tag in render.PARAGRAPHS:
            lines = self.own(n)
            return (["\n".join(lines)] if lines else []) + [b for c in self.children(n) if c["tag"] in render.NESTING for b in self.nested(c)]
        return self.flow(n)

    def written(self, n):
        return "".join(c["gap"] + c["raw"] + self.written(c) for c in self.children(n))

    def nested(self, n):
        lines = self.items(n) if n["tag"] in ("ul", "ol") else self.terms(n) if n["tag"] == "dl" else self.table(n)
        return ["\n".join(lines)] if lines else []

    def items(self, n, depth=0):
        out = []
        try:
            number = int(n["start"] or "1")
        except ValueError:
            number = 1
        for li in self.children(n):
            if li["tag"] != "li":
                continue
            if n["tag"] == "ol" and re.fullmatch("[0-9]+", li["start"]):
                number = int(li["start"])
            mark, indent = f"{number}." if n["tag"] == "ol" else "-", "  " * depth
            inside = [c for c in self.children(li) if c["tag"] in render.NESTING]
            text = "".join(c["gap"] if c in inside else self.inline(c) + ("\n" if c["tag"] in ("p", "div") else "") for c in self.children(li))
            first, *rest = self.tidy(text) or [""]
            out.append(f"{indent}{mark} {first}".rstrip())
            hang = indent + " " * (len(mark) + 1)
            out += [hang + x for x in rest]
            for c in inside:
                if c["tag"] in ("ul", "ol"):
                    out += self.items(c, depth + 1)
                else:
                    out += [hang + x for x in (self.terms(c) if c["tag"] == "dl" else self.table(c))]
            number += 1
        return out

    def terms(self, n):
        out = []
        for c in self.children(n):
            if c["tag"] == "dt" and self.own(c, False):
                out.append("\n".join(self.own(c, False)) + ":")
            if c["tag"] == "dd":
                out += ["  " + x for x in self.own(c)]
        return out

    def table_rows(self, n):
        return [r for r in self.rows[n["pre"] + 1 : n["post"] + 1] if r["tag"] == "tr" and r["table"] == n["pre"] and r["above"] in ("table", "tbody", "thead", "tfoot")]

    def layout(self, n):
        return n["role"].lower() == "presentation" or all(sum(c["tag"] in ("td", "th") for c in self.children(tr)) <= 1 for tr in self.table_rows(n))

    def cell(self, n):
        parts, run = [], []

        def flush():
            text = " ".join(self.tidy("".join(run)))
            if text:
                parts.append(text)
            run.clear()

        for c in self.children(n):
            if c["tag"] in ("ul", "ol", "dl"):
                flush()
                lines = [re.sub(r"^-\s+", "", x.strip()) if c["tag"] != "dl" else x.strip() for x in (self.items(c) if c["tag"] != "dl" else self.terms(c))]
                parts.append(" ; ".join(x for x in lines if x))
            elif c["tag"] == "table":
                flush()
                rows = [x.split(": ", 1)[-1].replace(" | ", " / ") for x in self.table(c) if x.startswith(("Row", "Columns"))]
                parts.append(" ; ".join(rows))
            else:
                run.append(self.inline(c))
        flush()
        return " ".join(p for p in parts if p).strip()

    def table(self, n):
        rows = self.table_rows(n)
        if not rows:
            return []
        grid, head, height = {}, None, len(rows)
        cells = [(c, tr) for tr in rows for c in self.children(tr) if c["tag"] in ("td", "th")]
        width = max((c["col"] for c, _ in cells), default=-1) + 1
        for tr in rows:
            mine = [c for c, of in cells if of is tr]
            if head is None and mine and all(c["tag"] == "th" for c in mine):
                head = tr["row"]
        for c, _ in cells:
            text = self.cell(c)
            for r in range(c["row"], max(min(c["row"] + c["rows"], height), c["row"] + 1)):
                for k in range(c["col"], max(min(c["col"] + c["cols"], width), c["col"] + 1)):
                    grid[r, k] = text
        caption = next((r for r in self.rows if r["tag"] == "caption" and r["table"] == n["pre"] and r["above"] == "table"), None)
        title = "\n".join(self.own(caption, False)) if caption else ""
        out, number = [f"TABLE: {title}".rstrip()], 0
        for r in range(height):
            line = [grid.get((r, k), "") for k in range(width)]
            if not any(line):
                continue
            number += r != head
            out.append(("Columns: " if r == head else f"Row {number}: ") + " | ".join(line))
        return out

    def text(self, interface=render.INTERFACE):
        top = [b for r in self.kids.get(-1, []) if r["tag"] not in render.SILENT for b in (self.block(r) if r["tag"] in render.BLOCKS else [])]
        lines = "\n\n".join(top).split("\n")

        def chrome(line):
            parts = [p.strip() for p in line.strip().lower().split("|") if p.strip()]
            return line.strip().lower() in interface or (len(parts) > 1 and all(p in interface for p in parts))

        text = "\n".join(re.sub(r"[ \t]+$", "", x) for x in lines if not chrome(x))
        return re.sub(r"\n{3,}", "\n\n", text).strip("\n") + "\n"


def shown(spark, pages):
    n = dom.nodes(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string"))
    return {r["page_id"]: r["text"] for r in render.rendered(n).collect()}


CASES = [
    ("<h2>Degree</h2><p>Total: 128 units.</p>", "## Degree\n\nTotal: 128 units.\n"),
    ("<ul><li>Core<ul><li>A 100</li><li>A 222</li></ul></li><li>Electives</li></ul>", "- Core\n  - A 100\n  - A 222\n- Electives\n"),
    ('<ol start="3"><li>Third</li><li>Fourth<ol><li>Sub</li></ol></li><li value=9>Ninth<li>Tenth</ol>', "3. Third\n4. Fourth\n  1. Sub\n9. Ninth\n10. Tenth\n"),
    ("<table><caption>Required</caption><tr><th>C<th>T<th>U</tr><tr><td>A 410<td>Acc<td>4</tr></table>", "TABLE: Required\nColumns: C | T | U\nRow 1: A 410 | Acc | 4\n"),
    ('<table><tr><th>T<th>C<th>U</tr><tr><td rowspan="2">Audit<td>A 462<td>4</tr><tr><td>A 463<td>4</tr><tr><td colspan="2">Total<td>8</tr></table>', "TABLE:\nColumns: T | C | U\nRow 1: Audit | A 462 | 4\nRow 2: Audit | A 463 | 4\nRow 3: Total | Total | 8\n"),
    ("<p>P 430 (4 units) <sup>1</sup></p><p><sup>1</sup> Requires.</p>", "P 430 (4 units) [1]\n\n[1] Requires.\n"),
    ('<p>See the <a href="https://d.example.org/x">page</a>, <a href="https://d.example.org">d.example.org</a>, <a href="preview_course.php?a=1">P 100</a> and <a href="https://d.example.org/index.php?q">in</a>.</p>', "See the page [https://d.example.org/x], d.example.org, P 100 and in.\n"),
    ("<p>Add to Portfolio (opens a new window)</p><p>Real.</p><p>Help | Back to top</p>", "Real.\n"),
    ("<dl><dt>Residency</dt><dd>20 units<br>here</dd><dt>GPA</dt><dd>2.0</dd></dl>", "Residency:\n  20 units\n  here\nGPA:\n  2.0\n"),
    ("<p>Line one<br>Line two</p><h3>One<br>Two</h3>", "Line one\nLine two\n\n### One Two\n"),
    ("<p>Total&nbsp;&nbsp;units:&amp;   128</p>", "Total units:& 128\n"),
    ('<div style="display:none"><ul><li>D 320</li></ul></div>', "- D 320\n"),
    ("<table><tr><td>a<ul><li>x<li>y</ul>b</td><td><table><tr><td>1<td>2</tr><tr><td>3<td>4</tr></table></td></tr></table>", "TABLE:\nRow 1: a x ; y b | 1 / 2 ; 3 / 4\n"),
    ("<table role=presentation><tr><td><h1>T</h1><p>one</td><td>two</td></tr></table>", "# T\n\none\n\ntwo\n"),
    ("<ul><li><p>one</p><p>two</p><dl><dt>k<dd>v</dl><table><tr><td>a<td>b</tr></table></li></ul>", "- one\n  two\n  k:\n    v\n  TABLE:\n  Row 1: a | b\n"),
    ("<blockquote>said<p>again</p><blockquote>deep</blockquote></blockquote>", "  said\n\n  again\n\n    deep\n"),
    ("<pre>\n a\n   b\n</pre><hr>", " a\n   b\n\n---\n"),
    ("<p>PHIL<b>100</b> <i>x</i>y</p>in <span>a<div>b</div></span> line<p>z</p>", None),
    ('<table><tr><td rowspan="1000000000" colspan="99999">a</td><td>b</td></tr><tr><td>c</td></tr></table>', None),
    ("", ""), (None, ""), ("just text", ""), ("<p></p>", "\n"),
]


def test_known_cases(spark):
    got = shown(spark, [h for h, _ in CASES])
    for k, (html, want) in enumerate(CASES):
        if want is not None:
            assert got.get(k, "") == want, html
        assert got.get(k, Walk(dom.parse(html)).text()) == Walk(dom.parse(html)).text(), html


def test_spans_end_with_their_table(spark):
    page = '<table><tr><td rowspan="1000000000" colspan="99999">a</td><td>b</td></tr><tr><td>c</td></tr><tr><td>d</td><td>e</td><td>f</td></tr></table>'
    assert [(r["row"], r["col"], r["rows"], r["cols"]) for r in dom.parse(page) if r["tag"] == "td"][:2] == [(0, 0, 65534, 1000), (0, 1000, 1, 1)]
    small = '<table><tr><td rowspan="9">a</td><td>b</td></tr><tr><td>c</td></tr></table>'
    assert shown(spark, [small])[0] == "TABLE:\nRow 1: a | b\nRow 2: a | c\n"


TAGS = ["p", "div", "ul", "ol", "li", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "caption", "span", "b", "a", "sup", "h2", "blockquote", "section", "pre", "figcaption", "tbody", "form", "label"]


def random_page(r, depth=0):
    out = []
    for _ in range(r.randrange(1, 5)):
        pick = r.random()
        if pick < 0.35 or depth > 6:
            out.append(r.choice(["word", " two words ", "\n", " ", "x\ny", "&nbsp;", "help", "1", "A 100 | B"]))
        elif pick < 0.42:
            out.append(r.choice(["<br>", "<hr>", "<sup>2</sup>", "<a href='https://e.org/z'>z y</a>"]))
        else:
            tag = r.choice(TAGS)
            attrs = {"a": " href='https://e.org/q'", "td": r.choice(["", " rowspan=2", " colspan=3"]), "ol": r.choice(["", " start=4", " start=x"]), "li": r.choice(["", " value=7", " value=-1"]), "table": r.choice(["", " role=presentation"])}.get(tag, "")
            inner = random_page(r, depth + 1)
            if tag == "table":
                inner = "".join(f"<tr>{''.join(f'<{c}>{random_page(r, depth + 2)}</{c}>' for c in r.choices(['td', 'th'], k=r.randrange(1, 4)))}</tr>" for _ in range(r.randrange(3)))
            if tag in ("ul", "ol"):
                inner = "".join(f"<li>{random_page(r, depth + 1)}</li>" for _ in range(r.randrange(4)))
            out.append(f"<{tag}{attrs}>{inner}" + (f"</{tag}>" if r.random() < 0.9 else ""))
    return "".join(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_pages_equal_a_walk(spark, seed):
    r = random.Random(seed)
    pages = [f"<body>{random_page(r)}</body>" for _ in range(150)]
    got = shown(spark, pages)
    for k, page in enumerate(pages):
        assert got[k] == Walk(dom.parse(page)).text(), page


def test_all_given_pages_equal_a_walk(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in render.rendered(dom.nodes(pages)).collect()}
    for r in pages.collect():
        assert got[r["page_id"]] == Walk(dom.parse(r["html"])).text()

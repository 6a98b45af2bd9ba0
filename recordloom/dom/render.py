"""Plain text of pages, the same for the same page: a fold of the node table from its deepest level up.

Elements are blocks (containers, headings, paragraphs, lists, data tables and so on) or flow inline within one.  Every
piece of text has an owner, the nearest element that has lines of its own; the outermost inline element around it
says which.  Owners become text by one aggregate.  Lists, definition lists and data tables nest in each other through
items and cells: those that hold no other are folded first, each level by one aggregate, so that an inner block is
text before the item or cell around it is.  The number of levels is how deeply a page nests them.

What a page holds is one task's in the last aggregate and in the running windows, so the largest page bounds a task.

Rules: headings get `#` marks; list items `-` or their number, an indent of two for each outer list, and a hanging indent;
terms a colon and their descriptions an indent; quotes an indent; data tables a title, a header row and numbered rows,
with what spans several cells in each of them.  In a cell, items are parted by ` ; ` and cells of an inner table by ` / `, which
no cell border is.  A table is layout if it says so or no row has two cells; its cells are then containers.  Links
show their target where it says more than their text, short superscripts stand in brackets, `br` breaks a line.  Inside of
inline elements lists and tables are a space.  A cell reaches no further than the rows of its table and the last column
that a cell starts in.  Blocks are parted by one empty line.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.dom import noise
from recordloom.dom.nodes import COLUMNS
from recordloom.dom.regions import HEADINGS, KEY, contained, joined, running
from recordloom.sources.shared import settled

# fixed values: which elements are blocks, paragraphs, and never shown
BLOCKS = [
    "p", "div", "section", "article", "main", "aside", "blockquote", "pre", "ul", "ol", "dl", "table", *HEADINGS, "hr", "fieldset", "figure", "figcaption", "address", "center",
    "tbody", "thead", "tfoot", "tr", "td", "th", "li", "dt", "dd", "form", "details", "summary", "html", "body",
]
PARAGRAPHS = ["p", "figcaption", "summary", "address", "center"]
SILENT = ["script", "style", "noscript", "template", "svg", "button", "input", "select", "label", "head"]
NESTING = ["ul", "ol", "dl", "table"]
# fixed values: paths inside of the site, whose links say no more than their text
INSIDE = ["preview_program.php", "preview_course", "content.php", "index.php", "portfolio", "search.php", "print_degree_planner", "catalog_list.php", "help.php"]
# fixed values: lines of interface chrome
INTERFACE = [
    "add to portfolio (opens a new window)", "add to portfolio", "print (opens a new window)", "print-friendly page (opens a new window)", "print degree planner (opens a new window)", "help (opens a new window)",
    "share this page:", "back to top", "[archived catalogue]", "close", "help",
]
BREAK = "\x01"
#: Columns of the node table that texts are not made of: they are neither shuffled nor written.
UNREAD = ["depth", "id", "class", "level", "aria", "text"]


def read(selectors: list[str] = noise.SELECTORS) -> list[str]:
    """The columns of the node table that noise and texts are found by."""
    return [c for c in COLUMNS if c not in UNREAD or c in noise.read(selectors)]


def _within(flag: Column, name: str, nodes: DataFrame) -> DataFrame:
    """Whether an element with `flag` holds each node: intervals nest, so the furthest end so far tells."""
    end = F.max(F.when(flag, F.col("post"))).over(running().rowsBetween(Window.unboundedPreceding, -1))
    return nodes.withColumn(name, F.coalesce(end >= F.col("pre"), F.lit(False)))


def _ordered(value: str, *by: str) -> Column:
    """An array of `value` in the order of some columns."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*by, value))), lambda x: x[value])


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^[\s\x01]+|[\s\x01]+$", "")


def lines_of(text: Column, breaks: bool = True) -> Column:
    """The lines of an inline text: white space is one space, lines without text go."""
    whole = F.replace(text, F.lit(BREAK), F.lit("\n" if breaks else " "))
    return F.filter(F.transform(F.split(whole, "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != "")


def structured(nodes: DataFrame) -> DataFrame:
    """Nodes with `block` (in block flow), `own` (has lines of its own), and `owner` and `seg` of what is inline.

    `own` elements are blocks that are no containers, and items, terms, rows and cells below them; `seg` is the last
    block before a node, which parts the inline runs of a container or cell.
    """
    tag, above = F.col("tag"), F.col("above")
    # cells of a row, and the most of them in a table, by windows within a page, so that nodes are shuffled once
    cell = tag.isin("td", "th") & (above == "tr")
    n = nodes.withColumn("grid", F.when(tag == "table", F.col("pre")).when(cell, F.col("table")))
    n = n.withColumn("n_cells", F.count(F.when(cell, 1)).over(Window.partitionBy(KEY, "grid", "parent"))).withColumn("most", F.max(F.when(cell, F.col("n_cells"))).over(Window.partitionBy(KEY, "grid")))
    n = n.withColumn("data", (tag == "table") & (F.coalesce("most", F.lit(0)) > 1) & (F.lower("role") != "presentation")).drop("grid", "n_cells", "most")
    element = tag != "#text"
    stop = element & (tag.isin(*HEADINGS, *PARAGRAPHS, "ul", "ol", "dl", "pre", "hr") | F.col("data") | ~tag.isin(*BLOCKS))
    n = _within(stop, "inside", n).withColumn("block", ~F.col("inside") & ~F.col("tag").eqNullSafe("#text")).withColumn("top", F.col("block") & stop & tag.isin(*BLOCKS))
    held = (
        ((tag == "li") & above.isin("ul", "ol")) | (tag.isin("dt", "dd") & (above == "dl")) | (tag.isin("tr") & above.isin("table", "tbody", "thead", "tfoot")) | (tag.isin("tbody", "thead", "tfoot", "caption") & (above == "table"))
        | (tag.isin("td", "th") & (above == "tr")) | (tag.isin(*NESTING) & above.isin("li", "td", "th", *PARAGRAPHS))
    )
    # inline elements: those in block flow that are no blocks, and those below a block that its kind has no place for
    inline = element & F.when(F.col("inside"), ~held).otherwise(~tag.isin(*BLOCKS))
    around = F.max(F.when(inline, F.struct("post", -F.col("pre"), "parent"))).over(running().rowsBetween(Window.unboundedPreceding, -1))
    n = n.withColumns({"inline": inline, "around": around}).withColumn("covered", F.coalesce(F.col("around.post") >= F.col("pre"), F.lit(False)))
    n = n.withColumn("own", element & ~F.col("inline") & ~F.col("covered") & (F.col("inside") | F.col("top")))
    part = F.when((F.col("block") & tag.isin(*BLOCKS)) | (F.col("own") & tag.isin(*NESTING)), F.col("pre"))
    n = n.withColumns({"owner": F.when(F.col("covered"), F.col("around.parent")).otherwise(F.col("parent")), "seg": F.coalesce(F.max(part).over(running()), F.lit(-1))})
    # lists and tables inside of inline elements are a space, whatever they hold
    flat = tag.isin(*NESTING) & (F.col("inline") | F.col("covered"))
    # what a layout table holds outside of the cells of its rows is not shown
    stray = ~F.col("inside") & (F.col("within") == "table") & ~(tag.isin("tr", "tbody", "thead", "tfoot") | (tag.isin("td", "th") & (above == "tr")))
    n = _within(flat, "gone", n.withColumns({"flat": flat, "stray": stray}))
    return _within(stray, "lost", n).where("not gone and not lost and not stray").drop("around", "gone", "lost", "stray", "inside")


def pieces(n: DataFrame) -> DataFrame:
    """(key, pre, part, owner, seg, piece) of inline text, links and superscripts folded from the innermost out."""
    tag = F.col("tag")
    inline = n.where((tag == "#text") | F.col("inline") | F.col("covered") | (F.col("gap") != ""))
    spaced = lambda c: F.regexp_replace(c, r"[ \t\r\f\x0b\x{a0}]+", " ")
    said = F.when(tag == "#text", spaced(F.col("raw"))).when(tag == "br", BREAK).when(F.col("flat"), " ")
    shown = F.array(F.struct(F.lit(-1).alias("part"), F.nullif(spaced(F.col("gap")), F.lit("")).alias("piece")), F.struct(F.lit(0).alias("part"), said.alias("piece")))
    texts = inline.select(KEY, "pre", "owner", "seg", F.explode(shown).alias("s")).select(KEY, "pre", "s.part", "owner", "seg", "s.piece").where("piece is not null")
    # paragraphs within an item end a line
    ends = n.where(tag.isin("p", "div") & (F.col("above") == "li") & F.col("inline") & ~F.col("covered")).select(KEY, F.col("post").alias("pre"), F.lit(5).alias("part"), "owner", "seg", F.lit(BREAK).alias("piece"))
    marks = n.where(tag.isin("a", "sup") & (F.col("inline") | F.col("covered"))).select(KEY, F.col("pre").alias("o_pre"), F.col("post").alias("o_post"), F.col("tag").alias("o_tag"), "href", F.col("owner").alias("o_owner"), F.col("seg").alias("o_seg"))
    outer = marks.select(KEY, "o_pre", "o_post")
    inner = marks.select(KEY, F.col("o_pre").alias("pre"))
    deep = contained(inner, outer, [KEY, "pre"]).groupBy(KEY, F.col("pre").alias("o_pre")).agg(F.count("*").alias("deep"))
    marks = settled(joined(marks, deep, [KEY, "o_pre"], "left").withColumn("deep", F.coalesce("deep", F.lit(0))))
    out = texts.unionByName(ends)
    for level in range((marks.agg(F.max("deep")).first()[0] or 0), -1, -1):
        mine = marks.where(F.col("deep") == level)
        # the marks of a level are apart, so the last one that starts before a piece holds it, or none does
        both = out.select(KEY, "pre", "part", "owner", "seg", "piece", F.lit(None).cast("struct<o_pre:int,o_post:int,o_tag:string,href:string,o_owner:int,o_seg:int>").alias("m"))
        both = both.unionByName(mine.select(KEY, F.col("o_pre").alias("pre"), F.lit(-9).alias("part"), F.lit(None).cast("int").alias("owner"), F.lit(None).cast("int").alias("seg"), F.lit("").alias("piece"), F.struct("o_pre", "o_post", "o_tag", "href", "o_owner", "o_seg").alias("m")))
        last = F.last("m", ignorenulls=True).over(Window.partitionBy(KEY).orderBy("pre", "part").rowsBetween(Window.unboundedPreceding, 0))
        both = both.withColumn("at", last).withColumn("held", F.coalesce((F.col("at.o_post") >= F.col("pre")) & (F.col("part") != 5) & ~((F.col("part") == -1) & (F.col("pre") == F.col("at.o_pre"))), F.lit(False)))
        whole = both.where("held").groupBy(KEY, F.col("at.o_pre").alias("pre"), "at.o_tag", "at.href", F.col("at.o_owner").alias("owner"), F.col("at.o_seg").alias("seg")).agg(_strip(F.array_join(_ordered("piece", "pre", "part"), "")).alias("t"))
        short = (F.col("o_tag") == "sup") & (F.length("t") > 0) & (F.length("t") <= 4)
        said = F.when(short, F.concat(F.lit("["), "t", F.lit("]"))).when((F.col("o_tag") == "a") & (F.col("t") != "") & informative(F.col("href"), F.col("t")), F.concat("t", F.lit(" ["), "href", F.lit("]"))).otherwise(F.col("t"))
        out = both.where("m is null and not held").select(KEY, "pre", "part", "owner", "seg", "piece").unionByName(whole.select(KEY, "pre", F.lit(0).alias("part"), "owner", "seg", said.alias("piece")))
    return out


def informative(href: Column, text: Column) -> Column:
    """Whether a link's target says more than its text: on the web, outside of the site's own paths, and not what is written."""
    target = F.trim(href)
    path = F.regexp_extract(target, r"^[^:]*://[^/?#]*([^#]*)", 1)
    bare = lambda c: F.lower(F.regexp_replace(c, "/+$", ""))
    own = F.lit(False)
    for p in INSIDE:
        own = own | path.contains(p)
    said = bare(F.trim(F.replace(text, F.lit(BREAK), F.lit("\n"))))
    return target.rlike("^(?i)https?:") & ~own & ~((said != "") & F.contains(bare(target), said))


def _numbers(n: DataFrame) -> DataFrame:
    """(key, pre, up, mark) of list items: numbers start and restart as the page says."""
    item = n.where("own and tag = 'li'").select(KEY, "pre", F.col("parent").alias("up"), F.col("start").alias("value"), F.col("above").alias("list"))
    begin = n.where("own and tag = 'ol'").select(KEY, F.col("pre").alias("up"), F.coalesce(F.trim("start").try_cast("int"), F.lit(1)).alias("begin"))
    w = Window.partitionBy(KEY, "up").orderBy("pre")
    item = joined(item, begin, [KEY, "up"], "left").withColumns({"i": F.row_number().over(w), "set": F.when(F.col("value").rlike("^[0-9]+$"), F.col("value").try_cast("int"))})
    base = F.last(F.when(F.col("set").isNotNull(), F.col("set") - F.col("i")), ignorenulls=True).over(w)
    number = F.concat((F.col("i") + F.coalesce(base, F.col("begin") - 1)).cast("string"), F.lit("."))
    return item.select(KEY, "pre", "up", F.when(F.col("list") == "ol", number).otherwise("-").alias("mark"))


def _indent(lines: Column, by: Column) -> Column:
    return F.transform(lines, lambda x: F.concat(by, x))


def _none(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


def _lists(items: DataFrame, texts: DataFrame, inner: DataFrame) -> DataFrame:
    """(key, pre, lines) of lists: each item's first line, the rest and inner blocks below it."""
    own = joined(joined(items, texts.select(KEY, F.col("owner").alias("pre"), "lines"), [KEY, "pre"], "left"), inner, [KEY, "pre"], "left")
    first = F.rtrim(F.concat("mark", F.lit(" "), F.coalesce(F.try_element_at("lines", F.lit(1)), F.lit(""))))
    hang = F.repeat(F.lit(" "), F.length("mark") + 1)
    rest = F.slice(F.coalesce("lines", _none()), 2, LONG)
    below = F.flatten(F.transform(F.coalesce("inner", _none(INNER)), lambda b: _indent(b["lines"], F.when(b["tag"].isin("ul", "ol"), "  ").otherwise(hang))))
    whole = own.withColumn("shown", F.concat(F.array(first), _indent(rest, hang), below))
    return whole.groupBy(KEY, F.col("up").alias("pre")).agg(F.flatten(_ordered("shown", "pre")).alias("lines"))


INNER = "struct<pre:int,tag:string,lines:array<string>>"
#: Longer than any list of lines.
LONG = 1 << 30


def _cell(tag: Column, lines: Column) -> Column:
    """An inner block as part of a cell's line."""
    item = F.transform(lines, lambda x: F.trim(x))
    rows = F.filter(lines, lambda x: x.startswith("Row") | x.startswith("Columns"))
    rows = F.transform(rows, lambda x: F.replace(F.when(F.instr(x, ": ") > 0, F.substring(x, F.instr(x, ": ") + 2, F.length(x))).otherwise(x), F.lit(" | "), F.lit(" / ")))
    parts = F.when(tag == "table", rows).when(tag == "dl", item).otherwise(F.transform(item, lambda x: F.regexp_replace(x, r"^-\s+", "")))
    return F.array_join(F.filter(parts, lambda x: x != ""), " ; ")


def _tables(cells: DataFrame, runs: DataFrame, inner: DataFrame, captions: DataFrame, tables: DataFrame) -> DataFrame:
    """(key, pre, lines) of data tables: a title, the header row, then numbered rows."""
    part = runs.select(KEY, F.col("owner").alias("pre"), F.col("seg").alias("k"), F.lit(1).alias("j"), F.array_join("lines", " ").alias("said"))
    block = inner.select(KEY, "pre", F.explode("inner").alias("b")).select(KEY, "pre", F.col("b.pre").alias("k"), F.lit(0).alias("j"), _cell(F.col("b.tag"), F.col("b.lines")).alias("said"))
    texts = part.unionByName(block).where("said <> ''").groupBy(KEY, "pre").agg(F.array_join(_ordered("said", "k", "j"), " ").alias("line"))
    size = joined(tables, cells, [KEY, "table"], "left").groupBy(KEY, "table").agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))
    known = joined(tables, size, [KEY, "table"]).withColumn("height", F.coalesce("height", "n_rows"))
    each = joined(joined(cells, known, [KEY, "table"]), texts, [KEY, "pre"], "left").withColumn("line", F.trim(F.coalesce("line", F.lit(""))))
    end = lambda at, n, size: F.least(F.col(at).cast("long") + F.col(n), F.col(size).cast("long")) - 1
    spread = each.withColumn("r", F.explode(F.sequence(F.col("row").cast("long"), F.greatest(end("row", "rows", "height"), F.col("row").cast("long"))))).withColumn("c", F.explode(F.sequence(F.col("col").cast("long"), F.greatest(end("col", "cols", "n_cols"), F.col("col").cast("long")))))
    one = spread.groupBy(KEY, "table", "r", "c").agg(F.max_by("line", "pre").alias("line"))
    at = F.map_from_entries(F.collect_list(F.struct("c", "line")))
    row = joined(one.groupBy(KEY, "table", "r").agg(at.alias("at")), known.select(KEY, "table", "n_cols"), [KEY, "table"])
    row = row.withColumn("cut", F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_cols").cast("long") - 1), lambda c: F.coalesce(F.try_element_at("at", c), F.lit("")))).where(F.exists("cut", lambda x: x != ""))
    heads = cells.groupBy(KEY, "table", "row").agg(F.bool_and(F.col("tag") == "th").alias("th")).where("th").groupBy(KEY, "table").agg(F.min("row").alias("head"))
    row = joined(row, heads, [KEY, "table"], "left").withColumn("is_head", F.col("r").eqNullSafe(F.col("head").cast("long")))
    number = F.sum((~F.col("is_head")).cast("int")).over(Window.partitionBy(KEY, "table").orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    said = F.array_join("cut", " | ")
    shown = row.withColumn("k", number).withColumn("shown", F.when(F.col("is_head"), F.concat(F.lit("Columns: "), said)).otherwise(F.concat(F.lit("Row "), F.col("k").cast("string"), F.lit(": "), said)))
    body = shown.groupBy(KEY, "table").agg(_ordered("shown", "r").alias("body"))
    title = F.rtrim(F.concat(F.lit("TABLE: "), F.coalesce("caption", F.lit(""))))
    whole = joined(joined(tables.where("height > 0"), body, [KEY, "table"], "left"), captions, [KEY, "table"], "left")
    return whole.select(KEY, F.col("table").alias("pre"), F.concat(F.array(title), F.coalesce("body", _none())).alias("lines"))


def rendered(nodes: DataFrame, interface: list[str] = INTERFACE, pages: DataFrame | None = None) -> DataFrame:
    """(key, text) of every page that has a node; lines that say one of `interface` are left out, alone or parted by bars.

    `pages` are the keys of all pages that have a node, where these are known; nodes are then read once, but for pages
    with text that is shown as written.
    """
    nodes = nodes.drop(*UNREAD)
    clean = _within(F.col("tag").isin(*SILENT), "hidden", nodes).where(~F.col("hidden") & ~F.col("tag").isin(*SILENT)).drop("hidden")
    n = settled(structured(clean))
    tag = F.col("tag")
    owners = n.where("own").select(KEY, F.col("pre").alias("owner"), F.col("tag").alias("o_tag"))
    said = settled(joined(pieces(n), owners, [KEY, "owner"], "left"))
    # texts of owners; containers and cells have one for each run between blocks
    runs = said.where("o_tag is null or o_tag in ('td', 'th')").groupBy(KEY, "owner", "seg", "o_tag").agg(F.array_join(_ordered("piece", "pre", "part"), "").alias("t"), F.min(F.when(F.col("part") >= 0, F.col("pre"))).alias("pre"))
    runs = runs.withColumn("lines", lines_of(F.col("t"))).where(F.size("lines") > 0)
    whole = said.where("o_tag is not null and o_tag not in ('td', 'th')").groupBy(KEY, "owner", "o_tag").agg(F.array_join(_ordered("piece", "pre", "part"), "").alias("t"))
    flowing = F.col("o_tag").isin(*HEADINGS, "dt", "caption")
    texts = settled(whole.withColumn("lines", F.when(flowing, lines_of(F.col("t"), False)).otherwise(lines_of(F.col("t")))))
    nests = n.where(F.col("own") & tag.isin(*NESTING)).select(KEY, "pre", "post", "parent", "tag", "above")
    outer = nests.select(KEY, F.col("pre").alias("o_pre"), F.col("post").alias("o_post"))
    deep = contained(nests.select(KEY, "pre"), outer, [KEY, "pre"]).groupBy(KEY, "pre").agg(F.count("*").alias("deep"))
    nests = settled(joined(nests, deep, [KEY, "pre"], "left").withColumn("deep", F.coalesce("deep", F.lit(0))))
    items = settled(_numbers(n))
    as_text = F.array_join("lines", "\n")
    terms = joined(n.where("own and tag in ('dt', 'dd')").select(KEY, F.col("parent").alias("up"), F.col("pre").alias("owner")), texts, [KEY, "owner"])
    terms = terms.select(KEY, "up", "owner", F.when((F.col("o_tag") == "dt") & (F.size("lines") > 0), F.array(F.concat(as_text, F.lit(":")))).when(F.col("o_tag") == "dd", _indent(F.col("lines"), F.lit("  "))).otherwise(_none()).alias("shown"))
    cells = n.where("own and tag in ('td', 'th')").select(KEY, "pre", "table", "row", "col", "rows", "cols", "tag")
    heights = n.where("own and tag = 'tr'").groupBy(KEY, "table").agg(F.count("*").alias("height"))
    captions = joined(n.where("own and tag = 'caption'").groupBy(KEY, "table").agg(F.min("pre").alias("owner")), texts, [KEY, "owner"]).where(F.size("lines") > 0).select(KEY, "table", as_text.alias("caption"))
    folded: list[DataFrame] = []
    inner = n.limit(0).select(KEY, "pre", _none(INNER).alias("inner"))
    deepest = nests.agg(F.max("deep")).first()[0]
    for level in range(-1 if deepest is None else deepest, -1, -1):
        mine = nests.where(F.col("deep") == level)
        at = lambda t, c, m=mine: m.where(F.col("tag").isin(*t)).select(KEY, F.col("pre").alias(c))
        lists = _lists(joined(items, at(["ul", "ol"], "up"), [KEY, "up"]), texts, inner)
        defined = joined(terms, at(["dl"], "up"), [KEY, "up"]).groupBy(KEY, F.col("up").alias("pre")).agg(F.flatten(_ordered("shown", "owner")).alias("lines"))
        tables = joined(at(["table"], "table"), heights, [KEY, "table"])
        made = lists.unionByName(defined).unionByName(_tables(joined(cells, at(["table"], "table"), [KEY, "table"]), runs.where("o_tag is not null"), inner, captions, tables))
        made = settled(joined(made.where(F.size("lines") > 0), mine.select(KEY, "pre", "parent", "tag", "above"), [KEY, "pre"]))
        inner = settled(made.where("above in ('li', 'td', 'th')").groupBy(KEY, F.col("parent").alias("pre")).agg(F.array_sort(F.collect_list(F.struct("pre", "tag", "lines"))).alias("inner")))
        folded.append(made.select(KEY, "pre", F.col("lines")))
    top = n.where("top and own").select(KEY, F.col("pre").alias("owner"), "tag")
    plain = joined(top.where(~tag.isin("pre", "hr", *NESTING)), texts, [KEY, "owner"]).where(F.size("lines") > 0)
    marked = F.when(F.col("tag").isin(*HEADINGS), F.concat(F.repeat(F.lit("#"), F.substring("tag", 2, 1).cast("int")), F.lit(" "), as_text)).otherwise(as_text)
    blocks = plain.select(KEY, F.col("owner").alias("pre"), marked.alias("shown"))
    blocks = blocks.unionByName(joined(runs.where("o_tag is null"), n.where("block and not own").select(KEY, F.col("pre").alias("owner")), [KEY, "owner"]).select(KEY, "pre", as_text.alias("shown")))
    blocks = blocks.unionByName(n.where("own and top and tag = 'hr'").select(KEY, "pre", F.lit("---").alias("shown")))
    as_written = n.where("own and top and tag = 'pre'").select(KEY, F.col("pre").alias("o_pre"), F.col("post").alias("o_post"))
    if not as_written.isEmpty():
        written = contained(clean.where("tag = '#text' or gap <> ''").select(KEY, "pre", F.concat("gap", "raw").alias("raw")), as_written, [KEY, "o_pre", "pre", "raw"])
        blocks = blocks.unionByName(written.groupBy(KEY, F.col("o_pre")).agg(F.regexp_replace(F.array_join(_ordered("raw", "pre"), ""), r"^\n+|\n+$", "").alias("shown")).where(r"shown rlike '\\S'").select(KEY, F.col("o_pre").alias("pre"), "shown"))
    direct = n.where(F.col("own") & tag.isin(*NESTING) & (F.col("top") | F.col("above").isin(*PARAGRAPHS))).select(KEY, "pre")
    for f in folded:
        blocks = blocks.unionByName(joined(f, direct, [KEY, "pre"]).select(KEY, "pre", as_text.alias("shown")))
    blocks = settled(blocks)
    quotes = n.where("block and tag = 'blockquote'").select(KEY, F.col("pre").alias("o_pre"), F.col("post").alias("o_post"))
    quoted = contained(blocks.select(KEY, "pre"), quotes, [KEY, "pre"]).groupBy(KEY, "pre").agg(F.count("*").cast("int").alias("quotes"))
    blocks = joined(blocks, quoted, [KEY, "pre"], "left").withColumn("lines", _indent(F.split("shown", "\n"), F.repeat(F.lit("  "), F.coalesce("quotes", F.lit(0)))))
    text = F.array_join(_ordered("page_lines", "pre"), "\n\n")
    kept = F.col("lines")
    if interface:
        known = [w.lower() for w in interface]

        def chrome(line: Column) -> Column:
            low = F.lower(_strip(line))
            parts = F.filter(F.transform(F.split(low, r"\|"), lambda x: _strip(x)), lambda p: p != "")
            return low.isin(known) | ((F.size(parts) > 1) & F.forall(parts, lambda p: p.isin(known)))

        kept = F.filter(kept, lambda x: ~chrome(x))
    shown = blocks.withColumn("page_lines", F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, r"[ \t]+$", "")), "\n")).groupBy(KEY).agg(text.alias("t"))
    tidy = F.regexp_replace(F.regexp_replace(F.col("t"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")
    pages = nodes.select(KEY).distinct() if pages is None else pages
    return joined(pages, shown, KEY, "left").select(KEY, F.concat(F.coalesce(tidy, F.lit("")), F.lit("\n")).alias("text"))

"""Content regions, headings, sections, links and plain text from node tables."""

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from recordloom.operators import titles


KEY = "page_id"
# fixed values: what may be a region, what is chrome
REGIONS = ["main", "article", "section", "td", "div", "body"]
CHROME = ["nav", "header", "footer"]
HEADINGS = [f"h{k}" for k in range(1, 7)]
#: The columns of the node table that metadata and breadcrumbs are found by.
READ = ["pre", "post", "tag", "id", "class", "aria", "text"]


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """An equal join of tables that grow with the pages, sorted and merged.

    Spark would broadcast many of them through the driver: it takes their size from files in which nodes are packed
    to some bytes a row.
    """
    return left.join(right.hint("merge"), on, how)


def contained(nodes: DataFrame, outer: DataFrame, inside: list[str], itself: bool = False) -> DataFrame:
    """Nodes with each of the `outer` nodes (key, o_pre, o_post and more) that holds them, or that is the node where `itself`.

    Members are numbered from o_pre + 1 to o_post, so this is an equal join on page and number: its work is
    the sum of what the outer nodes hold, and one large page is spread over many tasks.
    """
    begin = F.col("o_pre") + (0 if itself else 1)
    return joined(nodes, outer.where(begin <= F.col("o_post")).withColumn("pre", F.explode(F.sequence(begin, "o_post"))), [KEY, "pre"]).select(*inside)


def running() -> WindowSpec:
    """A page's nodes up to each one."""
    return Window.partitionBy(KEY).orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)


def sums(nodes: DataFrame, measures: dict[str, Column], of: Column | None = None) -> DataFrame:
    """Nodes (whole subtrees) with the sum of each measure over what they hold: two running sums and an equal join, however deep a page is.

    With `of`, only of the nodes that it holds for, without a join: each has a second row where it ends, after the node
    there, which reads the running sum so far.
    """
    run = nodes.withColumns({m: F.sum(c).over(running()) for m, c in measures.items()})
    if of is not None:
        both = run.select("*", F.posexplode(F.when(of, F.array("pre", "post")).otherwise(F.array("pre"))).alias("is_end", "at"))
        upto = Window.partitionBy(KEY).orderBy("at", "is_end").rowsBetween(Window.unboundedPreceding, 0)
        so_far = F.last(F.when(F.col("is_end") == 0, F.struct(*measures)), ignorenulls=True).over(upto)
        return both.withColumn("so_far", so_far).where("is_end = 1").select(*nodes.columns, *[(F.col("so_far")[m] - F.col(m)).alias(m) for m in measures])
    last = run.select(KEY, F.col("pre").alias("post"), *[F.col(m).alias(f"to_{m}") for m in measures])
    return joined(run, last, [KEY, "post"]).select(*nodes.columns, *[(F.col(f"to_{m}") - F.col(m)).alias(m) for m in measures])


def score(length: Column, link_length: Column, named: Column) -> Column:
    """The score of a region by its text, headings, items, tables and h1 (columns of those names), less what speaks of navigation."""
    # fixed values: the weights
    return (
        F.log(length + 1) * 12 + F.col("headings") * 6 + F.least("items", F.lit(200)) * 0.6 + F.col("tables") * 5 + F.least("h1", F.lit(1)) * 40
        - F.when(link_length > 0.85 * length, 80).otherwise(0) - F.when(named, 120).otherwise(0) - F.when(F.col("tag").isin("body", "html"), 30).otherwise(0)
    )


def candidates(nodes: DataFrame) -> DataFrame:
    """Regions with their measures and score; eligible ones have text and no chrome inside."""
    own = F.length("text")
    one = lambda c: c.cast("long")
    # text within a link: the last link that starts before it and has not ended
    marked = nodes.withColumn("in_link", F.max(F.when(F.col("tag") == "a", F.col("post"))).over(running()) >= F.col("pre"))
    c = sums(marked, {
        "chars": own, "link_chars": F.when(F.col("in_link"), own).otherwise(0), "headings": one(F.col("tag").isin(HEADINGS)), "items": one(F.col("tag") == "li"),
        "tables": one(F.col("tag") == "table"), "h1": one(F.col("tag") == "h1"), "chrome": one(F.col("tag").isin(CHROME)),
    }).where(F.col("tag").isin(REGIONS) & (F.col("post") > F.col("pre")))
    name = F.lower(F.concat_ws(" ", "class", "id"))
    value = F.when(F.col("chars") == 0, -1000.0).otherwise(score(F.col("chars"), F.col("link_chars"), name.rlike("nav|menu|sidebar|ad")))
    measures = ["chars", "link_chars", "headings", "items", "tables", "h1", "chrome"]
    c = c.select(KEY, F.col("pre").alias("o_pre"), F.col("post").alias("o_post"), F.col("tag").alias("o_tag"), name.alias("o_name"), *measures, value.alias("score"))
    return c.withColumn("eligible", (F.col("chars") > 0) & (F.col("chrome") == 0) & (F.col("o_tag") != "body"))


def region(nodes: DataFrame) -> DataFrame:
    """The chosen region of each page: the best eligible one, the first of equals; pages without one are left out."""
    good = candidates(nodes).where("eligible")
    best = good.groupBy(KEY).agg(F.max_by(F.struct("o_pre", "o_post", "o_tag", "score", "chars"), F.struct("score", -F.col("o_pre"))).alias("b"))
    return best.select(KEY, "b.*")


def headings(nodes: DataFrame) -> DataFrame:
    """Headings with their text and level: native ones, and elements with the heading role (level 2 if not given)."""
    level = F.when(F.col("tag").isin(HEADINGS), F.substring("tag", 2, 1).cast("int")).when(F.col("role") == "heading", F.coalesce(F.col("level").try_cast("int"), F.lit(2)))
    found = nodes.withColumn("hl", level).where("hl is not null").select(KEY, F.col("pre").alias("o_pre"), F.col("post").alias("o_post"), "hl")
    texts = contained(nodes.where("tag = '#text'"), found, [KEY, "o_pre", "o_post", "hl", "pre", "text"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda x: x["text"]), " ")
    return texts.groupBy(KEY, "o_pre", "o_post", "hl").agg(joined.alias("heading"))


def section(nodes: DataFrame, wanted: Column) -> DataFrame:
    """Nodes after the first heading that `wanted` (over `heading`) picks and before the next of its level or above."""
    h = headings(nodes)
    start = h.where(wanted).groupBy(KEY).agg(F.min_by(F.struct("o_pre", "o_post", "hl"), "o_pre").alias("s"))
    later = h.join(start, KEY).where((F.col("o_pre") > F.col("s.o_pre")) & (F.col("hl") <= F.col("s.hl"))).groupBy(KEY).agg(F.min("o_pre").alias("stop"))
    return nodes.join(start, KEY).join(later, KEY, "left").where((F.col("pre") > F.col("s.o_post")) & (F.col("stop").isNull() | (F.col("pre") < F.col("stop")))).select(nodes.columns)


def links(nodes: DataFrame) -> DataFrame:
    """Links in order with their text, each href once, numbered within the page."""
    a = nodes.where("tag = 'a' and href <> ''").select(KEY, F.col("pre").alias("o_pre"), F.col("post").alias("o_post"), "href")
    a = a.groupBy(KEY, "href").agg(F.min(F.struct("o_pre", "o_post")).alias("p")).select(KEY, "href", "p.o_pre", "p.o_post")
    texts = contained(nodes.where("tag = '#text'"), a, [KEY, "o_pre", "pre", "text"]).groupBy(KEY, "o_pre").agg(F.array_sort(F.collect_list(F.struct("pre", "text"))).alias("t"))
    title = F.coalesce(F.array_join(F.transform("t", lambda x: x["text"]), " "), F.lit(""))
    return a.join(texts, [KEY, "o_pre"], "left").select(KEY, F.row_number().over(Window.partitionBy(KEY).orderBy("o_pre")).alias("seq"), "href", title.alias("title"))


def _joined(*columns: str) -> Column:
    """Texts in order as one line."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*columns, "text"))), lambda x: x["text"]), " ")


def breadcrumb(nodes: DataFrame, most: int = 400) -> DataFrame:
    """(key, breadcrumb): the texts of each breadcrumb element in order, distinct ones parted by bars.

    Where a page has none: its first link that says where to return to, else what its text says so, else the
    distinct texts of its first navigation list.
    """
    trail = F.array_contains(F.split("class", r"\s+"), "breadcrumb") | F.array_contains(F.split("class", r"\s+"), "breadcrumbs") | F.array_contains(F.split("class", r"\s+"), "acalog-breadcrumb") | (F.col("id") == "breadcrumb") | (F.col("aria") == "breadcrumb")
    kind = F.when(trail, 1).when(F.col("tag") == "a", 2).when(F.col("tag") == "nav", 4)
    outer = nodes.select(KEY, F.col("pre").alias("o_pre"), F.col("post").alias("o_post"), kind.alias("kind")).where("kind is not null")
    texts = contained(nodes.where("tag = '#text'"), outer, [KEY, "o_pre", "kind", "pre", "text"])
    line = F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda x: x["text"])
    each = texts.groupBy(KEY, "o_pre", "kind").agg(line.alias("texts"))
    each = each.withColumn("said", F.when(F.col("kind") == 1, F.regexp_replace(F.array_join("texts", " > "), r"(?:\s*>\s*)+", " > ")).when(F.col("kind") == 2, F.array_join("texts", " ")).otherwise(F.array_join(F.array_distinct("texts"), " > ")))
    back = F.lower("said").startswith("return to") & F.length("said").between(10, 120)
    each = each.where((F.col("kind") != 2) | back)
    first = lambda k: F.min_by("said", F.when(F.col("kind") == k, F.col("o_pre")))
    trails = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == 1, F.struct("o_pre", "said")))), lambda x: x["said"])
    found = each.groupBy(KEY).agg(F.nullif(F.array_join(F.array_distinct(trails), " | "), F.lit("")).alias("trail"), first(2).alias("link"), first(4).alias("nav"))
    # the sentence may run over several elements, so it is looked for in the whole text of pages that speak of it
    speaks = nodes.where("tag = '#text' and text like '%Return to%'").select(KEY).distinct()
    whole = joined(nodes.where("tag = '#text'"), speaks, KEY, "left_semi").groupBy(KEY).agg(F.array_join(line, " ").alias("page"))
    said = F.regexp_extract("page", r"Return to[^<:]*:?\s*([^<>{|}]{3,120})", 1)
    sentence = whole.select(KEY, F.when(said != "", F.concat(F.lit("Return to: "), F.trim(said))).alias("sentence"))
    best = F.coalesce("trail", "link", "sentence", "nav")
    return joined(found, sentence, KEY, "full").where(best.isNotNull()).select(KEY, F.substring(best, 1, most).alias("breadcrumb"))


# fixed values: how a unit of a school is named, and the elements that may name it
SCHOOL = r"\b((?:[A-Z][\w'&.-]+\s+){0,6}(?:School|College|Academy|Conservatory)(?:\s+(?:of|for)\s+[A-Z][\w'&,.\- ]{2,60})?)"
SCHOOL_TAGS = ["em", "i", "p", "a", "h2", "div"]


def metadata(nodes: DataFrame, within: int = 60) -> DataFrame:
    """(key, title, credential, school) of every page.

    The title is that of the first h1, else the page's own up to a bar or dash; the credential the field that it ends
    in; the school what the first of `within` elements with a short text names.
    """
    outer = nodes.where("tag in ('h1', 'title')").select(KEY, F.col("pre").alias("o_pre"), F.col("post").alias("o_post"), F.col("tag").alias("o_tag"))
    texts = contained(nodes.where("tag = '#text'"), outer, [KEY, "o_pre", "o_tag", "pre", "text"]).withColumn("part", F.lit(0)).groupBy(KEY, "o_pre", "o_tag").agg(_joined("pre", "part").alias("line"))
    first = lambda tag: F.min_by(F.when(F.col("o_tag") == tag, F.col("line")), F.when(F.col("o_tag") == tag, F.col("o_pre")))
    page = F.regexp_replace(F.regexp_extract(first("title"), r"^([^|–]*)", 1), r"^Program:\s*", "")
    named = texts.groupBy(KEY).agg(F.coalesce(first("h1"), F.trim(page)).alias("title"))
    titled = titles.credential(named, "title", "credential")
    # only elements with a short text are read
    named_so = F.col("tag").isin(SCHOOL_TAGS)
    size = F.length("text") + (F.col("tag") == "#text").cast("int")
    counted = nodes.select(KEY, "pre", "post", named_so.alias("some"), size.alias("size")).withColumn("nth", F.count(F.when(F.col("some"), 1)).over(running()).cast("int"))
    sized = sums(counted, {"n_chars": F.col("size")}, F.col("some") & (F.col("nth") <= within)).where(F.col("n_chars").between(1, 201))
    short = sized.select(KEY, F.col("pre").alias("o_pre"), F.col("post").alias("o_post"), "nth")
    said = contained(nodes.where("tag = '#text'"), short, [KEY, "nth", "pre", "text"]).withColumn("part", F.lit(0)).groupBy(KEY, "nth").agg(_joined("pre", "part").alias("line"))
    unit = F.regexp_replace(F.trim(F.regexp_extract("line", SCHOOL, 1)), "[,.;]+$", "")
    schools = said.withColumn("unit", unit).where(F.length("unit").between(4, 90) & ~F.lower("unit").startswith("university")).groupBy(KEY).agg(F.min_by("unit", "nth").alias("school"))
    return joined(joined(nodes.select(KEY).distinct(), titled, KEY, "left"), schools, KEY, "left")


def locators(nodes: DataFrame, most: int = 12) -> DataFrame:
    """(key, pre, path): each element's path of tags from the root, the last `most` of them, with ids and first classes.

    Paths are doubled: an element's path is that of the ancestor where its own ends, then its own, so that a few equal
    joins of the elements with themselves do, however deep a page is.
    """
    mark = F.concat("tag", F.when(F.col("id") != "", F.concat(F.lit("#"), "id")).otherwise(""), F.when(F.col("class") != "", F.concat(F.lit("."), F.split_part("class", F.lit(" "), F.lit(1)))).otherwise(""))
    paths, length = nodes.where("tag <> '#text'").select(KEY, "pre", F.col("parent").alias("up"), F.array(mark).alias("path")), 1
    while length < most:
        above = paths.select(KEY, F.col("pre").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"))
        paths = paths.join(above, [KEY, "up"], "left").select(KEY, "pre", F.coalesce("next", F.lit(-1)).alias("up"), F.when(F.col("head").isNotNull(), F.concat("head", "path")).otherwise(F.col("path")).alias("path"))
        length *= 2
    return paths.select(KEY, "pre", F.array_join(F.slice("path", -F.least(F.size("path"), F.lit(most)), F.lit(most)), " > ").alias("path"))

"""From a page to the links of one section: region, navigation, headings, boundary, links.

Each step is a DataFrame over the node table, and what can't be proven is a row with an error, never a
fallback to the whole page.  `a` holds `d` if a.pre < d.pre <= a.post, so sums over what an element
holds are differences of running sums, and an element's members are the numbers from pre + 1 to post.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.dom.regions import HEADINGS, KEY, contained, running, score, sums
from recordloom.functions import unicode, urls
from recordloom.operators.resolve import is_interface, is_program
from recordloom.sources.shared import settled

# fixed values: where content may be (label, tags, class, id, role), what is exact platform content, what is navigation
SELECTORS = [
    ("main", ["main"], None, None, None),
    ("article", ["article"], None, None, None),
    ("role=main", None, None, None, "main"),
    ("td.block_content", ["td"], "block_content", None, None),
    ("div.block_content", ["div"], "block_content", None, None),
    ("#acalog-content", None, None, "acalog-content", None),
    ("div.custom_leftpad_20", ["div"], "custom_leftpad_20", None, None),
    ("#content", None, None, "content", None),
    (".main-content", None, "main-content", None, None),
    ("body", ["body"], None, None, None),
]
PLATFORM = ["td.block_content", "div.block_content", "#acalog-content", "div.custom_leftpad_20"]
EACH, BONUS, SHARE = 4, 50.0, 0.45
ENCLOSING = ["td", "div", "main", "article"]
STRUCTURAL = ["td", "div", "section", "article", "main"]
LANDMARKS = ["nav", "aside", "header", "footer"]
NAV_ROLES = r"(?i)^(navigation|banner|contentinfo|search)$"
CHROME_ROLES = r"(?i)^(navigation|banner|contentinfo)$"
NAV_NAME = r"(?i)(?:^|\b)(nav|navbar|menu|sidebar|footer|header|breadcrumb|social|share|cookie|banner|skiplink)(?:\b|$)"
VENDOR = r"(?i)(?:^|\b)(?:acalog[-_][\w-]*heading|filter[-_]heading)(?:\b|$)"
EDGE = " \t\r\n:;·•*–—-.[]|"
WHOLE = ["body", "html"]
#: Columns of the node table that links are found by; others are neither shuffled nor written.
READ = [KEY, "pre", "post", "parent", "tag", "id", "class", "role", "level", "href", "text"]


def named(pattern: str) -> Column:
    """Whether a node's classes and id match."""
    return F.concat_ws(" ", "class", "id").rlike(pattern)


def measured(nodes: DataFrame, chrome: str = r"(?i)skip to (?:navigation|content)") -> DataFrame:
    """Nodes with what they hold: `length` of their text, link text, headings and others, and whether site furniture is among them.

    `chrome` is looked for in each text on its own.
    """
    own = F.col("tag") == "#text"
    ahead = Window.partitionBy(KEY).orderBy("pre").rowsBetween(0, Window.unboundedFollowing)
    marked = nodes.withColumn("linked", F.coalesce(F.max(F.when(F.col("tag") == "a", F.col("post"))).over(running()) >= F.col("pre"), F.lit(False)))
    marked = marked.withColumn("with_text", (F.col("tag") == "a") & F.coalesce(F.first(F.when(own, F.col("pre")), ignorenulls=True).over(ahead) <= F.col("post"), F.lit(False)))
    one = lambda c: c.cast("long")
    held = sums(marked, {
        "n_chars": F.length("text"), "n_texts": one(own), "l_chars": F.when(F.col("linked"), F.length("text")).otherwise(0), "l_texts": one(own & F.col("linked")), "l_links": one(F.col("with_text")),
        "headings": one(F.col("tag").isin(HEADINGS)), "items": one(F.col("tag") == "li"), "tables": one(F.col("tag") == "table"), "h1": one(F.col("tag") == "h1"), "core": one(F.lower("class").contains("acalog")),
        "furniture": one(F.col("tag").isin("nav", "header", "footer") | F.col("role").rlike(CHROME_ROLES) | F.col("text").rlike(chrome)),
    })
    # texts joined by one space
    return held.select(
        *nodes.columns, "headings", "items", "tables", "h1", "core", F.greatest(F.col("n_chars") + F.col("n_texts") - 1, F.lit(0)).alias("length"), (F.col("l_chars") + F.col("l_texts") - F.col("l_links")).alias("link_length"),
        (F.col("tag").isin(WHOLE) | (F.col("furniture") > 0)).alias("chrome"),
    )


def _selected(m: DataFrame) -> DataFrame:
    """(key, label, place, pre): the first elements of each selector; an id that marks a start stands for what encloses it."""
    has = lambda name: F.array_contains(F.split(F.trim("class"), r"\s+"), name)
    parts = []
    for i, (label, tags, cls, ident, role) in enumerate(SELECTORS):
        fits = F.col("tag").isin(tags) if tags else F.lit(True)
        fits = fits & has(cls) if cls else fits
        fits = fits & (F.col("id") == ident) if ident else fits
        fits = fits & (F.col("role") == role) if role else fits
        parts.append(F.when(fits, F.struct(F.lit(label).alias("label"), F.lit(i).alias("place"))))
    hit = m.select(KEY, "pre", "tag", F.explode(F.array_compact(F.array(*parts))).alias("s")).select(KEY, "pre", "tag", "s.*")
    first = hit.withColumn("k", F.row_number().over(Window.partitionBy(KEY, "place").orderBy("pre"))).where((F.col("k") <= EACH) & ((F.col("label") != "body") | (F.col("k") == 1)))
    marks = first.where((F.col("label") == "#acalog-content") & F.col("tag").isin("a", "h1", "span"))
    around = m.where(F.col("tag").isin(ENCLOSING)).select(KEY, F.col("pre").alias("o_pre"), F.col("post").alias("o_post"))
    near = contained(marks.select(KEY, "pre"), around, [KEY, "pre", "o_pre"]).groupBy(KEY, "pre").agg(F.max("o_pre").alias("near"))
    moved = (F.col("label") == "#acalog-content") & F.col("tag").isin("a", "h1", "span")
    at = F.when(moved, F.coalesce("near", "pre")).otherwise(F.col("pre"))
    return first.join(near, [KEY, "pre"], "left").select(KEY, "label", "place", at.alias("pre"))


def regions(nodes: DataFrame) -> DataFrame:
    """(key, o_pre, o_post, o_tag, label, place, tier, length, chrome, score): every candidate region, for explaining a choice.

    An element that several selectors name counts for the first of them.  Tier 1 is exact platform content,
    tier 2 is free of site furniture (blocks around the first h1 are candidates, too), tier 3 is the rest.
    """
    m = settled(measured(nodes))
    found = _selected(m)
    h1 = m.where("tag = 'h1'").groupBy(KEY).agg(F.min("pre").alias("pre"))
    blocks = m.where(F.col("tag").isin(STRUCTURAL) & ~F.col("chrome")).select(KEY, F.col("pre").alias("o_pre"), F.col("post").alias("o_post"))
    near = contained(h1, blocks, [KEY, "o_pre"]).select(KEY, F.lit("around h1").alias("label"), F.lit(len(SELECTORS)).alias("place"), F.col("o_pre").alias("pre"))
    once = found.unionByName(near).groupBy(KEY, "pre").agg(F.min(F.struct("place", "label")).alias("s"))
    rows = once.select(KEY, "pre", "s.place", "s.label").join(m, [KEY, "pre"])
    value = score(F.col("length"), F.col("link_length"), named(NAV_NAME)) + F.least("core", F.lit(50)) * 2 - F.when(F.col("tag").isin(LANDMARKS), 200).otherwise(0)
    platform = F.col("label").isin(PLATFORM)
    value = F.when(F.col("length") == 0, -1000.0).otherwise(value) + F.when(platform, BONUS).otherwise(0.0)
    tier = F.when(F.col("length") == 0, 3).when(platform, 1).when(~F.col("chrome"), 2).otherwise(3)
    return rows.select(KEY, F.col("pre").alias("o_pre"), F.col("post").alias("o_post"), F.col("tag").alias("o_tag"), "label", "place", tier.alias("tier"), "length", "chrome", value.alias("score"))


def region(candidates: DataFrame, strict: bool = False) -> DataFrame:
    """(key, o_pre, o_post, o_tag, label, tier, score, error): the best candidate of each page, ties to the earlier selector and element.

    Where `strict`, tier 1 goes before tier 2 and the rest is not taken: `error` is content_region_missing.
    """
    every = candidates if strict else candidates.where(F.col("place") < len(SELECTORS))
    taken = F.col("tier") < 3 if strict else F.lit(True)
    order = F.struct(-F.col("tier") if strict else F.lit(0), "score", -F.col("place"), -F.col("o_pre"))
    best = every.groupBy(KEY).agg(F.max_by(F.when(taken, F.struct("o_pre", "o_post", "o_tag", "label", "tier", "score")), F.when(taken, order)).alias("b"))
    return best.select(KEY, "b.*", F.when(F.col("b").isNull(), "content_region_missing").alias("error"))


def inside(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Nodes held by the chosen region of their page."""
    at = chosen.where("o_pre is not null").select(KEY, "o_pre", "o_post")
    return nodes.join(at, KEY).where((F.col("pre") > F.col("o_pre")) & (F.col("pre") <= F.col("o_post"))).select(nodes.columns)


def navigation_free(nodes: DataFrame) -> DataFrame:
    """A region's nodes outside of landmarks, roles and names of navigation that hold at most 45% of its text, each judged on the input."""
    whole = F.sum(F.length("text") + (F.col("tag") == "#text").cast("int")).over(Window.partitionBy(KEY)) - 1
    held = sums(nodes.withColumn("whole", whole), {"n_chars": F.length("text"), "n_texts": (F.col("tag") == "#text").cast("long")})
    nav = F.col("tag").isin(LANDMARKS) | F.col("role").rlike(NAV_ROLES) | named(NAV_NAME)
    share = F.greatest(F.col("n_chars") + F.col("n_texts") - 1, F.lit(0)) / F.greatest("whole", F.lit(1))
    ends = held.withColumn("until", F.max(F.when(nav & (share <= SHARE), F.col("post"))).over(running()))
    return ends.where(F.col("until").isNull() | (F.col("pre") > F.col("until"))).select(nodes.columns)


def signals(nodes: DataFrame) -> DataFrame:
    """(key, o_pre, o_post, heading, form, hl, source): headings by tag, by role and by class; where a page has none, labels all in bold.

    A class counts on short texts without a bar.  A label is a paragraph, cell or block whose one child is bold.
    """
    text = nodes.where("tag = '#text'")
    native, by_role = F.col("tag").isin(HEADINGS), F.lower("role") == "heading"
    by_class = F.col("tag").isin("p", "div", "td", "span") & F.col("class").rlike(VENDOR)
    source = F.when(native, "native").when(by_role, "role").when(by_class, "class")
    level = F.when(native, F.substring("tag", 2, 1).cast("int")).when(by_role, F.coalesce(F.col("level").try_cast("int"), F.lit(2))).otherwise(2)
    found = nodes.select(KEY, F.col("pre").alias("o_pre"), F.col("post").alias("o_post"), level.alias("hl"), source.alias("source")).where("source is not null")
    children = nodes.groupBy(KEY, F.col("parent").alias("o_pre")).agg(F.count("*").alias("n"), F.count_if(F.col("tag").isin("strong", "b")).alias("bold")).where("n = 1 and bold = 1")
    labels = nodes.where("tag in ('p', 'td', 'div')").select(KEY, F.col("pre").alias("o_pre"), F.col("post").alias("o_post"), F.lit(3).alias("hl"), F.lit("label").alias("source")).join(children.select(KEY, "o_pre"), [KEY, "o_pre"])
    every = found.unionByName(labels.select(found.columns))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda x: x["text"]), " ")
    heads = contained(text, every, [KEY, "o_pre", "o_post", "hl", "source", "pre", "text"]).groupBy(KEY, "o_pre", "o_post", "hl", "source").agg(line.alias("heading"))
    long = F.length("heading")
    heads = heads.where((F.col("source") != "class") | ((long <= 60) & ~F.contains("heading", F.lit("|")))).where((F.col("source") != "label") | (long <= 80))
    plain = F.bool_or(F.col("source") != "label").over(Window.partitionBy(KEY))
    kept = heads.withColumn("plain", plain).where("not plain or source <> 'label'")
    return kept.select(KEY, "o_pre", "o_post", "heading", F.btrim(unicode.heading_form(F.col("heading")), F.lit(EDGE)).alias("form"), "hl", "source")


def boundary(nodes: DataFrame, chosen: DataFrame, wanted: Column) -> DataFrame:
    """(key, heading, hl, source, o_pre, o_post, stop, stop_heading, ended_by, container, error): the first wanted section of each region.

    `wanted` is over `form`.  A section ends at the next heading of its level or above; classes end sections
    that classes or labels began, labels those that labels began, tags and roles any.  The end of a region
    ends it too, but not the end of a whole page: then, or if no heading is wanted, `error` is boundary_not_provable.
    """
    heads = settled(signals(nodes))
    start = heads.where(wanted).groupBy(KEY).agg(F.min_by(F.struct("o_pre", "o_post", "heading", "hl", "source"), "o_pre").alias("s"))
    later = heads.join(start, KEY).where((F.col("o_pre") > F.col("s.o_post")) & (F.col("hl") <= F.col("s.hl")))
    ends = F.col("source").isin("native", "role") | ((F.col("source") == "class") & F.col("s.source").isin("class", "label")) | ((F.col("source") == "label") & (F.col("s.source") == "label"))
    stop = later.where(ends).groupBy(KEY).agg(F.min_by(F.struct(F.col("o_pre").alias("stop"), F.col("heading").alias("stop_heading")), "o_pre").alias("e"))
    rows = chosen.select(KEY, F.col("o_tag").alias("container"), F.col("error").alias("missing")).join(start, KEY, "left").join(stop, KEY, "left")
    unproven = F.col("s").isNull() | (F.col("e").isNull() & F.col("container").isin(WHOLE))
    ended = F.when(F.col("s").isNotNull(), F.when(F.col("e").isNotNull(), "heading").otherwise("container"))
    return rows.select(
        KEY, "s.heading", "s.hl", "s.source", "s.o_pre", "s.o_post", "e.stop", "e.stop_heading", ended.alias("ended_by"), "container",
        F.coalesce("missing", F.when(unproven, "boundary_not_provable")).alias("error"),
    )


def anchors(nodes: DataFrame, section: DataFrame) -> DataFrame:
    """(key, pos, href, title): links with an href in a proven section; one that wraps the heading at its end belongs to the next."""
    at = section.where("error is null").select(KEY, F.col("o_post").alias("from"), "stop")
    a = nodes.where("tag = 'a' and href <> ''").select(KEY, F.col("pre").alias("o_pre"), F.col("post").alias("o_post"), F.col("href").alias("target")).join(at, KEY)
    a = a.where((F.col("o_pre") > F.col("from")) & (F.col("stop").isNull() | (F.col("o_post") < F.col("stop")))).drop("from", "stop")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda x: x["text"]), " ")
    texts = contained(nodes.where("tag = '#text'"), a, [KEY, "o_pre", "pre", "text"]).groupBy(KEY, "o_pre").agg(line.alias("title"))
    return a.join(texts, [KEY, "o_pre"], "left").select(KEY, F.col("o_pre").alias("pos"), F.col("target").alias("href"), F.coalesce("title", F.lit("")).alias("title"))


def discover(nodes: DataFrame, pages: DataFrame, wanted: Column, path: str = "preview_program.php", ids: tuple[str, ...] = ("catoid", "poid")) -> tuple[DataFrame, DataFrame]:
    """The links of the wanted section (key, seq, title, canonical and the ids), and the section of every page with `n_links` and `duplicates`.

    `pages` has the key and `url`, against which links are resolved.  Each set of ids, and each canonical url, counts once.
    """
    nodes = nodes.select(*READ)
    chosen = settled(pages.select(KEY).join(region(regions(nodes)), KEY, "left").withColumn("error", F.when(F.col("o_pre").isNull(), "content_region_missing")))
    clean = settled(navigation_free(inside(nodes, chosen)))
    section = settled(boundary(clean, chosen, wanted))
    found = anchors(clean, section).where(~is_interface(F.col("href"))).join(pages.select(KEY, "url"), KEY)
    found = found.withColumn("whole", unicode.resolve(F.col("url"), F.trim("href"))).where(is_program(F.col("whole"), path, ids))
    rows = found.select(KEY, "pos", "title", urls.canonical(F.col("whole")).alias("canonical"), *[urls.parameter(F.col("whole"), p).alias(p) for p in ids])
    kept = settled(rows)
    keep = kept
    for names in ([*ids], ["canonical"]):
        if names:
            keep = keep.withColumn("nth", F.row_number().over(Window.partitionBy(KEY, *names).orderBy("pos"))).where("nth = 1").drop("nth")
    links = keep.withColumn("seq", F.row_number().over(Window.partitionBy(KEY).orderBy("pos"))).select(KEY, "seq", "title", "canonical", *ids)
    counts = kept.groupBy(KEY).agg(F.count("*").alias("every")).join(keep.groupBy(KEY).agg(F.count("*").alias("n_links")), KEY, "left")
    total = lambda c: F.coalesce(c, F.lit(0))
    report = section.join(counts, KEY, "left").select(section.columns + [total(F.col("n_links")).alias("n_links"), (total(F.col("every")) - total(F.col("n_links"))).alias("duplicates")])
    return links, report

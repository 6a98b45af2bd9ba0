"""What is no content of a page: elements by selectors, then small ones that are named like navigation.

Selectors are expressions over a node's own columns (tag, class, id, attribute with a value, attribute with a
substring), so that no node is exploded, joined or shuffled to see which fits.  What may be noise is settled: few rows a
page.  Whatever lies within a removed element goes with it: intervals nest, so the furthest end so far tells.
"""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.dom.regions import HEADINGS, KEY, joined, running, sums
from recordloom.sources.shared import settled

# fixed values: the selectors of noise, in their order, and names of navigation
SELECTORS = [
    "script", "style", "noscript", "template", "iframe", "form", "nav", "header", "footer", "[role=navigation]", "[role=banner]", "[role=contentinfo]", "[role=search]",
    "a[href*='portfolio.php']", "a[href*='portfolio_nopop.php']", "a[href*='print_degree_planner']", ".acalog-portfolio", ".social-media", ".skip-link", "#skip-link",
    ".breadcrumb", ".breadcrumbs", ".acalog-breadcrumb", "#cookie-banner", ".cookie-notice", ".noprint_pdf", ".gateway-toolbar", ".acalog-icon", ".acalog_catalog_name",
]
NAV_NAME = r"(?i)(?:^|\b)(nav|navbar|menu|sidebar|footer|header|breadcrumb|social|share|cookie|banner|skiplink)(?:\b|$)"
SPEAKS_OF_COURSES = r"(?i)\b(unit|course|requirement)\b"
#: Characters from which an element that is named like navigation counts as content.
LEAST_CONTENT = 400
NAMED = "named like navigation"
#: The attributes of a node that selectors may ask for, by their names in the node table.
ATTRIBUTES = {"id": "id", "class": "class", "role": "role", "href": "href", "aria-label": "aria"}


def parsed(selector: str) -> tuple[str, str, str, str, str]:
    """(selector, tag, attribute, kind, value); the kind is `is`, `has` (a word) or `holds` (a substring), or empty for a tag alone."""
    m = re.fullmatch(r"""(?P<tag>[\w-]*)(?:\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[(?P<attr>[\w-]+)(?P<op>\*?=)['"]?(?P<value>[^'"\]]*)['"]?\])?""", selector)
    if not m or not selector or (m["attr"] and m["attr"] not in ATTRIBUTES):
        raise ValueError(f"selector {selector!r} is not supported")
    if m["cls"]:
        return selector, m["tag"], "class", "has", m["cls"]
    if m["id"]:
        return selector, m["tag"], "id", "is", m["id"]
    if m["attr"]:
        return selector, m["tag"], m["attr"], "is" if m["op"] == "=" else "holds", m["value"]
    return selector, m["tag"], "", "", ""


def read(selectors: list[str] = SELECTORS) -> list[str]:
    """The columns of the node table that noise is found by."""
    asked = {ATTRIBUTES[attr] for _, _, attr, _, _ in map(parsed, selectors) if attr}
    return ["pre", "post", "tag", "raw", *sorted(asked | {"id", "class"})]


def fits(selector: str) -> Column:
    """Whether a node, which is no text, fits a selector."""
    _, tag, attr, kind, value = parsed(selector)
    rules = [F.col("tag") == tag] if tag else []
    if kind:
        c = F.col(ATTRIBUTES[attr])
        # the empty value and the empty substring are those of nodes without the attribute
        rules += [c != "", F.array_contains(F.split(c, r"\s+"), value) if kind == "has" else c.contains(value) if kind == "holds" else c == value]
    return reduce(lambda x, y: x & y, rules)


def first_fit(selectors: list[str] = SELECTORS) -> Column:
    """The place of the first selector that a node fits, else null."""
    return F.coalesce(*[F.when(fits(s), F.lit(k)) for k, s in enumerate(selectors)], F.lit(None).cast("int"))


def may_fit(selectors: list[str] = SELECTORS) -> Column:
    """Whether a node is no text and has a tag or an attribute that selectors or names ask for: few have, and only they are looked at closely."""
    tags = [tag for _, tag, attr, _, _ in map(parsed, selectors) if not attr]
    return (F.col("tag") != "#text") & reduce(lambda x, y: x | y, [F.col(c) != "" for c in read(selectors)[4:]], F.col("tag").isin(tags))


def marked(nodes: DataFrame, removed: DataFrame) -> DataFrame:
    """Nodes with `is_noise`: whether they are in `removed` (key, pre, post) or within one of these.

    What is removed goes along as rows of its own, before the node that it is, so that nodes are shuffled once, by page.
    """
    gone = removed.select(KEY, "pre", F.col("post").alias("gone_to"))
    both = nodes.withColumn("gone_to", F.lit(None).cast("int")).unionByName(gone, allowMissingColumns=True)
    upto = Window.partitionBy(KEY).orderBy("pre", F.col("gone_to").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    ends = both.withColumn("noise_end", F.max("gone_to").over(upto)).where("gone_to is null")
    return ends.withColumn("is_noise", F.coalesce(F.col("pre") <= F.col("noise_end"), F.lit(False))).select(*nodes.columns, "is_noise")


def outside(nodes: DataFrame, removed: DataFrame) -> DataFrame:
    """Nodes that are neither in `removed` (key, pre, post) nor within one of these."""
    return marked(nodes, removed).where("not is_noise").drop("is_noise")


def _name() -> Column:
    return F.concat_ws(" ", "class", "id")


def _is_named() -> Column:
    return (F.col("tag") != "#text") & (F.trim(_name()) != "") & _name().rlike(NAV_NAME)


def named(nodes: DataFrame, removed: DataFrame) -> DataFrame:
    """(key, pre, post) of elements that are named like navigation and, without what is `removed`, hold no heading, little text and no word of courses."""
    text = (F.col("tag") == "#text") & ~F.col("is_noise")
    size = F.length(F.regexp_replace("raw", r"^\s+|\s+$", ""))
    head = F.col("tag").isin(HEADINGS) & ~F.col("is_noise")
    # sums need whole subtrees, so what is removed stays and counts nothing
    all_of = marked(nodes.select(KEY, "pre", "post", "tag", "id", "class", "raw"), removed)
    measures = {"n_chars": F.when(text, size + 1).otherwise(0), "n_heads": head.cast("long"), "n_courses": (text & F.col("raw").rlike(SPEAKS_OF_COURSES)).cast("long")}
    narrow = all_of.select(KEY, "pre", "post", (~F.col("is_noise") & _is_named()).alias("open"), *[c.alias(f"own_{m}") for m, c in measures.items()])
    held = sums(narrow, {m: F.col(f"own_{m}") for m in measures}, F.col("open"))
    return held.where((F.col("n_heads") == 0) & (F.col("n_chars") - 1 < LEAST_CONTENT) & (F.col("n_courses") == 0)).select(KEY, "pre", "post")


def noise(nodes: DataFrame, selectors: list[str] = SELECTORS) -> DataFrame:
    """(key, pre, post, selector): every element that is noise by itself, with the first selector that fits, or as named like navigation."""
    # settled, as the names are looked for among what the selectors leave
    some = settled(nodes.where(may_fit(selectors)).select(KEY, "pre", "post", first_fit(selectors).alias("fit"), _is_named().alias("named")).where("fit is not null or named"))
    known = F.array(*[F.lit(s) for s in selectors]).cast("array<string>")
    first = some.where("fit is not null").groupBy(KEY, "pre", "post").agg(F.get(known, F.min("fit")).alias("selector"))
    # pages are read again only where a name is left to judge
    end = F.max(F.when(F.col("fit").isNotNull(), F.col("post"))).over(running())
    left = settled(some.withColumn("noise_end", end).where(F.col("named") & ~F.coalesce(F.col("pre") <= F.col("noise_end"), F.lit(False))).select(KEY).distinct())
    if left.isEmpty():
        return first
    return first.unionByName(named(joined(nodes, left, KEY, "left_semi"), joined(first, left, KEY, "left_semi")).withColumn("selector", F.lit(NAMED)))


def cleaned(nodes: DataFrame, selectors: list[str] = SELECTORS) -> DataFrame:
    """Nodes that are not noise."""
    return outside(nodes, noise(nodes, selectors))

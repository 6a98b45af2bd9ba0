"""Editions, navigation targets and programme links, from node tables of pages."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.dom.regions import KEY, contained
from recordloom.functions import codes, urls

# fixed values: hrefs and paths that belong to the interface
INTERFACE_PREFIXES = ["#", "javascript:", "mailto:", "tel:"]
INTERFACE_PATHS = ["portfolio.php", "portfolio_nopop.php", "print_degree_planner"]


def anchors(nodes: DataFrame) -> DataFrame:
    """(key, pos, href, title, around): links with their text and the text of their parent, in order."""
    a = nodes.where("tag = 'a'").select(KEY, F.col("pre").alias("o_pre"), F.col("post").alias("o_post"), F.col("href").alias("target"), F.col("parent").alias("above"))
    joined = lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda x: x["text"]), " ")
    text = nodes.where("tag = '#text'")
    own = contained(text, a, [KEY, "o_pre", "pre", "text"]).groupBy(KEY, "o_pre").agg(joined().alias("title"))
    parents = nodes.select(KEY, F.col("pre").alias("above"), F.col("pre").alias("p_pre"), F.col("post").alias("p_post")).join(a.select(KEY, "above", F.col("o_pre").alias("at")), [KEY, "above"])
    outer = parents.select(KEY, "at", F.col("p_pre").alias("o_pre"), F.col("p_post").alias("o_post"))
    around = contained(text, outer, [KEY, "at", "pre", "text"]).groupBy(KEY, F.col("at").alias("o_pre")).agg(joined().alias("around"))
    rows = a.join(own, [KEY, "o_pre"], "left").join(around, [KEY, "o_pre"], "left")
    none = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select(KEY, F.col("o_pre").alias("pos"), F.col("target").alias("href"), none("title"), none("around"))


def editions(links: DataFrame, parameter: str = "catoid") -> DataFrame:
    """(key, edition, year, archived): list entries that name a catalogue, each edition once, the first of its titles; archived is sticky."""
    e = urls.parameter(F.col("href"), parameter)
    named = links.where(F.lower("title").rlike("catalog") & F.col("href").contains("index.php")).select(KEY, "pos", e.alias("edition"), codes.year_range(F.col("title")).alias("year"), F.lower("around").contains("archived").alias("old")).where("edition is not null")
    return named.groupBy(KEY, "edition").agg(F.min_by("year", "pos").alias("year"), F.bool_or("old").alias("archived"))


def years(links: DataFrame, parameter: str = "catoid") -> DataFrame:
    """(key, year, edition, archived): the first edition of each year."""
    e = editions(links, parameter).where("year is not null")
    return e.groupBy(KEY, "year").agg(F.min_by("edition", F.col("edition").try_cast("long")).alias("edition"), F.bool_or("archived").alias("archived"))


def current(editions: DataFrame) -> DataFrame:
    """The newest edition of each page that has a year and is not archived."""
    newest = editions.where("year is not null and not archived").groupBy(KEY).agg(F.max_by(F.struct("edition", "year"), F.substring("year", 1, 4).cast("int")).alias("c"))
    return newest.select(KEY, "c.edition", "c.year")


def navigation(links: DataFrame, target: str, edition: Column, parameter: str = "catoid", wanted: str = "navoid") -> DataFrame:
    """(key, id) of the navigation entry named `target`, else of one that starts with it, within the edition."""
    low = F.lower("title")
    place = F.when(low == target.lower(), 0).when(low.startswith(target.lower()), 1)
    rows = links.where(urls.parameter(F.col("href"), parameter) == edition).select(KEY, "pos", place.alias("p"), urls.parameter(F.col("href"), wanted).alias("id"))
    return rows.where("p is not null and id is not null").groupBy(KEY).agg(F.min_by("id", F.struct("p", "pos")).alias("id"))


def same_page(requested: Column, final: Column, names: list[str]) -> Column:
    """Whether the ids of the final url are those requested; an absent one counts as another."""
    out = F.lit(True)
    for n in names:
        out = out & F.coalesce(urls.parameter(final, n) == urls.parameter(requested, n), F.lit(False))
    return out


def is_interface(href: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(href, F.lit(""))))
    path = urls.part(low, 3)
    hit = low == ""
    for p in INTERFACE_PREFIXES:
        hit = hit | low.startswith(p)
    for p in INTERFACE_PATHS:
        hit = hit | path.contains(p)
    return hit


def is_program(href: Column, path: str = "preview_program.php", needed: tuple[str, ...] = ("catoid", "poid")) -> Column:
    out = urls.part(href, 3).contains(path)
    for n in needed:
        out = out & (F.coalesce(urls.parameter(href, n), F.lit("")) != "")
    return out


def program_links(links: DataFrame, path: str = "preview_program.php") -> tuple[DataFrame, DataFrame]:
    """Programme links numbered in order, each id pair and each canonical url once; and (key, duplicates)."""
    rows = links.where(~is_interface(F.col("href")) & is_program(F.col("href"), path)).select(
        KEY, "pos", "title", "href", urls.canonical(F.col("href")).alias("canonical"), urls.parameter(F.col("href"), "catoid").alias("catoid"), urls.parameter(F.col("href"), "poid").alias("poid")
    )
    first = F.row_number().over(Window.partitionBy(KEY, "catoid", "poid").orderBy("pos")) == 1
    kept = rows.withColumn("__f", first).where("__f").drop("__f")
    kept = kept.withColumn("__f", F.row_number().over(Window.partitionBy(KEY, "canonical").orderBy("pos")) == 1).where("__f").drop("__f")
    numbered = kept.withColumn("seq", F.row_number().over(Window.partitionBy(KEY).orderBy("pos")))
    counts = rows.groupBy(KEY).agg(F.count("*").alias("all")).join(kept.groupBy(KEY).agg(F.count("*").alias("kept")), KEY)
    return numbered, counts.select(KEY, (F.col("all") - F.col("kept")).alias("duplicates"))

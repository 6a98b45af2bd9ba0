"""Web pages as columns: features, challenge detection, semantic checks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import text as tx

# fixed values: marks of pages that ask for a human
TEXT_MARKS = ["javascript is disabled", "verify that you are not a robot", "just a moment", "checking your browser", "verify you are human", "verifying you are human", "enable javascript and cookies to continue", "pardon our interruption", "request unsuccessful", "access denied", "press & hold", "captcha"]
TITLE_MARKS = ["just a moment", "attention required", "access denied", "human verification", "security check"]
SCRIPT_MARKS = ["challenge-platform", "cf-chl", "cf_chl_opt", "_incapsula_resource", "incapsula", "px-captcha", "perimeterx", "datadome", "hcaptcha.com", "recaptcha/api.js", "turnstile", "queue-it", "awswaf", "token.awswaf"]
SIGNALS = ["unit", "requirement", "course", "major", "degree"]
LONG_PAGE = 3500


def marks(c: Column, words: list[str]) -> Column:
    """Which of the words a lower-cased text holds."""
    return F.array_compact(F.array(*[F.when(c.contains(w), F.lit(w)) for w in words]))


def challenged(rows: DataFrame, html: str = "html", out: str = "challenge") -> DataFrame:
    """`rows` with a struct (challenged, evidence): marks in title or scripts decide; marks in the text do on a short page, or if there are two.

    The page is lower-cased once, as a column of its own, before it is searched for every mark.
    """
    h = F.coalesce(F.col(html), F.lit(""))
    noscript = F.col("__low").contains("<noscript")
    made = rows.withColumn("__low", F.lower(h)).withColumn("__body", F.when(noscript, F.lower(F.regexp_replace(h, r"(?is)<noscript[^>]*>.*?</noscript>", " "))).otherwise(F.col("__low"))).withColumn("__title", F.lower(tx.title_of(h)))
    found = {"__t": marks(F.col("__title"), TITLE_MARKS), "__s": marks(F.col("__low"), SCRIPT_MARKS), "__b": marks(F.col("__body"), TEXT_MARKS)}
    made = made.withColumns(found)
    strong = (F.size("__t") > 0) | (F.size("__s") > 0)
    # what is shown is only measured where it decides
    weak = F.when(F.size("__b") == 1, F.length(tx.visible_text(h, keep_noscript=True)) < LONG_PAGE).otherwise(F.size("__b") >= 2)
    tag = lambda name, a: F.transform(a, lambda m: F.concat(F.lit(name + ":"), m))
    value = F.struct((strong | weak).alias("challenged"), F.concat(tag("title", "__t"), tag("body", "__b"), tag("script", "__s")).alias("evidence"))
    return made.withColumn(out, value).drop("__low", "__body", "__title", *found)


def signal_count(text: Column) -> Column:
    low = F.lower(text)
    return sum((low.contains(s).cast("int") for s in SIGNALS), F.lit(0))


def semantic_ok(kind: Column, html: Column, links: Column, context: Column) -> Column:
    """Whether a page of a kind has what its kind needs: index, program, or home and list."""
    text = tx.visible_text(F.coalesce(html, F.lit("")))
    size = F.length(text)
    titled = html.rlike(r"(?i)<h1[^>]*>\s*\S") | html.contains("Program:")
    return (
        F.when(kind == "index", (size >= 1500) & context & (links >= 5))
        .when(kind == "program", (size >= 700) & titled & (signal_count(text) >= 2))
        .when(kind.isin("home", "list"), (size >= 400) & F.lower(text).rlike("catalog"))
        .otherwise(False)
    )


def acquisition_mode(error: Column, challenged: Column, valid: Column, status: Column) -> Column:
    return F.when(error.isNotNull(), "network_failure").when(challenged, "challenge").when(valid & (status == 200), "direct").otherwise("invalid")


def link_count(html: Column, pattern: str) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pattern), F.lit(0))))


def ready(html: Column, text: Column, least: int = 400) -> Column:
    """Whether a program page has loaded: a title, enough text, and units if it links to courses."""
    courses = html.contains("preview_course") | html.contains("showCourse")
    return html.rlike(r"(?i)<h1[\s>]") & (F.length(text) > least) & (~courses | text.rlike(r"Units?:\s*\d"))

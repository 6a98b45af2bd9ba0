"""Text expressions that Catalyst runs without Python."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(c: Column) -> Column:
    """Runs of white space, no-break spaces included, as one space; ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def folded(c: Column) -> Column:
    """The form in which sentences and bodies are compared: collapsed, and without case as far as lower case and sharp s go.

    `unicode.casefold` folds the rest too, in Python; this stays in the JVM, as whole texts pass through it.
    """
    return F.replace(F.lower(collapse(c)), F.lit("ß"), F.lit("ss"))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def strip_newlines(c: Column) -> Column:
    return F.btrim(c, F.lit("\n"))


def strip_footnotes(c: Column) -> Column:
    """Without trailing footnote marks."""
    return strip(F.regexp_replace(c, r"[\s*†‡+^]+$", ""))


def slug(c: Column) -> Column:
    """Only lower-case letters and digits."""
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "")


def file_slug(c: Column, size: int = 70) -> Column:
    """Lower-case words joined by underscores, cut to `size`; `program` if nothing is left."""
    s = F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_")
    s = F.regexp_replace(F.substring(F.regexp_replace(s, r"^_+|_+$", ""), 1, size), r"_+$", "")
    return F.when(s == "", "program").otherwise(s)


def sentences(c: Column) -> Column:
    """Trimmed sentences: cut after . ! or ? where white space follows."""
    marked = F.regexp_replace(c, r"([.!?])\s+", "$1\u0001")
    return F.transform(F.split(marked, "\u0001"), strip)


def body_hash(c: Column) -> Column:
    """SHA-256 of the compared form."""
    return F.sha2(folded(c), 256)


def title_of(html: Column) -> Column:
    return collapse(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def visible_text(html: Column, keep_noscript: bool = False) -> Column:
    """Text outside of tags, scripts and styles."""
    hidden = "script|style" if keep_noscript else "script|style|noscript"
    out = html
    for tag in hidden.split("|"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    return collapse(F.regexp_replace(out, r"(?s)<[^>]+>", " "))


def excerpt(c: Column, pattern: str, around: int = 50, mark: str = "¶") -> Column:
    """The first hit with its surroundings, newlines shown as a mark; null without a hit."""
    at = F.regexp_instr(c, F.lit(pattern))
    size = F.length(F.regexp_extract(c, pattern, 0))
    start = F.greatest(F.lit(1), at - around)
    cut = F.substring(c, start, at - start + size + around)
    return F.when(at > 0, F.regexp_replace(cut, r"\n", mark))

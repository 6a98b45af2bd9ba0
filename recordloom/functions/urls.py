"""URL expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: parameters that never tell pages apart
DROPPED = ["returnto", "print", "hl", "expand", "ref"]
DROPPED_PREFIXES = ["utm_", "fb", "gclid"]
URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def part(url: Column, k: int) -> Column:
    """Scheme 1, host 2, path 3 or query 4; empty where absent."""
    return F.coalesce(F.regexp_extract(url, URL, k), F.lit(""))


def parameters(url: Column) -> Column:
    """(key, value) in order, blanks kept; the last of equal keys wins."""
    pairs = F.filter(F.split(part(url, 4), "&"), lambda p: p != "")
    made = F.transform(pairs, lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), F.regexp_extract(p, r"^[^=]*=?(.*)$", 1).alias("v")))
    return F.filter(made, lambda e, i: ~F.exists(F.slice(made, i + 2, F.greatest(F.size(made) - i - 1, F.lit(0))), lambda later: later["k"] == e["k"]))


def parameter(url: Column, name: str) -> Column:
    return F.try_element_at(F.transform(F.filter(parameters(url), lambda e: e["k"] == name), lambda e: e["v"]), F.lit(1))


def canonical(url: Column, dropped: list[str] = DROPPED, prefixes: list[str] = DROPPED_PREFIXES) -> Column:
    """https for http, host in lower case, no fragment, tracking parameters dropped, the others sorted."""
    noise = lambda e: e["k"].isin(dropped) | e["k"].rlike("^(?:" + "|".join(prefixes) + ")")
    kept = F.array_sort(F.filter(parameters(url), lambda e: ~noise(e)))
    query = F.array_join(F.transform(kept, lambda e: F.concat(e["k"], F.lit("="), e["v"])), "&")
    scheme = F.when(F.lower(part(url, 1)).isin("http", "https", ""), "https").otherwise(F.lower(part(url, 1)))
    return F.concat(scheme, F.lit("://"), F.lower(part(url, 2)), part(url, 3), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def disallowed(url: Column, policies: list[str]) -> Column:
    """Whether the path starts with a policy, or holds a directory policy anywhere."""
    path = part(url, 3)
    hit = F.lit(False)
    for p in policies:
        hit = hit | path.startswith(p) | (path.contains(p) if p.endswith("/") else F.lit(False))
    return hit


def print_view(url: Column) -> Column:
    """The url with a `print` flag, as it is if it has one."""
    query = part(url, 4)
    flagged = F.concat(F.regexp_replace(url, "#.*$", ""), F.when(query == "", "?").otherwise("&"), F.lit("print"))
    return F.when(query.contains("print"), url).otherwise(flagged)


def last_number(url: Column) -> Column:
    """The number that is a path's last segment; null without one."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"/(\d+)(?:[?#]|$)", 1).try_cast("long")

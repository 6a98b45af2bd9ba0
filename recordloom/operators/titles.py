"""Rule-based classification of programme titles, with modes and reconciliation."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import text as tx

# fixed values: credential vocabularies, matched as whole tokens in exact case
UNDERGRADUATE = ["BA", "BS", "BFA", "BM", "BMus", "BArch", "BLA", "BSW", "BCA"]
GRADUATE = ["MA", "MS", "MBA", "MAcc", "MFA", "MM", "MPA", "MPH", "MPP", "MUP", "MRED", "MAT", "MSW", "MHA", "MCG", "LLM", "EdD", "PhD", "DMA", "DSW", "DPT", "DNP", "OTD", "AuD", "DrPH", "JD", "PharmD", "DDS", "MD"]
DOCTORAL = ["PhD", "EdD", "DMA", "DSW", "DNP", "OTD", "AuD", "DrPH"]
PROFESSIONAL = ["JD", "LLM", "PharmD", "DDS", "MD", "DPT"]
UNDERGRADUATE_PHRASE = r"bachelor of [a-z][a-z ]+|bachelor's degree"
GRADUATE_PHRASE = r"master of [a-z][a-z ]+|master's degree|doctor of [a-z][a-z ]+|doctorate|juris doctor|graduate certificate"
MINOR = r"\bminor\b\s*$|\bminor in\b"
# class, pattern over title and label; in the order of the tests after the minor test
NAMED = [
    ("excluded_certificate", r"\bcertificate\b"),
    ("excluded_joint", r"\bjoint degree\b|\bjoint (?:ba|bs|ma|ms|jd|mba)\b"),
    ("excluded_dual", r"\bdual degree\b|\bdual-degree\b"),
    ("excluded_combined", r"\bcombined (?:bachelor|undergraduate).{0,40}(?:master|graduate)\b|\bcombined degree\b|\b(?:bachelor|ba|bs)\s*(?:/|\+|and)\s*(?:master|ma|ms|mba)\b"),
    ("excluded_non_degree", r"\bnon-degree\b|\bpre-professional emphasis\b"),
]
TAIL_GROUPS = r"((?:\s*\([^()]*\)[\s*†‡+^]*)+)$"
SPLIT = r"(?i)\s+and\s+|[\s/,+&]+"


def normal(c: Column) -> Column:
    """Common entities decoded, plain apostrophes, collapsed white space."""
    for entity, sign in (("&rsquo;", "'"), ("&#39;", "'"), ("&quot;", '"'), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return tx.collapse(F.translate(c, "’", "'"))


def tokens(field: Column, vocabulary: list[str]) -> Column:
    """Tokens of a field that are in a vocabulary."""
    cut = F.transform(F.split(field, SPLIT), lambda t: F.regexp_replace(t, r"^[ .:;()\[\]]+|[ .:;()\[\]]+$", ""))
    return F.filter(cut, lambda t: t.isin(vocabulary))


def _phrase(field: Column, pattern: str) -> Column:
    return F.filter(F.array(F.regexp_extract(F.lower(field), pattern, 0)), lambda p: p != "")


def found(field: Column, vocabulary: list[str], pattern: str) -> Column:
    return F.concat(_phrase(field, pattern), tokens(field, vocabulary))


def _fields(out: DataFrame) -> DataFrame:
    """Rows of a normal title `__t` with its `__plain` form, its `__base` without fields, and the `__fields` that name credentials."""
    plain = tx.strip_footnotes(F.col("__t"))
    tail = F.regexp_extract(F.col("__t"), TAIL_GROUPS, 1)
    inside = lambda c, p: F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(1)), lambda x: F.trim(x))
    out = out.withColumns({"__plain": plain, "__base": tx.strip_footnotes(F.regexp_replace(F.col("__t"), TAIL_GROUPS, "")), "__ends": F.reverse(inside(tail, r"\(([^()]*)\)")), "__all": inside(plain, r"\(([^()]{1,40})\)")})
    has = lambda g: (F.size(found(g, UNDERGRADUATE, UNDERGRADUATE_PHRASE)) > 0) | (F.size(found(g, GRADUATE, GRADUATE_PHRASE)) > 0)
    comma = F.when(F.col("__plain").contains(",") & ~F.col("__plain").endswith(")"), F.trim(F.regexp_extract("__plain", r",([^,]*)$", 1)))
    comma = F.filter(F.array(F.coalesce(comma, F.lit(""))), has)
    ends, every = F.filter("__ends", has), F.filter("__all", has)
    fields = F.concat(F.when(F.size(ends) > 0, F.slice(ends, 1, 1)).otherwise(comma), F.when(F.size(every) > 0, every).otherwise(comma))
    out = out.withColumns({"__fields": fields, "__base": F.when((F.size(ends) == 0) & (F.size(comma) > 0), F.trim(F.regexp_replace("__plain", r",[^,]*$", ""))).when(F.size(ends) == 0, F.col("__plain")).otherwise(F.col("__base"))})
    return out


def credential(rows: DataFrame, title: str, out: str) -> DataFrame:
    """`rows` with the credential field that a title ends in: the rightmost bracketed group that names one, else what follows its last comma, else empty."""
    fields = _fields(rows.withColumn("__t", normal(F.coalesce(F.col(title), F.lit("")))))
    field = F.coalesce(F.try_element_at("__fields", F.lit(1)), F.lit(""))
    return fields.withColumn(out, F.when(F.col(title).isNotNull(), field)).drop(*[c for c in fields.columns if c.startswith("__")])


def classify(rows: DataFrame, title: str = "title", label: str = "label") -> DataFrame:
    """`rows` with ug, grad (credentials found), class and confident."""
    t, lab = normal(F.coalesce(F.col(title), F.lit(""))), normal(F.coalesce(F.col(label), F.lit("")))
    out = rows.withColumns({"__t": t, "__l": lab})
    out = _fields(out)
    collect = lambda v, p: F.array_distinct(F.flatten(F.transform("__fields", lambda f: found(f, v, p))))
    out = out.withColumns({"ug": collect(UNDERGRADUATE, UNDERGRADUATE_PHRASE), "grad": collect(GRADUATE, GRADUATE_PHRASE)})
    low = F.lower(F.concat_ws(" | ", F.nullif(F.col("__t"), F.lit("")), F.nullif(F.col("__l"), F.lit(""))))
    title_low = F.lower("__t")
    up, gp = F.regexp_extract(title_low, UNDERGRADUATE_PHRASE, 0), F.regexp_extract(title_low, GRADUATE_PHRASE, 0)
    among = lambda v: F.exists("grad", lambda g: g.isin(v))
    doctoral = among(DOCTORAL) | F.exists("grad", lambda g: F.lower(g).contains("doctor"))
    verdict = F.when(low.rlike(r"\bprogressive degree\b"), "excluded_progressive").when(F.lower("__base").rlike(MINOR) | F.lower("__l").rlike(MINOR), "excluded_minor")
    for name, pattern in NAMED:
        value = F.when(low.contains("graduate certificate"), "excluded_graduate_certificate").otherwise(name) if name == "excluded_certificate" else F.lit(name)
        verdict = verdict.when(low.rlike(pattern), value)
    verdict = (
        verdict.when((F.size("ug") > 0) & (F.size("grad") > 0), "excluded_combined")
        .when(F.size("grad") > 0, F.when(doctoral, "excluded_doctoral").when(among(PROFESSIONAL), "excluded_professional").otherwise("excluded_masters"))
        .when(F.size("ug") > 0, "included")
        .when((up != "") & (gp == ""), "included")
        .when((gp != "") & (up == ""), F.when(gp.contains("doctor"), "excluded_doctoral").otherwise("excluded_masters"))
        .when((up != "") & (gp != ""), "excluded_combined")
        .otherwise("manual_review")
    )
    out = out.withColumn("class", verdict).withColumn("confident", F.col("class") != "manual_review")
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def collected(verdict: Column, mode: str) -> Column:
    """The verdict for a collection of bachelor's degrees (default), of minors, or of both."""
    if mode == "all_undergraduate":
        return F.when(verdict == "excluded_minor", "included").otherwise(verdict)
    if mode == "minors":
        return F.when(verdict == "excluded_minor", "included").when(verdict == "included", "excluded_not_minor").otherwise(verdict)
    return verdict


def reconciled(link: Column, page: Column) -> Column:
    """One verdict from a link's and its page's; a null page leaves the link's."""
    return (
        F.when(page.isNull() | (link == page), link)
        .when((link == "included") & page.startswith("excluded_"), page)
        .when((link == "manual_review") & (page == "included"), "included")
        .otherwise("manual_review")
    )

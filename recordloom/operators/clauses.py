"""Requirement clauses: segmentation, phrase normalisation and validation of their records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOTH, ONCE, FLAG, NONE = ("ENFORCED", "ENFORCED"), ("GATE_ONCE", "CONDITIONAL"), ("FLAG_ONLY", "NOT_CHECKABLE"), (None, None)
# fixed values: tag, subtypes, qualifier (key, allowed values) pairs, roles
RULES = (
    [("CNS", None, {}, BOTH), ("UNKNOWN", None, {}, FLAG), ("FIELD_HOURS_REQUIREMENT", None, {}, FLAG)]
    + [(f"OUT_OF_SCOPE_{x}", None, {}, NONE) for x in ("GPA_FLOOR", "MINIMUM_GRADE", "TRANSFER_CREDIT", "SUBSTITUTION_LIMIT", "PDP", "PASS_NO_PASS", "GRADUATE")]
    + [("NOT_CNS_SPLIT", x, {}, BOTH) for x in ("FLOOR_CEILING_SET", "FLOOR_ONLY_SHARED_CAP", "DIVERSITY_SPREAD_CAP", "PROPORTIONAL_CAP")]
    + [("NOT_CNS_XREQ", x, {}, BOTH) for x in ("UNIQUENESS_FLOOR", "COURSE_LEVEL_DISTRIBUTION_RULE", "EQUIVALENT_COURSE_EXCLUSIVITY", "EXTERNAL_UNIT_CAP", "EXTERNAL_UNIT_FLOOR", "UNIT_DISTRIBUTION_FLOOR", "SEQUENCE_ORDERING")]
    + [("NOT_CNS_XREQ", x, {}, ONCE) for x in ("PROGRAM_COMBINATION_RULE", "MAJOR_CONDITIONAL_ROUTING")]
    + [("NOT_CNS_XREQ", "NO_DOUBLE_COUNT", {"mode": m, "polarity": p}, BOTH) for m in ("AT_MOST_ONE", "PAIRWISE") for p in ("PROHIBITS", "PERMITS")]
    + [("NOT_CNS_XREQ", "DIVERSITY_SPREAD_RULE", {"direction": d}, BOTH) for d in ("MIN_SPREAD", "MAX_CONCENTRATION")]
    + [("NOT_CNS_XREQ", "PROGRAM_ELIGIBILITY_RULE", {"direction": d}, ONCE) for d in ("EXCLUDES", "REQUIRES")]
    + [("NOT_CNS_DISC_COURSE", x, {}, FLAG) for x in ("SUBSTITUTE", "WAIVE", "ADD_NONLISTED")]
    + [("NOT_CNS_DISC_CATEGORY", x, {}, FLAG) for x in ("no_enumerated_list", "fully_adviser_directed", "empty_catalog_category", "faculty_supervised_milestone")]
    + [("NOT_CNS_GATE", x, {"checkable": c}, r) for x in ("INITIAL_ADMISSION", "INTERNAL_TRANSFER_ADMISSION", "EMPHASIS_OR_CONCENTRATION_ENTRY") for c, r in (("NUMERIC_THRESHOLD", ONCE), ("QUALITATIVE_REVIEW", FLAG))]
    + [("NOT_CNS_PROCEDURAL", x, {}, FLAG) for x in ("ADVISING_PROCEDURAL", "DECLARATION_DEADLINE")]
)
PHRASES = [
    (r"\b(?:no more than|not more than|a maximum of|at most)\s+", "max "),
    (r"\b(?:at least|a minimum of|no fewer than)\s+", "min "),
    (r"\bone or more\b", "min 1"),
    (r"\bfewer than\s+(?=\d)", "under "),
]
NUMBERS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]


def rule_rows() -> list[tuple]:
    """(tag, subtype, qualifiers as `key=value` pairs in key order, solver, validator)."""
    return [(t, s, ",".join(f"{k}={v}" for k, v in sorted(q.items())), *r) for t, s, q, r in RULES]


def violations(records: DataFrame) -> DataFrame:
    """requirement_id, violation: one row for each rule that a record breaks.

    Records have requirement_id, tag, subtype, qualifiers (a map or null), solver, validator and
    needs_review.  The rule table is a constant of some fifty rows.
    """
    spark = records.sparkSession
    rules = F.broadcast(spark.createDataFrame(rule_rows(), "r_tag string, r_subtype string, r_quals string, r_solver string, r_validator string"))
    quals = F.array_join(F.array_sort(F.transform(F.map_entries("qualifiers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    rows = records.withColumn("quals", F.coalesce(quals, F.lit("")))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    joined = rows.join(rules, F.col("tag") == F.col("r_tag"), "left")
    sub, q = F.col("r_tag").isNotNull() & same("subtype", "r_subtype"), same("quals", "r_quals")
    role = same("solver", "r_solver") & same("validator", "r_validator")
    ok = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    judged = joined.groupBy("requirement_id", "tag", "needs_review").agg(F.bool_or(F.col("r_tag").isNotNull()).alias("known"), ok(sub).alias("sub"), ok(sub & q).alias("qual"), ok(sub & q & role).alias("role"))
    found = F.array_compact(F.array(
        F.when(~F.col("known"), F.lit("tag")),
        F.when(F.col("known") & ~F.col("sub"), F.lit("subtype")),
        F.when(F.col("sub") & ~F.col("qual"), F.lit("qualifiers")),
        F.when(F.col("qual") & ~F.col("role"), F.lit("roles")),
        F.when((F.col("tag") == "UNKNOWN") & ~F.coalesce("needs_review", F.lit(False)), F.lit("needs_review")),
    ))
    return judged.select("requirement_id", F.explode(found).alias("violation"))


def normal_phrase(c: Column) -> Column:
    """Bounds as `max n` and `min n`, number words as digits."""
    c = F.lower(c)
    for k, word in enumerate(NUMBERS, 1):
        if word != "one":
            c = F.regexp_replace(c, rf"\b{word}(?:\s*\({k}\))?(?=\s)", str(k))
    for pattern, to in PHRASES:
        c = F.regexp_replace(c, pattern, to)
    return F.regexp_replace(c, r"\bone(?:\s*\(1\))?(?=\s)", "1")


def segments(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, n, requirement_id, clause: cut at bullets, sentence ends and semicolons; an otherwise-branch shares its number.

    Enumerations after a colon stay whole.
    """
    cut = F.regexp_replace(F.col(text), r"(?m)^\s*(?:[-*•]|\d+\.)\s+|([.!?])\s+|\n+", "$1\u0001")
    cut = F.regexp_replace(cut, r";\s+otherwise,?\s+", "\u0002")
    cut = F.regexp_replace(cut, r";\s+(?=(?:an?|the|students|no|at)\b)", "\u0001")
    clauses = F.filter(F.transform(F.split(cut, "\u0001"), lambda x: F.trim(x)), lambda s: s != "")
    rows = texts.select(key, F.posexplode(clauses).alias("i", "c"))
    rows = rows.select(key, (F.col("i") + 1).alias("n"), F.posexplode(F.split("c", "\u0002")).alias("branch", "clause"), F.col("c").contains("\u0002").alias("branches"))
    letter = F.when(F.col("branches"), F.when(F.col("branch") < 26, F.chr(F.col("branch") + 97)).otherwise((F.col("branch") + 1).cast("string"))).otherwise("")
    slug = F.upper(F.regexp_replace(F.col(key), r"[^A-Za-z0-9]+", "-"))
    return rows.select(key, "n", F.concat(slug, F.format_string("-%02d", "n"), letter).alias("requirement_id"), F.trim("clause").alias("clause"))


def tag_counts(records: DataFrame, program: str = "program") -> DataFrame:
    """Records of each tag per program, one column a tag."""
    tags = sorted({r[0] for r in RULES})
    return records.groupBy(program).pivot("tag", tags).agg(F.count(F.lit(1))).na.fill(0)

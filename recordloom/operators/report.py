"""Progress-report texts to typed records."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import codes
from recordloom.functions import text as tx

# fixed values: degree names, and requirement labels with the text that each looks for
DEGREES = {"SCIENCE": "BS", "ARTS": "BA", "FINE ARTS": "BFA", "MUSIC": "BM"}
REQUIREMENTS = [("128-Unit Minimum", "128 UNITS"), ("64-Unit Residency", "64-UNIT RESIDENCY"), ("32-Unit Upper Division", "32-UNIT UPPER DIVISION"), ("Cumulative GPA 2.0+", r"2\.0 CUMULATIVE GPA"), ("Composition/Writing", "COMPOSITION/WRITING")]
KIND = "(SCIENCE|ARTS|FINE ARTS|MUSIC)"
MAJOR = rf"(?i)BACHELOR OF {KIND}\s*[-–]?\s*(BUSINESS ADMINISTRATION|[A-Z][A-Z ,&]+?)(?:\s+Academic|\s+PROGRAM|\s*\n)"
POST = r"(?is)CURRENT POST:.*?(\d{3,4})\s+(?:BS|BA|BFA|BM|BME)\.?\s+(\w+)\s+\w+\s+\d{5}"


def _holds(t: Column, *literals: str) -> Column:
    """Whether a text holds all of some literals in any case: patterns are tried only where theirs are, which is far cheaper to see."""
    return reduce(and_, [F.contains(F.upper(t), F.lit(x.upper())) for x in literals])


def _says(t: Column, literal: str, pattern: str) -> Column:
    """Whether a text has a match; a match holds `literal`."""
    return _holds(t, literal) & t.rlike(pattern)


def _first(t: Column, literal: str | list[str], pattern: str, k: int = 1) -> Column:
    """A group of the first match, empty if there is none; a match holds `literal`, or all of several."""
    return F.when(_holds(t, *([literal] if isinstance(literal, str) else literal)), F.regexp_extract(t, pattern, k)).otherwise(F.when(t.isNotNull(), ""))


def _get(t: Column, literal: str | list[str], pattern: str, k: int = 1) -> Column:
    """A group of the first match, null if there is none; a match holds `literal`."""
    return F.nullif(F.trim(_first(t, literal, pattern, k)), F.lit(""))


def fields(t: Column) -> dict[str, Column]:
    """Scalar fields of a report."""
    kind = F.upper(F.coalesce(_get(t, "BACHELOR OF", rf"(?i)BACHELOR OF {KIND}"), F.lit("SCIENCE")))
    degree = F.lit("BS")
    for name, short in DEGREES.items():
        degree = F.when(kind == name, short).otherwise(degree)
    minor = _get(t, "MINOR:", r"(?i)MINOR:\s*(.+?)(?:\s+\d{5}|\n)")
    abroad = _says(t, "3000", r"(?i)[A-Z]\s+3000\b") | _says(t, "Off-Campus Studies", "(?i)Off-Campus Studies") | _says(t, "OVERSEAS STUDIES", "(?i)OVERSEAS STUDIES")
    return {
        "degree": degree,
        "major": F.coalesce(_get(t, "BACHELOR OF", MAJOR, 2), F.lit("")),
        "concentration": _get(t, ["BACHELOR OF", "(", ")"], r"(?i)BACHELOR OF[\s\S]{0,120}?\n\s*\(([^)]{3,60})\)"),
        "major_code": _get(t, "CURRENT POST:", POST, 2),
        "program_code": F.coalesce(_get(t, "PROGRAM:", r"(?i)PROGRAM:\s*(\d{3,5})\s"), _get(t, "CURRENT POST:", POST, 1)),
        "catalog_year": codes.academic_year(_get(t, "CATALOG YEAR:", r"(?i)CATALOG YEAR:\s*(\d{5})")),
        "class_level": _get(t, "Current Class Level", r"(?i)Current Class Level\s+(Freshman|Sophomore|Junior|Senior)"),
        "expected_graduation": _get(t, "Expected Graduation Date", r"(?i)Expected Graduation Date\s*[-–]?\s*(\d{1,2}\s+\w+\s+\d{4})"),
        "gpa": codes.leading_number(_first(t, "EARNED:", r"(?i)EARNED:\s*([\d.]+)\s*GPA")),
        "upper_division_gpa": codes.leading_number(_first(t, "UPPER DIVISION COURSE", r"(?i)UPPER DIVISION COURSE[\s\S]{0,40}?EARNED:\s*([\d.]+)\s*GPA")),
        "transfer_units": F.coalesce(codes.leading_number(_first(t, "TRNSFR", r"(?i)TRNSFR\s+WORK\s+([\d.]+)\s+TR")), F.lit(0.0)),
        "minor": F.when(~minor.rlike("(?i)no minor"), minor),
        "is_transfer": _says(t, "TRNSFR WORK", r"(?i)TRNSFR WORK\s+(?:6[0-9]|[7-9]\d|1\d{2})\.0\s+TR"),
        "studied_abroad": abroad,
        "is_athlete": _says(t, "Student Athlete:", "(?i)Student Athlete:"),
    }


def requirements(t: Column) -> Column:
    """Array of (label, status) of the requirements that a report mentions."""
    def one(label: str, mark: str) -> Column:
        status = F.when(t.rlike(rf"(?i){mark}(?:(?!SATISFIED)[\s\S]){{0,80}}?NOT BEEN SATISFIED"), "no").otherwise("ok")
        said = _holds(t, mark.replace("\\", "")) & t.rlike(rf"(?i){mark}[\s\S]{{0,80}}?SATISFIED")
        return F.when(said, F.struct(F.lit(label).alias("label"), status.alias("status")))

    return F.array_compact(F.array(*[one(*r) for r in REQUIREMENTS]))


ROW = r"^\s*(\d{5})\s+([A-Za-z]{2,4}\s*\d{3}[A-Za-z]?)\s+"
MARK = r"^([A-Z][A-Z+\-]*|CR|P|W|NP|RG)\s+"


def rows_of(t: Column) -> Column:
    """Array of (line, term, code, title, units, grade, state) of the course lines of a report; lines that fail a step are left out.

    A line is term, code, units, an optional grade and a title; it is in progress with an `>IP` mark or
    the grade RG, completed with any other grade but IP, and else dropped.
    """
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x, k: F.struct(k.alias("line"), x.alias("l"))), lambda x: x["l"].rlike(ROW))
    rest = F.transform(lines, lambda x: F.struct(x["line"].alias("line"), F.regexp_extract(x["l"], ROW, 1).alias("term"), F.regexp_extract(x["l"], ROW, 2).alias("code"), F.regexp_replace(x["l"], ROW, "").alias("rest")))
    parts = F.transform(rest, lambda x: F.struct(x["line"].alias("line"), x["term"].alias("term"), x["code"].alias("code"), F.regexp_extract(x["rest"], r"([\d.]+)\s+", 1).alias("units"), F.regexp_extract(x["rest"], r"^.*?[\d.]+\s+(.*)$", 1).alias("after")))
    graded = F.transform(F.filter(parts, lambda x: x["units"] != ""), lambda x: F.struct(
        x["line"].alias("line"), x["term"].alias("term"), F.regexp_replace(x["code"], r"\s+", " ").alias("code"), codes.leading_number(x["units"]).alias("units"), x["after"].alias("after"), F.regexp_extract(x["after"], MARK, 1).alias("grade"),
        tx.collapse(F.regexp_replace(F.regexp_replace(x["after"], MARK, ""), r"^>(?i:IP)[a-z]*", "")).alias("title"),
    ))
    state = lambda x: F.when(x["after"].rlike("(?i)>IP") | (x["grade"] == "RG"), "in_progress").when((x["grade"] != "") & (x["grade"] != "IP"), "completed")
    grade = lambda x: F.when(x["grade"] != "", x["grade"])
    judged = F.transform(graded, lambda x: F.struct(x["line"].alias("line"), x["term"].alias("term"), x["code"].alias("code"), x["title"].alias("title"), x["units"].alias("units"), grade(x).alias("grade"), state(x).alias("state")))
    return F.filter(judged, lambda x: x["state"].isNotNull() & (F.length(x["title"]) >= 3))


def course_rows(reports: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line, term, code, title, units, grade, state of every course line."""
    # outer, as Spark would else look for rows once more to leave out reports without any
    return reports.select(key, F.inline_outer(rows_of(F.col(text)))).where("line is not null")


def parse(reports: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One record a report: fields, requirements and the two ordered course arrays, null where a report has no course line.

    A report's rows stay with it as an array, so that nothing is exploded, grouped or joined.
    """
    t, rows = F.col(text), F.col("report_rows")
    pick = lambda state, *c: F.when(F.size(rows) > 0, F.transform(F.filter(rows, lambda x: x["state"] == state), lambda x: F.struct(*[x[k].alias(k) for k in ("line", *c)])))
    courses = {"completed_courses": pick("completed", "term", "code", "title", "units", "grade"), "in_progress_courses": pick("in_progress", "term", "code", "title", "units")}
    shown = {**fields(t), "requirements": requirements(t), **courses}
    return reports.select(key, text, rows_of(t).alias("report_rows")).select(key, *[c.alias(k) for k, c in shown.items()])


def chunks(lines: DataFrame, key: str, pos: str, line: str, divider: str = r"^\s*[-=_]{5,}\s*$") -> DataFrame:
    """Lines with the number of dividers before them as their chunk."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("chunk", F.sum(F.col(line).rlike(divider).cast("int")).over(w))


def labelled(lines: DataFrame, key: str, pos: str, line: str, labels: list[str]) -> DataFrame:
    """Lines with `label`: the first of the labels that their chunk holds, by its place; null where it holds none."""
    found = F.array_compact(F.array(*[F.when(F.col(line).contains(x), F.lit(x)) for x in labels]))
    first = lines.withColumn("__found", found).where(F.size("__found") > 0).groupBy(key, "chunk").agg(F.min_by(F.col("__found")[0], pos).alias("label"))
    return lines.join(first, [key, "chunk"], "left")


def rebuilt_lines(fragments: DataFrame) -> DataFrame:
    """(page, y, line): fragments (page, x, y, s) of one baseline joined from left to right."""
    parts = F.array_sort(F.collect_list(F.struct("x", "s")))
    return fragments.groupBy("page", "y").agg(F.array_join(F.transform(parts, lambda p: p["s"]), " ").alias("line"))


def text_or_ocr(layer: Column, ocr: Column, least: int = 100) -> Column:
    """The text layer if it has over `least` visible characters, else the recognised text."""
    return F.when(F.length(F.regexp_replace(layer, r"\s+", "")) > least, layer).otherwise(ocr)


def earned_units_agree(rows: DataFrame, key: str, stated: str) -> DataFrame:
    """Whether the units of completed rows add up to the stated number."""
    return rows.where("state = 'completed'").groupBy(key, stated).agg((F.abs(F.sum("units") - F.col(stated)) < 0.005).alias("agrees"))

"""Schedule feeds: nested JSON to typed course and section records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators import relational as rel
from recordloom.sources.shared import settled

# fixed values: section kinds by mode
KINDS = {"Lecture": "lectures", "Lecture/Lab": "lectures", "Lecture/Discussion": "lectures", "Lab": "labs", "Discussion": "discussions", "Quiz": "quizzes"}
FEED = (
    "courses array<struct<courseId string, fullCourseName string, classNumber string, description string, courseUnits array<double>, sections array<struct<"
    "sisSectionId string, linkCode string, hasDClearance boolean, notes string, isCancelled boolean, totalSeats int, registeredSeats int, waitlistedSeats int, isFull boolean, rnrMode string,"
    "instructors array<struct<firstName string, lastName string>>, schedule array<struct<days array<string>, startTime string, endTime string, location string>>>>>>"
)


def kind(mode: Column) -> Column:
    out = F.lit("other")
    for m, k in KINDS.items():
        out = F.when(mode == m, k).otherwise(out)
    return out


def open_seats(total: Column, registered: Column) -> Column:
    return F.greatest(F.lit(0), F.coalesce(total, F.lit(0)) - F.coalesce(registered, F.lit(0)))


def _section(s: Column) -> Column:
    first, who = F.get(s["schedule"], F.lit(0)), F.get(s["instructors"], F.lit(0))
    name = F.trim(F.concat_ws(" ", who["firstName"], who["lastName"]))
    mode = F.coalesce(s["rnrMode"], F.lit(""))
    no = lambda c: F.coalesce(c, F.lit(False))
    return F.struct(
        kind(mode).alias("kind"), s["sisSectionId"].alias("section_id"), s["linkCode"].alias("link_code"), no(s["hasDClearance"]).alias("has_clearance"), s["notes"].alias("notes"),
        no(s["isCancelled"]).alias("is_cancelled"), F.coalesce(F.nullif(name, F.lit("")), F.lit("TBD")).alias("instructor"), s["totalSeats"].alias("total_seats"), s["registeredSeats"].alias("registered_seats"),
        F.coalesce(s["waitlistedSeats"], F.lit(0)).alias("waitlisted_seats"), open_seats(s["totalSeats"], s["registeredSeats"]).alias("open_seats"), s["isFull"].alias("is_full"), mode.alias("mode"),
        first["days"].alias("days"), F.coalesce(first["startTime"], F.lit("")).alias("start_time"), F.coalesce(first["endTime"], F.lit("")).alias("end_time"), F.coalesce(first["location"], F.lit("")).alias("location"),
    )


def departments(responses: DataFrame) -> DataFrame:
    """(term, dept, dept_ord, state, n_courses) of every response: failed if its body has no list of courses, empty if the list is."""
    parsed, c = responses.select("term", "dept", "dept_ord", F.from_json("body", FEED)["courses"].alias("c")), F.col("c")
    state = F.when(c.isNull(), "failed").when(F.size(c) == 0, "empty").otherwise("ok")
    return parsed.select("term", "dept", "dept_ord", state.alias("state"), F.when(c.isNull(), 0).otherwise(F.size(c)).alias("n_courses"))


def courses(responses: DataFrame) -> DataFrame:
    """Course records of (term, dept, dept_ord, body), body being a response as JSON.

    A body that doesn't parse gives no courses; names of other departments are dropped; a course that
    an earlier department of the term already brought is dropped, repeats within one response stay.
    """


    def listed(r: DataFrame) -> DataFrame:
        parsed = r.select("term", "dept", "dept_ord", F.from_json("body", FEED)["courses"].alias("c"))
        # outer, as Spark would else test each body for courses first, and so make and parse it several times; null names drop out
        rows = parsed.select("term", "dept", "dept_ord", F.explode_outer("c").alias("c")).where(F.col("c.fullCourseName").startswith(F.concat("dept", F.lit(" "))))
        return rows.withColumn("id", F.coalesce("c.courseId", F.lit("")))

    # settled, so that Spark knows its size: where it is small, responses and courses are neither shuffled nor sorted again
    first = settled(listed(responses).groupBy("term", "id").agg(F.min("dept_ord").alias("first_ord")))
    # whole courses are read only from responses that brought one first
    some = first.select("term", F.col("first_ord").alias("dept_ord")).distinct()
    rows = listed(responses.join(some, ["term", "dept_ord"], "left_semi")).join(first, ["term", "id"]).where(F.col("dept_ord") == F.col("first_ord"))
    rows = rows.select("term", "c", F.transform("c.sections", _section).alias("s"))
    some = lambda f: F.coalesce(F.exists("s", f), F.lit(False))
    kinds = F.array_sort(F.array_distinct(F.transform("s", lambda x: x["kind"])))
    counts = F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, F.size(F.filter("s", lambda x: x["kind"] == k)))))
    groups = F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, F.filter("s", lambda x: x["kind"] == k))))
    return rows.select(
        "term", F.col("c.courseId").alias("course_id"), F.col("c.fullCourseName").alias("course_name"), F.col("c.classNumber").alias("class_number"), F.col("c.description").alias("description"),
        F.get("c.courseUnits", F.lit(0)).alias("units"), some(lambda x: x["kind"] == "labs").alias("has_lab"), some(lambda x: x["kind"] == "discussions").alias("has_discussion"),
        some(lambda x: x["has_clearance"]).alias("has_clearance"), some(lambda x: F.coalesce(x["notes"] != "", F.lit(False))).alias("has_restrictions"), counts.alias("section_counts"), groups.alias("sections"),
    )


def frequency(rows: DataFrame, term: str = "term", course: str = "course_name") -> DataFrame:
    """course, count, terms, label: how often a course is offered; repeats within a term count."""
    # counted once, as both the terms in all and those of a course are taken from the counts
    each = settled(rows.groupBy(course, term).agg(F.count("*").alias("n")))
    total = each.agg(F.count_distinct(term).alias("total"))
    repeats = F.when(F.col(term).isNotNull(), F.array_repeat(F.col(term), F.col("n").cast("int")))
    n = each.groupBy(course).agg(F.sum("n").alias("count"), F.array_sort(F.flatten(F.collect_list(repeats))).alias("terms"))
    label = rel.frequency_label(F.col("count"), F.col("total"))
    return n.crossJoin(F.broadcast(total)).select(course, "count", "terms", label.alias("label"))

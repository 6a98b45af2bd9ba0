"""Quality gate of extracted texts: features, reasons in fixed order, and a verdict."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import text as tx
from recordloom.sources import files

# fixed values: patterns that never occur in a clean body, with their names
FATAL = [
    ("skip_link", r"Skip to Navigation"),
    ("site_header", r"\|\s*{site}"),
    ("layout_marks", r"Begin Responsive|End Responsive"),
    ("script_markup", r"<\s*/?\s*script\b"),
    ("html_markup", r"<\s*(?:div|span|td|tr|table|ul|ol|li|img|link|style|body|html|meta|iframe)\b[^>]*>"),
    ("placeholder", r"(?:\bLoading\.\.\.|\bPlease wait\b|\bJust a moment)"),
    ("script_error", r"(?:ReferenceError|TypeError:|Uncaught |undefined is not a function)"),
    ("bot_wall", r"(?:verify you are human|Pardon our interruption|Request unsuccessful|Access Denied)"),
    ("menu_run", r"Courses\s+Programs\s+School"),
]
# fixed values: course codes, units, sections, headings, bullets and stubs of a body; the words of sections, and the least sizes
CODE = r"\b[A-Z]{2,5}\s\d{3}[A-Za-z]{0,3}\b"
UNITS = r"(?i)\bUnits?:\s*\d|\bTotal units\b"
SECTION = r"(?m)^#{2,4}\s+\S"
HEADING = r"(?m)^#{1,3}\s+\S"
BULLET = r"(?m)^\s*-\s+[A-Z]{2,5}\s?\d{3}[A-Za-z]{0,3}\b.*$"
BULLET_UNITS = r"(?i)\bUnits?:\s*[\d.]|\(\s*[\d.]+(?:\s*[-–]\s*[\d.]+)?\s*units?\s*\)|\b[\d.]+(?:\s*[-–]\s*[\d.]+)?\s+units?\b"
STUB = r"(?i)\bSee\b[^.\n]{0,140}?\b(?:School|College|section|Department|Division|catalogue)\b"
SECTION_WORDS = ["admission", "requirement", "restriction", "advisement", "prerequisite", "elective", "curriculum", "thesis", "total units", "course work"]
LEAST_CHARS, LEAST_WEAK_CHARS, MOST_REPEATS, LONG_SENTENCE = 200, 971, 3, 80


#: What a text must hold, as written, for a pattern to be looked for at all; a search for a literal costs a fraction of one for a pattern.
LITERALS = {
    "skip_link": ["Skip to Navigation"], "layout_marks": ["Begin Responsive", "End Responsive"], "html_markup": ["<"], "placeholder": ["Loading...", "Please wait", "Just a moment"], "script_markup": ["script"],
    "script_error": ["ReferenceError", "TypeError:", "Uncaught ", "undefined is not a function"], "bot_wall": ["verify you are human", "Pardon our interruption", "Request unsuccessful", "Access Denied"], "menu_run": ["Programs"],
    "table_header": ["TABLE:"], "script_file": [".js"], "style_file": [".css"], "menu_words": ["About"], "html_entity": ["&"], "shouting": ["!!"],
}
#: The same in lower case, for patterns that look at no case.
LOWER_LITERALS = {"cookie_notice": ["cookie"], "noscript_note": ["enable javascript"], "licence_line": ["licensed under"], "units": ["unit"], "stub": ["see"]}


def may_hold(name: str, text: Column, low: Column) -> Column:
    """Whether a text holds a literal without which the named pattern can't occur; true for a pattern without one."""
    held = F.lit(False)
    for x in LITERALS.get(name, []):
        held = held | text.contains(x)
    for x in LOWER_LITERALS.get(name, []):
        held = held | low.contains(x)
    return held if name in LITERALS or name in LOWER_LITERALS else F.lit(True)


def fatal_patterns(site: str) -> list[tuple[str, str]]:
    return [(k, p.replace("{site}", site)) for k, p in FATAL]


def title_present(body: Column, name: Column) -> Column:
    """Whether a heading starts with the name's stem; any heading of level 1 to 3 if there is no stem."""
    stem = tx.folded(F.regexp_replace(F.regexp_extract(F.coalesce(name, F.lit("")), r"^([^(]*)", 1), r"[*†‡]+\s*$", ""))
    lines = F.filter(F.split(F.when(body.contains("#"), body).otherwise(""), r"\R"), lambda x: x.startswith("#"))
    named = F.exists(lines, lambda x: tx.folded(F.regexp_replace(x, r"^#+", "")).startswith(stem))
    return F.when(stem == "", body.contains("#") & body.rlike(HEADING)).otherwise(named)


def repeated_sentences(docs: DataFrame, key: str, text: str, least: int = LONG_SENTENCE) -> DataFrame:
    """key, repeats and excerpt of the most repeated long sentence; of equals, the first. Rows without one are left out."""
    each = docs.select(F.col(key), F.posexplode(tx.sentences(F.col(text))).alias("at", "sentence")).where(F.length("sentence") > least)
    each = each.select(key, "at", tx.folded(F.col("sentence")).alias("s"))
    counts = each.groupBy(key, F.xxhash64("s").alias("h"), F.length("s").alias("size")).agg(F.count("*").alias("n"), F.min("at").alias("at"), F.first(F.substring("s", 1, 140)).alias("excerpt"))
    return counts.groupBy(key).agg(F.max("n").alias("repeats"), F.max_by("excerpt", F.struct("n", -F.col("at"))).alias("excerpt"))


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", name: Column | None = None, site: str = "Example University") -> DataFrame:
    """One row a document with everything that the gate judges by."""
    body = tx.strip(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(key), body.alias("body"), (name if name is not None else F.lit("")).alias("name")).withColumn("low", F.lower("body"))
    b, low = F.col("body"), F.col("low")
    bullets = F.regexp_extract_all(F.when(b.contains("-"), b).otherwise(""), F.lit(BULLET), F.lit(0))
    bare = F.filter(bullets, lambda x: ~F.regexp_replace(x, r"^\s*-\s+[A-Z]{2,5}\s?\d{3}[A-Za-z]{0,3}", "").rlike(BULLET_UNITS))
    last = F.element_at(F.split(F.substring_index(b, "\n", -1), r"\R"), -1)  # a body has no white space at its end
    rows = rows.select(
        key, "body",
        F.length(b).cast("long").alias("body_chars"),
        F.array_compact(F.array(*[F.when(may_hold(k, b, low) & b.rlike(p), F.lit(k)) for k, p in fatal_patterns(site)])).alias("fatal"),
        F.regexp_count(b, F.lit(CODE)).alias("codes"),
        F.when(low.contains("unit"), F.regexp_count(b, F.lit(UNITS))).otherwise(0).alias("units"),
        title_present(b, F.col("name")).alias("has_title"),
        F.when(b.contains("##"), F.regexp_count(b, F.lit(SECTION))).otherwise(0).alias("sections"),
        sum((low.contains(w).cast("int") for w in SECTION_WORDS), F.lit(0)).alias("section_words"),
        F.size(bullets).alias("bullets"), F.size(bare).alias("bare_bullets"),
        F.when(b == "", False).otherwise(F.coalesce(tx.strip(last).rlike(r"(?:[.!?:]|---)$|^#"), F.lit(False))).alias("ends_cleanly"),
        (low.contains("see") & b.rlike(STUB)).alias("refers"),
    )
    repeats = repeated_sentences(rows, key, "body")
    rows = rows.drop("body").join(repeats, key, "left").withColumns({"repeats": F.coalesce("repeats", F.lit(1)).cast("long"), "excerpt": F.coalesce("excerpt", F.lit(""))})
    structured = (F.col("sections") >= 2) | (F.col("section_words") >= 3)
    rows = rows.withColumns({"structured": structured, "stub": F.col("refers") & (F.col("body_chars") >= LEAST_CHARS) & F.col("ends_cleanly")})
    content = (F.col("codes") > 0) | (F.col("units") > 0) | F.col("structured") | F.col("stub")
    lost = (F.col("bullets") >= 3) & (F.col("bare_bullets") >= 3) & ((F.col("bare_bullets") == F.col("bullets")) | (F.col("bare_bullets") / F.col("bullets") > 0.6))
    return rows.withColumns({"content": content, "semantic": F.col("has_title") & content, "units_lost": F.coalesce(lost, F.lit(False))})


def reasons(least: int = LEAST_CHARS, weak: int = LEAST_WEAK_CHARS) -> Column:
    """The gate's reasons over `features`, in fixed order; an empty body has that one reason."""
    c = F.col
    found = [
        F.when(F.size("fatal") > 0, F.concat(F.lit("contaminated:"), F.array_join("fatal", ";"))),
        F.when(~c("has_title"), F.lit("no_title_heading")),
        F.when(~c("content"), F.lit("no_content_or_structure")),
        F.when(c("body_chars") < least, F.lit(f"under_{least}_chars")).when(~c("semantic") & (c("body_chars") < weak), F.lit(f"weak_and_under_{weak}_chars")),
        F.when(c("repeats") >= MOST_REPEATS, F.concat(F.lit("repeated_sentence_x"), c("repeats").cast("string"))),
        F.when(c("units_lost"), F.concat(F.lit("units_missing:"), c("bare_bullets").cast("string"), F.lit("_of_"), c("bullets").cast("string"))),
    ]
    return F.when(c("body_chars") == 0, F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(*found)))


def verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", name: Column | None = None) -> DataFrame:
    """key, verdict, reasons: FAIL if the body is contaminated, empty or under the least size, REVIEW for other reasons, else PASS."""
    rows = features(docs, key, text, name).withColumn("reasons", reasons())
    hard = F.exists("reasons", lambda r: r.startswith("contaminated") | (r == "empty") | r.startswith("under_"))
    return rows.withColumn("verdict", F.when(hard, "FAIL").when(F.size("reasons") > 0, "REVIEW").otherwise("PASS"))


def output_problems(outputs: DataFrame, key: str, value: str = "value") -> DataFrame:
    """key, problem and reasons of stored outputs: one without the marker, one whose body does not pass the gate under the name in its header, or null."""
    rows = files.decomposed(outputs.select(F.col(key).alias("file"), F.col(value).alias("value"))).withColumn("name", F.col("header")["Program"])
    judged = verdicts(rows.select("file", "body", "name"), "file", "body", F.col("name")).select("file", "verdict", F.array_join("reasons", " | ").alias("reasons"))
    marked = outputs.select(F.col(key).alias("file"), F.col(value).contains(files.MARKER).alias("marked"))
    problem = F.when(~F.col("marked"), "no_marker").when(F.col("verdict") != "PASS", "content")
    return marked.join(judged, "file").select(F.col("file").alias(key), problem.alias("problem"), F.when(F.col("marked"), F.col("reasons")).alias("reasons"))


# fixed values: the size under which a body has to show that it is complete, and what is said of a body that refers to its owner only
SHORT_CHARS = 400
DEFERS = "defers_to_owning_school_no_course_list_on_catalogue"


def audited(outputs: DataFrame, key: str, body: str, name: str, expected: str, cleared: str, short: int = SHORT_CHARS) -> DataFrame:
    """key, status, reasons and note: the gate's verdict under advisory flags, which demote a pass to a review and never fail.

    Flags are a title that differs from the index (`expected`), an accepted fetch that did not clear a challenge (`cleared`
    is false; null where there was no fetch), and a short body that does not show that it is complete.
    """
    judged = features(outputs, key, body, F.col(name)).withColumn("found", reasons()).select(key, "found", "semantic", "ends_cleanly", "stub", "codes", "units", "body_chars")
    rows = outputs.select(key, F.col(name).alias("name"), F.col(expected).alias("expected"), F.col(cleared).alias("cleared")).join(judged, key)
    differs = (F.coalesce("expected", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != "") & (tx.folded(F.col("expected")) != tx.folded(F.col("name")))
    flags = F.array_compact(F.array(
        F.when(differs, F.lit("title_mismatch_vs_index")),
        F.when(~F.coalesce("cleared", F.lit(True)), F.lit("accepted_fetch_did_not_clear_challenge")),
        F.when((F.col("body_chars") < short) & ~(F.col("semantic") & F.col("ends_cleanly")), F.lit("short_body_without_completeness_evidence")),
    ))
    status = F.when(F.size("found") > 0, "FAIL").when(F.size("flags") > 0, "REVIEW").otherwise("PASS")
    note = F.when(F.col("stub") & (F.col("codes") == 0) & (F.col("units") == 0), F.lit(DEFERS))
    return rows.withColumn("flags", flags).select(key, status.alias("status"), F.concat("found", "flags").alias("reasons"), note.alias("note"))

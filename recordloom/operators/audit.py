"""Corpus audit: counts, signatures, duplicate groups, outliers, priorities and run comparison."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import text as tx
from recordloom.operators.ranges import quantiles
from recordloom.operators import gate

# fixed values: signatures beyond the gate's fatal ones; patterns that begin with ^ match at line starts
HIGH = [("table_header", r"(?m)^TABLE:\s*Row"), ("script_file", r"\b[\w-]+\.js\b"), ("style_file", r"\b[\w-]+\.css\b"), ("menu_words", r"Home\s+About\s+Contact")]
MEDIUM = [("html_entity", r"&(?:nbsp|amp|lt|gt|quot|#\d+);"), ("cookie_notice", r"(?i)\bcookies?\b.{0,40}\b(?:accept|consent)"), ("noscript_note", r"(?i)enable javascript")]


def signatures(site: str = "Example University") -> list[tuple[str, str, str]]:
    """(name, severity, pattern)."""
    return [(k, "critical", p) for k, p in gate.fatal_patterns(site)] + [(k, "high", p) for k, p in HIGH] + [(k, "medium", p) for k, p in MEDIUM]


def signature_counts(docs: DataFrame, key: str, text: str, table: list[tuple[str, str, str]]) -> DataFrame:
    """key, signature, severity, hits for every signature that occurs: one scan; patterns are counted only where a literal of theirs occurs."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("low", F.lower("t"))
    count = lambda k, p: F.when(gate.may_hold(k, F.col("t"), F.col("low")), F.regexp_count("t", F.lit(p))).otherwise(0).cast("long")
    hits = F.array(*[F.struct(F.lit(k).alias("signature"), F.lit(s).alias("severity"), count(k, p).alias("hits")) for k, s, p in table])
    return rows.select(key, F.explode(F.filter(hits, lambda x: x["hits"] > 0)).alias("s")).select(key, "s.signature", "s.severity", "s.hits")


def counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_chars, n_bytes, n_words, n_lines (non-empty)."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        key,
        F.length(t).cast("long").alias("chars"),
        F.octet_length(t).cast("long").alias("bytes"),
        F.regexp_count(t, F.lit(r"[^ \t\n\r\f]+")).cast("long").alias("words"),
        F.regexp_count(t, F.lit(r"(?m)^.*[^ \t\n\r\f].*$")).cast("long").alias("lines"),
    )


def describe(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, min, max, mean, median, population deviation, exclusive quartiles and fences of the positive values."""
    good = rows.where(F.col(value) > 0)
    if not keys:
        good, keys = good.withColumn("__all", F.lit(1)), ["__all"]
    basic = good.groupBy(F.struct(*keys).alias("__k")).agg(F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stdev"))
    found = quantiles(good, keys, value).select(F.struct(*keys).alias("__k"), "median", "q1", "q3")
    joined = basic.join(found, "__k").select("__k.*", "n", "min", "max", "mean", "median", "stdev", "q1", "q3").withColumn("iqr", F.col("q3") - F.col("q1"))
    return joined.withColumns({"low_fence": F.col("q1") - 1.5 * F.col("iqr"), "high_fence": F.col("q3") + 1.5 * F.col("iqr")}).drop("__all")


def z_outliers(rows: DataFrame, key: str, value: str, least: float = 3.0) -> DataFrame:
    """key, value, z of the rows at least `least` population deviations from the mean."""
    good = rows.where(F.col(value) > 0)
    stats = good.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    z = (F.col(value) - F.col("mean")) / F.col("sd")
    return good.crossJoin(F.broadcast(stats)).where((F.col("sd") > 0) & (F.abs(z) >= least)).select(key, value, z.alias("z"))


def fence_outliers(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, side of the rows outside of the fences."""
    fences = describe(rows, [], value).select("low_fence", "high_fence")
    out = rows.where(F.col(value) > 0).crossJoin(F.broadcast(fences)).where((F.col(value) < F.col("low_fence")) | (F.col(value) > F.col("high_fence")))
    return out.select(key, value, F.when(F.col(value) > F.col("high_fence"), "high").otherwise("low").alias("side"))


def duplicate_groups(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, group_size, first and last member of every document's group of equal bodies.

    Sizes are aggregated first and joined back, so that a huge group is never one task's rows.
    """
    hashed = docs.select(key, tx.body_hash(F.coalesce(F.col(text), F.lit(""))).alias("h"))
    groups = hashed.groupBy("h").agg(F.count("*").alias("group_size"), F.min(key).alias("first_member"), F.max(key).alias("last_member"))
    return hashed.join(groups, "h").select(key, "group_size", "first_member", "last_member")


def members(docs: DataFrame, key: str, text: str) -> DataFrame:
    """h, n, member: a row for every member of every group of two or more equal bodies.

    Sizes are summed before a shuffle and joined back, so that no task holds a group.
    """
    hashed = docs.select(F.col(key).alias("member"), tx.body_hash(F.coalesce(F.col(text), F.lit(""))).alias("h"))
    sizes = hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    return hashed.join(sizes, "h").select("h", "n", "member")


def priority(verdict: Column, flagged: Column) -> Column:
    """Order of review: failures 1, flagged reviews 2, reviews 3, the rest 9."""
    return F.when(verdict == "FAIL", 1).when((verdict == "REVIEW") & flagged, 2).when(verdict == "REVIEW", 3).otherwise(9)


def compare_runs(before: DataFrame, after: DataFrame, key: str, state: str, mark: str) -> DataFrame:
    """key, change of two runs: added, removed, repaired, regressed, changed or same."""
    b = before.select(key, F.col(state).alias("b_state"), F.col(mark).alias("b_mark"))
    a = after.select(key, F.col(state).alias("a_state"), F.col(mark).alias("a_mark"))
    change = (
        F.when(F.col("b_state").isNull(), "added")
        .when(F.col("a_state").isNull(), "removed")
        .when((F.col("b_state") != "PASS") & (F.col("a_state") == "PASS"), "repaired")
        .when((F.col("b_state") == "PASS") & (F.col("a_state") != "PASS"), "regressed")
        .when(F.col("b_mark") != F.col("a_mark"), "changed")
        .otherwise("same")
    )
    return b.join(a, key, "full").select(key, change.alias("change"))


def first_by(keys: list[str], order: list[Column]) -> Column:
    """Row number for keep-first rules."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def checks(rows: DataFrame, failing: dict[str, Column], unique: dict[str, list[str]]) -> DataFrame:
    """name, n_failed, ok of each check, and of `all` together; `unique` counts rows beyond the first of a key."""
    counts = rows.agg(*[F.count_if(c).alias(name) for name, c in failing.items()])
    out = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n_failed")) for n in failing])).alias("c")).select("c.*")
    for name, key in unique.items():
        copies = rows.groupBy(*key).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_failed"))
        out = out.unionAll(copies.select(F.lit(name).alias("name"), "n_failed"))
    total = out.rollup("name").agg(F.sum("n_failed").alias("n_failed"))
    return total.select(F.coalesce("name", F.lit("all")).alias("name"), "n_failed", (F.col("n_failed") == 0).alias("ok"))

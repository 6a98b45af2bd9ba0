"""Ordered work on keys of any size: ranges of (key, order), work within a range, and what earlier ranges pass on.

Rows are dealt by ranges of their keys and order, which Spark balances by sampling, and are settled with the number of
their range.  A hot key then lies in several ranges.  Windows see one key in one range; what a range passes on to the
later ones of its key is a row for each key and range.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.sources.shared import settled

#: Rows of a range that are aimed at, and ranges at most.
ROWS, MOST = 1_000_000, 100_000
CELL = "range_of_rows"


def ranged(rows: DataFrame, by: list[str], size: int = ROWS) -> DataFrame:
    """`rows` with the number of their range of `by`; settled, as another run may draw other ranges."""
    rows = settled(rows)
    cells = max(1, min(MOST, -(-rows.count() // size)))
    return settled(rows.repartitionByRange(cells, *by).withColumn(CELL, F.spark_partition_id()))


def _paired(name: str, key: list[str]) -> Column:
    """Null-safe equality of the columns `key` with those of the same name after `name`."""
    out = F.lit(True)
    for k in key:
        out = out & F.col(k).eqNullSafe(F.col(f"{name}{k}"))
    return out


def running_total(rows: DataFrame, key: list[str], order: list[str], value: str, out: str, size: int = ROWS) -> DataFrame:
    """`rows` with the sum of `value` (null counts as 0) of this and the earlier rows of its key; `order` is unique in a key."""
    dealt = ranged(rows.withColumn(out, F.coalesce(F.col(value), F.lit(0))), [*key, *order], size)
    sums = dealt.groupBy(*key, CELL).agg(F.sum(out).alias("total"))
    ahead = sums.withColumn("ahead", F.sum("total").over(Window.partitionBy(*key).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)))
    ahead = ahead.select(*[F.col(k).alias(f"a_{k}") for k in key], F.col(CELL).alias("a_cell"), F.coalesce("ahead", F.lit(0)).alias("ahead"))
    within = F.sum(out).over(Window.partitionBy(CELL, *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = dealt.withColumn(out, within).join(ahead, (F.col(CELL) == F.col("a_cell")) & _paired("a_", key))
    return joined.select(*rows.columns, (F.col(out) + F.col("ahead")).alias(out))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, tie: str, values: list[str], strict: bool = True, size: int = ROWS) -> DataFrame:
    """`left` with `values` of the last row of `right` of its key before its time `at` (at it too, unless `strict`).

    Of right rows at one time the one with the largest `tie` counts.  Each key and time is answered once, however many rows
    share it.  Rows without key or time stay, and find nothing.
    """
    whole = F.col(key).isNotNull() & F.col(at).isNotNull()
    asked = left.where(whole).select(key, at).distinct().withColumn("as_of_v", F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType))
    said = right.where(whole).groupBy(key, at).agg(F.max_by(F.struct(*values), tie).alias("as_of_v"))
    dealt = ranged(asked.unionByName(said).groupBy(key, at).agg(F.first("as_of_v", ignorenulls=True).alias("as_of_v")), [key, at], size)
    until = Window.unboundedPreceding, -1 if strict else 0
    near = F.last("as_of_v", ignorenulls=True).over(Window.partitionBy(CELL, key).orderBy(at).rowsBetween(*until))
    last = dealt.groupBy(key, CELL).agg(F.max_by("as_of_v", F.when(F.col("as_of_v").isNotNull(), F.col(at))).alias("as_of_v"))
    carried = last.withColumn("carried", F.last("as_of_v", ignorenulls=True).over(Window.partitionBy(key).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1))).select(key, CELL, "carried")
    found = dealt.withColumn("near", near).join(carried, [key, CELL]).select(key, at, F.coalesce("near", "carried").alias("as_of_v"))
    return left.join(found, [key, at], "left").select(*left.columns, *[F.col("as_of_v")[v].alias(f"last_{v}") for v in values])


def before(rows: DataFrame, key: list[str], order: list[str], value: str, out: str, size: int = ROWS) -> DataFrame:
    """`rows` with a struct `out` (is_first, value): whether a row is the first of its key, and the value of the row before it."""
    dealt = ranged(rows, [*key, *order], size)
    here = Window.partitionBy(CELL, *key).orderBy(*order)
    near = F.lag(F.struct(F.lit(False).alias("is_first"), F.col(value).alias("value"))).over(here)
    last = dealt.groupBy(*key, CELL).agg(F.max_by(F.struct(F.lit(False).alias("is_first"), F.col(value).alias("value")), F.struct(*order)).alias("last"))
    carried = last.withColumn("last", F.lag("last").over(Window.partitionBy(*key).orderBy(CELL)))
    carried = carried.select(*[F.col(k).alias(f"c_{k}") for k in key], F.col(CELL).alias("c_cell"), F.col("last").alias("carried_last"))
    none = F.struct(F.lit(True).alias("is_first"), F.lit(None).cast(rows.schema[value].dataType).alias("value"))
    joined = dealt.withColumn(out, near).join(carried, (F.col(CELL) == F.col("c_cell")) & _paired("c_", key))
    return joined.select(*rows.columns, F.coalesce(F.col(out), F.col("carried_last"), none).alias(out))


def selected(rows: DataFrame, key: list[str], value: str, ranks: dict[str, Column], size: int = ROWS) -> DataFrame:
    """key, n and, for each name in `ranks`, the value of that rank (from 1; an expression over `n`) among the key's rows; nulls don't count.

    Two passes: values are counted, and the ranges that hold a rank found by the counts of ranges; then only
    these ranges are read again.
    """
    counted = rows.where(F.col(value).isNotNull()).select(F.struct(*key).alias("k"), F.col(value).alias("x")).groupBy("k", "x").agg(F.count("*").alias("c"))
    dealt = ranged(counted, ["k", "x"], size)
    cells = dealt.groupBy("k", CELL).agg(F.sum("c").alias("c"))
    w = Window.partitionBy("k")
    upto = cells.withColumns({"upto": F.sum("c").over(w.orderBy(CELL).rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(w)})
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.least(F.col("n"), rank.cast("long"))).alias("rank")) for name, rank in ranks.items()]))
    held = upto.select("k", CELL, "n", (F.col("upto") - F.col("c")).alias("before"), "upto", wanted.alias("r")).where((F.col("r.rank") > F.col("before")) & (F.col("r.rank") <= F.col("upto")))
    held = settled(held.select("k", CELL, "n", F.col("r.name").alias("name"), (F.col("r.rank") - F.col("before")).alias("place")))
    few = dealt.join(held.select("k", CELL).distinct(), ["k", CELL], "left_semi")
    run = few.withColumn("reach", F.sum("c").over(Window.partitionBy("k", CELL).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    hit = run.join(held, ["k", CELL]).where((F.col("place") <= F.col("reach")) & (F.col("place") > F.col("reach") - F.col("c")))
    return hit.groupBy("k").agg(F.first("n").alias("n"), *[F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in ranks]).select("k.*", "n", *ranks)


def quantiles(rows: DataFrame, key: list[str], value: str, size: int = ROWS) -> DataFrame:
    """key, n, median, q1 and q3 by the exclusive rule; with fewer than four values the quartiles are the extremes."""
    n = F.col("n")
    place = {"q1": (n + 1) * 0.25, "q3": (n + 1) * 0.75}
    low = {q: F.least(F.greatest(F.floor(p), F.lit(1)), F.greatest(n - 1, F.lit(1))) for q, p in place.items()}
    ranks = {"m_low": F.floor((n + 1) / 2), "m_high": F.ceil((n + 1) / 2), "x_min": F.lit(1), "x_max": n}
    for q, a in low.items():
        ranks |= {f"{q}_low": a, f"{q}_high": a + 1}
    got = selected(rows, key, value, ranks, size)
    at = {q: F.col(f"{q}_low") + (F.col(f"{q}_high") - F.col(f"{q}_low")) * (place[q] - low[q]) for q in place}
    edge = {"q1": F.col("x_min"), "q3": F.col("x_max")}
    shown = [F.when(n < 4, edge[q]).otherwise(at[q]).cast("double").alias(q) for q in place]
    return got.select(*key, "n", ((F.col("m_low") + F.col("m_high")) / 2).cast("double").alias("median"), *shown)

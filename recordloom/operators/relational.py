"""Joins, keyed picks, sequences and runs that the record pipelines are made of."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators import ranges


def accepted(rows: DataFrame, keys: list[str], ok: Column, order: str, value: Column) -> DataFrame:
    """The last row for which `ok` holds, else the first one seen, of each key."""
    tagged = rows.select(*keys, ok.alias("__ok"), F.col(order).alias("__at"), value.alias("__v"))
    best = F.max_by("__v", F.when(F.col("__ok"), F.col("__at")))
    return tagged.groupBy(*keys).agg(F.when(F.bool_or("__ok"), best).otherwise(F.min_by("__v", "__at")).alias("accepted")).select(*keys, "accepted.*")


def first_ok(rows: DataFrame, keys: list[str], ok: Column, order: str, value: Column) -> DataFrame:
    """The first row for which `ok` holds, of the keys that have one."""
    return rows.where(ok).groupBy(*keys).agg(F.min_by(value, order).alias("first")).select(*keys, "first.*")


def ranked(rows: DataFrame, key: str, name: str, width: int = 4096) -> DataFrame:
    """Rows numbered from 1 by an integer key, without one task for all.

    Ranges of `width` keys are counted, the counts are summed up over the small table of ranges, and
    rows are numbered within their range.
    """
    cell = F.floor(F.col(key) / width)
    counts = rows.groupBy(cell.alias("__cell")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"))
    within = F.row_number().over(Window.partitionBy("__cell").orderBy(key))
    return rows.withColumn("__cell", cell).join(ahead, "__cell").withColumn(name, F.col("__ahead") + within).drop("__cell", "__ahead")


def continued(known: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """key, seq: known keys keep theirs, new keys go on after the largest, in key order."""
    top = known.agg(F.coalesce(F.max(seq), F.lit(0)).alias("__top"))
    fresh = ranked(new.select(key).join(known.select(key), key, "left_anti").distinct(), key, "__n")
    return known.select(key, seq).unionByName(fresh.crossJoin(F.broadcast(top)).select(key, (F.col("__top") + F.col("__n")).alias(seq)))


def runs(rows: DataFrame, keys: list[str], order: list[str], value: str, size: int = ranges.ROWS) -> DataFrame:
    """keys, n_runs, longest of the runs of equal consecutive values; `order` is unique in a key, whose rows may lie in several ranges."""
    last = ranges.before(rows.select(*keys, *order, value), keys, order, value, "__last", size)
    changed = F.col("__last.is_first") | ~F.col(value).eqNullSafe(F.col("__last.value"))
    marked = ranges.running_total(last.withColumn("__new", changed.cast("long")), keys, order, "__new", "__run", size)
    return marked.groupBy(*keys, "__run").agg(F.count("*").alias("__n")).groupBy(*keys).agg(F.count("*").alias("n_runs"), F.max("__n").alias("longest"))


def reserved_names(rows: DataFrame, key: str, stem: Column, known: DataFrame | None = None) -> DataFrame:
    """key, name: a key that is in `known` (key, name) keeps its name; of the others the first of each stem that no known name is gets it, all later ones get the key as a suffix.

    The first is found by an aggregate, so that a frequent stem is not one task's rows.
    """
    stems = rows.select(key, stem.alias("stem"))
    if known is not None:
        stems = stems.join(known.select(key), key, "left_anti")
    first = stems.groupBy("stem").agg(F.min(key).alias("__first"))
    if known is not None:
        first = first.join(known.select(F.col("name").alias("stem")).distinct(), "stem", "left_anti")
    named = stems.join(first, "stem", "left").select(key, F.when(F.col(key) == F.col("__first"), F.col("stem")).otherwise(F.concat_ws("_", "stem", F.col(key).cast("string"))).alias("name"))
    return named if known is None else named.unionByName(known.select(key, "name"))


def section(rows: DataFrame, group: str, pos: str, level: str, wanted: Column) -> DataFrame:
    """Rows strictly after the first wanted heading and before the next heading of its level or above.

    `level` is null for rows that are no headings.
    """
    start = rows.where(wanted & F.col(level).isNotNull()).groupBy(group).agg(F.min_by(F.struct(F.col(pos).alias("p"), F.col(level).alias("l")), pos).alias("s"))
    joined = rows.join(start, group)
    stop = joined.where((F.col(pos) > F.col("s.p")) & (F.col(level) <= F.col("s.l"))).groupBy(group).agg(F.min(pos).alias("__stop"))
    return joined.join(stop, group, "left").where((F.col(pos) > F.col("s.p")) & (F.col("__stop").isNull() | (F.col(pos) < F.col("__stop")))).select(rows.columns)


def heading_of(rows: DataFrame, group: str, pos: str, heading: Column, name: str) -> DataFrame:
    """Every row with the last heading at or before it."""
    w = Window.partitionBy(group).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(heading, ignorenulls=True).over(w))


def interval_conflicts(slots: DataFrame, group: list[str], item: str, start: str, end: str, cell: int = 60) -> DataFrame:
    """group, a, b of the items (a before b) of a group whose half-open intervals overlap.

    Intervals are listed in the time cells that they touch, which makes an equi-join of the range
    join; a pair is reported in the cell where the later of the two begins.
    """
    cells = slots.where(F.col(start) < F.col(end)).withColumn("__cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor((F.col(end) - 1) / cell))))
    a = cells.select(*group, "__cell", F.col(item).alias("a"), F.col(start).alias("as"), F.col(end).alias("ae"))
    b = cells.select(*group, "__cell", F.col(item).alias("b"), F.col(start).alias("bs"), F.col(end).alias("be"))
    meet = (F.col("a") < F.col("b")) & (F.col("as") < F.col("be")) & (F.col("bs") < F.col("ae")) & (F.col("__cell") == F.floor(F.greatest("as", "bs") / cell))
    return a.join(b, [*group, "__cell"]).where(meet).select(*group, "a", "b").distinct()


def prefix_index(entries: DataFrame) -> DataFrame:
    """prefix -> entry from (ord, kind, prefix, entry): exact rows win, the last of them; else the first alias or fallback."""
    place = F.struct((F.col("kind") == "exact").cast("int").alias("x"), F.when(F.col("kind") == "exact", F.col("ord")).otherwise(-F.col("ord")).alias("o"))
    return entries.groupBy("prefix").agg(F.max_by("entry", place).alias("entry"))


def fold_status(severity: Column) -> Column:
    """pass, warning or fail of the worst severity 0, 1, 2."""
    worst = F.coalesce(F.max(severity), F.lit(0))
    return F.when(worst >= 2, "fail").when(worst == 1, "warning").otherwise("pass")


def frequency_label(n: Column, total: Column) -> Column:
    """How often something is offered in `total` terms."""
    return F.when(n >= total - 1, "every").when(n >= F.floor(total / 2), "most").when(n == 1, "rarely").otherwise("occasionally")


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str]) -> DataFrame:
    """Rows of both by key: new values win where given, but the columns `keep` stay as first written."""
    columns = [c for c in old.columns if c not in key]
    o = old.select(*key, *[F.col(c).alias(f"__o_{c}") for c in columns], F.lit(True).alias("__old"))
    n = new.select(*key, *[F.col(c).alias(f"__n_{c}") for c in columns])
    pick = lambda c: F.coalesce(f"__o_{c}", f"__n_{c}") if c in keep else F.coalesce(f"__n_{c}", f"__o_{c}")
    return o.join(n, key, "full").select(*key, *[pick(c).alias(c) for c in columns])


def keep_last(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    value = F.struct(*rows.columns)
    return rows.groupBy(*key).agg(F.max_by(value, order).alias("__r")).select("__r.*")


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """`old` and the rows of `new` whose key it lacks."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti").select(old.columns))


def update_where(rows: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """`rows` with new values where the condition holds; an unknown condition changes nothing."""
    return rows.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    """`rows` without those for which the condition is known to hold."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def keyed(rows: DataFrame, group: list[str], key: str, value: str) -> DataFrame:
    """One row a group, whose `entries` map keys to values; keys are unique within a group, and a group is one record."""
    return rows.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("entries"))

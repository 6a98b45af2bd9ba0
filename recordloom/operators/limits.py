"""What a plan can break: requirements that a course is claimed for twice, and limits on units.

Courses are assigned to requirements so that none counts twice: requirements are filled in their order, each as far as
the earlier ones allow, by augmenting paths.  A student's courses that fit the same requirements are one kind, so what is
solved for a student is a graph of kinds and requirements, however many courses there are; students are spread.  Limits
are running sums in the order of the courses.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.ranges import ROWS, running_total

#: Ranks below which Spark limits the groups of a window before it shuffles them.
LIMITED = 1_000


def flows(kinds: dict[int, int], needs: list[int]) -> dict[tuple[int, int], int]:
    """(kind, requirement) -> courses, for kinds (bit r set: fits requirement r) with their numbers; every flow is above 0.

    A requirement that is short asks along a path: a kind that fits it gives a course that is free, or one that
    another requirement holds and can replace.
    """
    free, held = dict(kinds), {}
    for wanted, need in enumerate(needs):
        left = need
        while left:
            came: dict[int, tuple[int, int]] = {}  # requirement -> the kind that it would give up, and who asked
            todo, end = [wanted], None
            while todo and end is None:
                r = todo.pop(0)
                for kind in sorted(free):
                    if not kind >> r & 1:
                        continue
                    if free[kind]:
                        end = (kind, r)
                        break
                    for other in range(len(needs)):
                        if other != wanted and other not in came and held.get((kind, other)):
                            came[other] = (kind, r)
                            todo.append(other)
            if end is None:
                break
            steps = [end]
            while steps[-1][1] != wanted:
                steps.append(came[steps[-1][1]])
            amount = min([left, free[end[0]], *(held[kind, steps[k][1]] for k, (kind, _) in enumerate(steps[1:]))])
            free[end[0]] -= amount
            for k, (kind, r) in enumerate(steps):
                held[kind, r] = held.get((kind, r), 0) + amount
                if k:  # what the requirement before gives up
                    held[kind, steps[k - 1][1]] -= amount
            left -= amount
    return {k: n for k, n in held.items() if n}


def _kinds(courses: DataFrame, student: str, fits: list[Column]) -> DataFrame:
    mask = sum((F.when(F.coalesce(c, F.lit(False)), 1 << r).otherwise(0) for r, c in enumerate(fits)), F.lit(0))
    return courses.withColumn("kind", mask.cast("int")).where(F.col(student).isNotNull() & (F.col("kind") > 0))


def assigned_kinds(courses: DataFrame, student: str, fits: list[Column], needs: list[int]) -> DataFrame:
    """(student, kind, requirement, n, before): how many courses of a kind go to a requirement (from 1), after how many that go to earlier ones."""
    counted = _kinds(courses, student, fits).groupBy(student, "kind").agg(F.count("*").alias("n"))
    graph = counted.groupBy(student).agg(F.collect_list(F.struct("kind", "n")).alias("kinds"))  # at most a row for each set of requirements

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for k, kinds in enumerate(b.column(1).to_pylist()):
                before: dict[int, int] = {}
                for (kind, r), n in sorted(flows({x["kind"]: x["n"] for x in kinds}, needs).items(), key=lambda f: (f[0][1], f[0][0])):
                    rows.append((k, kind, r + 1, n, before.get(kind, 0)))
                    before[kind] = before.get(kind, 0) + n
            at, *rest = zip(*rows, strict=True) if rows else [()] * 5
            kinds_of = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(rest, kinds_of, strict=True))], [student, "kind", "requirement", "n", "before"])

    kind = courses.schema[student].dataType.simpleString()
    return graph.mapInArrow(run, f"`{student}` {kind}, kind int, requirement int, n long, before long")


def fills(courses: DataFrame, student: str, fits: list[Column], needs: list[int]) -> DataFrame:
    """(student, requirement, need, filled) of every student with a course: requirements in order, each filled as far as the earlier ones allow."""
    made = assigned_kinds(courses, student, fits, needs).groupBy(student, "requirement").agg(F.sum("n").alias("filled"))
    each = F.explode(F.array(*[F.struct(F.lit(r + 1).alias("requirement"), F.lit(n).cast("long").alias("need")) for r, n in enumerate(needs)]))
    every = courses.where(F.col(student).isNotNull()).select(student).distinct().select(student, each.alias("r")).select(student, "r.requirement", "r.need")
    return every.join(made, [student, "requirement"], "left").select(student, "requirement", "need", F.coalesce("filled", F.lit(0)).alias("filled"))


def assignments(courses: DataFrame, student: str, order: list[str], fits: list[Column], needs: list[int], size: int = ROWS) -> DataFrame:
    """(student, *order, requirement) of every course that counts for a requirement; the first courses of a kind are taken first."""
    rows, most = _kinds(courses, student, fits).select(student, *order, "kind"), sum(needs)
    if most < LIMITED:  # no kind gives more than all needs: Spark drops the others before it shuffles, so that a hot student is few rows
        numbered = rows.withColumn("number", F.row_number().over(Window.partitionBy(student, "kind").orderBy(*order))).where(F.col("number") <= most)
    else:
        numbered = running_total(rows.withColumn("one", F.lit(1).cast("long")), [student, "kind"], order, "one", "number", size)
    ranges = assigned_kinds(courses, student, fits, needs).withColumnRenamed("kind", "of_kind").withColumnRenamed(student, "of_student")
    mine = (F.col(student) == F.col("of_student")) & (F.col("kind") == F.col("of_kind")) & (F.col("number") > F.col("before")) & (F.col("number") <= F.col("before") + F.col("n"))
    return numbered.join(ranges, mine).select(student, *order, "requirement")


def over_limits(courses: DataFrame, student: str, order: list[str], units: str, limits: dict[str, tuple[Column, float]], size: int = ROWS) -> DataFrame:
    """(student, limit, *order, units, upto, over) of every course with which a student passes a limit or is past it; null units count as none.

    A limit is what courses it is on, and how many units of them count at most; `over` are the units that don't.
    """
    each = F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(name).alias("limit"), F.lit(float(most)).alias("most"))) for name, (c, most) in limits.items()])))
    rows = courses.where(F.col(student).isNotNull()).select(student, *order, F.col(units).cast("double").alias("units"), each.alias("l")).select(student, *order, "units", "l.limit", "l.most")
    summed = running_total(rows, [student, "limit"], order, "units", "upto", size).where(F.col("upto") > F.col("most"))
    return summed.select(student, "limit", *order, "units", "upto", F.least("units", F.col("upto") - F.col("most")).alias("over")).where((F.col("units") > 0) & (F.col("over") > 0))

"""As-of joins, limits that a plan can break, and passages of a benchmark, over the given tables."""

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators import containment, limits, ranges
from recordloom.registry import query
from recordloom.sources.tables import table


@query("as_of_purchase", """
with g as (select user_id, ts, max(event_id) as event_id from events where event_type = 'purchase' group by user_id, ts)
select e.event_id, e.user_id, g.event_id as last_event_id, (select max(v.value) from events v where v.event_id = g.event_id) as last_value
from events e asof left join g on e.user_id = g.user_id and e.ts > g.ts
""")  # fmt: skip
def as_of_purchase(spark: SparkSession, sf: str) -> DataFrame:
    """Each event with its user's last earlier purchase."""
    events = table(spark, sf, "events")
    return ranges.as_of(events.select("event_id", "user_id", "ts"), events.where("event_type = 'purchase'"), "user_id", "ts", "event_id", ["event_id", "value"]).drop("ts")


SQL_COURSES = """
with c as (select o_custkey as student, l_orderkey, l_linenumber, l_quantity as units, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus from lineitem join orders on o_orderkey = l_orderkey)
"""


def _courses(spark: SparkSession, sf: str) -> DataFrame:
    """What a customer ordered, as the courses of a student."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("units"), "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus")
    return lines.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("student")), "l_orderkey")


#: What tells a customer's lines apart, in their order.
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LIMITS = {"physical education": ("l_suppkey % 7 = 0", 40), "music": ("l_suppkey % 7 = 1", 80), "pass or no pass": ("l_returnflag = 'R'", 240), "upper division": ("l_linestatus = 'F' and units > 25", 400)}


@query("unit_limits", SQL_COURSES + ", e as (" + " union all ".join(f"select *, '{k}' as \"limit\", {float(most)}::double as most from c where {c}" for k, (c, most) in LIMITS.items()) + """),
s as (select *, sum(units) over (partition by student, "limit" order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice rows between unbounded preceding and current row) as upto from e)
select student, "limit", l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, cast(units as double) as units, cast(upto as double) as upto, cast(least(units, upto - most) as double) as over from s where upto > most and least(units, upto - most) > 0
""")  # fmt: skip
def unit_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Courses with which a student passes a limit, and the units that no longer count."""
    return limits.over_limits(_courses(spark, sf), "student", ORDER, "units", {k: (F.expr(c), most) for k, (c, most) in LIMITS.items()})


FITS = ["l_suppkey % 5 < 2", "l_returnflag = 'R'", "l_linestatus = 'F' and units > 25", "l_suppkey % 5 = 1 or l_returnflag = 'A'"]
NEEDS = [8, 10, 12, 16]


def _sql_fills() -> str:
    """By counting: a set of requirements can be filled as far as the least, over its parts, of the courses that fit the part and the needs of the rest."""
    n = len(NEEDS)
    parts = [s for k in range(n + 1) for s in combinations(range(n), k)]
    counts = ", ".join(f"count(*) filter ((m & {sum(1 << r for r in s)}) <> 0) as n{sum(1 << r for r in s)}" for s in parts if s)
    reach = lambda k: "least(" + ", ".join((f"n{sum(1 << r for r in s)} + " if s else "") + str(sum(NEEDS[r] for r in range(k) if r not in s)) for s in parts if all(r < k for r in s)) + ")"
    mask = " + ".join(f"case when {c} then {1 << r} else 0 end" for r, c in enumerate(FITS))
    rows = " union all ".join(f"select student, {k} as requirement, {NEEDS[k - 1]}::bigint as need, {reach(k)}{f' - {reach(k - 1)}' if k > 1 else ''} as filled from g" for k in range(1, n + 1))
    return SQL_COURSES + f", g as (select student, {counts} from (select student, {mask} as m from c) group by student) {rows}"


@query("plan_fills", _sql_fills())
def plan_fills(spark: SparkSession, sf: str) -> DataFrame:
    """How far each student's courses fill each requirement when none counts twice."""
    return limits.fills(_courses(spark, sf), "student", [F.expr(c) for c in FITS], NEEDS)


@query("plan_assignments", _sql_fills().replace("union all select", "union all\nselect").join(["with f as (", ") select student, sum(filled)::bigint as assigned, sum(filled)::bigint as courses from f group by student having sum(filled) > 0"]))
def plan_assignments(spark: SparkSession, sf: str) -> DataFrame:
    """How many courses of each student are assigned to a requirement, and how many different ones: none twice."""
    made = limits.assignments(_courses(spark, sf), "student", ORDER, [F.expr(c) for c in FITS], NEEDS)
    return made.groupBy("student").agg(F.count("*").alias("assigned"), F.countDistinct(*ORDER).alias("courses"))


@query("doc_benchmark_overlap", "select doc_id, item_id from documents d, benchmark b where length(b.text) > 0 and contains(d.text, b.text)")
def doc_benchmark_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Every document that holds the whole text of a benchmark item."""
    return containment.contained_strings(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "benchmark"), "item_id", "text")

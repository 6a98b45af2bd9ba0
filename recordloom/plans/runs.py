"""Streaming runs over the given tables: budgets kept by state, and states committed batch by batch."""

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.registry import query
from recordloom.sources.tables import table
from recordloom.streaming import budget, run
from recordloom.streaming.versions import Versions


def arriving(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table as a stream; the pattern lets a single file be one."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


@query("retry_budget", """
with e as (select cast(user_id as varchar) as key, event_id as id, ts, coalesce(event_type <> 'purchase', false) as failed from events where user_id is not null and ts is not null),
w as (select *, case when not failed or ts - lag(ts) over (partition by key order by ts, id) > interval 3 day then 1 else 0 end as fresh from e),
g as (select *, sum(fresh) over (partition by key order by ts, id rows between unbounded preceding and current row) as run from w),
n as (select *, count(case when failed then 1 end) over (partition by key, run order by ts, id rows between unbounded preceding and current row) as attempt from g)
select key, id, failed, cast(attempt as int) as attempt, attempt > 3 as refused from n
""")  # fmt: skip
def retry_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Every event that is no purchase as a failed attempt of its user: three, until a purchase or a pause of three days."""
    at = budget.fresh(spark, "budget")
    rows = budget.attempts(arriving(spark, sf, "events"), "user_id", "event_id", F.col("event_type") != "purchase")
    budget.run(budget.budgeted(rows, 3, datetime.timedelta(days=3)), at)
    return budget.results(spark, at).select("key", "id", "failed", "attempt", "refused")


# fixed values: what the given tables' codes stand for
CLASSES = {"1-URGENT": "included", "2-HIGH": "included", "3-MEDIUM": "excluded_graduate", "4-NOT SPECIFIED": "manual_review", "5-LOW": "excluded_other"}
STATUSES = {"F": "complete", "O": "pending", "P": "failed"}


def _case(column: str, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def _sql_case(column: str, values: dict[str, str]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in values.items()) + " end"


SQL_STATES = f"with s as (select o_orderkey as key, o_custkey as seq, {_sql_case('o_orderpriority', CLASSES)} as class, {_sql_case('o_orderstatus', STATUSES)} as status from orders),\n"
SQL_STATES += "x as (select *, case when status = 'failed' then 'errors' when class = 'included' then 'included' when class like 'excluded\\_%' escape '\\' then 'excluded' else 'review' end as extract from s)\n"


def _finished(spark: SparkSession, sf: str) -> Versions:
    """The states of all orders after a run over them."""
    at = budget.fresh(spark, "run")
    states = run.states(spark, f"{at}/states")
    rows = arriving(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").cast("long").alias("seq"), _case("o_orderpriority", CLASSES).alias("class"), _case("o_orderstatus", STATUSES).alias("status"), F.col("o_orderdate").cast("timestamp").alias("updated"))
    run.process(rows, states, f"{at}/checkpoint", "first")
    return states


@query("run_extracts", SQL_STATES + "select extract, key, seq, class, status from x")
def run_extracts(spark: SparkSession, sf: str) -> DataFrame:
    """The four accounting extracts of the last commit of a run over the orders."""
    return run.regenerated(_finished(spark, sf))


@query("run_provenance", SQL_STATES + """
select 'first' as run, count(*) as touched, count(*) filter (extract = 'included') as included, count(*) filter (extract = 'excluded') as excluded, count(*) filter (extract = 'review') as review,
       count(*) filter (extract = 'errors') as errors, count(*) filter (class = 'included' and status = 'pending') as pending from x
""")  # fmt: skip
def run_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """What each committed version of the run held."""
    return run.provenance(_finished(spark, sf)).groupBy("run").agg(F.sum("touched").alias("touched"), *[F.max_by(c, "version").alias(c) for c in ("included", "excluded", "review", "errors", "pending")])

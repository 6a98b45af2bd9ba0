"""Joins, aggregates, windows and sets over the star tables, each with its SQL."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.functions import text as tx
from recordloom.functions import unicode as uni
from recordloom.operators import audit, ranges
from recordloom.operators import relational as rel
from recordloom.registry import query
from recordloom.sources.tables import table
from recordloom.streaming.budget import fresh


def _ok() -> Column:
    return F.col("event_type") != "error"


_event = lambda: F.struct("event_id", "event_type", "value")


@query("fetch_accepted", """
select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by event_type <> 'error' desc, case when event_type <> 'error' then -event_id else event_id end) as r from events) where r = 1
""")  # fmt: skip
def fetch_accepted(spark: SparkSession, sf: str) -> DataFrame:
    return rel.accepted(table(spark, sf, "events"), ["user_id"], _ok(), "event_id", _event())


@query("fetch_first_ok", "select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by event_id) as r from events where event_type <> 'error') where r = 1")
def fetch_first_ok(spark: SparkSession, sf: str) -> DataFrame:
    return rel.first_ok(table(spark, sf, "events"), ["user_id"], _ok(), "event_id", _event())


@query("runtime_stats", """
with g as (select event_type, list(value order by value) as a, count(*) as n, min(value) as mn, max(value) as mx, avg(value) as mean, median(value) as median, stddev_pop(value) as stdev from events where value > 0 group by event_type),
p as (select *, (n + 1) * 0.25 as p1, (n + 1) * 0.75 as p3 from g),
r as (select *, greatest(1, least(n - 1, cast(floor(p1) as bigint))) as l1, greatest(1, least(n - 1, cast(floor(p3) as bigint))) as l3 from p),
q as (select *, case when n < 4 then mn else a[l1] + (a[l1 + 1] - a[l1]) * (p1 - l1) end as q1, case when n < 4 then mx else a[l3] + (a[l3 + 1] - a[l3]) * (p3 - l3) end as q3 from r)
select event_type, n, mn as min, mx as max, mean, median, stdev, q1, q3, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as low_fence, q3 + 1.5 * (q3 - q1) as high_fence from q
""")  # fmt: skip
def runtime_stats(spark: SparkSession, sf: str) -> DataFrame:
    return audit.describe(table(spark, sf, "events"), ["event_type"], "value")


@query("runtime_buckets", """
select event_type, cast(hour(ts) as int) as hour, count(*) as n, count(*) filter (where value > 50) as slow, cast(count(*) filter (where value > 50) as double) / count(*) as rate, median(value) as median
from events group by grouping sets ((event_type), (hour(ts)), ())
""")  # fmt: skip
def runtime_buckets(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_type", F.hour("ts").alias("hour"), "value")
    # each row counts for its type, for its hour and for all; the set tells a missing type from one that is summed over
    of = lambda s, e, h: F.struct(F.lit(s).alias("s"), e.alias("event_type"), h.alias("hour"))
    e, h, no_e, no_h = F.col("event_type"), F.col("hour"), F.lit(None).cast("string"), F.lit(None).cast("int")
    sets = F.explode(F.array(of(1, e, no_h), of(2, no_e, h), of(3, no_e, no_h)))
    each = rows.select(sets.alias("k"), "value")
    slow = F.count_if(F.col("value") > 50)
    counts = each.groupBy("k").agg(F.count("*").alias("n"), slow.alias("slow"), (slow / F.count("*")).alias("rate"))
    middle = ranges.quantiles(each, ["k"], "value").select("k", "median")
    return counts.join(middle, "k", "left").select("k.event_type", "k.hour", "n", "slow", "rate", "median")


@query("runtime_percentile", "select event_type, avg(case when value <= 25 then 1.0::double else 0.0::double end) * 100 as share from events group by event_type")
def runtime_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg((F.avg((F.col("value") <= 25).cast("double")) * 100).alias("share"))


@query("mode_counts", "select event_type, count(*) as n from events group by event_type")
def mode_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("status_counts_with_zero", "select s.status, count(o.o_orderkey) as n from (values ('F'), ('O'), ('P'), ('X')) s(status) left join orders o on o.o_orderstatus = s.status group by s.status")
def status_counts_with_zero(spark: SparkSession, sf: str) -> DataFrame:
    known = spark.createDataFrame([(s,) for s in "FOPX"], "status string")
    counts = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return known.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query("sequence_continue", """
with known as (select doc_id, doc_id * 2 as seq from labels), top as (select coalesce(max(seq), 0) as t from known)
select * from known union all select doc_id, t + row_number() over (order by doc_id) as seq from documents, top where not exists (select 1 from known where known.doc_id = documents.doc_id)
""")  # fmt: skip
def sequence_continue(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents keep their numbers, all others go on after them."""
    known = table(spark, sf, "labels").select("doc_id", (F.col("doc_id") * 2).alias("seq"))
    return rel.continued(known, table(spark, sf, "documents").select("doc_id"), "doc_id", "seq")


@query("dedup_links", """
select l_partkey, l_suppkey, l_orderkey, l_linenumber, n - 1 as dropped from (select *, row_number() over w as r, count(*) over (partition by l_partkey, l_suppkey) as n from lineitem window w as (partition by l_partkey, l_suppkey order by l_orderkey, l_linenumber)) where r = 1
""")  # fmt: skip
def dedup_links(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("f"), (F.count("*") - 1).alias("dropped"))
    return rows.select("l_partkey", "l_suppkey", "f.l_orderkey", "f.l_linenumber", "dropped")


@query("link_sequence", """
with f as (select l_suppkey, l_partkey, min(l_orderkey) as o from lineitem group by l_suppkey, l_partkey)
select l_suppkey, l_partkey, cast(row_number() over (partition by l_suppkey order by o, l_partkey) as int) as seq from f
""")  # fmt: skip
def link_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier's parts numbered by their first order, by ranges, so that a supplier of very many is not one task's."""
    first = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_orderkey").alias("o")).withColumn("one", F.lit(1))
    numbered = ranges.running_total(first, ["l_suppkey"], ["o", "l_partkey"], "one", "seq")
    return numbered.select("l_suppkey", "l_partkey", F.col("seq").cast("int").alias("seq"))


@query("filename_reserve", """
with s as (select p_partkey, p_size <= 25 as early, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') as stem from part),
known as (select p_partkey, case when p_partkey = min(p_partkey) over (partition by stem) then stem else stem || '_' || p_partkey end as name from s where early)
select p_partkey, name from known union all
select p_partkey, case when p_partkey = min(p_partkey) over (partition by stem) and stem not in (select name from known) then stem else stem || '_' || p_partkey end from s where not early
""")  # fmt: skip
def filename_reserve(spark: SparkSession, sf: str) -> DataFrame:
    """Names of all parts: those of an earlier run, of the smaller parts, are stored, read back and kept."""
    at, parts, stem = fresh(spark, "names"), table(spark, sf, "part"), tx.slug(F.col("p_name"))
    rel.reserved_names(parts.where("p_size <= 25"), "p_partkey", stem).write.parquet(at)
    return rel.reserved_names(parts, "p_partkey", stem, spark.read.schema("p_partkey long, name string").parquet(at))


@query("file_slugs", r"""
with w as (select doc_id, array_to_string(string_split(coalesce(text, ''), ' ')[1:6], ' ') as t from documents),
s as (select doc_id, regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(t), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as s from w)
select doc_id, case when s = '' then 'program' else regexp_replace(substr(s, 1, 70), '_+$', '') end as name from s
""")  # fmt: skip
def file_slugs(spark: SparkSession, sf: str) -> DataFrame:
    """A file name of the first words of every document, accents dropped."""
    words = F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 6), " ")
    return table(spark, sf, "documents").select("doc_id", words.alias("t")).select("doc_id", uni.name_slug(F.col("t")).alias("name"))


@query("stable_runs", """
with m as (select user_id, ts, event_id, case when event_type is not distinct from lag(event_type) over w and lag(1) over w is not null then 0 else 1 end as fresh from events window w as (partition by user_id order by ts, event_id)),
r as (select user_id, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from m), c as (select user_id, run, count(*) as n from r group by user_id, run)
select user_id, count(*) as n_runs, max(n) as longest from c group by user_id
""")  # fmt: skip
def stable_runs(spark: SparkSession, sf: str) -> DataFrame:
    return rel.runs(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("pacing_gaps", """
select user_id, min(gap) as least, max(gap) as most, count(gap) as n from (select user_id, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as gap from events) group by user_id
""")  # fmt: skip
def pacing_gaps(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("user_id", (at - F.lag(at).over(w)).alias("gap")).groupBy("user_id").agg(F.min("gap").alias("least"), F.max("gap").alias("most"), F.count("gap").alias("n"))


SECTIONS = "with h as (select *, case when role = 'user' then 2 when length(text) < 60 then 3 end as level from conversations)"


def _headed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", 2).when(F.length("text") < 60, 3).alias("level"))


@query("section_slice", SECTIONS + """,
s as (select conv_id, min(turn) as p, arg_min(level, turn) as l from h where level = 2 and turn > 0 group by conv_id),
e as (select h.conv_id, min(h.turn) as stop from h join s using (conv_id) where h.turn > s.p and h.level <= s.l group by h.conv_id)
select h.conv_id, h.turn, h.level from h join s using (conv_id) left join e using (conv_id) where h.turn > s.p and (e.stop is null or h.turn < e.stop)
""")  # fmt: skip
def section_slice(spark: SparkSession, sf: str) -> DataFrame:
    return rel.section(_headed(spark, sf), "conv_id", "turn", "level", (F.col("level") == 2) & (F.col("turn") > 0))


@query("section_headings", SECTIONS + " select conv_id, turn, last_value(case when level is not null then turn end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as heading from h")
def section_headings(spark: SparkSession, sf: str) -> DataFrame:
    return rel.heading_of(_headed(spark, sf), "conv_id", "turn", F.when(F.col("level").isNotNull(), F.col("turn")), "heading").select("conv_id", "turn", "heading")


@query("first_last_included", """
select o_orderpriority, min(o_orderkey) as first_key, max(o_orderkey) as last_key, arg_min(o_totalprice, o_orderkey) as first_price, arg_max(o_totalprice, o_orderkey) as last_price from orders where o_orderstatus = 'O' group by o_orderpriority
""")  # fmt: skip
def first_last_included(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").where("o_orderstatus = 'O'").groupBy("o_orderpriority")
    return rows.agg(F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"), F.min_by("o_totalprice", "o_orderkey").alias("first_price"), F.max_by("o_totalprice", "o_orderkey").alias("last_price"))


@query("offering_frequency", """
with t as (select count(distinct year(l_shipdate)) as total from lineitem), o as (select distinct l_partkey, year(l_shipdate) as term from lineitem),
g as (select l_partkey, count(*) as n, string_agg(cast(term as varchar), ',' order by term) as terms from o group by l_partkey)
select l_partkey, n, terms, case when n >= total - 1 then 'every' when n >= total // 2 then 'most' when n = 1 then 'rarely' else 'occasionally' end as label from g, t
""")  # fmt: skip
def offering_frequency(spark: SparkSession, sf: str) -> DataFrame:
    offered = table(spark, sf, "lineitem").select("l_partkey", F.year("l_shipdate").alias("term")).distinct()
    total = offered.agg(F.count_distinct("term").alias("total"))
    g = offered.groupBy("l_partkey").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("term")), lambda x: x.cast("string")), ",").alias("terms"))
    return g.crossJoin(F.broadcast(total)).select("l_partkey", "n", "terms", rel.frequency_label(F.col("n"), F.col("total")).alias("label"))


@query("seat_projection", """
select p_partkey, p_size as total, coalesce(n, 0) as registered, greatest(0, coalesce(p_size, 0) - coalesce(n, 0)) as open_seats from part left join (select l_partkey, count(*) as n from lineitem group by l_partkey) on l_partkey = p_partkey
""")  # fmt: skip
def seat_projection(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf, "part").join(n, "p_partkey", "left")
    return rows.select("p_partkey", F.col("p_size").alias("total"), F.coalesce("n", F.lit(0)).alias("registered"), F.greatest(F.lit(0), F.coalesce("p_size", F.lit(0)) - F.coalesce("n", F.lit(0))).alias("open_seats"))


@query("rollup_flags", """
select o_orderkey, coalesce(bool_or(l_returnflag = 'R'), false) as any_returned, coalesce(bool_or(l_tax > 0.07), false) as any_taxed, count(l_orderkey) as n_lines, count(*) filter (where l_linestatus = 'O') as n_open
from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey
""")  # fmt: skip
def rollup_flags(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_tax") > 0.07).alias("t"), F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("o")
    )
    rows = table(spark, sf, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    zero = lambda c, v, n: F.coalesce(c, F.lit(v)).alias(n)
    return rows.select("o_orderkey", zero("r", False, "any_returned"), zero("t", False, "any_taxed"), zero("n", 0, "n_lines"), zero("o", 0, "n_open"))


SQL_TAKEN = "with x as (select distinct o_custkey as cust, o_orderstatus as s, l_partkey as part from orders join lineitem on l_orderkey = o_orderkey)"


def _taken(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("part"))
    return table(spark, sf, "orders").join(lines, "o_orderkey").select(F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("s"), "part").distinct()


@query("already_taken", SQL_TAKEN + """
select p.cust, p.part, case when exists (select 1 from x where x.s = 'F' and x.cust = p.cust and x.part = p.part) then 'fail' else 'warning' end as status from x p
where p.s = 'O' and exists (select 1 from x where x.s <> 'O' and x.cust = p.cust and x.part = p.part)
""")  # fmt: skip
def already_taken(spark: SparkSession, sf: str) -> DataFrame:
    rows = _taken(spark, sf)
    worst = rows.where("s <> 'O'").groupBy("cust", "part").agg(F.max((F.col("s") == "F").cast("int")).alias("done"))
    return rows.where("s = 'O'").join(worst, ["cust", "part"]).select("cust", "part", F.when(F.col("done") == 1, "fail").otherwise("warning").alias("status"))


@query("missing_prereq", SQL_TAKEN + """,
need as (select p_partkey as part, unnest([(p_partkey + 13) % 200, (p_partkey + 26) % 200, (p_partkey + 39) % 200]) as req from part),
asked as (select distinct cust, part, req from (select distinct cust, part from x where s = 'O') join need using (part) where req <> part)
select cust, part, count(*) as n, string_agg(cast(req as varchar), ',' order by req) as missing from asked where not exists (select 1 from x where x.s = 'F' and x.cust = asked.cust and x.part = asked.req) group by cust, part
""")  # fmt: skip
def missing_prereq(spark: SparkSession, sf: str) -> DataFrame:
    """What each open course of a customer requires and the customer has not completed: equal joins, three requirements a course."""
    p = F.col("p_partkey")
    need = table(spark, sf, "part").select(p.alias("part"), F.explode(F.array((p + 13) % 200, (p + 26) % 200, (p + 39) % 200)).alias("req")).where("req <> part").distinct()
    taken = _taken(spark, sf)
    asked = taken.where("s = 'O'").select("cust", "part").distinct().join(need, "part")
    lacks = asked.join(taken.where("s = 'F'").select("cust", F.col("part").alias("req")).distinct(), ["cust", "req"], "left_anti")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("req")), lambda x: x.cast("string")), ",")
    return lacks.groupBy("cust", "part").agg(F.count("*").alias("n"), listed.alias("missing"))


@query("not_in_catalog", "select distinct l_orderkey, l_partkey from lineitem where not exists (select 1 from part where p_partkey = l_partkey and p_size > 5)")
def not_in_catalog(spark: SparkSession, sf: str) -> DataFrame:
    catalog = table(spark, sf, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(catalog, "l_partkey", "left_anti").distinct()


@query("time_conflicts", """
with s as (select user_id, cast(ts as date) as day, event_id, hour(ts) * 60 + minute(ts) as a, hour(ts) * 60 + minute(ts) + cast(floor(value) as bigint) as z from events)
select x.user_id, x.day, x.event_id as a, y.event_id as b from s x join s y on x.user_id = y.user_id and x.day = y.day and x.event_id < y.event_id where x.a < x.z and y.a < y.z and x.a < y.z and y.a < x.z
""")  # fmt: skip
def time_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    minute = F.hour("ts") * 60 + F.minute("ts")
    slots = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", minute.alias("start"), (minute + F.floor("value")).alias("end"))
    return rel.interval_conflicts(slots, ["user_id", "day"], "event_id", "start", "end")


@query("clearance_prefix", """
with e as (select n_nationkey as ord, 'exact' as kind, 'N' || (n_nationkey % 7) as prefix, n_name as entry from nation
  union all select n_nationkey, 'alias', 'N' || (n_nationkey % 11), n_name || ' alias' from nation union all select 100 + r_regionkey, 'fallback', 'N' || (5 + r_regionkey * 2), r_name from region),
r as (select *, row_number() over (partition by prefix order by kind = 'exact' desc, case when kind = 'exact' then -ord else ord end) as k from e)
select prefix, entry from r where k = 1
""")  # fmt: skip
def clearance_prefix(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    key = F.col("n_nationkey").cast("long")
    name = lambda n: F.concat(F.lit("N"), n.cast("string")).alias("prefix")
    exact = nation.select(key.alias("ord"), F.lit("exact").alias("kind"), name(key % 7), F.col("n_name").alias("entry"))
    alias = nation.select(key.alias("ord"), F.lit("alias").alias("kind"), name(key % 11), F.concat("n_name", F.lit(" alias")).alias("entry"))
    fallback = region.select((F.col("r_regionkey").cast("long") + 100).alias("ord"), F.lit("fallback").alias("kind"), name(F.col("r_regionkey") * 2 + 5), F.col("r_name").alias("entry"))
    return rel.prefix_index(exact.unionAll(alias).unionAll(fallback))


SQL_PLAN = "with c as (select l_orderkey as plan, l_linenumber as ord, l_partkey as course, l_quantity as units, case l_returnflag when 'R' then 2 when 'A' then 1 else 0 end as sev, l_returnflag || ':' || l_linestatus as reason from lineitem)"


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    sev = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("plan"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").alias("course"), F.col("l_quantity").alias("units"), sev.alias("sev"), F.concat_ws(":", "l_returnflag", "l_linestatus").alias("reason")
    )


@query("plan_status_fold", SQL_PLAN + " select plan, course, case max(sev) when 2 then 'fail' when 1 then 'warning' else 'pass' end as status from c group by plan, course")
def plan_status_fold(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf).groupBy("plan", "course").agg(rel.fold_status(F.col("sev")).alias("status"))


@query("plan_reasons", SQL_PLAN + " select plan, string_agg(reason, '; ' order by ord, course, reason) as reasons from c group by plan")
def plan_reasons(spark: SparkSession, sf: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("ord", "course", "reason")))
    return _plan(spark, sf).groupBy("plan").agg(F.array_join(F.transform(listed, lambda x: x["reason"]), "; ").alias("reasons"))


@query("plan_summary", SQL_PLAN + " select plan, sum(units) as total_units, sum(units) > 120 as over_load, case when max(sev) = 2 then 'invalid' when max(sev) = 1 or sum(units) > 120 then 'warning' else 'valid' end as overall from c group by plan")
def plan_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = _plan(spark, sf).groupBy("plan").agg(F.sum("units").alias("total_units"), F.max("sev").alias("worst"))
    over = F.col("total_units") > 120
    return rows.select("plan", "total_units", over.alias("over_load"), F.when(F.col("worst") == 2, "invalid").when((F.col("worst") == 1) | over, "warning").otherwise("valid").alias("overall"))


@query("unit_caps", """
select o_custkey, count(*) as n, least(count(*), 16) as counted, count(*) > 16 as over_cap from orders group by o_custkey
""")  # fmt: skip
def unit_caps(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count("*")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(n.alias("n"), F.least(n, F.lit(16)).alias("counted"), (n > 16).alias("over_cap"))


@query("json_props", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("tumbling_window", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, sum(value) as total from events group by 1, 2")
def tumbling_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("sliding_window", """
select time_bucket(interval '30 minutes', ts) - s * interval '30 minutes' as start, count(*) as n from events, (values (0), (1)) v(s) group by 1
""")  # fmt: skip
def sliding_window(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query("session_window", """
with m as (select user_id, ts, event_id, case when ts - lag(ts) over w < interval '6 hours' then 0 else 1 end as fresh from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from m)
select user_id, min(ts) as start, count(*) as n from s group by user_id, k
""")  # fmt: skip
def session_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), "n")


@query("programs_links", "select o_orderkey, c_name, o_totalprice from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING'")
def programs_links(spark: SparkSession, sf: str) -> DataFrame:
    people = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, sf, "orders").join(people, "o_custkey").select("o_orderkey", "c_name", "o_totalprice")


@query("links_programs_left", "select c_custkey, c_mktsegment, count(o_orderkey) as n_orders, coalesce(cast(max(o_orderkey) as varchar), '') as last_order from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'F' where c_mktsegment like 'BUILD%' group by 1, 2")
def links_programs_left(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("m"))
    rows = table(spark, sf, "customer").where(F.col("c_mktsegment").startswith("BUILD")).join(done, "c_custkey", "left")
    return rows.select("c_custkey", "c_mktsegment", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce(F.col("m").cast("string"), F.lit("")).alias("last_order"))


@query("fallback_lookup", """
with names as (select p_name, max(p_partkey) as k from part group by p_name)
select e.event_id, coalesce(cast(a.k as varchar), cast(b.k as varchar), '?') as part from (select event_id, event_type || ' ring' as n1, case event_type when 'click' then 'red widget' when 'view' then 'small ring' else 'none' end as n2 from events) e
left join names a on a.p_name = e.n1 left join names b on b.p_name = e.n2
""")  # fmt: skip
def fallback_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Two keys tried in turn, the last row of a name winning, `?` if neither is known."""
    names = table(spark, sf, "part").groupBy("p_name").agg(F.max("p_partkey").cast("string").alias("k"))
    second = F.when(F.col("event_type") == "click", "red widget").when(F.col("event_type") == "view", "small ring").otherwise("none")
    e = table(spark, sf, "events").select("event_id", F.concat("event_type", F.lit(" ring")).alias("n1"), second.alias("n2"))
    a, b = names.select(F.col("p_name").alias("n1"), F.col("k").alias("ka")), names.select(F.col("p_name").alias("n2"), F.col("k").alias("kb"))
    return e.join(a, "n1", "left").join(b, "n2", "left").select("event_id", F.coalesce("ka", "kb", F.lit("?")).alias("part"))


@query("refusals_split", "select c_custkey, exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') as has_file from customer where c_acctbal < 2000")
def refusals_split(spark: SparkSession, sf: str) -> DataFrame:
    poor = table(spark, sf, "customer").where("c_acctbal < 2000").select("c_custkey")
    has = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return poor.join(has, "c_custkey", "left_semi").withColumn("has_file", F.lit(True)).unionAll(poor.join(has, "c_custkey", "left_anti").withColumn("has_file", F.lit(False)))


@query("set_algebra", """
select 'both' as part, count(*) as n from (select l_partkey from lineitem where l_returnflag = 'R' intersect select l_partkey from lineitem where l_returnflag = 'A')
union all select 'only_first', count(*) from (select l_partkey from lineitem where l_returnflag = 'R' except select l_partkey from lineitem where l_returnflag = 'A')
union all select 'either', count(*) from (select l_partkey from lineitem where l_returnflag = 'R' union select l_partkey from lineitem where l_returnflag = 'A')
""")  # fmt: skip
def set_algebra(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    a, b = (lines.where(F.col("l_returnflag") == f).select("l_partkey") for f in "RA")
    size = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return size("both", a.intersect(b)).unionAll(size("only_first", a.subtract(b))).unionAll(size("either", a.union(b).distinct()))


@query("kv_lookup", "select k, coalesce((select max(c_name) from customer where c_custkey = k), 'none') as value from (values (1::bigint), (5), (-1)) v(k)")
def kv_lookup(spark: SparkSession, sf: str) -> DataFrame:
    keys = spark.createDataFrame([(1,), (5,), (-1,)], "k long")
    found = table(spark, sf, "customer").groupBy(F.col("c_custkey").alias("k")).agg(F.max("c_name").alias("v"))
    return keys.join(found, "k", "left").select("k", F.coalesce("v", F.lit("none")).alias("value"))


@query("picker_search", """
select p_partkey, p_name from part where contains(replace(replace(lower(p_name), ' ', ''), '-', ''), 'redw') and p_partkey not in (1) order by p_partkey limit 6
""")  # fmt: skip
def picker_search(spark: SparkSession, sf: str) -> DataFrame:
    """The first six matches that are not chosen yet."""
    plain = F.regexp_replace(F.lower("p_name"), "[ -]", "")
    return table(spark, sf, "part").where(plain.contains("redw") & ~F.col("p_partkey").isin(1)).orderBy("p_partkey").limit(6).select("p_partkey", "p_name")


@query("distinct_prefixes", "select distinct split_part(p_name, ' ', 1) as prefix from part where p_name <> ''")
def distinct_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where("p_name <> ''").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("prefix")).distinct()


@query("slowest", "select event_id, value from events order by value desc, event_id limit 15")
def slowest(spark: SparkSession, sf: str) -> DataFrame:
    """A top-15 report."""
    return table(spark, sf, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(15)


@query("totals", "select count(*) as n_lines, count(distinct l_partkey) as n_parts, count(*) filter (where l_tax > 0.05) as n_taxed from lineitem")
def totals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").agg(F.count("*").alias("n_lines"), F.count_distinct("l_partkey").alias("n_parts"), F.count_if(F.col("l_tax") > 0.05).alias("n_taxed"))


@query("ordered_map", "select o_custkey, string_agg(cast(o_orderkey as varchar) || '=' || o_orderstatus, ',' order by o_orderkey) as manifest from orders group by o_custkey")
def ordered_map(spark: SparkSession, sf: str) -> DataFrame:
    entries = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["o_orderkey"].cast("string"), e["o_orderstatus"])), ",").alias("manifest"))


@query("state_upsert", """
select coalesce(o.k, n.k) as k, coalesce(o.seq, n.seq) as seq, coalesce(n.value, o.value) as value
from (select doc_id as k, doc_id * 2 as seq, cast(n_chars as bigint) as value from documents) o full join (select doc_id as k, -doc_id as seq, cast(quality as bigint) as value from labels) n on o.k = n.k
""")  # fmt: skip
def state_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Known rows keep their sequence, labelled ones take the newer value."""
    old = table(spark, sf, "documents").select(F.col("doc_id").alias("k"), (F.col("doc_id") * 2).alias("seq"), F.col("n_chars").cast("long").alias("value"))
    new = table(spark, sf, "labels").select(F.col("doc_id").alias("k"), (-F.col("doc_id")).alias("seq"), F.col("quality").cast("long").alias("value"))
    return rel.upsert(old, new, ["k"], ["seq"])


@query("latest_rows", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r = 1")
def latest_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rel.keep_last(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


SQL_STATE = """
with body as (select doc_id, md5(coalesce(text, '')) as h, md5(regexp_replace(coalesce(text, ''), '[0-9]', '#', 'g')) as masked from documents),
state as (select doc_id, case when toxic = 1 then 'pending' else 'complete' end as status, case when quality = 0 then null else 'f' || doc_id end as filename, h from labels join body using (doc_id)),
disk as (select 'f' || min(doc_id) as filename, min(masked) as h from body group by body.h),
j as (select s.doc_id, case when s.status <> 'complete' then 'pending' when s.filename is null then 'no_filename' when d.filename is null then 'missing' when d.h <> s.h then 'hash_mismatch' else 'ok' end as finding from state s left join disk d on d.filename = s.filename)
"""


def _state(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """What is known of labelled documents, and the files on disk: equal bodies share the first one's, and digits are masked there."""
    text = F.coalesce("text", F.lit(""))
    body = table(spark, sf, "documents").select("doc_id", F.md5(text.cast("binary")).alias("h"), F.md5(F.regexp_replace(text, "[0-9]", "#").cast("binary")).alias("masked"))
    name = lambda c: F.concat(F.lit("f"), c.cast("string"))
    status = F.when(F.col("toxic") == 1, "pending").otherwise("complete")
    known = table(spark, sf, "labels").select("doc_id", status.alias("status"), F.when(F.coalesce(F.col("quality") != 0, F.lit(True)), name(F.col("doc_id"))).alias("filename"))
    disk = body.groupBy("h").agg(F.min("doc_id").alias("first"), F.min("masked").alias("dh")).select(name(F.col("first")).alias("filename"), "dh", F.lit(True).alias("there"))
    return known.join(body.select("doc_id", "h"), "doc_id"), disk


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    known, disk = _state(spark, sf)
    finding = F.when(F.col("status") != "complete", "pending").when(F.col("filename").isNull(), "no_filename").when(F.col("there").isNull(), "missing").when(F.col("dh") != F.col("h"), "hash_mismatch").otherwise("ok")
    return known.join(disk, "filename", "left").select("doc_id", finding.alias("finding"))


@query("state_integrity", SQL_STATE + "select doc_id, finding from j where finding not in ('ok', 'pending')")
def state_integrity(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(spark, sf).where("finding not in ('ok', 'pending')")


@query("state_work_list", SQL_STATE + "select doc_id from j where finding <> 'ok' union all select doc_id from documents where not exists (select 1 from labels where labels.doc_id = documents.doc_id)")
def state_work_list(spark: SparkSession, sf: str) -> DataFrame:
    """What a resumed run has to do again, and what no run has seen."""
    new = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")
    return _findings(spark, sf).where("finding <> 'ok'").select("doc_id").unionAll(new)


@query("stray_files", SQL_STATE + "select d.filename from disk d where not exists (select 1 from state s where s.filename = d.filename)")
def stray_files(spark: SparkSession, sf: str) -> DataFrame:
    known, disk = _state(spark, sf)
    return disk.select("filename").join(known.select("filename"), "filename", "left_anti")

"""States, totals and checks of whole collections over the given tables, each with its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import codes, urls
from recordloom.functions import text as tx
from recordloom.operators import audit, pages, plan_check
from recordloom.operators import relational as rel
from recordloom.registry import query
from recordloom.sources.files import dump_totals as totals_of
from recordloom.sources.tables import table


@query("first_pending", "select o_orderkey, o_orderdate from orders where o_orderstatus = 'O' order by o_orderdate, o_orderkey limit 25")
def first_pending(spark: SparkSession, sf: str) -> DataFrame:
    """What the next run takes up: its size is the feature."""
    return table(spark, sf, "orders").where("o_orderstatus = 'O'").orderBy("o_orderdate", "o_orderkey").limit(25).select("o_orderkey", "o_orderdate")


@query("first_per_group", "select user_id, event_id from (select *, row_number() over (partition by user_id order by ts, event_id) as r from events) where r <= 4")
def first_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("r", audit.first_by(["user_id"], [F.col("ts"), F.col("event_id")])).where("r <= 4").select("user_id", "event_id")


@query("utc_seconds", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as at from events")
def utc_seconds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", codes.utc_second(F.col("ts")).alias("at"))


@query("day_blocks", """
with t as (select event_id, hour(ts) * 60 + minute(ts) as a, hour(ts) * 60 + minute(ts) + 50 as b from events)
select event_id, (a - 480) / 780 * 100 as top, (b - a) / 780 * 100 as height from t
""")  # fmt: skip
def day_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Place of each event in a calendar day, as a class of 50 minutes."""
    start = F.hour("ts") * 60 + F.minute("ts")
    return table(spark, sf, "events").select("event_id", codes.day_block(start, start + 50).alias("b")).select("event_id", "b.top", "b.height")


@query("page_fetches", r"""
with f as (select * from (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) as r from events where event_type <> 'error') where r = 1)
select page_id, k as id, event_id, event_type from (select page_id, try_cast(regexp_extract(coalesce(url, ''), '/(\d+)(?:[?#]|$)', 1) as bigint) as k from pages) left join f on user_id = k
""")  # fmt: skip
def page_fetches(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with the first good fetch of the id that their url names; pages without an id or fetch stay."""
    named = table(spark, sf, "pages").select("page_id", urls.last_number(F.col("url")).alias("id"))
    fetch = rel.first_ok(table(spark, sf, "events"), ["user_id"], F.col("event_type") != "error", "event_id", F.struct("event_id", "event_type"))
    return named.join(fetch.withColumnRenamed("user_id", "id"), "id", "left").select("page_id", "id", "event_id", "event_type")


@query("page_ready", r"""
with p as (select page_id, coalesce(html, '') as h, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?is)<noscript\b.*?</noscript>', ' ', 'g') as v from pages),
t as (select page_id, h, trim(regexp_replace(regexp_replace(v, '(?s)<[^>]+>', ' ', 'g'), '[\s\x0b]+', ' ', 'g')) as text from p)
select page_id, regexp_matches(h, '(?i)<h1[\s>]') and length(text) > 400 and (not contains(h, 'preview_course') and not contains(h, 'showCourse') or regexp_matches(text, 'Units?:\s*\d')) as ready from t
""")  # fmt: skip
def page_ready(spark: SparkSession, sf: str) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    text = tx.visible_text(html)
    return table(spark, sf, "pages").select("page_id", pages.ready(html, text).alias("ready"))


@query("index_rows", """
select c_custkey as sequence_number, coalesce(nullif(c_name, ''), c_mktsegment) as name, coalesce(c_mktsegment, '') as credential, 'id=' || c_custkey as identifier, coalesce(n_name, '') as school, coalesce(n, 0) as n_records
from customer left join nation on n_nationkey = c_nationkey left join (select o_custkey, count(*) as n from orders group by o_custkey) on o_custkey = c_custkey where c_acctbal > 0
""")  # fmt: skip
def index_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The index of included records, each absent field with its fallback."""
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf, "customer").where("c_acctbal > 0").join(n, "c_custkey", "left")
    rows = rows.join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        F.col("c_custkey").alias("sequence_number"), F.coalesce(F.nullif("c_name", F.lit("")), "c_mktsegment").alias("name"), blank("c_mktsegment").alias("credential"),
        F.concat(F.lit("id="), F.col("c_custkey").cast("string")).alias("identifier"), blank("n_name").alias("school"), F.coalesce("n", F.lit(0)).alias("n_records"),
    )


@query("insert_absent", """
select o_custkey as k, count(*) as n from orders group by o_custkey union all select c_custkey, 0 from customer where not exists (select 1 from orders where o_custkey = c_custkey)
""")  # fmt: skip
def insert_absent(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return rel.insert_absent(known, table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit(0).cast("long").alias("n")), ["k"])


@query("state_requeue", """
select o_orderkey, case when o_orderstatus = 'P' then 'O' else o_orderstatus end as o_orderstatus, case when o_orderstatus = 'P' then 0.0::double else o_totalprice end as o_totalprice
from orders where not (o_orderstatus = 'F' and o_totalprice < 50000)
""")  # fmt: skip
def state_requeue(spark: SparkSession, sf: str) -> DataFrame:
    """What was under way is pending again; small finished rows are deleted."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    kept = rel.delete_where(rows, (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 50000))
    return rel.update_where(kept, F.col("o_orderstatus") == "P", o_orderstatus=F.lit("O"), o_totalprice=F.lit(0.0))


@query("term_lookup", """
with e as (select l_orderkey, l_partkey, sum(l_quantity) as q from lineitem group by l_orderkey, l_partkey)
select l_orderkey, count(*) as n_entries, min_by(q, l_partkey) as first_entry, max_by(q, l_partkey) as last_entry from e group by l_orderkey
""")  # fmt: skip
def term_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The entries of one order as a dictionary by part, then its entries of the smallest and the largest part."""
    entries = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    one = rel.keyed(entries, ["l_orderkey"], "l_partkey", "q")
    keys = F.map_keys("entries")
    return one.select("l_orderkey", F.size(keys).cast("long").alias("n_entries"), F.col("entries")[F.array_min(keys)].alias("first_entry"), F.col("entries")[F.array_max(keys)].alias("last_entry"))


@query("dump_totals", """select cast(to_json({'n': count(*), 'n_returned': count(*) filter (where l_returnflag = 'R'), 'n_open': count(*) filter (where l_linestatus = 'O')}) as varchar) as totals from lineitem""")
def dump_totals(spark: SparkSession, sf: str) -> DataFrame:
    return totals_of(table(spark, sf, "lineitem"), n_returned=F.col("l_returnflag") == "R", n_open=F.col("l_linestatus") == "O")


@query("grade_rule_counts", """
with g as (select ['A', 'B+', 'C', 'C-', 'D', 'F', 'W'][cast(1 + l_linenumber % 7 as int)] as grade from lineitem)
select grade, case when grade in ('F', 'NP', 'NC', 'IN', 'MG', 'W') then 'fail' when grade in ('C-', 'D+', 'D', 'D-') then 'caution' else 'ok' end as rule, count(*) as n from g group by all
""")  # fmt: skip
def grade_rule_counts(spark: SparkSession, sf: str) -> DataFrame:
    grades = F.array(*[F.lit(g) for g in ("A", "B+", "C", "C-", "D", "F", "W")])
    rows = table(spark, sf, "lineitem").select(F.element_at(grades, (1 + F.col("l_linenumber") % 7).cast("int")).alias("grade"))
    return rows.groupBy("grade").agg(F.count("*").alias("n")).select("grade", plan_check.grade_rule(F.col("grade")).alias("rule"), "n")


@query("doc_hash_listing", "select doc_id, sha256(coalesce(text, '')) as hash from documents")
def doc_hash_listing(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))


SQL_CHECKS = """
with c as (select unnest(['has_id', 'has_text', 'has_source', 'has_lang', 'not_blank', 'size_agrees']) as name, unnest([count(*) filter (where doc_id is null), count(*) filter (where text is null), count(*) filter (where source is null), count(*) filter (where lang is null), count(*) filter (where not regexp_matches(coalesce(text, ''), '[^ \\t-\\r]')), count(*) filter (where n_chars is distinct from length(coalesce(text, '')))]) as n_failed from documents
union all select 'unique_id', cast(coalesce(sum(n - 1), 0) as bigint) from (select count(*) as n from documents group by doc_id))
select name, n_failed, n_failed = 0 as ok from c union all select 'all', cast(sum(n_failed) as bigint), sum(n_failed) = 0 from c
"""


@query("collection_checks", SQL_CHECKS)
def collection_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Seven checks of all documents, and whether all of them hold."""
    docs = table(spark, sf, "documents")
    text = F.coalesce("text", F.lit(""))
    failing = {
        "has_id": F.col("doc_id").isNull(), "has_text": F.col("text").isNull(), "has_source": F.col("source").isNull(), "has_lang": F.col("lang").isNull(),
        "not_blank": ~text.rlike(r"[^\x20\x09-\x0D]"), "size_agrees": ~F.col("n_chars").eqNullSafe(F.length(text)),
    }
    return audit.checks(docs, failing, unique={"unique_id": ["doc_id"]})

"""Records written and read again, stores put together, and outputs judged anew, over the given tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators import clauses, gate, plan_check, report
from recordloom.plans import corpus, records
from recordloom.registry import query
from recordloom.sources import export, files
from recordloom.sources.tables import table
from recordloom.streaming.budget import fresh


def _outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a programme file: (file, header, body)."""
    docs = table(spark, sf, "documents")
    header = F.create_map(F.lit("Program"), F.coalesce("source", F.lit("")), F.lit("Program ID"), F.col("doc_id").cast("string"), F.lit("Section"), F.coalesce("lang", F.lit("")))
    return docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"), header.alias("header"), F.coalesce("text", F.lit("")).alias("body"))


SQL_OUTPUT = "select 'd' || doc_id || '.txt' as file, trim(coalesce(source, '')) as program, cast(doc_id as varchar) as program_id, trim(coalesce(lang, '')) as section, sha256(trim(coalesce(text, ''), chr(10))) as body_sha256 from documents"


def _shown(rows: DataFrame) -> DataFrame:
    h = F.col("header")
    return rows.select("file", h["Program"].alias("program"), h["Program ID"].alias("program_id"), h["Section"].alias("section"), F.sha2(F.btrim("body", F.lit("\n")), 256).alias("body_sha256"))


@query("corpus_files", SQL_OUTPUT)
def corpus_files(spark: SparkSession, sf: str) -> DataFrame:
    """Header and body of every composed file, read from its text again."""
    return _shown(files.decomposed(files.composed(_outputs(spark, sf)).withColumnRenamed("text", "value")))


@query("corpus_export", SQL_OUTPUT)
def corpus_export(spark: SparkSession, sf: str) -> DataFrame:
    """Every document exported under one manifest, and read by it."""
    at = fresh(spark, "export")
    export.write(_outputs(spark, sf), at)
    return _shown(export.read(spark, at))


@query("csv_extract", "select cast(p_partkey as varchar) as p_partkey, p_name, coalesce(case when p_size > 9 then p_brand end, '') as p_brand, '\"' || p_type || '\", ' || p_size as note from part")
def csv_extract(spark: SparkSession, sf: str) -> DataFrame:
    """A projection of the parts written as delimited text with quotes, and read with its schema."""
    at = fresh(spark, "csv")
    note = F.concat(F.lit('"'), F.col("p_type"), F.lit('", '), F.col("p_size").cast("string"))
    files.write_csv(table(spark, sf, "part").withColumns({"p_brand": F.when(F.col("p_size") > 9, F.col("p_brand")), "note": note}), at, ["p_partkey", "p_name", "p_brand", "note"])
    return files.csv_rows(spark, at, "p_partkey string, p_name string, p_brand string, note string").na.fill("")


@query("json_dump", "select user_id, count(*) as n, sum(value) as total, max(event_type) as last_type from events group by user_id")
def json_dump(spark: SparkSession, sf: str) -> DataFrame:
    """The events dumped as JSON lines with their totals, and read again."""
    at = fresh(spark, "json")
    files.dump(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value"), at, errors=F.col("event_type") == "error")
    rows = spark.read.schema("event_id long, user_id long, event_type string, value double").json(f"{at}/rows")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("event_type").alias("last_type"))


@query("log_extract", "select doc_id, sha256(substr(coalesce(text, ''), 1, 2000)) as message, sha256(substr(coalesce(text, ''), 1, 1500)) as evidence from documents")
def log_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Log rows of all documents, cut to what a log keeps."""
    rows = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("message"), F.coalesce("text", F.lit("")).alias("evidence"))
    return files.log_rows(rows, "message", "evidence").select("doc_id", F.sha2("message", 256).alias("message"), F.sha2("evidence", 256).alias("evidence"))


@query("stores_merged", "select c_name as name, c_nationkey as nation, c_mktsegment as segment, null::double as balance from customer union all select s_name, s_nationkey, null, s_acctbal from supplier")
def stores_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers as one store, without the ids that each had for itself."""
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return files.merged_stores([a, b]).select("name", "nation", "segment", "balance")


@query("text_layers", r"select doc_id, case when length(regexp_replace(text, '\s+', '', 'g')) > 100 then 'layer' when text is not null then 'ocr' end as used from documents")
def text_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each document's text is enough, or what was recognised is used."""
    used = report.text_or_ocr(F.col("text"), F.lit("ocr"))
    return table(spark, sf, "documents").select("doc_id", F.when(F.col("text").isNull(), None).when(used == "ocr", "ocr").otherwise("layer").alias("used"))


# the lines of an order as those of a report, with a divider before each returned one and a label on some
SQL_LINES = """with l as (select l_orderkey as id, l_linenumber * 1000000000::bigint + l_partkey * 1000 + l_suppkey as pos, case when l_returnflag = 'R' then '-----' when l_linestatus = 'F' and l_returnflag = 'A' then 'COMPLETED COURSES ' || l_partkey else 'row ' || l_partkey end as line from lineitem)"""


def _report_lines(spark: SparkSession, sf: str) -> DataFrame:
    line = F.when(F.col("l_returnflag") == "R", "-----").when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A"), F.concat(F.lit("COMPLETED COURSES "), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("row "), F.col("l_partkey").cast("string")))
    pos = F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), pos.alias("pos"), line.alias("line"))


@query("report_chunks", SQL_LINES + """, c as (select *, sum(case when regexp_matches(line, '^\\s*[-=_]{5,}\\s*$') then 1 else 0 end) over (partition by id order by pos rows unbounded preceding) as chunk from l)
select id, pos, cast(chunk as bigint) as chunk, case when max(case when contains(line, 'COMPLETED COURSES') then 1 end) over (partition by id, chunk) = 1 then 'COMPLETED COURSES' end as label from c
""")  # fmt: skip
def report_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of every order cut at dividers, each chunk named by the label that it holds."""
    return report.labelled(report.chunks(_report_lines(spark, sf), "id", "pos", "line"), "id", "pos", "line", ["COMPLETED COURSES", "IN PROGRESS"]).select("id", "pos", "chunk", "label")


@query("report_lines", "select user_id as page, hour(ts)::double as y, string_agg(event_type, ' ' order by value, event_type) as line from events where value is not null group by user_id, hour(ts)")
def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as fragments on a page: those of one hour are one baseline, in the order of their values."""
    rows = table(spark, sf, "events").where("value is not null").select(F.col("user_id").alias("page"), F.col("value").alias("x"), F.hour("ts").cast("double").alias("y"), F.col("event_type").alias("s"))
    return report.rebuilt_lines(rows)


@query("report_units", "select l_orderkey as id, abs(sum(l_quantity * 0.1) - sum(l_quantity) / 10) < 0.005 as agrees from lineitem where l_linestatus = 'F' group by l_orderkey")
def report_units(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the units of each order's completed lines add up to those stated, up to rounding."""
    lines = table(spark, sf, "lineitem")
    stated = lines.where("l_linestatus = 'F'").groupBy("l_orderkey").agg((F.sum("l_quantity") / 10).alias("stated"))
    rows = lines.join(stated, "l_orderkey").select(F.col("l_orderkey").alias("id"), (F.col("l_quantity") * 0.1).alias("units"), F.when(F.col("l_linestatus") == "F", "completed").otherwise("in_progress").alias("state"), "stated")
    return report.earned_units_agree(rows, "id", "stated").select("id", "agrees")


_TAGS = sorted({r[0] for r in clauses.RULES})


@query("clause_tags", f"with r as (select p_brand as program, ([{', '.join(repr(t) for t in _TAGS)}])[cast(p_partkey % {len(_TAGS)} as int) + 1] as tag from part) select program, " + ", ".join(f"count(*) filter (tag = '{t}') as \"{t}\"" for t in _TAGS) + " from r group by program")
def clause_tags(spark: SparkSession, sf: str) -> DataFrame:
    """How many clauses of each tag every brand has."""
    tag = F.element_at(F.array(*[F.lit(t) for t in _TAGS]), (F.col("p_partkey") % len(_TAGS) + 1).cast("int"))
    return clauses.tag_counts(table(spark, sf, "part").select(F.col("p_brand").alias("program"), tag.alias("tag")))


@query("plan_entries", "select l_orderkey as plan_id, l_linenumber as ord, case when l_returnflag = 'N' and l_linestatus = 'F' then 'course' when l_linenumber = 7 then 'sections' end as missing from lineitem where (l_returnflag = 'N' and l_linestatus = 'F') or l_linenumber = 7")
def plan_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of plans that can't be judged, and what they lack."""
    plans = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("ord"), F.when(~((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F")), F.col("l_partkey").cast("string")).alias("course"),
        F.when(F.col("l_linenumber") != 7, F.array(F.col("l_suppkey").cast("string"))).otherwise(F.array().cast("array<string>")).alias("sections"),
    )
    return plan_check.incomplete(plans)


@query("plan_full_time", records.SQL_CHECKS + """, t as (select plan_id, coalesce(sum(case when known then units end), 0)::double as total_units, max(worst) as worst, bool_or(not known) as lost from courses group by plan_id)
select plan_id, case when worst = 2 then 'invalid' when worst = 1 or lost or total_units > 18 or total_units < 12 then 'warning' else 'valid' end as overall, total_units < 12 as below from t
""")  # fmt: skip
def plan_full_time(spark: SparkSession, sf: str) -> DataFrame:
    """Every plan judged as a full-time one."""
    plans = records.checked(spark, sf, full_time=True)[1]
    return plans.select("plan_id", "overall", F.exists("warnings", lambda w: w.contains("is below")).alias("below"))


# every document as an output: a third is headed by its programme, a third by another title; a fifth has lost its marker
_HEADS = ["'# Program ' || (doc_id % 7) || ' and requirements' || chr(10)", "'## Other' || chr(10)", "''"]
_SQL_NAMED = f"named as (select doc_id, 'Program ' || (doc_id % 7) || ' (BA)' as name, doc_id % 5 <> 0 as marked, case doc_id % 3 when 0 then {_HEADS[0]} when 1 then {_HEADS[1]} else {_HEADS[2]} end || coalesce(text, '') as text from documents),\n"
_SQL_TITLED = "len(list_filter(regexp_split_to_array(body, '\\r\\n|[\\n\\x0b\\f\\r\\x{85}\\x{2028}\\x{2029}]'), lambda x: x like '#%' and starts_with(lower(trim(regexp_replace(regexp_replace(x, '^#+', ''), '\\s+', ' ', 'g'))), 'program ' || (doc_id % 7)))) > 0 as has_title"


def _sql_outputs() -> str:
    sql = corpus.SQL_VERDICT.replace("from documents", "from named").replace("with ", "with " + _SQL_NAMED, 1)
    old = sql[sql.index("regexp_matches(body, " + corpus._q(gate.HEADING)) : sql.index(" as has_title") + len(" as has_title")]
    return sql.replace(old, _SQL_TITLED.replace("doc_id", "b.doc_id"))


def _named(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as an output: (doc_id, name, body)."""
    d = F.col("doc_id")
    head: Column = F.when(d % 3 == 0, F.concat(F.lit("# Program "), (d % 7).cast("string"), F.lit(" and requirements\n"))).when(d % 3 == 1, F.lit("## Other\n")).otherwise("")
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("Program "), (d % 7).cast("string"), F.lit(" (BA)")).alias("name"), F.concat(head, F.coalesce("text", F.lit(""))).alias("body"))


@query("doc_audit", _sql_outputs() + """,
index as (select doc_id, name, 'program ' || (case when doc_id % 11 = 0 then 9 else doc_id % 7 end) || '  (ba)' as expected, event_type not in ('error', 'view') as cleared from named left join events on event_id = doc_id),
flagged as (select h.doc_id, rs as found, list_filter([case when regexp_replace(lower(expected), '\\s+', ' ', 'g') <> lower(name) then 'title_mismatch_vs_index' end, case when cleared = false then 'accepted_fetch_did_not_clear_challenge' end,
  case when h.body_chars < 400 and not (has_title and content and ends_cleanly and h.body_chars > 0) then 'short_body_without_completeness_evidence' end], lambda x: x is not null) as flags, stub and codes = 0 and units = 0 as defers from h join k using (doc_id) join index using (doc_id))
select doc_id, case when len(found) > 0 then 'FAIL' when len(flags) > 0 then 'REVIEW' else 'PASS' end as status, array_to_string(list_concat(found, flags), ' | ') as reasons, case when defers then 'defers_to_owning_school_no_course_list_on_catalogue' end as note from flagged
""")  # fmt: skip
def doc_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Status of every output under the audit's advisory flags, against the index and the log of its fetch."""
    d = F.col("doc_id")
    expected = F.concat(F.lit("program "), F.when(d % 11 == 0, 9).otherwise(d % 7).cast("string"), F.lit("  (ba)"))
    fetched = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), (~F.col("event_type").isin("error", "view")).alias("cleared"))
    rows = _named(spark, sf).withColumn("expected", expected).join(fetched, "doc_id", "left")
    return gate.audited(rows, "doc_id", "body", "name", "expected", "cleared").withColumn("reasons", F.array_join("reasons", " | "))


@query("output_validity", _sql_outputs() + "select j.doc_id, case when not marked then 'no_marker' when verdict <> 'PASS' then 'content' end as problem, case when marked then reasons end as reasons from judged j join named using (doc_id)")
def output_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each stored output may stay: it has the marker, and its body passes the gate under the name in its header."""
    named = _named(spark, sf)
    rows = named.select(F.create_map(F.lit("Program"), F.col("name")).alias("header"), "body", F.col("doc_id").cast("string").alias("file"))
    written = files.composed(rows).withColumn("value", F.when(F.col("file").cast("long") % 5 != 0, F.col("text")).otherwise(F.replace("text", F.lit(files.MARKER), F.lit(""))))
    return gate.output_problems(written.select(F.col("file").cast("long").alias("doc_id"), "value"), "doc_id")

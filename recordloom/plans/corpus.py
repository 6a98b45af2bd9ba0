"""Corpus audit queries over `documents`, each with its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import text as tx
from recordloom.operators import audit, gate
from recordloom.registry import query
from recordloom.sources.tables import table

SITE = "Example University"


def _q(pattern: str) -> str:
    """A pattern as an SQL string literal."""
    return "'" + pattern.replace("'", "''") + "'"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


SQL_FOLD = "replace(lower(trim(regexp_replace({0}, '[\\s\\x0b]+', ' ', 'g'))), 'ß', 'ss')"
SQL_BODY = "regexp_replace(coalesce(text, ''), '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g')"
SQL_SENTENCES = f"""
  bodies as (select doc_id, {SQL_BODY} as body from documents),
  cut as (select doc_id, unnest(generate_series(1, len(parts))) as pos, unnest(parts) as s from (select doc_id, string_split(regexp_replace(body, '([.!?])[\\s\\x0b]+', '\\1' || chr(1), 'g'), chr(1)) as parts from bodies) x),
  longer as (select doc_id, pos, {SQL_FOLD.format("regexp_replace(s, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g')")} as s from cut where length(regexp_replace(s, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g')) > 80),
  tallied as (select doc_id, s, count(*) as n, min(pos) as pos from longer group by doc_id, s),
  top as (select doc_id, n, s, row_number() over (partition by doc_id order by n desc, pos) as r from tallied)
"""


@query("doc_counts", r"""
select doc_id, cast(length(coalesce(text, '')) as bigint) as chars, cast(octet_length(encode(coalesce(text, ''))) as bigint) as bytes,
  cast(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+')) as bigint) as words,
  cast(len(regexp_extract_all(coalesce(text, ''), '(?m)^.*[^ \t\n\r\f].*$')) as bigint) as lines from documents
""")  # fmt: skip
def doc_counts(spark: SparkSession, sf: str) -> DataFrame:
    return audit.counts(_docs(spark, sf), "doc_id", "text")


def _stats_sql(keys: str) -> str:
    by, sel = (f"group by {keys}", f"{keys}, ") if keys else ("", "")
    return f"""
with v as (select source, n_chars as x from documents where n_chars > 0),
g as (select {sel} list(x order by x) as a, count(*) as n, min(x) as mn, max(x) as mx, avg(x) as mean, median(x) as median, stddev_pop(x) as stdev from v {by}),
p as (select *, (n + 1) * 0.25 as p1, (n + 1) * 0.75 as p3 from g),
r as (select *, greatest(1, least(n - 1, cast(floor(p1) as bigint))) as l1, greatest(1, least(n - 1, cast(floor(p3) as bigint))) as l3 from p),
q as (select *, case when n < 4 then mn else a[l1] + (a[l1 + 1] - a[l1]) * (p1 - l1) end as q1, case when n < 4 then mx else a[l3] + (a[l3 + 1] - a[l3]) * (p3 - l3) end as q3 from r)
"""


STATS_COLUMNS = "n, mn as min, mx as max, mean, median, stdev, q1, q3, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as low_fence, q3 + 1.5 * (q3 - q1) as high_fence"


@query("doc_stats_overall", _stats_sql("") + f"select {STATS_COLUMNS} from q")
def doc_stats_overall(spark: SparkSession, sf: str) -> DataFrame:
    return audit.describe(_docs(spark, sf), [], "n_chars")


@query("doc_stats_by_source", _stats_sql("source") + f"select source, {STATS_COLUMNS} from q")
def doc_stats_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return audit.describe(_docs(spark, sf), ["source"], "n_chars")


@query("doc_outliers_z", """
with s as (select avg(n_chars) as m, stddev_pop(n_chars) as sd from documents where n_chars > 0)
select doc_id, n_chars, (n_chars - m) / sd as z from documents, s where n_chars > 0 and sd > 0 and abs((n_chars - m) / sd) >= 3
""")  # fmt: skip
def doc_outliers_z(spark: SparkSession, sf: str) -> DataFrame:
    return audit.z_outliers(_docs(spark, sf), "doc_id", "n_chars")


@query("doc_outliers_iqr", _stats_sql("") + """
select doc_id, n_chars, case when n_chars > q3 + 1.5 * (q3 - q1) then 'high' else 'low' end as side from documents, q
where n_chars > 0 and (n_chars > q3 + 1.5 * (q3 - q1) or n_chars < q1 - 1.5 * (q3 - q1))
""")  # fmt: skip
def doc_outliers_iqr(spark: SparkSession, sf: str) -> DataFrame:
    return audit.fence_outliers(_docs(spark, sf), "doc_id", "n_chars")


@query("doc_repeat_sentence", f"with {SQL_SENTENCES} select b.doc_id, cast(coalesce(n, 1) as bigint) as repeats, coalesce(substr(s, 1, 140), '') as excerpt from bodies b left join top t on b.doc_id = t.doc_id and r = 1")
def doc_repeat_sentence(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).select("doc_id", tx.strip(F.coalesce("text", F.lit(""))).alias("text"))
    found = gate.repeated_sentences(docs, "doc_id", "text")
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("repeats", F.lit(1)).cast("long").alias("repeats"), F.coalesce("excerpt", F.lit("")).alias("excerpt"))


@query("doc_duplicate_groups", f"""
with h as (select doc_id, sha256({SQL_FOLD.format("coalesce(text, '')")}) as h from documents)
select doc_id, count(*) over w as group_size, min(doc_id) over w as first_member, max(doc_id) over w as last_member from h window w as (partition by h)
""")  # fmt: skip
def doc_duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    return audit.duplicate_groups(_docs(spark, sf), "doc_id", "text")


@query("doc_duplicate_members", f"""
with h as (select doc_id, sha256({SQL_FOLD.format("coalesce(text, '')")}) as h from documents)
select h, n, member from (select h, doc_id as member, count(*) over (partition by h) as n from h) x where n > 1
""")  # fmt: skip
def doc_duplicate_members(spark: SparkSession, sf: str) -> DataFrame:
    return audit.members(_docs(spark, sf), "doc_id", "text")


SIGNATURES = audit.signatures(SITE) + [("licence_line", "low", r"(?i)\blicensed under\b"), ("shouting", "low", r"[A-Z]{4,}!!")]
SQL_SIGNATURES = " union all ".join(
    f"select doc_id, {_q(k)} as signature, {_q(s)} as severity, cast(len(regexp_extract_all(coalesce(text, ''), {_q(p)})) as bigint) as hits from documents" for k, s, p in SIGNATURES
)


@query("doc_signatures", f"select * from ({SQL_SIGNATURES}) x where hits > 0")
def doc_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return audit.signature_counts(_docs(spark, sf), "doc_id", "text", SIGNATURES)


@query("signature_totals", f"select signature, severity, count(*) as n_docs, cast(sum(hits) as bigint) as hits from ({SQL_SIGNATURES}) x where hits > 0 group by signature, severity")
def signature_totals(spark: SparkSession, sf: str) -> DataFrame:
    found = audit.signature_counts(_docs(spark, sf), "doc_id", "text", SIGNATURES)
    return found.groupBy("signature", "severity").agg(F.count("*").alias("n_docs"), F.sum("hits").alias("hits"))


_count = lambda p: f"len(regexp_extract_all(body, {_q(p)}))"
SQL_VERDICT = f"""
with {SQL_SENTENCES},
rep as (select doc_id, n from top where r = 1),
f as (select b.doc_id, body, cast(length(body) as bigint) as body_chars, coalesce(n, 1) as repeats,
  list_filter([{", ".join(f"case when regexp_matches(body, {_q(p)}) then {_q(k)} end" for k, p in gate.fatal_patterns(SITE))}], lambda x: x is not null) as fatal,
  {_count(gate.CODE)} as codes, {_count(gate.UNITS)} as units, regexp_matches(body, {_q(gate.HEADING)}) as has_title,
  {_count(gate.SECTION)} as sections, {" + ".join(f"cast(contains(lower(body), {_q(w)}) as int)" for w in gate.SECTION_WORDS)} as section_words,
  regexp_matches(body, {_q(gate.STUB)}) as refers, regexp_matches(body, '(?:[.!?:]|---)$') or regexp_matches(body, '(?:^|\\n)[ \\t]*#[^\\n]*$') as ends_cleanly,
  regexp_extract_all(body, {_q(gate.BULLET)}) as bullets from bodies b left join rep using (doc_id)),
g as (select *, len(bullets) as nb, len(list_filter(bullets, lambda x: not regexp_matches(regexp_replace(x, '^\\s*-\\s+[A-Z]{{2,5}}\\s?\\d{{3}}[A-Za-z]{{0,3}}', ''), {_q(gate.BULLET_UNITS)}))) as nl,
  sections >= 2 or section_words >= 3 as structured, refers and body_chars >= 200 and ends_cleanly as stub from f),
h as (select *, codes > 0 or units > 0 or structured or stub as content, nb >= 3 and nl >= 3 and (nl = nb or nl / nb > 0.6) as lost from g),
k as (select doc_id, body_chars, cast(repeats as bigint) as repeats, case when body_chars = 0 then ['empty'] else list_filter([
  case when len(fatal) > 0 then 'contaminated:' || array_to_string(fatal, ';') end, case when not has_title then 'no_title_heading' end,
  case when not content then 'no_content_or_structure' end,
  case when body_chars < 200 then 'under_200_chars' when not (has_title and content) and body_chars < 971 then 'weak_and_under_971_chars' end,
  case when repeats >= 3 then 'repeated_sentence_x' || repeats end, case when lost then 'units_missing:' || nl || '_of_' || nb end], lambda x: x is not null) end as rs from h),
judged as (select doc_id, body_chars, repeats, array_to_string(rs, ' | ') as reasons,
  case when len(list_filter(rs, lambda x: x like 'contaminated%' or x = 'empty' or x like 'under\\_%' escape '\\')) > 0 then 'FAIL' when len(rs) > 0 then 'REVIEW' else 'PASS' end as verdict from k)
"""


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return gate.verdicts(_docs(spark, sf)).select("doc_id", "verdict", F.array_join("reasons", " | ").alias("reasons"), "body_chars", "repeats")


@query("doc_verdict", SQL_VERDICT + "select * from judged")
def doc_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: verdict and reasons of every document."""
    return _verdicts(spark, sf)


@query("doc_verdict_counts", SQL_VERDICT + "select verdict, count(*) as n, count(*) filter (where reasons like '%contaminated%') as contaminated, count(*) filter (where reasons like '%no_title_heading%') as untitled, count(*) filter (where repeats >= 3) as repeated from judged group by verdict")
def doc_verdict_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _verdicts(spark, sf)
    return rows.groupBy("verdict").agg(
        F.count("*").alias("n"), F.count_if(F.col("reasons").contains("contaminated")).alias("contaminated"), F.count_if(F.col("reasons").contains("no_title_heading")).alias("untitled"), F.count_if(F.col("repeats") >= 3).alias("repeated")
    )


@query("doc_review_priority", SQL_VERDICT + """
select j.doc_id, j.verdict, cast(case when verdict = 'FAIL' then 1 when verdict = 'REVIEW' and coalesce(l.toxic, 0) = 1 then 2 when verdict = 'REVIEW' then 3 else 9 end as int) as priority
from judged j left join labels l on j.doc_id = l.doc_id
""")  # fmt: skip
def doc_review_priority(spark: SparkSession, sf: str) -> DataFrame:
    rows = _verdicts(spark, sf).join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return rows.select("doc_id", "verdict", audit.priority(F.col("verdict"), F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("priority"))


@query("audit_label_join", "select d.doc_id, coalesce(cast(l.quality as varchar), '') as quality, coalesce(cast(l.toxic as varchar), '') as toxic, l.doc_id is not null as labelled from documents d left join labels l on d.doc_id = l.doc_id")
def audit_label_join(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").withColumn("labelled", F.lit(True))
    rows = _docs(spark, sf).select("doc_id").join(labels, "doc_id", "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return rows.select("doc_id", text("quality"), text("toxic"), F.coalesce("labelled", F.lit(False)).alias("labelled"))


SQL_RUNS = f"""
with b as (select doc_id as k, case when n_chars >= 971 then 'PASS' else 'REVIEW' end as s, md5({SQL_FOLD.format("coalesce(text, '')")}) as m from documents),
t as (select doc_id, regexp_replace(coalesce(text, ''), '[0-9]', '', 'g') as x from documents),
a as (select doc_id as k, case when length(x) between 900 and 3000 then 'PASS' else 'REVIEW' end as s, md5({SQL_FOLD.format("x")}) as m from t),
j as (select coalesce(b.k, a.k) as k, case when b.s is null then 'added' when a.s is null then 'removed' when b.s <> 'PASS' and a.s = 'PASS' then 'repaired'
  when b.s = 'PASS' and a.s <> 'PASS' then 'regressed' when a.m <> b.m then 'changed' else 'same' end as change from b full join a on a.k = b.k)
"""


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as they are, and with their digits gone and another rule of size."""
    verdict = lambda good: F.when(good, "PASS").otherwise("REVIEW").alias("s")
    mark = lambda t: F.md5(tx.folded(t).cast("binary")).alias("m")
    text = F.coalesce("text", F.lit(""))
    bare = F.regexp_replace(text, "[0-9]", "")
    docs = _docs(spark, sf).withColumnRenamed("doc_id", "k")
    return audit.compare_runs(docs.select("k", verdict(F.col("n_chars") >= 971), mark(text)), docs.select("k", verdict(F.length(bare).between(900, 3000)), mark(bare)), "k", "s", "m")


@query("before_after", SQL_RUNS + "select k, change from j")
def before_after(spark: SparkSession, sf: str) -> DataFrame:
    return _runs(spark, sf)


@query("before_after_counts", SQL_RUNS + "select change, count(*) as n from j group by change")
def before_after_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _runs(spark, sf).groupBy("change").agg(F.count("*").alias("n"))


#: How many rows of each kind of change a report shows; rows that are the same are not shown.
SAMPLES = {"changed": 200, "repaired": 40, "regressed": 40, "added": 40, "removed": 40}


@query("before_after_samples", SQL_RUNS + "select change, k from (select *, row_number() over (partition by change order by k) as r from j) where r <= case change when 'changed' then 200 when 'same' then 0 else 40 end")
def before_after_samples(spark: SparkSession, sf: str) -> DataFrame:
    """The first rows of each kind of change, as a report shows them."""
    runs = _runs(spark, sf)
    parts = [runs.where(F.col("change") == kind).orderBy("k").limit(n).select("change", "k") for kind, n in SAMPLES.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("repeatability", f"""
with a as (select doc_id, md5({SQL_FOLD.format("coalesce(text, '')")}) as h from documents), b as (select doc_id, md5({SQL_FOLD.format("translate(coalesce(text, ''), 'abcxyz', 'ABCXYZ') || ' '")}) as h from documents)
select a.doc_id, a.h = b.h as equal from a join b on a.doc_id = b.doc_id
""")  # fmt: skip
def repeatability(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies of two runs, the second with some capitals and a space more: equal where folding undoes that."""
    hashed = lambda t: F.md5(tx.folded(t).cast("binary"))
    t = F.coalesce("text", F.lit(""))
    a = _docs(spark, sf).select("doc_id", hashed(t).alias("a"))
    b = _docs(spark, sf).select("doc_id", hashed(F.concat(F.translate(t, "abcxyz", "ABCXYZ"), F.lit(" "))).alias("b"))
    return a.join(b, "doc_id").select("doc_id", (F.col("a") == F.col("b")).alias("equal"))


@query("smallest_largest_docs", """
(select doc_id, n_chars, 'smallest' as side from documents where n_chars > 0 order by n_chars, doc_id limit 5)
union all (select doc_id, n_chars, 'largest' as side from documents where n_chars > 0 order by n_chars desc, doc_id limit 5)
""")  # fmt: skip
def smallest_largest_docs(spark: SparkSession, sf: str) -> DataFrame:
    """A report of the five smallest and the five largest."""
    rows = _docs(spark, sf).where("n_chars > 0").select("doc_id", "n_chars")
    small = rows.orderBy("n_chars", "doc_id").limit(5).withColumn("side", F.lit("smallest"))
    return small.unionAll(rows.orderBy(F.desc("n_chars"), "doc_id").limit(5).withColumn("side", F.lit("largest")))


@query("doc_excerpts", f"""
with b as (select doc_id, coalesce(text, '') as t, regexp_extract(coalesce(text, ''), '(?i)licensed under') as hit from documents)
select doc_id, replace(substr(t, greatest(1, instr(t, hit) - 50), instr(t, hit) - greatest(1, instr(t, hit) - 50) + length(hit) + 50), chr(10), '¶') as excerpt from b where hit <> ''
""")  # fmt: skip
def doc_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _docs(spark, sf).select("doc_id", tx.excerpt(F.coalesce("text", F.lit("")), r"(?i)licensed under").alias("excerpt"))
    return rows.where("excerpt is not null")


@query("quality_contract", """
select 'unique_doc_id' as check_name, count(*) - count(distinct doc_id) = 0 as ok from documents
union all select 'chars_match', bool_and(n_chars = length(text)) from documents
union all select 'labels_known', (select count(*) from labels l where not exists (select 1 from documents d where d.doc_id = l.doc_id)) = 0
union all select 'states_partition', (select count(*) from documents) = (select count(*) from documents where n_chars >= 971) + (select count(*) from documents where not coalesce(n_chars >= 971, false))
""")  # fmt: skip
def quality_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Named checks over the whole collection, one row each."""
    docs, labels = _docs(spark, sf), table(spark, sf, "labels")
    one = lambda name, ok: ok.select(F.lit(name).alias("check_name"), "ok")
    checks = [
        one("unique_doc_id", docs.groupBy("doc_id").count().agg(F.coalesce(F.bool_and(F.col("count") == 1), F.lit(True)).alias("ok"))),
        one("chars_match", docs.agg(F.bool_and(F.col("n_chars") == F.length("text")).alias("ok"))),
        one("labels_known", labels.join(docs, "doc_id", "left_anti").agg((F.count("*") == 0).alias("ok"))),
        one("states_partition", docs.agg((F.count("*") == F.count_if(F.col("n_chars") >= 971) + F.count_if(~F.coalesce(F.col("n_chars") >= 971, F.lit(False)))).alias("ok"))),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionAll(c)
    return out

"""Queries on titles, codes, urls, pages, reports and clauses, each with its SQL where SQL can express it.

The record operators have no table of their own among the given ones: titles, clauses and programmes are made of the
rows of `part`, reports, feeds and plans of orders and their lines, so that the work grows with the tables.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import codes, enums, urls
from recordloom.functions import text as tx
from recordloom.operators import clauses, feed, pages, plan_check, report, resolve, titles
from recordloom.registry import query
from recordloom.sources.tables import table

SELECTED = ["/fr/", "/private"]


def _values(rows: list[tuple]) -> str:
    show = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(show(v) for v in r) + ")" for r in rows)


# the forms that titles take: title, label and page title, with the name of a part for {}; a part has the form of its number
FORMS = [
    ("{} (BS)", "", "{} (BS)"), ("{}, BA", "", None), ("{} (Track A) (BFA)*", "", "{} (MFA)"), ("Asia Minor {} (BA)", "", "Asia Minor {} (BA)"),
    ("{} Minor", "", "{} Minor"), ("Minor in {}", "", "{} (BA)"), ("{} (PhD)", "", "{} (PhD)"), ("{} (JD)", "", None), ("{} (MA)", "", "{} (BA)"),
    ("{} (BS) / {} (MS)", "", "{} (BS)"), ("Graduate Certificate in {}", "", None), ("Certificate in {}", "", None), ("Joint Degree BA/JD in {}", "", None), ("Dual Degree in {}", "", None),
    ("Progressive Degree in {} (MA)", "", None), ("Pre-Professional Emphasis, {}", "", None), ("Bachelor of Arts in {}", "", None), ("Doctor of {}", "", None), ("{}", "", "{} (BA)"),
    ("{}&nbsp;Industry (BM)†", "", "{} Industry (BM)"), ("Combined Degree in {}", "", None), ("{}", "Minor", None), ("{} (BS and MS)", "", None), ("Basics of {}", "", None), ("", "", None),
]
_NAME = "upper(substr(p_name, 1, 1)) || substr(p_name, 2)"


def _form(k: int) -> str:
    quoted = ", ".join("null" if f[k] is None else "'" + f[k].replace("'", "''") + "'" for f in FORMS)
    return f"replace(([{quoted}])[cast(p_partkey % {len(FORMS)} as int) + 1], '{{}}', {_NAME})"


SQL_TITLES = f"with t as (select p_partkey as id, {_form(0)} as title, {_form(1)} as label, {_form(2)} as page from part)"


def _sql_tokens(field: str, vocabulary: list[str]) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({field}, '(?i)\\s+and\\s+|[\\s/,+&]+'), lambda k: regexp_replace(k, '^[ .:;()\\[\\]]+|[ .:;()\\[\\]]+$', '', 'g')), lambda k: k in ({', '.join(repr(v) for v in vocabulary)}))"


def _sql_found(field: str, vocabulary: list[str], pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"list_concat(list_filter([regexp_extract(lower({field}), '{p}')], lambda k: k <> ''), {_sql_tokens(field, vocabulary)})"


_UG, _GR = (titles.UNDERGRADUATE, titles.UNDERGRADUATE_PHRASE), (titles.GRADUATE, titles.GRADUATE_PHRASE)
_TAIL = titles.TAIL_GROUPS.replace("'", "''")
_NORMAL = "trim(regexp_replace(translate(replace(replace(coalesce({0}, ''), '&nbsp;', ' '), '&amp;', '&'), '’', ''''), '[\\s]+', ' ', 'g'))"


def _sql_class(title: str, label: str, source: str, name: str) -> str:
    """Common table expressions that end in `name` (id, class) for titles of `source`."""
    has = lambda k: f"(len({_sql_found(k, *_UG)}) > 0 or len({_sql_found(k, *_GR)}) > 0)"
    quoted = {k: p.replace("'", "''") for k, p in titles.NAMED}
    return f"""
{name}0 as (select id, {_NORMAL.format(title)} as t, {_NORMAL.format(label)} as l from {source}),
{name}1 as (select *, regexp_replace(t, '[\\s*†‡+^]+$', '') as plain, regexp_extract(t, '{_TAIL}', 1) as tail, regexp_replace(regexp_replace(t, '{_TAIL}', ''), '[\\s*†‡+^]+$', '') as base0 from {name}0),
{name}2 as (select *, list_filter(list_reverse(regexp_extract_all(tail, '\\(([^()]*)\\)', 1)), lambda x: {has("x")}) as ends, list_filter(regexp_extract_all(plain, '\\(([^()]{{1,40}})\\)', 1), lambda x: {has("x")}) as groups,
  list_filter([case when contains(plain, ',') and plain not like '%)' then trim(regexp_extract(plain, ',([^,]*)$', 1)) else '' end], lambda x: {has("x")}) as comma from {name}1),
{name}3 as (select *, list_concat(case when len(ends) > 0 then ends[1:1] else comma end, case when len(groups) > 0 then groups else comma end) as fields,
  case when len(ends) = 0 and len(comma) > 0 then trim(regexp_replace(plain, ',[^,]*$', '')) when len(ends) = 0 then plain else base0 end as base from {name}2),
{name}4 as (select *, flatten(list_transform(fields, lambda f: {_sql_found("f", *_UG)})) as ug, flatten(list_transform(fields, lambda f: {_sql_found("f", *_GR)})) as grad,
  lower(concat_ws(' | ', nullif(t, ''), nullif(l, ''))) as low, regexp_extract(lower(t), '{_UG[1].replace("'", "''")}') as up, regexp_extract(lower(t), '{_GR[1].replace("'", "''")}') as gp from {name}3),
{name} as (select id, case when regexp_matches(low, '\\bprogressive degree\\b') then 'excluded_progressive' when regexp_matches(lower(base), '{titles.MINOR}') or regexp_matches(lower(l), '{titles.MINOR}') then 'excluded_minor'
  when regexp_matches(low, '{quoted["excluded_certificate"]}') then case when contains(low, 'graduate certificate') then 'excluded_graduate_certificate' else 'excluded_certificate' end
  {" ".join(f"when regexp_matches(low, '{quoted[k]}') then '{k}'" for k, _ in titles.NAMED[1:])}
  when len(ug) > 0 and len(grad) > 0 then 'excluded_combined'
  when len(grad) > 0 then case when len(list_filter(grad, lambda g: g in ({', '.join(repr(v) for v in titles.DOCTORAL)}) or contains(lower(g), 'doctor'))) > 0 then 'excluded_doctoral' when len(list_filter(grad, lambda g: g in ({', '.join(repr(v) for v in titles.PROFESSIONAL)}))) > 0 then 'excluded_professional' else 'excluded_masters' end
  when len(ug) > 0 then 'included' when up <> '' and gp = '' then 'included' when gp <> '' and up = '' then case when contains(gp, 'doctor') then 'excluded_doctoral' else 'excluded_masters' end when up <> '' then 'excluded_combined' else 'manual_review' end as class from {name}4)
"""


def _titles(spark: SparkSession, sf: str) -> DataFrame:
    """A title for every part, made of its name."""
    name = F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substr(p_name, 2)"))
    forms = F.array(*[F.struct(*[F.lit(v).cast("string").alias(c) for v, c in zip(f, ("title", "label", "page"), strict=True)]) for f in FORMS])
    form = F.element_at(forms, (F.col("p_partkey") % len(FORMS) + 1).cast("int"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), *[F.replace(form[c], F.lit("{}"), name).alias(c) for c in ("title", "label", "page")])


@query("classify_title", SQL_TITLES + "," + _sql_class("title", "label", "t", "c") + "select id, class, class <> 'manual_review' as confident from c")
def classify_title(spark: SparkSession, sf: str) -> DataFrame:
    return titles.classify(_titles(spark, sf)).select("id", "class", "confident")


@query("classify_modes", SQL_TITLES + "," + _sql_class("title", "label", "t", "c") + """
select id, class as bachelors, case when class = 'excluded_minor' then 'included' else class end as all_undergraduate, case class when 'excluded_minor' then 'included' when 'included' then 'excluded_not_minor' else class end as minors from c
""")  # fmt: skip
def classify_modes(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("class")
    return titles.classify(_titles(spark, sf)).select("id", c.alias("bachelors"), titles.collected(c, "all_undergraduate").alias("all_undergraduate"), titles.collected(c, "minors").alias("minors"))


@query("enum_audit", f"""
with r as (select o_orderkey, ([{", ".join(repr(m) for m in [*enums.MODES, "httpx"])}])[cast(o_orderkey % 7 as int) + 1] as mode, ([{", ".join(repr(m) for m in [*enums.PAGE_KINDS, "other"])}])[cast(o_custkey % 5 as int) + 1] as kind,
  case o_orderstatus when 'F' then 'complete' when 'O' then 'pending' else 'partly' end as status from orders)
select o_orderkey, 'mode' as enumeration, mode as value from r where mode = 'httpx' union all select o_orderkey, 'page_kind', kind from r where kind = 'other' union all select o_orderkey, 'status', status from r where status = 'partly'
""")  # fmt: skip
def enum_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Values that are outside of their enumeration, of an attempt made of every order."""
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "pending").otherwise("partly")
    rows = table(spark, sf, "orders").select("o_orderkey", _pick([*enums.MODES, "httpx"], "o_orderkey", False).alias("mode"), _pick([*enums.PAGE_KINDS, "other"], "o_custkey", False).alias("kind"), status.alias("status"))
    return enums.violations(rows, "o_orderkey", {"mode": "mode", "page_kind": "kind", "status": "status"})


@query("reconcile_verdicts", SQL_TITLES + "," + _sql_class("title", "label", "t", "c") + "," + _sql_class("page", "''", "(select * from t where page is not null)", "p") + """
select c.id, case when p.class is null or p.class = c.class then c.class when c.class = 'included' and p.class like 'excluded\\_%' escape '\\' then p.class when c.class = 'manual_review' and p.class = 'included' then 'included' else 'manual_review' end as verdict
from c left join p on c.id = p.id
""")  # fmt: skip
def reconcile_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _titles(spark, sf)
    link = titles.classify(rows).select("id", F.col("class").alias("link"))
    page = titles.classify(rows.where("page is not null").select("id", F.col("page").alias("title"), F.lit("").alias("label"))).select("id", F.col("class").alias("page"))
    return link.join(page, "id", "left").select("id", titles.reconciled(F.col("link"), F.col("page")).alias("verdict"))


@query("accounting_partition", SQL_TITLES + "," + _sql_class("title", "label", "t", "c") + "select case when class = 'included' then 'included' when class = 'manual_review' then 'review' else 'excluded' end as part, count(*) as n from c group by 1 union all select 'discovered', count(*) from c")
def accounting_partition(spark: SparkSession, sf: str) -> DataFrame:
    rows = titles.classify(_titles(spark, sf))
    part = F.when(F.col("class") == "included", "included").when(F.col("class").startswith("excluded_"), "excluded").otherwise("review")
    return rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).unionAll(rows.agg(F.count("*").alias("n")).select(F.lit("discovered"), "n"))


# a course code as it may be typed, and the term of an order, from columns of the tables
SQL_CODE = "lower(c_mktsegment) || case when c_custkey % 2 = 0 then ' ' else '' end || c_custkey || 'x'"
SQL_TERM = "cast(year(o_orderdate) as varchar) || cast(1 + (month(o_orderdate) - 1) // 4 as varchar)"


@query("code_normalise", f"""
with t as (select c_custkey as id, {SQL_CODE} as c from customer), m as (select *, regexp_extract(trim(c), '^([A-Za-z]+)\\s*(\\d+[A-Za-z]?)', 1) as a, regexp_extract(trim(c), '^([A-Za-z]+)\\s*(\\d+[A-Za-z]?)', 2) as b from t)
select id, upper(case when a <> '' then a || ' ' || b else trim(c) end) as code, upper(case when regexp_extract(trim(c), '^[A-Za-z]+') <> '' then regexp_extract(trim(c), '^[A-Za-z]+') else trim(c) end) as prefix, try_cast(nullif(regexp_extract(c, '\\d+'), '') as int) as number from m
""")  # fmt: skip
def code_normalise(spark: SparkSession, sf: str) -> DataFrame:
    c = F.concat(F.lower("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, " ").otherwise(""), F.col("c_custkey").cast("string"), F.lit("x"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), codes.normal_code(c).alias("code"), codes.prefix(c).alias("prefix"), codes.number(c).alias("number"))


@query("term_year", f"""
with t as (select o_orderkey as id, {SQL_TERM} as c from orders), y as (select id, c, try_cast(nullif(regexp_extract(c, '^(\\d{{4}})\\d$', 1), '') as int) as y from t)
select id, cast(y as varchar) || '-' || substr(cast(y + 1 as varchar), 3, 2) as academic_year, case regexp_extract(c, '^\\d{{4}}(\\d)$', 1) when '1' then 'spring' when '2' then 'summer' when '3' then 'fall' end as season from y
""")  # fmt: skip
def term_year(spark: SparkSession, sf: str) -> DataFrame:
    """The academic year and season of each order's term, a term being four months."""
    c = F.concat(F.year("o_orderdate").cast("string"), F.floor((F.month("o_orderdate") + 3) / 4).cast("string"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), codes.academic_year(c).alias("academic_year"), codes.season(c).alias("season"))


@query("unresolved_times", """
with t as (select event_id as id, case when event_type = 'error' then 'TBA' else hour(ts) || ' : ' || minute(ts) end as c from events), p as (select id, try_cast(nullif(regexp_extract(c, '^\\s*([+-]?\\d+)\\s*:\\s*([+-]?\\d+)\\s*$', 1), '') as int) * 60 + try_cast(nullif(regexp_extract(c, '^\\s*([+-]?\\d+)\\s*:\\s*([+-]?\\d+)\\s*$', 2), '') as int) as minutes from t)
select id, minutes, minutes is null as unresolved from p
""")  # fmt: skip
def unresolved_times(spark: SparkSession, sf: str) -> DataFrame:
    """Minutes of each event's written time; errors have none."""
    m = codes.minutes(F.when(F.col("event_type") == "error", "TBA").otherwise(F.concat_ws(" : ", F.hour("ts").cast("string"), F.minute("ts").cast("string"))))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), m.alias("minutes"), m.isNull().alias("unresolved"))


@query("clock_labels", """
with t as (select event_id, hour(ts) * 60 + minute(ts) as m from events)
select event_id, cast(case when (m // 60) % 12 = 0 then 12 else (m // 60) % 12 end as varchar) || ':' || lpad(cast(m % 60 as varchar), 2, '0') || case when m // 60 < 12 then ' AM' else ' PM' end as label from t
""")  # fmt: skip
def clock_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", codes.clock_label((F.hour("ts") * 60 + F.minute("ts")).cast("int")).alias("label"))


SQL_URL = r"""
with u as (select page_id, url, regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?', ['s', 'h', 'p', 'q']) as x from pages),
k as (select page_id, url, x.s as s, x.h as h, x.p as p, x.q as q, list_filter(string_split(x.q, '&'), lambda e: e <> '') as e from u)
"""


@query("page_url_canonical", SQL_URL + r"""
select page_id, 'https://' || lower(h) || p || case when len(f) > 0 then '?' || array_to_string(f, '&') else '' end as canonical
from (select *, list_sort(list_filter(e, lambda z: split_part(z, '=', 1) not in ('returnto', 'print', 'hl', 'expand', 'ref') and not regexp_matches(z, '^(?:utm_|fb|gclid)'))) as f from k)
""")  # fmt: skip
def page_url_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@query("page_parameters", SQL_URL + "select page_id, unnest(list_transform(e, lambda z: split_part(z, '=', 1))) as key, unnest(list_transform(e, lambda z: regexp_extract(z, '^[^=]*=?(.*)$', 1))) as value from k where len(e) > 0")
def page_parameters(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select("page_id", F.explode(urls.parameters(F.col("url"))).alias("e"))
    return rows.select("page_id", F.col("e.k").alias("key"), F.col("e.v").alias("value"))


@query("page_robots", SQL_URL + "select page_id, starts_with(p, '/fr/') or contains(p, '/fr/') or starts_with(p, '/private') as refused from k")
def page_robots(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.disallowed(F.col("url"), SELECTED).alias("refused"))


@query("page_print_view", SQL_URL + "select page_id, case when contains(q, 'print') then url else regexp_replace(url, '#.*$', '') || case when q = '' then '?' else '&' end || 'print' end as alternate from k")
def page_print_view(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.print_view(F.col("url")).alias("alternate"))


def _sql_hidden(keep_noscript: bool = False) -> str:
    out = "coalesce(html, '')"
    for tag in ["script", "style"] + ([] if keep_noscript else ["noscript"]):
        out = f"regexp_replace({out}, '(?is)<{tag}\\b.*?</{tag}>', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({out}, '(?s)<[^>]+>', ' ', 'g'), '[\\s]+', ' ', 'g'))"


SQL_TITLE = "trim(regexp_replace(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'))"


@query("page_features", f"select page_id, {SQL_TITLE} as title, cast(length({_sql_hidden()}) as int) as visible, cast(len(list_distinct(regexp_extract_all(coalesce(html, ''), 'href=\"[^\"]+\"'))) as int) as links, cast(len(regexp_extract_all(coalesce(html, ''), '(?i)<h[1-6]\\b')) as int) as headings from pages")
def page_features(spark: SparkSession, sf: str) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return table(spark, sf, "pages").select(
        "page_id", tx.title_of(html).alias("title"), F.length(tx.visible_text(html)).alias("visible"), pages.link_count(html, 'href="[^"]+"').alias("links"), F.regexp_count(html, F.lit(r"(?i)<h[1-6]\b")).alias("headings")
    )


_any = lambda c, words: "list_filter([" + ", ".join(f"case when contains({c}, '{w}') then '{w}' end" for w in words) + "], lambda x: x is not null)"


SQL_CHALLENGE = f"""
with p as (select page_id, {_any(f"lower({SQL_TITLE})", pages.TITLE_MARKS)} as a, {_any("lower(coalesce(html, ''))", pages.SCRIPT_MARKS)} as s,
  {_any("lower(regexp_replace(coalesce(html, ''), '(?is)<noscript[^>]*>.*?</noscript>', ' ', 'g'))", pages.TEXT_MARKS)} as b, length({_sql_hidden(True)}) as n from pages)
select page_id, len(a) > 0 or len(s) > 0 or (len(b) > 0 and (n < 3500 or len(b) >= 2)) as challenged,
  array_to_string(list_concat(list_transform(a, lambda m: 'title:' || m), list_transform(b, lambda m: 'body:' || m), list_transform(s, lambda m: 'script:' || m)), ' ') as evidence from p
"""


@query("page_challenge", SQL_CHALLENGE)
def page_challenge(spark: SparkSession, sf: str) -> DataFrame:
    return pages.challenged(table(spark, sf, "pages")).select("page_id", "challenge.challenged", F.array_join("challenge.evidence", " ").alias("evidence"))


@query("fetch_errors", f"""
select page_id, case when refused then 'robots_disallowed' when html is null then 'network_failure' when challenged then 'human_verification_required' end as error
from pages join ({SQL_URL} select page_id, starts_with(p, '/fr/') or contains(p, '/fr/') or starts_with(p, '/private') as refused from k) using (page_id) join ({SQL_CHALLENGE}) using (page_id)
""")  # fmt: skip
def fetch_errors(spark: SparkSession, sf: str) -> DataFrame:
    """The error that the fetch of each page ends in, or null."""
    rows = pages.challenged(table(spark, sf, "pages"))
    return rows.select("page_id", enums.fetch_error(~urls.disallowed(F.col("url"), SELECTED), F.col("challenge.challenged"), F.col("html").isNull()).alias("error"))


SQL_SEMANTIC = f"""
with p as (select page_id, html, {_sql_hidden()} as t from pages)
select page_id, length(t) >= 700 and (regexp_matches(html, '(?i)<h1[^>]*>\\s*\\S') or contains(html, 'Program:')) and ({" + ".join(f"cast(contains(lower(t), '{s}') as int)" for s in pages.SIGNALS)}) >= 2 as program_ok,
  length(t) >= 1500 and contains(lower(t), 'the') and len(list_distinct(regexp_extract_all(html, 'href="[^"]+"'))) >= 5 as index_ok from p
"""


@query("page_semantic", SQL_SEMANTIC)
def page_semantic(spark: SparkSession, sf: str) -> DataFrame:
    html = F.col("html")
    context = F.lower(tx.visible_text(html)).contains("the")
    ok = lambda kind: pages.semantic_ok(F.lit(kind), html, pages.link_count(html, 'href="[^"]+"'), context)
    return table(spark, sf, "pages").select("page_id", ok("program").alias("program_ok"), ok("index").alias("index_ok"))


@query("acquisition_modes", f"""
select page_id, case when html is null then 'network_failure' when challenged then 'challenge' when index_ok then 'direct' else 'invalid' end as mode from pages left join ({SQL_CHALLENGE}) using (page_id) left join ({SQL_SEMANTIC}) using (page_id)
""")  # fmt: skip
def acquisition_modes(spark: SparkSession, sf: str) -> DataFrame:
    """How each page was got, had it come with status 200 where it has a body."""
    html = F.col("html")
    lost = F.when(html.isNull(), "no body")
    valid = pages.semantic_ok(F.lit("index"), html, pages.link_count(html, 'href="[^"]+"'), F.lower(tx.visible_text(html)).contains("the"))
    return pages.challenged(table(spark, sf, "pages")).select("page_id", pages.acquisition_mode(lost, F.col("challenge.challenged"), valid, F.lit(200)).alias("mode"))


@query("final_url_ids", SQL_URL + "select page_id, len(list_filter(e, lambda z: split_part(z, '=', 1) = 'page')) > 0 as same from k")
def final_url_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the canonical url of each page still names the requested `page`; an absent one counts as another."""
    return table(spark, sf, "pages").select("page_id", resolve.same_page(F.col("url"), urls.canonical(F.col("url")), ["page"]).alias("same"))


# a progress report for every order: what its head says depends on the order, its course rows are its lines
_DEGREES = ["SCIENCE - BUSINESS ADMINISTRATION PROGRAM\\n (FINANCE)", "FINE ARTS – DANCE Academic", "ARTS - HISTORY PROGRAM", "MUSIC"]
_LEVELS = ["Freshman", "Sophomore", "Junior", "Senior", "Visiting"]
_MINORS = ["NO MINOR 20243", "Painting 20253", "Film and Media 20251"]
_GRADES = ["-O 4.0 B-", "4.0 A", "2.0 RG >IP", "12.0 W", "2.0 IP", "3.5 P"]
_TITLES = ["Organizational Behavior", "Off-Campus Studies", "ab", "Untitled course", "Jazz  I"]


def _pick(values: list[str], key: str, sql: bool):
    """One of some values by a key, in SQL or as a column."""
    if sql:
        return "([" + ", ".join("'" + v.replace("'", "''").replace("\\n", "' || chr(10) || '") + "'" for v in values) + f"])[cast({key} % {len(values)} as int) + 1]"
    return F.element_at(F.array(*[F.lit(v.replace("\\n", "\n")) for v in values]), (F.expr(key) % len(values) + 1).cast("int"))


# pieces of the head and of a row: literal text, or (values, key)
_HEAD = [
    "PROGRAM: ", "1000 + o_custkey % 9000", " X\\nBACHELOR OF ", (_DEGREES, "o_orderkey"), "\\nCATALOG YEAR: 20243\\nCurrent Class Level ", (_LEVELS, "o_custkey"), "\\nEARNED: ", "o_orderkey % 4", ".", "10 + o_custkey % 90",
    " GPA\\nTRNSFR WORK ", "55 + o_orderkey % 20", ".0 TR\\nMINOR: ", (_MINORS, "o_orderkey"), "\\n",
]
_ROW = ["", "20231 + 10 * (l_partkey % 3) + l_partkey % 3", " ", (["BUAD", "ART ", "MATH", "xy", "L"], "l_suppkey"), "", "100 + l_partkey % 400", " ", (_GRADES, "l_partkey"), " ", (_TITLES, "l_suppkey")]


def _text_sql(parts: list) -> str:
    shown = []
    for k, part in enumerate(parts):
        if isinstance(part, tuple):
            shown.append(_pick(*part, True))
        elif k % 2:
            shown.append(f"cast(cast({part} as bigint) as varchar)")
        else:
            shown.append("'" + part.replace("\\n", "' || chr(10) || '") + "'")
    return " || ".join(shown)


def _text_column(parts: list):
    shown = []
    for k, part in enumerate(parts):
        if isinstance(part, tuple):
            shown.append(_pick(*part, False))
        elif k % 2:
            shown.append(F.expr(part).cast("long").cast("string"))
        else:
            shown.append(F.lit(part.replace("\\n", "\n")))
    return F.concat(*shown)


SQL_REPORTS = f"""with lines as (select l_orderkey, string_agg({_text_sql(_ROW)}, chr(10) order by l_linenumber, l_partkey, l_suppkey) as rows from lineitem group by l_orderkey),
r as (select o_orderkey as id, {_text_sql(_HEAD)} || coalesce(rows, '') as text from orders left join lines on l_orderkey = o_orderkey)"""


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    """A report for every order; an order has a few lines."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", _text_column(_ROW).alias("row")).alias("r"))
    rows = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["row"]), "\n").alias("rows"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), _text_column(_HEAD).alias("head"))
    return orders.join(rows, F.col("l_orderkey") == F.col("id"), "left").select("id", F.concat("head", F.coalesce("rows", F.lit(""))).alias("text"))


@query("report_course_rows", SQL_REPORTS + r""",
l as (select id, unnest(range(len(x))) as line, unnest(x) as l from (select id, string_split(text, chr(10)) as x from r)),
m as (select id, line, l, regexp_replace(l, '^\s*(\d{5})\s+([A-Za-z]{2,4}\s*\d{3}[A-Za-z]?)\s+', '') as rest from l where regexp_matches(l, '^\s*(\d{5})\s+([A-Za-z]{2,4}\s*\d{3}[A-Za-z]?)\s+')),
n as (select *, regexp_extract(rest, '([\d.]+)\s+', 1) as units, regexp_extract(rest, '^.*?[\d.]+\s+(.*)$', 1) as after from m),
o as (select *, nullif(regexp_extract(after, '^([A-Z][A-Z+\-]*|CR|P|W|NP|RG)\s+', 1), '') as grade, trim(regexp_replace(regexp_replace(regexp_replace(after, '^([A-Z][A-Z+\-]*|CR|P|W|NP|RG)\s+', ''), '^>(?i:IP)[a-z]*', ''), '\s+', ' ', 'g')) as title from n where units <> ''),
p as (select *, case when regexp_matches(after, '(?i)>IP') or grade = 'RG' then 'in_progress' when grade is not null and grade <> 'IP' then 'completed' end as state from o)
select id, cast(line as int) as line, regexp_extract(l, '^\s*(\d{5})', 1) as term, regexp_replace(regexp_extract(l, '^\s*\d{5}\s+([A-Za-z]{2,4}\s*\d{3}[A-Za-z]?)\s+', 1), '\s+', ' ', 'g') as code, title, cast(units as double) as units, grade, state from p where state is not null and length(title) >= 3
""")  # fmt: skip
def report_course_rows(spark: SparkSession, sf: str) -> DataFrame:
    return report.course_rows(_reports(spark, sf), "id")


@query("report_fields", SQL_REPORTS + r"""
select id, case upper(coalesce(nullif(regexp_extract(text, '(?i)BACHELOR OF (SCIENCE|ARTS|FINE ARTS|MUSIC)', 1), ''), 'SCIENCE')) when 'ARTS' then 'BA' when 'FINE ARTS' then 'BFA' when 'MUSIC' then 'BM' else 'BS' end as degree,
  coalesce(trim(regexp_extract(text, '(?i)BACHELOR OF (SCIENCE|ARTS|FINE ARTS|MUSIC)\s*[-–]?\s*(BUSINESS ADMINISTRATION|[A-Z][A-Z ,&]+?)(?:\s+Academic|\s+PROGRAM|\s*\n)', 2)), '') as major,
  nullif(trim(regexp_extract(text, '(?i)BACHELOR OF[\s\S]{0,120}?\n\s*\(([^)]{3,60})\)', 1)), '') as concentration, nullif(regexp_extract(text, '(?i)PROGRAM:\s*(\d{3,5})\s', 1), '') as program_code,
  nullif(regexp_extract(text, '(?i)Current Class Level\s+(Freshman|Sophomore|Junior|Senior)', 1), '') as class_level, try_cast(nullif(regexp_extract(text, '(?i)EARNED:\s*([\d.]+)\s*GPA', 1), '') as double) as gpa,
  coalesce(try_cast(nullif(regexp_extract(text, '(?i)TRNSFR\s+WORK\s+([\d.]+)\s+TR', 1), '') as double), 0) as transfer_units,
  case when not regexp_matches(regexp_extract(text, '(?i)MINOR:\s*(.+?)(?:\s+\d{5}|\n)', 1), '(?i)no minor') then nullif(trim(regexp_extract(text, '(?i)MINOR:\s*(.+?)(?:\s+\d{5}|\n)', 1)), '') end as minor,
  regexp_matches(text, '(?i)TRNSFR WORK\s+(?:6[0-9]|[7-9]\d|1\d{2})\.0\s+TR') as is_transfer, regexp_matches(text, '(?i)[A-Z]+\s+3000\b|Off-Campus Studies|OVERSEAS STUDIES') as studied_abroad, regexp_matches(text, '(?i)Student Athlete:') as is_athlete from r
""")  # fmt: skip
def report_fields(spark: SparkSession, sf: str) -> DataFrame:
    shown = ["degree", "major", "concentration", "program_code", "class_level", "gpa", "transfer_units", "minor", "is_transfer", "studied_abroad", "is_athlete"]
    f = report.fields(F.col("text"))
    return _reports(spark, sf).select("id", *[f[k].alias(k) for k in shown])


@query("report_records")
def report_records(spark: SparkSession, sf: str) -> DataFrame:
    """Whole nested records; the fields and rows have SQL of their own."""
    return report.parse(_reports(spark, sf), "id")


# the forms of clause records; a part has the form of its number
CLAUSES = [
    ("CNS", None, None, "ENFORCED", "ENFORCED", False), ("CNS", "X", None, "ENFORCED", "ENFORCED", False), ("NOT_CNS_XREQ", "NO_DOUBLE_COUNT", "mode=PAIRWISE,polarity=PERMITS", "ENFORCED", "ENFORCED", False),
    ("NOT_CNS_XREQ", "NO_DOUBLE_COUNT", None, "ENFORCED", "ENFORCED", False), ("UNKNOWN", None, None, "FLAG_ONLY", "NOT_CHECKABLE", False), ("NOT_CNS_GATE", "INITIAL_ADMISSION", "checkable=NUMERIC_THRESHOLD", "FLAG_ONLY", "NOT_CHECKABLE", True),
    ("NOPE", None, None, None, None, True), ("OUT_OF_SCOPE_PDP", None, None, None, None, False), ("NOT_CNS_GATE", "INITIAL_ADMISSION", "checkable=QUALITATIVE_REVIEW", "FLAG_ONLY", "NOT_CHECKABLE", True), ("NOT_CNS_SPLIT", "PROPORTIONAL_CAP", None, "GATE_ONCE", "CONDITIONAL", False),
]


@query("clause_validate", f"""
with f(k, tag, sub, q, s, v, review) as (values {_values([(k, *c) for k, c in enumerate(CLAUSES)])}), c as (select 'P-' || p_partkey as id, f.* from part join f on k = p_partkey % {len(CLAUSES)}), k(tag, sub, q, s, v) as (values {_values(clauses.rule_rows())}),
j as (select c.id, c.tag, c.review, bool_or(k.tag is not null) as known, coalesce(bool_or(k.tag is not null and c.sub is not distinct from k.sub), false) as a, coalesce(bool_or(k.tag is not null and c.sub is not distinct from k.sub and coalesce(c.q, '') = k.q), false) as b,
  coalesce(bool_or(k.tag is not null and c.sub is not distinct from k.sub and coalesce(c.q, '') = k.q and c.s is not distinct from k.s and c.v is not distinct from k.v), false) as r from c left join k on c.tag = k.tag group by all)
select id as requirement_id, 'tag' as violation from j where not known union all select id, 'subtype' from j where known and not a union all select id, 'qualifiers' from j where a and not b
union all select id, 'roles' from j where b and not r union all select id, 'needs_review' from j where tag = 'UNKNOWN' and not review
""")  # fmt: skip
def clause_validate(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with the clause record of every part."""
    names = ["tag", "subtype", "q", "solver", "validator", "needs_review"]
    forms = F.array(*[F.struct(*[F.lit(v).cast("boolean" if c == "needs_review" else "string").alias(c) for v, c in zip(f, names, strict=True)]) for f in CLAUSES])
    rows = table(spark, sf, "part").select(F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("requirement_id"), F.element_at(forms, (F.col("p_partkey") % len(CLAUSES) + 1).cast("int")).alias("f"))
    return clauses.violations(rows.select("requirement_id", "f.*").withColumn("qualifiers", F.expr("str_to_map(q, ',', '=')")).drop("q"))


# phrases with a number in words or digits, and what they come to
_NUMBERS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
PHRASES = [("No more than {w} ({n}) outside courses", "max {n} outside courses"), ("at least {w} courses", "min {n} courses"), ("one or more electives", "min 1 electives"), ("A maximum of {n} units", "max {n} units"), ("fewer than {n} courses", "under {n} courses"), ("choose {w} units", "choose {n} units")]


@query("phrase_normalise", f"""
select p_partkey as id, replace({_pick([p[1] for p in PHRASES], "p_partkey", True)}, '{{n}}', cast(1 + p_size % 10 as varchar)) as phrase from part
""")  # fmt: skip
def phrase_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """The normal form of a phrase about every part."""
    n = F.col("p_size") % 10
    phrase = F.replace(F.replace(_pick([p[0] for p in PHRASES], "p_partkey", False), F.lit("{n}"), (n + 1).cast("string")), F.lit("{w}"), F.element_at(F.array(*[F.lit(w) for w in _NUMBERS]), (n + 1).cast("int")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), clauses.normal_phrase(phrase).alias("phrase"))


PROGRAM_TEXT = "Choose three courses from the following list: {}. Complete one thesis; a minimum GPA of 2.0 is required.\n- Students may choose any two courses; otherwise, courses are assigned."
SEGMENTS = [("-01", "Choose three courses from the following list: {}."), ("-02", "Complete one thesis"), ("-03", "a minimum GPA of 2.0 is required."), ("-04a", "Students may choose any two courses"), ("-04b", "courses are assigned.")]


@query("clause_segments", f"""
with f(k, c) as (values {_values(SEGMENTS)}) select 'PART-' || p_partkey || '-MINOR' || k as requirement_id, replace(c, '{{}}', p_name) as clause from part, f
""")  # fmt: skip
def clause_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The numbered clauses of the text of a programme for every part."""
    rows = table(spark, sf, "part").select(F.concat(F.lit("Part "), F.col("p_partkey").cast("string"), F.lit(" Minor")).alias("program"), F.replace(F.lit(PROGRAM_TEXT), F.lit("{}"), F.col("p_name")).alias("text"))
    return clauses.segments(rows, "program").select("requirement_id", "clause")


# a response for every order: its department is the word of its priority, its courses are its lines
_MODES = ["Lecture", "Lab", "Quiz", "Discussion", "Seminar"]
_KINDS = ["lectures", "labs", "quizzes", "discussions", "other"]
_TERM = "concat(cast(year(o_orderdate) as string), cast(1 + quarter(o_orderdate) % 3 as string))"
_DEPT = "split_part(split_part(o_orderpriority, '-', 2), ' ', 1)"


#: Lines whose responses one task makes: what a task sorts is bounded by it, however many lines there are.
LINES = 200_000


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    tasks = max(8, -(-lines.count() // LINES))
    named = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus", "l_returnflag"]
    listed = lines.select(*named).repartition(tasks, "l_orderkey").groupBy("l_orderkey").agg(F.collect_list(F.struct(*named)).alias("lines"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.expr(_TERM).alias("term"), F.expr(_DEPT).alias("dept")).repartition(tasks, "o_orderkey")
    mode = lambda key: F.element_at(F.array(*[F.lit(m) for m in _MODES]), (key % len(_MODES) + 1).cast("int"))
    section = lambda x, n, key: F.struct(
        F.concat_ws("-", x["l_orderkey"], x["l_linenumber"], x["l_partkey"], F.lit(n)).alias("sisSectionId"), mode(key).alias("rnrMode"), F.lit(30).alias("totalSeats"), x["l_quantity"].cast("int").alias("registeredSeats"),
        (x["l_linestatus"] == "F").alias("hasDClearance"), F.when(x["l_returnflag"] == "R", "ask").when(x["l_returnflag"] == "A", "").alias("notes"),
    )

    def course(x: Column) -> Column:
        one, half = section(x, 1, x["l_suppkey"]), ((x["l_suppkey"] - x["l_suppkey"] % 2) / 2).cast("long")
        return F.struct(
            F.concat(F.lit("c"), (x["l_partkey"] % 200).cast("string")).alias("courseId"), F.concat(F.when(x["l_suppkey"] % 3 == 0, "OTHER").otherwise(F.col("dept")), F.lit(" "), (100 + x["l_partkey"] % 400).cast("string")).alias("fullCourseName"),
            F.when(x["l_returnflag"] == "N", F.array().cast("array<double>")).otherwise(F.array(x["l_quantity"])).alias("courseUnits"), F.when(x["l_suppkey"] % 2 == 0, F.array(one, section(x, 2, half))).otherwise(F.array(one)).alias("sections"),
        )

    whole = orders.join(listed, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("courses", F.sort_array(F.transform(F.coalesce("lines", F.array().cast(listed.schema["lines"].dataType)), course)))
    body = F.when(F.col("o_orderstatus") == "P", "not json").otherwise(F.to_json(F.struct("courses")))
    return whole.select("term", "dept", F.col("o_orderkey").alias("dept_ord"), body.alias("body"))


_SQL_KIND = lambda key: f"([{', '.join(repr(k) for k in _KINDS)}])[cast({key} % 5 as int) + 1]"
SQL_FEED = f"""with o as (select o_orderkey, o_orderstatus, cast(year(o_orderdate) as varchar) || cast(1 + quarter(o_orderdate) % 3 as varchar) as term, split_part(split_part(o_orderpriority, '-', 2), ' ', 1) as dept from orders),
l as (select term, dept, o_orderkey as ord, 'c' || (l_partkey % 200) as id, case when l_suppkey % 3 = 0 then 'OTHER' else dept end || ' ' || (100 + l_partkey % 400) as name, case when l_returnflag <> 'N' then l_quantity end as units,
  {_SQL_KIND("l_suppkey")} as k1, case when l_suppkey % 2 = 0 then {_SQL_KIND("(l_suppkey // 2)")} end as k2, l_linestatus = 'F' as clear, l_returnflag = 'R' as limited from lineitem join o on o_orderkey = l_orderkey where o_orderstatus <> 'P'),
k as (select * from l where starts_with(name, dept || ' ')), f as (select term, id, min(ord) as o from k group by term, id),
c as (select k.term, k.id as course_id, name as course_name, units, k1 = 'labs' or coalesce(k2 = 'labs', false) as has_lab, clear as has_clearance, limited as has_restrictions,
  case when k2 is null then k1 || '=1' when k1 = k2 then k1 || '=2' else least(k1, k2) || '=1,' || greatest(k1, k2) || '=1' end as counts from k join f on f.term = k.term and f.id = k.id and ord = o)
"""


@query("feed_courses", SQL_FEED + "select * from c")
def feed_courses(spark: SparkSession, sf: str) -> DataFrame:
    """The courses of every response, parsed from its JSON."""
    counts = F.array_join(F.transform(F.map_entries("section_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return feed.courses(_responses(spark, sf)).select("term", "course_id", "course_name", "units", "has_lab", "has_clearance", "has_restrictions", counts.alias("counts"))


@query("feed_frequency", SQL_FEED + """, t as (select count(distinct term) as total from c)
select course_name, count(*) as count, string_agg(term, ',' order by term) as terms, case when count(*) >= any_value(total) - 1 then 'every' when count(*) >= any_value(total) // 2 then 'most' when count(*) = 1 then 'rarely' else 'occasionally' end as label from c, t group by course_name
""")  # fmt: skip
def feed_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return feed.frequency(feed.courses(_responses(spark, sf))).withColumn("terms", F.array_join("terms", ","))


@query("feed_departments", SQL_FEED + """
select term, dept, o_orderkey as dept_ord, case when o_orderstatus = 'P' then 'failed' when n is null then 'empty' else 'ok' end as state, case when o_orderstatus = 'P' then 0 else coalesce(n, 0) end::int as n_courses
from o left join (select l_orderkey, count(*) as n from lineitem group by l_orderkey) on l_orderkey = o_orderkey
""")  # fmt: skip
def feed_departments(spark: SparkSession, sf: str) -> DataFrame:
    """Whether every department answered, and with how many courses: one that failed is not one that has none."""
    return feed.departments(_responses(spark, sf))


# a plan for every order: its courses are the parts of its lines, in the sections that the line's number says; parts up to a size are in the catalog
_DEPTS = ["CSCI", "MATH", "ART", "HIST"]
_RULES = [None, "Prerequisite: CSCI 103; requires a 2.0 GPA", "Prerequisite: consent", "prereq MATH 126 or CSCI 103", "No rules"]
_NOTES = [None, "Reserved for students in the School of Art. B.A. only", "Only open to undergraduate students", "Not available for History majors", "see the department", ""]
_MAJORS = ["Computer Science", "History", "Art", None]
_YEARS = ["Freshman", "Sophomore", "Junior", "Senior", None]
CLEARANCE = [(1, "exact", "MATH", "all MATH courses", "write to the office")]


def _one(values: list[str | None], key: str):
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.expr(key) % len(values) + 1).cast("int"))


def _sql_one(values: list[str | None], key: str) -> str:
    return "([" + ", ".join("null" if v is None else "'" + v + "'" for v in values) + f"])[cast({key} % {len(values)} as int) + 1]"


def checked(spark: SparkSession, sf: str, full_time: bool = False) -> tuple[DataFrame, DataFrame]:
    """Every planned course and every plan, judged."""
    code = lambda p: F.concat(_one(_DEPTS, p), F.lit(" "), (F.expr(p) + 100).cast("string"))
    text = lambda c: F.expr(c).cast("string")
    named = lambda p, n: F.concat(F.col(p).cast("string"), F.lit(f"-{n}"))
    # by order, where they are made distinct, summed and joined
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").repartition("l_orderkey").distinct()
    chosen = F.when(F.col("l_linenumber") == 7, F.array(F.lit("none"))).when(F.col("l_linenumber") % 2 == 0, F.array(named("l_partkey", 1), named("l_partkey", 2))).otherwise(F.array(named("l_partkey", 1)))
    typed = F.when(F.col("l_partkey") % 2 == 1, F.lower(code("l_partkey"))).otherwise(code("l_partkey"))
    plans = lines.select(F.col("l_orderkey").alias("plan_id"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("ord"), typed.alias("course"), chosen.alias("sections"))
    ends = lines.groupBy("l_orderkey").agg(F.min("l_partkey").alias("least"), F.max("l_partkey").alias("most"))
    o = table(spark, sf, "orders").join(ends, F.col("l_orderkey") == F.col("o_orderkey"))
    students = o.select(
        F.col("o_orderkey").alias("plan_id"), _one(_MAJORS, "o_custkey").alias("major"), _one(_YEARS, "o_custkey").alias("class_level"), F.when(F.col("o_custkey") % 9 != 0, 1.5 + (F.col("o_custkey") % 25) / 10).alias("gpa"),
        F.array_compact(F.array(F.when(F.col("o_custkey") % 2 == 0, "MATH 126"), F.when(F.col("o_orderkey") % 3 == 0, code("least")))).alias("completed"), F.array_compact(F.array(F.when(F.col("o_orderkey") % 4 == 0, code("most")))).alias("in_progress"),
    )
    p = F.col("p_partkey")
    hour = lambda n: F.concat((F.lit(n) + p % 10).cast("string"))
    section = lambda kind, n, link, notes, full, days, a, b: F.struct(
        F.lit(kind).alias("kind"), named("p_partkey", n).alias("section_id"), link.alias("link_code"), notes.alias("notes"), (p % 11 == 0).alias("is_cancelled"), full.alias("is_full"), days.alias("days"), a.alias("start_time"), b.alias("end_time")
    )
    none = F.lit(None).cast("string")
    lecture = section("lectures", 1, F.lit("A"), _one(_NOTES, "p_partkey"), p % 13 == 0, F.when(p % 17 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("M"))), F.concat(hour(8), F.lit(":00")), F.concat(hour(9), F.lit(":15")))
    lab = section("labs", 2, F.when(p % 10 == 3, "B").otherwise("A"), none, F.lit(False), F.array(F.lit("T")), F.when(p % 19 == 0, "TBA").otherwise(F.concat(hour(9), F.lit(":30"))), F.concat(hour(10), F.lit(":00")))
    catalog = table(spark, sf, "part").where("p_size <= 40").select(
        code("p_partkey").alias("code"), _one(_RULES, "p_partkey").alias("description"), (F.col("p_size") % 4 + 1).cast("double").alias("units"), (p % 3 == 0).alias("has_lab"), F.lit(False).alias("has_discussion"),
        (p % 7 == 0).alias("has_clearance"), (p % 4 == 0).alias("has_restrictions"), F.array(lecture, lab).alias("sections"),
    )
    return plan_check.validate(plans, students, catalog, spark.createDataFrame(CLEARANCE, "ord int, kind string, prefix string, required_for string, how_to string"), full_time)


_SQL_CODE = lambda p: f"{_sql_one(_DEPTS, p)} || ' ' || ({p} + 100)"
_ARRAY = lambda *cases: "list_filter([" + ", ".join(f"case when {c} then {s} end" for c, s in cases) + "], lambda f: f is not null)"
# each check as severities; the two notes rules that can hold say so by the number of a part's note
SQL_CHECKS = f"""
with lines as (select distinct l_orderkey as plan_id, l_linenumber as n, l_partkey as p from lineitem),
ends as (select plan_id, min(p) as least, max(p) as most from lines group by plan_id),
students as (select o_orderkey as plan_id, {_sql_one(_MAJORS, "o_custkey")} as major, {_sql_one(_YEARS, "o_custkey")} as level, case when o_custkey % 9 <> 0 then 1.5::double + cast(o_custkey % 25 as double) / 10 end as gpa,
  o_custkey % 2 = 0 as math_done, case when o_orderkey % 3 = 0 then least end as done, case when o_orderkey % 4 = 0 then most end as going from orders join ends on plan_id = o_orderkey),
rows as (select l.plan_id, l.n, l.p, l.n::bigint * 1000000000 + l.p as ord, case when l.p % 2 = 1 then lower({_SQL_CODE("l.p")}) else {_SQL_CODE("l.p")} end as course, s.* exclude (plan_id), p_partkey is not null as known, p_size % 4 + 1 as units,
  l.n <> 7 and p_partkey is not null as has_lecture, l.n % 2 = 0 and p_partkey is not null as chose_lab from lines l left join students s on s.plan_id = l.plan_id left join part on p_partkey = l.p and p_size <= 40),
live as (select *, has_lecture and p % 11 <> 0 as lec, chose_lab and p % 11 <> 0 as lab from rows),
slots as (select plan_id, ord, 'M' as day, (8 + p % 10) * 60 as a, (9 + p % 10) * 60 + 15 as b from live where lec and p % 17 <> 0 union all select plan_id, ord, 'T', (9 + p % 10) * 60 + 30, (10 + p % 10) * 60 from live where lab and p % 19 <> 0),
met as (select ord, plan_id, count(distinct other) as clashes from (select x.plan_id, x.ord, y.ord as other from slots x join slots y on x.plan_id = y.plan_id and x.day = y.day and x.ord <> y.ord and x.a < y.b and y.a < x.b) group by plan_id, ord),
noted as (select *, case when lec and known and p % 4 = 0 then p % 6 end as note, known and p % 4 = 0 as limited, lower(coalesce(major, '')) as m, coalesce(level is not null, false) as under from live),
found as (select noted.*, coalesce(clashes, 0) as clashes, {_ARRAY(
    ("done = p", "2"), ("going = p and done is distinct from p", "1"), ("p + 100 >= 400 and level in ('Freshman', 'Sophomore')", "1"), ("known and p % 7 = 0", "1"), ("known and p % 7 = 0 and p % 4 = 1", "1"), ("known and p % 7 = 0 and p % 4 = 1", "1"),
    ("known and p % 5 = 1 and (gpa is null or gpa < 2.0)", "2"), ("known and p % 5 = 1", "2"), ("known and p % 5 = 3", "2"), ("known and p % 5 = 2", "1"), ("not known", "1"), ("lec and p % 13 = 0", "2"),
    ("known and p % 3 = 0 and not chose_lab", "2"), ("known and p % 3 = 0 and chose_lab and has_lecture and p % 10 = 3", "2"), ("limited and (note is null or note in (0, 5))", "1"),
    ("limited and note = 1 and m <> '' and m <> 'art'", "2"), ("limited and note = 2 and not under", "2"), ("limited and note = 3 and m = 'history'", "2"), ("limited and note = 4", "1"), ("(lec and p % 17 = 0) or (lab and p % 19 = 0)", "1"),
)} as f from noted left join met on met.ord = noted.ord and met.plan_id = noted.plan_id),
courses as (select plan_id, ord, course, known, units, len(f) + clashes as n_reasons, greatest(coalesce(list_max(f), 0), case when clashes > 0 then 2 else 0 end) as worst from found)
"""


@query("plan_validate", SQL_CHECKS + "select plan_id, ord, course, case worst when 2 then 'fail' when 1 then 'warning' else 'pass' end as status, cast(n_reasons as int) as n_reasons from courses")
def plan_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Every course of every plan, with its status and the number of its reasons."""
    return checked(spark, sf)[0].select("plan_id", "ord", "course", "status", "n_reasons")


@query("plan_overall", SQL_CHECKS + """, t as (select plan_id, coalesce(sum(case when known then units end), 0)::double as total_units, max(worst) as worst, bool_or(not known) as lost from courses group by plan_id)
select plan_id, case when worst = 2 then 'invalid' when worst = 1 or lost or total_units > 18 then 'warning' else 'valid' end as overall, total_units, cast(case when total_units > 18 then 1 else 0 end + case when lost then 1 else 0 end as int) as n_warnings from t
""")  # fmt: skip
def plan_overall(spark: SparkSession, sf: str) -> DataFrame:
    return checked(spark, sf)[1].select("plan_id", "overall", "total_units", F.size("warnings").alias("n_warnings"))

"""The thin queries of the numbered operators, with SQL where SQL can express them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordloom.llm import clustering, decontamination, language_id, mixing, near_duplicates, neighbours, quality, secrets, substring_dedup, suffix_dedup, toxicity, url_filter, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# fixed values: verdict, host and path of each rule, and the names of listed domains
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
LISTED = [f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to weights 5, 2, 1 at 150% of their words, at most twice each."""
    return mixing.mix_digest(_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as ord
  from documents),
per as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as sid from sized group by source),
weighed as (select *, [5.0::double, 2.0::double, 1.0::double][cast((sid - 1) % 3 + 1 as int)] as w, source_size * 2.0::double as cap, cast(sum(source_size) over () as double) * 1.5::double as total from per),
filled as (select *, cap * sum(w) over (order by cap / w, sid rows between current row and unbounded following)
             <= w * (total - coalesce(sum(cap) over (order by cap / w, sid rows between unbounded preceding and 1 preceding), 0)) as filled_up from weighed),
goal as (select source, source_size, case when filled_up then cap else least(cap, w * ((total - coalesce(sum(case when filled_up then cap end) over (), 0)) / sum(case when not filled_up then w end) over ())) end as target from filled),
quotas as (select s.sid, g.source, g.source_size, g.target, cast(floor(g.target + 0.5) as bigint) as quota from goal g join per s on g.source is not distinct from s.source),
bounds as (select sid, coalesce(floor(sum(quota) over (order by sid rows between unbounded preceding and 1 preceding)::bigint::double / sum(quota) over ()::bigint::double * 4294967296.0::double), 0)::bigint as lo,
                  floor(sum(quota) over (order by sid rows between unbounded preceding and current row)::bigint::double / sum(quota) over ()::bigint::double * 4294967296.0::double)::bigint as hi
           from quotas where quota > 0),
plan as (select *, (words + block - 1) // block as n_slots from (select words, greatest(1, least(2048, words // 65536)) as block from (select coalesce(sum(quota), 0)::bigint as words from quotas))),
points as (select t, ((t % 2147483648) * 2654435769) % 4294967296 as p from (select unnest(range(n_slots)) as t from plan)),
slots as (select sid, t, row_number() over (partition by sid order by t) - 1 as k from points join bounds on p >= lo and p < hi),
gives as (select q.sid, least(count(*) * any_value(block), any_value(source_size) * 2)::bigint as g from slots s join quotas q on s.sid = q.sid, plan group by q.sid),
placed as (select s.doc_id, s.size, q.source_size, q.target, q.sid, coalesce(gives.g, 0) as g, block,
             cast(coalesce(sum(s.size) over (partition by s.source order by s.ord, s.doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as place
           from sized s join quotas q on s.source is not distinct from q.source left join gives on gives.sid = q.sid, plan),
spread as (select *, greatest(0, least(place + size, g) - place) as once, greatest(0, least(place + source_size + size, g) - place - source_size) as again from placed)
select doc_id, size, source_size, target, cast(once + again as bigint) as taken, t as first_slot,
       cast(case when once > 0 then (place + once - 1) // block - place // block + 1 else 0 end
            + case when again > 0 then (place + source_size + again - 1) // block - (place + source_size) // block + 1 else 0 end as bigint) as n_parts
from spread left join slots on once > 0 and slots.sid = spread.sid and slots.k = place // block
"""


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page's url."""
    return url_filter.url_verdicts(_table(spark, sf_dir, "pages"), RULES, spark.createDataFrame([(k,) for k in LISTED], "key string"))


OP4_SQL = f"""
with parts as (
  select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), '{url_filter.UPPER}', '{url_filter.LOWER}') as host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') as path from pages),
ruled as (
  select *, regexp_replace(host, '\\.?(:[0-9]*)?$', '') as bare, case
    when ('.' || host) like '%.www.example.com' and path like '/en/%' then 'www.example.com/en/'
    when ('.' || host) like '%.example.com' and path like '/en/%' then 'example.com/en/'
    when ('.' || host) like '%.net' and path like '/es/%' then 'net/es/'
    when ('.' || host) like '%.net' and path like '/fr/%' then 'net/fr/'
    when ('.' || host) like '%.com' and path like '/%' then 'com/' end as rule
  from parts)
select page_id, host, path, rule, case
    when rule in ('www.example.com/en/', 'com/') then 'allow' when rule is not null then 'block'
    when {" or ".join(f"('.' || bare) like '%.{k}'" for k in LISTED)} then 'block' else 'allow' end as verdict
from ruled
"""


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it contains, with the tiles' coverage of the item."""
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents without windows of 20 that start earlier."""
    return substring_dedup.substring_digest(_table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents without strings of 200 that also start elsewhere."""
    return suffix_dedup.suffix_digest(_table(spark, sf_dir, "documents"))


OP5_SQL = r"""
with worded as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - 18)) as s from worded where len(w) >= 20),
wins as (select doc_id, s, md5(array_to_string(w[s:s+19], ' ')) as h from starts),
firsts as (select h, min((doc_id, s)) as f from wins group by h),
gone as (select distinct doc_id, unnest(range(s, s + 20)) as p from (select doc_id, s from wins join firsts using (h) where (doc_id, s) > f) x),
lost as (select doc_id, list(p) as ps from gone group by doc_id),
kept as (select wd.doc_id, len(wd.w) as n, coalesce(len(l.ps), 0) as g, wd.w as w, coalesce(l.ps, []) as ps from worded wd left join lost l on wd.doc_id = l.doc_id)
select doc_id, cast(n as bigint) as n_words, cast(g as bigint) as n_removed,
       sha256(array_to_string([w[i] for i in range(1, n + 1) if not list_contains(ps, i)], ' ')) as kept_sha256 from kept
"""


OP10_SQL = r"""
with raw as (select doc_id, encode(coalesce(text, '')) as b from documents),
starts as (select doc_id, b, unnest(range(1, octet_length(b) - 198)) as s from raw where octet_length(b) >= 200),
hashed as (select doc_id, s, md5(b[s:s+199]) as h from starts),
twice as (select h from hashed group by h having count(*) > 1),
hits as (select doc_id, s from hashed semi join twice using (h)),
marked as (select *, case when s > lag(s) over (partition by doc_id order by s) + 200 or lag(s) over (partition by doc_id order by s) is null then 1 else 0 end as new from hits),
numbered as (select *, sum(new) over (partition by doc_id order by s) as part from marked),
parts as (select doc_id, min(s) as a, max(s) + 200 as z from numbered group by doc_id, part),
lost as (select doc_id, list(a order by a) as begins, list(z order by a) as ends, sum(z - a) as gone from parts group by doc_id),
cut as (select r.doc_id, b, coalesce(gone, 0) as gone, coalesce(len(begins), 0) as n, list_concat([1], coalesce(ends, [])) as keep_from, list_concat(coalesce(begins, []), [octet_length(b) + 1]) as keep_to
        from raw r left join lost l on r.doc_id = l.doc_id)
select doc_id, cast(octet_length(b) as bigint) as n_bytes, cast(gone as bigint) as n_removed, cast(n as bigint) as n_spans,
       sha256(unhex(array_to_string([case when keep_to[i] > keep_from[i] then hex(b[keep_from[i]:keep_to[i]-1]) else '' end for i in range(1, n + 2)], ''))) as kept_sha256 from cut
"""


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    return secrets.secret_digest(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language_id.language_digest(_table(spark, sf_dir, "documents"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every vector whose id is divisible by 100."""
    return neighbours.search(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under Jaccard similarity of at least 0.75."""
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"))


OP8_SQL = rf"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(text, '{url_filter.UPPER}', '{url_filter.LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, list_distinct(case when len(w) >= 5 then [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]
                                           when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from worded),
items as (select doc_id, len(s) as n, unnest(s) as g from sets),
links as (select a.doc_id as u, b.doc_id as v from items a join items b on a.g = b.g and a.doc_id <> b.doc_id
          group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach as (select doc_id as u, doc_id as v from documents union select r.u, l.v from reach r join links l on r.v = l.u),
least_reached as (select u, min(v) as c from reach group by u)
select doc_id, cast(coalesce(len(s), 0) as bigint) as n_shingles, c as component_id, c = doc_id as kept
from sets join least_reached on u = doc_id
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    return quality.quality_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector after five rounds from 40 of them."""
    return clustering.clusters(_table(spark, sf_dir, "embeddings"), k=40, rounds=5, seed="2", dim=64)


def _op11_sql(rounds: int) -> str:
    """Each round as two steps: nearest centroids by exact distances, then floors of exact means."""
    apart = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = r"""
with kept as (
  select vec_id, row_number() over () as rid, list_transform(embedding, lambda e: cast(floor(cast(e as double) * 256) as bigint)) as x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is not null and isfinite(cast(e as double)))) = 64),
c0 as (select row_number() over (order by h, x) - 1 as k, x as c from (select sha256('2:' || vec_id) as h, x from kept where vec_id is not null order by h, x limit 40)),
"""
    for n in range(rounds + 1):
        steps += f"a{n} as materialized (select rid, arg_min(k, (d, k)) as k, min(d) as d from (select rid, k, cast({apart} as bigint) as d from kept, c{n}) group by rid),\n"
        if n < rounds:
            steps += f"""m{n} as (select k, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as c
  from (select k, i, sum(v)::hugeint as s, count(*)::hugeint as n from (select k, unnest(range(64)) as i, unnest(x) as v from kept join a{n} using (rid)) group by k, i) group by k),
c{n + 1} as materialized (select c{n}.k, coalesce(m{n}.c, c{n}.c) as c from c{n} left join m{n} using (k)),
"""
    return steps.rstrip(",\n") + f"""
select vec_id, cast(k as int) as cluster, d as distance, cast(sum(d) over (partition by k) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
       sha256(array_to_string(c, ',')) as centroid_sha256
from a{rounds} join kept using (rid) join c{rounds} using (k)
"""


OP11_SQL = _op11_sql(5)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    return toxicity.toxicity_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every vector."""
    return whitening.whitening_digest(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_decontamination": op1_decontamination, "op2_mix": op2_mix, "op3_language_id": op3_language_id, "op4_url_filter": op4_url_filter, "op5_substring_dedup": op5_substring_dedup, "op6_secrets": op6_secrets, "op7_neighbours": op7_neighbours, "op8_near_duplicates": op8_near_duplicates, "op9_quality": op9_quality, "op10_suffix_dedup": op10_suffix_dedup, "op11_centroids": op11_centroids, "op12_toxicity": op12_toxicity, "op13_whitening": op13_whitening}
ORACLES: dict[str, str] = {"op2_mix": OP2_SQL, "op4_url_filter": OP4_SQL, "op5_substring_dedup": OP5_SQL, "op8_near_duplicates": OP8_SQL, "op10_suffix_dedup": OP10_SQL, "op11_centroids": OP11_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

"""Each stage of the pipeline, on what the one before it kept, against plain rules and SQL."""

import duckdb
import pytest

import corpus_pipeline
from recordloom.llm import secrets
from recordloom.llm.queries import OP8_SQL, queries
from recordloom.llm.store import settle
from tests.llm.test_models import plain_base
from tests.llm.test_pairs import contaminated_by_rule, folded_words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(name, documents before, documents after) of the stages that keep documents."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = settle(stage(spark, docs, SF))
        out.append((name, docs, done))
        docs = done
    return {name: (a, b) for name, a, b in out}


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_quality_keeps_what_the_score_says(spark, stages):
    before, after = stages["quality"]
    good = sorted(r["doc_id"] for r in queries()["op9_quality"](spark, SF).collect() if r["predicted"] == 1)
    assert ids(after) == good and len(good) < before.count()


def test_one_document_of_each_component_stays(spark, stages):
    before, after = stages["near_duplicates"]
    con = duckdb.connect()
    con.register("rows", before.select("doc_id", "text").toPandas())
    con.execute("create table documents as select * from rows")
    component = {r[0]: r[2] for r in con.execute(OP8_SQL).fetchall()}
    kept = ids(after)
    assert sorted(component[k] for k in kept) == sorted(set(component.values())) and len(kept) < len(component)


def test_contaminated_documents_go(spark, stages):
    before, after = stages["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seeds = {}
    for i, t in items:
        w = folded_words(t)
        for k in range(len(w) - 4):
            seeds.setdefault(tuple(w[k : k + 5]), set()).add((i, t))
    hit = set()
    for r in before.select("doc_id", "text").collect():
        w = folded_words(r["text"])
        near = {x for k in range(len(w) - 4) for x in seeds.get(tuple(w[k : k + 5]), ())}
        # a tile lies within some seeds' surroundings, so the words around them are enough
        spots = sorted({j for k in range(len(w) - 4) if tuple(w[k : k + 5]) in seeds for j in range(max(0, k - 60), min(len(w), k + 65))})
        cut = [w[j] if k and spots[k - 1] == j - 1 else b"zzgapzz " + w[j] for k, j in enumerate(spots)]
        part = b" ".join(cut).decode()
        if near and contaminated_by_rule([(r["doc_id"], part)], sorted(near), 5, 0.5):
            hit.add(r["doc_id"])
    assert ids(after) == sorted(set(ids(before)) - hit)


def test_secrets_are_replaced_and_nothing_else(spark):
    before = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")  # the smaller table has no secret
    after = settle(corpus_pipeline.secret_stage(spark, before, SF))
    spans = {r["doc_id"]: r["spans"] for r in secrets.secret_digest(before).collect()}
    new = {r["doc_id"]: r["text"] for r in after.collect()}
    changed = 0
    for r in before.collect():
        found = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans[r["doc_id"]].split(",") if x)]
        assert [s for s in found if s[0] != "crf"] == plain_base(r["text"])
        out, at = [], 0
        for lo, hi in merged(sorted((a, b) for _, a, b in found)):
            out += [r["text"][at:lo], "[SECRET]"]
            at = hi
        assert new[r["doc_id"]] == "".join([*out, (r["text"] or "")[at:]])
        changed += bool(found)
    assert changed and len(new) == before.count()


def merged(spans):
    """Spans that overlap as one."""
    out = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out

"""State that survives: attempt budgets, committed versions, runs that are killed and go on."""

import datetime
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from recordloom.streaming import budget, run
from recordloom.streaming.versions import Versions

SF = "/root/testdata/sf0.001"
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def attempt_rows(n, seed=1):
    r = random.Random(seed)
    hours = sorted(r.sample(range(3000), n))
    return [(r.choice(["a", "b", "hot", "hot", "hot"]), k, START + datetime.timedelta(hours=h), r.random() < 0.8) for k, h in enumerate(hours)]


def plain_budget(rows, most, pause):
    """Each attempt's number, one row after the other."""
    out, spent = [], {}
    for key, id_, ts, failed in rows:
        failures, last = spent.get(key, (0, None))
        failures = 0 if last is not None and ts - last > pause else failures
        failures = failures + 1 if failed else 0
        spent[key] = (failures, ts)
        out.append((key, id_, failed, failures, failures > most))
    return sorted(out)


def put(spark, rows, path):
    spark.createDataFrame(rows, "key string, id long, ts timestamp, failed boolean").coalesce(1).write.mode("append").parquet(path)


def test_budget_goes_on_over_batches_and_restarts(spark, tmp_path):
    rows, src, out = attempt_rows(400), str(tmp_path / "in"), str(tmp_path / "out")
    schema = "key string, id long, ts timestamp, failed boolean"
    for k in range(0, 400, 100):
        put(spark, rows[k : k + 100], src)
        if k in (100, 300):  # two runs of two batches each, the second from the checkpoint of the first
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
            budget.run(budget.budgeted(budget.attempts(stream, "key", "id", F.col("failed")), 3, datetime.timedelta(days=2)), out)
    got = budget.results(spark, out)
    assert sorted((r["key"], r["id"], r["failed"], r["attempt"], r["refused"]) for r in got.collect()) == plain_budget(rows, 3, datetime.timedelta(days=2))
    assert got.where("refused").count() > 20


def test_budget_without_usable_rows(spark, tmp_path):
    put(spark, [(None, 1, START, True), ("a", 2, None, True), ("a", None, START, None)], str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, id long, ts timestamp, failed boolean").parquet(str(tmp_path / "in"))
    budget.run(budget.budgeted(budget.attempts(stream, "key", "id", F.col("failed"))), str(tmp_path / "out"))
    assert [(r["key"], r["id"], r["attempt"], r["refused"]) for r in budget.results(spark, str(tmp_path / "out")).collect()] == [("a", None, 0, False)]


def last_wins(old, new):
    return old.join(new.select("k"), "k", "left_anti").unionByName(new)


def kv(spark, *rows):
    return spark.createDataFrame(list(rows), "k long, v string")


def shown(df):
    return sorted((r["k"], r["v"]) for r in df.collect())


def test_versions_are_replay_safe_and_whole(spark, tmp_path):
    t = Versions(spark, str(tmp_path / "t"), "k long, v string", ["k"], buckets=4)
    assert t.rows().collect() == [] and t.numbers() == []
    assert t.write(kv(spark, *[(k, "a") for k in range(20)]), last_wins, "s", 0)
    assert not t.write(kv(spark, (1, "again")), last_wins, "s", 0)  # the same batch again
    assert t.write(kv(spark, (1, "b"), (99, "new")), last_wins, "s", 7)  # a gap
    assert not t.write(kv(spark, (1, "late")), last_wins, "s", 3)
    want = sorted([(k, "a") for k in range(20) if k != 1] + [(1, "b"), (99, "new")])
    assert shown(t.rows()) == want and t.numbers() == [1, 2] and t.latest()["streams"] == {"s": 7}
    assert shown(t.rows(1)) == [(k, "a") for k in range(20)]  # older versions stay whole
    untouched = [b for b in t.about(1)["folders"] if t.about(1)["folders"][b] == t.about(2)["folders"][b]]
    assert untouched  # buckets that no row fell in were not written again


def test_a_kill_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    t = Versions(spark, str(tmp_path / "t"), "k long, v string", ["k"], buckets=2)
    t.write(kv(spark, (1, "a"), (2, "a")), last_wins, "s", 0)

    def killed(about):
        raise KeyboardInterrupt

    monkeypatch.setattr(t, "_commit", killed)
    with pytest.raises(KeyboardInterrupt):
        t.write(kv(spark, (1, "b")), last_wins, "s", 1)
    again = Versions(spark, str(tmp_path / "t"), "k long, v string", ["k"], buckets=2)
    assert shown(again.rows()) == [(1, "a"), (2, "a")]
    assert again.write(kv(spark, (1, "b")), last_wins, "s", 1) and shown(again.rows()) == [(1, "b"), (2, "a")]
    assert again.expire(keep=1) >= 1 and again.numbers() == [2] and shown(again.rows()) == [(1, "b"), (2, "a")]
    assert len([p for p in (tmp_path / "t/data").iterdir()]) <= 2  # what nothing names is gone


def test_a_version_is_never_written_over(spark, tmp_path):
    t = Versions(spark, str(tmp_path / "t"), "k long, v string", ["k"])
    t.write(kv(spark, (1, "a")), last_wins)
    with pytest.raises(Exception, match="exists"):
        t._commit(t.latest())
    assert shown(t.rows()) == [(1, "a")]


def test_a_merge_may_empty_a_bucket(spark, tmp_path):
    t = Versions(spark, str(tmp_path / "t"), "k long, v string", ["k"], buckets=1)
    t.write(kv(spark, (1, "a")), last_wins)
    t.write(kv(spark, (1, "gone")), lambda old, new: old.join(new.select("k"), "k", "left_anti"))
    assert t.rows().collect() == [] and t.numbers() == [1, 2]


def records(spark, src):
    """Orders in four files by key, with a second state of some."""
    rows = spark.read.parquet(f"{SF}/orders.parquet").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").cast("long").alias("seq"), F.when(F.col("o_orderkey") % 3 == 0, "excluded_graduate").when(F.col("o_orderkey") % 3 == 1, "included").alias("class"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("pending").alias("status"), F.col("o_orderdate").cast("timestamp").alias("updated"))
    cuts = rows.approxQuantile("key", [0.25, 0.5, 0.75], 0.0)
    for lo, hi in zip([-1, *cuts], [*cuts, 1e18], strict=True):
        rows.where((F.col("key") > lo) & (F.col("key") <= hi)).coalesce(1).write.mode("append").parquet(src)
    later = rows.where("key % 5 = 0").withColumns({"status": F.lit("complete"), "updated": F.expr("updated + interval 10 years"), "seq": F.lit(-1).cast("long")})
    later.coalesce(1).write.mode("append").parquet(src)
    return rows, later


def test_a_killed_run_goes_on(spark, tmp_path):
    rows, later = records(spark, str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    whole = run.states(spark, str(tmp_path / "whole"), buckets=3)
    assert run.process(stream(), whole, str(tmp_path / "c1"), "r1") == 5
    part = run.states(spark, str(tmp_path / "part"), buckets=3)
    with pytest.raises(StreamingQueryException, match="stopped before batch 2"):
        run.process(stream(), part, str(tmp_path / "c2"), "r1", stop_before=2)
    assert part.latest()["streams"] == {"records": 1}  # two batches are committed
    assert run.process(stream(), part, str(tmp_path / "c2"), "r1") == 3
    assert run.process(stream(), part, str(tmp_path / "c2"), "r1") == 0  # nothing is left
    show = lambda t: sorted(map(str, t.rows().collect()))
    assert show(part) == show(whole) and part.rows().count() == rows.count()
    changed = {r["key"]: r for r in part.rows().where("key % 5 = 0").collect()}
    first = {r["key"]: r["seq"] for r in rows.collect()}
    assert all(r["status"] == "complete" and r["seq"] == first[k] and r["first_run"] == "r1" for k, r in changed.items())  # sequences stay, states move


def test_extracts_partition_the_states_and_runs_are_accounted_for(spark, tmp_path):
    rows, _ = records(spark, str(tmp_path / "in"))
    t = run.states(spark, str(tmp_path / "t"), buckets=2)
    run.process(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in")), t, str(tmp_path / "c"), "r1")
    got = run.regenerated(t)
    assert got.count() == rows.count() == got.select("key").distinct().count()
    assert {r["extract"] for r in got.select("extract").distinct().collect()} == {"included", "excluded", "review", "errors"}
    log = run.write_extracts(t, str(tmp_path / "out")).orderBy("version").collect()
    assert [r["batch"] for r in log] == [0, 1, 2] and log[-1]["included"] == got.where("extract = 'included'").count() and log[0]["included"] < log[-1]["included"]
    back = spark.read.option("header", True).csv(str(tmp_path / "out" / str(t.latest()["version"])))
    assert sorted((r["extract"], int(r["key"])) for r in back.select("extract", "key").collect()) == sorted((r["extract"], r["key"]) for r in got.collect())
    empty = run.states(spark, str(tmp_path / "none"))
    assert run.regenerated(empty).count() == 0 and run.provenance(empty).count() == 0

"""Exports that are whole or not there, and SQL functions that equal the column functions."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from recordloom.dom import nodes as dom
from recordloom.functions import codes, sql
from recordloom.functions import text as tx
from recordloom.sources import export, files, sqlite

SF = "/root/testdata/sf0.001"
VALUES = [None, "", " csci  104l ", "MATH-225", "225x", "a1b2", "10:30", " 9 : 05 ", "25:99", "TBA", "10:3x", "20263", "2026", "19991", "Title *†", "x + ", "A  B\tC", "ÄRGER", "+1:-2"]


def documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    header = F.create_map(F.lit("Program"), F.col("source"), F.lit("Program ID"), F.col("doc_id").cast("string"))
    return rows.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"), header.alias("header"), F.coalesce("text", F.lit("")).alias("body"))


def shown(df):
    return sorted((r["file"], tuple(sorted(r["header"].items())), r["body"]) for r in df.collect())


def test_written_documents_read_back_equal(spark, tmp_path):
    at, rows = str(tmp_path / "out"), documents(spark)
    assert export.read(spark, at).collect() == []  # nothing was committed yet
    export.write(rows.repartition(5), at)
    assert shown(export.read(spark, at)) == shown(rows)
    manifest = json.loads((tmp_path / "out/manifest.json").read_text())
    assert manifest["records"] == rows.count() == sum(f["records"] for f in manifest["files"]) and len(manifest["files"]) == 5
    export.write(rows.limit(3), at, append=True)
    assert export.read(spark, at).count() == rows.count() + 3
    export.write(rows.limit(2), at)
    assert export.read(spark, at).count() == 2
    export.write(rows.limit(0), at)
    assert export.read(spark, at).count() == 0


def test_a_failing_task_leaves_nothing_visible(spark, tmp_path):
    at, rows = str(tmp_path / "out"), documents(spark)
    export.write(rows.limit(4), at)
    before = (tmp_path / "out/manifest.json").read_text()
    broken = rows.repartition(4).withColumn("body", F.when(F.col("file") == "d7.txt", F.raise_error(F.lit("lost"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="lost"):
        export.write(broken, at)
    assert (tmp_path / "out/manifest.json").read_text() == before and export.read(spark, at).count() == 4


def test_a_changed_file_is_refused(spark, tmp_path):
    at = str(tmp_path / "out")
    export.write(documents(spark).coalesce(1), at)
    (name,) = (tmp_path / "out/records").iterdir()
    name.write_text(name.read_text().replace("d1.txt", "d0.txt", 1))
    with pytest.raises(Exception, match="not what was committed"):
        export.read(spark, at).collect()
    with pytest.raises(Exception, match="need the columns"):
        spark.createDataFrame([("x",)], "file string").write.format("records").mode("append").save(at)


def test_composed_files_come_from_exported_records(spark, tmp_path):
    export.write(documents(spark), str(tmp_path / "out"))
    text = files.composed(export.read(spark, str(tmp_path / "out"))).orderBy("file").first()
    assert text["text"].startswith("Program: ") and files.MARKER in text["text"]


def test_sql_functions_equal_columns(spark):
    sql.register(spark)
    spark.createDataFrame([(v,) for v in VALUES], "v string").createOrReplaceTempView("typed")
    got = spark.sql("select normal_code(v) a, strip_footnotes(v) b, folded(v) c, clock_minutes(v) d, academic_year(v) e from typed")
    v = F.col("v")
    want = spark.table("typed").select(codes.normal_code(v).alias("a"), tx.strip_footnotes(v).alias("b"), tx.folded(v).alias("c"), codes.minutes(v).alias("d"), codes.academic_year(v).alias("e"))
    assert got.collect() == want.collect()


def test_a_query_in_sql_over_customers(spark):
    sql.register(spark)
    spark.read.parquet(f"{SF}/customer.parquet").createOrReplaceTempView("customer_rows")
    got = spark.sql("select normal_code(lower(c_mktsegment) || c_custkey || 'x') as code, count(*) as n from customer_rows group by all")
    c = F.concat(F.lower("c_mktsegment"), F.col("c_custkey").cast("string"), F.lit("x"))
    want = spark.table("customer_rows").groupBy(codes.normal_code(c).alias("code")).agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_pages_as_tables_in_sql(spark):
    sql.register(spark)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    pages.unionByName(pages.limit(1).withColumn("html", F.lit(None).cast("string")).withColumn("page_id", F.lit(-1).cast("long"))).createOrReplaceTempView("page_rows")
    got = spark.sql("select p.page_id, n.tag, count(*) as n from page_rows p, lateral parse_html(p.html) n group by all")
    want = dom.nodes(pages).groupBy("page_id", "tag").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("parts", [1, 3])
def test_sqlite_tables(spark, tmp_path, parts):
    spark.dataSource.register(sqlite.Sqlite)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    con = sqlite3.connect(tmp_path / "state.db")
    con.execute('create table links (catoid TEXT, seq INTEGER, "a ""b" REAL, raw BLOB, note)')
    rows = [("22", k, k / 2 if k % 3 else None, bytes([k]), f"n{k}" if k % 2 else None) for k in range(20)] + [("23", 20, 1.0, None, "x'y")]
    con.executemany("insert into links values (?, ?, ?, ?, ?)", rows)
    con.execute("create table empty (k INTEGER)")
    con.commit()
    con.close()
    load = lambda t: spark.read.format("sqlite").option("table", t).option("partitions", parts).load(str(tmp_path / "state.db"))
    df = load("links")
    assert df.dtypes == [("catoid", "string"), ("seq", "bigint"), ('a "b', "double"), ("raw", "binary"), ("note", "string")]
    assert sorted((r[0], r[1], r[2], None if r[3] is None else bytes(r[3]), r[4]) for r in df.collect()) == sorted(rows) and df.rdd.getNumPartitions() == parts
    assert [r["seq"] for r in df.where("catoid = '23' and seq > 3").collect()] == [20] and df.where("note = \"x'y\"").count() == 1
    assert df.where("seq = 4").orderBy("seq").select("catoid").collect()[0][0] == "22" and load("empty").count() == 0
    with pytest.raises(Exception, match="no table"):
        load("none").count()

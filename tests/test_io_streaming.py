"""Files in and out, and the streaming forms against their batch forms."""

import zipfile

import pytest
from pyspark.sql import functions as F

from recordloom.plans import relational
from recordloom.sources import files
from recordloom.streaming import events as ev

SF = "/root/testdata/sf0.001"


def test_corpus_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a.txt", {"Program": "Art: Studio", "Credential": "BA"}, "# Art\n\nbody")], "file string, header map<string,string>, body string")
    text = files.composed(rows).first()["text"]
    (tmp_path / "a.txt").write_text(text + "\n")
    got = files.text_corpus(spark, str(tmp_path)).first()
    assert got["file"] == "a.txt" and got["body"] == "# Art\n\nbody" and got["header"]["Program"] == "Art: Studio" and got["header"]["Breadcrumb"] == ""


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'say "x"\ny', None), (2, "b,c", 5)], "k int, t string, n int").withColumn("extra", F.lit(1))
    files.write_csv(rows, str(tmp_path / "c"), ["k", "t", "n"])
    got = files.csv_rows(spark, str(tmp_path / "c"), "k int, t string, n int").orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, 'say "x"\ny', None), (2, "b,c", 5)]


def test_version_gate(spark):
    rows = spark.createDataFrame([("1.4", 1)], "v string, x int")
    assert files.require_version(rows, "v", "1.4").count() == 1
    with pytest.raises(Exception, match="v must be 1.5"):
        files.require_version(rows, "v", "1.5").collect()


def test_extracts_partition(spark):
    rows = spark.createDataFrame([("included", "complete"), ("excluded_minor", None), ("manual_review", "pending"), ("included", "failed"), (None, None)], "class string, status string")
    assert {k: v.count() for k, v in files.extracts(rows).items()} == {"included": 1, "excluded": 1, "review": 2, "errors": 1}
    m = files.manifest(spark.createDataFrame([("b", "2"), ("a", "1")], "file string, hash string")).first()
    assert m["n_files"] == 2 and m["manifest"] == '{"a":"1","b":"2"}'


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    path = tmp_path / "w.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><t>x</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c t="inlineStr"><is><t>in</t></is></c></row><row><c t="s"><v>1</v></c><c><v>7</v></c></row></sheetData></worksheet>')
    spark.dataSource.register(files.Workbook)
    got = spark.read.format("workbook").load(str(path)).orderBy("row").collect()
    assert [r["cells"] for r in got] == [["name", "in"], ["x", "7"]]


def streamed(spark, tmp_path, make, name):
    """What a stream over the events, cut into files by time, has put out at its end, as an append."""
    src = tmp_path / "in"
    rows = spark.read.parquet(f"{SF}/events.parquet")
    cut = rows.approxQuantile("event_id", [0.5], 0.0)[0]
    rows.where(F.col("event_id") <= cut).coalesce(1).write.mode("append").parquet(str(src))
    rows.where(F.col("event_id") > cut).coalesce(1).write.mode("append").parquet(str(src))
    end = rows.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp_ntz"))
    end.coalesce(1).write.mode("append").parquet(str(src))
    q = make(ev.event_stream(spark, str(src), rows.schema, 100)).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(180)
    return spark.table(name)


@pytest.mark.parametrize("form", ["tumbling", "sliding", "sessions"])
def test_streams_equal_batches(spark, tmp_path, form):
    batch = {"tumbling": relational.tumbling_window, "sliding": relational.sliding_window, "sessions": relational.session_window}[form](spark, SF)
    got = streamed(spark, tmp_path, getattr(ev, form), f"s_{form}").where("start < '2029-01-01'")
    key = [c for c in batch.columns if c != "total"]
    show = lambda df: sorted(tuple(str(v) for v in r) for r in df.select(*key).withColumn("start", F.col("start").cast("timestamp")).collect())
    assert show(got) == show(batch)


def test_hash_listing_and_merged_stores(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    got = files.hash_listing(spark, str(tmp_path), "*.txt").collect()
    assert [(r["file"], r["hash"][:8]) for r in got] == [("a.txt", "2d711642")]
    a, b = spark.createDataFrame([(1, "x")], "id int, t string"), spark.createDataFrame([(1, "y", 5)], "id int, t string, n int")
    assert sorted(map(str, files.merged_stores([a, b]).collect())) == ["Row(t='x', n=None)", "Row(t='y', n=5)"]

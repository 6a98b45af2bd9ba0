"""A run over a stream of records: states that are committed batch by batch, and extracts of the last commit.

A record is included, excluded or up for review by its class, and complete, pending or failed by its status.  Each batch
is merged into the states (known keys keep their sequence and the run that first saw them), counted, and
committed; a run that stops goes on with the first batch that is not committed.  All extracts come from a
committed version, never from what a run still holds.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators import relational as rel
from recordloom.sources.files import extracts
from recordloom.streaming.versions import Versions

STATE = "key long, seq long, class string, status string, updated timestamp, first_run string"
COUNTS = "included long, excluded long, review long, errors long, pending long"


def states(spark: SparkSession, path: str, buckets: int = 16) -> Versions:
    return Versions(spark, path, STATE, ["key"], buckets)


def merged(run: str):
    """Known keys keep their sequence and first run; of several rows of a key in one batch the last updated counts."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        rows = rel.keep_last(new.where("key is not null").withColumn("first_run", F.lit(run)), ["key"], "updated")
        return rel.upsert(old, rows.select(old.columns), ["key"], ["seq", "first_run"])

    return merge


def kinds(rows: DataFrame) -> dict[str, Column]:
    """The extract that a state belongs to, and whether it is to be done, as conditions."""
    c, failed = F.col("class"), F.coalesce(F.col("status") == "failed", F.lit(False))
    return {
        "included": (c == "included") & ~failed, "excluded": c.startswith("excluded_") & ~failed,
        "review": ((c == "manual_review") | c.isNull()) & ~failed, "errors": failed, "pending": (c == "included") & (F.col("status") == "pending"),
    }


def counts(rows: DataFrame) -> DataFrame:
    """One row of COUNTS."""
    return rows.agg(*[F.count_if(c).alias(k) for k, c in kinds(rows).items()])


def process(stream: DataFrame, table: Versions, checkpoint: str, run: str, stop_before: int | None = None) -> int:
    """Take all that has arrived of a stream of (key, seq, class, status, updated) into `table`; the number of batches committed.

    `stop_before` makes the run fail before it commits that batch, as a kill would.
    """
    done = []

    def take(batch: DataFrame, batch_id: int) -> None:
        if stop_before is not None and batch_id >= stop_before:
            raise RuntimeError(f"stopped before batch {batch_id}")
        batch = batch.persist()  # read for its buckets, then merged; lost parts are computed again
        if table.write(batch, merged(run), "records", batch_id, lambda rows: {"run": run, "batch": batch_id, "touched": rows.count()}):
            done.append(batch_id)
        batch.unpersist()

    q = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return len(done)


def regenerated(table: Versions) -> DataFrame:
    """(extract, key, seq, class, status): every extract of the last committed version; each state is in one."""
    parts = [df.select(F.lit(name).alias("extract"), "key", "seq", "class", "status") for name, df in extracts(table.rows()).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_extracts(table: Versions, path: str) -> DataFrame:
    """Every extract as files under `path`/<version>, and the run's summary row."""
    version = table.latest()["version"]
    regenerated(table).write.mode("overwrite").partitionBy("extract").option("header", True).csv(f"{path}/{version}")
    return provenance(table)


def provenance(table: Versions) -> DataFrame:
    """(version, run, batch, touched and the counts of all states then) of every committed version that is kept."""
    spark = table.spark
    rows = None
    for n in table.numbers():
        about = table.about(n)["notes"]
        one = counts(table.rows(n)).select(F.lit(n).cast("long").alias("version"), F.lit(about["run"]).alias("run"), F.lit(about["batch"]).cast("long").alias("batch"), F.lit(about["touched"]).cast("long").alias("touched"), "*")
        rows = one if rows is None else rows.unionByName(one)
    return rows if rows is not None else spark.createDataFrame([], f"version long, run string, batch long, touched long, {COUNTS}")

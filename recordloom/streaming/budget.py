"""A budget of failed attempts for each key, kept in state across micro-batches and restarts.

A failure spends one of a key's attempts, a success gives all of them back, and so does a pause longer than
`refill`.  Failures beyond the budget are refused; the count goes on, so that a row says how far over
it is.  A timer drops the state of a key once the watermark is past its pause: whatever may still come for it
starts anew anyway, so that dropping it never changes a result.

Attempts of a key are taken in the order of their batches, by time and id within a batch.  What a task holds of
one key is a small record for each of its attempts in one batch; the size of a trigger bounds that.
"""

import datetime
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from recordloom.sources.shared import shared_dir

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "key string, id long, ts timestamp, failed boolean, attempt int, refused boolean"


class RetryBudget(StatefulProcessor):
    """Numbers the failures of a key since its last success or long pause; times are microseconds."""

    def __init__(self, budget: int, refill: int) -> None:
        self.budget, self.refill = budget, refill

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = handle.getValueState("spent", "failures int, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        failures, last = self.spent.get() if self.spent.exists() else (0, None)
        for at, named, id_, failed in sorted((r.at, r.id is not None, r.id or 0, r.failed) for r in rows):
            failures = 0 if last is not None and at - last > self.refill else failures
            failures = failures + 1 if failed else 0
            last = at if last is None else max(at, last)
            yield Row(key=key[0], id=id_ if named else None, at=at, failed=failed, attempt=failures, refused=failures > self.budget)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.spent.update((failures, last))
        self.handle.registerTimer((last + self.refill) // 1000 + 1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.spent.clear()
        return iter(())


def attempts(events: DataFrame, key: str, id_: str, failed: Column) -> DataFrame:
    """(key, id, ts, at, failed) of a stream or table with event time `ts`; rows without key or time take no part."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(id_).cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce(failed, F.lit(False)).alias("failed"))
    return rows.where("key is not null and ts is not null").withColumn("at", F.unix_micros("ts"))


def budgeted(rows: DataFrame, budget: int = 3, refill: datetime.timedelta = datetime.timedelta(days=3), late: str = "1 hour") -> DataFrame:
    """A stream of `attempts` with each one's number and whether it is refused; rows later than `late` are left out."""
    keyed = rows.withWatermark("ts", late).groupBy("key")
    pause = refill // datetime.timedelta(microseconds=1)
    made = keyed.transformWithState(RetryBudget(budget, pause), "key string, id long, at long, failed boolean, attempt int, refused boolean", "Append", "EventTime")
    return made.select("key", "id", F.timestamp_micros("at").alias("ts"), "failed", "attempt", "refused")


def run(stream: DataFrame, path: str) -> None:
    """Take all that has arrived, from where the checkpoint under `path` stands; results are rows under `path`/rows."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        q = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER[0])
        else:
            spark.conf.set(PROVIDER[0], before)


def results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OUT).parquet(f"{path}/rows")


def fresh(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run, where all executors see it."""
    return f"{shared_dir(spark)}/recordloom-{name}-{uuid.uuid4().hex}"

"""A keyed table of committed versions, for runs that stop and go on.

Rows lie in buckets by a hash of their key.  A commit merges some rows into the buckets that they fall in, writes
these to a folder of their own, and then puts one small file in place by an atomic rename that never overwrites;
it names the folder of every bucket and the last batch of every stream.  What has no such file was never
written: a run that is killed between the two leaves a folder that nothing names, and the next run merges
the same batch again.  A batch that is named is not merged twice, and batch ids may have gaps.

One writer a table; readers see whole versions.  A commit rewrites the buckets that it touches, so their number is
to be chosen so that one is small beside a batch.
"""

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "bucket_of_key"
Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Versions:
    """The table under `path` with `schema`, keyed by the columns `key`."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 16) -> None:
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets
        jvm = spark.sparkContext._jvm
        self._at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([path, *parts]))
        self._fs = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._renamer = lambda: jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        self._no_options = lambda: spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    # ---- commits
    def numbers(self) -> list[int]:
        """Committed versions that are kept, oldest first."""
        at = self._at("versions")
        if not self._fs.exists(at):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at) if s.getPath().getName().isdigit())

    def about(self, version: int) -> dict:
        """version, folders (bucket -> folder), streams (name -> last batch) and notes of a version."""
        with_text = self.spark.read.text(f"{self.path}/versions/{version}", wholetext=True).first()
        return json.loads(with_text["value"])

    def latest(self) -> dict:
        n = self.numbers()
        return self.about(n[-1]) if n else {"version": 0, "folders": {}, "streams": {}, "notes": {}}

    def _commit(self, about: dict) -> None:
        draft = self._at("drafts", uuid.uuid4().hex)
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(about), "utf-8"))
        out.close()
        self._fs.mkdirs(self._at("versions"))
        self._renamer().rename(draft, self._at("versions", str(about["version"])), self._no_options())

    # ---- rows
    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def rows(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the last one if none is given."""
        about = self.latest() if version is None else self.about(version)
        return self._read(sorted(about["folders"].values()))

    def write(self, new: DataFrame, merge: Merge, stream: str = "", batch: int | None = None, notes: Callable[[DataFrame], dict] | None = None) -> bool:
        """Merge (old rows, new rows) of the buckets that `new` touches, and commit; false if the batch of that stream was committed before.

        `notes` gets the committed rows of the touched buckets and gives what is to be kept with the version.
        """
        last = self.latest()
        if batch is not None and last["streams"].get(stream, -1) >= batch:
            return False
        spot = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        touched = sorted(str(r[BUCKET]) for r in new.select(spot.alias(BUCKET)).distinct().collect())
        folder = f"data/{uuid.uuid4().hex}"
        old = self._read([last["folders"][b] for b in touched if b in last["folders"]])
        merge(old, new).withColumn(BUCKET, spot).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        folders = {b: f for b, f in last["folders"].items() if b not in touched}
        folders |= {b: f"{folder}/{BUCKET}={b}" for b in touched if self._fs.exists(self._at(folder, f"{BUCKET}={b}"))}
        written = self._read(sorted(f for b, f in folders.items() if b in touched))
        streams = last["streams"] | ({stream: batch} if batch is not None else {})
        self._commit({"version": last["version"] + 1, "folders": folders, "streams": streams, "notes": notes(written) if notes else {}})
        return True

    def expire(self, keep: int = 2) -> int:
        """Drop all but the last `keep` versions and the folders that none of these names; the number of folders dropped."""
        numbers = self.numbers()
        kept = {f.split("/")[1] for n in numbers[-keep:] for f in self.about(n)["folders"].values()}
        for n in numbers[:-keep]:
            self._fs.delete(self._at("versions", str(n)), False)
        at = self._at("data")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        dropped = [n for n in names if n not in kept]
        for n in dropped:
            self._fs.delete(self._at("data", n), True)
        return len(dropped)

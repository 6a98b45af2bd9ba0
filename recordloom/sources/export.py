"""Export of records as text files with a header, through a data source whose commit is one file.

Every task writes files of its own, of composed records one after the other; the driver puts one manifest in place
when all tasks are done, naming the files with their sizes, hashes and numbers of records.  Readers take what the manifest
names, so that a job that fails, or a task that runs twice, leaves nothing that can be seen.  Files lie on any
store that pyarrow reaches by the path (a shared folder, HDFS or an object store), never on a machine's own disk only.
"""

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "manifest.json"
SCHEMA = "file string, header map<string,string>, body string"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: file, number of records, bytes and hash; no file for a task without rows."""

    file: str | None
    records: int
    size: int
    sha256: str


class RecordWriter(DataSourceWriter):
    """Writes (file, header, body) rows; a column of that name that is null is empty, or an empty map."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        store, at = _store(self.path)
        name = f"records/{self.job}-{uuid.uuid4().hex}.jsonl"
        n, size, digest, out = 0, 0, hashlib.sha256(), None
        try:
            for row in rows:
                if out is None:
                    store.create_dir(f"{at}/records", recursive=True)
                    out = store.open_output_stream(f"{at}/{name}")
                data = (json.dumps({"file": row["file"], "header": row["header"] or {}, "body": row["body"] or ""}, ensure_ascii=False, sort_keys=True) + "\n").encode()
                out.write(data)
                digest.update(data)
                n, size = n + 1, size + len(data)
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None, n, size, digest.hexdigest())

    def commit(self, messages: list[Written]) -> None:
        store, at = _store(self.path)
        old = committed(self.path) if not self.overwrite else []
        files = old + [{"file": m.file, "records": m.records, "bytes": m.size, "sha256": m.sha256} for m in messages if m and m.file]
        store.create_dir(at, recursive=True)
        draft = f"{at}/.{self.job}-{MANIFEST}"
        with store.open_output_stream(draft) as out:
            out.write(json.dumps({"records": sum(f["records"] for f in files), "files": sorted(files, key=lambda f: f["file"])}, indent=1).encode())
        store.move(draft, f"{at}/{MANIFEST}")

    def abort(self, messages: list[Written]) -> None:
        """Remove what the job wrote; what a lost task leaves is named by no manifest."""
        store, at = _store(self.path)
        for m in messages:
            if m and m.file:
                store.delete_file(f"{at}/{m.file}")


def committed(path: str) -> list[dict]:
    """The files of the last commit under `path`."""
    store, at = _store(path.rstrip("/"))
    if store.get_file_info(f"{at}/{MANIFEST}").type == fs.FileType.NotFound:
        return []
    with store.open_input_stream(f"{at}/{MANIFEST}") as f:
        return json.loads(f.read())["files"]


@dataclass
class _File(InputPartition):
    file: str
    sha256: str


class RecordReader(DataSourceReader):
    """One partition a file of the manifest; a file that differs from it is an error."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")

    def partitions(self) -> list[_File]:
        return [_File(f["file"], f["sha256"]) for f in committed(self.path)] or [_File("", "")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.file:
            return
        store, at = _store(self.path)
        digest = hashlib.sha256()
        with store.open_input_stream(f"{at}/{partition.file}") as f:
            held = b""
            while chunk := f.read(1 << 20):
                digest.update(chunk)
                *lines, held = (held + chunk).split(b"\n")
                for line in lines:
                    r = json.loads(line)
                    yield r["file"], r["header"], r["body"]
        if digest.hexdigest() != partition.sha256:
            raise ValueError(f"{partition.file} is not what was committed")


class Records(DataSource):
    """`df.write.format("records")` and `spark.read.format("records")` of (file, header, body)."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        missing = {"file", "header", "body"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"records need the columns {sorted(missing)}")
        return RecordWriter(self.options, overwrite)


def write(rows: DataFrame, path: str, append: bool = False) -> None:
    """Commit (file, header, body) rows under `path`, in the place of what is there or beside it."""
    rows.sparkSession.dataSource.register(Records)
    rows.select("file", "header", "body").write.format("records").mode("append" if append else "overwrite").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(Records)
    return spark.read.format("records").load(path)

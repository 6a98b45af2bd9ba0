"""SQLite files as a data source, for the state that small tools keep.

`spark.read.format("sqlite").option("table", "links").load(path)` reads a table of a file on any store that pyarrow
reaches.  A table is split by row ids; equality filters run in the file.  The file is held in memory by each
task that reads it, so this is for files that fit there, as such state files do.
"""

import io
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from recordloom.sources.files import read_bytes

TYPES = {"INTEGER": "bigint", "INT": "bigint", "BIGINT": "bigint", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "TEXT": "string", "VARCHAR": "string", "BLOB": "binary"}


def opened(path: str) -> sqlite3.Connection:
    """The file's database, in memory."""
    con = sqlite3.connect(":memory:")
    con.deserialize(io.BytesIO(read_bytes(path)).getbuffer())
    return con


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class Rows(InputPartition):
    """Row ids from `low` up to, not including, `high`."""

    low: int
    high: int


@dataclass
class SqliteReader(DataSourceReader):
    path: str
    table: str
    columns: list[str]
    parts: int
    equal: list[tuple[str, object]] = field(default_factory=list)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Equalities with a whole number or a text run in the file; other filters are Spark's."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and isinstance(f.value, (int, str)) and not isinstance(f.value, bool):
                self.equal.append((f.attribute[0], f.value))
            else:
                yield f

    def partitions(self) -> list[Rows]:
        low, high = opened(self.path).execute(f"select min(rowid), max(rowid) from {quoted(self.table)}").fetchone()
        if low is None:
            return [Rows(0, 0)]
        step = max(1, -(-(high + 1 - low) // self.parts))
        return [Rows(k, min(k + step, high + 1)) for k in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        where = "".join(f" and {quoted(c)} = ?" for c, _ in self.equal)
        sql = f"select {', '.join(map(quoted, self.columns))} from {quoted(self.table)} where rowid >= ? and rowid < ?{where} order by rowid"
        yield from opened(self.path).execute(sql, (partition.low, partition.high, *(v for _, v in self.equal)))


class Sqlite(DataSource):
    """Options: `table`, and `partitions` (1) that it is read in."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _columns(self) -> list[tuple[str, str]]:
        found = opened(self.options["path"]).execute(f"pragma table_info({quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']!r}")
        return [(name, TYPES.get(kind.split("(")[0].upper(), "string")) for _, name, kind, *_ in found]

    def schema(self) -> str:
        return ", ".join(f"`{n}` {t}" for n, t in self._columns())

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], schema.fieldNames(), int(self.options.get("partitions", "1")))

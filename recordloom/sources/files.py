"""Readers and writers of the record formats, always with an explicit schema."""

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from recordloom.functions import text as tx

# fixed values: header keys of a programme file, in their order, and the line that ends the header
HEADER = ["Program", "Credential", "School or Academic Unit", "Section", "Catalogue Year", "Canonical URL", "Program ID", "Catalogue ID", "Source Mode", "Retrieved At", "Content Hash", "Breadcrumb"]
MARKER = "=== CONTENT ==="


def text_corpus(spark: SparkSession, path: str, marker: str = MARKER, keys: list[str] = HEADER) -> DataFrame:
    """file, header and body of whole text files, as `decomposed`."""
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")
    return decomposed(rows, marker, keys)


def decomposed(rows: DataFrame, marker: str = MARKER, keys: list[str] = HEADER) -> DataFrame:
    """file, header (map of the known keys, the last of equal ones) and body of (file, value); what has no marker is all body."""
    at = F.instr("value", marker)
    head = F.when(at > 0, F.substring(F.col("value"), F.lit(1), at - 1)).otherwise("")
    body = F.when(at > 0, F.substring(F.col("value"), at + len(marker), F.length("value"))).otherwise(F.col("value"))
    pairs = F.transform(F.filter(F.split(head, "\n"), lambda x: x.contains(":")), lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("v")))
    known = F.array(*[F.lit(k) for k in keys])
    last = lambda k: F.try_element_at(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]), F.lit(-1))
    header = F.map_filter(F.map_from_arrays(known, F.transform(known, last)), lambda k, v: v.isNotNull())
    return rows.select("file", header.alias("header"), tx.strip_newlines(body).alias("body"))


def composed(rows: DataFrame, keys: list[str] = HEADER, marker: str = MARKER) -> DataFrame:
    """file and text of (file, header, body): the header in fixed order, the marker, the body."""
    lines = F.array(*[F.concat(F.lit(f"{k}: "), F.coalesce(F.col("header")[k], F.lit(""))) for k in keys])
    return rows.select("file", F.concat_ws("\n", F.array_join(lines, "\n"), F.lit(marker), tx.strip_newlines(F.col("body")), F.lit("")).alias("text"))


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Delimited rows with a header; quotes within quotes are doubled."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True, mode="PERMISSIVE")


def require_version(rows: DataFrame, column: str, expected: str) -> DataFrame:
    """`rows`, which fail when read if a row has another version."""
    bad = F.concat(F.lit(f"{column} must be {expected}, not "), F.coalesce(F.col(column).cast("string"), F.lit("null")))
    return rows.where(F.when(F.col(column).eqNullSafe(F.lit(expected)), True).otherwise(F.raise_error(bad).cast("boolean")))


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """A fixed order of columns, extra ones left out, missing values as empty text."""
    rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def extracts(programs: DataFrame) -> dict[str, DataFrame]:
    """The accounting extracts of one table of states: included, excluded, review and errors partition it."""
    c = F.col("class")
    failed = F.coalesce(F.col("status") == "failed", F.lit(False))
    return {
        "included": programs.where((c == "included") & ~failed),
        "excluded": programs.where(c.startswith("excluded_") & ~failed),
        "review": programs.where(((c == "manual_review") | c.isNull()) & ~failed),
        "errors": programs.where(failed),
    }


def manifest(files: DataFrame) -> DataFrame:
    """One row: number of files and a JSON object of file -> hash in order."""
    entries = F.array_sort(F.collect_list(F.struct("file", "hash")))
    return files.agg(F.count("*").alias("n_files"), F.to_json(F.map_from_entries(entries)).alias("manifest"))


def hash_listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file and SHA-256 of the files under a path."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("hash"))


def merged_stores(stores: list[DataFrame], surrogate: str = "id") -> DataFrame:
    """Rows of several stores without their surrogate ids; columns that a store lacks are null."""
    out = stores[0].drop(surrogate)
    for s in stores[1:]:
        out = out.unionByName(s.drop(surrogate), allowMissingColumns=True)
    return out


def log_rows(rows: DataFrame, message: str, evidence: str) -> DataFrame:
    """Log rows with their long fields cut to the sizes that logs keep."""
    return rows.withColumns({message: F.substring(message, 1, 2000), evidence: F.substring(evidence, 1, 1500)})


def dump_totals(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row: a JSON object of the number of rows, and of those that meet each condition."""
    counts = [F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in conditions.items()]]
    return rows.agg(F.struct(*counts).alias("t")).select(F.to_json("t").alias("totals"))


def dump(rows: DataFrame, path: str, **conditions: Column) -> None:
    """Rows as JSON lines under `path`/rows and their totals under `path`/totals."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    dump_totals(rows, **conditions).write.mode("overwrite").text(f"{path}/totals")


NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(data: bytes, sheet: str) -> Iterator[tuple[int, list[str]]]:
    """(row, cells) of a worksheet of a workbook, shared strings resolved."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{NS}si")]
        for n, row in enumerate(ElementTree.fromstring(z.read(sheet)).iter(f"{NS}row")):
            cells = []
            for c in row.iter(f"{NS}c"):
                v = c.find(f"{NS}v")
                text = v.text if v is not None and v.text is not None else "".join(t.text or "" for t in c.iter(f"{NS}t"))
                cells.append(shared[int(text)] if c.get("t") == "s" and text else text)
            yield n, cells


class _Sheet(InputPartition):
    def __init__(self, path: str, sheet: str) -> None:
        self.path, self.sheet = path, sheet


def read_bytes(path: str) -> bytes:
    """A whole file of any store that pyarrow reaches by the path."""
    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with store.open_input_stream(at) as f:
        return f.read()


class WorkbookReader(DataSourceReader):
    """One partition a worksheet."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self) -> list[_Sheet]:
        with zipfile.ZipFile(io.BytesIO(read_bytes(self.path))) as z:
            return [_Sheet(self.path, n) for n in sorted(z.namelist()) if n.startswith("xl/worksheets/") and n.endswith(".xml")]

    def read(self, partition: _Sheet) -> Iterator[tuple]:
        for n, cells in sheet_rows(read_bytes(partition.path), partition.sheet):
            yield partition.sheet, n, cells


class Workbook(DataSource):
    """`spark.read.format("workbook").load(path)`: sheet, row, cells of a spreadsheet on a path that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "sheet string, row int, cells array<string>"

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options)

"""SQL dumps as a data source: ``spark.read.format("sqldump").option("table", t).load(path)``.

Files are read in byte ranges. A range starts after the first semicolon at or before it and
reads the statements that begin in it, so any part of one large file is some task's work. A
value is checked as it is passed: a malformed one is an error that names its file and
byte. Of the columns only those of the given schema are decoded; without a schema all
columns of the table's first statement are read, as bytes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_type

#: A statement's head, and one value with what follows it.
HEAD = re.compile(rb"\s*(?:--[^\n]*\n\s*)*INSERT\s+INTO\s+`((?:[^`]|``)+)`\s*\(([^)]*)\)\s*VALUES\s*", re.I)
NAME = re.compile(rb"`((?:[^`]|``)+)`")
VALUE = re.compile(rb"\s*(?:(NULL)|(-?\d[\d.eE+-]*)|''|(?:CONVERT\()?FROM_BASE64\('([A-Za-z0-9+/=]*)'\)(?: USING utf8mb4\))?)\s*([,)])")
OPEN, NEXT = re.compile(rb"\s*\("), re.compile(rb"\s*,")
TAIL = re.compile(rb"\s*(?:ON DUPLICATE KEY UPDATE [^'()]*)?\Z", re.I)
#: Bytes that are read at once, of a range, and rows of a batch.
READ, SPLIT, ROWS = 1 << 20, 128 << 20, 4096


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (pafs.LocalFileSystem(), path)


def dump_files(path: str) -> Iterator[tuple[str, int]]:
    """A dump's files and their sizes; names that start with a dot or underscore are no data."""
    fs, bare = open_fs(path)
    info = fs.get_file_info(bare)
    found = fs.get_file_info(pafs.FileSelector(bare, recursive=True)) if info.type == pafs.FileType.Directory else [info]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._")


def statements(stream: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """The statements that begin in a range of a file, with the byte where each begins."""
    at, held = max(0, start - 1), b""
    stream.seek(at)
    skip = start > 0  # the statement that the range falls into belongs to the one before
    while True:
        found = held.find(b";")
        if found < 0:
            parts = [held]
            while block := stream.read(READ):
                parts.append(block)
                if b";" in block:
                    break
            held = b"".join(parts)
            found = held.find(b";")
        last = found < 0
        own, held = (held, b"") if last else (held[:found], held[found + 1 :])
        if not skip:
            if at >= end:
                return
            yield at, own
        skip, at = False, at + len(own) + 1
        if last:
            return


def names_of(head: re.Match) -> list[str]:
    return [n.replace(b"``", b"`").decode() for n in NAME.findall(head[2])]


def rows_of(text: bytes, table: str, wanted: list[str], where: str, offset: int) -> Iterator[list[bytes | None]]:
    """The wanted columns of a statement's rows; a statement on another table has none."""
    head = HEAD.match(text)
    if not head or head[1].replace(b"``", b"`").decode() != table:
        return
    names = names_of(head)
    place = {n: k for k, n in enumerate(names)}
    take, n, at = [place.get(w) for w in wanted], len(names), head.end()

    def fail(what: str) -> ValueError:
        return ValueError(f"{what} at byte {offset + at} of {where}: {text[at : at + 60]!r}")

    while True:
        if not (m := OPEN.match(text, at)):
            raise fail("no row")
        at, row = m.end(), []
        for k in range(n):
            if not (m := VALUE.match(text, at)) or m[4] != (b"," if k < n - 1 else b")"):
                raise fail("a malformed value")
            row.append(m)
            at = m.end()
        yield [None if k is None or row[k][1] else row[k][2] if row[k][2] else base64.b64decode(row[k][3] or b"") for k in take]
        if not (m := NEXT.match(text, at)):
            break
        at = m.end()
    if not TAIL.match(text, at):
        raise fail("text after the last row")


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class SqlDumpReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.schema, self.root, self.table = schema, options["path"], options["table"]
        self.split = int(options.get("splitBytes", SPLIT))

    def partitions(self) -> list[Range]:
        return [Range(p, at, min(size, at + self.split)) for p, size in dump_files(self.root) for at in range(0, size, self.split)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(self.root)
        wanted = self.schema.fieldNames()
        rows: list[list] = []
        with fs.open_input_file(part.path) as stream:
            for offset, text in statements(stream, part.start, part.end):
                for row in rows_of(text, self.table, wanted, part.path, offset):
                    rows.append(row)
                    if len(rows) == ROWS:
                        yield self.batch(rows)
                        rows = []
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[list]) -> pa.RecordBatch:
        columns = []
        for f, cells in zip(self.schema, zip(*rows, strict=True), strict=True):
            raw, kind = pa.array(cells, pa.binary()), to_arrow_type(f.dataType)
            columns.append(raw if pa.types.is_binary(kind) else raw.cast(pa.string()).cast(kind))
        return pa.RecordBatch.from_arrays(columns, names=self.schema.fieldNames())


class SqlDump(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqldump"

    def schema(self) -> T.StructType:
        fs, _ = open_fs(self.options["path"])
        for path, size in dump_files(self.options["path"]):
            with fs.open_input_file(path) as stream:
                for _, text in statements(stream, 0, size):
                    if (head := HEAD.match(text)) and head[1].replace(b"``", b"`").decode() == self.options["table"]:
                        return T.StructType([T.StructField(n, T.BinaryType()) for n in names_of(head)])
        raise ValueError(f"no statement on {self.options['table']}: give a schema")

    def reader(self, schema: T.StructType) -> SqlDumpReader:
        return SqlDumpReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqlDump)

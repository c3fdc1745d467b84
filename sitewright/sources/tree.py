"""Trees of files as index rows, listed by the executors.

Directories still to be read are a DataFrame; each level is read by tasks, written, and its
directories are the next level's rows. The driver sees counts only, and a lost executor
costs its directories of one level. Local file systems (which executors share) show links,
change times and empty directories; stores that pyarrow can open show directories and
files; others are listed by Spark's reader, files only.
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.functions.paths import GENERATED_DIRECTORIES, default_skip, relative_under
from sitewright.operators.tree import below_any
from sitewright.shared import scratch_path

#: Columns of a listing: ``real`` is where a directory to be read lies.
ENTRY = "path binary, ctime long, size long, type string, empty boolean, target binary, intermediate boolean, real binary"
NAMES = [c.split()[0] for c in ENTRY.split(", ")]
KINDS = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary(), pa.bool_(), pa.binary()]
#: Directories of a task, and rows of a batch that it gives back.
DIRECTORIES, ROWS = 64, 4096
STORES = ("hdfs", "s3", "gs", "abfss")


def _joined(folder: bytes, name: bytes) -> bytes:
    return folder.rstrip(b"/") + b"/" + name if folder else name


def _passed_links(link: bytes, root: bytes) -> Iterator[tuple]:
    """The links on the way to a link's target, as its text has it."""
    text = os.readlink(link)
    whole = os.path.normpath(os.path.join(os.path.dirname(link), text))
    at = b""
    for part in whole.split(b"/")[1:]:
        at += b"/" + part
        if at != link and os.path.islink(at):
            info, real = os.lstat(at), os.path.realpath(at)
            shown = at[len(root) + 1 :] if at.startswith(root.rstrip(b"/") + b"/") else at
            yield shown, int(info.st_ctime), info.st_size, "link", None, real if os.path.isdir(real) else None, True, None


def _local(path: bytes, real: bytes, root: bytes) -> Iterator[tuple]:
    try:
        with os.scandir(real) as found:
            entries = sorted(found, key=lambda e: e.name)
    except OSError:  # stays as a row that says it was not read
        yield path, None, 0, "dir", None, None, False, None
        return
    if not entries:
        yield path, int(os.lstat(real).st_ctime), 0, "dir", True, None, False, None
    for e in entries:
        try:
            info = e.stat(follow_symlinks=False)
            own = _joined(path, e.name)
            if stat.S_ISLNK(info.st_mode):
                to = os.path.realpath(e.path)
                folder = to if to != e.path and os.path.isdir(to) else None
                if folder is not None:
                    yield from _passed_links(e.path, root)
                yield own, int(info.st_ctime), info.st_size, "link", None, folder, False, None
            elif stat.S_ISDIR(info.st_mode):
                yield own, int(info.st_ctime), 0, "walk", None, None, False, e.path
            else:
                kind = "file" if stat.S_ISREG(info.st_mode) else "other"
                yield own, int(info.st_ctime), info.st_size if kind == "file" else 0, kind, None, None, False, None
        except FileNotFoundError:  # gone meanwhile
            continue


def _stored(fs: pafs.FileSystem, path: bytes, real: bytes) -> Iterator[tuple]:
    entries = fs.get_file_info(pafs.FileSelector(real.decode()))
    if not entries:
        yield path, None, 0, "dir", True, None, False, None
    for e in entries:
        when = None if e.mtime is None else int(e.mtime.timestamp())
        if e.type == pafs.FileType.Directory:
            yield _joined(path, e.base_name.encode()), when, 0, "walk", None, None, False, e.path.encode()
        else:
            yield _joined(path, e.base_name.encode()), when, e.size, "file", None, None, False, None


def _expand(folders: DataFrame, root: str, scheme: str) -> DataFrame:
    """The entries of ``folders(path, real)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = None if scheme == "file" else pafs.FileSystem.from_uri(root)[0]
        rows: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)
        for some in batches:
            for path, real in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                for row in _local(path, real, root.encode()) if fs is None else _stored(fs, path, real):
                    rows.append(row)
                    if len(rows) == ROWS:
                        yield batch()
                        rows.clear()
        if rows:
            yield batch()

    return folders.mapInArrow(run, ENTRY)


def list_tree(spark: SparkSession, root: str, generated: tuple[str, ...] = GENERATED_DIRECTORIES, *, follow: bool = True) -> DataFrame:
    """A folder's index rows, without what snapshots skip by default.

    ``path`` is relative to the root; ``type`` is file, link, dir or other. A directory is a
    row only if it is empty or (``empty`` null) cannot be read. ``target`` is where a link to
    a directory leads; with ``follow`` such a directory outside of what is listed already is
    listed once, at its own absolute path, and links on the way there are rows marked
    ``intermediate``. Cycles end, as no directory is read twice.
    """
    scheme = m[1] if (m := re.match(r"([a-z0-9]+):", root)) else "file"
    if scheme not in ("file", *STORES):
        return _files(spark, root, generated)
    bare = "/" + re.sub(r"^file:/*", "", root).strip("/") if scheme == "file" else pafs.FileSystem.from_uri(root)[1]
    out, level, text = scratch_path(spark, "tree"), 0, lambda c: F.col(c).cast("string")
    folders = spark.range(1).select(F.lit(b"").alias("path"), F.lit(os.path.realpath(bare).encode() if scheme == "file" else bare.encode()).alias("real"))
    base, listed = folders.first()["real"].decode(), folders.select("real")
    read = lambda k=None: spark.read.schema(f"{ENTRY}, level int" if k is None else ENTRY).parquet(out if k is None else f"{out}/level={k}")
    count = 1
    while count:
        dealt = folders.repartition(max(1, min(-(-count // DIRECTORIES), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
        found = _expand(dealt, base if scheme == "file" else root, scheme)
        skipped = default_skip(text("path"), F.col("type") == "file", generated=generated)
        found.where(~F.coalesce(skipped, F.lit(False))).write.parquet(f"{out}/level={level}")
        folders = read(level).where("type = 'walk'").select("path", "real")
        if level and follow:  # a followed directory may hold the root, or another one that was followed
            folders = folders.join(listed, "real", "left_anti").select("path", "real")
        level, count = level + 1, folders.count()
        if not count and follow and scheme == "file":
            targets = read().where("target is not null").select(text("target").alias("path")).distinct()
            # Not below what is listed, and of several the highest.
            new = targets.join(below_any(targets, listed.select(text("real").alias("path"))), "path", "left_anti")
            new = new.join(below_any(new, new, proper=True), "path", "left_anti").select(F.col("path").cast("binary").alias("path"), F.col("path").cast("binary").alias("real"))
            new.write.parquet(f"{out}-roots/level={level}")
            folders = spark.read.schema("path binary, real binary").parquet(f"{out}-roots/level={level}")
            listed, count = listed.unionByName(folders.select("real")), folders.count()
    rows = read().where("type <> 'walk'")
    # A link may be passed on the way to several targets.
    once = rows.where("not intermediate").unionByName(rows.where("intermediate").dropDuplicates(["path"]).join(rows.where("not intermediate").select("path"), "path", "left_anti"))
    return once.select(text("path").alias("path"), "ctime", "size", "type", "empty", text("target").alias("target"), "intermediate")


def _files(spark: SparkSession, root: str, generated: tuple[str, ...]) -> DataFrame:
    """Files alone, by Spark's own listing, for stores that only Spark opens."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    path = relative_under(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "/" + root.split(":", 1)[-1].lstrip("/"))
    none = lambda kind: F.lit(None).cast(kind)
    rows = files.select(path.alias("path"), F.unix_timestamp("modificationTime").alias("ctime"), F.col("length").alias("size"), F.lit("file").alias("type"))
    return rows.where(~default_skip(F.col("path"), generated=generated)).select("*", none("boolean").alias("empty"), none("string").alias("target"), F.lit(False).alias("intermediate"))

"""Sharding by size-tiered compaction under a versioned manifest.

An arrival is written as small immutable shards. Shards fall into tiers by size, each tier's
sizes within a factor of FANOUT; a tier with a run of FANOUT shards or more is merged into
files of the target size, and tiers only grow, so a row is rewritten a bounded number of
times. Files are never changed: a manifest of a new version names the live ones. Manifests
are tables, made live by a pointer file that is written once, so readers see all of a change
or nothing. Of two writers of a version one gets ``Conflict``: it lays its change over the
winner's version, or plans anew if files that it merged are gone, and no row is lost.
``read`` takes any version.

Only DataFrame reads and writes move rows; nothing shuffles: a merge narrows the partitions
of the run's files, and a version's manifest is made from the last one where it lies. The
driver holds the names of new files and of shards to merge. Results by case: nulls, empty and
long texts, repeated rows and columns of any name are stored as they are; an empty arrival
adds no shard, and an empty store reads as an empty table of its schema.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewright.shared import names_in, read_small, write_once

#: Bytes of a merged file, shards of a run, and the size below which all are one tier.
TARGET_BYTES, FANOUT, SMALLEST = 128 << 20, 4, 1 << 20
#: Files of a manifest at most, and the column that numbers the arrivals of one write.
MANIFEST_FILES, PART = 16, "__arrival"

MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("rows", T.LongType()), T.StructField("tier", T.IntegerType())])


class Conflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int
    tier: int


def tier_of(size: int) -> int:
    return 0 if size <= SMALLEST else 1 + int(math.log(size / SMALLEST, FANOUT))


class ShardStore:
    """Shards and manifests below one folder of a shared file system."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, target_bytes: int = TARGET_BYTES):
        self.spark, self.path, self.schema, self.target = spark, path.rstrip("/"), schema, target_bytes

    def _fs(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), jpath

    def versions(self) -> list[int]:
        return [int(n[1:]) for n in names_in(self.spark, f"{self.path}/manifest") if n.startswith("v")]

    def latest(self) -> int:
        return max(self.versions(), default=0)

    def manifest_table(self, version: int | None = None) -> DataFrame:
        """A version's shards as rows."""
        at = self.latest() if version is None else version
        if at == 0:
            return self.spark.createDataFrame([], MANIFEST)
        folder = read_small(self.spark, f"{self.path}/manifest/v{at:012d}")
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/tables/{folder}")

    def manifest(self, version: int | None = None) -> list[Shard]:
        return [Shard(**r.asDict()) for r in self.manifest_table(version).collect()]

    def commit(self, base: int, added: Iterable[Shard], gone: Iterable[str] = ()) -> int:
        """Make version ``base + 1`` of what ``base`` holds, at once and only if nobody has."""
        folder, gone = uuid.uuid4().hex, set(gone)
        before = self.manifest_table(base)
        if gone:
            names = self.spark.createDataFrame([(p,) for p in sorted(gone)], "path string")
            if before.join(names, "path", "left_semi").count() < len(gone):
                raise Conflict(f"version {base} no longer holds what was merged")
            before = before.join(names, "path", "left_anti").select(*MANIFEST.names)
        rows = self.spark.createDataFrame([(s.path, s.bytes, s.rows, s.tier) for s in added], MANIFEST)
        before.unionByName(rows).coalesce(MANIFEST_FILES if base else 1).write.json(f"{self.path}/tables/{folder}")
        if not write_once(self.spark, f"{self.path}/manifest/v{base + 1:012d}", folder):
            raise Conflict(f"version {base + 1} is taken")
        return base + 1

    def _written(self, folder: str) -> list[Shard]:
        """The shards of a folder that hold rows: sizes and counts come from the files' footers."""
        file = F.col("_metadata")
        found = self.spark.read.schema(self.schema).parquet(folder).groupBy(file["file_name"].alias("name"), file["file_size"].alias("size")).agg(F.count("*").alias("rows"))
        return [Shard(f"{folder}/{r['name']}", r["size"], r["rows"], tier_of(r["size"])) for r in found.collect()]

    def append_parts(self, df: DataFrame, part: Column) -> int:
        """Write ``df`` in one pass, its rows as shards of the arrivals that ``part`` numbers, and
        commit these one after the other, each as a version of its own."""
        folder = f"{self.path}/data/arrival-{uuid.uuid4().hex}"
        df.select(*(F.col(f"`{f.name}`") for f in self.schema), part.alias(PART)).write.partitionBy(PART).parquet(folder)
        file = F.col("_metadata")
        place = F.regexp_extract(file["file_path"], rf"({PART}=([^/]+)/[^/]+)$", 1)
        found = self.spark.read.schema(self.schema).parquet(folder).groupBy(place.alias("name"), file["file_size"].alias("size")).agg(F.count("*").alias("rows"))
        arrived: dict[int, list[Shard]] = {}
        for r in found.collect():  # a row a file of this write
            arrived.setdefault(int(r["name"].split("/")[0].split("=")[1]), []).append(Shard(f"{folder}/{r['name']}", r["size"], r["rows"], tier_of(r["size"])))
        return max((self._commit_next(added) for _, added in sorted(arrived.items())), default=self.latest())

    def append(self, df: DataFrame) -> int:
        """Write ``df``'s partitions as shards and commit them, after whoever was faster."""
        folder = f"{self.path}/data/arrival-{uuid.uuid4().hex}"
        df.select(*(F.col(f"`{f.name}`") for f in self.schema)).write.parquet(folder)
        return self._commit_next(self._written(folder))

    def _commit_next(self, added: list[Shard]) -> int:
        while True:
            try:
                return self.commit(self.latest(), added)
            except Conflict:
                continue

    def runs(self, shards: list[Shard]) -> list[list[Shard]]:
        """Similarly sized shards to merge: tiers with FANOUT of them or more, below the target."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target // 2:
                tiers.setdefault(s.tier, []).append(s)
        return [t for _, t in sorted(tiers.items()) if len(t) >= FANOUT]

    def compact(self) -> int:
        """Merge every run once and commit; the version stays if there is none.

        Only shards below half the target are listed; those at rest stay in the manifest.
        """
        base = self.latest()
        small = [Shard(**r.asDict()) for r in self.manifest_table(base).where(F.col("bytes") < self.target // 2).collect()]
        merged: list[Shard] = []
        gone: set[str] = set()
        for run in self.runs(small):
            folder = f"{self.path}/data/merged-{uuid.uuid4().hex}"
            files = max(1, math.ceil(sum(s.bytes for s in run) / self.target))
            self.spark.read.schema(self.schema).parquet(*(s.path for s in run)).coalesce(files).write.parquet(folder)
            merged += self._written(folder)
            gone |= {s.path for s in run}
        if not gone:
            return base
        while True:
            try:
                return self.commit(base, merged, gone)
            except Conflict:
                base = self.latest()
                live = self.manifest_table(base).where(F.col("path").isin(sorted(gone))).count()
                if live < len(gone):  # another compaction merged some of them
                    return self.compact()

    def compact_all(self) -> int:
        """Merge until no tier holds a run."""
        while (before := self.latest()) != self.compact():
            continue
        return before

    def vacuum(self, keep: int = 2) -> int:
        """Delete the files that none of the last ``keep`` versions names; older versions go too.

        Run it when no writer is between its data and its commit.
        """
        known = self.versions()
        named = {s.path for v in known[-keep:] for s in self.manifest(v)}
        kept_tables = {read_small(self.spark, f"{self.path}/manifest/v{v:012d}") for v in known[-keep:]}
        fs, data = self._fs(f"{self.path}/data")
        gone = 0
        for folder in fs.listStatus(data) if fs.exists(data) else []:
            name = folder.getPath().getName()
            found, files = fs.listFiles(folder.getPath(), True), []
            while found.hasNext():
                files.append(found.next().getPath())
            files = [f for f in files if f.getName().endswith(".parquet")]
            stale = [f for f in files if f"{self.path}/data/{name}/" + f.toString().split(f"/data/{name}/", 1)[1] not in named]
            for f in stale:
                fs.delete(f, False)
            gone += len(stale)
            if len(stale) == len(files):
                fs.delete(folder.getPath(), True)
        for v in known[:-keep]:
            fs.delete(self._fs(f"{self.path}/manifest/v{v:012d}")[1], True)
        for folder in set(names_in(self.spark, f"{self.path}/tables")) - kept_tables:
            fs.delete(self._fs(f"{self.path}/tables/{folder}")[1], True)
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        paths = [s.path for s in self.manifest(version)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)


#: The arrivals' parts of a table: several of each size, so that tiers fill and merge.
ARRIVALS = (1, 1, 1, 1, 2, 2, 2, 2, 4, 4, 8, 8)


def arrive(store: ShardStore, df: DataFrame, key: str, parts: tuple[int, ...] = ARRIVALS) -> None:
    """A file-backed table as arrivals of several sizes.

    A table of many files arrives by whole files, so each is read once; one of fewer files
    than parts by a hash of ``key``, each row in one arrival, all written in one pass.
    """
    edges = [sum(parts[:k]) for k in range(len(parts) + 1)]
    files = sorted(df.inputFiles())
    if len(files) >= len(parts):
        cuts = sorted({len(files) * e // edges[-1] for e in edges})
        for a, b in zip(cuts, cuts[1:], strict=False):
            store.append(df.sparkSession.read.schema(df.schema).parquet(*files[a:b]))
        return
    owner = [k for k, n in enumerate(parts) for _ in range(n)]
    store.append_parts(df, F.get(F.array(*map(F.lit, owner)), F.pmod(F.xxhash64(key), F.lit(edges[-1])).cast("int")))

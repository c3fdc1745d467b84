"""Change logs, rewrites and scans as Structured Streaming jobs.

Each job resumes from its checkpoint and gives the same result when a batch is replayed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from sitewright.functions.rewrite import rewrite_column
from sitewright.operators.changes import counted
from sitewright.shared import delete_path, names_in, read_small, write_once

#: What a change log adds to an index's own columns.
CHANGE = T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.StringType())])
#: Runs of one size class that merge, rows of the lowest class, and versions that a vacuum leaves.
FAN, SMALL, KEPT_VERSIONS = 4, 10_000, 2


def size_class(rows: int) -> int:
    level = 0
    while rows > SMALL * FAN**level:
        level += 1
    return level


def merging(sizes: list[int]) -> int:
    """Of runs from old to new, how many of the newest are merged: FAN or more that are no
    larger in class than the FANth of them, with those that the merged run then equals."""
    take = 0
    while True:
        total = sum(sizes[len(sizes) - take :])
        least = size_class(total) if take else 0
        more = take
        while more < len(sizes) and size_class(sizes[-more - 1]) <= max(least, size_class(sizes[-1])):
            more += 1
        if more - take < (FAN if not take else 1) or more == take:
            return take
        take = more


def _versions(spark: SparkSession, out: str) -> list[int]:
    return [int(n[1:]) for n in names_in(spark, f"{out}/versions")]


def _pointer(spark: SparkSession, out: str, version: int) -> dict:
    """A version's runs from old to new (folder and rows), and the index's schema."""
    return json.loads(read_small(spark, f"{out}/versions/v{version:012d}"))


def _run(spark: SparkSession, pointer: dict, which: slice) -> list[DataFrame]:
    schema = T.StructType.fromJson(pointer["schema"]).add("op", "string").add("at", "long")
    return [spark.read.schema(schema).parquet(r["folder"]) for r in pointer["runs"][which]]


def _last(runs: list[DataFrame]) -> DataFrame:
    """The last change of each path in some runs."""
    rows = reduce(DataFrame.unionByName, runs)
    rest = [c for c in rows.columns if c != "path"]
    return rows.groupBy("path").agg(F.max_by(F.struct(*rest), "at").alias("c")).select("path", "c.*")


def _store(rows: DataFrame, folder: str) -> dict:
    """A run: rows sorted by path within each file, so that readers of few paths skip most."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).sortWithinPartitions("path").write.mode("overwrite").parquet(folder)
    return {"folder": folder, "rows": seen.get["rows"]}


def read_followed(spark: SparkSession, out: str, version: int | None = None) -> DataFrame:
    """A version of a followed index (the last one).

    Runs are merged as they are read: the oldest one holds the index, of the others the last
    change of each path counts.
    """
    pointer = _pointer(spark, out, max(_versions(spark, out)) if version is None else version)
    (oldest,), later = _run(spark, pointer, slice(0, 1)), _run(spark, pointer, slice(1, None))
    columns = [c for c in oldest.columns if c not in ("op", "at")]
    if not later:
        return oldest.select(*columns)
    changed = _last(later)
    return oldest.select(*columns).join(changed.select("path"), "path", "left_anti").select(*columns).unionByName(changed.where("op = '+'").select(*columns))


def stream_wal(spark: SparkSession, folder: str, index: DataFrame, out: str, checkpoint: str, files_a_batch: int = 1000) -> StreamingQuery:
    """Follow change-log files into versions of the index below ``out`` (see ``read_followed``).

    The index has a string column ``path`` and any others; the log's JSON lines have them too,
    with ``seq`` and ``op`` (+ or -). A version is a list of immutable sorted runs named by a
    pointer file: the index as it was, then the changes of batches. Batch n adds one run with
    the last change of each of its paths and makes version n + 1; the newest runs that have
    come to one size class are merged to one, so each change is rewritten once a class, as
    a log-structured index does, and what is written follows the log, not the index. Deletes
    stay until they meet the oldest run. A replayed batch changes nothing. Data that the last
    KEPT_VERSIONS versions do not name is deleted.
    """
    own = T.StructType([f for f in index.schema if f.name not in ("op", "seq", "at")])
    columns = own.fieldNames()
    if not names_in(spark, f"{out}/versions"):
        start = _store(index.select(*columns, F.lit("+").alias("op"), F.lit(-1).cast("long").alias("at")), f"{out}/data/v{0:012d}")
        write_once(spark, f"{out}/versions/v{0:012d}", json.dumps({"schema": own.jsonValue(), "runs": [start]}))

    def fold(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if n + 1 in _versions(spark, out):
            return
        pointer, fields = _pointer(spark, out, n), [c for c in columns if c != "path"]
        last = batch.groupBy("path").agg(F.max_by(F.struct("op", *fields), "seq").alias("c"))
        data = f"{out}/data/v{n + 1:012d}"
        runs = [*pointer["runs"], _store(last.select("path", *(F.col(f"c.`{f}`").alias(f) for f in fields), "c.op", F.lit(n).cast("long").alias("at")), data)]
        if take := merging([r["rows"] for r in runs]):
            merged = _last(_run(spark, pointer | {"runs": runs}, slice(len(runs) - take, None)))
            whole = take == len(runs)  # nothing older that a delete must still hide
            runs = [*runs[: len(runs) - take], _store(merged.where("op = '+'") if whole else merged, f"{data}m")]
        write_once(spark, f"{out}/versions/v{n + 1:012d}", json.dumps(pointer | {"runs": runs}))
        _vacuum(spark, out, n + 1)

    log = spark.readStream.schema(T.StructType([*CHANGE, *own])).option("maxFilesPerTrigger", files_a_batch).json(folder)
    return log.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _vacuum(spark: SparkSession, out: str, last: int) -> None:
    """Delete versions before the last ones, and the runs that those no longer name."""
    kept = range(max(0, last - KEPT_VERSIONS + 1), last + 1)
    named = {r["folder"] for v in kept for r in _pointer(spark, out, v)["runs"]}
    for v in _versions(spark, out):
        if v < kept[0]:
            delete_path(spark, f"{out}/versions/v{v:012d}")
    for name in names_in(spark, f"{out}/data"):
        if int(name[1:13]) <= last and f"{out}/data/{name}" not in named:
            delete_path(spark, f"{out}/data/{name}")


class LastChange(StatefulProcessor):
    """The row of a key with the greatest sequence number."""

    def __init__(self, keys: tuple[str, ...], fields: T.StructType, ttl_ms: int | None) -> None:
        self.keys, self.fields, self.names, self.ttl_ms = keys, fields, fields.fieldNames(), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", self.fields, self.ttl_ms)

    def newer(self, rows: Iterator[Row]) -> bool:
        """Take what is newer than the state; whether there was any."""
        place, best, found = self.names.index("seq"), tuple(self.state.get()) if self.state.exists() else None, False
        for row in rows:
            if row["seq"] is not None and (best is None or row["seq"] > best[place]):
                best, found = tuple(row[n] for n in self.names), True
        if found:
            self.state.update(best)
        return found

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers: object) -> Iterator[Row]:
        self.newer(rows)
        if self.state.exists():
            yield Row(**dict(zip((*self.keys, *self.names), (*key, *self.state.get()), strict=True)))

    def handleInitialState(self, key: tuple, initial: Row, timers: object) -> None:
        self.newer([initial])

    def close(self) -> None:
        pass


def stream_latest(changes: DataFrame, keys: tuple[str, ...] = ("key",), *, ttl_ms: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """The last change of each key of a stream that has ``seq`` and any other columns, in update mode.

    Of rows with equal numbers the first that arrives counts, and rows without one do not.
    ``initial`` is a snapshot of the same columns that the first batch starts from; a key
    that has not changed for ``ttl_ms`` is forgotten. Needs the RocksDB state store, which
    spills to disk; ``read_latest`` reads the state of a checkpoint.
    """
    fields = T.StructType([f for f in changes.schema if f.name not in keys])
    out = T.StructType([*(changes.schema[k] for k in keys), *fields])
    start = None if initial is None else initial.select(*out.fieldNames()).groupBy(*keys)
    processor, timing = LastChange(keys, fields, ttl_ms), "ProcessingTime" if ttl_ms else "None"
    return changes.select(*out.fieldNames()).groupBy(*keys).transformWithState(processor, out, "Update", timing, start)


def read_latest(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The keys and last changes that a stopped ``stream_latest`` holds in its checkpoint."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "last").load()
    value = "value.value" if "value" in state.schema["value"].dataType.fieldNames() and len(state.schema["value"].dataType) == 2 and "ttlExpirationMs" in state.schema["value"].dataType.fieldNames() else "value"
    return state.select("key.*", f"{value}.*")


class RewriteStats(StreamingQueryListener):
    """Totals of the metrics that streams report under given names, as their batches end."""

    def __init__(self) -> None:
        self.totals: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event: object) -> None:
        pass

    def onQueryProgress(self, event: object) -> None:
        for name, row in event.progress.observedMetrics.items():
            found = self.totals.setdefault(name, {})
            for metric, n in row.asDict().items():
                found[metric] = found.get(metric, 0) + (n or 0)

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: object) -> None:
        pass


def stream_rewrite(content: DataFrame, column: str, mapping: dict[str, str], hint: str | None = None, stats: str | None = None) -> DataFrame:
    """New content rewritten as it arrives: stateless, any sink.

    With ``stats`` each batch reports ``n_processed`` and ``n_changed`` under that name, from
    the pass that writes it (see ``RewriteStats``).
    """
    if stats is None:
        return rewrite_column(content, column, mapping, hint=hint)
    return counted(content, [column], mapping, stats, hints={column: hint} if hint else None)


def stream_scan(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Index rows of the files that are new since the last run."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)
    rows = files.select("path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("ctime"), F.lit("file").alias("type"))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

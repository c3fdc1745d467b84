"""Exact dedup: an extendible-hash index of texts on shared files.

Texts are equal when they are identical without white space. Each row's text gives a 64-bit
key; an index entry is one distinct text. The directory starts as one bucket over all keys
and doubles while a bucket holds more than CAPACITY entries: a bucket is a prefix of key
bits, as short as its entries allow. Owner tasks take ranges of keys, chain the entries that
share a key in order of their digests, and write them sorted, with their buckets, as the
index's files in the session's shared folder.

Bytes are compared before anything moves by key: rows whose key occurs more than once (a
broadcast filter of fixed size lets few others through) are grouped on key and bytes. Copies
meet in their own task first, so a text that a third of all rows hold shuffles as one row a
task, and no key's rows are ever gathered: a group is a count and its best row. Rows then
find their entries by an equi-join on narrow columns, entries of most rows by broadcast (fewer
than HOT exist). Everything is built-in DataFrame operations.

Results by case: a null text counts as empty; of equal texts the row with the most code
points stays, then the least id (null ids last), then the first of repeated rows; an empty
table gives an empty result; other columns are not carried (``drop_copies`` keeps them all,
as they are).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.llm.simhash import HOT, _marked
from sitewright.shared import materialize

#: White space that does not count (fixed by the definition of equal texts).
SPACE = " \t\n\v\f\r"
#: Entries of a bucket beyond which it splits, and bits that a directory's cells are finer
#: than even buckets would be (keys are hashes, so no bucket needs more).
CAPACITY, FINER = 8192, 6


def normalised(text: Column) -> Column:
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in SPACE:
        out = F.replace(out, F.lit(c))
    return out


def fingerprinted(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A narrow row for each of ``df``: ``rid``, ``doc_id``, ``points``, ``key`` and ``sha``, written down."""
    text = F.col(f"`{text_col}`")
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.char_length(text.cast("string")), F.lit(0)).alias("points"), normalised(text).alias("norm"))
    return materialize(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "points", F.xxhash64("norm").alias("key"), F.unhex(F.sha2("norm", 256)).alias("sha")), "dedup-rows")


def prefix(key: Column, bits: Column | int) -> Column:
    """The first bits of a key, none of them as 0."""
    bits = F.lit(bits) if isinstance(bits, int) else bits
    return F.when(bits == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", key, (F.lit(64) - bits).cast("int")))


def directory(entries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cell``, ``bits``, ``bucket`` and ``depth``: the bucket of each of the finest cells that hold entries.

    A bucket is the shortest prefix with ``capacity`` entries or fewer, so its parent is
    overfull; cells that are overfull themselves keep their entries as one long chain.
    """
    total = entries.count()
    bits = min(40, max(0, -(-total // capacity) - 1).bit_length() + FINER)
    cells = entries.groupBy(prefix(F.col("key"), bits).alias("cell")).agg(F.count("*").alias("n"))
    cells = materialize(cells, "dedup-cells")
    levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    up = F.expr(f"shiftright(cell, {bits} - depth)")
    sums = levels.groupBy("depth", up.alias("bucket")).agg(F.sum("n").alias("n"))
    fits = sums.where((F.col("n") <= capacity) | (F.col("depth") == bits)).select("depth", "bucket")
    deepest = levels.select("cell", "depth", up.alias("bucket")).join(fits, ["depth", "bucket"]).groupBy("cell").agg(F.min(F.struct("depth", "bucket")).alias("b"))
    return deepest.select("cell", F.lit(bits).alias("bits"), "b.bucket", "b.depth")


def compared(df: DataFrame, rows: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``key``, ``sha`` and ``n`` of each distinct text, byte by byte, among keys of several rows."""
    repeated = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    texts = df.select(normalised(F.col(f"`{text_col}`")).alias("norm")).select(F.xxhash64("norm").alias("key"), "norm")
    met = _marked(texts, "key", repeated).where("doubtful")
    return met.groupBy("key", "norm").agg(F.count("*").alias("n")).select("key", F.unhex(F.sha2("norm", 256)).alias("sha"), "n")


@dataclass(frozen=True)
class Index:
    """An index's files: entries in ranges of keys, and the directory of their buckets."""

    entries: DataFrame
    directory: DataFrame

    def find(self, keys: DataFrame) -> DataFrame:
        """Entries of the chain of each of ``keys(key)``."""
        return self.entries.join(keys, "key")


def build(df: DataFrame, rows: DataFrame, *, text_col: str = "text", capacity: int = CAPACITY) -> Index:
    """The index of ``rows``, which are ``fingerprinted(df)``."""
    best = F.min(F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    groups = rows.groupBy("key", "sha").agg(F.count("*").alias("n"), best.alias("best"))
    same = compared(df, rows, text_col=text_col).select("key", "sha", F.col("n").alias("equal"))
    # A digest names the bytes in a chain only if all that have it were found to be the same bytes.
    sure = F.when((F.col("n") == 1) | (F.col("n") == F.col("equal")), F.col("n")).otherwise(F.raise_error(F.lit("texts that differ have the same key and digest")))
    entries = materialize(groups.join(same, ["key", "sha"], "left").select("key", "sha", sure.alias("n"), "best"), "dedup-groups")
    found = directory(entries, capacity)
    found = materialize(found, "dedup-directory")
    bits = found.select(F.max("bits")).first()[0] or 0
    placed = entries.withColumn("cell", prefix(F.col("key"), bits)).join(found.drop("bits"), "cell").drop("cell")
    owned = placed.repartitionByRange("key").withColumn("chain", F.row_number().over(Window.partitionBy("key").orderBy("sha")))
    files = materialize(owned.select("bucket", "depth", "key", "chain", "sha", "n", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid")), "dedup-index")
    return Index(files, found)


def members(rows: DataFrame, index: Index) -> DataFrame:
    """``rows`` with their entries' ``keep_id``, ``keep_rid`` and ``n``."""
    named = index.entries.select("key", "sha", "n", "keep_id", "keep_rid")
    total = rows.count()
    hot = named.where(F.col("n") * HOT > total)  # fewer than HOT entries
    most = rows.join(F.broadcast(hot), ["key", "sha"])
    rest = rows.join(F.broadcast(hot.select("key", "sha")), ["key", "sha"], "left_anti")
    return most.unionByName(rest.join(named, ["key", "sha"]))


def exact_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of every row of ``df``."""
    rows = fingerprinted(df, id_col=id_col, text_col=text_col)
    found = members(rows, build(df, rows, text_col=text_col))
    return found.select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with their columns as they are.

    Its rows are written once, so that each keeps its number.
    """
    held = materialize(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("rid")), "dedup-held")
    text = F.col("text").cast("string")
    rows = held.select("rid", "doc_id", F.coalesce(F.char_length(text), F.lit(0)).alias("points"), normalised(text).alias("norm"))
    rows = materialize(rows.select("rid", "doc_id", "points", F.xxhash64("norm").alias("key"), F.unhex(F.sha2("norm", 256)).alias("sha")), "dedup-rows")
    stay = build(held, rows).entries.select(F.col("keep_rid").alias("rid"))
    return held.join(stay, "rid", "left_semi").select(*(F.col(f"row.`{c}`").alias(c) for c in df.columns))

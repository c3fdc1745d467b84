"""Snapshot maintenance: ordering, change logs, path mapping, collisions, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.functions.paths import relative_under
from sitewright.operators.tree import below_any, longest_prefix
from sitewright.shared import materialize


def sort_dedup(df: DataFrame, key: Column, tie: Column) -> DataFrame:
    """Rows in byte order of ``key``, one a key (the least ``tie``), without null keys.

    The aggregate keeps one row a key before the shuffle, so a hot key costs nothing, and
    the sort is a range shuffle that spills.
    """
    row = F.struct(*(F.col(c) for c in df.columns))
    one = df.select(key.alias("__key"), tie.alias("__tie"), row.alias("__row")).where("__key is not null").groupBy("__key").agg(F.min_by("__row", "__tie").alias("r"))
    return one.orderBy("__key").select("r.*")


def path_neighbours(diff: DataFrame, buckets: int | None = None) -> DataFrame:
    """For each added or deleted path: its neighbours in the snapshot that lacks it.

    ``before`` and ``after`` are the nearest smaller and greater paths of the other snapshot.
    Rows are range-partitioned by path and written with their range's number, as ranges
    sampled anew would differ; within a range windows fill both ways, and across ranges a row
    a range carries the edge values, so no task sees the whole order.
    """
    spark = diff.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(diff.select("path", "change").repartitionByRange(n, "path").withColumn("bucket", F.spark_partition_id()), "ranges")
    rows = rows.select("path", "change", "bucket", F.when(F.col("change") != "added", F.col("path")).alias("old"), F.when(F.col("change") != "deleted", F.col("path")).alias("new"))
    edges = rows.groupBy("bucket").agg(*(f(c).alias(f"{tag}_{c}") for c in ("old", "new") for tag, f in (("min", F.min), ("max", F.max))))
    # One row a range: sizes are those of the partition count.
    order = Window.orderBy("bucket")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    edges = edges.select("bucket", *(F.max(f"max_{c}").over(earlier).alias(f"prior_{c}") for c in ("old", "new")), *(F.min(f"min_{c}").over(later).alias(f"next_{c}") for c in ("old", "new")))
    # Both ways as running frames, each in its own order: a frame that ends at the last row
    # would be read again for every row.
    own = Window.partitionBy("bucket")
    back = own.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    ahead = own.orderBy(F.desc("path")).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c, w, tag: F.last(c, ignorenulls=True).over(w).alias(f"{tag}_{c}")
    filled = rows.select("path", "change", "bucket", *(last(c, back, "b") for c in ("old", "new")), *(last(c, ahead, "a") for c in ("old", "new")))
    both = filled.where("change IN ('added', 'deleted')").join(edges, "bucket")
    side = lambda old, new: F.when(F.col("change") == "added", old).otherwise(new)
    return both.select(
        "path", "change",
        side(F.coalesce("b_old", "prior_old"), F.coalesce("b_new", "prior_new")).alias("before"),
        side(F.coalesce("a_old", "next_old"), F.coalesce("a_new", "next_new")).alias("after"),
    )


def apply_mutations(index: DataFrame, mutations: DataFrame) -> DataFrame:
    """Upserts (+) and deletes (-) by path; what stood at or below a mutated path goes.

    Mutations do not cancel each other: an upsert below a deleted path stays. One root may take
    the whole index along, so what goes is never broadcast.
    """
    gone = below_any(index, mutations)
    upserts = mutations.where("op = '+'").select(*index.columns)
    return index.join(gone.hint("merge"), "path", "left_anti").unionByName(upserts)


def apply_wal(index: DataFrame, log: DataFrame) -> DataFrame:
    """The index after a change log: the last change of each path wins.

    Deleting an absent path does nothing, and replaying a log changes nothing.
    """
    fields = [c for c in index.columns if c != "path"]
    last = log.groupBy("path").agg(F.max_by(F.struct("op", *fields), "seq").alias("c"))
    upserts = last.where("c.op = '+'").select("path", *(F.col(f"c.{f}").alias(f) for f in fields)).select(*index.columns)
    return index.join(last.select("path"), "path", "left_anti").unionByName(upserts)


def map_paths(index: DataFrame, mapping: DataFrame, default_root: str, scope: str | None = None, alternate_root: str | None = None) -> DataFrame:
    """``local`` for each path: the longest mapped prefix's target, else below a default root.

    ``mapping(prefix, target)`` is looked up depth by depth (``tree.longest_prefix``). Paths
    outside ``scope`` (followed links) go below the alternate root.
    """
    found = longest_prefix(index, F.col("path"), mapping.select("prefix", "target"), "__m")
    fallback = F.concat(F.lit(default_root.rstrip("/") + "/"), F.ltrim("path", F.lit("/")))
    if scope is not None:
        inside = relative_under(F.col("path"), scope)
        fallback = F.when(inside.isNull(), F.concat(F.lit((alternate_root or default_root).rstrip("/") + "/"), F.ltrim("path", F.lit("/")))).otherwise(F.concat(F.lit(default_root.rstrip("/") + "/"), inside))
    mapped = F.concat("__m.target", F.substring(F.col("path"), F.char_length("__m.prefix") + 1, F.char_length("path")))
    return found.select(*index.columns, F.coalesce(mapped, fallback).alias("local"))


def collisions(mapped: DataFrame) -> DataFrame:
    """``local, reason`` for paths that cannot stand side by side: equal ones, and one below
    another that is no intermediate link. Column ``intermediate`` may be absent."""
    link = F.coalesce(F.col("intermediate"), F.lit(False)) if "intermediate" in mapped.columns else F.lit(False)
    same = mapped.groupBy("local").count().where("count > 1").select("local", F.lit("same").alias("reason"))
    solid = mapped.where(~link).select(F.col("local").alias("path"))
    below = below_any(mapped.select(F.col("local").alias("path")).distinct(), solid, proper=True)
    return same.unionByName(below.select(F.col("path").alias("local"), F.lit("below").alias("reason")))


def assert_no_collisions(mapped: DataFrame) -> None:
    bad = collisions(mapped).take(1)
    if bad:
        raise ValueError(f"paths collide: {bad[0]['local']} ({bad[0]['reason']})")


def merge_unit(path: Column, whole_depth: int = 2, units: tuple[str, ...] = ("plugins", "themes"), leaves: tuple[str, ...] = ("uploads",)) -> Column:
    """What a merge takes or leaves as one: a plugin or theme, a single upload, else a top entry."""
    parts = F.split(path, "/")
    return F.when(parts[0].isin(*units), F.array_join(F.slice(parts, 1, whole_depth), "/")).when(parts[0].isin(*leaves), path).otherwise(parts[0])


def merge_no_overwrite(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Both trees' rows, where the destination's units win over the source's."""
    unit = merge_unit(F.col("path"))
    held = destination.select(unit.alias("__unit")).distinct()
    added = source.withColumn("__unit", unit).join(held, "__unit", "left_anti").select(*source.columns)
    return destination.select(*source.columns).unionByName(added)

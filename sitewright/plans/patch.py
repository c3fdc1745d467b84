"""Copy and delete plans between two snapshots, as set operations on ancestor closures.

A snapshot is sparse: a directory that is not empty has no row, its descendants imply it. So
what exists is the closure of the paths under ``ancestors``. Every test on that is an
equi-join after ``explode``: no prefix join, which Spark could only plan as a nested loop.
Build sides are made distinct before the shuffle, so one huge directory is one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.functions.paths import is_under, with_self
from sitewright.operators.tree import below_any
from sitewright.shared import materialize


def allowed(path: Column, includes: list[str], excludes: list[str]) -> Column:
    """Under an include, and neither under, equal to nor an ancestor of an exclude."""
    test = F.lit(not includes)
    for root in includes:
        test = test | is_under(path, root)
    for root in excludes:
        test = test & ~is_under(path, root) & ~is_under(F.lit(root), path)
    return test


def select_paths(df: DataFrame, includes: list[str], excludes: list[str]) -> DataFrame:
    return df.where(allowed(F.col("path"), includes, excludes))


def closure(index: DataFrame) -> DataFrame:
    """Every path and ancestor of a snapshot, once, as ``path``."""
    return index.select(F.explode(with_self(F.col("path"))).alias("path")).distinct()


#: Row types as numbers, so that aggregates stay in hash tables.
TYPES = ("file", "link", "dir")


def _sides(base: DataFrame, head: DataFrame) -> DataFrame:
    """What each path of either closure is: its row on each side, and what lies below it.

    One shuffle: rows are exploded to ancestors and counted per path before they move, so a
    directory costs a row a task however much it holds.
    """

    def exploded(df: DataFrame, side: str) -> DataFrame:
        kind = F.coalesce(F.array_position(F.array(*map(F.lit, TYPES)), F.col("type")), F.lit(1))
        chain = df.select("path", "size", "ctime", F.when(kind == 0, 1).otherwise(kind).cast("int").alias("kind"), F.explode(with_self(F.col("path"))).alias("p"))
        own = F.col("p") == F.col("path")
        mine = [F.when(own, F.col(c)).alias(f"{side}_{c}") for c in ("kind", "size", "ctime")]
        return chain.select(F.col("p").alias("path"), *mine, (~own).alias(f"{side}_below"))

    both = exploded(base, "old").unionByName(exploded(head, "new"), allowMissingColumns=True)
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    return both.groupBy("path").agg(*(F.max(f"{s}_{c}").alias(f"{s}_{c}") for s in ("old", "new") for c in ("kind", "size", "ctime")), flag("old_below"), flag("new_below"))


def plan_patch(base: DataFrame, head: DataFrame, includes: list[str] = (), excludes: list[str] = ()) -> DataFrame:
    """``path, op, type, size, ctime`` with one op a path: copy, delete or replace.

    Deletes run before copies. A directory that vanished whole is deleted at its highest
    missing ancestor, if the selection allows that; there is no fallback to a lower one. Two
    shuffles in all: one makes what each path is, and the paths that the head lacks meet
    their parents in another: one whose parent is still there is the top of what vanished.
    """
    ok = allowed(F.col("path"), list(includes), list(excludes))
    known = materialize(_sides(base, head), "plan-sides")  # read twice below, made once
    old, new = F.col("old_kind").isNotNull(), F.col("new_kind").isNotNull()
    live = new | F.col("new_below")
    replaced = new & ~old & F.col("old_below")  # a row in a directory's place
    is_dir = lambda side: F.col(f"{side}_kind") == TYPES.index("dir") + 1
    modified = ~reduce(lambda a, b: a & b, (F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in ("kind", "size", "ctime")))

    copy = new & (~old | (is_dir("new") & ~is_dir("old")) | (~is_dir("new") & modified))
    # Of what the head only implies, an empty directory just lost its row.
    delete = replaced | (old & new & (is_dir("old") != is_dir("new"))) | (old & ~new & ~is_dir("old"))
    named = F.get(F.array(*map(F.lit, TYPES)), F.col("new_kind") - 1)
    op = F.when(copy & delete, "replace").when(copy, "copy").otherwise("delete")
    put = lambda c, t: F.when(copy, c).cast(t)
    stays = known.where(live & ok & (copy | delete)).select("path", op.alias("op"), put(named, "string").alias("type"), put(F.col("new_size"), "long").alias("size"), put(F.col("new_ctime"), "long").alias("ctime"))

    parent = F.when(F.col("path").rlike("[^/]/"), F.regexp_replace("path", "/[^/]*$", ""))
    gone = known.where(~live).select("path", parent.alias("parent"))
    # What lies below a replaced directory goes with it.
    parents = known.where(live & ~replaced).select(F.col("path").alias("parent"), F.lit(True).alias("found"))
    top = gone.join(parents, "parent", "left").where("parent is null OR found")
    none = lambda t: F.lit(None).cast(t)
    return stays.unionByName(top.where(ok).select("path", F.lit("delete").alias("op"), none("string").alias("type"), none("long").alias("size"), none("long").alias("ctime")))


def plan_sync(mode: str, last: DataFrame, now: DataFrame, destination: DataFrame, **selection) -> DataFrame:
    """catch-up plans from the last remote snapshot, mirror from what the destination holds."""
    if mode not in ("catch-up", "mirror"):
        raise ValueError(f"unknown mode: {mode}")
    return plan_patch(last if mode == "catch-up" else destination, now, **selection)


def require_copies(plan: DataFrame, base: DataFrame, head: DataFrame, paths: DataFrame, includes: list[str] = (), excludes: list[str] = ()) -> DataFrame:
    """The plan with copies for the listed, selected paths that the head has.

    A listed path that is in neither snapshot is an error, raised where it is met.
    """
    listed = select_paths(paths.select("path").distinct(), list(includes), list(excludes))
    known = base.select("path").unionByName(head.select("path")).distinct().withColumn("known", F.lit(True))
    checked = listed.join(known, "path", "left").select(F.when(F.col("known"), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("path in neither snapshot: "), F.col("path"))).cast("string")).alias("path"))
    extra = checked.join(head, "path").select("path", F.struct("type", "size", "ctime").alias("head"))
    both = plan.join(extra, "path", "full_outer")
    op = F.when(F.col("head").isNull(), F.col("op")).when(F.col("op").isin("delete", "replace"), "replace").otherwise("copy")
    pick = lambda c: F.coalesce(F.col(f"head.{c}"), F.col(c)).alias(c)
    return both.select("path", op.alias("op"), pick("type"), pick("size"), pick("ctime"))


def plan_summary(plan: DataFrame) -> DataFrame:
    """Copies, and the bytes of those that are files."""
    copies = plan.where("op IN ('copy', 'replace')")
    return copies.agg(F.count("*").alias("n_copies"), F.coalesce(F.sum(F.when(F.col("type") == "file", F.col("size"))), F.lit(0)).alias("n_bytes"))


def apply_plan(base: DataFrame, plan: DataFrame) -> DataFrame:
    """The snapshot that a plan makes of ``base``: deletes (with all below), then copies."""
    deletes = plan.where("op IN ('delete', 'replace')").select("path")
    copies = plan.where("op IN ('copy', 'replace')").select("path", "ctime", "size", "type")
    gone = below_any(base, deletes)
    left = base.select("path", "ctime", "size", "type").join(gone, "path", "left_anti")
    return left.join(copies.select("path"), "path", "left_anti").unionByName(copies)

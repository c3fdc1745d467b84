"""Paths at or below other paths, and their longest mapped prefix, without a task for a whole subtree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.functions.paths import ancestors, with_self
from sitewright.shared import materialize

#: Roots up to which they are broadcast, after a count; beyond it a root's rows are dealt over SALTS tasks.
BROADCAST_ROOTS, SALTS = 50_000, 32


def below_any(paths: DataFrame, roots: DataFrame, proper: bool = False) -> DataFrame:
    """The distinct ``path`` values of ``paths`` at or below (``proper``: below) one of ``roots(path)``.

    Paths are exploded to their ancestors for an equi-join. All rows of a snapshot may share
    an ancestor, so the exploded rows only shuffle where that is bounded: few roots are
    broadcast; of many, those that are an ancestor at all are found among distinct ancestors
    (combined before they shuffle) and broadcast if these are few; else each root is joined
    in SALTS parts. The joins of uncounted or many roots are merge joins by hint: the optimizer
    sees the size of their files, not of their rows (nor of SALTS copies of these), and would
    broadcast them through the driver.
    """
    chain = paths.select("path").select(F.col("path").alias("own"), F.explode((ancestors if proper else with_self)(F.col("path"))).alias("path"))
    roots = materialize(roots.select("path").where("path is not null").distinct(), "roots")
    if _few(roots):
        hit = chain.join(F.broadcast(roots), "path", "left_semi")
    else:
        found = materialize(chain.select("path").distinct().join(roots.hint("merge"), "path", "left_semi"), "roots")
        if _few(found):
            hit = chain.join(F.broadcast(found), "path", "left_semi")
        else:
            salted = found.select("path", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
            hit = chain.withColumn("salt", F.pmod(F.xxhash64("own"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["path", "salt"], "left_semi")
    return hit.select(F.col("own").alias("path")).distinct()


def _few(roots: DataFrame) -> bool:
    return roots.limit(BROADCAST_ROOTS + 1).count() <= BROADCAST_ROOTS


def longest_prefix(df: DataFrame, path: Column, mapping: DataFrame, name: str = "hit") -> DataFrame:
    """``df`` with ``name``, the struct of the ``mapping(prefix, target)`` row whose prefix is the
    longest that is ``path`` or stands above it; null if none is. Of equal prefixes the one with
    the least target counts.

    Prefixes are taken by depth, the deepest first: one hash lookup of the path's own prefix
    of each depth that occurs (a trie's walk, each level a table), and no rows are made or
    gathered. A depth with few prefixes is broadcast, after a count; one with many is joined
    in SALTS parts, so a prefix above all paths is no single task's either way.
    """
    one = mapping.where("prefix <> ''").groupBy("prefix").agg(F.min("target").alias("target"))
    one = materialize(one.withColumn("depth", F.size(F.split("prefix", "/"))), "prefixes")
    depths = sorted(((r["depth"], r["n"]) for r in one.groupBy("depth").agg(F.count("*").alias("n")).collect()), reverse=True)  # a row a depth
    out, cells = df.withColumn("__path", path).withColumn("__salt", F.pmod(F.xxhash64("__path"), F.lit(SALTS)).cast("int")), []
    for depth, n in depths:
        own = F.when(F.size(F.split("__path", "/")) >= depth, F.substring_index("__path", "/", depth))
        level = one.where(F.col("depth") == depth).select(F.col("prefix").alias("__prefix"), F.struct("prefix", "target").alias(f"__hit{depth}"))
        found = F.coalesce(*cells) if cells else F.lit(None)
        asked = F.when(found.isNull(), own)  # a path that has its prefix asks no more
        if n <= BROADCAST_ROOTS:
            out = out.withColumn("__own", asked).join(F.broadcast(level), F.col("__own") == F.col("__prefix"), "left")
        else:
            dealt = level.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            out = out.withColumn("__own", asked).join(dealt, (F.col("__own") == F.col("__prefix")) & (F.col("__salt") == F.col("__part")), "left").drop("__part")
        out = out.drop("__own", "__prefix")
        cells.append(F.col(f"__hit{depth}"))
    hit = F.coalesce(*cells) if cells else F.lit(None).cast("struct<prefix:string,target:string>")
    return out.select(*(F.col(f"`{c}`") for c in df.columns), hit.alias(name))

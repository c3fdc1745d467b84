"""Progress records, host detection and batch classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewright.functions.values import compressibility


def latest_progress(events: DataFrame) -> DataFrame:
    """The last snapshot of each command: ``command, phase, label, done, ts``.

    Label and counter carry forward only within a run of one phase. ``events(command, phase,
    label, done, ts)``; a command's log is in one partition, sorted with spill.
    """
    w = Window.partitionBy("command").orderBy("ts", "phase")
    run = F.sum(F.when(F.col("phase").eqNullSafe(F.lag("phase").over(w)), 0).otherwise(1)).over(w)
    within = Window.partitionBy("command", "run").orderBy("ts")
    filled = events.withColumn("run", run).select("command", "phase", "run", "ts", *(F.last(c, ignorenulls=True).over(within).alias(c) for c in ("label", "done")))
    return filled.groupBy("command").agg(F.max_by(F.struct("phase", "label", "done", "ts"), F.struct("ts", "run")).alias("s")).select("command", "s.*")


def detect_host(signals: DataFrame, rules: DataFrame, least: float = 0.5) -> DataFrame:
    """``site, host, score``: the best host whose rules add up to ``least`` or more, else other.

    ``signals(site, signal)``, ``rules(host, signal, score)``; scores are capped at 1.
    """
    sites = signals.select("site").distinct()
    scored = signals.distinct().join(rules, "signal").groupBy("site", "host").agg(F.least(F.sum("score"), F.lit(1.0)).alias("score")).where(F.col("score") >= least)
    best = scored.groupBy("site").agg(F.max(F.struct("score", "host")).alias("b"))
    return sites.join(best, "site", "left").select("site", F.coalesce("b.host", F.lit("other")).alias("host"), F.coalesce("b.score", F.lit(0.0)).alias("score"))


def batch_compressible(files: DataFrame) -> DataFrame:
    """``batch, compressible``: whether any of a batch's ``path`` (and ``head``) compresses."""
    head = F.col("head") if "head" in files.columns else None
    return files.groupBy("batch").agg(F.bool_or(compressibility(F.col("path"), head) == "yes").alias("compressible"))

"""Snapshot diff by one full outer equi-join on the path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff_index(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both snapshots side by side: ``path``, ``change``, and each side's columns.

    ``change`` is added, deleted, modified (type, size or ctime differ) or unchanged. The
    join is on the path alone, so both sides shuffle once and nothing is broadcast.
    """
    side = lambda df, tag: df.select(F.col("path").alias(f"{tag}_path"), *(F.col(c).alias(f"{tag}_{c}") for c in ("ctime", "size", "type")))
    both = side(old, "old").join(side(new, "new"), F.col("old_path") == F.col("new_path"), "full_outer")
    differs = ~(F.col("old_type").eqNullSafe(F.col("new_type")) & F.col("old_size").eqNullSafe(F.col("new_size")) & F.col("old_ctime").eqNullSafe(F.col("new_ctime")))
    change = F.when(F.col("old_path").isNull(), "added").when(F.col("new_path").isNull(), "deleted").when(differs, "modified").otherwise("unchanged")
    return both.select(F.coalesce("old_path", "new_path").alias("path"), change.alias("change"), *(c for c in both.columns if not c.endswith("_path")))

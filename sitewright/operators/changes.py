"""Change sets of rewritten rows, and their conditional application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sitewright.functions.rewrite import rewritten


def rewrite_changes(df: DataFrame, keys: list[str], columns: list[str], mapping: dict[str, str], *, hints: dict[str, str] | None = None, base: str | None = None) -> DataFrame:
    """``keys, column, old, new`` for each value that a rewrite changes.

    A table without a key gives nothing; a key that the rewrite would change is an error.
    """
    if not keys:
        return df.limit(0).select(F.lit("").alias("column"), F.lit("").alias("old"), F.lit("").alias("new"))
    hints, intact = hints or {}, F.lit(True)
    types = dict(df.dtypes)
    texts = [k for k in keys if types[k] == "string"]
    # All columns are rewritten in one projection, so rows are read once.
    new = {c: rewritten(F.col(f"`{c}`"), mapping, hint=hints.get(c), base=base) for c in dict.fromkeys([*texts, *columns])}
    done = df.select(*keys, *(F.struct(F.col(f"`{c}`").alias("old"), v.alias("new")).alias(f"__{c}") for c, v in new.items()))
    for k in texts:
        same = F.col(f"`__{k}`.old").eqNullSafe(F.col(f"`__{k}`.new"))
        intact = intact & F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("a key would change: "), F.col(f"`__{k}`.old"))).cast("boolean"))
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`__{c}`.old").alias("old"), F.col(f"`__{c}`.new").alias("new")) for c in columns))).alias("c")
    return done.select(*keys, intact.alias("intact"), cells).where(F.col("intact") & ~F.col("c.old").eqNullSafe(F.col("c.new"))).select(*keys, "c.*")


def apply_changes(current: DataFrame, keys: list[str], changes: DataFrame) -> DataFrame:
    """``current`` with each change whose key exists and whose old value still stands.

    Changes are gathered to a row a key and joined once. Of several changes of one cell that
    fit, the least new value is taken.
    """
    columns = [f for f in current.columns if f not in keys]
    pairs = lambda c: F.collect_set(F.when(F.col("column") == c, F.struct("old", "new"))).alias(f"__{c}")
    joined = current.join(changes.groupBy(*keys).agg(*map(pairs, columns)), keys, "left")

    def cell(c: str) -> Column:
        own = F.col(f"`{c}`")
        fitting = F.array_sort(F.filter(F.col(f"`__{c}`"), lambda p: p["old"].eqNullSafe(own.cast("string"))))
        return F.when(F.size(fitting) > 0, F.get(fitting, 0)["new"].cast(current.schema[c].dataType)).otherwise(own).alias(c)

    return joined.select(*(cell(c) if c in columns else F.col(f"`{c}`") for c in current.columns))


def rewrite_stats(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """``table_name, n_processed, n_changed`` from ``rows(table_name, id)`` and ``changes`` alike."""
    seen = rows.groupBy("table_name").agg(F.count("*").alias("n_processed"))
    hit = changes.groupBy("table_name").agg(F.countDistinct("id").alias("n_changed"))
    return seen.join(hit, "table_name", "left").select("table_name", "n_processed", F.coalesce("n_changed", F.lit(0)).alias("n_changed"))


def counted(df: DataFrame, columns: list[str], mapping: dict[str, str], name: str | Observation, *, hints: dict[str, str] | None = None, **how) -> DataFrame:
    """``df`` with ``columns`` rewritten, whose writing counts its rows by the way.

    ``n_processed`` and ``n_changed`` come from the pass that writes the result, under the
    observation's name, so no row is read or rewritten a second time for them.
    """
    hints = hints or {}
    new = [F.struct(F.col(f"`{c}`").alias("old"), rewritten(F.col(f"`{c}`"), mapping, hint=hints.get(c), **how).alias("new")).alias(f"__{c}") for c in columns]
    both = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in columns), *new)
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(f"`__{c}`.old").eqNullSafe(F.col(f"`__{c}`.new"))
    seen = both.observe(name, F.count(F.lit(1)).alias("n_processed"), F.count_if(changed).alias("n_changed"))
    return seen.select(*(F.col(f"`__{c}`.new").alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns))


def write_rewritten(tables: dict[str, DataFrame], columns: dict[str, list[str]], mapping: dict[str, str], target: str, **how) -> DataFrame:
    """Write each table below ``target`` with its ``columns`` rewritten; ``table_name, n_processed, n_changed``, a row a table."""
    rows = []
    for name, df in tables.items():
        seen = Observation()
        counted(df, columns.get(name, []), mapping, seen, **how).write.parquet(f"{target}/{name}")
        rows.append((name, seen.get["n_processed"], seen.get["n_changed"]))
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table_name string, n_processed long, n_changed long")

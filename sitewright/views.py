"""Snapshots and site tables derived from the given tables, with the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    path = F.concat(F.lit("d"), cust % 50, F.when(key % 7 == 0, "-x").otherwise(""), F.lit("/s"), key % 4, F.lit("/o"), key)
    return o.select(
        key.alias("k"), cust.alias("c"), path.alias("path"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ctime"),
        F.floor("o_totalprice").cast("long").alias("size"), F.lit("file").alias("type"),
    )


def old_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier snapshot: ``path, ctime, size, type``."""
    return _base_entry(spark, sf_dir).where("k % 10 <> 3").select("path", "ctime", "size", "type")


def new_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later snapshot: additions, deletions, changed sizes and times, and a file in a directory's place."""
    kept = _base_entry(spark, sf_dir).where("k % 10 <> 7 AND NOT (c % 50 IN (4, 14, 6) AND k % 7 <> 0)")
    changed = kept.select(
        "path", (F.col("ctime") + F.when(F.col("k") % 13 == 0, 60).otherwise(0)).alias("ctime"),
        (F.col("size") + F.when(F.col("k") % 11 == 0, 1).otherwise(0)).alias("size"), "type",
    )
    one = table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.lit("d6").alias("path"), F.lit(0).cast("long").alias("ctime"), F.lit(1).cast("long").alias("size"), F.lit("file").alias("type"))
    return changed.unionByName(one)


INDEX_SQL = """
WITH base_entry AS (
  SELECT o_orderkey AS k, o_custkey AS c,
    'd' || (o_custkey % 50) || (CASE WHEN o_orderkey % 7 = 0 THEN '-x' ELSE '' END) || '/s' || (o_orderkey % 4) || '/o' || o_orderkey AS path,
    CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) AS ctime,
    CAST(floor(o_totalprice) AS BIGINT) AS size, 'file' AS type
  FROM orders
), old_index AS (
  SELECT path, ctime, size, type FROM base_entry WHERE k % 10 <> 3
), new_index AS (
  SELECT path, ctime + CASE WHEN k % 13 = 0 THEN 60 ELSE 0 END AS ctime,
    size + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS size, type
  FROM base_entry WHERE k % 10 <> 7 AND NOT (c % 50 IN (4, 14, 6) AND k % 7 <> 0)
  UNION ALL SELECT 'd6', 0, 1, 'file' FROM region WHERE r_regionkey = 0
)
"""


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes and upserts of single paths, and the delete of a whole directory."""
    base = _base_entry(spark, sf_dir).where("k % 17 = 0 OR k % 19 = 0")
    rows = base.select(F.col("k").alias("seq"), F.when(F.col("k") % 17 == 0, "-").otherwise("+").alias("op"), "path", "ctime", (F.col("size") + 7).alias("size"), "type")
    none = lambda t: F.lit(None).cast(t)
    one = table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.lit(0).cast("long").alias("seq"), F.lit("-").alias("op"), F.lit("d8").alias("path"), none("long").alias("ctime"), none("long").alias("size"), none("string").alias("type"))
    return rows.unionByName(one)


#: ``own, path`` rows: each path with itself and its ancestors.
CLOSURE_SQL = """, {name} AS (
  SELECT own, array_to_string(parts[1:n], '/') AS path
  FROM (SELECT path AS own, string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')) + 1)) AS n FROM {source})
)
"""

#: The patch rules over old_index and new_index, whole selection.
PLAN_SQL = (
    CLOSURE_SQL.format(name="old_chain", source="old_index")
    + CLOSURE_SQL.format(name="new_chain", source="new_index")
    + """, both_sides AS (
  SELECT coalesce(o.path, n.path) AS path, o.path IS NULL AS added, n.path IS NULL AS deleted,
    o.path IS NOT NULL AND n.path IS NOT NULL AND (o.type <> n.type OR o.size <> n.size OR o.ctime <> n.ctime) AS modified
  FROM old_index o FULL JOIN new_index n ON o.path = n.path
), replaced_dirs AS (
  SELECT path FROM both_sides WHERE added AND path IN (SELECT path FROM old_chain WHERE own <> path)
), missing AS (
  SELECT own, min_by(path, length(path)) AS path FROM old_chain
  WHERE own IN (SELECT path FROM both_sides WHERE deleted) AND path NOT IN (SELECT path FROM new_chain) GROUP BY own
), candidates AS (
  SELECT DISTINCT coalesce(m.path, b.path) AS path FROM both_sides b LEFT JOIN missing m ON b.path = m.own WHERE b.deleted
), below_replaced AS (
  SELECT DISTINCT c.path FROM candidates c, replaced_dirs r WHERE starts_with(c.path, r.path || '/')
), deletes AS (
  SELECT path FROM candidates WHERE path NOT IN (SELECT path FROM below_replaced) UNION SELECT path FROM replaced_dirs
), copies AS (
  SELECT path FROM both_sides WHERE added OR modified
), plan AS (
  SELECT coalesce(c.path, d.path) AS path, CASE WHEN d.path IS NULL THEN 'copy' WHEN c.path IS NULL THEN 'delete' ELSE 'replace' END AS op
  FROM copies c FULL JOIN deletes d ON c.path = d.path
)
"""
)

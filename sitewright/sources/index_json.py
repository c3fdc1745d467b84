"""Snapshot indexes and plans as JSON lines with base64 paths; reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewright.functions.paths import relative_under

INDEX = T.StructType([T.StructField("path", T.StringType()), T.StructField("ctime", T.LongType()), T.StructField("size", T.LongType()), T.StructField("type", T.StringType()), T.StructField("empty", T.BooleanType())])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index lines as rows; blank lines are skipped, a malformed one is an error."""
    rows = spark.read.schema(INDEX).json(path, mode="FAILFAST")
    return rows.withColumn("path", F.unbase64("path").cast("string"))


def encode_index(index: DataFrame) -> DataFrame:
    """Rows as one JSON line each, paths in base64."""
    return index.select(F.to_json(F.struct(F.base64(F.col("path").cast("binary")).alias("path"), *(c for c in index.columns if c != "path"))).alias("value"))


def decode_index(lines: DataFrame) -> DataFrame:
    """The rows of index lines in a column ``value``; blank lines go, malformed ones are errors."""
    parsed = lines.where(F.trim("value") != "").select(F.from_json("value", INDEX, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return parsed.withColumn("path", F.unbase64("path").cast("string"))


def write_index(index: DataFrame, path: str) -> None:
    encode_index(index).write.text(path)


def write_plan(plan: DataFrame, folder: str, prefix: str) -> None:
    """``folder/copies`` as JSON lines, ``folder/deletes`` as NUL-delimited paths below ``prefix``.

    A delete outside the prefix is an error.
    """
    copy = plan.where("op IN ('copy', 'replace')").select("path", "type", "size", "ctime")
    encode_index(copy).write.text(f"{folder}/copies")
    delete_list(plan, prefix).write.option("lineSep", "\0").text(f"{folder}/deletes")


def delete_list(plan: DataFrame, prefix: str) -> DataFrame:
    inside = relative_under(F.col("path"), prefix)
    checked = F.when(inside.isNull() | (inside == ""), F.raise_error(F.concat(F.lit("delete outside the prefix: "), F.col("path"))).cast("string")).otherwise(inside)
    return plan.where("op IN ('delete', 'replace')").select(checked.alias("value"))


def read_reports(lines: DataFrame, kind_ending: str = "_report", versions: tuple[int, ...] = (1,)) -> DataFrame:
    """From mixed log lines (``value``), the JSON records whose type ends so and whose schema
    version is known: ``kind, version, record``. What is no JSON is ignored."""
    record = F.try_parse_json("value")
    kind, version = F.try_variant_get(record, "$.type", "string"), F.try_variant_get(record, "$.schema_version", "int")
    return lines.select(kind.alias("kind"), version.alias("version"), F.col("value").alias("record")).where(F.col("kind").endswith(kind_ending) & F.col("version").isin(*versions))

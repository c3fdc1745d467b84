"""Publishing many tables at once: staged privately, then swapped live by one pointer.

Each publisher stages into a folder of its own, so none can change what another made live.
A version's pointer is one small file that names the folder and is written once: of two
publishers of a version one gets False, and ``stage_and_publish`` then takes the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sitewright.shared import names_in, read_small, write_once


def stage(tables: dict[str, DataFrame], target: str) -> str:
    """Write all tables where no reader looks; the folder's name below ``target/versions``."""
    name = uuid.uuid4().hex
    for table, df in tables.items():
        df.write.parquet(f"{target}/versions/{name}/{table}")
    return name


def publish(spark: SparkSession, target: str, version: int, staged: str) -> bool:
    """Make what was staged live as ``version``; False if the version is taken by other tables."""
    pointer = f"{target}/live/{version:012d}"
    return write_once(spark, pointer, staged) or read_small(spark, pointer) == staged


def live_version(spark: SparkSession, target: str) -> int | None:
    return max(map(int, names_in(spark, f"{target}/live")), default=None)


def read_live(spark: SparkSession, target: str, table: str) -> DataFrame:
    """A table of the live version: all tables change together."""
    version = live_version(spark, target)
    if version is None:
        raise ValueError(f"nothing is published at {target}")
    return spark.read.parquet(f"{target}/versions/{read_small(spark, f'{target}/live/{version:012d}')}/{table}")


def stage_and_publish(spark: SparkSession, tables: dict[str, DataFrame], target: str) -> int:
    """The version as which the tables went live, after those of publishers that were faster."""
    staged = stage(tables, target)
    while True:
        version = (live_version(spark, target) or 0) + 1
        if publish(spark, target, version, staged):
            return version

"""SQL dumps: rows to batched INSERT text, and such text back to rows.

A statement is one line of text without a semicolon inside (text values are base64), so the
dump splits on semicolons alone and any part of it can be read by any task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewright.functions.values import float_text, project_encoded

#: Fixed shape of a value in a statement, of a statement's head up to its values, of what
#: stands between two rows, and of what may follow the last one.
VALUE = r"NULL|''|-?\d[\d.eE+-]*+|(?:CONVERT\()?FROM_BASE64\('[A-Za-z0-9+/=]*+'\)(?: USING utf8mb4\))?"
HEAD = r"(?is)^\s*+(?:--[^\n]*+\n\s*+)*+INSERT\s+INTO\s+`((?:[^`]|``)++)`\s*\(([^)]*+)$"
BODY, BETWEEN = r"(?i)\)\s*VALUES\s*\(", r"\)\s*,\s*\("
TAIL = r"(?is)^\s*(?:ON DUPLICATE KEY UPDATE [^'()]*)?$"
NAME = "`((?:[^`]|``)+)`"


def kind_of(field: T.StructField) -> str:
    t = field.dataType
    return "numeric" if isinstance(t, T.NumericType) else "binary" if isinstance(t, T.BinaryType) else "text"


def encoded_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``tuple``: each row's value list in transport form."""
    values = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = float_text(c)
        values.append(project_encoded(c, kind_of(f)))
    return df.select(*keys, F.concat(F.lit("("), F.concat_ws(",", *values), F.lit(")")).alias("tuple"))


def dump_statements(df: DataFrame, table: str, keys: list[str], max_rows: int = 1000, max_bytes: int = 1 << 20, partitions: int | None = None) -> DataFrame:
    """``value``: one statement a batch, in key order within and across partitions.

    Rows are range-partitioned by key, encoded and streamed; a batch closes on its rows or
    bytes.
    """
    columns = ", ".join(f"`{c}`" for c in df.columns)
    head = f"INSERT INTO `{table}` ({columns}) VALUES "
    tail = f" ON DUPLICATE KEY UPDATE `{keys[0]}`=`{keys[0]}`"
    rows = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    rows = encoded_rows(rows.sortWithinPartitions(*keys), []).select("tuple")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch: list[str] = []
        size = 0
        for pdf in frames:
            out = []
            for t in pdf["tuple"]:
                if batch and (len(batch) >= max_rows or size + len(t) > max_bytes):
                    out.append(head + ",".join(batch) + tail + ";")
                    batch, size = [], 0
                batch.append(t)
                size += len(t) + 1
            yield pd.DataFrame({"value": out}, dtype=object)
        if batch:
            yield pd.DataFrame({"value": [head + ",".join(batch) + tail + ";"]})

    return rows.mapInPandas(pack, "value string")


def write_sql_dump(df: DataFrame, table: str, path: str, keys: list[str], **bounds) -> None:
    dump_statements(df, table, keys, **bounds).write.text(path)


def parse_statements(statements: DataFrame, table: str, schema: T.StructType) -> DataFrame:
    """Rows of ``table`` from statements in a column ``value``; other statements are dropped.

    No value holds a comma or a parenthesis but its own, so a statement is cut into rows and
    a row into values by its separators, in built-in expressions; columns that are not read
    are not decoded. A row with more or fewer values than the statement has columns, a value
    of another shape, and text after the last row but the upsert clause are errors.
    """
    wrong = lambda what, c: F.raise_error(F.concat(F.lit(f"{what} in a statement on {table}: "), F.substring(c, 1, 200)))
    parts = F.split("value", BODY, 2)
    head = lambda k: F.regexp_extract(F.get("parts", 0), HEAD, k)
    own = statements.select(parts.alias("parts")).where((F.size("parts") == 2) & (F.replace(head(1), F.lit("``"), F.lit("`")) == table))
    names = F.transform(F.regexp_extract_all(head(2), F.lit(NAME), F.lit(1)), lambda c: F.replace(c, F.lit("``"), F.lit("`")))
    rest = F.col("rest")
    tail = F.substring_index(rest, ")", -1)
    body = F.substring(rest, F.lit(1), F.char_length(rest) - F.char_length(tail) - 1)
    checked = F.when(rest.contains(")") & tail.rlike(TAIL), F.split(body, BETWEEN)).otherwise(wrong("text after the last row", tail).cast("array<string>"))
    rows = own.select(names.alias("names"), F.get("parts", 1).alias("rest")).select("names", F.explode(checked).alias("row"))
    cut = rows.select("names", F.col("row"), F.split("row", ",").alias("cells"))
    whole = F.when(F.size("cells") == F.size("names"), F.col("cells")).otherwise(wrong("a row that does not fit its columns", F.col("row")).cast("array<string>"))
    cut = cut.select("names", whole.alias("cells")).where(F.size("cells") > 0)  # the test holds whatever columns are read
    place = lambda f: F.array_position("names", f.name).cast("int")
    cells = cut.select(*(F.when(place(f) > 0, F.btrim(F.get("cells", place(f) - 1), F.lit(" \t\r\n"))).alias(f.name) for f in schema))

    def value(f: T.StructField):
        c = F.col(f"`{f.name}`")
        sound = F.when(c.rlike(f"^(?:{VALUE})$"), c).otherwise(wrong("a malformed value", c).cast("string"))
        inner = F.substring_index(F.substring_index(sound, "'", 2), "'", -1)
        text = F.when(c.startswith("FROM_") | c.startswith("CONVERT") | c.startswith("'"), F.unbase64(inner)).otherwise(sound.cast("binary"))
        text = text if isinstance(f.dataType, T.BinaryType) else text.cast("string")
        return F.when(c.isNull() | (c == "NULL"), F.lit(None)).otherwise(text).cast(f.dataType).alias(f.name)

    return cells.select(*(value(f) for f in schema))


def read_sql_dump(spark: SparkSession, path: str, table: str, schema: T.StructType) -> DataFrame:
    return parse_statements(spark.read.text(path, lineSep=";"), table, schema)

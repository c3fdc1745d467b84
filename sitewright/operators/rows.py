"""Keyed rows: pages, oversized values, chunks, batches."""

from __future__ import annotations

import datetime
import re
from decimal import Decimal
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewright.shared import materialize


def scan_table(spark: SparkSession, path: str, columns: dict[str, Column] | None = None, *, jdbc: dict | None = None, keys: list[str] | None = None, partitions: int = 64) -> DataFrame:
    """A whole table, by splits of its files or, over JDBC, by ranges of its key.

    ``columns`` are expressions to read; the reader prunes the rest. Over JDBC (``jdbc`` has
    ``url`` and perhaps ``properties``) the key's columns are read first for the ranges'
    bounds, so that ranges hold about as many rows each, whatever the key's gaps and heavy
    values. Without a key one task reads the table.
    """
    if not jdbc:
        df = spark.read.parquet(path)
    else:
        how = {"url": jdbc["url"], "table": path, "properties": jdbc.get("properties", {})}
        df = spark.read.jdbc(**how)
        if keys:
            quote = lambda c: f'"{c}"' if re.search(r"[^A-Z0-9_]", c) else c
            df = spark.read.jdbc(**how, predicates=range_predicates(split_points(_first_keys(spark, df, how, keys), keys, partitions), [quote(k) for k in keys]))
    return df.select(*(c.alias(n) for n, c in columns.items())) if columns else df


def _first_keys(spark: SparkSession, df: DataFrame, how: dict, keys: list[str]) -> DataFrame:
    """A table's keys over JDBC, read by even steps of a whole-number key, else by one task."""
    field = df.schema[keys[0]]
    if not isinstance(field.dataType, T.IntegralType):
        return df.select(*keys)
    low, high = df.agg(F.min(keys[0]), F.max(keys[0])).first()
    if low is None or low == high:
        return df.select(*keys)
    steps = spark.sparkContext.defaultParallelism
    return spark.read.jdbc(**how, column=keys[0], lowerBound=low, upperBound=high + 1, numPartitions=steps).select(*keys)


def split_points(keys: DataFrame, names: list[str], parts: int) -> list[tuple]:
    """Up to ``parts - 1`` keys, in order, between which about as many rows lie each.

    A number's or date's are quantiles of a sketch that is merged from all tasks; a value
    that takes several quantiles by itself is split by the next key. Other types' are the
    bounds of a range shuffle of the keys, which Spark samples. Fewer come back where the
    keys do not tell rows apart.
    """
    if parts < 2 or not names:
        return []
    head, kind = names[0], keys.schema[names[0]].dataType
    if not isinstance(kind, (T.NumericType, T.DateType, T.TimestampType)):
        dealt = keys.select(*names).repartitionByRange(parts, *names)
        ends = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct(*names)).alias("k")).orderBy("p").select("k.*").collect()  # ``parts`` at most
        return [tuple(r) for r in ends[:-1]]
    found = keys.agg(F.percentile_approx(head, [k / parts for k in range(1, parts)], 100 * parts)).first()[0] or []
    points: list[tuple] = []
    for value, same in groupby(found):
        times = len(list(same))
        if times > 1 and len(names) > 1:  # it ends what is before it, and is split by what comes after
            points += [(value, *rest) for rest in split_points(keys.where(F.col(head) == F.lit(value)), names[1:], times + 1)]
        points.append((value,))
    return points


def range_predicates(points: list[tuple], names: list[str]) -> list[str]:
    """Conditions, one a range, of which each row meets exactly one: up to a point and past the one before.

    A point of fewer keys than there are stands for the last row with those. Rows with a null
    key come first.
    """

    def past(point: tuple) -> str:
        tests = []
        for k in range(len(point)):
            same = [f"{c} = {_literal(v)}" for c, v in zip(names[:k], point[:k], strict=False)]
            tests.append(" AND ".join([*same, f"{names[k]} > {_literal(point[k])}"]))
        return "(" + " OR ".join(f"({t})" for t in tests) + ")"

    # Null keys make a comparison unknown, so they are told apart by themselves.
    missing = "(" + " OR ".join(f"{c} IS NULL" for c in names) + ")"
    if not points:
        return ["1 = 1"]
    out = [f"({missing} OR NOT {past(points[0])})"]
    out += [f"(NOT {missing} AND {past(a)} AND NOT {past(b)})" for a, b in zip(points, points[1:], strict=False)]
    return [*out, f"(NOT {missing} AND {past(points[-1])})"]


def _literal(value: object) -> str:
    if isinstance(value, (datetime.datetime, datetime.date)):
        kind = "TIMESTAMP" if isinstance(value, datetime.datetime) else "DATE"
        return f"{kind} '{value.isoformat(' ') if kind == 'TIMESTAMP' else value.isoformat()}'"
    return str(value) if isinstance(value, (int, float, Decimal)) else "'" + str(value).replace("'", "''") + "'"


def scan_ranges(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """``df`` with ``range_no``, the number of the key range that each row falls into, by the
    same bounds and conditions as a scan over JDBC."""
    number = F.lit(None).cast("int")
    for k, test in reversed(list(enumerate(range_predicates(split_points(df, keys, parts), [f"`{c}`" for c in keys])))):
        number = F.when(F.expr(test), F.lit(k)).otherwise(number)
    return df.withColumn("range_no", number)


def keyset_page(df: DataFrame, keys: list[str], after: tuple | None, n: int) -> DataFrame:
    """The next ``n`` rows after a composite key; the limit is the feature (a top-n heap a task).

    The comparison is expanded, so that its first part reaches the scan.
    """
    if after is not None:
        parts = []
        for k in range(len(keys)):
            same = [F.col(c) == F.lit(v) for c, v in zip(keys[:k], after[:k], strict=True)]
            parts.append(reduce(lambda a, b: a & b, [*same, F.col(keys[k]) > F.lit(after[k])]))
        df = df.where((F.col(keys[0]) >= F.lit(after[0])) & reduce(lambda a, b: a | b, parts))
    return df.orderBy(*keys).limit(n)


def offset_page(df: DataFrame, skip: int, n: int) -> DataFrame:
    """Rows ``skip`` to ``skip + n`` in the order of all columns."""
    return df.orderBy(*df.columns).offset(skip).limit(n)


def row_bytes(df: DataFrame) -> Column:
    return reduce(lambda a, b: a + b, (F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns))


def withhold_oversized(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """``df`` with ``row_bytes`` and ``oversized``; the values of oversized rows are null."""
    size = row_bytes(df)
    keep = lambda c: F.col(c) if c in keys else F.when(size <= limit, F.col(c)).alias(c)
    return df.select(*(keep(c) for c in df.columns), size.cast("long").alias("row_bytes"), (size > limit).alias("oversized"))


def chunk_values(df: DataFrame, keys: list[str], column: str, size: int) -> DataFrame:
    """``offset, data, is_first, is_last`` rows of each value's bytes; an empty value is one chunk."""
    value = F.col(column).cast("binary")
    n = F.greatest(F.ceil(F.octet_length(value) / size), F.lit(1)).cast("int")
    at = df.where(F.col(column).isNotNull()).select(*keys, value.alias("__v"), n.alias("__n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("__k"))
    data = F.substring(F.col("__v"), F.col("__k") * size + 1, F.lit(size))
    return at.select(*keys, (F.col("__k") * size).cast("long").alias("offset"), data.alias("data"), (F.col("__k") == 0).alias("is_first"), (F.col("__k") == F.col("__n") - 1).alias("is_last"))


def assemble_chunks(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """``value`` of each key: its chunks in order. A gap, overlap or missing end is an error.

    A value is one row in the end, so its chunks meet in one row, in one shuffle. Bytes that
    are cast to a string stay as they are, so joining strings joins the bytes.
    """
    chunk = F.struct(F.col("offset"), F.col("data").cast("string").alias("data"), F.col("is_last"))
    whole = chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(chunk)).alias("c"))
    end = lambda x: x["offset"] + F.octet_length(x["data"])
    fits = lambda x, i: (x["offset"] == F.when(i == 0, F.lit(0)).otherwise(end(F.get("c", i - 1)))) & (x["is_last"] == (i == F.size("c") - 1))
    good = F.forall(F.transform("c", fits), lambda ok: ok)
    joined = F.array_join(F.transform("c", lambda x: x["data"]), "").cast("binary")
    value = F.when(good, joined).otherwise(F.raise_error(F.lit("chunks have a gap, an overlap or no end")).cast("binary"))
    return whole.select(*keys, value.alias("value"))


def fixed_batches(df: DataFrame, partition: list[str], order: list[str], rows: int) -> DataFrame:
    """``batch`` numbers by a bound on rows alone: native, from the row's place in its group."""
    place = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    return df.withColumn("batch", F.floor((place - 1) / rows).cast("long"))


def pack_batches(df: DataFrame, partition: str, order: list[str], size_col: str, max_rows: int, max_bytes: int, fan: int = 64) -> DataFrame:
    """``batch`` numbers by bounds on rows and bytes; an item over the bound is a batch alone.

    Where a batch begins depends on where the one before did, but the next start is a
    function of a start: rows are cut into sorted ranges, and each range, from sizes alone
    and in parallel, makes a jump table from the starts that may fall into it to the first
    start beyond it. Tables of ``fan`` ranges compose to one, level by level; then the starts
    go down again to the ranges, which number their batches. No task sees more than a range,
    ``fan`` tables or a range's own rows, however many rows a group has, and the result is
    the one-by-one loop's. A null size counts as zero; rows that tie in ``order`` stand by their
    other plain columns.
    """
    group = F.col(f"`{partition}`")
    rest = [f.name for f in df.schema if f.name not in (partition, *order) and isinstance(f.dataType, T.AtomicType)]
    keyed = df.select(group.alias("__g"), F.coalesce(F.col(f"`{size_col}`").cast("long"), F.lit(0)).alias("__size"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"))
    by = ["__g", *(F.col(f"__row.`{c}`") for c in (*order, *rest))]
    held = materialize(keyed.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), "batches")
    held = held.withColumn("__part", F.shiftright("__at", 33))
    ranges = held.groupBy("__g", "__part").agg(F.min("__at").alias("low"), F.count("*").alias("n"), F.sum("__size").alias("bytes"))
    # One row a range: its place in the group's order, and what stands before it in rows and bytes.
    so_far = Window.partitionBy("__g").orderBy("__part")
    before = lambda c: F.coalesce(F.sum(c).over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = materialize(ranges.select("__g", "__part", "low", "n", (F.row_number().over(so_far) - 1).cast("long").alias("k"), before("n").alias("first"), before("bytes").alias("start"), F.col("bytes")), "batches-ranges")
    same = lambda a, b: F.col(f"{a}.__g").eqNullSafe(F.col(f"{b}.__g"))

    # A range's last batch may reach into later ranges: those that begin within its bounds.
    within = lambda c, most: F.max("k").over(Window.partitionBy("__g").orderBy(c).rangeBetween(Window.currentRow, most))
    reach = ranges.select("__g", "k", F.least(within("start", max_bytes), within("first", max_rows)).alias("reach"))
    # They count from the range's end, where the next one starts.
    ends = reach.select("__g", "k", F.lead("reach").over(Window.partitionBy("__g").orderBy("k")).alias("last"))
    pairs = ends.select("__g", F.col("k").alias("own"), F.explode(F.sequence("k", F.coalesce("last", "k"))).alias("k")).alias("p")
    sized = held.select("__g", "__part", "__at", "__size").join(ranges.select(F.col("__g").alias("g2"), "__part", "low", "k", "first"), F.col("__g").eqNullSafe(F.col("g2")) & held["__part"].eqNullSafe(ranges["__part"])).select("__g", "k", (F.col("__at") - F.col("low") + F.col("first")).alias("pos"), "__size").alias("s")
    lent = sized.join(pairs, same("s", "p") & (F.col("s.k") == F.col("p.k"))).select("s.__g", "p.own", "s.pos", "s.__size", (F.col("s.k") == F.col("p.own")).alias("mine"))
    # Of a later range no more rows than a batch may have.
    bounds = ranges.select(F.col("__g"), F.col("k").alias("own"), (F.col("first") + F.col("n")).alias("end")).alias("b")
    lent = lent.alias("s").join(bounds, same("s", "b") & (F.col("s.own") == F.col("b.own"))).where(F.col("mine") | (F.col("pos") < F.col("end") + max_rows)).select("s.__g", "s.own", "pos", "__size", "end")
    kind = df.schema[partition].dataType.simpleString()

    def jumps(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        low, end = int(rows["pos"].iloc[0]), int(rows["end"].iloc[0])
        after = _next_starts(rows["__size"].to_numpy(np.int64), max_rows, max_bytes)[: end - low] + low
        return _table(rows, *_leaps(after, low, end, max_rows), low, end)

    tables = materialize(lent.groupBy("__g", "own").applyInPandas(jumps, f"__g {kind}, k long, low long, end long, exits binary, counts binary"), "batches-tables")

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        low, end = int(rows["low"].iloc[0]), int(rows["end"].iloc[-1])
        starts = np.arange(low, min(end, low + max_rows), dtype=np.int64)
        at, count = _walk(rows, starts)[-1]
        return _table(rows, at, count, low, end)

    levels, width = [tables], ranges.agg(F.max("k")).first()[0] or 0
    while width:
        width //= fan
        above = levels[-1].withColumn("own", F.expr(f"k div {fan}")).groupBy("__g", "own").applyInPandas(compose, f"__g {kind}, k long, low long, end long, exits binary, counts binary")
        levels.append(materialize(above, "batches-tables"))

    def descend(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        walked = _walk(rows, rows["at"].iloc[:1].to_numpy(np.int64), rows["number"].iloc[:1].to_numpy(np.int64))
        return pd.DataFrame({"__g": rows["__g"], "k": rows["k"], "at": [int(a[0]) for a, _ in walked[:-1]], "number": [int(c[0]) for _, c in walked[:-1]]})

    # ``at``: the first start at or after a range's first row; ``number``: of the batch that begins there.
    starts = levels[-1].select("__g", "k", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("number"))
    for level in levels[-2::-1]:
        met = level.withColumn("own", F.expr(f"k div {fan}")).alias("t").join(starts.alias("u"), same("t", "u") & (F.col("t.own") == F.col("u.k"))).select("t.*", "u.at", "u.number")
        starts = materialize(met.groupBy("__g", "own").applyInPandas(descend, f"__g {kind}, k long, at long, number long"), "batches-starts")

    def number(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        low, at, first = (int(rows[c].iloc[0]) for c in ("pos", "at", "number"))
        after, begins, here = _next_starts(rows["__size"].to_numpy(np.int64), max_rows, max_bytes), np.zeros(len(rows), np.int64), at - low
        while here < len(rows):
            begins[here] = 1
            here = int(after[here])
        return pd.DataFrame({"__g": rows["__g"], "pos": rows["pos"], "k": rows["k"], "batch": first - 1 + np.cumsum(begins)})

    begun = sized.join(starts.alias("u"), same("s", "u") & (F.col("s.k") == F.col("u.k"))).select("s.*", "u.at", "u.number")
    found = begun.groupBy("__g", "k").applyInPandas(number, f"__g {kind}, pos long, k long, batch long").alias("f")
    placed = ranges.alias("r").join(found, same("r", "f") & (F.col("r.k") == F.col("f.k"))).select((F.col("pos") - F.col("first") + F.col("low")).alias("__at"), F.col("batch").alias("__batch"))
    return held.join(placed, "__at").select(*(F.col(f"__row.`{c}`").alias(c) for c in df.columns), F.col("__batch").alias("batch"))


def _next_starts(sizes: np.ndarray, max_rows: int, max_bytes: int) -> np.ndarray:
    """For each item, where the next batch begins if one begins there, as far as the items go."""
    before = np.concatenate([[0], np.cumsum(sizes)])
    here = np.arange(len(sizes), dtype=np.int64)
    fit = np.searchsorted(before, before[:-1] + max_bytes, "right") - 1
    return np.minimum(np.maximum(fit, here + 1), here + min(max_rows, len(sizes)))


def _leaps(after: np.ndarray, low: int, end: int, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """From the first ``max_rows`` items of a range: the first start at or past its end, and the
    batches begun before it; by doubling the leaps of all items at once."""
    count = np.ones(len(after), np.int64)
    while (inside := after < end).any():
        to = after[inside] - low
        count[inside], after[inside] = count[inside] + count[to], after[to]
    return after[:max_rows], count[:max_rows]


def _table(rows: pd.DataFrame, exits: np.ndarray, counts: np.ndarray, low: int, end: int) -> pd.DataFrame:
    return pd.DataFrame({"__g": rows["__g"].iloc[:1], "k": rows["own"].iloc[:1].astype("int64"), "low": low, "end": end, "exits": [exits.astype("<i8").tobytes()], "counts": [counts.astype("<i8").tobytes()]})


def _walk(tables: pd.DataFrame, at: np.ndarray, count: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Starts and batches before them as each of consecutive tables is entered, and after the last."""
    at, count, out = at.copy(), np.zeros(len(at), np.int64) if count is None else count.copy(), []
    for low, end, exits, counts in zip(tables["low"], tables["end"], tables["exits"], tables["counts"], strict=True):
        out.append((at.copy(), count.copy()))
        inside = (at >= low) & (at < end)
        to = at[inside] - low
        at[inside], count[inside] = np.frombuffer(exits, "<i8")[to], count[inside] + np.frombuffer(counts, "<i8")[to]
    return [*out, (at, count)]

"""Commits by several writers, and what sources read back."""

from __future__ import annotations

import random
import time
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewright.shared import names_in, read_small, scratch_path, write_once
from sitewright.sources import publish


def test_one_of_many_writers_wins(spark):
    path = scratch_path(spark, "once") + "/pointer"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: write_once(spark, path, f"writer {k}"), range(24)))
    assert sum(won) == 1 and read_small(spark, path) == f"writer {won.index(True)}"
    assert names_in(spark, path.rsplit("/", 1)[0]) == ["pointer"] and names_in(spark, path + "-none") == []


def test_publishers_that_meet(spark):
    """Two publishers stage for the same version: one takes it, the other the next, none is lost."""
    target = scratch_path(spark, "publish")
    tables = lambda k: {"t": spark.range(k, k + 3), "u": spark.range(2).select(F.lit(k).alias("k"))}
    first, second = publish.stage(tables(10), target), publish.stage(tables(20), target)
    assert publish.publish(spark, target, 1, first) and not publish.publish(spark, target, 1, second)
    assert publish.publish(spark, target, 1, first)  # again: nothing changes
    assert sorted(r["id"] for r in publish.read_live(spark, target, "t").collect()) == [10, 11, 12]
    assert publish.publish(spark, target, 2, second) and publish.read_live(spark, target, "u").first()["k"] == 20
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda k: publish.stage_and_publish(spark, tables(k), target), (30, 40, 50, 60)))
    assert sorted(versions) == [3, 4, 5, 6]
    last = (30, 40, 50, 60)[versions.index(6)]
    assert publish.read_live(spark, target, "t").agg(F.min("id")).first()[0] == last == publish.read_live(spark, target, "u").first()["k"]


def test_followed_index_is_log_structured(spark, monkeypatch):
    """Random changes over many batches with small size classes: reads equal a dictionary's, old data
    goes, a replay changes nothing, and what is written follows the log."""
    from sitewright.streaming import jobs

    monkeypatch.setattr(jobs, "SMALL", 8)
    monkeypatch.setattr(jobs, "FAN", 2)
    out, rng = scratch_path(spark, "followed"), random.Random(2)
    start = spark.range(600).selectExpr("concat('p', id) AS path", "named_struct('size', id, 'note', CAST(NULL AS STRING)) AS meta")
    want = {f"p{k}": (k, None) for k in range(600)}
    written, store = [], jobs._store
    monkeypatch.setattr(jobs, "_store", lambda rows, folder: written.append(store(rows, folder)) or written[-1])
    schema = T.StructType([*jobs.CHANGE, *start.schema])
    follow = lambda: jobs.stream_wal(spark, f"{out}/log", start, f"{out}/index", f"{out}/checkpoint").awaitTermination()
    for n in range(9):
        changes = [(100 * n + k, rng.choice("++-"), f"p{rng.randrange(640)}", {"size": n, "note": str(k)}) for k in range(6)]
        for _, op, path, meta in changes:
            want.pop(path, None)
            if op == "+":
                want[path] = (n, meta["note"])
        spark.createDataFrame(changes, schema).coalesce(1).write.mode("append").json(f"{out}/log")
        follow()
        if n in (3, 8):
            assert {r["path"]: tuple(r["meta"]) for r in jobs.read_followed(spark, f"{out}/index").collect()} == want
    assert names_in(spark, f"{out}/index/versions") == ["v000000000008", "v000000000009"]
    runs = [jobs._pointer(spark, f"{out}/index", v)["runs"] for v in (8, 9)]
    assert {f"{out}/index/data/{n}" for n in names_in(spark, f"{out}/index/data")} == {r["folder"] for v in runs for r in v}
    assert 2 <= len(runs[1]) <= 5 and written[0]["rows"] == 600 and sum(r["rows"] for r in written[1:]) < 54 * 5
    before = len(written)
    follow()
    assert len(written) == before


def test_runs_merge_by_size_class():
    from sitewright.streaming import jobs

    sizes, wrote = [1_000_000], 0
    for _ in range(500):
        sizes.append(1000)
        wrote += 1000
        if take := jobs.merging(sizes):
            total = sum(sizes[len(sizes) - take :])
            sizes, wrote = [*sizes[: len(sizes) - take], total], wrote + total
        assert len(sizes) <= 4 * 5
    assert sum(sizes) == 1_500_000 and wrote < 500_000 * 8


def test_latest_of_any_columns(spark):
    """Any value columns, a snapshot to start from, a restart, and the state read back."""
    from sitewright.streaming import jobs

    base, schema = scratch_path(spark, "latest"), "site string, k int, seq long, v struct<a:int,b:array<string>>, at timestamp"
    initial = spark.createDataFrame([("x", 1, 5, (50, ["s"]), None), ("y", 2, 1, (10, []), None)], schema)
    batches = [[("x", 1, 4, (40, None), None), ("y", 2, 3, (30, ["q"]), None), (None, 3, 1, (11, None), None)], [("y", 2, 2, (20, None), None), ("x", 1, 9, None, None), ("z", 9, None, (1, None), None)]]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
            got = jobs.stream_latest(spark.readStream.schema(schema).parquet(f"{base}/in"), ("site", "k"), initial=initial)
            write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out/n={n}")
            got.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        state = {(r["site"], r["k"]): (r["seq"], r["v"] and tuple(r["v"])) for r in jobs.read_latest(spark, f"{base}/checkpoint").collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert state == {("x", 1): (9, None), ("y", 2): (3, (30, ["q"])), (None, 3): (1, (11, None))}
    first = {(r["site"], r["k"]): r["seq"] for r in spark.read.parquet(f"{base}/out/n=0").collect()}
    assert first[("x", 1)] == 5 and first[("y", 2)] == 3 and first[(None, 3)] == 1


def test_streamed_rewrite_counts_as_it_writes(spark):
    from sitewright.streaming import jobs

    base, listener = scratch_path(spark, "stats"), jobs.RewriteStats()
    rows = spark.range(40).selectExpr("id", "IF(id % 4 = 0, concat('https://old.com/', id), IF(id = 7, NULL, 'none')) AS v")
    rows.write.parquet(f"{base}/in")
    spark.streams.addListener(listener)
    try:
        done = jobs.stream_rewrite(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"), "v", {"https://old.com": "https://new.com"}, stats="pages")
        done.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        for _ in range(50):
            if listener.totals.get("pages", {}).get("n_processed") == 40:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert listener.totals["pages"] == {"n_processed": 40, "n_changed": 10}
    assert spark.read.parquet(f"{base}/out").where("v LIKE 'https://new.com/%'").count() == 10


def test_chunks_keep_any_bytes(spark):
    from sitewright.operators import rows

    df = spark.createDataFrame([(1, bytearray(range(256)) * 3), (2, bytearray(b"")), (3, bytearray(b"\xff\xfe\x00,"))], "k long, v binary")
    back = rows.assemble_chunks(rows.chunk_values(df, ["k"], "v", 100), ["k"])
    assert {r["k"]: bytes(r["value"]) for r in back.collect()} == {r["k"]: bytes(r["v"]) for r in df.collect()}


def test_dump_rejects_what_it_cannot_read(spark):
    from sitewright.sources.sql_dump import parse_statements

    read = lambda text, schema="a int, b string, c int": parse_statements(spark.createDataFrame([(t,) for t in text.split(";")], "value string"), "t", T._parse_datatype_string(schema)).collect()
    head = "INSERT INTO `t` (`a`, `b`, `c`) VALUES "
    assert [tuple(r) for r in read(head + "\n(1,FROM_BASE64('eA=='),-2),\n( 2 , '' ,NULL)\nON DUPLICATE KEY UPDATE `a` = `a`;\n-- note\n" + head + "(3,NULL,4)")] == [(1, "x", -2), (2, "", None), (3, None, 4)]
    assert read("INSERT INTO `u` (`a`) VALUES (what);DROP TABLE t;") == []
    assert [tuple(r) for r in read("INSERT INTO `t``s` (`a`) VALUES (9);INSERT INTO `t` (`b`, `a``x`) VALUES ('',1)", "a int, b string")] == [(None, "")]
    for bad in ("(1,'abc',2),(3,'x',4),(5,'y',6)", "(1,TRUE,2)", "(1,DEFAULT,2)", "(1,2)", "(1,'',2),(3,4)", "(1,'',2", "(1,'',2) SELECT 1", "(1,FROM_BASE64('e;A=='),2)", "(1,'a,b',2)", "()"):
        with pytest.raises(Exception, match="statement on t"):
            read(head + bad)


@pytest.fixture(scope="module")
def dump(spark):
    from sitewright.sources.sql_dump import write_sql_dump

    path = scratch_path(spark, "dump")
    rows = [(k, None if k % 5 == 0 else "té;xt" * (k % 40), bytearray([0, k % 256, 255]), k / 7, Decimal(k) / 4) for k in range(3000)]
    df = spark.createDataFrame(rows, "k long, t string, b binary, f double, d decimal(12,2)")
    write_sql_dump(df, "t", path, ["k"], max_rows=37, max_bytes=4000, partitions=2)
    return path, df


def test_dump_source_equals_native(spark, dump):
    """Whatever the ranges, each statement is read once."""
    from sitewright.sources import dump_source, sql_dump

    path, df = dump
    dump_source.register(spark)
    read = lambda **o: spark.read.format("sqldump").option("table", "t").options(**o)
    want = sorted(map(str, df.collect()))
    assert sorted(map(str, sql_dump.read_sql_dump(spark, path, "t", df.schema).collect())) == want
    for split in (1 << 30, 4000):
        got = read(splitBytes=split).schema(df.schema).load(path)
        assert sorted(map(str, got.collect())) == want
    assert got.rdd.getNumPartitions() > 20
    assert read().load(path).columns == df.columns and read().load(path).first()["k"].isdigit()
    narrow = read(splitBytes=5000).schema("f double, k long").load(path)
    assert sorted(map(tuple, narrow.collect())) == sorted((r.f, r.k) for r in df.collect())


def test_dump_source_names_the_byte(spark, tmp_path):
    from sitewright.sources import dump_source

    dump_source.register(spark)
    text = "INSERT INTO `t` (`a`, `b`) VALUES (1,2);\nINSERT INTO `t` (`a`, `b`) VALUES (1,'abc');\n"
    (tmp_path / "d.sql").write_text(text)
    with pytest.raises(Exception, match=f"malformed value at byte {text.index(chr(39))} of "):
        spark.read.format("sqldump").option("table", "t").schema("a int").load(str(tmp_path)).collect()


def test_tree_is_listed_by_levels(spark, tmp_path):
    """Files, empty and unreadable directories, links, cycles and followed directories."""
    from sitewright.sources.tree import list_tree

    root, away = tmp_path / "site", tmp_path / "away"
    for d in ("a/b/c", "empty", "node_modules/x", ".git/objects", "d"):
        (root / d).mkdir(parents=True)
    for d in ("real/deep", "hollow"):
        (away / d).mkdir(parents=True)
    for f in ("a/one", "a/b/c/two é", "top", "node_modules/x/y", ".git/objects/z", ".hidden"):
        (root / f).write_text(f)
    (away / "real/deep/file").write_text("12345")
    (root / "a/loop").symlink_to(root)  # a cycle
    (root / "d/file_link").symlink_to(root / "top")
    (root / "d/broken").symlink_to("nowhere")
    (away / "hop").symlink_to(away / "real")
    (root / "d/out").symlink_to(away / "hop" / "deep")  # by a link on the way
    (away / "real/deep/up").symlink_to(away)  # the followed directory leads to one above it, and that to the root's side
    (away / "back").symlink_to(root)
    rows = {r["path"]: r for r in list_tree(spark, f"file://{root}").collect()}
    inside = {p: (r["type"], r["size"]) for p, r in rows.items() if not p.startswith("/")}
    files = {f: ("file", len(f.encode())) for f in ("a/one", "a/b/c/two é", "top", ".hidden", "node_modules/x/y")}
    assert {p: v for p, v in inside.items() if v[0] == "file"} == files
    assert {p for p, v in inside.items() if v[0] == "link"} == {"a/loop", "d/file_link", "d/broken", "d/out"} and inside["empty"] == ("dir", 0) and rows["empty"]["empty"]
    assert {p for p, v in inside.items() if v[0] == "dir"} == {"empty"}
    assert rows["a/loop"]["target"] == str(root) and rows["d/broken"]["target"] is None and rows["d/out"]["target"] == str(away / "real/deep")
    outside = {p: (r["type"], r["intermediate"]) for p, r in rows.items() if p.startswith("/")}
    assert outside == {str(away / "hop"): ("link", False), str(away / "real/deep/file"): ("file", False), str(away / "real/deep/up"): ("link", False), str(away / "hollow"): ("dir", False), str(away / "back"): ("link", False)}
    alone = {r["path"]: r["intermediate"] for r in list_tree(spark, str(root), follow=False).collect()}
    assert set(alone) == set(inside) | {str(away / "hop")} and alone[str(away / "hop")]


def test_tree_many_directories(spark, tmp_path):
    from sitewright.sources.tree import list_tree

    for k in range(400):
        folder = tmp_path / f"d{k % 20}" / f"e{k}"
        folder.mkdir(parents=True)
        for j in range(k % 5):
            (folder / f"f{j}").touch()
    got = list_tree(spark, str(tmp_path)).groupBy("type").count().collect()
    assert {r["type"]: r["count"] for r in got} == {"file": sum(k % 5 for k in range(400)), "dir": 80}


def test_jdbc_ranges(spark):
    """Over an embedded database: skewed, composite and text keys in ranges that hold about as many rows, each row once."""
    from sitewright.operators import rows

    url = "jdbc:derby:memory:ranges;create=true"
    df = spark.range(4000).selectExpr("CASE WHEN id % 10 < 7 THEN 5 ELSE CAST(id * id % 100000 AS INT) END AS A", "CAST(id AS INT) AS B", "concat('k', id * 7919 % 4000) AS C", "CAST(id AS DOUBLE) / 3 AS D")
    df.write.option("createTableColumnTypes", "C VARCHAR(20)").jdbc(url, "KEYED", mode="overwrite")
    for keys in (["B"], ["A", "B"], ["C"], ["A", "C"]):
        got = rows.scan_table(spark, "KEYED", {"b": F.col("B"), "c": F.col("C")}, jdbc={"url": url}, keys=keys, partitions=8)
        sizes = [r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert sum(sizes) == 4000 and got.distinct().count() == 4000
        assert 6 <= len(sizes) and max(sizes) <= 2 * 4000 / 8, (keys, sizes)
    assert rows.scan_table(spark, "KEYED", jdbc={"url": url}).rdd.getNumPartitions() == 1


def test_range_predicates_hold_each_row_once(spark):
    from sitewright.operators import rows

    df = spark.createDataFrame([(a, b) for a in (None, 1, 1, 2, 3) for b in (None, "x", "o'k", "z")] * 3, "a int, b string")
    for points in ([], [(1,)], [(1, "o'k"), (1, "z"), (1,), (2, "x")]):
        tests = rows.range_predicates(points, ["a", "b"])
        hits = sum(F.coalesce(F.expr(t).cast("int"), F.lit(0)) for t in tests)
        assert [tuple(r) for r in df.select(hits).distinct().collect()] == [(1,)]
    assert rows.split_points(df.limit(0), ["a"], 4) == [] and rows.split_points(df, ["a", "b"], 1) == []

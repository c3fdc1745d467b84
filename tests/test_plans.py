"""Patch planning and snapshot maintenance on small golden trees and random ones."""

from __future__ import annotations

import random

import pytest

from sitewright.operators import diff, index
from sitewright.operators import rows as rows_of
from sitewright.plans import patch

SCHEMA = "path string, ctime long, size long, type string"


def tree(spark, *rows):
    return spark.createDataFrame([(p, c, s, t) for p, c, s, t in rows], SCHEMA)


def ops(plan):
    return {r["path"]: r["op"] for r in plan.collect()}


def test_diff_transitions(spark):
    old = tree(spark, ("b-deleted", 1, 1, "file"), ("c", 1, 1, "file"), ("d", 1, 10, "file"), ("e", 10, 1, "file"), ("f", 1, 1, "file"))
    new = tree(spark, ("a-added", 1, 1, "file"), ("c", 1, 1, "dir"), ("d", 1, 20, "file"), ("e", 20, 1, "file"), ("f", 1, 1, "file"))
    got = {r["path"]: r["change"] for r in diff.diff_index(old, new).collect()}
    assert got == {"a-added": "added", "b-deleted": "deleted", "c": "modified", "d": "modified", "e": "modified", "f": "unchanged"}


def test_five_operations(spark):
    base = tree(spark, ("b", 1, 1, "file"), ("c", 1, 0, "dir"), ("d", 1, 1, "file"), ("e", 1, 1, "file"), ("f", 1, 1, "file"))
    head = tree(spark, ("a", 1, 1, "file"), ("c", 1, 1, "file"), ("d", 1, 0, "dir"), ("e", 2, 1, "file"), ("f", 1, 1, "file"))
    assert ops(patch.plan_patch(base, head)) == {"a": "copy", "b": "delete", "c": "replace", "d": "replace", "e": "copy"}


def test_vanished_directory_goes_as_one(spark):
    base = tree(spark, ("gone/child.txt", 1, 1, "file"), ("gone/nested/leaf.txt", 1, 1, "file"), ("stays.txt", 1, 1, "file"))
    head = tree(spark, ("stays.txt", 1, 1, "file"))
    assert ops(patch.plan_patch(base, head)) == {"gone": "delete"}


def test_directory_replaced_by_file(spark):
    base = tree(spark, ("tree/a", 1, 1, "file"), ("tree/b/c", 1, 1, "file"))
    assert ops(patch.plan_patch(base, tree(spark, ("tree", 1, 5, "file")))) == {"tree": "replace"}


def test_selection_limits_both_operations(spark):
    base = tree(spark, ("in/old", 1, 1, "file"), ("out/old", 1, 1, "file"), ("in/kept/x", 1, 1, "file"))
    head = tree(spark, ("in/new", 1, 1, "file"), ("out/new", 1, 1, "file"))
    assert ops(patch.plan_patch(base, head, ["in"], ["in/kept"])) == {"in/old": "delete", "in/new": "copy"}


def random_tree(spark, rng):
    names, rows = "ab", {}
    for _ in range(rng.randint(0, 6)):
        p = "/".join(rng.choice(names) for _ in range(rng.randint(1, 3)))
        if not any(q == p or q.startswith(p + "/") or p.startswith(q + "/") for q in rows):
            rows[p] = (p, rng.randint(1, 2), 1, rng.choice(("file", "file", "dir", "link")))
    return list(rows.values())


def test_plan_turns_base_into_head(spark):
    rng = random.Random(5)
    bases, heads = [], []
    for k in range(60):  # many trees in one snapshot, each below a directory that both keep
        keep = (f"t{k}/keep", 1, 1, "file")
        bases += [keep, *((f"t{k}/{p}", *r) for p, *r in random_tree(spark, rng))]
        heads += [keep, *((f"t{k}/{p}", *r) for p, *r in random_tree(spark, rng))]
    base, head = tree(spark, *bases), tree(spark, *heads)
    plan = patch.plan_patch(base, head)
    after = {r["path"]: tuple(r) for r in patch.apply_plan(base, plan).select("path", "ctime", "size", "type").collect()}
    want = {r[0]: r for r in heads}
    # An empty directory of the base that the head only implies loses its row in the end.
    extra = {p for p in after if p not in want}
    assert all(any(q.startswith(p + "/") for q in want) for p in extra)
    assert {p: v for p, v in after.items() if p in want} == {p: want[p] for p in want}


def test_required_copies(spark):
    base, head = tree(spark, ("a", 1, 1, "file"), ("x", 1, 1, "file")), tree(spark, ("a", 1, 1, "file"), ("b", 1, 1, "file"))
    plan = patch.plan_patch(base, head)
    listed = spark.createDataFrame([("a",), ("x",)], "path string")
    assert ops(patch.require_copies(plan, base, head, listed)) == {"a": "copy", "b": "copy", "x": "delete"}
    with pytest.raises(Exception, match="neither snapshot"):
        patch.require_copies(plan, base, head, spark.createDataFrame([("nowhere",)], "path string")).collect()
    with pytest.raises(ValueError, match="unknown mode"):
        patch.plan_sync("other", base, head, head)


def test_mutations(spark):
    start = tree(spark, ("tree/child", 1, 1, "file"), ("tree/old", 1, 1, "file"), ("tree-other", 1, 1, "file"))
    muts = spark.createDataFrame([(1, "-", "tree", None, None, None), (2, "+", "tree/child", 9, 9, "file")], "seq long, op string, path string, ctime long, size long, type string")
    got = {r["path"]: r["size"] for r in index.apply_mutations(start, muts).collect()}
    assert got == {"tree/child": 9, "tree-other": 1}


def test_log_replay_is_idempotent(spark):
    start = tree(spark, ("a", 1, 1, "file"), ("b", 1, 1, "file"))
    log = spark.createDataFrame([(1, "+", "a", 2, 2, "file"), (2, "-", "b", None, None, None), (3, "-", "nowhere", None, None, None), (4, "+", "a", 3, 3, "file")], "seq long, op string, path string, ctime long, size long, type string")
    once = index.apply_wal(start, log)
    twice = index.apply_wal(once, log)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", 3, 3, "file")]


def test_collisions_and_merge(spark):
    mapped = spark.createDataFrame([("a", False), ("a", False), ("l", True), ("l/x", False), ("f", False), ("f/x", False)], "local string, intermediate boolean")
    assert sorted(map(tuple, index.collisions(mapped).collect())) == [("a", "same"), ("f/x", "below")]
    with pytest.raises(ValueError, match="collide"):
        index.assert_no_collisions(mapped)
    source = spark.createDataFrame([("plugins/p/a",), ("plugins/q/a",), ("uploads/1",), ("uploads/2",), ("top/x",)], "path string")
    dest = spark.createDataFrame([("plugins/p/b",), ("uploads/1",), ("top/y",)], "path string")
    assert sorted(r["path"] for r in index.merge_no_overwrite(source, dest).collect()) == ["plugins/p/b", "plugins/q/a", "top/y", "uploads/1", "uploads/2"]


def test_sort_dedup_drops_null_keys(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("b", 2), ("a", 9), (None, 1), ("b", 1)], "k string, t long")
    assert [tuple(r) for r in index.sort_dedup(rows, F.col("k"), F.col("t")).collect()] == [("a", 9), ("b", 1)]


@pytest.mark.parametrize("few", [50_000, 2, 0])
def test_below_any_by_size(spark, monkeypatch, few):
    """Roots that are broadcast, found among ancestors first, or joined in parts: the same rows."""
    from sitewright.operators import tree as t

    monkeypatch.setattr(t, "BROADCAST_ROOTS", few)
    paths = [f"all/d{k % 5}/e{k % 7}/f{k}" for k in range(300)] + ["all", "all/d1", "other"]
    roots = ["all/d1", "all/d2/e3", "all/d1/e1", "nowhere", None, "all/d4/e4/f4", *(f"x{k}" for k in range(50))]
    df, wanted = spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(r,) for r in roots], "path string")
    for proper in (False, True):
        got = sorted(r["path"] for r in t.below_any(df, wanted, proper).collect())
        assert got == sorted(p for p in paths if any(r and (p.startswith(r + "/") or (p == r and not proper)) for r in roots))


def test_a_snapshot_under_one_root_is_no_task(spark):
    """All rows below one mutated root: no exploded row shuffles by its ancestor."""
    start = spark.range(5000).selectExpr("concat('root/d', id % 3, '/f', id) AS path", "id AS ctime", "id AS size", "'file' AS type")
    muts = tree(spark, ("root/d1", 1, 1, "file")).selectExpr("0L AS seq", "'-' AS op", "path", "ctime", "size", "type")
    done = index.apply_mutations(start, muts)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(path" not in plan.split("Generate")[-1].split("Union")[0] or "BroadcastHashJoin" in plan
    assert done.count() == sum(k % 3 != 1 for k in range(5000))


def test_many_mutations_are_not_broadcast(spark, monkeypatch):
    """More roots than may be broadcast, in files under the optimizer's limit: no join broadcasts them."""
    from sitewright.operators import tree as t

    monkeypatch.setattr(t, "BROADCAST_ROOTS", 10)
    start = spark.range(3000).selectExpr("concat('root/d', id % 3, '/f', id) AS path", "id AS ctime", "id AS size", "'file' AS type")
    some = spark.range(0, 3000, 3).where("id % 2 = 0").selectExpr("id AS seq", "if(id % 4 = 0, '-', '+') AS op", "concat('root/d0/f', id) AS path", "id AS ctime", "id + 7 AS size", "'file' AS type")
    muts = some.union(spark.sql("SELECT 3000L, '-', 'root/d1', NULL, NULL, NULL"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")  # any broadcast is an error
    try:
        done = {r["path"]: r["size"] for r in index.apply_mutations(start, muts).collect()}
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    stays = {f"root/d{k % 3}/f{k}": k for k in range(3000) if k % 3 == 2 or k % 6 == 3}
    assert done == stays | {f"root/d0/f{k}": k + 7 for k in range(0, 3000, 6) if k % 4}


def test_what_goes_is_not_broadcast(spark):
    """One root takes the whole index along: that is not broadcast, however small the index's files."""
    start = spark.range(5000).selectExpr("concat('root/d', id % 3, '/f', id) AS path", "id AS size")
    muts = spark.sql("SELECT '-' AS op, 'root' AS path, 0L AS size").union(spark.sql("SELECT '+', 'new', 7L"))
    done = index.apply_mutations(start, muts)
    assert [tuple(r) for r in done.collect()] == [("new", 7)]
    joins = [line for line in done._jdf.queryExecution().executedPlan().toString().splitlines() if "LeftAnti" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_changes_of_one_cell(spark):
    """Two changes of a cell make no rows; the one whose old value stands is applied."""
    from sitewright.operators import changes

    now = spark.createDataFrame([(1, "b", "x"), (2, None, "y"), (3, "c", "z")], "k long, v string, w string")
    what = spark.createDataFrame([(1, "v", "a", "n1"), (1, "v", "b", "n2"), (1, "v", "b", "n3"), (2, "v", None, "n4"), (2, "w", "y", "n5"), (3, "v", "other", "n6"), (9, "v", "c", "n7")], "k long, column string, old string, new string")
    assert sorted(map(tuple, changes.apply_changes(now, ["k"], what).collect())) == [(1, "n2", "x"), (2, "n4", "n5"), (3, "c", "z")]


def loop_batches(sizes, max_rows, max_bytes):
    batch, rows, total, out = 0, 0, 0, []
    for size in sizes:
        if rows and (rows >= max_rows or total + size > max_bytes):
            batch, rows, total = batch + 1, 0, 0
        rows, total = rows + 1, total + size
        out.append(batch)
    return out


@pytest.mark.parametrize(("max_rows", "max_bytes", "fan"), [(7, 900, 2), (1 << 40, 5000, 3), (100, 1 << 40, 64), (1, 1, 2), (60, 20_000, 2)])
def test_batches_of_one_hot_group_equal_the_loop(spark, max_rows, max_bytes, fan):
    """One group over many small ranges, some of them smaller than a batch, beside a few small groups."""
    rng = random.Random(4)
    rows = [("hot", k, None if k % 50 == 0 else rng.choice([0, 10, 300, 1200])) for k in range(2000)] + [(g, k, 400) for g in (None, "", "é") for k in range(5)]
    df = spark.createDataFrame(rows, "g string, k long, size long").repartition(5)
    want = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        want |= {(g, k): b for (_, k, _), b in zip(own, loop_batches([s or 0 for _, _, s in own], max_rows, max_bytes), strict=True)}
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that ranges stay small
        got = rows_of.pack_batches(df, "g", ["k"], "size", max_rows, max_bytes, fan).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert {(r["g"], r["k"]): r["batch"] for r in got} == want and len(got) == len(rows)


def test_batches_odd(spark):
    df = spark.createDataFrame([(1, 1, None, "a"), (1, 1, None, "b"), (1, 2, 5, "a")], "g int, k int, size int, batch_name string")
    assert sorted((r["k"], r["batch_name"], r["batch"]) for r in rows_of.pack_batches(df, "g", ["k"], "size", 2, 100).collect()) == [(1, "a", 0), (1, "b", 0), (2, "a", 1)]
    assert rows_of.pack_batches(df.limit(0), "g", ["k"], "size", 2, 100).count() == 0


def test_longest_prefix_of_many(spark, monkeypatch):
    """One root over all paths and very many prefixes, broadcast or not."""
    from sitewright.operators import index, tree

    mapping = spark.range(3000).selectExpr("concat('r/d', id) AS prefix", "concat('t', id) AS target").union(spark.createDataFrame([("r", "root"), ("r/d1/x", "deep"), ("r/d1", "z"), (None, "n"), ("", "e")], "prefix string, target string"))
    paths = spark.range(6000).selectExpr("concat('r/d', id, '/x/', id % 7) AS path").union(spark.createDataFrame([("r",), ("rr/d1",), ("r/d1/x",), ("r/d10x",), (None,)], "path string"))

    def plain(p):
        best = {"r/d1/x": "deep", "r": "root"}
        parts = [] if p is None else p.split("/")
        for k in range(len(parts), 0, -1):
            head = "/".join(parts[:k])
            target = best.get(head) or (f"t{head[3:]}" if head.startswith("r/d") and head[3:].isdigit() and int(head[3:]) < 3000 else None)
            if target:
                return target + p[len(head) :]
        return None if p is None else "root2/" + p

    want = sorted(((r[0], plain(r[0])) for r in paths.collect()), key=str)
    for few in (50_000, 10):
        monkeypatch.setattr(tree, "BROADCAST_ROOTS", few)
        got = index.map_paths(paths, mapping, "root2")
        assert sorted(((r["path"], r["local"]) for r in got.select("path", "local").collect()), key=str) == want


def test_map_urls_by_host(spark):
    from sitewright.functions.rewrite import map_urls

    mapping = spark.createDataFrame([("Old.example", "https://new.test"), ("old.example/Media", "https://cdn.test/m"), ("old.example:8080", "https://port.test")], "source string, target string")
    cases = {
        "https://OLD.example/a": "https://new.test/a", "https://u@old.example/a": "https://new.test/a", "http://u:p@OLD.EXAMPLE/Media/x?q=A@b/c": "https://cdn.test/m/x?q=A@b/c",
        "https://old.example/media/x": "https://new.test/media/x", "//old.example": "https://new.test", "https://old.example.org/a": "https://old.example.org/a", "https://old.example:8080/a": "https://port.test/a",
        "https://x.test/@old.example/a": "https://x.test/@old.example/a", "https://old.example?u=1": "https://new.test?u=1", "": "", None: None,
    }
    got = map_urls(spark.createDataFrame([(u,) for u in cases], "url string"), mapping).collect()
    assert {r["url"]: r["mapped"] for r in got} == cases

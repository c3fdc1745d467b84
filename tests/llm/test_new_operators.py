"""Conversation repair, the Merkle manifest and exact dedup against plain versions."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sitewright.llm import conversation_repair as repair
from sitewright.llm import exact_dedup, queries
from tests.oracle import assert_same

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()


# 11: conversation repair


def cheapest(initials, faults):
    """The cheapest edits by a search over all of them, in order of cost and then of their letters."""
    form, heap, seen = re.compile(r"s?(ua)*u?"), [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        if at == len(initials) and re.fullmatch(r"(s?(ua)+)?", out):
            return cost, audit, out
        if (at, out, audit) in seen:
            continue
        seen.add((at, out, audit))
        moves = [(5, "I", at, out + c) for c in "ua"] if len(out) < len(initials) + 3 else []
        if at < len(initials):
            late = 5 * (faults[at] == 3)
            moves.append((2, "D", at + 1, out))
            if faults[at] not in (1, 2):
                moves.append((late, "K", at + 1, out + (initials[at] or "?")))
                moves += [(1 + late, "R", at + 1, out + c) for c in "ua"]
        for fee, letter, to, now in moves:
            if form.fullmatch(now):
                heapq.heappush(heap, (cost + fee, audit + letter, to, now))
    raise AssertionError


def plain_report(rows):
    """Of rows (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    cost, audit, out = cheapest([r[1][:1] for r in rows], faults)
    said, at, k = [], 0, 0
    for letter in audit:
        if letter == "I":
            said.append({"u": "user:", "a": "assistant:"}[out[k]])
        else:
            _, role, text = rows[at]
            at += 1
            if letter != "D":
                said.append(f"{role if letter == 'K' else {'u': 'user', 'a': 'assistant'}[out[k]]}:{text}")
        k += letter != "D"
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, sha("\n".join(said))


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def test_repair_query_equals_plain(spark, sf_dir):
    convs = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        code = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", r.text) if code == 2 else r.text
        convs[r.conv_id] += [(r.turn, "user" if code == 4 else r.role, text)] * {0: 0, 3: 2}.get(code, 1)
    got = {r[0]: tuple(r)[1:] for r in queries.op11_repair(spark, sf_dir).collect()}
    assert got == {k: plain_report(in_order(rows)) if rows else (0, 0, 0, 0, 0, 0, "", sha("")) for k, rows in convs.items()}


def test_repair_random_conversations_equal_plain(spark):
    rng, rows = random.Random(11), []
    for conv in range(300):
        for _ in range(rng.randint(1, 6)):
            rows.append((conv, rng.choice([None, *range(5)]), rng.choice(["user", "assistant", "system", "tool", "", "agent"]), rng.choice(["Yes.", "No.", "cut", " \n", "", "So?"])))
    convs = defaultdict(list)
    for c, *r in rows:
        convs[c].append(tuple(r))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r[0]: tuple(r)[1:] for r in repair.report(df).collect()}
    assert got == {c: plain_report(in_order(r)) for c, r in convs.items()}


def test_repair_rows_are_the_repaired_conversation(spark):
    df = spark.createDataFrame([("x", 0, "system", "Be kind.", 1), ("x", 1, "assistant", "Hi.", 1), ("x", 2, "user", "no end", 1), ("x", 2, "user", "no end", 1)], "id string, t int, who string, said string, fault int")
    got = repair.repair(df, id_col="id", turn_col="t", role_col="who", text_col="said").orderBy("place").collect()
    assert [(r.conv_id, r.edit, r.role, r.text, r.turn, r.fault) for r in got] == [
        ("x", "R", "user", "Be kind.", 0, None), ("x", "K", "assistant", "Hi.", 1, None), ("x", "D", "user", "no end", 2, "truncated"), ("x", "D", "user", "no end", 2, "duplicate"),
    ]
    assert cheapest(["s", "a", "u", "u"], [0, 0, 3, 2])[:2] == (5, "RKDD")


def test_repair_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, fault int, nth string, id string"
    rows = [(None, 0, "user", "Hi.", 1, "", "q"), (None, 1, None, None, 1, "", "q"), (1 << 60 | 1, None, "user", "A" * 200_000 + ".", 1, "", "q"), (1 << 60 | 1, 1 << 59, "assistant", "Ok!", 1, "", "q")]
    df = spark.createDataFrame(rows, schema)
    got = {r[0]: tuple(r)[1:] for r in repair.report(df).collect()}
    assert got == {None: plain_report([(0, "user", "Hi."), (1, " ", " ")]), 1 << 60 | 1: plain_report([(None, "user", "A" * 200_000 + "."), (1 << 59, "assistant", "Ok!")])}
    assert repair.report(spark.createDataFrame([], schema)).count() == 0 and repair.repair(spark.createDataFrame([], schema)).count() == 0


def test_repair_spills_alike():
    """A giant conversation in files of the task gives what one in memory does."""
    rng = random.Random(3)
    rows = [(k, rng.choice(["user", "assistant", "system"]), f"{rng.random()}" + rng.choice([".", ""]), rng.choice([0, 0, 0, 1, 2, 3])) for k in range(5000)]
    told = []
    for limits in ((1 << 20, 1 << 23), (1001, 5000)):
        conv = repair.Conversation("c", *limits)
        for r in rows:
            conv.add(*r)
        assert (conv.pointers.file is not None) == (limits[0] == 1001)
        told.append((list(conv.edits()), conv.cost))
    assert told[0] == told[1]


def test_repair_state_is_finite():
    repair.step.cache_clear()
    rng, state = random.Random(5), ((0, 0), None, None, None)
    for _ in range(200_000):
        state, _, _ = repair.step(state, rng.choice("suax"), rng.choice([0, 1, 3]))
    assert repair.step.cache_info().currsize < 20_000


# 12: Merkle manifest


def climb(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def plain_manifest(rows):
    """Of rows (doc_id, source, lang, n_chars, text)."""
    mark = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(mark, r)))
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    trees, names = {}, sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = climb([leaf(r) for r in groups[g]])
    top, out = climb([trees[g][-1][0] for g in names]), []
    for at, g in enumerate(names):
        for k, r in enumerate(groups[g]):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            node = leaf((*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4]))) if changed else leaf(r)
            proof = ""
            for levels, i in ((trees[g], k), (top, at)):
                for level in levels[:-1]:
                    low = i // 8 * 8
                    left, right = "".join(level[low:i]), "".join(level[i + 1 : low + 8])
                    proof, node, i = proof + left + right, sha(left + node + right), i // 8
            out.append((r[0], trees[g][0][k], trees[g][-1][0], top[-1][0], sha(proof), node, node == top[-1][0]))
    return sorted(out, key=str)


def manifest(spark, path, **options):
    return sorted(map(tuple, queries.op12_merkle(spark, str(path), **options).collect()), key=str)


def test_merkle_query_equals_plain(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = manifest(spark, sf_dir)
    assert got == plain_manifest(rows) and {r[-1] for r in got} == {True, False}


DOCS = "doc_id long, source string, lang string, n_chars long, text string, pos int, grp string, node string"


def test_merkle_tiers_and_odd_rows(spark, tmp_path):
    """Small blocks, so that groups of some hundred rows and the groups themselves take several tiers."""
    rows = [(k if k % 50 else None, "s", ["en", None, "", f"g{k % 300}"][k % 4 if k > 700 else 0], k, None if k % 7 == 0 else "" if k % 11 == 0 else f"Text {k}") for k in range(1500)]
    rows += [rows[5]] * 3 + [(1 << 60 | 1, None, "é", None, "A" * 100_000), (9, "s", "en", None, "Other")]
    path = tmp_path / "documents.parquet"
    spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DOCS).write.parquet(str(path))
    for levels in (1, 2):
        assert manifest(spark, tmp_path, levels=levels) == plain_manifest(rows)


@pytest.mark.parametrize("n", [0, 1])
def test_merkle_few_rows(spark, tmp_path, n):
    rows = [(5, "s", None, 3, "Abc")] * n
    spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert manifest(spark, tmp_path) == plain_manifest(rows)


# 13: exact dedup


def plain_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[WHITE.sub("", t or "")].append((i, t or ""))
    out = []
    for norm, found in groups.items():
        found.sort(key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        out += [(i, found[0][0], len(found), k == 0, sha(norm)) for k, (i, _) in enumerate(found)]
    return sorted(out, key=str)


ODD = [(1, "a b"), (2, "ab"), (3, " a\tb\r\n"), (4, None), (5, ""), (6, " \v\f"), (None, "ab "), (None, None), (7, "a\xa0b"), (8, "x" * 300_000), (9, "x " * 300_000), (10, "same"), (10, "same"), (11, "\x1cab")]


def test_dedup_odd_rows(spark):
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in ODD], "doc_id long, text string, rid int, key string")
    got = exact_dedup.exact_duplicates(df)
    assert sorted(map(tuple, got.collect()), key=str) == plain_dedup(ODD)
    left = exact_dedup.drop_copies(df)
    assert left.columns == df.columns and sorted((r[0] for r in left.collect()), key=str) == sorted((r[0] for r in plain_dedup(ODD) if r[3]), key=str)
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0 and exact_dedup.drop_copies(df.limit(0)).count() == 0


def test_dedup_hot_text(spark):
    """A text of most rows moves as one row a task."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("one text"), F.repeat(F.lit(" "), (F.col("id") % 5).cast("int")))).otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_duplicates(df)
    assert got.where("kept").count() == 6_668 and got.where("group_size > 1").select("keep_id").distinct().collect() == [(4,)]


def test_dedup_buckets_split_and_hold_all(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 4000).cast("string").alias("text"))
    rows = exact_dedup.fingerprinted(df)
    index = exact_dedup.build(df, rows, capacity=100)
    sizes = index.entries.groupBy("bucket", "depth").agg(F.count("*").alias("n"), F.sum("n").alias("rows"), F.min("key").alias("low")).collect()
    assert sum(r.n for r in sizes) == 4000 and sum(r.rows for r in sizes) == 5000 and max(r.n for r in sizes) <= 100 and len(sizes) > 40
    for r in sizes:  # a bucket's parent is overfull: shallower buckets would not hold
        assert sum(s.n for s in sizes if s.depth >= r.depth and s.bucket >> (s.depth - r.depth + 1) == r.bucket >> 1) > 100
    assert {r.bucket for r in sizes if r.depth == 6} <= {(r.low & (1 << 64) - 1) >> 58 for r in sizes if r.depth == 6}


def test_dedup_collisions_chain(spark, monkeypatch):
    """With a key of few values, texts of one key are told apart by their bytes."""
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(3)) if isinstance(c[0], str) and c[0] == "norm" else real(*c))
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.exact_duplicates(df).collect()), key=str) == plain_dedup(ODD)
    rows = exact_dedup.fingerprinted(df)
    chains = exact_dedup.build(df, rows).entries.groupBy("key").agg(F.max("chain").alias("last"), F.count("*").alias("n")).collect()
    assert all(r.last == r.n for r in chains) and len(chains) <= 3


def test_dedup_sql(spark, sf_dir):
    assert_same(spark, queries.queries()["op13_exact"], queries.OP13_SQL, sf_dir)


# 9: secret scans


def test_long_addresses_hold_what_is_in_them():
    """However far into an address a run lies; beyond the address it counts."""
    import public_tokenizers

    from sitewright.llm import secret_scan

    ranks, key = public_tokenizers.path("byte_bpe_50k.tiktoken"), "q7Zk2xW9vB4nT8rLp3Ym6Jd"
    url = "https://h.example/" + "path.to/" * 3000
    spans = secret_scan.spans_of(f"see {url}{key} and {key}, {'a.b/' * 3000}{key}", ranks)
    text = f"see {url}{key} and {key}, "
    assert (text.rindex(key), 3, text.rindex(key) + len(key)) in spans and not any(a < len("see ") + len(url) + 5 for a, _, _ in spans)

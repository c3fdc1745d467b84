"""Approximate nearest neighbours over learned partitions.

The number of parts grows with the table, a part for PART_ROWS rows up to MOST_PARTS. On a
bounded sample of SAMPLE_A_PART vectors a part (picked by a hash) the exact neighbour graph is
built and cut into balanced parts: begun from nearby centres under a size limit, then each
vector moves to the part that holds most of its neighbours while that part has room. A small
classifier (one hidden layer) learns the parts and sends every row of the table to its most
probable one, which indexes it. A second one learns in which parts a vector's neighbours
lie, and sends a query to as many of its most probable parts as make up a share of the
probability: the least share at which vectors held out of the fit find HELD_RECALL of their
true neighbours. What those parts hold is ranked by exact distance.

The index holds every row. Parts are dealt to tasks in blocks of BLOCK rows, so a hot part
(or one vector that very many rows share) is many blocks, and each block returns k rows a
query. Results by case: vectors that are null, zero, or hold null or non-finite components
take no part; vectors of another length than most are a part for each length, so they meet
their like; components of any finite size are ranked right; null ids take no part; an id on
several rows is searched once (its least vector) and found on each row but the query's own id;
an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.shared import materialize

#: Rows of a part (about), parts at most, sampled rows a part and at least, neighbours in their graph.
PART_ROWS, MOST_PARTS, SAMPLE_A_PART, SAMPLE_LEAST, GRAPH_K = 200, 256, 64, 6_000, 12
#: Components beyond which a vector is left out of the sample (not of the index).
SAMPLED_UP_TO = 1e100
#: Recall that held-out vectors must reach, and the part of the sample that is held out.
HELD_RECALL, HELD_SHARE = 0.95, 0.2
#: Candidates and queries of one block.
BLOCK, QUERY_BLOCK = 8_192, 16_384


def valid(vector: Column) -> Column:
    """Whether a vector takes part in a search."""
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def neighbour_graph(x: np.ndarray, among: np.ndarray, k: int, own: bool) -> np.ndarray:
    """The places in ``among`` of each row's k nearest; ``own`` leaves out the row itself."""
    k = min(k, len(among) - own)
    graph, square = np.empty((len(x), k), dtype=np.int64), (among**2).sum(1)
    for at in range(0, len(x), 1024):
        d = square[None] - 2 * x[at : at + 1024] @ among.T
        if own:
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        graph[at : at + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return graph


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """A part for each vector: a balanced cut of their neighbour graph."""
    n, rng = len(x), np.random.default_rng(seed)
    room = int(np.ceil(1.1 * n / parts))
    centres = x[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, dtype=np.int64)
    for _ in range(12):
        d = (centres**2).sum(1)[None] - 2 * x @ centres.T
        order, size = np.argsort(d.min(1) - np.partition(d, 1, axis=1)[:, 1]), np.zeros(parts, dtype=np.int64)
        near = np.argsort(d, axis=1)
        for v in order:  # the clearest cases choose first
            p = next(p for p in near[v] if size[p] < room)
            part[v], size[p] = p, size[p] + 1
        for p in range(parts):
            if size[p]:
                centres[p] = x[part == p].mean(0)
    size = np.bincount(part, minlength=parts)
    for _ in range(10):
        moved = 0
        for v in rng.permutation(n):
            votes = np.bincount(part[graph[v]], minlength=parts)
            votes[size >= room] = 0
            p = int(votes.argmax())
            if votes[p] > (part[graph[v]] == part[v]).sum():
                size[part[v]] -= 1
                size[p] += 1
                part[v] = p
                moved += 1
        if moved < n // 200:
            break
    return part


@dataclass
class Router:
    """A classifier of one hidden layer over standardised vectors."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(np.clip((x - self.mean) * self.scale, -1e6, 1e6) @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train_router(x: np.ndarray, target: np.ndarray, hidden: int = 128, rounds: int = 40, seed: int = 7) -> Router:
    """Fit by Adam on cross-entropy against rows of part shares, with noise against over-fitting."""
    rng, dim, parts = np.random.default_rng(seed), x.shape[1], target.shape[1]
    mean, scale = x.mean(0), float(1 / max(x.std(), 1e-12))
    z = (x - mean) * scale
    w = [rng.normal(0, np.sqrt(2 / dim), (dim, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for r in range(rounds):
        order = rng.permutation(len(z))
        for at in range(0, len(z), 256):
            rows = order[at : at + 256]
            a = z[rows] + rng.normal(0, 0.1, (len(rows), dim))
            h = np.maximum(a @ w[0] + w[1], 0)
            p = h @ w[2] + w[3]
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p = (p - target[rows]) / len(rows)
            back = (p @ w[2].T) * (h > 0)
            grads = [a.T @ back + 1e-4 * w[0], back.sum(0), h.T @ p + 1e-4 * w[2], p.sum(0)]
            step += 1
            rate = 3e-3 * (1 - r / rounds) + 1e-4
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Router(mean, scale, *w)


@dataclass
class Partitions:
    """Routers of rows and of queries, and the probability that a query's parts make up."""

    index: Router
    query: Router
    mass: float

    def probes(self, x: np.ndarray) -> list[np.ndarray]:
        return probed(self.query.probabilities(x), self.mass)


def probed(p: np.ndarray, mass: float) -> list[np.ndarray]:
    """Each row's most probable parts, up to the mass."""
    order = np.argsort(-p, axis=1, kind="stable")
    reached = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
    n = np.minimum((reached < mass).sum(1) + 1, p.shape[1])
    return [o[:k] for o, k in zip(order, n, strict=True)]


def learn(x: np.ndarray, parts: int) -> Partitions:
    """Parts, routers and the probed mass from a sample in random order."""
    held = int(len(x) * HELD_SHARE)
    held, fit = x[:held], x[held:]
    graph = neighbour_graph(fit, fit, GRAPH_K, own=True)
    index = train_router(fit, np.eye(parts)[balanced_parts(fit, graph, parts)])
    part = index.probabilities(fit).argmax(1)
    shares = lambda g: np.eye(parts)[part[g]].mean(1)
    query = train_router(fit, shares(graph))
    truth, p = part[neighbour_graph(held, fit, 10, own=False)], query.probabilities(held)
    for mass in (*np.arange(0.8, 0.99, 0.01).round(2).tolist(), 0.99, 0.995, 0.999):
        if np.mean([np.isin(t, own).mean() for t, own in zip(truth, probed(p, mass), strict=True)]) >= HELD_RECALL:
            return Partitions(index, query, mass)
    return Partitions(index, query, 1.0)


def matrix(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1)


def distances(found: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances; where squares leave the range of doubles, of scaled differences."""
    with np.errstate(over="ignore", under="ignore"):
        apart = found - q
        plain = np.sqrt((apart**2).sum(1))
        largest = np.abs(apart).max(1)
        odd = (largest > 0) & ~((plain > 1e-140) & np.isfinite(plain))
        if odd.any():
            plain[odd] = largest[odd] * np.sqrt(((apart[odd] / largest[odd, None]) ** 2).sum(1))
    return plain


def nearest(queries: np.ndarray, query_ids: np.ndarray, found: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: the places and distances of its k nearest rows with another id."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        square = (found**2).sum(1)
        plain = square < 1e300  # the others are measured one by one
        for at in range(0, len(queries), 128):
            q = queries[at : at + 128]
            own = (q**2).sum(1)
            rough = own[:, None] + square[None] - 2 * q @ found.T
            slack = 1e-9 * (own + square[plain].max(initial=0))
            for j in range(len(q)):
                others = ids != query_ids[at + j]
                places = np.flatnonzero(others & plain)
                if own[j] < 1e300 and len(places) > k:
                    row = rough[j, places]
                    places = places[row <= np.partition(row, k - 1)[k - 1] + slack[j]]
                places = np.concatenate([places, np.flatnonzero(others & ~plain)])
                exact = distances(found[places], q[j])
                best = np.lexsort((ids[places], exact))[:k]
                yield at + j, places[best], exact[best]


def search(df: DataFrame, queries: Column, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows found for each row under ``queries``.

    ``queries`` is a condition on the column ``vec_id``. The driver holds the sample, the
    router and a count for each part.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null").where(valid(F.col("v")))
    usual = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if usual is None:
        return spark.range(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    wanted = max(1, min(MOST_PARTS, usual["count"] // PART_ROWS))
    sampled = max(SAMPLE_LEAST, SAMPLE_A_PART * wanted)
    of_million = min(1_000_000, int(1_000_000 * sampled / usual["count"]) + 1)
    fit = rows.where(F.size("v") == usual["dim"]).where(~F.exists("v", lambda c: F.abs(c) > SAMPLED_UP_TO))
    sample = fit.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1_000_000)) < of_million).groupBy("v").agg(F.min("vec_id").alias("vec_id")).orderBy(F.xxhash64("vec_id", "v")).limit(2 * sampled).select("v").toPandas()
    x = np.array(sample["v"].to_list(), dtype=np.float64).reshape(len(sample), usual["dim"])
    parts = max(1, min(wanted, len(x) // 50))
    router = spark.sparkContext.broadcast(learn(x, parts) if parts > 1 else None)

    dim = usual["dim"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8")
            ends = np.cumsum(sizes)
            # A length that is not the usual one is a part of its own, numbered below zero.
            own, probes = -sizes.astype(np.int32), [np.array([-n], dtype=np.int32) for n in sizes]
            usual_ones = np.flatnonzero(sizes == dim)
            if len(usual_ones):
                vectors = flat[np.repeat(sizes == dim, sizes)].reshape(-1, dim)
                own[usual_ones] = router.value.index.probabilities(vectors).argmax(1) if router.value else 0
                for k, o in zip(usual_ones, router.value.probes(vectors) if router.value else [np.zeros(1)] * len(vectors), strict=True):
                    probes[k] = o.astype(np.int32)
            raw = [flat[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(own, pa.int32()), pa.array(probes, pa.list_(pa.int32()))], names=["vec_id", "v", "part", "probes"])

    index = materialize(rows.mapInArrow(route, "vec_id long, v binary, part int, probes array<int>"), "ann-index")
    asked = index.where(queries).groupBy("vec_id").agg(F.min(F.struct("v", "probes")).alias("q")).select(F.col("vec_id").alias("query_id"), "q.v", F.explode("q.probes").alias("part"))
    # Blocks a part: bounded candidates and queries for one task, whatever a part's size.
    count = lambda t: {r["part"]: r["count"] for r in t.groupBy("part").count().collect()}
    have, want = count(index), count(asked)
    table = spark.createDataFrame([(p, -(-n // BLOCK), -(-want.get(p, 1) // QUERY_BLOCK)) for p, n in have.items()], "part int, blocks int, query_blocks int")
    salt = lambda n: F.pmod(F.xxhash64("vec_id", "v"), n).cast("int")
    left = index.join(F.broadcast(table), "part").select("part", salt(F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block"), "vec_id", "v")
    right = asked.join(F.broadcast(table), "part").select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int").alias("query_block"), "query_id", "v")

    def rank(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = []
        if len(candidates) and len(asked):
            ids, query_ids = candidates["vec_id"].to_numpy(), asked["query_id"].to_numpy()
            for q, places, score in nearest(matrix(asked["v"].to_list()), query_ids, matrix(candidates["v"].to_list()), ids, k):
                out.append((np.full(len(places), query_ids[q]), ids[places], score))
        joined = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), joined, strict=True)))

    keys = ("part", "block", "query_block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(rank, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

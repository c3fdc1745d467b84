"""Lexical retrieval packing: windows filled by BM25 neighbours that are still unused.

A document's tokens fill whole windows of their own as far as they go; its remainder, under
a window long, seeds a window or fills another's. The remainders are indexed in shards: a
shard holds about SHARD_DOCS documents that are lexically close: a tree of splits, fitted on
a sample of bounded size, deals them by their BM25 weights, and what lands in one leaf beyond
that number (a large copy group) is dealt over further shards by a hash. In a shard, an inverted index over token ids
with BM25 weights (document frequencies and mean length taken over the whole corpus) scores
the unused remainders against the seed's; they fill the seed's window greedily, nearest
first. The one that no longer fits whole is cut, and its rest seeds the next window, so only
the last window of a shard stays open; it is cut into a run of powers of two, which need no
padding.

Results by case: a null or empty text is its end token alone; a null id is a document of its
own row; repeated rows are packed each; an empty table gives an empty result; other columns
are not carried.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.shared import materialize

#: Tokens of a window, documents of a shard (about), and postings from which a token's are kept as a row.
WINDOW, SHARD_DOCS, DENSE = 1024, 1024, 24
#: Directions that weights are projected on, sampled remainders a leaf of the dealing tree, and leaves at most.
DIRECTIONS, LEAF_SAMPLE, MOST_LEAVES = 64, 32, 1024
#: BM25's usual parameters.
K1, B = 1.2, 0.75
#: Bytes of the texts (about) whose units are encoded together; a longer text goes by itself.
TOGETHER = 4 << 20
#: The id that ends a document.
END = 0


#: White space besides the space and the line feed.
ODD_ASCII = "\t\v\f\r\x1c\x1d\x1e\x1f"
ODD_OTHER = "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


class Encoder:
    """A byte-level vocabulary's token ids, as bytes, of texts: equal to the library's."""

    def __init__(self, tokenizer):
        import tiktoken

        from sitewright.llm.bpe import byte_alphabet

        self.tokenizer = tokenizer
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        back = {c: b for b, c in byte_alphabet().items()}
        vocabulary = json.loads(tokenizer.to_str())["model"]["vocab"]
        ranks = {bytes(back[c] for c in t): i for t, i in vocabulary.items() if all(c in back for c in t)}
        self.opens = np.zeros(max(ranks.values(), default=0) + 1, dtype=bool)  # ids that start with a space
        self.opens[[i for t, i in ranks.items() if t.startswith(b" ")]] = True
        self.encode = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.encode(text).astype("<u4").tobytes()

    def parts(self, text: str) -> bool:
        """Whether all units of the text (what follows a single space up to the next) stand alone:
        none is empty or starts or ends with white space."""
        if any(s in text for s in self.special):
            return False
        odd = "  " in text or "\n " in text or " \n" in text or text.endswith(" ") or any(c in text for c in ODD_ASCII)
        return not odd and (text.isascii() or not any(c in text for c in ODD_OTHER))

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. The distinct units of a batch are encoded once, as one text: a
        unit's first token is its only one that starts with a space, so the units' ids part there."""
        out = [None if self.parts(t) else self.ids(t) for t in texts]
        plain = [k for k, ids in enumerate(out) if ids is None]
        if not plain:
            return out
        # Each text's first unit has no space before it and is encoded by itself.
        lists = pc.split_pattern(pa.array([texts[k] for k in plain], pa.large_string()), " ")
        firsts, flat = lists.offsets.to_numpy()[:-1], lists.values
        heads = [self.encode(t) for t in flat.take(pa.array(firsts)).to_pylist()]
        later = np.ones(len(flat), dtype=bool)
        later[firsts] = False
        coded = flat.filter(pa.array(later)).dictionary_encode()
        distinct = len(coded.dictionary)
        ids = self.encode("".join((" " + coded.dictionary.to_numpy(zero_copy_only=False)) if distinct else []))
        begin = np.flatnonzero(self.opens[ids]) if distinct else np.zeros(0, dtype=np.int64)
        sizes = np.diff(begin, append=len(ids)) if distinct else begin
        own = np.array([len(h) for h in heads])
        ids, begin = np.concatenate([ids, *heads]).astype("<u4"), np.concatenate([begin, len(ids) + np.cumsum(own) - own])
        sizes = np.concatenate([sizes, own])
        unit = np.empty(len(flat), dtype=np.int64)
        unit[later], unit[firsts] = coded.indices.to_numpy(), np.arange(distinct, distinct + len(heads))
        begin, sizes = begin[unit], sizes[unit]
        end = np.cumsum(sizes)
        raw = ids[np.arange(end[-1]) + np.repeat(begin - end + sizes, sizes)].tobytes()
        to = (4 * end[np.append(firsts[1:], len(flat)) - 1]).tolist()
        for k, at, stop in zip(plain, [0, *to[:-1]], to, strict=True):
            out[k] = raw[at:stop]
        return out


#: The byte-level vocabularies' split (fixed by the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return Encoder(tokenizer)


PIECE = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long"


def tokenize(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Full windows (``ids`` null) and remainders (with ``ids``) of each row's whole text."""
    schema = PIECE.format(id=df.schema[id_col].dataType.simpleString()) + ", ids binary, shard_key long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = encoder(vocabulary)
        end = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            chunk = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)) // TOGETHER
            bounds = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), batch.num_rows]
            for at, to in pairwise(bounds):
                part = batch.slice(at, to - at)
                doc, start, length, crc, total, kept, key = [], [], [], [], [], [], []
                for k, raw in enumerate(u.batch([t or "" for t in part.column(1).to_pylist()])):
                    raw += end
                    n = len(raw) // 4
                    for s in range(0, n, window):
                        own = raw[4 * s : 4 * (s + window)]
                        full = len(own) == 4 * window
                        doc.append(k)
                        start.append(s)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        total.append(n)
                        numbers = None if full else np.frombuffer(own, "<u4")
                        kept.append(None if full else numbers.astype("<u2" if numbers.max() < 1 << 16 else "<u4").tobytes())
                        key.append(zlib.crc32(own, 1))
                ids = part.column(0).take(pa.array(doc, pa.int64()))
                columns = [ids, *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array(kept, pa.binary()), pa.array(key, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "shard_key"])
        pa.default_memory_pool().release_unused()

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _numbers(ids: bytes, length: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * length else "<u4").astype("<u4")


def token_statistics(rests: DataFrame) -> tuple[int, float, np.ndarray]:
    """Remainders, their mean length and each token's document frequency, over all of them.

    A partition sends one count for each token of the vocabulary at most, so what reaches the
    driver is bounded by the vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            for ids, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = np.unique(_numbers(ids, n))
                if seen[-1] >= len(df):
                    df = np.concatenate([df, np.zeros(int(seen[-1]) + 1 - len(df), dtype=np.int64)])
                df[seen] += 1
        tokens = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array(df[tokens], pa.int64())], names=["token", "df"])

    n, total = rests.agg(F.count("*"), F.sum("length")).first()
    counts = rests.select("ids", "length").mapInArrow(run, "token long, df long").groupBy("token").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(int(counts["token"].max()) + 1 if len(counts) else 1, dtype=np.int64)
    df[counts["token"]] = counts["df"]
    return n, (total or 0) / max(n, 1), df


def bm25(weight_of: np.ndarray, terms: np.ndarray, tf: np.ndarray, lengths: np.ndarray, mean: float) -> np.ndarray:
    return (weight_of[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths / max(mean, 1e-9)))).astype(np.float32)


@lru_cache(maxsize=1)
def _directions(tokens: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((tokens, DIRECTIONS), dtype=np.float32)


def projected(ids: list[bytes], lengths: list[int], weight_of: np.ndarray, mean: float) -> np.ndarray:
    """A unit row for each remainder: its BM25 weights on the fixed directions."""
    out = np.zeros((len(ids), DIRECTIONS), dtype=np.float32)
    directions = _directions(len(weight_of))
    for k, (own, n) in enumerate(zip(ids, lengths, strict=True)):
        terms, tf = np.unique(_numbers(own, n), return_counts=True)
        out[k] = bm25(weight_of, terms, tf.astype(np.float32), n, mean) @ directions[terms]
    return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-9)


def fit_tree(x: np.ndarray, leaves: int, first: int = 0) -> tuple | int:
    """Nested ``(direction, threshold, below, above)`` splits by principal directions; numbered leaves."""
    if leaves == 1 or len(x) < 2:
        return first
    _, vectors = np.linalg.eigh(np.cov(x, rowvar=False))
    at = x @ vectors[:, -1]
    half = leaves // 2
    threshold = float(np.quantile(at, half / leaves))
    return vectors[:, -1].astype(np.float32), threshold, fit_tree(x[at <= threshold], half, first), fit_tree(x[at > threshold], leaves - half, first + half)


def leaves_of(tree: tuple | int, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, int):
        return np.full(len(x), tree, dtype=np.int64)
    direction, threshold, below, above = tree
    low, out = x @ direction <= threshold, np.empty(len(x), dtype=np.int64)
    out[low], out[~low] = leaves_of(below, x[low]), leaves_of(above, x[~low])
    return out


def deal(rests: DataFrame, n: int, mean: float, weights) -> DataFrame:
    """``rests`` with the ``shard`` of each: of about SHARD_DOCS remainders close to each other.

    The driver holds the sample's projections and a count for each leaf.
    """
    leaves = min(max(1, round(n / SHARD_DOCS)), MOST_LEAVES)
    salt = F.xxhash64("row")  # by row: repeated rows spread too
    if leaves == 1:
        return rests.withColumn("shard", F.lit(0).cast("long"))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = projected(batch.column(0).to_pylist(), batch.column(1).to_pylist(), weights.value, mean)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary())], names=["x"])

    every = max(1, n // (LEAF_SAMPLE * leaves))
    rows = rests.where(F.pmod(salt, F.lit(every)) == 0).select("ids", "length").mapInArrow(sample, "x binary").collect()
    sampled = np.frombuffer(b"".join(sorted(bytes(r["x"]) for r in rows)), "<f4").reshape(-1, DIRECTIONS)
    tree = fit_tree(sampled.astype(np.float64), leaves)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("ids", "length"))
            leaf = leaves_of(tree, projected(ids, lengths, weights.value, mean))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rests.schema)
    routed = materialize(rests.mapInArrow(route, f"{fields}, leaf long"), "packing-leaves")
    counts = {r["leaf"]: r["count"] for r in routed.groupBy("leaf").count().collect()}
    parts = [max(1, round(counts.get(k, 0) / SHARD_DOCS)) for k in range(leaves)]
    firsts = np.cumsum([0, *parts[:-1]]).tolist()
    leaf = F.col("leaf").cast("int")
    pick = lambda numbers: F.get(F.array(*map(F.lit, numbers)), leaf).cast("long")
    return routed.withColumn("shard", pick(firsts) + F.pmod(salt, pick(parts))).drop("leaf")


def order_by_neighbours(tokens: list[np.ndarray], weight_of: np.ndarray, mean: float, window: int) -> Iterator[tuple[int, int, int, int]]:
    """``(sequence, document, start, length)`` of a shard's pieces, window by window."""
    n = len(tokens)
    lengths = np.array([len(t) for t in tokens])
    found = [np.unique(t, return_counts=True) for t in tokens]
    terms = np.concatenate([t for t, _ in found])
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t, _ in found])
    tf = np.concatenate([c for _, c in found]).astype(np.float32)
    weight = bm25(weight_of, terms, tf, lengths[owner], mean)
    by_term = np.argsort(terms, kind="stable")
    terms, owner, weight = terms[by_term], owner[by_term], weight[by_term]
    known, starts, counts = np.unique(terms, return_index=True, return_counts=True)
    # Frequent tokens' postings are rows of a table, the others' stay lists.
    dense = np.flatnonzero(counts >= DENSE)
    row_of = np.full(len(known), -1)
    row_of[dense] = np.arange(len(dense))
    table = np.zeros((len(dense), n), dtype=np.float32)
    held = row_of[np.repeat(np.arange(len(known)), counts)]
    table[held[held >= 0], owner[held >= 0]] = weight[held >= 0]

    def scores(own: np.ndarray) -> np.ndarray:
        """Every document's BM25 score against all of a seed's tokens."""
        at = np.searchsorted(known, own)
        rows, lists = row_of[at], at[row_of[at] < 0]
        size = counts[lists]
        places = np.arange(size.sum()) + np.repeat(starts[lists] - np.cumsum(size) + size, size)
        return table[rows[rows >= 0]].sum(0) + np.bincount(owner[places], weights=weight[places], minlength=n).astype(np.float32)

    free = np.ones(n, dtype=bool)
    rest: tuple[int, int] | None = None  # a cut document and where its rest starts
    seed_order, at, sequence = np.argsort(-lengths, kind="stable"), 0, 0
    while True:
        if rest is None:
            while at < n and not free[seed_order[at]]:
                at += 1
            if at == n:
                return
            seed, start = int(seed_order[at]), 0
            free[seed] = False
        else:
            (seed, start), rest = rest, None
        room = window - (lengths[seed] - start)
        yield sequence, seed, start, int(lengths[seed] - start)
        if room > 0 and free.any():
            score = scores(found[seed][0])
            score[~free] = -1
            while room > 0:
                k = int(score.argmax())
                if score[k] < 0:
                    break  # only used ones are left
                score[k], free[k] = -1, False
                take = int(min(room, lengths[k]))
                yield sequence, k, 0, take
                room -= take
                if take < lengths[k]:
                    rest = (k, take)
        sequence += 1


def pack(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Tokens are written once to the shared folder; full windows never shuffle, remainders
    shuffle once, by shard. The driver holds document frequencies only.
    """
    spark = df.sparkSession
    pieces = materialize(tokenize(df, vocabulary, id_col=id_col, text_col=text_col, window=window).withColumn("row", F.monotonically_increasing_id()), "packing-tokens")
    rests = pieces.where("ids is not null")
    n, mean, frequency = token_statistics(rests)
    weights = spark.sparkContext.broadcast(np.log1p((n - frequency + 0.5) / (frequency + 0.5)).astype(np.float32))
    schema = PIECE.format(id=df.schema[id_col].dataType.simpleString()) + ", sequence_id long, offset long"

    def fill(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["doc_tokens", "shard_key"], kind="stable").reset_index(drop=True)
        tokens = [_numbers(i, k) for i, k in zip(shard["ids"], shard["length"], strict=True)]
        base = int(shard["shard"].iloc[0]) << 32
        rows, used, previous = [], 0, -1
        placed = list(order_by_neighbours(tokens, weights.value, mean, window))
        fill_of: dict[int, int] = {}
        for s, _, _, k in placed:
            fill_of[s] = fill_of.get(s, 0) + k
        extra = max(fill_of, default=0) + 1
        for s, d, a, k in placed:
            used = used if s == previous else 0
            previous = s
            # A window that stays open is cut at powers of two, largest first: sequences
            # of those lengths are not padded.
            while k:
                left = fill_of[s] - used
                if fill_of[s] == window or left == 0:
                    number, offset, take = s, used, k
                else:
                    done, size = 0, 1 << (fill_of[s].bit_length() - 1)
                    part = 0
                    while used >= done + size:
                        done += size
                        part += 1
                        size = 1 << ((fill_of[s] - done).bit_length() - 1)
                    number, offset, take = (s if part == 0 else extra + part), used - done, min(k, done + size - used)
                own = tokens[d][a : a + take]
                rows.append((d, a, take, zlib.crc32(own.astype("<u4").tobytes()), base + number, offset))
                a, k, used = a + take, k - take, used + take
        d, a, k, crc, number, offset = (np.array(x) for x in zip(*rows, strict=True))
        of = shard.iloc[d].reset_index(drop=True)
        return pd.DataFrame({"doc_id": of["doc_id"], "start": of["start"] + a, "length": k, "ids_crc32": crc, "doc_tokens": of["doc_tokens"], "sequence_id": number, "offset": offset})

    packed = deal(rests, n, mean, weights).groupBy("shard").applyInPandas(fill, schema)
    # Full windows: their sequence is their own; negative numbers keep clear of the shards'.
    full = pieces.where("ids is null").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(packed)

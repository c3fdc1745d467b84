"""SimHash near-duplicates: fingerprints, and links by a byte-position inverted index.

Two fingerprints of eight bytes that differ in at most two bits agree in at least six bytes
at the same positions. The inverted index is keyed by positions with their bytes. A list of
one position would hold a 256th of all fingerprints, so a key takes four positions: the 14
sets of four whose numbers' XOR is 0, of which any six positions contain three that cover
them. Each list that a pair shares adds its positions to the pair's tally of shared bytes;
pairs below the guaranteed minimum of six are dropped, and the rest verified bit by bit.

Only distinct fingerprints are indexed, so copies cost nothing; fingerprints that many rows
share are joined back by broadcast, at most HOT of them. A posting list longer than
MAX_LIST (a dense group of near copies) is not paired: each of its fingerprints lists itself
and its 64 one-bit neighbours instead, and fingerprints that list the same value, at most 65
of them, link to the least. That finds the same links, exactly, in linear work.

Results by case: a null or wordless text has fingerprint zero, linked like any other; a null
id gets its component like any row (``component_id`` is the least id that is not null, null
if there is none); repeated rows and ids each get a row; other columns are not carried; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sitewright.shared import materialize, passing

#: Posting lists up to this length are paired; longer ones link through shared neighbours.
MAX_LIST = 24
#: Differing bits that still link, and the positional bytes that such pairs share at least.
MAX_BITS, MIN_BYTES = 2, 6
#: The sets of four positions that key the postings.
QUADS = [q for q in combinations(range(8), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]
#: Fingerprints held by more than one row in HOT, so fewer than HOT, are joined by broadcast.
HOT = 1000


def fingerprint_of(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, as a signed 64-bit integer."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else iter([b" ".join(w)])
    n = max(1, len(w) - words + 1)
    h = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), dtype="<u8", count=n).view(np.uint8).reshape(n, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 8192):
        ones += np.unpackbits(h[at : at + 8192], axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fp long`` of each row's whole text; one narrow pass."""
    schema = f"doc_id {df.schema[id_col].dataType.simpleString()}, fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint_of(t.as_py()) for t in batch.column(1)), dtype=np.int64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], names=["doc_id", "fp"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _byte(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(0xFF))


def links(distinct: DataFrame) -> DataFrame:
    """``(a, b)`` pairs of ``fp`` values at most MAX_BITS apart that connect all such pairs."""
    key = lambda q: reduce(lambda v, k: F.shiftleft(v, 8) + _byte(F.col("fp"), k), q[1:], _byte(F.col("fp"), q[0]))
    keys = F.array(*(F.struct(F.lit(sum(1 << k for k in q)).alias("places"), key(q).alias("key")) for q in QUADS))
    postings = distinct.select("fp", F.explode(keys).alias("p")).select("fp", "p.places", "p.key")
    lists = materialize(postings.groupBy("places", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-lists")
    short = postings.join(lists.where(F.col("n") <= MAX_LIST), ["places", "key"]).groupBy("places", "key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    one = short.select("places", "fps", F.posexplode("fps").alias("at", "a"))
    met = one.select("places", "a", F.explode(F.slice("fps", F.col("at") + 2, F.lit(MAX_LIST))).alias("b"))
    tally = met.groupBy("a", "b").agg(F.bit_count(F.bit_or("places")).alias("shared"))
    paired = tally.where(F.col("shared") >= MIN_BYTES).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b")
    dense = postings.join(lists.where(F.col("n") > MAX_LIST), ["places", "key"], "left_semi").select("fp").distinct()
    near = F.concat(F.array("fp"), F.array(*(F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(64))))
    starred = (
        dense.select("fp", F.explode(near).alias("v"))
        .select(F.col("fp").alias("b"), F.min("fp").over(Window.partitionBy("v")).alias("a"))
        .where("a <> b")
        .distinct()
        .select("a", "b")
    )
    return paired.unionByName(starred)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``(a, b)``: the least node that it reaches.

    Alternating large-star and small-star steps over DataFrames, each written to the shared
    folder; the number of steps grows with the logarithm of the longest chain. Least
    neighbours are combined before they shuffle and written too, so that the edges join a
    plain table: adaptive execution splits the edges of a node that very many share.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "simhash-edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "simhash-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "simhash-edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = materialize(small, "simhash-edges")
        before, state = state, _state(now)
        if before == state:
            break
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge table."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` and ``root`` (its least fingerprint) of every row of ``df``."""
    prints = materialize(fingerprints(df, id_col=id_col, text_col=text_col), "simhash-prints")
    return assign(prints)


def assign(prints: DataFrame) -> DataFrame:
    """Components for a table of ``doc_id`` and ``fp``."""
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "simhash-classes")
    rooted = classes.join(components(links(classes.select("fp"))), F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = materialize(rooted.join(least, "root").select("fp", "component_id", "root"), "simhash-components")
    rows = classes.agg(F.sum("n")).first()[0] or 0
    hot = found.join(classes.where(F.col("n") * HOT > rows).select("fp"), "fp")
    # Fewer than HOT rows in all, by their condition; the other keys are of bounded size.
    joined = [prints.join(F.broadcast(hot), "fp"), prints.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(found, "fp")]
    return joined[0].unionByName(joined[1]).select("doc_id", "fp", "component_id", "root")


#: For similarity by share of common shingles: words of a shingle, the least similarity, and
#: the signature's positional bytes, of which KEYS groups of four are indexed.
SHINGLE, SIMILARITY, POSITIONS, KEYS = 5, 0.8, 128, 32
#: Keys that a pair shares at least: at similarity 0.8 all but one pair in 80,000 do, of 13 on average.
MIN_KEYS = 3
#: Members of a long list that all its members are paired with.
PIVOTS = 4
#: Signatures of a block in which a long list's members are compared, and shingles of one in
#: which their sets are; partners of one row in a block beyond which the sets are compared.
BLOCK, BLOCK_SHINGLES, CROWD = 2048, 1 << 20, 8
#: Bits of the filter that says which rows may be among given ones, whatever the table's size.
FILTER_BITS = 1 << 23
#: Estimate below which a pair is dropped unverified: at similarity 0.8 that happens to one
#: pair in ten million.
NEVER = 0.6


def shingle_hashes(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text, as sorted hashes; one for a text without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    shingles = {b" ".join(w)} if len(w) < words else set(map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)))
    return np.sort(np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), dtype=np.uint64, count=len(shingles)))


def _multipliers() -> np.ndarray:
    return np.random.default_rng(64).integers(1, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature_of(text: str | None, multipliers: np.ndarray) -> bytes:
    """A byte for each position: of the least shingle hash in that position's order."""
    h = shingle_hashes(text)
    h = h ^ (h >> np.uint64(31))
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(h), 2048):
        np.minimum(least, (h[at : at + 2048, None] * multipliers).min(0), out=least)
    # The product's least value has small high bits; its low bits tell which hash it was.
    return (((least ^ (least >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def _postings(rows: DataFrame, width: int = 4) -> DataFrame:
    keys = F.array(*(F.struct(F.lit(k).alias("k"), F.substring(F.concat("sig", "sig"), 4 * k + 1, width).alias("key")) for k in range(KEYS)))
    return rows.select("cid", F.explode(keys).alias("p")).select("cid", "p.k", "p.key")


def _candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(a, b)`` pairs of classes to verify, and the members ``(cid, k, key)`` of the lists of
    which not all pairs are among them.

    The keys that a pair shares in lists up to MAX_LIST are tallied, and pairs with MIN_KEYS or
    more stay. In a longer list each class is paired with PIVOTS of its members only, which
    links most of a dense group of near copies; ``_strays`` compares what that leaves apart.
    """
    postings = _postings(classes)
    picks = [F.min_by("cid", F.xxhash64("cid", F.lit(i))).alias(f"p{i}") for i in range(PIVOTS)]
    lists = materialize(postings.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1"), "similar-lists")
    # All postings shuffle for one join; what it leaves, those of shared keys, is read for both kinds of list.
    met = materialize(postings.join(lists, ["k", "key"]).select("cid", "k", "key", "n"), "similar-postings")
    short = met.where(F.col("n") <= MAX_LIST).groupBy("k", "key").agg(F.array_sort(F.collect_list("cid")).alias("cids"))
    one = short.select("cids", F.posexplode("cids").alias("at", "a"))
    close = one.select("a", F.explode(F.slice("cids", F.col("at") + 2, F.lit(MAX_LIST))).alias("b"), F.lit(1).alias("shared"))
    dense = met.where(F.col("n") > MAX_LIST).select("cid", "k", "key")
    long = dense.join(dense.groupBy("k", "key").agg(*picks), ["k", "key"]).select("cid", F.explode(F.array(*(f"p{i}" for i in range(PIVOTS)))).alias("p")).where("cid <> p")
    starred = long.select(F.least("cid", "p").alias("a"), F.greatest("cid", "p").alias("b"), F.lit(MIN_KEYS).alias("shared"))
    tally = close.unionByName(starred).groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    return tally.where(F.col("shared") >= MIN_KEYS).select("a", "b"), dense


def _strays(classes: DataFrame, texts: DataFrame, dense: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs to verify, and verified links, among members ``dense`` of long lists that
    ``roots(node, root)`` leaves apart.

    Members in the group of a list's first pivot are connected; each other one, a stray, meets
    every member, a block of signatures by a block. Pairs that share MIN_KEYS keys, the first
    of them in this list, and whose estimate reaches NEVER are candidates. Where a stray has
    more than CROWD of them in a block pair, the block pair is compared on the shingles,
    exactly, and gives no more links than connect its rows.
    """
    members = dense.join(roots, F.col("cid") == F.col("node"), "left").select("k", "key", "cid", F.coalesce("root", "cid").alias("root"))
    members = materialize(members, "similar-members")
    homes = members.groupBy("k", "key").agg(F.min_by("root", F.xxhash64("cid", F.lit(0))).alias("home"))
    placed = members.join(homes, ["k", "key"]).withColumn("stray", F.col("root") != F.col("home"))
    sizes = placed.groupBy("k", "key").agg(F.count_if("stray").alias("strays"), F.count_if(~F.col("stray")).alias("rest")).where("strays > 0")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    sizes = sizes.select("k", "key", blocks("strays").alias("n"), blocks("rest").alias("m"))
    # Blocks of strays come first; they meet all blocks, the others those of strays only.
    block = F.when(F.col("stray"), F.pmod(F.xxhash64("cid"), F.col("n"))).otherwise(F.col("n") + F.pmod(F.xxhash64("cid"), F.col("m"))).cast("int")
    meets = F.when(F.col("stray"), F.col("n") + F.col("m")).otherwise(F.col("n"))
    # The lists of a class that are long, as bits: a pair is compared in the first that it shares.
    bits = members.groupBy("cid").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("long"))
    placed = placed.join(sizes, ["k", "key"]).select("k", "key", "cid", "root", block.alias("block"), meets.alias("meets"))
    placed = materialize(placed.join(bits, "cid").join(classes.select("cid", "sig"), "cid"), "similar-strays")

    def pairwise(rows: DataFrame) -> DataFrame:
        met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("meets") - 1)))
        return met.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "meets")

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        i, j, k = (int(rows[c].iloc[0]) for c in ("i", "j", "k"))
        found, crowded = _block_candidates(rows[rows["block"] == i], rows[rows["block"] == j], k, i == j)
        out = pd.DataFrame(found, columns=["a", "b"], dtype="int64")
        if crowded:
            out = pd.DataFrame({"a": [-1], "b": [-1]})
        return out.assign(k=k, key=rows["key"].iloc[0], i=i, j=j)

    met = materialize(pairwise(placed).groupBy("k", "key", "i", "j").applyInPandas(meet, "a long, b long, k int, key binary, i int, j int"), "similar-met")
    crowded = met.where("a < 0").select("k", "key", "i", "j")

    asked = placed.join(crowded.select("k", "key", F.explode(F.array("i", "j")).alias("block")).distinct(), ["k", "key", "block"], "left_semi")
    wanted = materialize(asked.select("cid").distinct(), "similar-asked")
    sets = materialize(_marked(texts, "cid", wanted).where("doubtful").drop("doubtful").join(wanted, "cid", "left_semi").mapInArrow(_shingled, "cid long, set binary"), "similar-sets")
    full = pairwise(placed.drop("sig", "long")).join(crowded, ["k", "key", "i", "j"], "left_semi").join(sets, "cid")
    # Both sides of a block pair are dealt again, so that a task holds a bounded number of shingles.
    parts = full.groupBy("k", "key", "i", "j").agg(F.ceil(F.sum(F.octet_length("set")) / (8 * BLOCK_SHINGLES)).cast("int").alias("parts"))
    full = materialize(full.join(parts, ["k", "key", "i", "j"]), "similar-crowds")
    own, every = F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = full.where("block = i").withColumn("p", own).withColumn("q", every).withColumn("left", F.lit(True))
    dealt = dealt.unionByName(full.where("block = j").withColumn("q", own).withColumn("p", every).withColumn("left", F.lit(False)))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        sides = (rows[rows["left"]], rows[~rows["left"]])
        return pd.DataFrame(_block_links(*((side["cid"].to_numpy(), side["root"].to_numpy(), [np.frombuffer(v, "<u8") for v in side["set"]]) for side in sides)), columns=["a", "b"], dtype="int64")

    links = dealt.groupBy("k", "key", "i", "j", "p", "q").applyInPandas(compare, "a long, b long")
    return met.where("a >= 0").select("a", "b").distinct(), links


def _block_candidates(left: pd.DataFrame, right: pd.DataFrame, k: int, same_block: bool) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of two blocks of list ``k`` to verify, or that a row has too many of them."""
    if not len(left) or not len(right):
        return [], False
    matrix = lambda side: np.frombuffer(b"".join(side["sig"]), np.uint8).reshape(len(side), POSITIONS)
    ours, theirs = matrix(left), matrix(right)
    our_keys, their_keys = ours.view("<u4"), theirs.view("<u4")
    ids, roots = right["cid"].to_numpy(), right["root"].to_numpy()
    earlier = (1 << k) - 1  # long lists before this one
    powers = np.left_shift(np.int64(1), np.arange(KEYS, dtype=np.int64))
    found: list[tuple[int, int]] = []
    for own, root, long, sig, key in zip(left["cid"].tolist(), left["root"].tolist(), left["long"].tolist(), ours, our_keys, strict=True):
        near = np.flatnonzero((roots != root) & (ids > own) if same_block else roots != root)
        same = their_keys[near] == key
        near, same = near[(count := same.sum(1) >= MIN_KEYS)], same[count]
        first = (same * powers).sum(1) & long & earlier == 0
        near = near[first]
        share = (theirs[near] == sig).mean(1)
        near = near[(share - 1 / 256) / (1 - 1 / 256) >= NEVER]
        if len(near) > CROWD:
            return [], True
        found += ((own, int(b)) for b in ids[near])
    return found, False


def _block_links(left: tuple, right: tuple) -> list[tuple[int, int]]:
    """Links between two blocks of ``(ids, roots, shingle sets)`` that connect their groups."""
    (ids, roots, sets), (other_ids, other_roots, other_sets) = left, right
    if not len(ids) or not len(other_ids):
        return []
    group: dict[int, int] = {}

    def find(x: int) -> int:
        while group.setdefault(x, x) != x:
            group[x] = x = group[group[x]]
        return x

    length = np.array([len(x) for x in other_sets])
    hashes, owner = np.concatenate(other_sets), np.repeat(np.arange(len(other_sets)), length)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    links = []
    for own, root, x in zip(ids.tolist(), roots.tolist(), sets, strict=True):
        low, high = np.searchsorted(hashes, x), np.searchsorted(hashes, x, "right")
        n = high - low
        at = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
        common = np.bincount(owner[at], minlength=len(length))
        for k in np.flatnonzero((common >= SIMILARITY * (len(x) + length - common)) & (other_roots != root)).tolist():
            p, q = find(root), find(int(other_roots[k]))
            if p != q:
                group[p] = q
                links.append((own, int(other_ids[k])))
    return links


def _marked(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``rows`` with ``doubtful``: false only where ``column`` is surely not in the one column of ``ids``.

    A filter of one hash as a table of 64-bit words, FILTER_BITS / 64 at most, which bounds its
    broadcast: few wide rows then shuffle for an exact join with few ids. With very many ids
    it admits all rows, and that join alone decides.
    """
    at = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(FILTER_BITS))
    bit = "shiftleft(1L, cast(at % 64 as int))"
    words = materialize(ids.select(at(ids.columns[0]).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr(bit)).alias("bits")), "similar-filter")
    found = rows.withColumn("at", at(column)).withColumn("word", F.shiftright("at", 6)).join(F.broadcast(words), "word", "left")
    return found.select(*rows.columns, F.coalesce(F.col("bits").bitwiseAND(F.expr(bit)) != 0, F.lit(False)).alias("doubtful"))


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_hashes(t.as_py()).tobytes() for t in part.column(1)], pa.binary())], names=["cid", "set"])


def similar_links(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """``(a, b)`` pairs of ``classes(cid, sig)`` that connect those whose shingles have SIMILARITY or more in common.

    The equal positional bytes of each candidate pair are tallied; pairs that cannot reach
    the similarity are dropped, and all others verified on their shingles, made anew from
    ``texts(cid, text)``.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, POSITIONS) for k in (2, 3))
            share = (left == right).mean(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((share - 1 / 256) / (1 - 1 / 256))], names=["a", "b", "share"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py(), "<u8") for v in (a, b))
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common >= SIMILARITY * (len(x) + len(y) - common))
            kept = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(kept) for k in (0, 1)], names=["a", "b"])

    def verified(likely: DataFrame) -> DataFrame:
        asked = likely.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        asked = materialize(asked, "similar-asked")
        sets = materialize(_marked(texts, "cid", asked).where("doubtful").drop("doubtful").join(asked, "cid", "left_semi").mapInArrow(_shingled, "cid long, set binary"), "similar-sets")
        own = lambda side: sets.select(F.col("cid").alias(side), F.col("set").alias(f"set_{side}"))
        return likely.join(own("a"), "a").join(own("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(verify, "a long, b long")

    sig = lambda side: classes.select(F.col("cid").alias(side), F.col("sig").alias(f"sig_{side}"))
    candidates, dense = _candidates(classes)
    tallied = candidates.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(tally, "a long, b long, share double")
    likely = materialize(tallied.where(F.col("share") >= NEVER).select("a", "b"), "similar-pairs")
    roots = materialize(components(verified(likely)), "similar-roots")
    more, links = _strays(classes, texts, dense, roots)
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(verified(more)).unionByName(links)


def drop_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the least id.

    Near copies have SIMILARITY or more of their five-word shingles in common, over whole
    texts; groups are what such links connect. A 64-bit SimHash cannot tell that similarity
    (at 0.8 some ten of its bits differ), so the positional bytes here are min-wise, two
    texts agreeing at a position as often as their shingles do; index, tally and
    verification are the same. Ids that are null come last; of rows that repeat one stays.
    Columns stay as they are.
    """
    row = "__row"
    while row in docs.columns:
        row += "_"
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema)
    multipliers = _multipliers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = [signature_of(t.as_py(), multipliers) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.binary()), batch.column(1)], names=["sig", row])

    signed = docs.select(F.col(text_col).cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row)).mapInArrow(run, f"sig binary, `{row}` struct<{fields}>")
    whole = materialize(signed.withColumn("rid", F.monotonically_increasing_id()), "similar-rows")
    doc_id, text = F.col(f"`{row}`.`{id_col}`"), F.col(f"`{row}`.`{text_col}`").cast("string")
    ids = whole.select("rid", "sig", doc_id.alias("doc_id"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    with passing(docs.sparkSession):
        classes = materialize(ids.groupBy("sig").agg(least.alias("first")).select("sig", "first", F.col("first.rid").alias("cid")), "similar-classes")
        edges = similar_links(classes.select("cid", "sig"), whole.select(F.col("rid").alias("cid"), text.alias("text")))
        rooted = classes.join(components(edges), F.col("cid") == F.col("node"), "left").select(F.coalesce("root", "cid").alias("root"), "first")
        kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.rid").alias("rid"))
        # Rows that surely stay never shuffle; those that may go are decided by an exact join.
        gone = materialize(whole.select("rid").join(kept, "rid", "left_anti"), "similar-gone", lasting=True)
    whole = _marked(whole, "rid", gone)
    left = whole.where(~F.col("doubtful")).unionByName(whole.where("doubtful").join(gone, "rid", "left_anti"))
    return left.select(*(F.col(f"`{row}`.`{c}`").alias(c) for c in docs.columns))

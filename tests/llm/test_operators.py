"""Each operator against a plain version, and on nulls, empty texts, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from sitewright.llm import ann, bpe, chat, html_extract, packing, quality_model, queries, rules, secret_scan, shards, simhash
from sitewright.shared import scratch_path
from tests.oracle import assert_same

WORD_BPE, BYTE_BPE, RANKS = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
LONG = "lorem ipsum dolor, sit amet. " * 4000
ODD = [
    (1, "The quick brown fox.\nIt don't stop."), (2, None), (3, ""), (4, " \n\t "), (None, "null id"), (5, "same text"), (5, "same text"), (6, LONG),
    (7, "ΑΣ ΟΔΟΣ İé ｶﾅ 漢字 🤖 don't I'LL 1½ ___"), (8, "<|endoftext|>a <|ENDOFTEXT|> <|startoftext|>"), (9, "a  b \n c\t\td \x1c e\xa0f  g "), (10, "x" * 3000),
]
SCHEMA = "doc_id long, text string, ids long, spans string, sig string, m int, __row int"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with extra columns named like what operators make."""
    return spark.createDataFrame([(i, t, 0, "x", "y", 1, 2) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas()


def test_oracle_sql(spark, sf_dir):
    for name, sql in queries.oracle_sql().items():
        assert_same(spark, queries.queries()[name], sql, sf_dir)


# 1: BPE


def library(path, texts):
    t = Tokenizer.from_file(path)
    return [(e.ids, t.decode(e.ids, skip_special_tokens=False)) for e in (t.encode(x or "", add_special_tokens=False) for x in texts)]


def test_bpe_equals_library(spark, sf_dir, odd, empty, docs):
    want = sorted(zip([i for i, _ in ODD], library(WORD_BPE, [t for _, t in ODD]), strict=True), key=repr)
    got = bpe.encode(odd, WORD_BPE, with_decoded=True).collect()
    assert sorted(((r["doc_id"], (r["ids"], r["decoded"])) for r in got), key=repr) == want
    back = bpe.decode(bpe.encode(odd, WORD_BPE), WORD_BPE).collect()
    assert sorted((r["doc_id"], r["decoded"]) for r in back if r["doc_id"]) == sorted((i, d) for i, (_, d) in want if i)
    assert bpe.encode(empty, WORD_BPE).count() == 0
    rows = {r["doc_id"]: r for r in queries.op1_bpe(spark, sf_dir).collect()}
    for i, (ids, text) in zip(docs["doc_id"], library(WORD_BPE, docs["text"]), strict=True):
        r = rows[i]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_stable_pairs_equal_merging():
    b = bpe.TrieBPE(WORD_BPE)
    names = list(b.built)
    rng = np.random.default_rng(3)
    for x, y in rng.integers(0, len(names), (3000, 2)):
        first = names[x][:-1] if len(names[x]) > 1 and names[x][-1] in b.last.values() else names[x]
        if first in b.built and first[-1] not in b.last.values():
            assert b.stable(b.built[first], b.built[names[y]]) == (b.merge_all(first + names[y]) == [first, names[y]])


# 2: quality classifier


def test_quality_held_out(spark, sf_dir, odd, empty):
    for d, least in (("/root/testdata/sf0.01", 0.95),):
        got = queries.op2_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
        assert (got["kept"] == (got["quality"] == 1)).mean() >= least
        assert got[got["quality"] == 1]["kept"].mean() >= 0.98
    rows = quality_model.classify(odd).collect()
    assert len(rows) == len(ODD) and all(r["kept"] for r in rows if r["doc_id"] in (2, 3, 4))
    assert quality_model.classify(empty).count() == 0
    assert quality_model.keep_good(odd).columns == odd.columns and quality_model.keep_good(empty).count() == 0


def plain_votes(text):
    """A text's votes, and its hashed words' shapes, from loops over words and characters."""
    text = text or ""
    w = [x for x in re.split("[ \t-\r]+", text) if x]
    n, chars = len(w), sum(c not in rules.SPACE for c in text)
    listed = {x for line in quality_model.FUNCTION_WORDS for x in line.split()}
    stutter = sum(a == b for a, b in zip(w, w[1:], strict=False))
    count = lambda p: len(regex.findall(p, text))
    share = lambda k, of: k / max(of, 1)
    vote = lambda bad, good: 0 if bad else 1 if good else 2
    symbols, upper, shouts, bars = share(count("[#*$%&<>]"), n), share(count(r"\p{Lu}"), chars), share(text.count("!!"), n), share(text.count("|"), n)
    ends, function, distinct = count(r"[\p{L}\p{N}][.?!](?=[ \t-\r]|\Z)"), sum(x.lower() in listed for x in w), len(set(w))
    votes = [
        vote(symbols > 0.2, symbols < 0.02), vote(upper > 0.4, upper < 0.2), vote(shouts > 0.2, shouts < 0.02), vote(bars > 0.15, bars < 0.02),
        vote(n >= 20 and share(stutter, n) > 0.15, n >= 20 and share(stutter, n) < 0.05), vote(50 <= n < 5000 and distinct < 0.12 * n, n >= 20 and distinct > 0.35 * n),
        vote(n >= 20 and share(function, n) < 0.03, n >= 20 and share(function, n) > 0.08), vote(n >= 20 and (max(chars, 1) > 14 * n or max(chars, 1) < 2 * n), n >= 20 and 3 * n < max(chars, 1) < 9 * n),
        vote(n >= 20 and ends * 60 < n, n >= 20 and ends * 25 > n),
    ]
    shape = regex.sub(r"\p{N}+", "9", regex.sub(r"\p{Lu}+", "A", regex.sub(r"\p{Ll}+", "a", text)))
    return votes, Counter([x for x in re.split("[ \t-\r]+", shape) if x] + ["\tstutter"] * stutter)


def test_quality_equals_plain(spark, sf_dir, odd):
    """Votes, posteriors and scores against loops: votes from the texts, EM a document at a time, the scorer's sums."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = quality_model.featured(docs.withColumn("__text", F.col("text")), "__text").cache()
    model = quality_model.fit(rows, key=F.col("doc_id"))
    got = model.score(rows).select("text", "votes", "features", "n_words", "posterior", "score").collect()
    plain = {r["text"]: plain_votes(r["text"]) for r in got}
    assert all(r["votes"] == sum(v * 3**k for k, v in enumerate(plain[r["text"]][0])) for r in got)

    seen = [plain[r["text"]][0] for r in got if r["n_words"]]
    p = [0.95 if 0 not in v else 0.4 if v.count(1) > 3 * v.count(0) else 0.1 for v in seen]
    prior = before = None
    for _ in range(100):
        before, prior = prior, (sum(p) + 1) / (len(p) + 2)
        right = {}
        for k in range(9):
            for c in (0, 1):
                tally = [0.5 + sum((q if c else 1 - q) for q, v in zip(p, seen, strict=True) if v[k] == x) for x in (0, 1)]
                right[k, c] = [tally[0] / sum(tally), tally[1] / sum(tally), 1.0]
        p = []
        for v in seen:
            good, bad = math.log(prior) + sum(math.log(right[k, 1][x]) for k, x in enumerate(v)), math.log(1 - prior) + sum(math.log(right[k, 0][x]) for k, x in enumerate(v))
            p.append(1 / (1 + math.exp(max(-50, min(50, bad - good)))))
        if before is not None and abs(before - prior) < 1e-9:
            break
    assert np.allclose([r["posterior"] for r in got if r["n_words"]], p, atol=1e-6)

    hashing, w, b = HashingTF(numFeatures=quality_model.FEATURES), model.scorer.coefficients.toArray(), model.scorer.intercept
    for r in got:
        shapes = plain[r["text"]][1]
        at = Counter()
        for x, n in shapes.items():
            at[hashing.indexOf(x)] += n
        norm = math.sqrt(sum(n * n for n in at.values())) or 1
        assert r["score"] == 1.0 if not r["n_words"] else abs(r["score"] - 1 / (1 + math.exp(-b - sum(w[i] * n / norm for i, n in at.items())))) < 1e-9


def test_quality_training_rows_are_bounded(spark):
    """One row that makes up most of a table enters the fit once."""
    text = "An ordinary sentence of words that differ goes on, for more than twenty words, so that the labellers have something to say about it."
    rows = spark.range(20_000).select(F.when(F.col("id") < 19_000, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 19_000, text).otherwise(F.concat(F.lit("### !!! $$$ "), F.col("id").cast("string"))).alias("text"))
    model = quality_model.fit(quality_model.featured(rows, "text"), key=F.col("doc_id"), train_rows=1_000_000)
    assert model.scorer is not None and model.scorer.summary.predictions.count() <= 2 * 1001


def test_weak_labels_recover_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.8
    accuracy = np.linspace(0.7, 0.95, quality_model.LABELLERS)
    votes = np.where(rng.random((4000, len(accuracy))) < accuracy, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.3] = quality_model.NONE
    patterns, counts = np.unique((votes * 3 ** np.arange(len(accuracy))).sum(1), return_counts=True)
    found = quality_model.fit_labels(patterns, counts.astype(float))
    assert abs(found.prior - truth.mean()) < 0.03
    assert np.abs(found.right[:, 1, 1] - accuracy).max() < 0.05


# 3: approximate nearest neighbours


def exact_neighbours(ids, x, queries_, k):
    out = {}
    for q in queries_:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
        out[q] = sorted((s, i) for s, i in zip(d, ids, strict=True) if i != q)[:k]
    return out


def test_ann_recall_and_exact_scores(spark):
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)
    truth = exact_neighbours(ids, x, [i for i in ids if i % 100 == 0], 10)
    got = defaultdict(list)
    for r in queries.op3_neighbours(spark, d).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    assert set(got) == set(truth)
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in t}) / 10 for q, t in truth.items()]) >= 0.9
    own = {i: v for i, v in zip(ids, x, strict=True)}
    for q, found in got.items():
        assert found == sorted(found) and len(found) == 10 and q not in {i for _, i in found}
        assert np.allclose([s for s, _ in found], [np.linalg.norm(own[q] - own[i]) for _, i in found], rtol=1e-12)


def test_ann_odd_vectors(spark):
    v = lambda *a: [float(c) if c is not None else None for c in a]
    rows = [(0, v(1, 0)), (1, v(1, 0)), (2, v(1, 0)), (3, v(0, 0)), (4, None), (5, v(1, None)), (6, v(float("nan"), 1)), (7, v(float("inf"), 1)), (8, v(1, 2, 3)), (9, v(0, 3)), (None, v(1, 1)), (100, v(0, 1)), (1, v(1, 0))]
    df = spark.createDataFrame([(i, e, 0.5) for i, e in rows], "vec_id long, embedding array<double>, score double")
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.search(df, F.col("vec_id") % 100 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 1, 0.0), (0, 3, 2, 0.0), (100, 1, 0, 1.414214), (100, 2, 1, 1.414214), (100, 3, 1, 1.414214)]
    assert ann.search(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_ann_extreme_and_rare_vectors(spark):
    """Components of any finite size are ranked by their true distance; each length meets its like."""
    rows = [(100, [1e200, 0.0]), (1, [1e200, 3e190]), (2, [1e200, 1e190]), (3, [-1e200, 0.0]), (200, [1.0, 2.0, 3.0]), (4, [1.0, 2.0, 4.0]), (300, [1e-200, 0.0]), (5, [3e-200, 0.0]), (6, [2e-200, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 100 == 0, k=2).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert [i for i, _ in got[100]] == [2, 1] and np.allclose([x for _, x in got[100]], [1e190, 3e190], rtol=1e-12)
    assert got[200] == [(4, 1.0)]
    assert [i for i, _ in got[300]] == [6, 5] and np.allclose([x for _, x in got[300]], [1e-200, 2e-200], rtol=1e-12, atol=0)


# 4: HTML


def test_html_article_blocks(spark, sf_dir):
    import html as h

    for r in queries.op4_html(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"]).collect():
        body = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = (" ".join(h.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", body))
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a> Site</header><div id="cookie-notice">We use cookies, ok.</div>
<main><div class=content><h2>Title</h2><p>Some long text, with punctuation. And more &lt;text&gt;&nbsp;here, really.<p>Next <b>one</b><br>goes on.
<ul><li>One point here.</li><li>Two</li></ul><ul><li><a href=1>Menu a</a><li><a href=2>Menu b</a></ul><form><input><label>Name</label></form><script>var x = "</p>";</script>
<div class="comments"><article class="comment"><p>Nice post, I like it very much. Thanks, really.</p></article></div></div></main><aside>Side text, with words.</aside><footer>&copy; me</footer></body>"""


def test_html_cases(spark):
    assert html_extract.main_text(PAGE) == "Title\n\nSome long text, with punctuation. And more <text> here, really.\n\nNext one goes on.\n\nOne point here.\n\nTwo"
    assert html_extract.main_text("plain <b>text</b>") == "plain text"
    assert html_extract.main_text('<nav>a, b</nav><div class="ad">Buy, now. All of it.</div>') == ""
    assert html_extract.main_text("<article>" + "<p>open <div>x" * 300).count("x") == 300
    df = spark.createDataFrame([(1, "u", None, "t"), (1, "u", "", "t"), (None, None, "<p>a, b.</p>", "t")], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"], r["text"]) for r in html_extract.extract(df).collect() if r["page_id"]) == [(1, ""), (1, "")]
    assert html_extract.extract(df.limit(0)).count() == 0


LONG = "Some long text, with punctuation. And more of it here, really; much more."


def long_blocks(n):
    return f"<p>{LONG}</p>" * n, [LONG] * n


def test_html_ratios_decide(spark, sf_dir, monkeypatch):
    """With all paths' ratios equal, every page's text is another."""
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    texts, real = [html_extract.main_text(p) for p in pages], html_extract.path_ratios
    monkeypatch.setattr(html_extract, "path_ratios", lambda *a: tuple(dict.fromkeys(x, 1.0) for x in real(*a)))
    assert all(html_extract.main_text(p) != t for p, t in zip(pages, texts, strict=True))


def test_html_pages_without_marks(spark, sf_dir):
    """Without article, nav and footer elements, ratios and names find most texts."""
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    for swaps, share in (((("article", "div"),), 1.0), ((("article", "div"), ("nav>", "div>"), ("footer>", "section>"), ('"ad"', '"x1"')), 0.6)):
        same = 0
        for page in pages:
            bare = page
            for a, b in swaps:
                bare = bare.replace(a, b)
            same += html_extract.main_text(bare) == html_extract.main_text(page)
        assert same >= share * len(pages)


@pytest.mark.parametrize(
    "page, blocks",
    [
        (f"<article><h2><a href=1>A heading that links</a></h2><p>{LONG}</p><p><a href=2>A paragraph that is one link</a></p><p>{LONG}</p></article>", ["A heading that links", LONG, "A paragraph that is one link", LONG]),
        (f'<article><div class="side-by-side"><p>{LONG}</p></div><p>{LONG}</p><div class="related-work"><p>{LONG}</p></div></article>', [LONG] * 3),
        (f'<article><p>{LONG}</p><p>Text <span class="ad">Buy now!</span> goes on.</p></article>', [LONG, "Text goes on."]),
        (f"<main><p>{LONG}</p><ol><li><a href=1>Smith, J. A title. Journal, 2019.</a></li><li><a href=1>Doe, A. A title. Journal, 2020.</a></li></ol></main>", [LONG, "Smith, J. A title. Journal, 2019.", "Doe, A. A title. Journal, 2020."]),
        ("<article><h1>T</h1><p><a href=1>all of it a link</a></p></article>", ["T", "all of it a link"]),
        (f"<div><p>{LONG}</p><a name=top><p>{LONG}</p><p>{LONG}</p></div><div class=comments><p>{'Nice post, I like it. ' * 40}</p></div>", [LONG] * 3),
        (f"<div id=c><h1>Title</h1><div class=b><p>{LONG}</p><p>{LONG}</p><ul><li>One</li><li>Two</li></ul></div></div><div class=x><ul>{'<li><a href=1>Menu</a></li>' * 6}</ul></div><div><p>Small promo.</p></div>", ["Title", LONG, LONG, "One", "Two"]),
        (f'<article><p>{LONG}</p><p class="x>Raw, text.</p><p>{LONG}</p></article>', [LONG, "Raw, text.", LONG]),
        ("<div><a href=1>Home page</a> <a href=2>About us</a></div>", []),
        (f'<body><form action=1><input type=hidden><header>Site</header><article><h1>T</h1><p>{LONG}</p></article><footer>me</footer></form></body>', ["T", LONG]),
        (f'<body><form id="form1"><div class=c><p>{LONG}</p><p>{LONG}</p></div><div class=m><a href=1>Menu</a></div></form></body>', [LONG, LONG]),
        (f'<article><p>{LONG}</p><form><p>Your name, please.</p></form><h2 id="search">Search</h2><p>{LONG}</p><section id="comments-on-method"><p>Short, too.</p></section></article>', [LONG, "Search", LONG, "Short, too."]),
        (f'<article><p>{LONG}</p><div class="related-work"><p>Brief.</p></div><section id="comments"><p>{LONG}</p></section></article>', [LONG, "Brief."]),
        ("a < b, and c > d", ["a < b, and c > d"]),
        (f"<article><p>{LONG}</p>" + "<div>" * 5000 + "<nav>menu, one.</nav>" + "</div>" * 5000 + "</article>", [LONG]),
    ],
)
def test_html_by_ratio(page, blocks):
    assert html_extract.main_text(page) == "\n\n".join(blocks)


@pytest.mark.parametrize("page", ["<a " * 330_000, "<div>x" * 150_000, '<a x=">"' * 120_000, "<td><ul>" + "<x>" * 60_000 + "<td></td>" * 60_000, "<svg>" * 200_000, "<p>" * 300_000, "</a" * 300_000, "<!-- " * 200_000])
def test_html_hostile_pages_take_linear_time(page):
    began = time.perf_counter()
    html_extract.main_text(page)
    assert time.perf_counter() - began < 8  # a second or two on an idle core


# 5: sharding


def test_shards_compact_and_conflict(spark, odd):
    path = scratch_path(spark, "test-shards")
    store = shards.ShardStore(spark, path, odd.schema)
    assert store.read().count() == 0 and store.versions() == []
    for _ in range(2):
        store.append(odd.repartition(3))
    assert store.versions() == [1, 2] and len(store.manifest()) == 6
    assert store.append(odd.limit(0)) == 3
    version = store.compact_all()
    assert version == 4 and len(store.manifest()) == 1 and len(store.manifest(2)) == 6
    count = lambda df: Counter(map(tuple, df.collect()))
    assert count(store.read()) == count(store.read(2)) == count(odd.unionByName(odd))
    assert store.compact() == 4
    with pytest.raises(shards.Conflict):
        store.commit(3, [])
    store.vacuum(keep=2)  # the empty arrival's files go
    assert store.versions() == [3, 4] and count(store.read(3)) == count(store.read())
    assert store.vacuum(keep=1) == 6 and store.versions() == [4]
    assert count(store.read()) == count(odd.unionByName(odd))


def test_shards_lose_no_writer(spark, monkeypatch):
    """Writers that meet: one commits, the other gets Conflict, and all rows are there in the end."""
    path, schema = scratch_path(spark, "test-writers"), spark.range(1).schema
    one, two = (shards.ShardStore(spark, path, schema) for _ in range(2))
    part = lambda k: spark.range(100 * k, 100 * k + 100).coalesce(2)
    real, met = shards.ShardStore.commit, []

    def late(self, base, added, gone=()):  # the other writer commits between plan and commit
        if not met:
            met.append(base)
            two.append(part(1))
        try:
            return real(self, base, added, gone)
        except shards.Conflict:
            met.append("conflict")
            raise

    monkeypatch.setattr(one, "commit", late.__get__(one))
    assert one.append(part(0)) == 2 and met == [0, "conflict"]
    assert sorted(r["id"] for r in one.read().collect()) == list(range(200))
    met.clear()
    assert one.compact() == 4 and met == [2, "conflict"]  # the arrival in between stays beside the merged run
    assert sorted(r["id"] for r in one.read().collect()) == sorted([*range(200), *range(100, 200)])
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: shards.ShardStore(spark, path, schema).append(part(k)), range(2, 8)))
    two.compact_all()
    assert sorted(r["id"] for r in one.read().collect()) == sorted([*range(800), *range(100, 200)])


def test_op5_merges_a_table_of_one_file(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = shards.ShardStore(spark, scratch_path(spark, "test-op5"), docs.schema)
    shards.arrive(store, docs, "doc_id")
    ids = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    held = lambda: sorted(r["doc_id"] for r in store.read().select("doc_id").collect())
    assert store.versions() == list(range(1, 13)) and len(store.manifest()) == 12 and store.read().columns == docs.columns
    assert store.vacuum(keep=1) == 0 and held() == ids
    assert len(store.manifest(store.compact_all())) == 1 and store.vacuum(keep=1) == 12 and held() == ids


def test_tiers_merge_similar_sizes():
    store = shards.ShardStore.__new__(shards.ShardStore)
    store.target = shards.TARGET_BYTES
    small, mid, large = (shards.Shard(f"{k}", n, 1, shards.tier_of(n)) for k, n in enumerate((1000, 20 << 20, 120 << 20)))
    assert store.runs([small] * 3 + [mid] * 4 + [large] * 9) == [[mid] * 4]


# 6: near duplicates


def plain_fingerprint(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = sorted(prints)
    for k, a in enumerate(known):
        for b in known[:k]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {f: find(f) for f in prints}


def test_simhash_equals_plain(spark, sf_dir, docs):
    prints = {i: plain_fingerprint(t) for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    group = plain_components(set(prints.values()))
    least = defaultdict(lambda: 1 << 60)
    for i, f in prints.items():
        least[group[f]] = min(least[group[f]], i)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op6_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{f:016x}", least[group[f]]) for i, f in prints.items()}


def test_simhash_dense_group(spark):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 1 << 62))
    prints = {base} | {base ^ int(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))) for _ in range(300)} | {int(x) for x in rng.integers(0, 1 << 62, 50)}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(k, signed(f)) for k, f in enumerate(sorted(prints))], "doc_id long, fp long")
    group = plain_components(prints)
    ids = {f: k for k, f in enumerate(sorted(prints))}
    want = {ids[f]: min(ids[g] for g in prints if group[g] == group[f]) for f in prints}
    assert {r["doc_id"]: r["component_id"] for r in simhash.assign(df).collect()} == want


def test_simhash_fingerprint_of_most_rows(spark):
    """Rows of a fingerprint that a third of all rows and more share are joined back whole."""
    rows = [(k, "" if k % 3 else f"word{k} one two three") for k in range(6000)] + [(None, "")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert len(got) == 6001 and (got["fp"] == 0).sum() >= 4001
    assert set(got[got["fp"] == 0]["component_id"]) == {got[got["fp"] == 0]["doc_id"].min()}


def test_simhash_positions_cover_six_of_eight():
    assert len(simhash.QUADS) == 14
    for left in combinations(range(8), 6):
        inside = [set(q) for q in simhash.QUADS if set(q) <= set(left)]
        assert len(inside) >= 3 and set().union(*inside) == set(left)


def test_simhash_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {r["component_id"] for r in got if r["doc_id"] in (2, 3, 4)} == {2}
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert simhash.near_duplicates(empty).count() == 0


def test_similar_copies_go(spark, odd, empty):
    kept = simhash.drop_similar(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 2, 5, 6, 7, 8, 9, 10]
    assert simhash.drop_similar(empty).count() == 0
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in rng.integers(0, 10**6, 300)]
    rows = [(0, " ".join(words))]
    for k in range(1, 60):  # one word changed keeps the similarity over 0.8, 40 words do not
        changed = list(words)
        for at in rng.choice(300, 40 if k % 10 == 0 else 1, replace=False):
            changed[at] = f"x{k}_{at}"
        rows.append((k, " ".join(changed)))
    got = {r["doc_id"] for r in simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0, 10, 20, 30, 40, 50}


def test_similar_copies_on_one_template(spark):
    # Documents on a template are alike at 0.71; 400 of them have one near copy each, at 0.81.
    rng = np.random.default_rng(6)
    template, rows = [f"t{k}" for k in range(100)], []
    for k in range(401):
        own = [f"d{k}_{j}" for j in range(20)]
        rows.append((2 * k, " ".join(template + own)))
        if k:  # the least has no near copy
            rows.append((2 * k + 1, " ".join([*template, *own[:8], *(f"e{k}_{j}" for j in range(12))])))
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(i), str(t)) for i, t in rows], "doc_id long, text string")
    got = sorted(r["doc_id"] for r in simhash.drop_similar(df).collect())
    assert len(got) == 401 and got == list(range(0, 802, 2))


def test_similar_pairs_are_verified(spark):
    # Signatures that agree in full and in 0.66 of their bytes, of texts under and at the similarity.
    w = [f"w{k}" for k in range(100)]
    texts = [w, [*w[:88], *(f"x{k}" for k in range(12))], [f"y{k}" for k in range(100)], [*(f"y{k}" for k in range(92)), *(f"z{k}" for k in range(8))]]
    sig = bytes(range(128))
    sigs = [sig, sig[:127] + b"x", bytes(range(128, 256)), bytes(range(128, 128 + 85)) + bytes(43)]
    classes = spark.createDataFrame(list(enumerate(map(bytearray, sigs))), "cid long, sig binary")
    links = simhash.similar_links(classes, spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "cid long, text string"))
    assert {(r["a"], r["b"]) for r in links.collect() if r["a"] != r["b"]} == {(3, 2)}
    # What the index and the tally miss at the similarity itself.
    p = simhash.SIMILARITY + (1 - simhash.SIMILARITY) / 256
    least = simhash.NEVER + (1 - simhash.NEVER) / 256
    under = sum(math.comb(128, k) * p**k * (1 - p) ** (128 - k) for k in range(math.ceil(128 * least)))
    assert under < 1e-6 and (1 - p**4) ** simhash.KEYS < 1e-6


# 7: packing


def test_packing_is_whole(spark, sf_dir, odd, empty, docs):
    t = Tokenizer.from_file(BYTE_BPE)
    for df, texts in ((spark.read.parquet(f"{sf_dir}/documents.parquet"), dict(zip(docs["doc_id"], docs["text"], strict=True))), (odd.where("doc_id <> 5"), {i: x for i, x in ODD if i not in (5, None)})):
        pieces = packing.pack(df, BYTE_BPE).toPandas()
        ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in texts.items()}
        for i, own in pieces.groupby("doc_id"):
            own = own.sort_values("start")
            assert list(own["start"]) == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() == len(ids[i]) == own["doc_tokens"].iloc[0]
            for p in own.itertuples():
                assert p.ids_crc32 == zlib.crc32(np.array(ids[i][p.start : p.start + p.length], "<u4").tobytes())
        assert set(pieces["doc_id"]) == set(ids)
        lengths, padding = pieces.groupby("sequence_id")["length"].sum(), 0
        for _, own in pieces.groupby("sequence_id"):
            own = own.sort_values("offset")
            assert list(own["offset"]) == [0, *np.cumsum(own["length"])[:-1]]
        for n in lengths:
            assert n <= 1024
            padding += 0 if n & (n - 1) == 0 else 1024 - n
        assert padding == 0
    twice = packing.pack(odd, BYTE_BPE).where("doc_id = 5").toPandas()
    assert len(twice) == 2 and packing.pack(odd, BYTE_BPE).where("doc_id is null").count() >= 1 and packing.pack(empty, BYTE_BPE).count() == 0


def test_encoder_equals_library():
    u, t = packing.encoder(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    rng = np.random.default_rng(5)
    parts = ["a", "b", "The", " ", " ", " ", "\n", "\t", "  ", "\u3000", "\x85", "é", "中文", "'s", "don't", "<|endoftext|>", "12", "!!", "\r\n", "\x1f", "x\n", "\u200b"]
    plain = ["a", "The", " ", " ", "é", "中文", "'s", "12", "!!", "x\ny"]
    made = ["".join(rng.choice(p, rng.integers(0, 14))) for p in (parts, plain) for _ in range(3000)]
    for texts in ([], [""], ["", ""], ["word"], [" "], [x or "" for _, x in ODD], *(made[k : k + 40] for k in range(0, len(made), 40))):
        got = [np.frombuffer(ids, "<u4").tolist() for ids in u.batch(texts)]
        assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_neighbours_share_a_window():
    rng = np.random.default_rng(0)
    topics = [rng.integers(100 * k, 100 * k + 100, (8, 256)).astype("<u4") for k in range(1, 9)]
    docs = [topics[k % 8][k // 8] for k in range(64)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=1000)
    weights = np.log1p((64 - df + 0.5) / (df + 0.5)).astype("f4")
    windows = defaultdict(set)
    for s, d, _, _ in packing.order_by_neighbours(docs, weights, 256, 1024):
        windows[s].add(d % 8)
    assert all(len(w) == 1 for w in windows.values())


def test_neighbours_equal_plain_bm25():
    """Each window's fills are the best unused ones by scores computed pair by pair."""
    rng = np.random.default_rng(3)
    docs = [rng.zipf(1.3, rng.integers(5, 300)).clip(max=900).astype("<u4") for _ in range(150)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=901)
    weights, mean = np.log1p((150 - df + 0.5) / (df + 0.5)).astype("f4"), float(np.mean([len(d) for d in docs]))
    counts = [Counter(d.tolist()) for d in docs]

    def score(a, b):
        k1, b_ = packing.K1, packing.B
        return sum(weights[t] * n * (k1 + 1) / (n + k1 * (1 - b_ + b_ * len(docs[b]) / mean)) for t, n in counts[b].items() if t in counts[a])

    windows, used, fills = defaultdict(list), set(), 0
    for s, d, start, n in packing.order_by_neighbours(docs, weights, mean, 1024):
        windows[s].append((d, start, n))
    for s in sorted(windows):
        (seed, _, _), *filled = windows[s]
        used.add(seed)
        for d, start, _ in filled:
            best = max(score(seed, x) for x in range(150) if x not in used)
            assert start == 0 and score(seed, d) >= best * (1 - 1e-4) > 0
            used.add(d)
            fills += 1
    assert used == set(range(150)) and fills > 100


def test_packing_spreads_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 32)
    rows = spark.range(600).select(F.when(F.col("id") < 300, 7).alias("doc_id"), F.when(F.col("id") < 300, "the same row").alias("text"))
    pieces = packing.pack(rows, BYTE_BPE).toPandas()
    assert pieces["length"].sum() == 300 * 4 + 300 and (pieces.groupby(pieces["sequence_id"] // (1 << 32))["length"].sum() < 1024).all()


def test_neighbours_share_a_shard(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 32)
    rng = np.random.default_rng(1)
    words = rng.permutation([f"{a}{b}" for a in "bcdfghjklm" for b in ("ark", "end", "ill", "ost", "unt", "ash", "eel", "ive")])
    rows = [(k, " ".join(rng.choice(words[10 * (k % 8) : 10 * (k % 8) + 10], 60))) for k in range(512)] + [(1000 + k, "one text") for k in range(200)]
    pieces = packing.pack(spark.createDataFrame([(int(i), str(t)) for i, t in rows], "doc_id long, text string"), BYTE_BPE).toPandas()
    pieces["shard"] = pieces["sequence_id"] // (1 << 32)
    own = pieces[pieces["doc_id"] < 512].drop_duplicates("doc_id")
    topics = own.groupby("shard")["doc_id"].agg(lambda d: np.bincount(d % 8).max())
    assert topics.sum() >= 0.8 * 512  # one in eight or so if dealt at random
    assert pieces.groupby("shard")["doc_id"].nunique().max() <= 128


# 8: chat


def test_chat_layouts(spark):
    records = [
        '{"messages":[{"role":"user","content":"a <|end|> ~0 [x]"},{"role":"assistant","content":null}]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"r|s"}]}',
        '{"prompt":"p","response":"r"}', '{"instruction":"do","input":"this","output":"done"}', '{"instruction":"do","input":"","output":"done"}', '{"what":1}', '{"messages":[]}',
    ]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(records)], "id long, r string").withColumn("v", F.parse_json("r"))
    turns = chat.canonical_turns(df, id_col="id", record_col="v")
    got = {r["conv_id"]: (r["layout"], [(t["role"], t["text"]) for t in r["turns"]]) for r in turns.collect()}
    assert got[0] == ("messages", [("user", "a <|end|> ~0 [x]"), ("assistant", "")])
    assert got[1] == ("from_value", [("user", "q"), ("assistant", "r|s")])
    assert got[3][1] == [("user", "do\n\nthis"), ("assistant", "done")] and got[4][1] == [("user", "do"), ("assistant", "done")]
    assert got[5] == (None, []) and got[2][0] == "prompt_response"
    out = chat.format_turns(turns.select("conv_id", "turns"))
    back = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("l")).collect()
    for r in back:
        assert [(t["role"], t["text"]) for t in r["t"]] == got[r["conv_id"]][1]
        assert r["l"] == "".join(t for role, t in got[r["conv_id"]][1] if role == "assistant")
        assert r["formatted"].count("<|end|>") == len(r["t"])


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (None, 0, "user", "x"), (2, 5, None, "y"), (2, 5, None, "y"), *((3, k, "assistant" if k % 2 else "user", f"t{k} <") for k in range(700))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat.canonical_turns(chat.gather(df), id_col="conv_id", record_col="record")
    out = {r["conv_id"]: r for r in chat.format_turns(turns.select("conv_id", "turns")).select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("l")).collect()}
    assert [tuple(t) for t in out[1]["t"]] == [("user", ""), ("assistant", "b")] and out[1]["l"] == "b"
    assert [tuple(t) for t in out[2]["t"]] == [("", "y"), ("", "y")] and [tuple(t) for t in out[None]["t"]] == [("user", "x")]
    assert out[3]["l"] == "".join(f"t{k} <" for k in range(1, 700, 2))
    assert chat.gather(df.limit(0)).count() == 0


def test_chat_roles_stay_and_null_ids_stand_alone(spark):
    """Other role names keep their spelling and stay out of the loss; extra columns may have any name."""
    said = [(7, 0, "human"), (7, 1, "gpt"), (7, 2, "assistant"), (8, 0, "bot"), (8, 1, "model"), (None, 0, "user"), (None, 0, "user"), (None, 1, "assistant")]
    rows = [(c, t, r, f"{r} says", 1, "x", 2, "y", "z") for c, t, r in said]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, t long, record string, alone long, turns string, content string")
    turns = chat.canonical_turns(chat.gather(df), id_col="conv_id", record_col="record")
    out = chat.format_turns(turns.select("conv_id", "turns")).select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("l")).collect()
    found = {r["conv_id"]: ([t["role"] for t in r["t"]], r["l"]) for r in out if r["conv_id"]}
    assert found == {7: (["human", "gpt", "assistant"], "assistant says"), 8: (["bot", "model"], "")}
    assert sorted(r["l"] for r in out if r["conv_id"] is None) == ["", "", "assistant says"]


def test_chat_long_conversation(spark):
    df = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("<|~["), F.col("id").cast("string")).alias("text"))
    turns = chat.canonical_turns(chat.gather(df), id_col="conv_id", record_col="record")
    (r,) = chat.format_turns(turns.select("conv_id", "turns")).select(chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("l")).collect()
    assert [t["text"] for t in r["t"]] == [f"<|~[{k}" for k in range(20_000)]
    assert r["l"] == "".join(f"<|~[{k}" for k in range(1, 20_000, 2))


# 9: secrets


def plain_base(text):
    text = text or ""
    assign = re.finditer(r"(?a:(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))", text)
    spans = [(m.start(), 0, m.end()) for m in assign if len(m[1]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_secrets_base_and_dense(spark, sf_dir, docs):
    for r in queries.op9_secrets(spark, sf_dir).collect():
        text = docs.set_index("doc_id")["text"][r["doc_id"]]
        base = plain_base(text)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("dense")] == [s for s in base.split(",") if s]
    spans = lambda t: [(secret_scan.KINDS[k], t[a:b]) for a, k, b in secret_scan.spans_of(t, RANKS)]
    random_key = "xK9fQ2mZ7pL4vT8wR1sB6nY3"
    assert spans(f"use {random_key} now") == [("dense", random_key)]
    assert spans("id 123e4567-e89b-12d3-a456-426614174000 v1.22.333.4444-build7 2024-01-02T03:04:05+00") == []
    assert spans("sha D41D8CD98F00B204E9800998ECF8427E") == [] and spans("internationalization2024") == [] and spans("see https://x.example/aB3dE5fG7hI9jK1lM3nO5pQ7") == []
    assert spans('TOKEN = "abcdefghijkl"') == [("assign", 'TOKEN = "abcdefghijkl')] and spans("token=short") == [] and spans("tooken: abcdefghijkl") == []


def test_secrets_beside_dots_and_slashes():
    found = lambda t: [t[a:b] for a, _, b in secret_scan.spans_of(t, RANKS)]
    one, two = "xK9fQ2mZ7pL4vT8wR1sB6nY3", "Hq7Wc3Zt9Lr2Vb8Nx5Jd1Mg6Ks4Py0Fa"
    assert found(f"SG.{one}.{two} x") == [one, two] and found(f"The end.{one} and") == [one]
    assert found(f"eyJhbGciOiJIUzI1NiJ9.{one}.{two}")[-2:] == [one, two]
    assert found(f"x {one}//{two}") == [f"{one}//{two}"] and found(f"2024-01-02-{two}") == [f"2024-01-02-{two}"]
    letters = "xKfQzmZqpLjvTgwRhsBnYcWd"
    assert found(f"use {letters} now") == [letters] and found(f"12-34-{two}") == [f"12-34-{two}"]
    assert found('{"u":"https://a.example/b","k":"' + one + '"}') == [one] and found(f"https://a.example/p?k={one}") != []
    for t in (f"https://a.example/{one}", f"see a.example.com/{one}/b", f"{one}@mail.example", f"ftp://user:{one}@host.example", "-" * 40, "2024-01-02T03-04-05-123456Z", "getElementsByTagNameAndClass"):
        assert found(t) == [], t


def test_secrets_many_spans_take_linear_time():
    text = " ".join(f"{'0123456789abcdef' * 2} Zk3xQ9vB7wLm2Rt8Yp4N{k:05d}Hd6Js1Gf" for k in range(20_000))
    began = time.perf_counter()
    assert Counter(k for _, k, _ in secret_scan.spans_of(text, RANKS))[3] == 20_000
    assert time.perf_counter() - began < 20  # a second or two on an idle core


def test_secrets_odd_rows(odd, empty):
    assert secret_scan.scan(odd, RANKS).count() == len(ODD) and secret_scan.scan(empty, RANKS).count() == 0
    done = secret_scan.redact(odd, RANKS)
    assert done.columns == odd.columns and Counter(map(tuple, done.collect())) == Counter(map(tuple, odd.collect()))
    assert secret_scan.masked("a password=0123456789abcdef01 b", RANKS, "#") == "a # b"


# 10: rules


def plain_rules(text):
    text = text or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    win = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    count, hit = Counter(win), set()
    for k, x in enumerate(win):
        if count[x] > 1:
            hit.update(range(k, k + 8))
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_rules_equal_plain(spark, odd, empty):
    extra = [(20, "a b c d e f g h " * 5), (21, "x\nx\n \n x\nx"), (22, " ".join(map(str, range(50))) + "\n" + " ".join(map(str, range(20, 40))))]
    rows = [(i, t, 0, "x", "y", 1, 2) for i, t in extra]
    df = odd.unionByName(spark.createDataFrame(rows, SCHEMA))
    got = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rules.ledger(df).collect()]
    assert Counter(got) == Counter((i, *plain_rules(t)) for i, t in [*ODD, *extra])
    assert rules.ledger(empty).count() == 0 and rules.keep_good(empty, "prose-1").columns == empty.columns
    assert sorted(r["doc_id"] for r in rules.keep_good(df, "base-1").collect()) == sorted(i for i, t in [*ODD, *extra] if plain_rules(t)[0] >= 20 and 100 * plain_rules(t)[4] <= 30 * plain_rules(t)[0])


def test_ablation(spark, sf_dir):
    rows = rules.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    bits = [r["failed"] for r in rows.collect()]
    got = {r["rule"]: (r["n_failed"], r["n_only"]) for r in rules.ablation(rows, "prose-1").collect()}
    assert got == {n: (sum(b >> rules.RULES[n].bit & 1 for b in bits), sum(b == 1 << rules.RULES[n].bit for b in bits)) for n in rules.POLICIES["prose-1"]}

"""The pipeline's stages against plain versions on the small tables."""

from __future__ import annotations

import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sitewright.llm import quality_model, secret_scan
from tests.llm.test_operators import plain_rules

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, rid long"


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Each stage's result, run one after the other."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = stage(spark, docs, sf_dir).cache()
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "rules", "near_duplicates", "secrets", "packing"]
    for name in ("quality", "rules", "near_duplicates", "secrets"):
        assert stages[name].columns == stages["documents"].columns


def test_quality_follows_the_classifier(stages):
    kept = quality_model.classify(stages["documents"]).where("kept")
    assert ids(stages["quality"]) == ids(kept)


def test_rules_equal_plain(stages):
    want = []
    for r in stages["quality"].collect():
        n, chars, symbols, dup, repeat = plain_rules(r["text"])
        lines = [x for x in r["text"].split("\n") if x.strip(" \t\n\v\f\r")]
        upper = sum(c.isupper() and c.lower() != c for c in r["text"])
        if n >= 20 and 100 * repeat <= 30 * n and 10 * symbols <= n and 10 * upper <= 3 * chars and not (len(lines) > 4 and 2 * dup > len(lines)) and chars <= 25 * n:
            want.append(r["doc_id"])
    assert ids(stages["rules"]) == sorted(want)


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text).split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_one_of_each_group_stays(stages):
    sets = {r["doc_id"]: shingles(r["text"]) for r in stages["rules"].collect()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = sorted(sets)
    for k, a in enumerate(known):
        for b in known[:k]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert ids(stages["near_duplicates"]) == sorted({find(d) for d in sets})


def test_secrets_are_masked_and_all_tokens_packed(stages):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    before = {r["doc_id"]: r["text"] for r in stages["near_duplicates"].collect()}
    after = {r["doc_id"]: r["text"] for r in stages["secrets"].collect()}
    assert after == {d: secret_scan.masked(t, ranks, "[secret]") for d, t in before.items()}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = Counter()
    for r in stages["packing"].collect():
        packed[r["doc_id"]] += r["length"]
    assert packed == {d: len(t.encode(x, add_special_tokens=False).ids) + 1 for d, x in after.items()}


def test_odd_rows_and_empty_table(spark, sf_dir):
    rows = [(1, None, None, None, None, 0.5, 7), (2, "", "en", "s", 0, None, 7), (None, "a b c " * 30, "en", "s", 1, 0.1, 7), (3, "An ordinary sentence, of words that differ, goes on for more than twenty words so that the rules have nothing to say against it here.", "en", "s", 5, 0.1, 7)]
    rows += rows[-1:]
    for df in (spark.createDataFrame(rows, EXTRA), spark.createDataFrame([], EXTRA)):
        docs = df
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            if name != "packing":
                assert docs.columns == df.columns
                docs = docs.cache()
        assert docs.select("doc_id").distinct().count() == min(1, df.count())

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from talktide.llm import ngram
from talktide.llm.queries import op2_ngram_trie


def brute(docs):
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), ""]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    one, two = Counter(), Counter()
    for i, t in docs:
        if not out(i):
            one.update(split(t))
            two.update(zip(["", *split(t)[:-1]], split(t), strict=True))
    n, v = sum(one.values()), len(one)
    p1 = lambda w: (one[w] + 0.5) / (n + 0.5 * (v + 1))
    code = lambda p: min(round(-math.log10(p) * ngram.STEPS), 65535)
    rows = []
    for i, t in docs:
        words, total = split(t), 0
        for a, b in zip(["", *words[:-1]], words, strict=True):
            if two[a, b]:
                total += code((two[a, b] + ngram.MU * p1(b)) / (one[a] + ngram.MU))
            else:
                total += code(p1(b)) + code(ngram.MU / (one[a] + ngram.MU))
        rows.append((str(i), out(i), len(words), sum(one[w] > 0 for w in words), n, sum(math.log10(p1(w)) for w in words), -total / ngram.STEPS))
    return sorted(rows)


def same(found, known):
    found = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found)
    assert [r[:5] for r in found] == [r[:5] for r in known]
    for k in (5, 6):
        assert [r[k] for r in found] == pytest.approx([r[k] for r in known], rel=1e-6, abs=2e-3)


def test_elias_fano():
    draw = np.random.default_rng(1)
    for n, u in ((0, 10), (1, 1), (5, 5), (1000, 3000), (1000, 1 << 63), (300, 301)):
        values = np.sort(draw.choice(u, n, replace=False)) if u < 1e5 else np.sort(draw.integers(0, u, n, np.uint64))
        own = ngram.EliasFano.of(ngram.EliasFano.encode(values, u))
        assert own[np.arange(n)].tolist() == values.tolist()
        ask = np.unique(np.r_[values.astype(np.uint64), draw.integers(0, u, 500).astype(np.uint64), np.uint64(1 << 63), np.uint64((1 << 64) - 1)])
        at, there = own.successor(ask)
        assert at.tolist() == np.searchsorted(values.astype(np.uint64), ask).tolist()
        assert there.tolist() == np.isin(ask, values.astype(np.uint64)).tolist()


def test_small_table(spark, small, awkward, empty, monkeypatch):
    docs = awkward.select("doc_id", "text").union(small.select("doc_id", "text"))
    known = brute(docs.collect())
    same(ngram.score(docs).collect(), known)
    monkeypatch.setattr(ngram, "BLOCK_BYTES", 50_000)
    monkeypatch.setattr(ngram, "SHARD_BYTES", 300_000)
    same(ngram.score(docs.repartition(5)).collect(), known)
    same(ngram.score(awkward).collect(), brute(awkward.select("doc_id", "text").collect()))
    assert ngram.score(empty).count() == 0


def test_random_words(spark):
    draw = random.Random(4)
    docs = [(draw.randrange(100), " ".join(draw.choice("aAbcdé") for _ in range(draw.randrange(30)))) for _ in range(90)]
    same(ngram.score(spark.createDataFrame(docs, "doc_id long, text string")).collect(), brute(docs))


def test_query_predicts_better_than_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = op2_ngram_trie(spark, "/root/testdata/sf0.001").collect()
    same(rows, brute(docs))
    out = [r for r in rows if r.held_out]
    assert out and sum(r.score for r in out) > sum(r.base_score for r in out)

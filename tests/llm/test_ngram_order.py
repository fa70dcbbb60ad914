import math
import random
import re
import zlib
from collections import Counter

import pytest

from talktide.llm import ngram
from talktide.llm.queries import op2_ngram_trie


def brute(docs, order):
    """Scores by a model of the order: start, words, end; the first token of a text follows the start only."""
    split = lambda t: ["", *re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), ""]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    seen, after = Counter(), Counter()
    for i, t in docs:
        if not out(i):
            words = split(t)
            for at in range(1, len(words)):
                for k in range(1, min(order, at + 1) + 1):
                    seen[tuple(words[at + 1 - k : at + 1])] += 1
                    after[tuple(words[at + 1 - k : at])] += 1
    n, v = after[()], sum(len(gram) == 1 for gram in seen)
    p1 = lambda w: (seen[w] + 0.5) / (n + 0.5 * (v + 1))
    code = lambda p: min(round(-math.log10(p) * ngram.STEPS), 65535)

    def of(gram):
        if len(gram) == 1:
            return code(p1(gram))
        below = of(gram[1:])
        if not seen[gram]:
            return below + code(ngram.MU / (after[gram[:-1]] + ngram.MU))
        return code((seen[gram] + ngram.MU * (p1(gram[1:]) if len(gram) == 2 else 10 ** (-below / ngram.STEPS))) / (after[gram[:-1]] + ngram.MU))

    rows = []
    for i, t in docs:
        words = split(t)
        rows.append((str(i), out(i), -sum(of(tuple(words[max(at + 1 - order, 0) : at + 1])) for at in range(1, len(words))) / ngram.STEPS))
    return sorted(rows)


def same(found, known):
    found = sorted((str(r.doc_id), r.held_out, r.score) for r in found)
    assert [r[:2] for r in found] == [r[:2] for r in known]
    assert [r[2] for r in found] == pytest.approx([r[2] for r in known], rel=1e-6, abs=2e-3)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_orders(spark, awkward, empty, monkeypatch, order):
    draw = random.Random(order)
    docs = [(draw.randrange(100), " ".join(draw.choice("aAbcdé") for _ in range(draw.randrange(30)))) for _ in range(90)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").union(awkward.select("doc_id", "text"))
    known = brute(docs.collect(), order)
    same(ngram.score(docs, order=order).collect(), known)
    # shards so small that frequent contexts are split
    monkeypatch.setattr(ngram, "BLOCK_BYTES", 50_000)
    monkeypatch.setattr(ngram, "SHARD_BYTES", 20_000)
    same(ngram.score(docs.repartition(5), order=order).collect(), known)
    assert ngram.score(empty, order=order).count() == 0
    only_ends = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    same(ngram.score(only_ends, order=order).collect(), brute(only_ends.collect(), order))


def test_order_below_two(spark, empty):
    with pytest.raises(ValueError):
        ngram.score(empty, order=1)


def test_query_is_of_order_three(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    same(op2_ngram_trie(spark, "/root/testdata/sf0.001").collect(), brute(docs, 3))


def test_levels_are_mapped(tmp_path):
    arrays = [ngram.np.arange(5), ngram.np.arange(3, dtype="<u2"), ngram.np.zeros(0, "<u8"), ngram.np.arange(7, dtype="<u8")]
    ngram.stored(str(tmp_path / "x"), arrays)
    assert [x.tolist() for x in ngram.mapped(str(tmp_path / "x"))] == [x.tolist() for x in arrays]


def test_few_and_many_selected():
    raw = ngram.np.random.default_rng(2).integers(0, 2, 6400).astype("u1")
    bits = ngram.Bits(ngram._words(raw))
    for bit in (0, 1):
        places = ngram.np.flatnonzero(raw == bit)
        assert bits.select(ngram.np.arange(len(places)), bit).tolist() == places.tolist()
        assert [int(bits.select(ngram.np.array([k]), bit)[0]) for k in range(0, len(places), 7)] == places[::7].tolist()


def test_order_of_few_and_many_bits():
    draw = ngram.np.random.default_rng(3)
    for key in (draw.integers(0, 50, 1000), draw.integers(0, 50, 1000) << 55, ngram.np.zeros(0, int)):
        assert ngram._ordered(key).tolist() == ngram.np.argsort(key, kind="stable").tolist()

import random
import re

import numpy as np
import pytest
import xxhash

from talktide.llm import simhash
from talktide.llm.components import components
from talktide.llm.queries import op5_simhash


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(len(words) - 3, 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(items, linked):
    up = list(range(len(items)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(items))]


def brute(docs, bits=4):
    fps = [(i, fingerprint(t)) for i, t in docs]
    root = classes([f for _, f in fps], lambda x, y: (x ^ y).bit_count() <= bits)
    least = {}
    for (i, _), r in zip(fps, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted((str(i), f"{f:016x}", least.get(r)) for (i, f), r in zip(fps, root, strict=True))


def rows(df):
    return sorted((str(r.doc_id), f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in df.collect())


def cluster(draw, n, flips):
    out, centre = [], draw.getrandbits(64)
    for _ in range(n):
        x = centre
        for b in draw.sample(range(64), flips):
            x ^= 1 << b
        out.append(x)
    return out


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_join_of_random_fingerprints(spark, blocks, monkeypatch):
    draw = random.Random(blocks)
    fps = sorted({draw.getrandbits(64) for _ in range(150)} | {x for _ in range(6) for x in cluster(draw, 25, 3)} | {x for x in cluster(draw, 120, 2)} | {0, (1 << 64) - 1, 15, 31})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    monkeypatch.setattr(simhash, "blocks_for", lambda n, bits: blocks)
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    want = classes(fps, lambda x, y: (x ^ y).bit_count() <= 4)
    for split in (simhash.SPLIT, 20):
        edges = simhash.links(df, len(fps), 4, split)
        assert edges.count()
        found = dict(components(edges).collect())
        by = {}
        for x, r in zip(signed, want, strict=True):
            by.setdefault(r, []).append(x)
        assert all(found.get(x, x) == min(v) for v in by.values() for x in v)


def test_walk_in_small_steps_is_the_same(monkeypatch):
    draw = random.Random(5)
    values = np.array(sorted({x for _ in range(4) for x in cluster(draw, 80, 3)} | {draw.getrandbits(64) for _ in range(200)}), np.uint64)
    group = np.zeros(len(values), np.int64)
    known = simhash.self_join(values, group, 0, 4)
    assert known.tolist() == classes(values.tolist(), lambda x, y: (x ^ y).bit_count() <= 4)
    monkeypatch.setattr(simhash, "FRONTIER", 7)
    assert simhash.self_join(values, group, 0, 4).tolist() == known.tolist()


def test_documents(spark, awkward, empty, small):
    docs = awkward.select("doc_id", "text").union(small.select("doc_id", "text")).repartition(3)
    assert rows(simhash.near_duplicates(docs)) == brute(docs.collect())
    assert rows(simhash.near_duplicates(awkward)) == brute(awkward.select("doc_id", "text").collect())
    assert simhash.near_duplicates(empty).count() == 0


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    found = op5_simhash(spark, "/root/testdata/sf0.001").collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in found) == brute(docs)


def test_chain_of_edges(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (500, 501), (501, 500)], "a long, b long")
    found = dict(components(edges).collect())
    assert found == {i: 0 for i in range(301)} | {500: 500, 501: 500}

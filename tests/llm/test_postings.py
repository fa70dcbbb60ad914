import hashlib
import random
import re

import pytest

from talktide.llm import postings
from talktide.llm.common import scratch_table
from talktide.llm.queries import op3_decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width=10):
    out = []
    for i, text in docs:
        own, hit, met = words(text), set(), set()
        for item, it in items:
            w = words(it)
            for a in range(max(min(len(w), 1), len(w) - width + 1)):
                win = w[a : a + width]
                for b in range(len(own) - len(win) + 1):
                    if own[b : b + len(win)] == win:
                        hit.update(range(b, b + len(win)))
                        met.add("" if item is None else str(item))
        out.append((str(i), len(own), len(hit), sorted(met), bool(hit)))
    return sorted(out)


def rows(df):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in df.collect())


def test_random_documents(spark):
    draw = random.Random(3)
    text = lambda n: " ".join(draw.choice(["a", "B", "c", "é", "dd", "x,y"]) for _ in range(n))
    docs = [(i, text(draw.randrange(60))) for i in range(60)]
    items = [(i, text(draw.choice([0, 1, 3, 5, 7, 12]))) for i in range(12)] + [(None, "a b c a"), (3, None), (3, docs[7][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(postings.contamination(d, b, 4)) == brute(docs, items, 4)


def test_blocks_of_items_give_the_same(spark, small, monkeypatch):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    known = rows(postings.contamination(small, items))
    monkeypatch.setattr(postings, "ITEM_BYTES", 2000)
    monkeypatch.setattr(postings, "CANDIDATES", 5)
    assert rows(postings.contamination(small, items)) == known
    assert any(r[4] for r in known)


def test_awkward_rows(spark, awkward, empty):
    items = spark.createDataFrame([(10, "THREE four five"), (9, "one two three four five six seven eight nine ten eleven"), (11, "")], "item_id int, text string")
    pairs = awkward.select("doc_id", "text").collect()
    assert rows(postings.contamination(awkward, items)) == brute(pairs, items.collect())
    assert postings.contamination(empty, items).count() == 0
    assert not any(r[4] for r in rows(postings.contamination(awkward, items.limit(0))))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b y c"), (2, "a b"), (3, "c a x x x b a b c")], "doc_id long, text string")
    index = scratch_table(postings.build(docs))
    near = lambda slop: sorted(map(tuple, postings.proximity(index, ["a", "b", "c"], slop).collect()))
    assert near(0) == [(3, 6, 9)]
    assert near(2) == [(1, 0, 5), (3, 6, 9)]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"/root/testdata/{sf}/benchmark.parquet").select("item_id", "text").collect()
    found = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in op3_decontamination(spark, f"/root/testdata/{sf}").collect())
    assert found == [(i, n, h, len(m), hashlib.sha256(",".join(m).encode()).hexdigest(), c) for i, n, h, m, c in brute(docs, items)]

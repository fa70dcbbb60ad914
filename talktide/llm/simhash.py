"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints are joined, not documents: equal ones are one row. Two fingerprints of at most k differing bits agree in
all but k of the blocks that their bits are cut into, so each fingerprint is dealt to one group for every choice of
agreeing blocks, with those bits in front. A group is the root of a binary trie over the remaining bits. The self-join
walks pairs of its nodes downwards together, adds up the bits in which they differ, and drops a pair as soon as that
exceeds k; it also drops pairs of nodes that are already connected, which keeps dense groups of copies cheap. Groups
beyond a bound are cut into chunks that meet pairwise in tasks of their own. Each task sends a forest of links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talktide.llm.common import bound_batches, documents_of, flat_words, ragged, runs, scratch_table
from talktide.llm.components import components

SHINGLE, BITS = 4, 4  # words of a shingle; differing bits that still link
SEED = 42
PER_GROUP = 512  # fingerprints in a group on average, beyond which more blocks are used
SPLIT = 1 << 16  # fingerprints in a group beyond which it is split
FRONTIER = 1 << 18  # node pairs walked at a time; a bound on memory only


def fingerprints_of(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The SimHash of each text: words lower-cased A-Z, shingles space-joined, XXH64; zero for a text without words."""
    import xxhash

    row, words, index = flat_words(texts, lower=True)
    out = np.zeros(len(texts), np.uint64)
    if not len(row):
        return out
    each = words.cast(pa.large_binary()).to_pylist()
    size = np.fromiter(map(len, each), np.int64, len(each))[index]
    end = np.cumsum(size + 1) - 1
    begin = end - size
    whole = b" ".join(map(each.__getitem__, index.tolist()))
    n = np.bincount(row, minlength=len(texts))
    first = (np.cumsum(n) - n)[n > 0]
    made = np.maximum(n[n > 0] - shingle + 1, 1)
    start = ragged(first, made)
    stop = np.minimum(start + shingle, np.repeat(first + n[n > 0], made)) - 1
    one = xxhash.xxh64_intdigest
    h = np.fromiter((one(whole[a:b], SEED) for a, b in zip(begin[start].tolist(), end[stop].tolist(), strict=True)), np.uint64, len(start))
    at, found = np.cumsum(made) - made, np.zeros(len(made), np.uint64)
    both, low = np.uint64(0x0000000100000001), np.uint64(0xFFFFFFFF)
    for j in range(32):  # two counters of 32 bits in each sum
        votes = np.add.reduceat((h >> np.uint64(j)) & both, at)
        found |= ((votes & low) * np.uint64(2) > made.astype(np.uint64)).astype(np.uint64) << np.uint64(j)
        found |= ((votes >> np.uint64(32)) * np.uint64(2) > made.astype(np.uint64)).astype(np.uint64) << np.uint64(j + 32)
    out[n > 0] = found
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64 bits of fp as a signed long."""
    bound_batches(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fp": fingerprints_of(batch.column(1), shingle).view(np.int64)})

    return documents_of(docs, id_col, text_col).mapInArrow(made, "doc_id long, fp long")


# ---- the join

def blocks_for(n: int, bits: int) -> int:
    """Blocks to cut 64 bits into, so that groups hold PER_GROUP fingerprints on average or fewer."""
    b = bits + 1
    while n > PER_GROUP << (64 * (b - bits) // b) and comb(b + 1, bits) < 1000 and b < 16:
        b += 1
    return b


class Deal:
    """For each choice of agreeing blocks, a permutation of the bits that puts them in front."""

    def __init__(self, n: int, bits: int):
        b = blocks_for(n, bits)
        edges = [64 * i // b for i in range(b + 1)]
        self.blocks = [(edges[i], edges[i + 1] - edges[i]) for i in range(b)]  # from the top: first bit, width
        self.choices = [(*c, *(i for i in range(b) if i not in c)) for c in combinations(range(b), b - bits)]
        self.width = [sum(self.blocks[i][1] for i in c[: b - bits]) for c in self.choices]

    @staticmethod
    def _cut(x: np.ndarray, at: int, width: int) -> np.ndarray:
        return (x >> np.uint64(64 - at - width)) & np.uint64((1 << width) - 1)

    def permute(self, fp: np.ndarray, choice: int) -> np.ndarray:
        out = np.zeros(len(fp), np.uint64)
        for i in self.choices[choice]:
            at, width = self.blocks[i]
            out = (out << np.uint64(width)) | self._cut(fp, at, width)
        return out

    def restore(self, value: np.ndarray, choice: int) -> np.ndarray:
        out, done = np.zeros(len(value), np.uint64), 0
        for i in self.choices[choice]:
            at, width = self.blocks[i]
            out |= self._cut(value, done, width) << np.uint64(64 - at - width)
            done += width
        return out


class Links:
    """Components of the rows of one array, by least member."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (up := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = up


def self_join(values: np.ndarray, group: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """values: distinct, sorted inside each of the consecutive groups, which agree in their first `depth` bits.
    The least member of the values' components, linked at `bits` or fewer differing bits inside groups."""
    links = Links(len(values))
    if not len(values):
        return links.label
    ones = {}  # bit -> running number of ones

    def mid(lo, hi, at):
        if at not in ones:
            ones[at] = np.r_[0, np.cumsum((values >> np.uint64(63 - at)) & np.uint64(1))].astype(np.int64)
        return hi - (ones[at][hi] - ones[at][lo])

    lo = runs(group)
    hi = np.r_[lo[1:], len(values)]
    zero = np.zeros(len(lo), np.int64)
    todo = [(depth, lo, hi, lo, hi, zero)]
    moved = np.arange(len(values))
    while todo:
        at, alo, ahi, blo, bhi, err = todo.pop()
        if len(alo) > FRONTIER:
            todo.append((at, *(x[FRONTIER:] for x in (alo, ahi, blo, bhi, err))))
            alo, ahi, blo, bhi, err = (x[:FRONTIER] for x in (alo, ahi, blo, bhi, err))
        # pairs that are connected already, and single values with themselves
        live = ~((moved[ahi - 1] == moved[alo]) & (moved[bhi - 1] == moved[blo]) & (links.label[alo] == links.label[blo]))
        leaf = live & (ahi - alo == 1) & (bhi - blo == 1)
        near = np.flatnonzero(leaf)
        near = near[np.bitwise_count(values[alo[near]] ^ values[blo[near]]) <= bits]
        if len(near):
            links.join(alo[near], blo[near])
            moved = np.r_[0, np.cumsum(links.label[1:] != links.label[:-1])]
        rest = live & ~leaf
        if at == 64 or not rest.any():
            continue
        alo, ahi, blo, bhi, err = (x[rest] for x in (alo, ahi, blo, bhi, err))
        am, bm, own = mid(alo, ahi, at), mid(blo, bhi, at), alo == blo
        far = []
        for a, b, c, d, e, use in ((alo, am, bm, bhi, err + 1, err >= 0), (am, ahi, blo, bm, err + 1, ~own), (alo, am, blo, bm, err, err >= 0), (am, ahi, bm, bhi, err, err >= 0)):
            ok = use & (b > a) & (d > c) & (e <= bits)
            far.append(tuple(x[ok] for x in (a, b, c, d, e)))
        for pair in (far[:2], far[2:]):  # the last pushed, which differ less, go first
            joined = tuple(np.concatenate(x) for x in zip(*pair, strict=True))
            if len(joined[0]):
                todo.append((at + 1, *joined))
    return links.label


def links(distinct: DataFrame, n: int, bits: int = BITS, split: int | None = None) -> DataFrame:
    """(a, b): a forest of links for each group of `distinct` (fp), which holds n rows; all together connect what links of `bits` or fewer do."""
    spark, deal, split = distinct.sparkSession, Deal(n, bits), split or SPLIT

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for c, width in enumerate(deal.width):
                value = deal.permute(fp, c)
                yield pa.RecordBatch.from_pydict({"choice": np.full(len(fp), c, np.int32), "slot": (value >> np.uint64(64 - width)).view(np.int64), "value": value.view(np.int64)})

    rows = scratch_table(distinct.select("fp").mapInArrow(dealt, "choice int, slot long, value long"))
    large = rows.groupBy("choice", "slot").count().where(F.col("count") > split).select("choice", "slot", F.ceil(F.col("count") / split).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("value"), F.col("parts")).cast("int")
    tasks = rows.join(large, ["choice", "slot"], "left").withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    tasks = tasks.select("choice", "slot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "value")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(batch: pa.RecordBatch) -> pa.RecordBatch:
            choice, slot, i, j, value = (c.to_numpy() for c in batch.columns)
            value = value.view(np.uint64)
            a, b = [], []
            for c in np.unique(choice).tolist():
                at = np.flatnonzero(choice == c)
                key = np.stack([slot[at], i[at], j[at]])
                new = np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]
                group, own = np.cumsum(new), value[at]
                order = np.lexsort((own, group))
                own, group = own[order], group[order]
                label, fp = self_join(own, group, deal.width[c], bits), deal.restore(own, c)
                far = np.flatnonzero(label != np.arange(len(label)))
                a.append(fp[far])
                b.append(fp[label[far]])
            return pa.RecordBatch.from_pydict({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

        def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) < 1 << 18:
                continue
            every = whole(held)  # up to the start of the last group, which may go on
            keys = np.stack([every.column(k).to_numpy().astype(np.int64) for k in range(4)])
            cut = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])[-1]
            if cut:
                yield out(every.slice(0, cut))
            held = [every.slice(cut)]
        if held:
            yield out(whole(held))

    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["choice", "slot", "i", "j"]
    return tasks.repartition(n_tasks, *by).sortWithinPartitions(*by).mapInArrow(joined, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs: the smallest doc_id reachable over fingerprints of `bits` or fewer differing bits.

    A null or empty text has fingerprint zero and is linked like any other. Null ids take part, but name no component:
    component_id is null where all reachable ids are. Repeated rows come back each for itself. Other columns are ignored.
    """
    marks = scratch_table(fingerprints(docs, shingle, id_col, text_col))
    distinct = scratch_table(marks.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(distinct, distinct.count(), bits))
    rooted = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    class_of = rooted.join(named, "root").select("fp", "component_id")
    return marks.join(class_of, "fp").select("doc_id", "fp", "component_id")

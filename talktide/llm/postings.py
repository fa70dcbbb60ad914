"""Benchmark decontamination with a distributed positional inverted index.

The corpus is indexed in segments of whole documents: each row of the index table holds the distinct words of its
segment and, word by word, the positions at which they stand (ascending, stored as gaps). A phrase is found inside
each segment by taking the postings of its rarest word, shifted by the word's offset, and intersecting them with the
shifted lists of the next rarest words. Segments hold their own documents' postings only, so a frequent word or
passage never gathers in one task, and no document text is shuffled. The phrases are broadcast in blocks of a bounded
size; a larger benchmark is searched block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talktide.llm.common import bound_batches, documents_of, flat_words, narrow, pack, ragged, rows_of, runs, scratch_table, unpack

WINDOW = 10  # words of a benchmark window
ITEM_BYTES = 8 << 20  # of benchmark text in one broadcast block
CANDIDATES = 1 << 20  # start positions intersected at a time; a bound on memory only
SEGMENT = "segment long, payload binary"

_BYTES = np.full(256, ord(" "), np.uint8)
_BYTES[0x80:] = np.arange(0x80, 0x100)
for _a, _b in (("0", "9"), ("a", "z")):
    _BYTES[ord(_a) : ord(_b) + 1] = np.arange(ord(_a), ord(_b) + 1)
_BYTES[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Like flat_words, for words of 0-9, a-z (A-Z lower-cased) and characters beyond ASCII."""
    texts = texts.cast(pa.large_string())
    offsets, data = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1], texts.buffers()[2]
    if not len(texts) or data is None:
        return np.zeros(0, np.int64), pa.array([], pa.large_string()), np.zeros(0, np.int64)
    plain = _BYTES[np.frombuffer(data, np.uint8)]
    return flat_words(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(plain)), lower=False)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of docs as a table (segment, payload), not yet stored; every row of docs is indexed."""
    bound_batches(docs.sparkSession)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(batches):
            row, words, index = words_of(batch.column(1))
            position = np.arange(len(row), dtype=np.int64) + row  # a gap after each document
            order = np.argsort(index, kind="stable")
            listed = position[order].astype(np.uint32)
            gaps = np.diff(listed, prepend=listed[:1])
            first = runs(index[order])
            gaps[first] = listed[first]
            ids = batch.column(0)
            body = pack(
                ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), np.bincount(row, minlength=len(ids)),
                b" ".join(words.cast(pa.large_binary()).to_pylist()), narrow(np.bincount(index, minlength=len(words))), gaps,
            )
            yield pa.RecordBatch.from_pydict({"segment": pa.array([base + k], pa.int64()), "payload": pa.array([body], pa.binary())})

    return documents_of(docs, id_col, text_col).mapInArrow(indexed, SEGMENT)


class Segment:
    """One segment's postings in memory."""

    def __init__(self, payload: bytes):
        ids, known, self.n_words, terms, counts, gaps = unpack(payload)
        self.ids, self.known = ids, known.astype(bool)
        self.terms = pa.array(terms.split(b" ") if terms else [], pa.binary())
        self.counts = counts.astype(np.int64)
        ends = np.cumsum(self.counts)
        total = np.cumsum(gaps.astype(np.int64))
        before = np.r_[0, total][ends - self.counts] if len(ends) else ends
        self.positions = total - np.repeat(before, self.counts)
        self.first = ends - self.counts
        self.doc_start = np.cumsum(self.n_words + 1) - (self.n_words + 1)
        self.span = int(self.n_words.sum() + len(ids) + 1)
        self.keys = self.positions + np.repeat(np.arange(len(ends)) * self.span, self.counts)

    def lookup(self, words: pa.Array) -> np.ndarray:
        """Term number of each word, -1 where it doesn't occur."""
        return pc.fill_null(pc.index_in(words, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each position is in the list of its term."""
        want = term * self.span + position
        at = np.searchsorted(self.keys, want)
        return (position >= 0) & (self.keys[np.minimum(at, len(self.keys) - 1)] == want)

    def row(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_start, position, "right") - 1

    def phrases(self, phrase: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """phrase: (n, width) term numbers, -2 past a phrase's end. Yields (phrase, start position) of every occurrence."""
        length = (phrase != -2).sum(axis=1)
        live = np.flatnonzero((length > 0) & ~(phrase == -1).any(axis=1)) if len(phrase) and len(self.keys) else np.zeros(0, np.int64)
        if not len(live):
            return
        count = np.where(phrase[live] >= 0, self.counts[np.maximum(phrase[live], 0)], np.iinfo(np.int64).max)
        order = np.argsort(count, axis=1, kind="stable")  # rarest words first
        many = count[np.arange(len(live)), order[:, 0]]
        for part in np.split(np.arange(len(live)), np.flatnonzero(np.diff(np.cumsum(many) // CANDIDATES)) + 1):
            which = np.repeat(part, many[part])
            term = phrase[live[part], order[part, 0]]
            start = self.positions[ragged(self.first[term], many[part])] - order[which, 0]
            for k in range(1, phrase.shape[1]):
                offset = order[which, k]
                term = phrase[live[which], offset]
                keep = (term == -2) | self.holds(np.maximum(term, 0), start + offset)
                which, start = which[keep], start[keep]
            good = start >= 0
            yield live[which[good]], start[good]

    def near(self, terms: list[int], slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the shortest stretches with the terms in order inside one document and at most `slop` other words."""
        if not terms or min(terms) < 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin = end = self.positions[self.first[terms[0]] : self.first[terms[0]] + self.counts[terms[0]]]
        for t in terms[1:]:
            own = self.positions[self.first[t] : self.first[t] + self.counts[t]]
            at = np.searchsorted(own, end, "right")
            keep = at < len(own)
            begin, end = begin[keep], own[at[keep]]
        if len(end):
            latest = np.r_[end[1:] != end[:-1], True]  # of the stretches with one end, the shortest
            begin, end = begin[latest], end[latest]
        keep = (end - begin + 1 - len(terms) <= slop) & (self.row(begin) == self.row(end))
        return begin[keep], end[keep]


def _items(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, str]]]:
    """Benchmark items in blocks of ITEM_BYTES, one longer than that by itself; a null id is the empty string."""
    block, size = [], 0
    for i, text in items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).toLocalIterator():
        if size and size + len(text) > ITEM_BYTES:
            yield block
            block, size = [], 0
        block.append((i, text))
        size += len(text)
    if block:
        yield block


def windows(block: list[tuple[str, str]], width: int = WINDOW) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(words, distinct windows as word numbers with -2 past the end, (window, item) pairs as two arrays, item ids)."""
    row, words, index = words_of(pa.array([t for _, t in block], pa.large_string()))
    n = np.bincount(row, minlength=len(block))
    first, made = np.cumsum(n) - n, np.maximum(np.minimum(n, 1), n - width + 1)
    item = np.repeat(np.arange(len(block)), made)
    start = ragged(first, made)
    at = start[:, None] + np.arange(width)[None, :]
    grid = np.where(at < (first + n)[item][:, None], np.r_[index, -2][np.minimum(at, len(index))], -2)
    distinct, inverse = np.unique(grid, axis=0, return_inverse=True) if len(grid) else (grid, np.zeros(0, np.int64))
    return words.cast(pa.binary()).to_pylist(), distinct, inverse.reshape(-1), item, [i for i, _ in block]


SPANS = "segment long, row int, doc_id long, n_words long, spans array<struct<first:int,last:int>>, items array<string>"


def _search(index: DataFrame, block: list[tuple[str, str]], width: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(windows(block, width))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grid, pair_window, pair_item, names = shared.value
        words, by_window = pa.array(words, pa.binary()), np.argsort(pair_window, kind="stable")
        of_window = np.bincount(pair_window, minlength=len(grid))
        first_pair, size = np.cumsum(of_window) - of_window, (grid != -2).sum(axis=1)
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for number, payload in rows_of(batches):
            own = Segment(payload)
            term = own.lookup(words)
            cover, hits = np.zeros(own.span + 1, np.int64), set()
            for which, start in own.phrases(np.where(grid == -2, -2, term[grid])) if len(words) else ():
                np.add.at(cover, start, 1)
                np.add.at(cover, start + size[which], -1)
                pairs = pair_item[by_window[ragged(first_pair[which], of_window[which])]]
                row = np.repeat(own.row(start), of_window[which])
                hits.update(np.unique(row * len(names) + pairs).tolist())
            edge = np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=0)
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            row = own.row(begin)
            spans, items = [[] for _ in own.ids], [[] for _ in own.ids]
            for r, a, b in zip(row.tolist(), (begin - own.doc_start[row]).tolist(), (end - own.doc_start[row]).tolist(), strict=True):
                spans[r].append({"first": a, "last": b})
            for h in sorted(hits):
                items[h // len(names)].append(names[h % len(names)])
            yield pa.RecordBatch.from_pydict({
                "segment": pa.array([number] * len(spans), pa.int64()), "row": pa.array(range(len(spans)), pa.int32()), "doc_id": pa.array(own.ids, pa.int64(), mask=~own.known),
                "n_words": pa.array(own.n_words, pa.int64()), "spans": pa.array(spans, kind), "items": pa.array(items, pa.list_(pa.string())),
            })

    return index.mapInArrow(found, SPANS)


def search(index: DataFrame, items: DataFrame, width: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """For every indexed document (segment, row, doc_id, n_words, spans, items): the word ranges [first, last) that occurrences of the
    items' windows cover, and the items with occurring windows, in no order. An item of fewer than `width` words, but not none, is one window.
    """
    found = [_search(index, block, width) for block in _items(items, id_col, text_col)] or [_search(index, [], width)]
    if len(found) == 1:
        return found[0]
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    whole = every.groupBy("segment", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    # sorted ranges of several blocks, joined where they meet
    joined = F.aggregate(
        "spans", F.array().cast("array<struct<first:int,last:int>>"),
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["last"] >= x["first"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["last"], x["last"]).alias("last"))))).otherwise(F.concat(done, F.array(x))),
    )
    return whole.withColumn("spans", F.when(F.size("spans") > 0, joined).otherwise(F.col("spans")))


def proximity(index: DataFrame, words: list[str], slop: int) -> DataFrame:
    """(doc_id, first, last): word ranges [first, last) that hold the words in this order with at most `slop` others among them."""
    ask = [w.encode() for w in words]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, payload in rows_of(batches):
            own = Segment(payload)
            begin, end = own.near(own.lookup(pa.array(ask, pa.binary())).tolist(), slop)
            row = own.row(begin)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(own.ids[row], pa.int64(), mask=~own.known[row]), "first": pa.array(begin - own.doc_start[row], pa.int32()), "last": pa.array(end + 1 - own.doc_start[row], pa.int32())})

    return index.mapInArrow(found, "doc_id long, first int, last int")


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated) of every row of docs, by an index that is stored in the shared folder.

    A null text has no words; a null id stays null; repeated rows are judged each for itself; items of one id count
    once; an item without words matches nothing; other columns are ignored; empty tables give no rows or no hits.
    """
    index = scratch_table(build(docs, id_col, text_col))
    found = search(index, items, width, item_col, item_text)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size(F.array_distinct("items")).cast("long").alias("n_items"), F.array_sort(F.array_distinct("items")).alias("items"), (F.size("spans") > 0).alias("contaminated"))

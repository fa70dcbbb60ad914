"""Language-model scoring with a trie of n-grams in Elias-Fano coded levels, of order 2 or more.

The corpus is packed into blocks. First, each block sends its distinct words with their training counts to hash
buckets and gets back the counts of the whole corpus and a number for each word, small for frequent ones; from then on
it is kept as numbers. Then, for each order from 2 on, it sends its distinct n-grams to the shards of a trie: a shard owns
the contexts of a hash range (a context that would outgrow a shard is split by its successors). A shard sums up the
n-grams' training counts, lays them out as a trie, and looks every n-gram up. Below the last order the answers, count and
code, go back to the block, which sends them with the next order's n-grams: there they are the contexts' counts and the
codes to back off to. So a shard needs no other shard, and one order's exchange is gone before the next one's. At the last
order n-grams come with the documents that hold them, a share of the shards at a time, and the shard answers with sums for documents.

Levels of a shard: the contexts' first words; for each further word, monotone pointers into the next level and the words there,
numbered inside the shard and made monotone by what they follow; a back-off code for each context, the code of the smoothed
probability for each n-gram. Keys, pointers and successors are Elias-Fano sequences in a file that is mapped into memory. An n-gram is
found by a successor search inside its context's range; an absent one backs off to the code of the n-gram without its first word
plus the context's back-off code.

Smoothing: p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)) and p(w | u v) = (c(uvw) + MU p(w | v)) / (c(uv) + MU), for every order
alike. Codes are -log10(p) in steps of 1 / STEPS, so a document's score is a sum of integers: the same in any order. From
order 3 on, p(w | v) is what its code stands for. The first word of a text follows the start only, the second one the start
and the first, and so on.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talktide.llm.common import conf, discard, documents_of, flat_words, grouped, mix64, narrow, pack, pack_blocks, partitions_for, ragged, release, rows_of, runs, scratch_table, unpack, word_hashes

MU = 8.0  # pseudo-count of the back-off distribution in each context
STEPS = 4096  # codes in a power of ten
FOLDS, HELD_OUT = 5, 1
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 8 << 20  # text whose n-grams of one order a shard holds, on average
ORDER = 3  # of the query's model
PASSES = 2  # in which the shards of the last order are asked, so that the exchange of one is gone before the next one's
END = ""  # the end of a text, and the context of its first word


# ---- Elias-Fano

class Bits:
    """A bit vector with a directory of ones for each 64-bit word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Position of the k-th (from 0) one or zero."""
        if len(k) * 8 >= len(self.words) * 64:  # so many that all positions are found in one pass
            return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little") == bit)[k]
        before = self.before if bit else np.arange(len(self.before), dtype=np.int64) * 64 - self.before
        w = np.searchsorted(before, k, "right") - 1
        word = self.words[w] if bit else ~self.words[w]
        left, at = k - before[w], np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count((word >> at.astype(np.uint64)) & np.uint64((1 << half) - 1)).astype(np.int64)
            right = left >= low
            left -= np.where(right, low, 0)
            at += np.where(right, half, 0)
        return w * 64 + at


def _words(bits: np.ndarray) -> np.ndarray:
    raw = np.packbits(bits, bitorder="little")
    return np.frombuffer(raw.tobytes() + bytes(-len(raw) % 8), "<u8")


class EliasFano:
    """A monotone sequence: low bits side by side, high bits in unary."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, Bits(high)

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> list[np.ndarray]:
        """[n and low bits, low words, high words]; values < universe, ascending."""
        n, values = len(values), values.astype(np.uint64)
        l = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)  # noqa: E741
        bits = ((values[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(-1) if l else np.zeros(0, np.uint8)
        high = np.zeros(n + (max(universe - 1, 0) >> l) + 2, np.uint8)
        high[(values >> np.uint64(l)).astype(np.int64) + np.arange(n)] = 1
        return [np.array([n, l], np.int64), np.r_[_words(bits), np.zeros(1, "<u8")], _words(high)]

    @classmethod
    def of(cls, parts: list[np.ndarray]) -> EliasFano:
        return cls(int(parts[0][0]), int(parts[0][1]), parts[1], parts[2])

    def lows(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        first = self.low[word] >> shift
        next_ = np.where(shift > 0, self.low[np.minimum(word + 1, len(self.low) - 1)] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (first | next_) & np.uint64((1 << self.low_bits) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return ((self.high.select(i, 1) - i).astype(np.uint64) << np.uint64(self.low_bits)) | self.lows(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the first value that is x or more, and whether it is x."""
        x = x.astype(np.uint64)
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        high, low = (x >> np.uint64(self.low_bits)).astype(np.int64), x & np.uint64((1 << self.low_bits) - 1)
        past = (high < 0) | (high >= len(self.high.words) * 64 - self.high.before[-1])
        high = np.where(past, 0, high)
        end = self.high.select(high, 0) - high
        a = np.where(high > 0, self.high.select(np.maximum(high - 1, 0), 0) + 1 - high, 0)
        b = end.copy()
        while (open_ := np.flatnonzero(a < b)).size:
            mid = (a[open_] + b[open_]) // 2
            less = self.lows(mid) < low[open_]
            a[open_] = np.where(less, mid + 1, a[open_])
            b[open_] = np.where(less, b[open_], mid)
        return np.where(past, self.n, a), ~past & (a < end) & (self.lows(np.minimum(a, self.n - 1)) == low)


KINDS = ("<i8", "<u8", "<u2")


def stored(path: str, arrays: list[np.ndarray]) -> None:
    """Arrays in one file, each at a multiple of 8 bytes, to be mapped."""
    head = [[KINDS.index(x.dtype.str), x.nbytes] for x in arrays]
    with open(path, "wb") as f:
        f.write(np.array([len(arrays), *sum(head, [])], "<i8").tobytes())
        for x in arrays:
            f.write(np.ascontiguousarray(x).tobytes() + bytes(-x.nbytes % 8))


def mapped(path: str) -> list[np.ndarray]:
    whole = np.memmap(path, np.uint8, "r")
    n = int(whole[:8].view("<i8")[0])
    at, out = 8 + 16 * n, []
    for kind, size in whole[8:at].view("<i8").reshape(n, 2).tolist():
        out.append(np.asarray(whole[at : at + size].view(KINDS[kind])))
        at += size + -size % 8
    return out


class Trie:
    """The levels of one shard, mapped from its file."""

    def __init__(self, path: str):
        parts = mapped(path)
        self.n_words, steps = int(parts[0][0]), int(parts[0][1])
        self.keys, self.back_off, self.codes = EliasFano.of(parts[1:4]), parts[4], parts[5]
        self.steps = [(EliasFano.of(parts[i : i + 3]), EliasFano.of(parts[i + 3 : i + 6])) for i in range(6, 6 + 6 * steps, 6)]

    @staticmethod
    def build(path: str, n_words: int, columns: list[np.ndarray], total: np.ndarray, context: np.ndarray, word: np.ndarray, count: np.ndarray, below: np.ndarray) -> None:
        """columns, total: the words of the contexts, in order, and their counts; context, word, count, below: n-grams in order, by the
        number of context and word, and the probability of each without its first word. All counts are 1 or more."""
        first = runs(columns[0])
        keys, node = columns[0][first], np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(total)]))
        parents, steps = len(keys), []

        def step(node: np.ndarray, word: np.ndarray) -> None:
            steps.extend(EliasFano.encode(np.searchsorted(node, np.arange(parents + 1)), len(word) + 1))
            steps.extend(EliasFano.encode(node * n_words + word, parents * n_words))

        for column in columns[1:]:
            head = runs(node * n_words + column)
            step(node[head], column[head])
            node, parents = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(total)])), len(head)
        step(context, word)
        p = (count + MU * below) / (total[context] + MU)
        stored(path, [
            np.array([n_words, len(columns)], "<i8"), *EliasFano.encode(keys, int(keys[-1]) + 1 if len(keys) else 1),
            codes(MU / (total + MU)), codes(p), *steps,
        ])

    def _next(self, step: int, node: np.ndarray, known: np.ndarray, word: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The places of words behind their nodes, or the ones numbered `of`, in the next level, and whether they are there."""
        pointers, words = self.steps[step]
        if not words.n:
            return np.zeros(len(word), np.int64), np.zeros(len(word), bool)
        node = np.where(known, node, 0)
        start, end = pointers[node].astype(np.int64), pointers[node + 1].astype(np.int64)
        if of is not None:
            node, known, start, end = node[of], known[of], start[of], end[of]
        at, there = words.successor(np.where(known, node * self.n_words + word, 0))
        return np.minimum(at, words.n - 1), there & known & (at >= start) & (at < end)

    def find(self, columns: list[np.ndarray], context: np.ndarray, word: np.ndarray, below: np.ndarray) -> np.ndarray:
        """The codes of n-grams: columns: the words of contexts; context: of each n-gram, its number there; below: its code without its first word."""
        if not self.keys.n:
            return below.astype(np.int64)
        node, known = self.keys.successor(columns[0])
        for k, column in enumerate(columns[1:]):
            node, known = self._next(k, node, known, column)
        back = np.where(known, self.back_off[np.where(known, node, 0)], 0).astype(np.int64)
        at, there = self._next(len(columns) - 1, node, known, word, context)
        return np.where(there, self.codes[at] if len(self.codes) else 0, below + back[context]).astype(np.int64)


def codes(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-np.log10(p) * STEPS), 65535).astype(np.uint16)


# ---- blocks

def held_out(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Rows that aren't learned from: crc32 of the id as text, modulo FOLDS, is HELD_OUT; a null id is the empty text."""
    return np.fromiter((zlib.crc32(str(i).encode() if k else b"") % FOLDS == HELD_OUT for i, k in zip(ids.tolist(), known.tolist(), strict=True)), bool, len(ids))


class Tokens:
    """The tokens of a block: words and an end for each document, by number in the block's dictionary (0 is the end)."""

    def __init__(self, payload: bytes):
        self.ids, self.known, size, raw = unpack(payload)
        offsets = np.r_[0, np.cumsum(size)].astype(np.int64)
        row, words, index = flat_words(pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(raw)), lower=True)
        self.n = np.bincount(row, minlength=len(size)) + 1
        self.end = np.cumsum(self.n) - 1
        self.token = np.zeros(int(self.n.sum()), np.int64)
        self.token[np.arange(len(row)) + row] = index + 1
        self.words = pa.concat_arrays([pa.array([END], pa.large_string()), words])
        self.doc = np.repeat(np.arange(len(size)), self.n)
        self.train = ~held_out(self.ids, self.known)
        self.hash = word_hashes(self.words)

    def counts(self) -> np.ndarray:
        return np.bincount(self.token[self.train[self.doc]], minlength=len(self.words))

    def buckets(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Words by bucket, and the edges of the buckets."""
        b = (mix64(self.hash) % np.uint64(n)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        return order, np.searchsorted(b[order], np.arange(n + 1))


SENT = "bucket long, block long, payload binary"


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_pydict({c.split()[0]: pa.array([r[i] for r in rows], kinds[c.split()[1]]) for i, c in enumerate(schema.split(", "))})


def _word_counts(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, payload, n, v): corpus counts and ranks of the block's words in a bucket; n and v of the whole bucket once."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, payload in rows_of(batches):
            own = Tokens(payload)
            order, edge = own.buckets(buckets)
            count, words = own.counts(), own.words.cast(pa.large_binary())
            for k in np.flatnonzero(np.diff(edge)).tolist():
                at = order[edge[k] : edge[k + 1]]
                yield _rows(SENT, [(k, block, pack(b" ".join(words.take(pa.array(at)).to_pylist()), narrow(count[at])))])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, group in grouped(batches):
            opened = [unpack(p) for _, _, p in group]
            lists = [x[0].split(b" ") for x in opened]  # words hold no space; the end is the empty one
            index = pa.array([w for words in lists for w in words], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            total = np.bincount(index, np.concatenate([x[1] for x in opened])).astype(np.int64)
            rank = np.empty(len(total), np.int64)
            rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
            at, n, v = 0, int(total.sum()), int((total > 0).sum())
            for (_, block, _), words in zip(group, lists, strict=True):
                mine = index[at : at + len(words)]
                yield _rows("block long, bucket long, payload binary, n long, v long", [(block, bucket, pack(narrow(total[mine]), narrow(rank[mine])), n, v)])
                at, n, v = at + len(words), 0, 0

    dealt = blocks.mapInArrow(sent, SENT).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(summed, "block long, bucket long, payload binary, n long, v long")


def _ordered(key: np.ndarray) -> np.ndarray:
    """A stable argsort; keys of few bits are sorted together with their places, which is several times faster."""
    bits = len(key).bit_length()
    if not len(key) or int(key.max()) >= 1 << (63 - bits):
        return np.argsort(key, kind="stable")
    packed = (key << bits) | np.arange(len(key))
    packed.sort()
    return packed & ((1 << bits) - 1)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every distinct key, in order, the place of its first occurrence; the number of every key."""
    by = _ordered(key)
    first = runs(key[by])
    number = np.empty(len(key), np.int64)
    number[by] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(by)]))
    return by[first], number


def _gaps(ascending: np.ndarray) -> np.ndarray:
    return narrow(np.diff(ascending, prepend=0))


class Grams:
    """The tokens of a block by number, and its distinct n-grams of an order that grows from 1."""

    def __init__(self, payload: bytes, n: int, shards: int):
        self.ids, self.known, self.size, self.n_known, self.base, number, self.count, token = unpack(payload)
        self.number, self.token = np.cumsum(number, dtype=np.int64), token.astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        self.place = np.arange(len(token)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.train = ~held_out(self.ids, self.known)
        self.hot, self.shards = n // shards, shards
        self.order, self.gram, self.columns, self.total, self.code = 1, self.token, [np.arange(len(self.number))], self.count, None

    @staticmethod
    def payload(own: Tokens, count: np.ndarray, number: np.ndarray, n_known: np.ndarray, base: np.ndarray) -> bytes:
        """Words in the order of their numbers."""
        by_number = np.argsort(number)
        place = np.empty(len(number), np.int64)
        place[by_number] = np.arange(len(number))
        return pack(own.ids, own.known, narrow(own.n), narrow(n_known), base, _gaps(number[by_number]), narrow(count[by_number]), narrow(place[own.token]))

    def grow(self) -> None:
        """The next order: a token has n-grams of an order up to its place from 0, and 2."""
        at = np.flatnonzero(self.place >= self.order - 1)
        # what precedes the first token of a text is the end of the one before, the block's last one for the first
        context = self.gram[at - 1]
        key = context * len(self.number) + self.token[at]
        by = _ordered(key)
        first = runs(key[by])
        self.many, self.at = np.diff(np.r_[first, len(by)]), at[by]
        head = self.at[first]
        self.first, self.context, self.below = first, self.gram[head - 1], self.code[self.gram[head]] if self.order > 1 else None
        self.learned = np.add.reduceat(self.train[self.doc[self.at]].astype(np.int64), first) if len(first) else first
        self.gram = np.full(len(self.token), -1)
        self.gram[self.at] = np.repeat(np.arange(len(first)), self.many)
        self.before, self.before_total = self.columns, self.total
        self.columns = [*(c[self.context] for c in self.columns), self.token[head]]
        self.order += 1
        hashed = np.zeros(len(first), np.uint64)
        for c in self.columns[:-1]:
            hashed = mix64(hashed + mix64(self.number[c]))
        hot = self.before_total[self.context] > self.hot  # would fill a shard by itself: split by successor
        shard = (mix64(hashed + np.where(hot, mix64(self.number[self.columns[-1]]), np.uint64(0))) % np.uint64(self.shards)).astype(np.int64)
        self.by = _ordered(shard)
        self.edge = np.searchsorted(shard[self.by], np.arange(self.shards + 1))

    def sent(self, turn: int | None) -> Iterator[tuple[int, bytes]]:
        """(shard, payload) of the n-grams: words, contexts, n-grams, and for the last order, which has turns, their documents."""
        for k in np.flatnonzero(np.diff(self.edge)).tolist():
            if turn is not None and k % PASSES != turn:
                continue
            at = self.by[self.edge[k] : self.edge[k + 1]]
            contexts, c = np.unique(self.context[at], return_inverse=True)
            columns = [x[contexts] for x in self.before]
            words, index = np.unique(np.concatenate([*columns, self.columns[-1][at]]), return_inverse=True)
            *columns, w = np.split(index, np.cumsum([len(contexts)] * len(columns)))
            parts = [_gaps(self.number[words]), _gaps(columns[0]), *(narrow(x) for x in columns[1:]), narrow(self.before_total[contexts]), _gaps(c), narrow(w), narrow(self.learned[at])]
            parts.append(narrow(self.count[words]) if self.below is None else narrow(self.below[at]))
            if turn is not None:
                parts += [narrow(self.many[at]), narrow(self.doc[self.at[ragged(self.first[at], self.many[at])]])]
            yield k, pack(*parts)

    def answered(self, found: dict[int, bytes]) -> None:
        """Counts of the whole corpus and codes of the n-grams, as the shards gave them."""
        self.total, self.code = np.zeros(len(self.by), np.int64), np.zeros(len(self.by), np.int64)
        for k, payload in found.items():
            at = self.by[self.edge[k] : self.edge[k + 1]]
            self.total[at], self.code[at] = unpack(payload)

    def starts(self) -> np.ndarray:
        """The codes of each document's token that has n-grams of this order and of none above."""
        at = np.flatnonzero(self.place == self.order - 2)
        return np.bincount(self.doc[at], self.code[self.gram[at]], minlength=len(self.size)).astype(np.int64)


def _merge(group: list[list], order: int) -> tuple:
    """Payloads of one shard, numbered alike: (numbers of words, words' counts, contexts' words, totals, n-grams' context, word, learned, code below, n-gram of each sent one)."""
    numbers = [np.cumsum(x[0], dtype=np.int64) for x in group]
    words = np.concatenate(numbers)
    head, index = _distinct(words)
    words = words[head]
    base = np.cumsum([0, *map(len, numbers)])
    of = lambda k, gaps: [np.cumsum(x[k], dtype=np.int64) if gaps else x[k].astype(np.int64) for x in group]
    own = lambda k, gaps=False: np.concatenate([index[b + x] for b, x in zip(base, of(k, gaps), strict=False)])
    columns = [own(k + 1, k == 0) for k in range(order - 1)]
    key, at = columns[0], order
    for c in columns[1:]:
        key = _distinct(key)[1] * len(words) + c
    head, of_sent = _distinct(key)
    totals = np.concatenate([x[at] for x in group])[head].astype(np.int64)
    base_context = np.cumsum([0, *(len(x[at]) for x in group)])
    context = np.concatenate([of_sent[b + x] for b, x in zip(base_context, of(at + 1, True), strict=False)])
    word = own(at + 2)
    first, gram = _distinct(context * len(words) + word)
    learned = np.bincount(gram, np.concatenate([x[at + 3] for x in group]), minlength=len(first)).astype(np.int64)
    counts, below = None, np.concatenate([x[at + 4] for x in group]).astype(np.int64)
    if order == 2:
        counts = np.zeros(len(words), np.int64)
        counts[index] = below
    return words, counts, [c[head] for c in columns], totals, context[first], word[first], learned, below[first] if order > 2 else None, gram


def _scored(group: list[list], order: int, n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts and codes of the n-grams sent to one shard, looked up in its trie."""
    words, counts, columns, totals, context, word, learned, below, gram = _merge(group, order)
    if order == 2:
        p = (counts + 0.5) / (n + 0.5 * (v + 1))
        p_below, below = p[word], codes(p)[word].astype(np.int64)
    else:
        p_below = 10.0 ** (-below / STEPS)
    seen, there = learned > 0, totals > 0
    number = np.cumsum(there) - 1
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "trie")
        Trie.build(path, len(words), [c[there] for c in columns], totals[there], number[context[seen]], word[seen], learned[seen], p_below[seen])
        found = Trie(path).find(columns, context, word, below)
    return learned[gram], found[gram]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs, by n-grams of up to `order` tokens.

    The model learns from the rows that aren't held out. A null text is the empty text: one token, its end. A null id
    is learned from. Repeated rows count each for itself. Other columns are ignored. An empty table gives an empty table.
    """
    if order < 2:
        raise ValueError("the order must be 2 or more")
    spark = docs.sparkSession
    sent_row, answer_row = "shard long, block long, payload binary", "block long, level long, shard long, payload binary"
    with conf(spark, spark__sql__execution__arrow__maxBytesPerBatch=str(4 << 20)):
        blocks = scratch_table(pack_blocks(documents_of(docs, id_col, text_col), BLOCK_BYTES))
        size = max(blocks.count(), 1) * BLOCK_BYTES
        shards = partitions_for(spark, size, SHARD_BYTES)
        counted = scratch_table(_word_counts(blocks, shards))
        release(spark)
        n, v = (int(x or 0) for x in counted.agg(F.sum("n"), F.sum("v")).first())

        def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, payload, found in rows_of(batches):
                own = Tokens(payload)
                by, edge = own.buckets(shards)
                count, number = np.zeros(len(own.words), np.int64), np.zeros(len(own.words), np.int64)
                for x in found:
                    at = by[edge[x["bucket"]] : edge[x["bucket"] + 1]]
                    count[at], number[at] = unpack(x["payload"])
                    number[at] = number[at] * shards + x["bucket"]
                each = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
                base = np.add.reduceat(each[own.token], own.end - own.n + 1) if len(own.n) else np.zeros(0)
                known = np.add.reduceat((count[own.token] > 0).astype(np.int64), own.end - own.n + 1) if len(own.n) else np.zeros(0, np.int64)
                yield _rows("block long, payload binary", [(block, Grams.payload(own, count, number, known, base))])

        whole = blocks.join(counted.groupBy("block").agg(F.collect_list(F.struct("bucket", "payload")).alias("found")), "block")
        numbered = scratch_table(whole.mapInArrow(renamed, "block long, payload binary"))
        discard(blocks, counted)

        def asking(level: int, turn: int | None):
            def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for block, payload, *found in rows_of(batches):
                    own = Grams(payload, n, shards)
                    start = np.zeros(len(own.size), np.int64)
                    for k in range(2, level):
                        own.grow()
                        own.answered({x["shard"]: x["payload"] for x in found[0] if x["level"] == k})
                        start += own.starts()
                    own.grow()
                    if turn == 0:
                        yield _rows(sent_row, [(block % shards, block, b"B" + pack(own.ids, own.known, own.size, own.n_known, own.base, start))])
                    for k, body in own.sent(turn):
                        yield _rows(sent_row, [(k, block, b"P" + body)])

            return sent

        def answering(level: int):
            def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for shard, group in grouped(batches):
                    group = [(block, unpack(p[1:])) for _, block, p in group]
                    count, code = _scored([x for _, x in group], level, n, v)
                    at = 0
                    for block, x in group:
                        mine, at = slice(at, at + len(x[level + 1])), at + len(x[level + 1])
                        yield _rows(answer_row, [(block, level, shard, pack(narrow(count[mine]), narrow(code[mine])))])

            return answer

        def dealt(level: int, answers: DataFrame | None, turn: int | None = None) -> DataFrame:
            asked = numbered
            if answers is not None:
                asked = numbered.join(answers.groupBy("block").agg(F.collect_list(F.struct("level", "shard", "payload")).alias("found")), "block")
            tasks = shards if turn is None else partitions_for(spark, size / PASSES, SHARD_BYTES)
            return asked.mapInArrow(asking(level, turn), sent_row).repartition(tasks, "shard").sortWithinPartitions("shard")

        answers, tables = None, [numbered]
        for level in range(2, order):
            tables.append(scratch_table(dealt(level, answers).mapInArrow(answering(level), answer_row)))
            answers = tables[-1] if answers is None else answers.union(tables[-1])

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in grouped(batches):
            for _, block, payload in group:
                if payload[:1] == b"B":
                    yield _rows("block long, payload binary", [(block, payload)])
            group = [(block, unpack(p[1:])) for _, block, p in group if p[:1] == b"P"]
            if not group:
                continue
            _, found = _scored([x for _, x in group], order, n, v)
            at = 0
            for block, x in group:
                code = np.repeat(found[at : at + len(x[-2])], x[-2])
                at += len(x[-2])
                total = np.bincount(x[-1], code).astype(np.int64)
                some = np.flatnonzero(total)
                yield _rows("block long, payload binary", [(block, b"S" + pack(narrow(some), narrow(total[some])))])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (payloads,) in rows_of(batches):
            ids, known, size, n_known, base, start = unpack(next(p for p in payloads if p[:1] == b"B")[1:])
            total = start.astype(np.int64)
            for p in payloads:
                if p[:1] == b"S":
                    at, code = unpack(p[1:])
                    total[at] += code.astype(np.int64)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64(), mask=known == 0), "held_out": held_out(ids, known), "n_tokens": pa.array(size.astype(np.int64)), "n_known": pa.array(n_known.astype(np.int64)),
                "train_tokens": np.full(len(ids), n, np.int64), "base_score": base.astype(np.float64), "score": -total / STEPS,
            })

    with conf(spark, spark__sql__execution__arrow__maxBytesPerBatch=str(4 << 20)):
        sums = reduce(DataFrame.union, [scratch_table(dealt(order, answers, turn).mapInArrow(looked_up, "block long, payload binary")) for turn in range(PASSES)])
    discard(*tables)
    return sums.groupBy("block").agg(F.collect_list("payload").alias("payloads")).select("payloads").mapInArrow(gathered, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

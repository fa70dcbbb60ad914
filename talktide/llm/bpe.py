"""Byte-level BPE by way of a sentencepiece model that is serialised straight from a rank file.

Every byte is mapped to one character, so that any piece of the vocabulary is a string; a piece's score is its
negative rank, and the normaliser is the identity. Sentencepiece then joins the best-scored neighbours first, the
leftmost of equals, which is the order of the ranks. Each pre-token is encoded for itself; a pre-token that is a
whole entry of the vocabulary is that entry. Decoding is the inverse mapping of pieces to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from talktide.llm.common import bound_batches, documents_of

SHIFT = 0x100  # byte b is the character U+0100 + b
CACHE = 1_000_000  # pre-tokens that a worker remembers; a bound on memory only


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> list[bytes]:
    """Pieces by rank of a .tiktoken file (base64 and rank on each line); ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = sorted((int(r), base64.b64decode(p)) for p, r in (line.split() for line in f if line.strip()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be consecutive from 0")
    return [p for _, p in pairs]


def _as_chars(piece: bytes) -> str:
    return "".join(chr(SHIFT + b) for b in piece)


def serialise(pieces: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece i scored -i, the unknown piece last, BPE, identity normalisation."""
    normal = (_field(1, _field(1, _as_chars(p).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -float(i))) for i, p in enumerate(pieces))
    unknown = _field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2))
    trainer = _field(2, _number(3, 2) + _number(4, len(pieces) + 1))
    normaliser = _field(3, _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return b"".join(normal) + unknown + trainer + normaliser


class Codec:
    """Encoder and decoder of one model; `pattern` splits a text into pre-tokens."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        chars = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size() - 1)]
        self.back = [bytes(ord(c) - SHIFT for c in p) for p in chars]
        self.whole = {p: i for i, p in enumerate(self.back)}
        self.known: dict[str, bytes] = {}
        self.table = {b: chr(SHIFT + b) for b in range(256)}

    def learn(self, tokens: set[str]) -> None:
        new = tokens.difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.known = {}
            new = tokens
        rest = []
        for t in new:
            at = self.whole.get(t.encode())
            if at is None:
                rest.append(t)
            else:
                self.known[t] = at.to_bytes(4, "little")
        for t, ids in zip(rest, self.model.encode([t.encode().decode("latin-1").translate(self.table) for t in rest], num_threads=1), strict=True):
            self.known[t] = array("I", ids).tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        tokens = [self.find(t) for t in texts]
        self.learn(set().union(*tokens))
        return [b"".join(map(self.known.__getitem__, t)) for t in tokens]

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.back.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[bytes, Codec] = {}


def codec(model: bytes, pattern: str) -> Codec:
    """One per worker process and model."""
    key = hashlib.sha256(model + pattern.encode()).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model, pattern)
    return _CODECS[key]


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids binary, decoded binary, and the columns of `keep`) for each row of docs, in no order.

    A null text is the empty text, which has no ids; a null id stays null; repeated rows are encoded each for
    itself; an empty table gives an empty table; other columns are ignored unless kept. The vocabulary is read on
    the driver (a file of fixed size) and broadcast. Texts of any length: memory is that of one text and its ids.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(serialise(read_ranks(ranks)))
    rows = documents_of(docs, id_col, text_col) if not keep else docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *(docs[c] for c in keep))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            ids = own.encode_batch([t or "" for t in batch.column(1).to_pylist()])
            more = {c: batch.column(2 + i) for i, c in enumerate(keep)}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "ids": pa.array(ids, pa.binary()), "decoded": pa.array([own.decode(x) for x in ids], pa.binary())} | more)

    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(encoded, f"doc_id long, ids binary, decoded binary{more}")

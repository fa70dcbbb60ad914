import base64
import hashlib

import public_tokenizers as P
import tiktoken

from talktide.llm import bpe
from talktide.llm.queries import op8_byte_bpe, pre_token_pattern, ranks_path


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(data):
    return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]


def test_ids_are_those_of_the_rank_library_and_decode_to_the_text(spark, awkward, small):
    known = reference()
    docs = awkward.select("doc_id", "text").union(small.select("doc_id", "text"))
    texts = docs.collect()
    found = bpe.encode(docs, ranks_path(), pre_token_pattern()).collect()
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in found) == sorted((str(i), b"".join(x.to_bytes(4, "little") for x in known.encode_ordinary(t or ""))) for i, t in texts)
    assert all(bytes(r.decoded) == b"".join(known.decode_single_token_bytes(i) for i in ids_of(r.ids)) for r in found)


def test_random_strings():
    import random

    own, known = bpe.codec(bpe.serialise(bpe.read_ranks(ranks_path())), pre_token_pattern()), reference()
    draw = random.Random(7)
    alphabet = "aAeinrst  \n\t'l09.,-<>éßñ東 ▁́\U0001f600\x00\x1c\x85" + "the ing tion"
    for _ in range(3000):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randrange(60)))
        assert ids_of(own.encode(text)) == known.encode_ordinary(text), repr(text)
        assert own.decode(own.encode(text)) == text.encode()


def test_query(spark):
    rows = op8_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    texts = dict(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    known = reference()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = known.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_table_and_kept_columns(spark, empty, awkward):
    assert bpe.encode(empty, ranks_path(), pre_token_pattern()).count() == 0
    assert bpe.encode(awkward, ranks_path(), pre_token_pattern(), keep=("kept", "score")).columns == ["doc_id", "ids", "decoded", "kept", "score"]

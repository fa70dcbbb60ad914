import os
import random

import numpy as np
import pytest

from talktide.llm import bpe, token_files
from talktide.llm.queries import op1_token_counts, op8_byte_bpe, pre_token_pattern, ranks_path


@pytest.mark.parametrize("width", [2, 4])
def test_scan_of_flat_files(spark, tmp_path, width):
    draw, mark = random.Random(width), token_files.SEPARATORS[width]
    want = []
    for stream in range(3):
        flat = [mark if draw.random() < 0.05 else draw.randrange(300) for _ in range(draw.choice([1, 900, 2000]))]
        cuts = sorted({0, len(flat), *(draw.randrange(len(flat)) for _ in range(3))})
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            (tmp_path / f"part-{stream:05}-x-c{i:03}.txt").write_bytes(np.array(flat[a:b], f">u{width}").tobytes())
        n, first = 0, 0
        for i, t in enumerate(flat):
            if t == mark:
                want.append((stream, n, first, i - first, True))
                n, first = n + 1, i + 1
        if first < len(flat):
            want.append((stream, n, first, len(flat) - first, False))
    (tmp_path / "part-00003-x-c000.txt").write_bytes(b"")
    found = token_files.documents(token_files.blocks(spark, f"file://{tmp_path}", width, block=64 * width)).collect()
    assert sorted(map(tuple, found)) == sorted(want)


def test_a_broken_file_is_an_error(spark, tmp_path):
    (tmp_path / "part-00000-x-c000.txt").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole number of tokens"):
        token_files.blocks(spark, f"file://{tmp_path}").collect()


def test_files_hold_the_tokens(spark, tmp_path, small):
    token_files.write(small, f"file://{tmp_path}/out", ranks_path(), pre_token_pattern())
    own = bpe.codec(bpe.serialise(bpe.read_ranks(ranks_path())), pre_token_pattern())
    flat = b"".join((tmp_path / "out" / f).read_bytes() for f in sorted(os.listdir(tmp_path / "out")) if f.startswith("part-"))
    assert flat == b"".join(np.frombuffer(own.encode(r.text or ""), "<u4").astype(">u2").tobytes() + b"\xc4\x90" for r in small.collect())


def test_counts(spark, awkward, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "PER_FILE", 2)
    awkward.repartition(3).write.parquet(f"{tmp_path}/docs")
    stored = spark.read.parquet(f"{tmp_path}/docs")
    found = token_files.counts(stored, ranks_path(), pre_token_pattern()).collect()
    own = bpe.codec(bpe.serialise(bpe.read_ranks(ranks_path())), pre_token_pattern())
    assert sorted((str(r.doc_id), r.n_tokens) for r in found) == sorted((str(r.doc_id), len(own.encode(r.text or "")) // 4) for r in stored.collect())
    assert token_files.counts(empty, ranks_path(), pre_token_pattern()).count() == 0


def test_query_agrees_with_the_encoder(spark):
    counts = op1_token_counts(spark, "/root/testdata/sf0.001").select("doc_id", "n_tokens").collect()
    assert sorted(counts) == sorted(op8_byte_bpe(spark, "/root/testdata/sf0.001").select("doc_id", "n_tokens").collect())


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BATCH", 1 << 12)
    monkeypatch.setattr(token_files, "PER_FILE", 4)
    text = "some words of a document, " * 20
    spark.range(400).selectExpr("id doc_id", f"if(id % 7 = 0, '', '{text}') text").coalesce(1).write.parquet(f"{tmp_path}/docs")
    stored = spark.read.parquet(f"{tmp_path}/docs")
    token_files.write(stored, f"file://{tmp_path}/out", ranks_path(), pre_token_pattern())
    sizes = [os.path.getsize(tmp_path / "out" / f) for f in os.listdir(tmp_path / "out") if f.startswith("part-")]
    assert len(sizes) > 4 and max(sizes) < 4 * (1 << 13)
    found = token_files.counts(stored, ranks_path(), pre_token_pattern())
    n = len(bpe.codec(bpe.serialise(bpe.read_ranks(ranks_path())), pre_token_pattern()).encode(text)) // 4
    assert sorted((r.doc_id, r.n_tokens) for r in found.collect()) == [(i, n if i % 7 else 0) for i in range(400)]


def test_slices_of_a_large_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SLICE", 2)
    flat = np.arange(1000, dtype=">u2")
    flat[::37] = token_files.SEPARATORS[2]
    (tmp_path / "part-00000-x-c000.txt").write_bytes(flat.tobytes())
    found = token_files.blocks(spark, f"file://{tmp_path}", block=128).orderBy("block").collect()
    assert [(r.block, r.n_tokens) for r in found] == [(i, min(64, 1000 - 64 * i)) for i in range(16)]
    assert [64 * r.block + x for r in found for x in r.found] == list(range(0, 1000, 37))

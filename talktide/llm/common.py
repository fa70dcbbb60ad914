"""Shared parts of the training-data operators: inputs, scratch tables, packed blocks and bucketed blob shuffles.

Two data layouts recur. A *block* is one row that packs a few MB of whole documents; it lets a Python worker
handle text with numpy instead of row by row. A *blob row* is (bucket, block, payload): what one block has to say
to one bucket of a hash-partitioned exchange. Both keep the number of shuffled rows small and the memory of a
task bounded by the block size, whatever the size of the corpus.
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Arrow batches of about `size` bytes, so that a worker's memory doesn't depend on the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def documents_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), so that other columns of any name can't clash; a null text becomes the empty text."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; a local one only where that is unset and there are no other machines."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="talktide-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/talktide-{uuid.uuid4().hex}"


def scratch_table(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """The rows of df written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors.

    The step's shuffle files go when it is written, as nothing can read them again.
    """
    path = scratch_dir(df.sparkSession)
    with conf(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.option("compression", compression).parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.scratch_path = path
    return stored


def bucketed_table(df: DataFrame, key: str, compression: str = "zstd") -> DataFrame:
    """Like scratch_table, in files dealt by `key` as a shuffle would deal them: joins and groups by that key don't send its rows again.

    The catalog has it by a name, which discard() drops.
    """
    spark, name = df.sparkSession, f"talktide_{uuid.uuid4().hex}"
    path, n = scratch_dir(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    with conf(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.format("parquet").bucketBy(n, key).option("compression", compression).option("path", path).saveAsTable(name)
    stored = spark.table(name)
    stored.scratch_path, stored.scratch_name = path, name
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that no later step reads."""
    for t in tables:
        if hasattr(t, "scratch_name"):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {t.scratch_name}")
        hadoop = t.sparkSession._jvm.org.apache.hadoop.fs
        path = hadoop.Path(t.scratch_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Keys with at least this share of all rows are at most as many, whatever the corpus: what is joined to them is broadcast.
HOT = 1 << 14


def join_hot(rows: DataFrame, few: DataFrame, on: list[str], hot: int | None = None) -> DataFrame:
    """rows joined with `few`, which holds a row per key and, as n, how many of the rows have that key; both are stored tables.

    The rows of frequent keys aren't sent, so that they never meet in one task; the others are too few to make one long.
    """
    often = F.col("n") * (hot or HOT) >= F.lit(rows.count())
    rest = rows.join(F.broadcast(few.where(often).select(*on)), on, "left_anti")
    return rows.join(F.broadcast(few.where(often)), on).union(rest.join(few.where(~often), on))


def release(spark: SparkSession) -> None:
    """Let go of finished steps' frames here and in the driver's JVM, so that Spark's cleaner deletes their shuffle files."""
    for _ in range(2):  # what the first round lets go of, the second one finds
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)  # the cleaner works on its own thread


def partitions_for(spark: SparkSession, size: float, per_partition: float, least: int | None = None) -> int:
    """Shuffle partitions for `size` bytes at `per_partition` each, never below the session's own number."""
    return int(max(least or int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // per_partition)))


def bounded_ids(df: DataFrame, most: int) -> np.ndarray | None:
    """The sorted distinct values of df's only column if they are `most` or fewer, else None; nulls are left out."""
    values = df.where(df[0].isNotNull()).distinct().limit(most + 1).toArrow().column(0)
    return None if len(values) > most else np.sort(values.to_numpy())


def flat_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of a batch of texts, split at space and \t \n \v \f \r: (row of each word, dictionary of distinct words, index of each word)."""
    import pyarrow.compute as pc

    texts = texts.cast(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    row, words = pc.list_parent_indices(lists), pc.list_flatten(lists)
    real = pc.greater(pc.binary_length(words), 0)
    row, words = row.filter(real).to_numpy(zero_copy_only=False).astype(np.int64), words.filter(real).dictionary_encode()
    return row, words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    import xxhash

    one = xxhash.xxh64_intdigest
    return np.fromiter((one(w, seed) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def dense(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the keys among their distinct values, and how many those are."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    return inverse.astype(np.int64), len(distinct)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of starts[i] .. starts[i] + lengths[i] - 1, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


# ---- blobs of arrays

def pack(*arrays: np.ndarray, level: int | None = 1) -> bytes:
    """Arrays (or bytes) in one compressed payload."""
    import zstandard

    parts = []
    for a in arrays:
        raw, kind = (a, b"S") if isinstance(a, bytes) else (np.ascontiguousarray(a).tobytes(), a.dtype.str.encode())
        parts += [len(raw).to_bytes(8, "little"), len(kind).to_bytes(1, "little"), kind, raw]
    whole = b"".join(parts)
    return zstandard.ZstdCompressor(level=level).compress(whole)


def unpack(payload: bytes) -> list:
    import zstandard

    whole, at, out = memoryview(zstandard.ZstdDecompressor().decompress(payload)), 0, []
    while at < len(whole):
        size, k = int.from_bytes(whole[at : at + 8], "little"), whole[at + 8]
        kind, at = bytes(whole[at + 9 : at + 9 + k]), at + 9 + k
        raw, at = whole[at : at + size], at + size
        out.append(bytes(raw) if kind == b"S" else np.frombuffer(raw, np.dtype(kind.decode())))
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """The smallest unsigned type that holds a."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


BLOCK = "block long, payload binary"


def pack_blocks(docs: DataFrame, block_bytes: int = BATCH_BYTES) -> DataFrame:
    """(block, payload): whole documents packed by the order of the input's partitions; one longer than block_bytes has a block of its own.

    payload: ids (int64, with a validity byte each), byte lengths, UTF-8 bytes end to end.
    """
    bound_batches(docs.sparkSession)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        ids, texts, size = [], [], 0

        def out():
            nonlocal ids, texts, size, made
            known = np.array([x is not None for x in ids], np.uint8)
            body = pack(np.array([x or 0 for x in ids], np.int64), known, np.array([len(t) for t in texts], np.int64), b"".join(texts))
            made, ids, texts, size = made + 1, [], [], 0
            return pa.RecordBatch.from_pydict({"block": pa.array([base + made - 1], pa.int64()), "payload": pa.array([body], pa.binary())})

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                if size and size + len(text) > block_bytes:
                    yield out()
                ids.append(i)
                texts.append(text)
                size += len(text)
        if ids:
            yield out()

    return docs.mapInArrow(packed, BLOCK)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Consecutive rows of one value of the first column, of batches sorted by it."""
    key, group = None, []
    for row in rows_of(batches):
        if group and row[0] != key:
            yield key, group
            group = []
        key = row[0]
        group.append(row)
    if group:
        yield key, group


@contextlib.contextmanager
def conf(spark: SparkSession, **settings: str):
    """Session settings (dots as double underscores) held for a while."""
    keys = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

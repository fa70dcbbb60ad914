"""Token counts by a scan for separators in flat, unindexed token files.

A flat file is nothing but the tokens of one document after the other as big-endian unsigned integers of one width,
each document followed by the separator. Files are cut into blocks; each block is searched for the separator in one
vector comparison. Documents that cross blocks (and the files of one stream) are stitched by a prefix scan over the
blocks' token counts, separator counts and last separators; a stream is what one writing task has written, so the scan
never runs over the whole corpus in one task.

Writing needs no other file system than Spark's: the text writer puts each document's bytes as they are, and the
separator is its line separator. That is why separators are numbers whose bytes are UTF-8. A record of the writer is what
a batch of documents became, so files are bounded by bytes and not by documents: Spark reads a file as one value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talktide.llm.bpe import codec, read_ranks, serialise
from talktide.llm.common import bound_batches, documents_of, scratch_dir

#: Width in bytes -> separator: the UTF-8 bytes of U+0110 and U+10000, beyond the ids of any vocabulary that fits.
SEPARATORS = {2: 0xC490, 4: 0xF0908080}
BLOCK = 1 << 20
BATCH = 1 << 20  # bytes of texts whose tokens are one record
PER_FILE = 16  # records in a file
SLICE = 16  # blocks that Python gets at once


def write(docs: DataFrame, path: str, ranks: str, pattern: str, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the tokens of docs, a null text as no tokens, to flat files at path; one stream per partition, in the order of its rows."""
    spark, separator = docs.sparkSession, SEPARATORS[width]
    bound_batches(spark, BATCH)
    pieces = read_ranks(ranks)
    if len(pieces) > separator:
        raise ValueError("the vocabulary has the separator's id")
    shared = spark.sparkContext.broadcast(serialise(pieces))
    line = separator.to_bytes(width, "big")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            ids = own.encode_batch(batch.column(0).to_pylist())
            if ids:  # the writer puts the last separator
                yield pa.RecordBatch.from_pydict({"tokens": pa.array([line.join(np.frombuffer(x, "<u4").astype(f">u{width}").tobytes() for x in ids)], pa.binary())})

    tokens = documents_of(docs, id_col, text_col).select("text").mapInArrow(encoded, "tokens binary")
    tokens.select(F.col("tokens").cast("string").alias("value")).write.option("lineSep", line.decode()).option("maxRecordsPerFile", PER_FILE).text(path)


def blocks(spark: SparkSession, path: str, width: int = 2, separator: int | None = None, block: int = BLOCK) -> DataFrame:
    """(stream, file, block, n_tokens, found): for each block of a stream's numbered files, its tokens and the places of separators in it."""
    bound_batches(spark)
    mark = SEPARATORS[width] if separator is None else separator
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    whole = F.when(F.col("length") % width == 0, F.col("length")).otherwise(F.raise_error(F.concat(F.lit("not a whole number of tokens: "), "path")))
    cut = files.where("length > 0").select(F.regexp_extract(name, r"^part-(\d+)", 1).cast("long").alias("stream"), F.coalesce(F.try_to_number(F.regexp_extract(name, r"-c(\d+)(?:\.[a-z]+)?$", 1), F.lit("9" * 18)).cast("long"), F.lit(0).cast("long")).alias("file"), "content", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((whole - 1) / (SLICE * block)))).alias("slice"))
    # a file of one slice, as write() makes them, is sent as it is: each substring would first copy the whole file
    of_slice = F.when(F.col("length") <= SLICE * block, F.col("content")).otherwise(F.substring("content", (F.col("slice") * (SLICE * block) + 1).cast("int"), F.lit(SLICE * block)))
    pieces = cut.select("stream", "file", "slice", of_slice.alias("raw"))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = block // width
        for batch in batches:
            for stream, file, part, raw in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                tokens = np.frombuffer(raw.as_buffer(), f">u{width}")
                each = [tokens[i : i + step] for i in range(0, len(tokens), step)]
                yield pa.RecordBatch.from_pydict({
                    "stream": pa.array([stream] * len(each), pa.int64()), "file": pa.array([file] * len(each), pa.int64()), "block": pa.array(range(part * SLICE, part * SLICE + len(each)), pa.int64()),
                    "n_tokens": pa.array([len(t) for t in each], pa.int64()), "found": pa.array([np.flatnonzero(t == mark) for t in each], pa.list_(pa.int64())),
                })

    return pieces.mapInArrow(searched, "stream long, file long, block long, n_tokens long, found array<long>")


def documents(scanned: DataFrame) -> DataFrame:
    """(stream, doc_no, first_token, n_tokens, ended): every document of every stream, in order from 0; what stands behind a stream's last separator is one that hasn't ended."""
    before = Window.partitionBy("stream").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))
    placed = scanned.withColumn("start", start)
    last = F.when(F.size("found") > 0, F.col("start") + F.element_at("found", -1))
    placed = placed.withColumn("last", last)
    placed = placed.withColumns({"docs": F.coalesce(F.sum(F.size("found").cast("long")).over(before), F.lit(0).cast("long")), "previous": F.coalesce(F.max("last").over(before), F.lit(-1).cast("long"))})
    ends = placed.select("stream", "docs", F.col("previous").alias("before"), F.transform("found", lambda x: x + F.col("start")).alias("ends"))
    begins = F.concat(F.array("before"), F.slice("ends", 1, F.size("ends") - 1))
    each = ends.where(F.size("ends") > 0).select("stream", "docs", F.posexplode(F.arrays_zip(begins.alias("a"), F.col("ends").alias("b"))).alias("i", "x"))
    ended = each.select("stream", (F.col("docs") + F.col("i")).alias("doc_no"), (F.col("x.a") + 1).alias("first_token"), (F.col("x.b") - F.col("x.a") - 1).alias("n_tokens"), F.lit(True).alias("ended"))
    totals = placed.groupBy("stream").agg(F.sum("n_tokens").alias("tokens"), F.sum(F.size("found").cast("long")).alias("docs"), F.coalesce(F.max("last"), F.lit(-1).cast("long")).alias("last"))
    rest = totals.where("tokens - last - 1 > 0").select("stream", F.col("docs").alias("doc_no"), (F.col("last") + 1).alias("first_token"), (F.col("tokens") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.union(rest)


def counts(docs: DataFrame, ranks: str, pattern: str, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stream, doc_no, first_token, n_tokens) of every row of docs, counted in flat files written to the shared folder.

    docs must be a stored table, whose rows have the same places each time it is read: the files carry no ids, so the
    n-th document of a stream is the n-th row of the partition; a difference in their numbers is an error. A null or
    empty text has no tokens; null ids and repeated rows come back each for itself; other columns are ignored; an
    empty table gives an empty table.
    """
    spark = docs.sparkSession
    path = scratch_dir(spark)
    write(docs, path, ranks, pattern, width, id_col, text_col)
    place = F.monotonically_increasing_id()
    rows = documents_of(docs, id_col, text_col).select("doc_id", F.shiftright(place, 33).alias("stream"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("doc_no"), F.lit(True).alias("there"))
    both = rows.join(documents(blocks(spark, path, width)), ["stream", "doc_no"], "full")
    sound = F.when(F.col("there").isNotNull() & F.col("ended"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("the files don't hold the rows of the table")).cast("long"))
    return both.select("doc_id", "stream", "doc_no", "first_token", sound.alias("n_tokens"))

"""Sources: tables of segments and turns, media listings, fixtures and data set lists; models are plugged in as functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = "media_id string, seq int, start double, end double, text string"
TURNS = "media_id string, seq int, start double, end double, speaker string"


def media(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(media_id, path, bytes) of the files at path; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("media_id"), "path", F.col("length").alias("bytes"))


def segments_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).json(path)


def turns_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TURNS).json(path)


def recognise(chunks: DataFrame, model: Callable[[bytes, str | None], list[tuple[float, float, str]]], language: str | None = None) -> DataFrame:
    """Segments (media_id, chunk_idx, seq, start, end, text) of (media_id, chunk_idx, content) by a pluggable recogniser, called once per chunk."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(m, c, i, *s) for m, c, content in zip(*(x.to_pylist() for x in batch.columns), strict=True) for i, s in enumerate(model(content, language))]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["media_id", "chunk_idx", "seq", "start", "end", "text"])

    return chunks.select(F.col("media_id").cast("string"), F.col("chunk_idx").cast("int"), "content").mapInArrow(made, "media_id string, chunk_idx int, seq int, start double, end double, text string")


def diarise(files: DataFrame, model: Callable[[bytes], list[tuple[float, float, str]]]) -> DataFrame:
    """Turns of (media_id, content) by a pluggable diariser."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(m, i, *t) for m, content in zip(*(x.to_pylist() for x in batch.columns), strict=True) for i, t in enumerate(model(content))]
            kinds = (pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["media_id", "seq", "start", "end", "speaker"])

    return files.select(F.col("media_id").cast("string"), "content").mapInArrow(made, TURNS)


def dataset_items(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Rows of a tab-separated list without a header as an array, those with at least `columns` fields; pos keeps their order in a file."""
    lines = spark.read.text(path).withColumn("fields", F.split("value", "\t", -1)).where(F.size("fields") >= columns)
    return lines.select(F.monotonically_increasing_id().alias("pos"), "fields")


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def threshold(flat: str, per_mode: str, mode: str):
    """A threshold for a mode, from a flat one or one by mode."""
    return F.coalesce(F.col(f"{per_mode}.{mode}"), F.col(flat))

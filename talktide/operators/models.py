"""Operators that need an external model, with the model as a function: embeddings of prototypes, casing by a tagger."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talktide import lexicons as L


def prototypes(spark: SparkSession, encode: Callable[[list[str]], list[list[float]]], lang: str) -> DataFrame:
    """(kind, text, embedding) of the question and exclamation prototypes of a language, English without one; a table of fixed size."""
    pick = lambda lists: lists.get(lang, lists["en"])
    rows = [(kind, t) for kind, lists in (("question", L.QUESTION_PROTOTYPES), ("exclamation", L.EXCLAMATION_PROTOTYPES)) for t in pick(lists)]
    vectors = encode([t for _, t in rows])
    return spark.createDataFrame([(k, t, [float(x) for x in v]) for (k, t), v in zip(rows, vectors, strict=True)], "kind string, text string, embedding array<float>")


def embed(texts: DataFrame, encode: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(id, text, embedding) of (id, text), a batch of texts per call."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "text": batch.column(1), "embedding": pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float32()))})

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(made, f"id {kind}, text string, embedding array<float>")


def capitalise(text: str, names: list[tuple[int, int]], lang: str) -> str:
    """A capital for each word in the character ranges that a tagger calls names, but for connectors, addresses and handles."""
    keep = {*L.NAME_CONNECTORS, *(L.ES_POSSESSIVES if lang == "es" else ())}
    out = list(text)
    for a, b in names:
        at = a
        for word in text[a:b].split(" "):
            if word and word.lower() not in keep and not any(c in word for c in "@/") and "." not in word.strip(".") and word[0].islower():
                out[at] = word[0].upper()
            at += len(word) + 1
    return "".join(out)


def entity_casing(texts: DataFrame, tagger: Callable[[str, str], list[tuple[int, int]]]) -> DataFrame:
    """(id, text) of (id, lang, text) with names in capitals; tagger(text, lang) gives the ranges of names."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "text": pa.array([t and capitalise(t, tagger(t, lang), lang) for lang, t in rows], pa.string())})

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "lang", "text").mapInArrow(made, f"id {kind}, text string")


def foreign_words(words: DataFrame, lexicon: DataFrame, reach: int = 2) -> DataFrame:
    """Words (media_id, word_idx, word) that stand within `reach` words of one in the lexicon (word) of another language."""
    from pyspark.sql import Window

    marks = lexicon.select(F.lower("word").alias("w")).distinct().withColumn("hit", F.lit(1))
    flagged = words.join(marks, F.lower("word") == F.col("w"), "left")
    near = Window.partitionBy("media_id").orderBy("word_idx").rowsBetween(-reach, reach)
    return flagged.withColumn("foreign", F.coalesce(F.max("hit").over(near), F.lit(0)) == 1).drop("w", "hit")

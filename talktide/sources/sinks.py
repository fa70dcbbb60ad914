"""Sinks: subtitles, paragraphs, dumps. Each medium's lines are one row of text, in order, so that writers stay parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talktide.functions import text as T
from talktide.operators.segments import raw_dump, srt_text
from talktide.operators.speakers import attribute

LEAST_WORDS = 3


def _joined(rows: DataFrame, order: str, line: str, between: str = "\n\n") -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line])
    return rows.groupBy("media_id").agg(F.array_join(lines, between).alias("value"))


def srt(cues: DataFrame) -> DataFrame:
    return _joined(srt_text(cues), "idx", "cue")


def raw(segments: DataFrame, language: str | None = None, task: str = "transcribe") -> DataFrame:
    return _joined(raw_dump(segments, language, task), "idx", "line", "\n")


def pieces(sentence: Column) -> Column:
    """A sentence's paragraphs: by speaker if it has several, each with LEAST_WORDS words or more, else as a whole."""
    said = F.filter(sentence["utterances"], lambda u: F.trim(u["text"]) != "")
    start = F.array().cast("array<struct<text:string,speaker:string>>")
    last = lambda done: F.try_element_at(done, F.lit(-1))
    join = lambda done, u: F.when((F.size(done) > 0) & last(done)["speaker"].eqNullSafe(u["speaker"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.concat_ws(" ", last(done)["text"], u["text"]).alias("text"), u["speaker"].alias("speaker"))))).otherwise(F.concat(done, F.array(F.struct(u["text"].alias("text"), u["speaker"].alias("speaker")))))
    runs = F.aggregate(said, start, join)
    long_ = F.forall(runs, lambda u: F.size(T.words(u["text"])) >= LEAST_WORDS)
    return F.when((F.size(runs) > 1) & long_, F.transform(runs, lambda u: u["text"])).otherwise(F.array(sentence["text"]))


def paragraphs(sentences: DataFrame, lang: str | None = None) -> DataFrame:
    """(media_id, idx, piece, paragraph) of (media_id, sentences), blank ones left out."""
    each = sentences.select("media_id", F.posexplode("sentences").alias("idx", "s")).select("media_id", "idx", F.posexplode(pieces(F.col("s"))).alias("piece", "text"))
    return each.where(F.trim("text") != "").select("media_id", "idx", "piece", T.paragraph(F.col("text"), lang).alias("paragraph"))


def txt(sentences: DataFrame, lang: str | None = None) -> DataFrame:
    rows = paragraphs(sentences, lang).select("media_id", F.struct("idx", "piece").alias("place"), "paragraph")
    return _joined(rows, "place", "paragraph")


def diarisation_dump(merged: DataFrame, sources: DataFrame) -> DataFrame:
    """(media_id, timestamp, sources): where each merged boundary comes from."""
    return attribute(merged, sources)


def write_text(rows: DataFrame, path: str) -> None:
    """One folder per medium."""
    rows.select("media_id", "value").write.mode("overwrite").partitionBy("media_id").text(path)

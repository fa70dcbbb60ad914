"""Pipelines: segments (and turns) to subtitles, or to sentences and paragraphs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talktide.functions import text as T
from talktide.operators import merge, segments as S, speakers, split
from talktide.sources import sinks

FORMATS = ("txt", "srt")


@dataclass
class Transcript:
    """Lazy frames; output is (media_id, value)."""

    segments: DataFrame
    output: DataFrame
    sentences: DataFrame | None = None
    history: DataFrame | None = None
    turns: DataFrame | None = None


def normalised(segments: DataFrame) -> DataFrame:
    """Segment texts as they stand in the joined text: initials closed up, white space single."""
    return segments.withColumn("text", F.trim(F.regexp_replace(T.initials(F.coalesce("text", F.lit(""))), r"(?U)\s+", " ")))


def joined(segments: DataFrame) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return segments.where("text != ''").groupBy("media_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))


def sentences(segments: DataFrame, turns: DataFrame | None, lang: str, similarity: Callable[[str, str], float] | None = None) -> DataFrame:
    """(media_id, sentences, removed): one shuffle by medium, then all windows and folds reuse it."""
    own = normalised(segments)
    text = joined(own)
    ends = S.word_ends(own, S.words_of(text)).groupBy("media_id").agg(F.collect_list("word_idx").alias("segment_ends"))
    rows = text.join(ends, "media_id", "left")
    if turns is None:
        rows = rows.withColumn("turns", F.lit(None).cast("array<struct<start_word:int,end_word:int,speaker:string>>"))
    else:
        ranges = speakers.word_ranges(speakers.char_ranges(turns, own), text)
        rows = rows.join(ranges.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word", "speaker"))).alias("turns")), "media_id", "left")
    return split.split_texts(rows.withColumn("lang", F.lit(lang)), similarity)


def transcribe(segments: DataFrame, turns: DataFrame | None = None, lang: str = "en", output_format: str = "txt", epsilon: float = S.EPSILON, similarity: Callable[[str, str], float] | None = None) -> Transcript:
    """Segments of any number of media to text in the given format."""
    if output_format not in FORMATS:
        raise ValueError(f"output_format must be one of {FORMATS}")
    kept = S.dedupe(segments, epsilon)
    if output_format == "srt":
        return Transcript(kept, sinks.srt(S.srt_cues(kept)), turns=turns)
    found = sentences(kept, turns, lang, similarity)
    ended = found.withColumn("sentences", F.transform("sentences", lambda s: s.withField("text", T.terminal_punctuation(s["text"], F.lit(lang), "sentence_end"))))
    merged = merge.format_sentences(ended.withColumn("lang", F.lit(lang)))
    return Transcript(kept, sinks.txt(_spoken(merged), lang), ended, merged.select("media_id", F.explode("history").alias("h")).select("media_id", "h.*"), turns)


def _spoken(merged: DataFrame) -> DataFrame:
    """Sentences with their utterances; one without any is an utterance of its speaker."""
    whole = lambda s: F.array(F.struct(s["text"].alias("text"), s["speaker"].alias("speaker")))
    return merged.select("media_id", F.transform("sentences", lambda s: s.withField("utterances", F.when(F.size(s["utterances"]) > 0, s["utterances"]).otherwise(whole(s)))).alias("sentences"))

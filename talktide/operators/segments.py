"""Operators on timed segments: (media_id, seq, start, end, text). Order is (start, seq) or seq; both columns are explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talktide.functions.text import timestamp

CHUNK_SECONDS, OVERLAP_SECONDS, EPSILON = 480, 3, 0.05


def chunk_windows(media: DataFrame, chunk_seconds: int = CHUNK_SECONDS, overlap_seconds: int = OVERLAP_SECONDS) -> DataFrame:
    """(media_id, chunk_idx, start_sec, duration_sec): overlapping windows over len_ms, up to the first that reaches the end."""
    chunk, step = chunk_seconds * 1000, max(1, (chunk_seconds - max(0, overlap_seconds)) * 1000)
    n = F.col("len_ms")
    last = F.greatest(F.ceil((n - chunk) / step), F.lit(0)).cast("long")
    each = media.where("len_ms > 0").select("media_id", "len_ms", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    start = F.col("k") * step
    return each.select("media_id", F.col("k").cast("int").alias("chunk_idx"), (start / 1000.0).alias("start_sec"), ((F.least(start + chunk, n) - start) / 1000.0).alias("duration_sec"))


def keep_advancing(rows: Column, last: Column, epsilon: float) -> Column:
    """Fold over an ordered array of structs with `end`: a row stays if it ends beyond the last KEPT end by more than epsilon."""
    start = F.struct(F.array().cast("array<int>").alias("kept"), last.cast("double").alias("last"))
    numbered = F.transform(rows, lambda x, i: F.struct(x["end"].alias("end"), i.alias("i")))
    step = lambda s, x: F.when(x["end"] <= s["last"] + F.lit(epsilon), s).otherwise(F.struct(F.concat(s["kept"], F.array(x["i"])).alias("kept"), F.greatest(s["last"], x["end"]).alias("last")))
    return F.aggregate(numbered, start, step)


def dedupe(segments: DataFrame, epsilon: float = EPSILON, last_end: float = 0.0) -> DataFrame:
    """The segments that advance their medium. The rule looks at kept rows only, so a running maximum is not the same."""
    cols = [c for c in segments.columns if c != "media_id"]
    lists = segments.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("seq", *(c for c in cols if c != "seq")))).alias("rows"))
    state = lists.withColumn("state", keep_advancing(F.col("rows"), F.lit(last_end), epsilon))
    kept = state.select("media_id", F.explode(F.transform("state.kept", lambda i: F.get("rows", i))).alias("r"))
    return kept.select("media_id", *(F.col(f"r.{c}").alias(c) for c in cols))


def globalise(segments: DataFrame, chunk_start: str = "chunk_start", epsilon: float = EPSILON, last_end: float = 0.0) -> DataFrame:
    """(media_id, text, n_segments, last_end): chunk times made global, overlaps dropped, stripped texts joined by newlines."""
    shifted = segments.withColumns({"start": F.col("start") + F.col(chunk_start), "end": F.col("end") + F.col(chunk_start)}).drop(chunk_start)
    kept = dedupe(shifted, epsilon, last_end)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.trim("text").alias("t")))), lambda x: x["t"])
    return kept.groupBy("media_id").agg(F.array_join(texts, "\n").alias("text"), F.count("*").alias("n_segments"), F.max("end").alias("last_end"))


def srt_cues(segments: DataFrame, max_duration: float = 5.0, min_gap: float = 0.25, min_duration: float = 2.0, chars_per_second: float = 15.0) -> DataFrame:
    """The segments as subtitle cues, their ends bounded by reading time, length and the next cue; adds end_before."""
    w = Window.partitionBy("media_id").orderBy("start", "seq")
    text = F.trim(F.coalesce("text", F.lit("")))
    length = F.length(text)
    desired = F.when(length == 0, min_duration).otherwise(F.greatest(F.lit(min_duration), F.least(F.lit(max_duration), length / F.lit(chars_per_second))))
    base = segments.select("media_id", "seq", "start", F.coalesce("end", "start").alias("end_before"), text.alias("text"), F.lead("start").over(w).alias("next"), desired.alias("desired"))
    end = F.least("end_before", F.col("start") + F.lit(max_duration), F.col("start") + F.col("desired"))
    gap = F.col("next") - F.lit(min_gap)
    end = F.when(gap > F.col("start"), F.least(end, gap)).otherwise(end)
    return base.select("media_id", "seq", "start", F.when(end <= F.col("start"), F.col("start") + F.lit(min_duration)).otherwise(end).alias("end"), "text", "end_before")


def srt_text(cues: DataFrame) -> DataFrame:
    """(media_id, idx, cue): the text of each cue, numbered from 1."""
    w = Window.partitionBy("media_id").orderBy("start", "seq")
    numbered = cues.withColumn("idx", F.row_number().over(w))
    return numbered.select("media_id", "idx", F.concat(F.col("idx").cast("string"), F.lit("\n"), timestamp(F.col("start")), F.lit(" --> "), timestamp(F.col("end")), F.lit("\n"), F.trim("text")).alias("cue"))


def trim_stats(cues: DataFrame, least: float = 0.0005) -> DataFrame:
    """(media_id, n_trimmed, max_trim, total_trim) of ends that were brought forward."""
    cut = F.col("end_before") - F.col("end")
    hit = F.when(cut > least, cut)
    return cues.groupBy("media_id").agg(F.count(hit).alias("n_trimmed"), F.coalesce(F.max(hit), F.lit(0.0)).alias("max_trim"), F.coalesce(F.sum(hit), F.lit(0.0)).alias("total_trim"))


def raw_dump(segments: DataFrame, language: str | None = None, task: str = "transcribe") -> DataFrame:
    """(media_id, idx, line): a header at 0, then every segment with two decimals."""
    w = Window.partitionBy("media_id").orderBy("start", "seq")
    body = segments.select("media_id", F.row_number().over(w).alias("idx"), "start", "end", F.trim("text").alias("text"))
    lines = body.select("media_id", "idx", F.format_string("Segment %d: %.2fs - %.2fs\nText: %s\n", "idx", "start", "end", "text").alias("line"))
    head = segments.groupBy("media_id").agg(F.format_string(f"Language: {language or 'unknown'}\nTask: {task}\nNumber of segments: %d\n", F.count("*")).alias("line"))
    return head.select("media_id", F.lit(0).alias("idx"), "line").unionByName(lines)


def char_ends(segments: DataFrame) -> DataFrame:
    """(media_id, seq, start, end, text, char_start, char_end): places of the stripped, non-blank texts in their joined text."""
    w = Window.partitionBy("media_id").orderBy("seq")
    some = segments.withColumn("text", F.trim("text")).where("text != ''")
    ends = some.withColumn("char_end", F.sum(F.length("text") + 1).over(w) - 1)
    return ends.withColumn("char_start", F.col("char_end") - F.length("text"))


def terminal_marks(segments: DataFrame) -> DataFrame:
    """(media_id, char_pos, mark) of segments that end in . ! or ?"""
    return char_ends(segments).select("media_id", (F.col("char_end") - 1).alias("char_pos"), F.right("text", F.lit(1)).alias("mark")).where("mark in ('.', '!', '?')")


def boundary_chars(boundaries: DataFrame, segments: DataFrame) -> DataFrame:
    """(media_id, ord, char_pos): each time becomes the end of the first segment that contains it, else of the one ending last
    before it, else of the first that starts after it; equal places once, in the order of the boundaries (media_id, ord, t)."""
    places = char_ends(segments).select("media_id", "seq", "start", "end", "char_end")
    both = boundaries.join(places, "media_id")
    tier = F.when((F.col("start") <= F.col("t")) & (F.col("t") <= F.col("end")), 0).when(F.col("end") <= F.col("t"), 1).when(F.col("start") >= F.col("t"), 2)
    far = F.when(tier == 1, F.col("t") - F.col("end")).otherwise(F.lit(0.0))
    best = both.where(tier.isNotNull()).groupBy("media_id", "ord").agg(F.min_by("char_end", F.struct(tier, far, "seq")).alias("char_pos"))
    return best.groupBy("media_id", "char_pos").agg(F.min("ord").alias("ord"))


def words_of(texts: DataFrame) -> DataFrame:
    """(media_id, word_idx, word, char_start, char_end) of single-spaced texts."""
    each = texts.select("media_id", F.posexplode(F.split("text", " ")).alias("word_idx", "word"))
    w = Window.partitionBy("media_id").orderBy("word_idx")
    ends = each.withColumn("char_end", F.sum(F.length("word") + 1).over(w) - 1)
    return ends.select("media_id", "word_idx", "word", (F.col("char_end") - F.length("word")).alias("char_start"), "char_end")


def chars_to_words(places: DataFrame, words: DataFrame, slack: int = 3) -> DataFrame:
    """(media_id, word_idx): the first word whose place, with `slack` characters behind it, holds each char_pos; each word once."""
    hit = places.join(words, "media_id").where(F.col("char_pos").between(F.col("char_start"), F.col("char_end") + slack))
    return hit.groupBy("media_id", "char_pos").agg(F.min("word_idx").alias("word_idx")).select("media_id", "word_idx").distinct()


def word_ends(segments: DataFrame, words: DataFrame) -> DataFrame:
    """(media_id, word_idx): the word in which each segment's last character stands."""
    last = char_ends(segments).select("media_id", (F.col("char_end") - 1).alias("p"))
    return last.join(words, "media_id").where((F.col("char_start") <= F.col("p")) & (F.col("p") < F.col("char_end"))).select("media_id", "word_idx").distinct()

"""The transcript tables, derived from the tables at hand; the same arithmetic as VIEWS_SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a medium, each turn a segment that takes a second for 15 characters."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.length("text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").withColumn("chars", F.sum(n).over(w) - n)
    return rows.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("seq"), (F.col("chars") / F.lit(15.0)).alias("start"), ((F.col("chars") + n) / F.lit(15.0)).alias("end"), "text", F.col("role").alias("speaker"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min("ts").over(Window.partitionBy("user_id"))
    micros = F.expr("timestampdiff(MICROSECOND, first, ts)")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", "event_type").withColumn("first", first)
    return rows.select("user_id", "event_id", "value", "event_type", (micros / F.lit(3.6e9)).alias("start"))


def overlap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as overlapping segments, in hours."""
    w = Window.partitionBy("user_id").orderBy("start", "event_id")
    return _events(spark, sf_dir).select(F.col("user_id").alias("media_id"), F.row_number().over(w).alias("seq"), "start", (F.col("start") + F.col("value") / 10).alias("end"), F.col("event_type").alias("text"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as turns that last until the next one."""
    w = Window.partitionBy("user_id").orderBy("start", "event_id")
    return _events(spark, sf_dir).select(F.col("user_id").alias("media_id"), F.row_number().over(w).alias("seq"), "start", F.coalesce(F.lead("start").over(w), F.col("start") + 1).alias("end"), F.col("event_type").alias("speaker"))


def shifted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments' own speakers, each turn two seconds late: overlaps with two segments."""
    return segments(spark, sf_dir).select("media_id", "seq", (F.col("start") + 2).alias("start"), (F.col("end") + 2).alias("end"), "speaker")


def joined_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, text) of the segments' texts, single-spaced."""
    one = F.trim(F.regexp_replace("text", r"\s+", " "))
    parts = F.array_sort(F.collect_list(F.struct("seq", one.alias("t"))))
    return segments(spark, sf_dir).where(one != "").groupBy("media_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("text"))


def spaced_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))


VIEWS_SQL = r"""
WITH segments AS (
  SELECT conv_id AS media_id, turn AS seq, (sum(length(text)) OVER w - length(text)) / 15.0::DOUBLE AS "start", (sum(length(text)) OVER w) / 15.0::DOUBLE AS "end", text, role AS speaker
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), base AS (
  SELECT user_id, event_id, value, event_type, date_diff('microsecond', min(ts) OVER (PARTITION BY user_id), ts) / 3.6e9::DOUBLE AS "start" FROM events
), overlap_segments AS (
  SELECT user_id AS media_id, row_number() OVER w AS seq, "start", "start" + value / 10 AS "end", event_type AS text FROM base WINDOW w AS (PARTITION BY user_id ORDER BY "start", event_id)
), turns AS (
  SELECT user_id AS media_id, row_number() OVER w AS seq, "start", coalesce(lead("start") OVER w, "start" + 1) AS "end", event_type AS speaker FROM base WINDOW w AS (PARTITION BY user_id ORDER BY "start", event_id)
), spaced AS (
  SELECT media_id, seq, "start", "end", trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, speaker FROM segments
), places AS (
  SELECT media_id, seq, "start", "end", text, (sum(length(text) + 1) OVER (PARTITION BY media_id ORDER BY seq) - 1)::BIGINT AS char_end FROM spaced WHERE text <> ''
), joined AS (
  SELECT media_id, string_agg(text, ' ' ORDER BY seq) AS text FROM spaced WHERE text <> '' GROUP BY media_id
), words AS (
  SELECT media_id, unnest(range(len(l)))::INT AS word_idx, unnest(l) AS word FROM (SELECT media_id, string_split(text, ' ') AS l FROM joined)
)
"""

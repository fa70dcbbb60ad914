"""Operators on speaker turns (media_id, seq, start, end, speaker): boundaries, clusters, places in the text, utterances."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talktide.operators.segments import char_ends

SHORT_BOUNDARY, SHORT_TURN, SHORT_OVERLAP = 0.5, 1.3, 0.3
NEAR = 1.0


def boundaries(turns: DataFrame, least: float = SHORT_BOUNDARY) -> DataFrame:
    """(media_id, seq, timestamp, from_speaker, to_speaker, segment_duration, included, reason) where the speaker changes."""
    w = Window.partitionBy("media_id").orderBy("start", "seq")
    next_ = turns.withColumn("to_speaker", F.lead("speaker").over(w)).withColumn("more", F.lead(F.lit(True)).over(w))
    length = F.col("end") - F.col("start")
    changed = next_.where(F.col("more") & ~F.col("speaker").eqNullSafe(F.col("to_speaker")))
    reason = F.when(length >= least, "included").otherwise(F.format_string(f"segment too short (%.2fs < {least}s)", length))
    return changed.select("media_id", "seq", F.col("end").alias("timestamp"), F.col("speaker").alias("from_speaker"), "to_speaker", length.alias("segment_duration"), (length >= least).alias("included"), reason.alias("reason"))


def cluster(values: Column, epsilon: float) -> Column:
    """Ascending values without those within epsilon of the last kept one (of the cluster's head, not of the neighbour)."""
    step = lambda done, x: F.when((F.size(done) > 0) & (x - F.element_at(done, -1) <= epsilon), done).otherwise(F.concat(done, F.array(x)))
    return F.aggregate(F.array_sort(values), F.array().cast("array<double>"), step)


def merge_boundaries(segments: Column, speakers: Column, epsilon: float = NEAR) -> Column:
    """Both lists as one, clustered; where one is null the other is only sorted."""
    none = F.array().cast("array<double>")
    return F.when(segments.isNull() & speakers.isNull(), none).when(segments.isNull(), F.array_sort(speakers)).when(speakers.isNull(), F.array_sort(segments)).otherwise(cluster(F.concat(speakers, segments), epsilon))


def attribute(merged: DataFrame, sources: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(media_id, timestamp, sources): names of the sources (media_id, source, timestamp) of each merged boundary."""
    s = sources.select("media_id", F.col("timestamp").alias("t"), "source")
    hit = merged.join(s, "media_id", "left").where(F.col("t").isNull() | (F.abs(F.col("timestamp") - F.col("t")) < tolerance))
    return hit.groupBy("media_id", "timestamp").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def talk_time(turns: DataFrame) -> DataFrame:
    """(media_id, speaker, n_turns, seconds)"""
    return turns.groupBy("media_id", "speaker").agg(F.count("*").alias("n_turns"), F.sum(F.col("end") - F.col("start")).alias("seconds"))


def speaker_count(turns: DataFrame) -> DataFrame:
    return turns.groupBy("media_id").agg(F.countDistinct("speaker").alias("num_speakers"))


def nearest_segment(times: DataFrame, segments: DataFrame) -> DataFrame:
    """(media_id, ord, seq): the segment whose end is nearest to each time; the first of equals."""
    return times.join(segments.select("media_id", "seq", "end"), "media_id").groupBy("media_id", "ord").agg(F.min_by("seq", F.struct(F.abs(F.col("end") - F.col("t")), "seq")).alias("seq"))


# ---- turns to characters to words

def _snap(text: Column, at: Column, low: Column, high: Column) -> Column:
    """The nearest space in [low, high), the lower of equals, else `at`."""
    spaces = F.filter(F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<int>")), lambda p: F.substring(text, p + 1, F.lit(1)) == " ")
    best = F.array_min(F.transform(spaces, lambda p: F.struct(F.abs(p - at).alias("d"), p.alias("p"))))
    return F.coalesce(best["p"], at)


def char_ranges(turns: DataFrame, segments: DataFrame, short_turn: float = SHORT_TURN, short_overlap: float = SHORT_OVERLAP) -> DataFrame:
    """(media_id, start_char, end_char, speaker): the stretches of each speaker in the joined text of normalised segments.

    A segment with one speaker is theirs; where one of two speakers dominates and the other is at an edge, it is the
    dominant one's; otherwise it is split in proportion, at spaces. Neighbouring stretches of one speaker are joined.
    """
    seg = char_ends(segments).select("media_id", "seq", "start", "end", "text", "char_start", "char_end")
    t = turns.where(F.col("end") - F.col("start") >= short_turn).select("media_id", F.col("seq").alias("turn"), F.col("start").alias("t0"), F.col("end").alias("t1"), "speaker")
    a, b = F.greatest("start", "t0"), F.least("end", "t1")
    over = seg.join(t, "media_id").where(b - a >= short_overlap).withColumns({"a": a, "b": b})
    parts = over.groupBy("media_id", "seq", "start", "end", "text", "char_start", "char_end").agg(F.array_sort(F.collect_list(F.struct("a", "turn", "b", (F.col("b") - F.col("a")).alias("d"), "speaker"))).alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda n, x: n + x["d"])
    most = F.array_max(F.transform("p", lambda x: x["d"]))
    parts = parts.withColumns({"most": most, "ratio": most / total}).withColumn("main", F.element_at(F.filter("p", lambda x: x["d"] == F.col("most")), 1)["speaker"])
    edge = 0.1 * (F.col("end") - F.col("start"))
    minor = F.try_element_at(F.filter("p", lambda x: x["speaker"] != F.col("main")), F.lit(1))
    at_edge = F.coalesce((F.abs(minor["a"] - F.col("start")) < edge) | (F.abs(minor["b"] - F.col("end")) < edge), F.lit(False))
    whole = (F.size("p") == 1) | ((F.col("ratio") > 0.8) & (F.size("p") == 2) & at_edge)
    n = (F.col("char_end") - F.col("char_start")).cast("int")
    window = F.greatest(F.lit(5), (n * 0.2).cast("int"))

    def cut(x: Column) -> Column:
        at = (n * (x["b"] - F.col("start")) / (F.col("end") - F.col("start"))).cast("int")
        return _snap(F.col("text"), at, F.greatest(F.lit(0), at - window), F.least(n, at + window))

    cuts = F.transform("p", lambda x, i: F.when(i == F.size("p") - 1, n).otherwise(cut(x)))
    pairs = F.arrays_zip(cuts.alias("c"), F.col("p").alias("x"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,speaker:string>>").alias("out"))
    step = lambda s, x: F.when(x["c"] > s["at"], F.struct(x["c"].alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("s"), x["c"].alias("e"), x["x"]["speaker"].alias("speaker")))).alias("out"))).otherwise(s)
    split = F.aggregate(pairs, start, step, lambda s: s["out"])
    one = F.array(F.struct(F.lit(0).alias("s"), n.alias("e"), F.col("main").alias("speaker")))
    each = parts.select("media_id", "char_start", F.explode(F.when(whole, one).otherwise(split)).alias("r"))
    ranges = each.select("media_id", (F.col("char_start") + F.col("r.s")).cast("long").alias("start_char"), (F.col("char_start") + F.col("r.e")).cast("long").alias("end_char"), F.col("r.speaker").alias("speaker"))
    return coalesce(ranges, "start_char", "end_char", 1)


def coalesce(ranges: DataFrame, start: str, end: str, gap: int) -> DataFrame:
    """Neighbouring ranges of one speaker joined where the next starts at most `gap` behind the end so far."""
    order = Window.partitionBy("media_id").orderBy(start, end)
    run = ranges.withColumn("new", F.when(F.lag("speaker").over(order).eqNullSafe(F.col("speaker")), 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    inside = Window.partitionBy("media_id", "run").orderBy(start, end)
    reach = F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    island = run.withColumn("island", F.sum(F.when(F.coalesce(F.col(start) <= reach + gap, F.lit(False)), 0).otherwise(1)).over(inside))
    return island.groupBy("media_id", "run", "island", "speaker").agg(F.min(start).alias(start), F.max(end).alias(end)).select("media_id", start, end, "speaker")


def word_ranges(ranges: DataFrame, texts: DataFrame) -> DataFrame:
    """(media_id, start_word, end_word, speaker): character ranges as word ranges, end exclusive; a space belongs to the word before it."""
    both = ranges.join(texts, "media_id")
    before = lambda p: F.size(F.split(F.substring(F.col("text"), F.lit(1), p.cast("int")), " ")) - 1
    total = F.size(F.split("text", " "))
    first, last = F.least(before(F.col("start_char")), total - 1), F.least(before(F.col("end_char") - 1), total - 1)
    words = both.select("media_id", first.alias("start_word"), (last + 1).alias("end_word"), "speaker").where("end_word > start_word")
    return coalesce(words, "start_word", "end_word", 0)


def speaker_at(words: DataFrame, ranges: DataFrame) -> DataFrame:
    """(media_id, word_idx, speaker): the first range, in the order of ord, that holds the word; null without one."""
    hit = words.join(ranges, "media_id", "left").withColumn("in", (F.col("start_word") <= F.col("word_idx")) & (F.col("word_idx") < F.col("end_word")))
    return hit.groupBy("media_id", "word_idx").agg(F.min_by(F.when(F.col("in"), F.col("speaker")), F.when(F.col("in"), F.col("ord"))).alias("speaker"))


def utterances(words: DataFrame, ranges: DataFrame) -> DataFrame:
    """(media_id, start_word, end_word, speaker, text): runs of words of one known speaker; a word is the longest covering range's."""
    r = ranges.select("media_id", "start_word", "end_word", "speaker")
    hit = words.join(r, "media_id").where((F.col("start_word") <= F.col("word_idx")) & (F.col("word_idx") < F.col("end_word")))
    owner = hit.groupBy("media_id", "word_idx", "word").agg(F.max_by("speaker", F.struct(F.col("end_word") - F.col("start_word"), -F.col("start_word"))).alias("speaker"))
    w = Window.partitionBy("media_id").orderBy("word_idx")
    new = ~(F.lag("speaker").over(w).eqNullSafe(F.col("speaker")) & (F.lag("word_idx").over(w) == F.col("word_idx") - 1))
    runs = owner.where("speaker is not null").withColumn("run", F.sum(F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"]), " ")
    return runs.groupBy("media_id", "run", "speaker").agg(F.min("word_idx").alias("start_word"), (F.max("word_idx") + 1).alias("end_word"), text.alias("text")).drop("run")


#: What one medium's turns are folded into: (media_id, scored and wrong steps).
SCORED = "media_id {kind}, scored long, wrong long"


def _alone(turns: np.ndarray, of: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Of each stretch between two points the number of the only turn (first and last point) that covers it, else -1."""
    number, many = np.zeros(len(points) + 1, np.int64), np.zeros(len(points) + 1, np.int64)
    first, last = np.searchsorted(points, turns[:, 0]), np.searchsorted(points, turns[:, 1])
    for at, sign in ((first, 1), (last, -1)):
        np.add.at(number, at, sign * of)
        np.add.at(many, at, sign)
    number, many = np.cumsum(number), np.cumsum(many)
    return np.where(many == 1, number, -1)[: max(len(points) - 1, 0)]


def _least(turns: np.ndarray, speaker: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Of each stretch between two points the least speaker of the turns that cover it, else -1."""
    first, last = np.searchsorted(points, turns[:, 0]), np.searchsorted(points, turns[:, 1])
    out, order, at, active = np.full(max(len(points) - 1, 0), -1, np.int64), np.argsort(first, kind="stable").tolist(), 0, []
    first, last, speaker = first.tolist(), last.tolist(), speaker.tolist()
    for k in range(len(out)):
        while at < len(order) and first[order[at]] <= k:
            heapq.heappush(active, (speaker[order[at]], last[order[at]]))
            at += 1
        while active and active[0][1] <= k:
            heapq.heappop(active)
        if active:
            out[k] = active[0][0]
    return out


def _judged(side: np.ndarray, steps: np.ndarray, speaker: np.ndarray) -> tuple[int, int]:
    """(scored, wrong) steps of one medium. side: 0 reference; steps: first and last, first and last that is scored; speaker: ranks, -1 for null."""
    ref, hyp = side == 0, (side == 1) & (speaker >= 0)
    if not ref.any():
        return 0, 0
    points = np.unique(np.r_[steps[ref].ravel(), steps[hyp][:, :2].ravel()])
    turn = _alone(steps[ref], np.arange(ref.sum()), points)
    inner, at = steps[ref][turn, 2:], points[:-1]
    live = np.flatnonzero((turn >= 0) & (at >= inner[:, 0]) & (at < inner[:, 1]))
    told, said, long_ = speaker[ref][turn[live]], _least(steps[hyp], speaker[hyp], points)[live], np.diff(points)[live]
    scored, right = int(long_.sum()), int(long_[(said < 0) & (told < 0)].sum())
    # each hypothesis speaker is the reference speaker of the longest common time, the greatest of equals
    some = np.flatnonzero(said >= 0)
    pair, inverse = np.unique(np.c_[said[some], told[some]], axis=0, return_inverse=True)
    common = np.zeros(len(pair), np.int64)
    np.add.at(common, inverse.ravel(), long_[some])
    order = np.lexsort((pair[:, 1], common, pair[:, 0]))
    best = order[np.r_[pair[order][1:, 0] != pair[order][:-1, 0], True]] if len(order) else order
    return scored, scored - right - int(common[best].sum())


def der(reference: DataFrame, hypothesis: DataFrame, collar: float = 0.25, step: float = 0.01) -> DataFrame:
    """(media_id, scored, errors, der): share of scored time in which the mapped hypothesis differs from the reference.

    Speakers are mapped by the longest common time. Time is looked at in steps; a step within `collar` of a reference
    edge or under several reference speakers isn't scored. A turn is one row whatever its length: a sweep over the turns'
    ends counts the steps of each stretch between them.
    """
    ceil = lambda x: F.ceil(F.col(x) / step).cast("long")
    # the steps of a turn that aren't near its ends: near is monotone in the step, so a step at each rounded bound decides
    after = lambda k: (k * step - F.col("start")) >= collar
    before = lambda k: (F.col("end") - k * step) >= collar

    def exact(guess: Column, holds: Callable[[Column], Column]) -> Column:
        """The first of guess - 2 .. guess + 2 for which it holds, else guess + 3."""
        found = F.lit(3)
        for k in (2, 1, 0, -1, -2):
            found = F.when(holds(guess + k), k).otherwise(found)
        return guess + found

    inner = exact(F.ceil((F.col("start") + collar) / step).cast("long"), after)
    outer = exact(F.ceil((F.col("end") - collar) / step).cast("long"), lambda k: ~before(k))
    sides = []
    for side, turns in enumerate((reference, hypothesis)):
        some = turns.where(F.col("end") - F.col("start") > step)
        bounds = (inner, outer) if side == 0 else (F.lit(None).cast("long"), F.lit(None).cast("long"))
        sides.append(some.select("media_id", F.lit(side).alias("side"), ceil("start").alias("a"), ceil("end").alias("b"), bounds[0].alias("x"), bounds[1].alias("y"), "speaker"))
    kind = dict(sides[0].dtypes)["media_id"]

    def swept(key: tuple, turns: pa.Table) -> pa.Table:
        column = lambda c: turns[c].fill_null(0).to_numpy()
        names = turns["speaker"].to_pylist()
        rank = {s: i for i, s in enumerate(sorted({s for s in names if s is not None}, key=lambda s: s.encode() if isinstance(s, str) else s))}
        speaker = np.array([rank.get(s, -1) for s in names], np.int64)
        side = column("side")
        if turns["media_id"][0].as_py() is None:  # no medium: nothing to compare with
            side = np.where(side == 1, 2, side)
        scored, wrong = _judged(side, np.c_[column("a"), column("b"), column("x"), column("y")].astype(np.int64), speaker)
        return pa.table({"media_id": turns["media_id"].slice(0, 1), "scored": pa.array([scored]), "wrong": pa.array([wrong])})

    each = sides[0].union(sides[1]).groupBy("media_id").applyInArrow(swept, SCORED.format(kind=kind)).where("scored > 0")
    return each.select("media_id", (F.col("scored") * step).alias("scored"), (F.col("wrong") * step).alias("errors")).withColumn("der", F.col("errors") / F.col("scored"))

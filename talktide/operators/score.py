"""Scores: similarity to prototypes, word error rate, comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talktide import lexicons as L
from talktide.functions.rewrite import contains_any, let, starts_with_any


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double arithmetic."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def best_prototype(sentences: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(id, score): the highest similarity of each embedding to a prototype (kind, embedding); prototypes are a short fixed list."""
    lists = prototypes.groupBy("kind").agg(F.collect_list("embedding").alias("protos"))
    both = sentences.join(lists, "kind")
    return both.select("id", "kind", F.array_max(F.transform("protos", lambda p: cosine(F.col("embedding"), p))).alias("score"))


def is_question(text: Column, score: Column, lang: str, indicator: Column) -> Column:
    """An opening mark decides; Spanish statements are none; else the score, with a lower bar where words point to a question."""
    limit = L.thresholds(lang)
    low = F.lower(text)
    bar = F.when(indicator, limit["question_with_indicator"]).otherwise(limit["question"])
    strong = [*L.ES_CORE, "como"]
    statement = (F.lit(lang) == "es") & ~contains_any(low, strong) & ~starts_with_any(low, [w + " " for w in strong]) & contains_any(low, L.ES_INTRODUCTIONS)
    return F.when(F.ltrim(text).startswith("¿"), True).when(statement, False).otherwise(score > bar)


def is_exclamation(score: Column) -> Column:
    return score > L.EXCLAMATION


def semantic_breaks(embeddings: DataFrame, below: float = L.SEMANTIC_BREAK) -> DataFrame:
    """(group, ord, similarity, is_break) of each embedding and the next one."""
    w = Window.partitionBy("group").orderBy("ord")
    next_ = embeddings.withColumn("next", F.lead("embedding").over(w)).where("next is not null")
    return next_.select("group", "ord", cosine(F.col("embedding"), F.col("next")).alias("similarity")).withColumn("is_break", F.col("similarity") < below)


def edit_distance(a: Column, b: Column) -> Column:
    """Word edit distance of two arrays: one row of the table after the other."""

    def row(state: Column, word: Column) -> Column:
        before = state["row"]
        first = F.array(F.element_at(before, 1) + 1)
        cells = F.zip_with(F.zip_with(F.slice(before, 1, F.size(before) - 1), F.slice(before, 2, F.size(before) - 1), lambda d, u: F.struct(d.alias("d"), u.alias("u"))), state["b"], lambda c, w: F.struct((c["d"] + F.when(w == word, 0).otherwise(1)).alias("x"), (c["u"] + 1).alias("y")))
        after = F.aggregate(cells, first, lambda done, c: F.concat(done, F.array(F.least(c["x"], c["y"], F.element_at(done, -1) + 1))))
        return F.struct(after.alias("row"), state["b"].alias("b"))

    start = F.struct(F.sequence(F.lit(0), F.size(b)).alias("row"), b.alias("b"))
    return F.aggregate(a, start, row, lambda s: F.element_at(s["row"], -1))


def wer(reference: Column, hypothesis: Column) -> Column:
    """Word errors by the reference's words, four decimals; of an empty reference 1 if there is a hypothesis, else 0."""
    n, m = F.size(reference), F.size(hypothesis)
    return F.when(n == 0, F.when(m > 0, 1.0).otherwise(0.0)).otherwise(F.bround(edit_distance(reference, hypothesis) / n, 4))


def word_array(text: Column) -> Column:
    return let(text, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ")))


def compare(baseline: DataFrame, current: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(key, baseline, current, status): missing, new, error, regression, improvement or same by the difference of `value`."""
    both = baseline.select("key", F.col("value").alias("baseline"), F.lit(True).alias("old")).join(current.select("key", F.col("value").alias("current"), F.lit(True).alias("new")), "key", "full")
    delta = F.col("current") - F.col("baseline")
    status = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "new").when(delta.isNull(), "error").when(delta > tolerance, "regression").when(delta < -tolerance, "improvement").otherwise("same")
    return both.select("key", "baseline", "current", status.alias("status"))


def first_per_group(rows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The first `most` rows of each group."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def pattern_checks(texts: DataFrame) -> DataFrame:
    """(id, tag, passed) of (id, text, tags): what each tag asks of a text."""
    text = F.col("text")
    each = texts.select("id", "text", F.explode("tags").alias("tag"))
    passed = F.when(F.col("tag") == "question", text.contains("?")).when(F.col("tag") == "inverted", text.rlike("[¿¡]")).when(F.col("tag") == "domain", ~text.rlike(r"(?i)\b[a-z0-9-]+\.\s+(?:com|net|org)\b"))
    return each.select("id", "tag", F.coalesce(passed, F.lit(True)).alias("passed"))

"""Quality rules: word and repetition rules, then a hashed n-gram log-likelihood ratio between trusted and raw text.

Words and word pairs are hashed into a fixed number of bins. Two multinomials over the bins are counted over all
documents: one of the trusted ones (labelled quality 1) and one of the whole corpus. A document's score is the mean
of log(trusted share / raw share) over its n-grams. The threshold is set by the trusted documents themselves: the
score that a given share of them falls below, read from an exact histogram on a fixed grid, so it is the same on
every run. Half of the trusted documents (by a hash of the id) are counted, the other half sets the threshold: a
document that was counted scores too well to tell how an unseen one of its kind would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talktide.llm.common import bound_batches, bounded_ids, dense, documents_of, flat_words, mix64, scratch_table, word_hashes

BINS = 1 << 16
REJECTED_TRUSTED = 0.005  # share of the trusted documents that the threshold may reject
GRID = 1000  # scores are thresholded in steps of 1 / GRID
MOST_IDS = 1 << 20  # trusted ids that are broadcast (8 MB); more are joined
SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word, index of each word, row of each n-gram, bin of each n-gram)."""
    row, words, index = flat_words(texts, lower=False)
    h = word_hashes(words)[index]
    pair = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
    both = mix64(h[pair] * np.uint64(0x9E3779B97F4A7C15) + h[pair + 1])
    return row, index, np.r_[row, row[pair]], (np.r_[h, both] % np.uint64(BINS)).astype(np.int64)


def _repeated(row: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """Words of each row that lie in a window of three words found twice or more in it."""
    at = np.flatnonzero(row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, np.int64)
    if not len(at):
        return np.zeros(n, np.int64)
    size = int(index.max()) + 1
    if size < 1 << 21:
        key, most = dense((index[at] << 42) | (index[at + 1] << 21) | index[at + 2])
    else:
        key, _ = dense(index[at] * size + index[at + 1])
        key, most = dense(key * size + index[at + 2])
    _, inverse, count = np.unique(row[at] * most + key, return_inverse=True, return_counts=True)
    hit, many = np.zeros(len(row), bool), at[count[inverse] > 1]
    for k in range(3):
        hit[many + k] = True
    return np.bincount(row[hit], minlength=n)


def _dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    return len(lines) - len(set(lines))


def _stats(texts: pa.Array, row: np.ndarray, index: np.ndarray) -> dict[str, np.ndarray]:
    n, plain = len(texts), texts.cast(pa.large_string())
    raw = plain.cast(pa.large_binary())
    many = pc.count_substring(plain, "\n").to_numpy(zero_copy_only=False) > 0
    symbols = sum(pc.count_substring(raw, bytes([c])).to_numpy(zero_copy_only=False).astype(np.int64) for c in SYMBOLS)
    spaces = sum(pc.count_substring(raw, c.encode()).to_numpy(zero_copy_only=False).astype(np.int64) for c in " \t\n\v\f\r")
    return {
        "n_words": np.bincount(row, minlength=n),
        "word_chars": pc.utf8_length(plain).to_numpy(zero_copy_only=False) - spaces,
        "n_symbols": symbols,
        "n_dup_lines": np.array([_dup_lines(t) if m else 0 for t, m in zip(texts.to_pylist(), many, strict=True)], np.int64),
        "n_repeat_words": _repeated(row, index, n),
    }


def bin_counts(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """(2, BINS): n-grams of the trusted and of all documents; each task sends one row per bin it has met at most."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows, ids = documents_of(docs, id_col, text_col), bounded_ids(trusted.select(F.col("doc_id").cast("long")), MOST_IDS)
    if ids is None:
        marks = trusted.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("trusted")).where("doc_id is not null").distinct()
        rows = rows.join(marks, "doc_id", "left").select("doc_id", "text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    else:
        rows = rows.select("doc_id", "text", F.lit(False).alias("trusted"))
    shared = spark.sparkContext.broadcast(ids)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BINS), np.int64)
        for batch in batches:
            _, _, row, bins = _grams(batch.column(1))
            if shared.value is None:
                good = batch.column(2).to_numpy(zero_copy_only=False)
            else:
                good = np.isin(batch.column(0).fill_null(-1).to_numpy(), shared.value) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            total[0] += np.bincount(bins[good[row]], minlength=BINS)
            total[1] += np.bincount(bins, minlength=BINS)
        some = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_pydict({"bin": some, "trusted": total[0][some], "raw": total[1][some]})

    found = rows.mapInArrow(counted, "bin long, trusted long, raw long").groupBy("bin").agg(F.sum("trusted").alias("trusted"), F.sum("raw").alias("raw")).toArrow()
    out = np.zeros((2, BINS), np.int64)
    for i, name in enumerate(("trusted", "raw")):
        out[i, found["bin"].to_numpy()] = found[name].to_numpy()
    return out


def log_ratios(counts: np.ndarray) -> np.ndarray:
    share = (counts + 1.0) / (counts.sum(axis=1, keepdims=True) + BINS)
    return np.log(share[0]) - np.log(share[1])


def score(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the counts of STATS, score) of each row; the score of a text without words is 0. `keep`: further columns to carry."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(ratios)
    rows = docs.select(docs[id_col].cast("long").alias("__id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("__text"), *(docs[c] for c in keep))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            word_row, index, row, bins = _grams(texts)
            n = np.bincount(row, minlength=len(texts))
            # sums of integers: the same whatever the order
            total = np.bincount(row, np.rint(shared.value[bins] * (1 << 20)), minlength=len(texts)) / (1 << 20)
            out = {"doc_id": batch.column(0)} | {k: pa.array(v, pa.int64()) for k, v in _stats(texts, word_row, index).items()} | {"score": total / np.maximum(n, 1)}
            yield pa.RecordBatch.from_pydict(out | {f"kept_{c}": batch.column(2 + i) for i, c in enumerate(keep)})

    more = "".join(f", kept_{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(scored, "doc_id long, " + ", ".join(f"{k} long" for k in STATS) + f", score double{more}")


def threshold(scores: DataFrame, trusted: DataFrame, rejected: float = REJECTED_TRUSTED) -> float:
    """The highest step of the grid with at most a share `rejected` of the trusted documents below it; minus infinity without any."""
    marks = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    steps = scores.select("doc_id", F.floor(F.col("score") * GRID).alias("step")).join(marks, "doc_id", "left_semi").groupBy("step").count().orderBy("step").toArrow()
    if not len(steps):
        return float("-inf")
    step, n = steps["step"].to_numpy(), steps["count"].to_numpy()
    return float(step[np.flatnonzero(np.cumsum(n) > rejected * n.sum())[0]]) / GRID


def halves(trusted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trusted documents to count, and those that set the threshold."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id"))
    odd = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    return ids.where(odd == 0), ids.where(odd == 1)


def verdicts(scores: DataFrame, least: float) -> DataFrame:
    """Adds base_failed and kept."""
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return scores.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= F.lit(least)))


def judge(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, STATS, score, base_failed, kept) of each row of docs; trusted: a table with the doc_ids of trusted documents.

    A null or empty text has no words and fails the base rules. A null id is never trusted. Repeated rows are
    counted and judged each for itself. Without trusted documents among docs, only the base rules decide. Other
    columns are ignored. An empty table gives an empty table.
    """
    fitted, held = halves(trusted)
    ratios = log_ratios(bin_counts(docs, fitted, id_col, text_col))
    scores = scratch_table(score(docs, ratios, id_col, text_col))
    return verdicts(scores, threshold(scores.select("doc_id", "score"), held))

"""Substring dedup by hashed units: lines, paragraphs, or lines cut at their sentence ends are normalised, their digests
grouped over the whole corpus, the earliest ranked occurrence kept and the rest removed, with the offsets in the original
text retained.

A repeated passage seldom starts and ends with a line, so whole lines miss it; and short stock lines recur in texts that
repeat nothing else. Hence the two parameters: `unit="sentence"` cuts lines at sentence ends, and `least_run` removes
repeated units only where neighbouring ones hold so many words together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talktide.llm.common import bound_batches, documents_of, join_hot, scratch_table

#: What separates the blocks of a text, and the units within a block.
SEPARATORS = {"line": ("\n", None), "paragraph": ("\n\n", None), "sentence": ("\n", r"(?<=[.!?])[ \t\x0B\f\r]+")}
BLANK = " \t\n\v\f\r"
#: Words that neighbouring repeated units must hold together to go: half of a passage of 50 words, as its first and last
#: sentence may run on into the text around it.
LEAST_RUN = 25


def normalised(unit: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(unit), r"[ \t\n\x0B\f\r]+", " "))


def digests(unit: Column) -> list[Column]:
    """128 bits in two columns."""
    return [F.xxhash64(unit).alias("h1"), F.xxhash64(F.lit("second"), unit).alias("h2")]


def identity(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, twin): rows are told apart by id and text, so that repeated rows share every decision."""
    return documents_of(docs, id_col, text_col).withColumn("twin", F.xxhash64("text"))


def split(rows: DataFrame, unit: str = "line") -> DataFrame:
    """(doc_id, twin, unit_no, unit): every unit of every row."""
    outer, inner = SEPARATORS[unit]
    return rows.select("doc_id", "twin", F.posexplode(F.split("text", outer if inner is None else f"{outer}|{inner}", -1)).alias("unit_no", "unit"))


def duplicates(rows: DataFrame, unit: str = "line") -> DataFrame:
    """(doc_id, twin, unit_no) of every unit that isn't the first of its digest, by (doc_id, twin, unit_no); null ids rank last."""
    units = split(rows, unit).select("doc_id", "twin", "unit_no", normalised(F.col("unit")).alias("unit")).where("unit != ''")
    stored = scratch_table(units.select("doc_id", "twin", "unit_no", *digests(F.col("unit"))))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "twin", "unit_no")
    # a row per digest and task is sent, however often a unit occurs
    firsts = scratch_table(stored.groupBy("h1", "h2").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1"))
    return join_hot(stored, firsts, ["h1", "h2"]).where(~F.col("first").eqNullSafe(rank)).select("doc_id", "twin", "unit_no")


RESULT = "doc_id long, n_units long, n_removed long, removed_chars long, spans string, kept string"


def cut(text: str, drop: set[int], unit: str, least_run: int) -> tuple[int, int, int, str, str]:
    """(n_units, n_removed, removed_chars, spans, kept) of one text, of whose units those in `drop` occurred before."""
    outer, inner = SEPARATORS[unit]
    inner = inner and re.compile(inner)
    places, at, no = [], 0, 0  # (block, start, end, end of the separator, words, repeated) of each unit
    for b, block in enumerate(text.split(outer)):
        ends = [(m.start(), m.end()) for m in inner.finditer(block)] if inner else []
        for start, (end, after) in zip([0, *(e for _, e in ends)], [*ends, (len(block), len(block))], strict=True):
            places.append((b, at + start, at + end, at + after, len([w for w in re.split(r"[ \t\n\v\f\r]+", block[start:end]) if w]), no in drop))
            no += 1
        at += len(block) + len(outer)
    gone, run = set(), []
    real = [k for k, p in enumerate(places) if p[4]]
    for k in [*real, None]:
        if k is not None and places[k][5]:
            run.append(k)
            continue
        if sum(places[j][4] for j in run) >= least_run:
            gone.update(run)
        run = []
    # a block goes with all of its units; of the others, a unit goes with the separator after it, or before it at the end
    left, b = [], 0
    while b < len(places):
        e = b
        while e < len(places) and places[e][0] == places[b][0]:
            e += 1
        own = range(b, e)
        stays = [k for k in own if k not in gone]
        if not any(k in gone for k in own):
            left.append(text[places[b][1] : places[e - 1][3]])
        elif any(places[k][4] for k in stays):
            left.append("".join(text[places[k][1] : places[k][3] if k != stays[-1] else places[k][2]] for k in stays))
        b = e
    spans = [(places[k][1], places[k][2]) for k in sorted(gone)]
    return len(real), len(spans), sum(e - s for s, e in spans), ",".join(f"{s}:{e}" for s, e in spans), outer.join(left)


def dedup(docs: DataFrame, unit: str = "line", id_col: str = "doc_id", text_col: str = "text", least_run: int = 0) -> DataFrame:
    """(doc_id, n_units, n_removed, removed_chars, spans, kept) of every row of docs.

    n_units: units with more than white space; spans: start:end of each removed unit in the original text (code
    points, without its separator), comma-joined; kept: the text of the other units. Of repeated units those go that
    hold, with the repeated ones next to them, `least_run` words or more. Units of white space only are
    never removed and don't part neighbours. A null text is the empty text. Rows of one id and text share their decisions
    (a unit is never removed as a copy of itself in a repeated row); null ids rank after all others. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    rows = identity(docs, id_col, text_col)
    gone = duplicates(rows, unit).groupBy("doc_id", "twin").agg(F.sort_array(F.collect_set("unit_no")).alias("gone")).withColumnsRenamed({"doc_id": "gone_id", "twin": "gone_twin"})
    both = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("twin") == F.col("gone_twin")), "left").select("doc_id", "text", "gone")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, drops = (c.to_pylist() for c in batch.columns)
            rows = [(i, *cut(t, set(d or ()), unit, least_run)) for i, t, d in zip(ids, texts, drops, strict=True)]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            columns = [[r[k] for r in rows] for k in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

    return both.mapInArrow(told, RESULT)

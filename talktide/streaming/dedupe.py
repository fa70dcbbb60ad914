"""Overlap dedupe and chunk prompts on a stream: each medium keeps the last kept end and the tail of its text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from talktide.operators.segments import EPSILON

PROMPT = 200


def dedupe_stream(segments: DataFrame, epsilon: float = EPSILON, first_end: float = 0.0) -> DataFrame:
    """The kept rows of a stream (media_id string, chunk_idx, seq, start, end, text), with the prompt that the medium's text so far gives the next chunk.

    Rows of one trigger are taken in the order of (chunk_idx, seq); what ends at or before the last kept end of an
    earlier trigger is dropped, so the end acts as a watermark. State per medium is a number and PROMPT characters.
    """

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, tail = state.get if state.exists else (first_end, "")
        rows = pd.concat(list(frames)).sort_values(["chunk_idx", "seq"], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            if r.end > last + epsilon:
                last = max(last, r.end)
                tail = f"{tail}\n{(r.text or '').strip()}"[-PROMPT:]
                out.append((key[0], r.chunk_idx, r.seq, r.start, r.end, r.text, tail))
        state.update((float(last), tail))
        yield pd.DataFrame(out, columns=["media_id", "chunk_idx", "seq", "start", "end", "text", "prompt"])

    return segments.groupBy("media_id").applyInPandasWithState(
        keep, "media_id string, chunk_idx int, seq int, start double, end double, text string, prompt string", "last double, tail string", "append", GroupStateTimeout.NoTimeout
    )

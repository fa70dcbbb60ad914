"""Merges of adjacent sentences, with a history of what was merged or why not.

A pass walks the sentences of one text in order; a merge consumes its partners, so links don't chain unless the rule
says so. Passes are plain functions of lists; `format_sentences` runs them on the sentences of many texts, one row per
text, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talktide import lexicons as L


class Sentence(NamedTuple):
    text: str
    speaker: str | None = None
    utterances: tuple[tuple[str, str | None], ...] = ()  # (text, speaker) of what was said, in order


class Merge(NamedTuple):
    merge_type: str
    sentence1_idx: int
    sentence2_idx: int
    reason: str
    speaker1: str | None
    speaker2: str | None
    before_text1: str
    before_text2: str
    after_text: str


def lower_first(text: str) -> str:
    at = next((i for i, c in enumerate(text) if c.isalpha()), None)
    return text if at is None else text[:at] + text[at].lower() + text[at + 1 :]


def conflict(a: Sentence, b: Sentence) -> str | None:
    """Why two sentences can't be one: their speakers are known and differ."""
    return f"different speakers ({a.speaker} vs {b.speaker})" if a.speaker and b.speaker and a.speaker != b.speaker else None


def said(sentences: list[Sentence]) -> tuple[tuple[str, str | None], ...]:
    """The utterances of all, in order: a merged sentence keeps every speaker's part."""
    return tuple(u for x in sentences for u in x.utterances)


LABEL = re.compile(r"([A-Za-z0-9\-]+)\.$")
TLD = re.compile(rf"^({'|'.join(L.MERGE_TLDS)})(?:\b|\W)(.*)$", re.IGNORECASE)
DIGITS, FRACTION = re.compile(r"(\d{1,3})\.$"), re.compile(r"^(\d{1,3})(%?)\s*(.*)$")
PLACE = re.compile(r"^(.*?,\s*de\s+[A-ZÁÉÍÓÚÑ][\wÁÉÍÓÚÑ-]+)\.?$"), re.compile(r"^[A-ZÁÉÍÓÚÑ][\wÁÉÍÓÚÑ-]+\s*\.?\s*$")


def _walk(sentences: list[Sentence], rule, log: list[Merge]) -> list[Sentence]:
    """rule(i): None to keep sentence i, else (sentences consumed, replacement)."""
    out, i = [], 0
    while i < len(sentences):
        n, made = rule(i) or (1, [sentences[i]])
        out += made
        i += n
    return out


def merge_domains(s: list[Sentence], lang: str, log: list[Merge]) -> list[Sentence]:
    """'label.' and a sentence that starts with a top-level domain."""

    def rule(i):
        if i + 1 >= len(s):
            return None
        a, b = s[i].text.strip(), s[i + 1].text.strip()
        left, right = LABEL.search(a), TLD.match(b)
        if not left or not right:
            return None
        token, capital = right[1], left[1][0].isupper()
        if lang == "es" and token.lower() == "es" and (capital or token[0].isupper()):
            return None
        if len(a) >= 50 and not capital:
            return None
        if why := conflict(s[i], s[i + 1]):
            log.append(Merge("domain", i, i + 1, f"skipped: {why}", s[i].speaker, s[i + 1].speaker, a, b, ""))
            return None
        rest, joined = right[2].lstrip(), f"{a[:-1]}.{token.lower()}"
        third = s[i + 2].text.strip() if i + 2 < len(s) else ""
        if rest in ("", ".", "!", "?") and third:
            joined = f"{joined} {lower_first(third)}"
            log.append(Merge("domain", i, i + 2, "triple_merge", s[i].speaker, s[i + 2].speaker, f"{a} | {b} | {third}", "", joined))
            return 3, [Sentence(joined, s[i].speaker, said(s[i : i + 3]))]
        if rest:
            joined = joined + rest if rest[0] in ".!?" else f"{joined} {lower_first(rest)}"
        log.append(Merge("domain", i, i + 1, "domain_pattern_match", s[i].speaker, s[i + 1].speaker, a, b, joined))
        return 2, [Sentence(joined, s[i].speaker, said(s[i : i + 2]))]

    return _walk(s, rule, log)


def merge_decimals(s: list[Sentence], lang: str, log: list[Merge]) -> list[Sentence]:
    """'99.' and '9% ...'."""

    def rule(i):
        if i + 1 >= len(s):
            return None
        a, b = s[i].text.strip(), s[i + 1].text.strip()
        right = FRACTION.match(b)
        if not DIGITS.search(a) or not right:
            return None
        if why := conflict(s[i], s[i + 1]):
            log.append(Merge("decimal", i, i + 1, f"skipped: {why}", s[i].speaker, s[i + 1].speaker, a, b, ""))
            return None
        joined = f"{a[:-1]}.{right[1]}{right[2]}"
        if right[3].lstrip():
            joined = f"{joined} {lower_first(right[3].lstrip())}"
        log.append(Merge("decimal", i, i + 1, "decimal_pattern_match", s[i].speaker, s[i + 1].speaker, a, b, joined))
        return 2, [Sentence(joined, s[i].speaker, said(s[i : i + 2]))]

    return _walk(s, rule, log)


def merge_appositives(s: list[Sentence], lang: str, log: list[Merge]) -> list[Sentence]:
    """', de Proper.' and a lone 'Proper.' in Spanish; the merged sentence has no speaker."""

    def rule(i):
        if lang != "es" or i + 1 >= len(s):
            return None
        left, b = PLACE[0].search(s[i].text.strip()), s[i + 1].text.strip()
        return (2, [Sentence(f"{left[1]}, {b}")]) if left and PLACE[1].match(b) else None

    return _walk(s, rule, log)


def merge_emphatic(s: list[Sentence], lang: str, log: list[Merge]) -> list[Sentence]:
    """'No. No. No.' as 'No, no, no.'; a single emphatic word is rewritten and logged too."""
    allowed = set(L.EMPHATIC.get(lang, ()))
    bare = lambda x: x.text.strip().strip(".!?")

    def rule(i):
        n = i
        while n < len(s) and bare(s[n]).lower() in allowed:
            n += 1
        if n == i:
            return None
        run = s[i:n]
        if len(run) > 1 and conflict(run[0], run[-1]):
            return len(run), run
        words = ["sí" if lang == "es" and bare(x).lower() in ("si", "sí") else bare(x).lower() for x in run]
        joined = ", ".join([words[0].capitalize(), *words[1:]]) + "."
        log.append(Merge("emphatic", i, n - 1, f"emphatic_repeat_{len(run)}_words", run[0].speaker, run[-1].speaker, " | ".join(map(bare, run)), "", joined))
        return len(run), [Sentence(joined, run[0].speaker, said(run))]

    return _walk(s, rule, log) if allowed else s


PASSES = (merge_domains, merge_decimals, merge_appositives, merge_emphatic)


def apply_passes(sentences: list[Sentence], lang: str | None) -> tuple[list[Sentence], list[Merge]]:
    log: list[Merge] = []
    for one in PASSES:
        sentences = one(sentences, lang or "", log)
    return sentences, log


UTTERANCES = pa.list_(pa.struct([("text", pa.string()), ("speaker", pa.string())]))
MADE = pa.list_(pa.struct([("text", pa.string()), ("speaker", pa.string()), ("utterances", UTTERANCES)]))
HISTORY = pa.list_(pa.struct([(k, pa.int32() if k.endswith("_idx") else pa.string()) for k in Merge._fields]))


def _read(sentence: dict) -> Sentence:
    return Sentence(sentence["text"] or "", sentence["speaker"], tuple((u["text"], u["speaker"]) for u in sentence["utterances"] or ()))


def _written(sentence: Sentence) -> dict:
    return {"text": sentence.text, "speaker": sentence.speaker, "utterances": [{"text": t, "speaker": who} for t, who in sentence.utterances]}


def format_sentences(texts: DataFrame) -> DataFrame:
    """(media_id, sentences, history) of (media_id, lang, sentences array<struct<text, speaker>>), whose structs may have utterances."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [apply_passes([_read(x) for x in s or ()], lang) for lang, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"media_id": batch.column(0), "sentences": pa.array([[_written(x) for x in s] for s, _ in done], MADE), "history": pa.array([[x._asdict() for x in h] for _, h in done], HISTORY)})

    kind = texts.schema["media_id"].dataType.simpleString()
    history = ", ".join(f"{k}:{'int' if k.endswith('_idx') else 'string'}" for k in Merge._fields)
    spoken = "utterances" in texts.schema["sentences"].dataType.elementType.names
    pair = lambda u: F.struct(u["text"].alias("text"), u["speaker"].alias("speaker"))
    utterances = lambda x: F.transform(x["utterances"], pair) if spoken else F.array().cast("array<struct<text:string,speaker:string>>")
    rows = texts.select("media_id", "lang", F.transform("sentences", lambda x: F.struct(x["text"].alias("text"), x["speaker"].alias("speaker"), utterances(x).alias("utterances"))).alias("sentences"))
    return rows.mapInArrow(made, f"media_id {kind}, sentences array<struct<text:string,speaker:string,utterances:array<struct<text:string,speaker:string>>>>, history array<struct<{history}>>")


def merge_summary(history: DataFrame) -> DataFrame:
    """(merge_type, skipped, n) of an exploded history."""
    return history.groupBy("merge_type", F.startswith("reason", F.lit("skipped:")).alias("skipped")).agg(F.count("*").alias("n"))

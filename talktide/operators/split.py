"""Sentence ends in a stream of words: one decision per word, made in order, because each depends on the last cut.

Everything that doesn't depend on the last cut is a feature of the word: boundaries of segments and speakers come in as
word numbers, which the operators of `segments` and `speakers` compute relationally. The fold itself runs on the
words of one text at a time, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talktide import lexicons as L

EDGE = ".,;:!?¿¡"
INFINITIVE = re.compile(L.INFINITIVE)
SETS = {k: frozenset(v) for k, v in {"connectors": L.CONNECTORS, "auxiliaries": L.AUXILIARIES, "closed": L.CONJUNCTIONS + L.AUXILIARIES, "units": L.UNITS, "nouns": L.NUMBERED_NOUNS, "participles": L.PARTICIPLES}.items()}


class Utterance(NamedTuple):
    text: str
    speaker: str | None
    start_word: int
    end_word: int


class Split(NamedTuple):
    text: str
    speaker: str | None
    split_reason: str
    utterances: list[Utterance]


def bare(word: str) -> str:
    return word.lower().strip(EDGE)


def is_participle(word: str) -> bool:
    word = bare(word)
    return word.endswith(tuple(L.PARTICIPLE_ENDS)) or word in SETS["participles"] or (word.startswith("ge") and word.endswith(("t", "en")))


def guarded(word: str, lang: str) -> bool:
    """Words that no sentence ends on."""
    return bare(word) in SETS["closed"] or bare(word) in L.FORBIDDEN_ENDS.get(lang, ())


def comparative(word: str, after: str, lang: str) -> bool:
    few = L.COMPARATIVES.get(lang, ())
    return (bare(after) in few and bare(word) in L.DEGREES.get(lang, ())) or (bare(word) in few and after[:1].islower())


def modal_infinitive(word: str, after: str, lang: str) -> bool:
    return bare(word) in L.GOVERNORS.get(lang, ()) and after[:1].islower() and len(bare(after)) >= 2 and bool(INFINITIVE.match(bare(after)))


def infinitive_complement(word: str, after: str, lang: str) -> bool:
    return lang == "es" and after[:1].islower() and len(bare(word)) >= 2 and bool(INFINITIVE.match(bare(word)))


def open_mark(chunk: list[str], word: str, lang: str) -> bool:
    """Inside an inverted mark that isn't closed, in Spanish."""
    text = " ".join(chunk)
    return lang == "es" and (any(c in word for c in "¿¡") or ("¿" in text and "?" not in text) or ("¡" in text and "!" not in text))


def number_or_participle(word: str, after: str, chunk: list[str]) -> bool:
    """A break would part a number from its noun, unit or list, or an auxiliary from its participle."""
    now, then = bare(word), bare(after)
    if after and after.strip(".,;:!?").isdigit():
        listed = now in L.BEFORE_NUMBERS and len(chunk) >= 2 and any(c.isdigit() for w in chunk[-3:] for c in w)
        if listed or now in SETS["nouns"]:
            return True
    return bool(after) and ((any(c.isdigit() for c in now) and then in SETS["units"]) or (now in SETS["auxiliaries"] and is_participle(then)))


def shift_past_mark(boundary: int, words: list[str], lang: str, reach: int = 25) -> int:
    """A speaker boundary inside an open inverted mark moves to the word that closes it."""
    if lang != "es" or not 0 <= boundary < len(words):
        return boundary
    text = " ".join(words[: boundary + 1])
    closers = [c for o, c in ("¡!", "¿?") if text.count(o) > text.count(c)]
    return next((i for i in range(boundary + 1, min(boundary + reach + 1, len(words))) if any(c in words[i] for c in closers)), boundary)


@dataclass
class Splitter:
    """Rules of one language over one text; `similarity` scores the texts around a word, or is absent."""

    lang: str
    segment_ends: frozenset[int] = frozenset()
    turns: list[tuple[int, int, str]] = field(default_factory=list)
    similarity: Callable[[str, str], float] | None = None

    def speaker(self, i: int) -> str | None:
        return next((s for a, b, s in self.turns if a <= i < b), None)

    def changes(self, words: list[str]) -> set[int]:
        ends = [a[1] - 1 for a, b in zip(self.turns, self.turns[1:], strict=False) if a[2] != b[2]]
        return {shift_past_mark(e, words, self.lang) for e in ends if e >= 0}

    def reason(self, words: list[str], i: int, chunk: list[str], changes: set[int]) -> str | None:
        """Why a sentence ends at word i, or None; the first rule that applies decides."""
        limit = L.thresholds(self.lang)
        if i in changes:
            return "speaker"
        if not 1 <= i < len(words) - 1 or guarded(words[i], self.lang):
            return None
        after, at_end = words[i + 1], i in self.segment_ends
        connector = bare(after) in SETS["connectors"]
        if at_end and any(i < c <= i + 3 for c in changes) and (connector or after[0].islower()):
            return None
        if len(words) <= limit["min_total_words"]:
            return None
        if at_end and len(chunk) >= limit["min_words_segment_break"]:
            same = self.speaker(i) is not None and self.speaker(i) == self.speaker(i + 1)
            blocked = same if connector else open_mark(chunk, words[i], self.lang)
            return None if blocked else "segment"
        if len(chunk) < limit["min_chunk"] or open_mark(chunk, words[i], self.lang) or number_or_participle(words[i], after, chunk):
            return None
        if self.similarity is None or len(chunk) < limit["min_chunk_semantic"]:
            return None
        hinges = L.HINGES.get(self.lang, ())
        if comparative(words[i], after, self.lang) or bare(words[i]) in hinges or bare(after) in hinges or modal_infinitive(words[i], after, self.lang) or infinitive_complement(words[i], after, self.lang):
            return None
        if any(k in self.segment_ends for k in range(i + 1, min(i + limit["lookahead"] + 1, len(words)))):
            return None
        return "semantic" if self.similarity(" ".join(words[max(0, i - 10) : i + 1]), " ".join(words[i + 1 : i + 11])) < L.SEMANTIC_BREAK else None

    def utterances(self, words: list[str], start: int, end: int) -> list[Utterance]:
        """Runs of words of one speaker; of covering turns the longest owns a word. The last run goes on to the end."""
        near = sorted((t for t in self.turns if t[0] < end and t[1] > start), key=lambda t: t[0])
        owner = [max((t for t in near if t[0] <= i < t[1]), key=lambda t: t[1] - t[0], default=(0, 0, None))[2] for i in range(start, end)]
        out, at = [], 0
        for k in range(1, len(owner) + 1):
            if k == len(owner) or owner[k] != owner[at]:
                if owner[at]:
                    out.append(Utterance(" ".join(words[at:k]), owner[at], start + at, start + k))
                at = k
        return out or [Utterance(" ".join(words), None, start, end)]

    def split(self, text: str) -> tuple[list[Split], list[int]]:
        """(sentences, words whose period was taken away before a connector of the same speaker)."""
        words = text.split()
        changes, out, removed, chunk, start = self.changes(words), [], [], [], 0
        for i in range(len(words)):
            chunk.append(words[i])
            why = self.reason(words, i, chunk, changes) if len(words) >= 3 else None
            if i == len(words) - 1:
                why = why or "end"
            elif not why and len(words) >= 3 and words[i].endswith(".") and bare(words[i + 1]) in SETS["connectors"]:
                if self.speaker(i) is not None and self.speaker(i) == self.speaker(i + 1):
                    chunk[-1], words[i + 1] = words[i].rstrip(".!?"), bare(words[i + 1])
                    removed.append(i)
            if why:
                own = self.utterances(chunk, start, i + 1)
                out.append(Split(" ".join(chunk), own[0].speaker, why, own))
                chunk, start = [], i + 1
        return out, removed

    def join_connectors(self, sentences: list[Split]) -> tuple[list[Split], list[int]]:
        """'... .' and a sentence of the same known speaker that starts with a connector, in pairs."""
        out, removed, at, i = [], [], 0, 0
        while i < len(sentences):
            a, n = sentences[i], len(sentences[i].text.split())
            b = sentences[i + 1] if i + 1 < len(sentences) else None
            then = b.text.split() if b else []
            if then and bare(then[0]) in SETS["connectors"] and a.text.endswith(".") and self.speaker(at + n - 1) is not None and self.speaker(at + n - 1) == self.speaker(at + n):
                out.append(Split(" ".join([a.text.rstrip("."), bare(then[0]), *then[1:]]), a.speaker, b.split_reason, a.utterances + b.utterances))
                removed.append(at + n - 1)
                at, i = at + n + len(then), i + 2
                continue
            out.append(a)
            at, i = at + n, i + 1
        return out, removed


UTTERANCE = pa.struct([("text", pa.string()), ("speaker", pa.string()), ("start_word", pa.int32()), ("end_word", pa.int32())])
SENTENCE = pa.struct([("text", pa.string()), ("speaker", pa.string()), ("split_reason", pa.string()), ("utterances", pa.list_(UTTERANCE))])
TYPE = "array<struct<text:string,speaker:string,split_reason:string,utterances:array<struct<text:string,speaker:string,start_word:int,end_word:int>>>>"


def split_texts(texts: DataFrame, similarity: Callable[[str, str], float] | None = None) -> DataFrame:
    """(media_id, sentences, removed) of (media_id, lang, text, segment_ends array<int>, turns array<struct<start_word, end_word, speaker>>)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, gone = [], []
            for lang, text, ends, turns in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                own = Splitter(lang or "", frozenset(ends or ()), [(t["start_word"], t["end_word"], t["speaker"]) for t in turns or ()], similarity)
                sentences, inline = own.split(text or "")
                sentences, pairs = own.join_connectors(sentences) if own.turns else (sentences, [])
                done.append([s._asdict() | {"utterances": [u._asdict() for u in s.utterances]} for s in sentences])
                gone.append(inline + pairs)
            yield pa.RecordBatch.from_pydict({"media_id": batch.column(0), "sentences": pa.array(done, pa.list_(SENTENCE)), "removed": pa.array(gone, pa.list_(pa.int32()))})

    kind = texts.schema["media_id"].dataType.simpleString()
    return texts.select("media_id", "lang", "text", "segment_ends", "turns").mapInArrow(made, f"media_id {kind}, sentences {TYPE}, removed array<int>")


def speaker_changes(sentence: Column) -> Column:
    """Whether a sentence's utterances have several known speakers."""
    known = F.array_distinct(F.filter(F.transform(sentence["utterances"], lambda u: u["speaker"]), lambda s: s.isNotNull()))
    return F.size(known) > 1


def first_speaker(sentence: Column) -> Column:
    """The first utterance's speaker, the sentence's own where it has no utterances."""
    return F.when(F.size(sentence["utterances"]) > 0, F.coalesce(F.try_element_at(sentence["utterances"], F.lit(1))["speaker"], sentence["speaker"])).otherwise(sentence["speaker"])


# ---- the word rules as columns

def clean(word: Column) -> Column:
    return F.btrim(F.lower(word), F.lit(EDGE))


def guard_flags(word: Column, after: Column, lang: str) -> dict[str, Column]:
    """Flags of a word and its successor, as the fold's rules have them."""
    now, then = clean(word), clean(after)
    participle = then.rlike(f"(?:{'|'.join(L.PARTICIPLE_ENDS)})$") | then.isin(L.PARTICIPLES) | then.rlike("^ge.*(?:t|en)$")
    return {
        "grammar": now.isin(sorted(SETS["closed"])) | now.isin(L.FORBIDDEN_ENDS.get(lang, [""])),
        "number_unit": now.rlike("[0-9]") & then.isin(L.UNITS),
        "numbered_noun": now.isin(L.NUMBERED_NOUNS) & F.btrim(after, F.lit(".,;:!?")).rlike("^[0-9]+$"),
        "participle": now.isin(L.AUXILIARIES) & participle,
        "comparative": (then.isin(L.COMPARATIVES.get(lang, [""])) & now.isin(L.DEGREES.get(lang, [""]))) | (now.isin(L.COMPARATIVES.get(lang, [""])) & after.rlike(r"^\p{Ll}")),
        "modal_infinitive": now.isin(L.GOVERNORS.get(lang, [""])) & after.rlike(r"^\p{Ll}") & (F.length(then) >= 2) & then.rlike(INFINITIVE.pattern),
        "infinitive_complement": F.lit(lang == "es") & after.rlike(r"^\p{Ll}") & (F.length(now) >= 2) & now.rlike(INFINITIVE.pattern),
    }

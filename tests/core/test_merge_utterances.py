"""Utterances of merged sentences."""

from talktide.operators import merge
from talktide.operators.merge import Sentence
from talktide.plans.transcript import transcribe


def one(text, speaker):
    return Sentence(text, speaker, ((text, speaker),))


def test_every_merge_keeps_what_was_said():
    cases = [
        ([one("Visit google.", "A"), one("Com.", None), one("For more.", "B")], [("Visit google.", "A"), ("Com.", None), ("For more.", "B")]),
        ([one("It cost 99.", "A"), one("9% of it.", "A")], [("It cost 99.", "A"), ("9% of it.", "A")]),
        ([one("Nein.", "A"), one("Nein.", None), one("Nein.", "A")], [("Nein.", "A"), ("Nein.", None), ("Nein.", "A")]),
    ]
    for sentences, want in cases:
        (found,), _ = merge.apply_passes(sentences, "de")
        assert list(found.utterances) == want


def test_equal_texts_keep_their_own(spark):
    rows = [("m", "en", [("Okay.", "A", [("Okay.", "A")]), ("Then it cost 99.", "A", [("Then it", "A"), ("cost 99.", "B")]), ("9% less.", None, [("9% less.", "C")]), ("Okay.", "B", [("Okay.", "B")])])]
    df = spark.createDataFrame(rows, "media_id string, lang string, sentences array<struct<text:string,speaker:string,utterances:array<struct<text:string,speaker:string>>>>")
    found = merge.format_sentences(df).first().sentences
    assert [[u.speaker for u in s.utterances] for s in found] == [["A"], ["A", "B", "C"], ["B"]]
    bare = df.selectExpr("media_id", "lang", "transform(sentences, s -> named_struct('text', s.text, 'speaker', s.speaker)) AS sentences")
    assert [list(s.utterances) for s in merge.format_sentences(bare).first().sentences] == [[], [], []]


def test_transcript_has_both_speakers(spark):
    segments = spark.createDataFrame([("m", i, 2.0 * i, 2.0 * i + 2.0, t) for i, t in enumerate(["we all went to the old harbour.", "the boats had left at noon."])], "media_id string, seq int, start double, end double, text string")
    turns = spark.createDataFrame([("m", 0, 0.0, 2.0, "A"), ("m", 1, 2.0, 4.0, "B")], "media_id string, seq int, start double, end double, speaker string")
    value = transcribe(segments, turns, "en").output.first().value
    assert "harbour." in value and "noon." in value and value.index("harbour") < value.index("boats")

"""Operators on fixed examples and against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from talktide.operators import merge, score, segments, speakers, split
from talktide.plans import transcript
from talktide.sources import sinks
from talktide.streaming.dedupe import dedupe_stream

SEG = "media_id string, seq int, start double, end double, text string"
TURN = "media_id string, seq int, start double, end double, speaker string"


def segs(spark, rows):
    return spark.createDataFrame([("m", i, float(a), float(b), t) for i, (a, b, t) in enumerate(rows)], SEG)


def turns(spark, rows):
    return spark.createDataFrame([("m", i, float(a), float(b), s) for i, (a, b, s) in enumerate(rows)], TURN)


@pytest.mark.parametrize(("rows", "seed", "kept"), [([(0, 1, "a"), (0.9, 1.5, "b"), (1.49, 1.7, "c")], 1.0, "bc"), ([(0, 1, "a"), (0.9, 1.2, "b"), (1.3, 2.0, "c")], 0.95, "bc"), ([(0, 1.0, "a"), (0, 1.04, "b"), (0, 1.08, "c")], 0.0, "ac")])
def test_dedupe(spark, rows, seed, kept):
    assert [r.text for r in segments.dedupe(segs(spark, rows), 0.05, seed).orderBy("seq").collect()] == list(kept)


def test_globalise(spark):
    df = segs(spark, [(0, 1, "hello"), (1, 2, " world ")]).withColumn("chunk_start", F.lit(10.0))
    r = segments.globalise(df, last_end=9.5).first()
    assert (r.text, r.last_end) == ("hello\nworld", 12.0)


def test_srt(spark):
    cues = segments.srt_cues(segs(spark, [(0, 10, "x" * 62), (3, 4, "world")]), 6.0, 0.2, 1.0, 15.0).orderBy("seq").collect()
    assert [round(c.end, 6) for c in cues] == [2.8, 4.0]
    assert segments.srt_cues(segs(spark, [(1, 1, "Zero length")]), 4.5, 0.25, 1.5).first().end == 2.5
    assert sinks.srt(segments.srt_cues(segs(spark, [(0, 3, " a "), (4, 6, "b")]))).first().value.startswith("1\n00:00:00,000 --> 00:00:02,000\na\n\n2\n")
    assert segments.chunk_windows(spark.createDataFrame([("m", 1_000_000), ("n", 480_000)], "media_id string, len_ms long")).count() == 4


@pytest.mark.parametrize(("rows", "want"), [([(0, 10, "0")], []), ([(0, 10, "0"), (10, 20, "1")], [10]), ([(0, 0.3, "0"), (0.3, 4.0, "1"), (4.0, 4.4, "0")], [4.0]), ([(20, 30, "1"), (0, 10, "0"), (10, 20, "1")], [10])])
def test_speaker_boundaries(spark, rows, want):
    assert [r.timestamp for r in speakers.boundaries(turns(spark, rows)).where("included").orderBy("timestamp").collect()] == want


@pytest.mark.parametrize(("a", "b", "eps", "want"), [(None, None, 1, []), ([15, 5, 10], None, 1, [5, 10, 15]), (None, [20, 10, 30], 1, [10, 20, 30]), ([5, 15, 25], [10, 20, 30], 1, [5, 10, 15, 20, 25, 30]), ([10, 20], [10.5, 20.8], 1, [10, 20]), ([10], [10.3], 0.2, [10, 10.3]), ([5, 5.3, 15, 15.5], [5.2, 15.4], 1, [5, 15]), ([5.0, 5.8, 6.4], [], 1, [5.0, 6.4])])
def test_merge_boundaries(spark, a, b, eps, want):
    df = spark.createDataFrame([(a and [float(x) for x in a], [float(x) for x in b] if b is not None else None)], "a array<double>, b array<double>")
    assert df.select(speakers.merge_boundaries(F.col("a"), F.col("b"), eps).alias("m")).first().m == want


@pytest.mark.parametrize(("rows", "times", "want"), [([(0, 5, "Hello world"), (5, 10, "How are you"), (10, 15, "I am fine")], [5.0], [11]), ([(0, 5, "First"), (7, 12, "Second")], [6.0], [5]), ([(0, 10, "Segment one"), (10, 20, "Segment two"), (20, 30, "Segment three")], [10.0, 20.0], [11, 23]), ([(0, 10, "Only segment")], [5.0, 7.0, 9.0], [12])])
def test_boundary_chars(spark, rows, times, want):
    t = spark.createDataFrame([("m", i, x) for i, x in enumerate(times)], "media_id string, ord int, t double")
    assert [r.char_pos for r in segments.boundary_chars(t, segs(spark, rows)).orderBy("ord").collect()] == want


def test_turns_to_words(spark):
    s = segs(spark, [(0, 10, "one two three four five"), (10, 20, "six seven eight nine")])
    t = turns(spark, [(0, 5, "A"), (5, 19.5, "B"), (19.5, 20, "C")])
    ranges = speakers.char_ranges(t, s)
    assert sorted((r.start_char, r.end_char, r.speaker) for r in ranges.collect()) == [(0, 13, "A"), (13, 44, "B")]
    assert sorted((r.start_word, r.end_word, r.speaker) for r in speakers.word_ranges(ranges, transcript.joined(s)).collect()) == [(0, 3, "A"), (2, 9, "B")]


def test_formatter():
    make = lambda *t: [merge.Sentence(x) for x in t]
    out, log = merge.apply_passes(make("Visit google.", "Com for search", "No.", "No.", "No.", "99.", "9% accuracy"), "es")
    assert [s.text for s in out] == ["Visit google.com for search", "No, no, no.", "99.9% accuracy"] and len(log) == 3
    assert [s.text for s in merge.apply_passes(make("Visit google.", "Com"), "en")[0]] == ["Visit google.com"]
    assert len(merge.apply_passes(make("como lo decía Nate.", "Es considerada buena"), "es")[0]) == 2
    assert len(merge.apply_passes(make("una frase larga que sigue y que nunca es capaz de jugar.", "Es que vamos a ver"), "es")[0]) == 2
    out, log = merge.apply_passes([merge.Sentence("See site.", "A"), merge.Sentence("Com now", "B")], "en")
    assert len(out) == 2 and log[0].reason.startswith("skipped:")
    assert [s.text for s in merge.apply_passes(make("Soy Ana, de Texas.", "Unidos."), "es")[0]] == ["Soy Ana, de Texas, Unidos."]


def test_splitter_rules():
    words = [f"w{i}" for i in range(40)]
    own = split.Splitter("en", frozenset({14, 20}))
    assert [len(s.text.split()) for s in own.split(" ".join(words))[0]] == [15, 25]
    assert [len(s.text.split()) for s in split.Splitter("en").split(" ".join(words))[0]] == [40]
    spoken = split.Splitter("en", turns=[(0, 3, "A"), (3, 9, "B")]).split("we go home. And they stay there. And sleep well")[0]
    assert [(s.text, s.speaker) for s in spoken] == [("we go home.", "A"), ("And they stay there and sleep well", "B")]
    semantic = split.Splitter("en", similarity=lambda a, b: 0.1 if a.endswith("w29") else 0.9)
    assert [len(s.text.split()) for s in semantic.split(" ".join(words))[0]] == [30, 10]
    assert split.number_or_participle("18", "años", ["los", "18"]) and split.number_or_participle("fueron", "dirigidos", ["fueron"]) and not split.number_or_participle("casa", "roja", ["casa"])
    assert split.shift_past_mark(1, "así ¡empecemos, Nate! ya".split(), "es") == 2
    assert split.comparative("poco", "más", "es") and split.modal_infinitive("puedes", "encontrar", "es") and split.infinitive_complement("encontrar", "un", "es")


def test_guards_as_columns_agree_with_the_fold(spark):
    draw = random.Random(1)
    pool = ["18", "años", "fueron", "dirigidos", "el", "casa", "más", "poco", "baratos", "y", "episodio", "5", "The", "gegangen", "habló"]
    rows = [(draw.choice(pool), draw.choice(pool)) for _ in range(300)]
    flags = split.guard_flags(F.col("a"), F.col("b"), "es")
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", *(v.alias(k) for k, v in flags.items())).collect():
        assert r.grammar == split.guarded(r.a, "es") and r.comparative == split.comparative(r.a, r.b, "es")
        assert (r.number_unit or r.numbered_noun or r.participle) == split.number_or_participle(r.a, r.b, [r.a])


def test_word_errors(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    draw = random.Random(2)
    rows = [([draw.choice("abc") for _ in range(draw.randrange(7))], [draw.choice("abc") for _ in range(draw.randrange(7))]) for _ in range(150)]
    for r in spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", score.wer(F.col("a"), F.col("b")).alias("w")).collect():
        assert r.w == (round(distance(r.a, r.b) / len(r.a), 4) if r.a else float(bool(r.b)))


def test_transcripts(spark):
    s = segs(spark, [(0, 4, "hello there friend of mine"), (4, 9, "visit google"), (9, 12, "com today")])
    t = turns(spark, [(0, 4, "A"), (4, 12, "B")])
    out = transcript.transcribe(s, t, "en")
    assert out.output.first().value == "Hello there friend of mine.\n\nVisit google com today."
    assert transcript.transcribe(s, None, "en", "srt").output.first().value.count("-->") == 3
    with pytest.raises(ValueError):
        transcript.transcribe(s, None, "en", "doc")


def test_stream(spark, tmp_path):
    rows = [("m", 0, 0, 0.0, 1.0, "a"), ("m", 0, 1, 0.9, 1.04, "b"), ("m", 1, 0, 1.0, 1.08, "c"), ("n", 0, 0, 0.0, 2.0, "d")]
    schema = "media_id string, chunk_idx int, seq int, start double, end double, text string"
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = dedupe_stream(stream).writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.text for r in spark.table("kept").collect()) in (["a", "c", "d"], ["c", "d"])

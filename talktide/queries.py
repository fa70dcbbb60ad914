"""One query per operator over whole tables, and the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talktide import lexicons as L
from talktide.functions import text as T
from talktide.functions.rewrite import by_language, lower_first, words
from talktide.operators import merge, score, segments, speakers, split
from talktide.plans import views
from talktide.plans.views import VIEWS_SQL as V
from talktide.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


# ---- segments

CUES = (
    V
    + """, cues AS (
  SELECT media_id, seq, "start", "end" AS end_before, trim(text, ' ') AS text, lead("start") OVER (PARTITION BY media_id ORDER BY "start", seq) AS nxt,
    CASE WHEN length(trim(text, ' ')) = 0 THEN 2.0::DOUBLE ELSE greatest(2.0::DOUBLE, least(5.0::DOUBLE, length(trim(text, ' ')) / 15.0::DOUBLE)) END AS desired FROM segments
), capped AS (SELECT *, least(end_before, "start" + 5.0::DOUBLE, "start" + desired) AS e FROM cues
), gapped AS (SELECT *, CASE WHEN nxt - 0.25::DOUBLE > "start" THEN least(e, nxt - 0.25::DOUBLE) ELSE e END AS g FROM capped
), done AS (SELECT media_id, seq, "start", CASE WHEN g <= "start" THEN "start" + 2.0::DOUBLE ELSE g END AS "end", text, end_before FROM gapped)
"""
)
STAMP = "printf('%02d:%02d:%02d,%03d', floor({x} / 3600)::INT, floor(({x} % 3600) / 60)::INT, floor({x} % 60)::INT, floor(({x} - floor({x})) * 1000)::INT)"


@query(CUES + """SELECT media_id, seq, round("start", 6) AS "start", round("end", 6) AS "end", text FROM done""")
def srt_cues(spark, sf_dir):
    return segments.srt_cues(views.segments(spark, sf_dir)).select("media_id", "seq", r6("start").alias("start"), r6("end").alias("end"), "text")


@query(CUES + f"""SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY "start", seq)::INT AS idx,
 row_number() OVER (PARTITION BY media_id ORDER BY "start", seq) || chr(10) || {STAMP.format(x='"start"')} || ' --> ' || {STAMP.format(x='"end"')} || chr(10) || text AS cue FROM done""")
def srt_text(spark, sf_dir):
    return segments.srt_text(segments.srt_cues(views.segments(spark, sf_dir)))


@query(CUES + """SELECT media_id, count(*) FILTER (end_before - "end" > 0.0005) AS n_trimmed, round(coalesce(max(end_before - "end") FILTER (end_before - "end" > 0.0005), 0), 6) AS max_trim,
 round(coalesce(sum(end_before - "end") FILTER (end_before - "end" > 0.0005), 0), 4) AS total_trim FROM done GROUP BY media_id""")
def srt_trim_stats(spark, sf_dir):
    found = segments.trim_stats(segments.srt_cues(views.segments(spark, sf_dir)))
    return found.select("media_id", "n_trimmed", r6("max_trim").alias("max_trim"), F.round("total_trim", 4).alias("total_trim"))


@query(V + """SELECT media_id, 0 AS idx, 'Language: fr' || chr(10) || 'Task: transcribe' || chr(10) || 'Number of segments: ' || count(*) || chr(10) AS line FROM segments GROUP BY media_id UNION ALL
SELECT media_id, n::INT, printf('Segment %d: %.2fs - %.2fs', n, "start", "end") || chr(10) || 'Text: ' || trim(text, ' ') || chr(10) FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY "start", seq) AS n FROM segments)""")
def raw_dump(spark, sf_dir):
    return segments.raw_dump(views.segments(spark, sf_dir), "fr")


@query("""WITH media AS (SELECT user_id AS media_id, (date_diff('microsecond', min(ts), max(ts)) // 1000)::BIGINT AS len_ms FROM events GROUP BY user_id),
w AS (SELECT media_id, len_ms, unnest(range(0, (greatest(ceil((len_ms - 480000) / 477000.0), 0) + 1)::BIGINT)) AS k FROM media WHERE len_ms > 0)
SELECT media_id, k::INT AS chunk_idx, k * 477000 / 1000.0::DOUBLE AS start_sec, (least(k * 477000 + 480000, len_ms) - k * 477000) / 1000.0::DOUBLE AS duration_sec FROM w""")
def chunk_windows(spark, sf_dir):
    media = views.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("media_id")).agg(F.floor(F.expr("timestampdiff(MICROSECOND, min(ts), max(ts))") / 1000).alias("len_ms"))
    return segments.chunk_windows(media)


@query(V.replace("WITH segments", "WITH RECURSIVE segments") + """, walk AS (
  SELECT media_id, seq, "end" AS e, CASE WHEN "end" <= 0.0 + 2.0 THEN 0.0::DOUBLE ELSE "end" END AS last, "end" > 0.0 + 2.0 AS kept FROM overlap_segments WHERE seq = 1
  UNION ALL
  SELECT o.media_id, o.seq, o."end", CASE WHEN o."end" <= w.last + 2.0 THEN w.last ELSE o."end" END, o."end" > w.last + 2.0 FROM walk w JOIN overlap_segments o ON o.media_id = w.media_id AND o.seq = w.seq + 1
) SELECT media_id, seq::INT AS seq, round(e, 6) AS "end" FROM walk WHERE kept""")
def dedupe_overlap(spark, sf_dir):
    return segments.dedupe(views.overlap_segments(spark, sf_dir), 2.0).select("media_id", F.col("seq").cast("int").alias("seq"), r6("end").alias("end"))


@query(V + """SELECT media_id, string_agg(trim(text, ' '), chr(10) ORDER BY seq) AS text, count(*) AS n_segments, round(max("end") + 10, 6) AS last_end FROM segments GROUP BY media_id""")
def globalise_text(spark, sf_dir):
    found = segments.globalise(views.segments(spark, sf_dir).drop("speaker").withColumn("chunk_start", F.lit(10.0)))
    return found.select("media_id", "text", "n_segments", r6("last_end").alias("last_end"))


@query(V + """SELECT media_id, seq, char_end FROM places""")
def segment_char_ends(spark, sf_dir):
    return segments.char_ends(views.spaced_segments(spark, sf_dir)).select("media_id", "seq", "char_end")


@query(V + """SELECT media_id, char_end - 1 AS char_pos, right(text, 1) AS mark FROM places WHERE right(text, 1) IN ('.', '!', '?')""")
def terminal_marks(spark, sf_dir):
    return segments.terminal_marks(views.spaced_segments(spark, sf_dir))


@query(V + """, ranked AS (
  SELECT b.media_id, b.seq AS ord, p.char_end, row_number() OVER (PARTITION BY b.media_id, b.seq ORDER BY
    CASE WHEN p."start" <= b.t AND b.t <= p."end" THEN 0 WHEN p."end" <= b.t THEN 1 ELSE 2 END,
    CASE WHEN p."start" <= b.t AND b.t <= p."end" THEN 0 WHEN p."end" <= b.t THEN b.t - p."end" ELSE 0 END, p.seq) AS n
  FROM (SELECT media_id, seq, "end" + 2 AS t FROM segments) b JOIN places p ON p.media_id = b.media_id
) SELECT media_id, char_end AS char_pos, min(ord) AS ord FROM ranked WHERE n = 1 GROUP BY media_id, char_end""")
def boundary_to_char(spark, sf_dir):
    times = views.segments(spark, sf_dir).select("media_id", F.col("seq").alias("ord"), (F.col("end") + 2).alias("t"))
    return segments.boundary_chars(times, views.spaced_segments(spark, sf_dir))


@query(V + """, ends AS (SELECT media_id, word_idx, word, sum(length(word) + 1) OVER (PARTITION BY media_id ORDER BY word_idx) - 1 AS e FROM words)
SELECT DISTINCT p.media_id, w.word_idx FROM places p JOIN ends w ON w.media_id = p.media_id AND w.e - length(w.word) <= p.char_end - 1 AND p.char_end - 1 < w.e""")
def segment_word_ends(spark, sf_dir):
    return segments.word_ends(views.spaced_segments(spark, sf_dir), segments.words_of(views.joined_texts(spark, sf_dir)))


@query(V + """, ends AS (SELECT media_id, word_idx, word, sum(length(word) + 1) OVER (PARTITION BY media_id ORDER BY word_idx) - 1 AS e FROM words),
hit AS (SELECT p.media_id, p.char_end, min(w.word_idx) AS word_idx FROM places p JOIN ends w ON w.media_id = p.media_id AND p.char_end BETWEEN w.e - length(w.word) AND w.e + 3 GROUP BY 1, 2)
SELECT DISTINCT media_id, word_idx FROM hit""")
def char_to_word(spark, sf_dir):
    places = segments.char_ends(views.spaced_segments(spark, sf_dir)).select("media_id", F.col("char_end").alias("char_pos"))
    return segments.chars_to_words(places, segments.words_of(views.joined_texts(spark, sf_dir)))


# ---- speakers

@query(V + """, n AS (SELECT *, lead(speaker) OVER (PARTITION BY media_id ORDER BY "start", seq) AS nxt FROM turns)
SELECT media_id, seq::INT AS seq, round("end", 6) AS "timestamp", speaker AS from_speaker, nxt AS to_speaker, "end" - "start" >= 0.5 AS included FROM n WHERE nxt IS NOT NULL AND nxt <> speaker""")
def speaker_boundaries(spark, sf_dir):
    found = speakers.boundaries(views.turns(spark, sf_dir))
    return found.select("media_id", F.col("seq").cast("int").alias("seq"), r6("timestamp").alias("timestamp"), "from_speaker", "to_speaker", "included")


@query(V + """, n AS (SELECT *, lead(speaker) OVER (PARTITION BY media_id ORDER BY "start", seq) AS nxt FROM turns)
SELECT media_id, round("end", 6) AS "timestamp", CASE WHEN "end" - "start" >= 0.5 THEN 'included' ELSE printf('segment too short (%.2fs < 0.5s)', "end" - "start") END AS reason FROM n WHERE nxt IS NOT NULL AND nxt <> speaker""")
def speaker_boundary_details(spark, sf_dir):
    return speakers.boundaries(views.turns(spark, sf_dir)).select("media_id", r6("timestamp").alias("timestamp"), "reason")


@query(V + """, lists AS (SELECT media_id, list_sort(list("end") || list("start" + 2)) AS v FROM segments GROUP BY media_id)
SELECT media_id, list_transform(list_reduce(list_transform(v, lambda x: [x]), lambda a, b: CASE WHEN b[1] - a[len(a)] <= 1.0 THEN a ELSE a || b END), lambda x: round(x, 6)) AS merged FROM lists""")
def merge_boundaries(spark, sf_dir):
    lists = views.segments(spark, sf_dir).groupBy("media_id").agg(F.collect_list("end").alias("a"), F.collect_list(F.col("start") + 2).alias("b"))
    return lists.select("media_id", F.transform(speakers.merge_boundaries(F.col("a"), F.col("b")), lambda x: F.round(x, 6)).alias("merged"))


@query(V + """SELECT media_id, speaker, count(*) AS n_turns, round(sum("end" - "start"), 4) AS seconds FROM turns GROUP BY media_id, speaker""")
def speaker_talk_time(spark, sf_dir):
    return speakers.talk_time(views.turns(spark, sf_dir)).withColumn("seconds", F.round("seconds", 4))


@query(V + """SELECT media_id, count(DISTINCT speaker) AS num_speakers FROM turns GROUP BY media_id""")
def speaker_count(spark, sf_dir):
    return speakers.speaker_count(views.turns(spark, sf_dir))


@query(V + """, r AS (SELECT b.media_id, b.seq AS ord, s.seq, row_number() OVER (PARTITION BY b.media_id, b.seq ORDER BY abs(s."end" - (b."end" + 2)), s.seq) AS n FROM segments b JOIN segments s ON s.media_id = b.media_id)
SELECT media_id, ord, seq FROM r WHERE n = 1""")
def nearest_segment(spark, sf_dir):
    own = views.segments(spark, sf_dir)
    return speakers.nearest_segment(own.select("media_id", F.col("seq").alias("ord"), (F.col("end") + 2).alias("t")), own)


@query()
def turn_char_ranges(spark, sf_dir):
    return speakers.char_ranges(views.shifted_turns(spark, sf_dir), views.spaced_segments(spark, sf_dir))


@query()
def turn_word_ranges(spark, sf_dir):
    return speakers.word_ranges(turn_char_ranges(spark, sf_dir), views.joined_texts(spark, sf_dir))


RANGES = V + """, counts AS (SELECT media_id, seq, speaker, len(string_split(text, ' ')) AS n FROM spaced WHERE text <> ''),
ranges AS (SELECT media_id, seq AS ord, speaker, (sum(n) OVER w - n)::INT AS start_word, (sum(n) OVER w + 2)::INT AS end_word FROM counts WINDOW w AS (PARTITION BY media_id ORDER BY seq))
"""


def _ranges(spark, sf_dir) -> DataFrame:
    """Each segment's words and two more as its speaker's."""
    from pyspark.sql import Window

    w = Window.partitionBy("media_id").orderBy("seq")
    n = F.size(F.split("text", " "))
    own = views.spaced_segments(spark, sf_dir).where("text != ''").withColumn("e", F.sum(n).over(w))
    return own.select("media_id", F.col("seq").alias("ord"), "speaker", (F.col("e") - n).cast("int").alias("start_word"), (F.col("e") + 2).cast("int").alias("end_word"))


@query(RANGES + """SELECT w.media_id, w.word_idx, arg_min(r.speaker, r.ord) AS speaker FROM words w LEFT JOIN ranges r ON r.media_id = w.media_id AND r.start_word <= w.word_idx AND w.word_idx < r.end_word GROUP BY 1, 2""")
def speaker_at_word(spark, sf_dir):
    return speakers.speaker_at(segments.words_of(views.joined_texts(spark, sf_dir)), _ranges(spark, sf_dir))


@query(RANGES + """, own AS (SELECT w.media_id, w.word_idx, w.word, r.speaker, row_number() OVER (PARTITION BY w.media_id, w.word_idx ORDER BY r.end_word - r.start_word DESC, r.start_word) AS n FROM words w JOIN ranges r ON r.media_id = w.media_id AND r.start_word <= w.word_idx AND w.word_idx < r.end_word),
marked AS (SELECT *, CASE WHEN lag(speaker) OVER v IS NOT DISTINCT FROM speaker AND lag(word_idx) OVER v = word_idx - 1 THEN 0 ELSE 1 END AS new FROM own WHERE n = 1 WINDOW v AS (PARTITION BY media_id ORDER BY word_idx)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY media_id ORDER BY word_idx) AS run FROM marked)
SELECT media_id, speaker, min(word_idx) AS start_word, max(word_idx) + 1 AS end_word, string_agg(word, ' ' ORDER BY word_idx) AS text FROM runs GROUP BY media_id, run, speaker""")
def utterances(spark, sf_dir):
    return speakers.utterances(segments.words_of(views.joined_texts(spark, sf_dir)), _ranges(spark, sf_dir))


@query()
def diarization_error(spark, sf_dir):
    found = speakers.der(views.segments(spark, sf_dir).select("media_id", "start", "end", "speaker"), views.shifted_turns(spark, sf_dir))
    return found.select("media_id", F.round("scored", 2).alias("scored"), F.round("errors", 2).alias("errors"), F.round("der", 4).alias("der"))


# ---- text

DOCS = "SELECT doc_id, lang, {} AS result FROM documents"


def _texts(spark, sf_dir, change: Callable[[Column], Column], lang: str | None = None) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents")
    return (docs.where(F.col("lang") == lang) if lang else docs).select("doc_id", "lang", change(F.col("text")).alias("result"))


def _spoiled(text: Column) -> Column:
    """Commas and periods set wrong, and some domains broken."""
    return F.concat(F.replace(F.replace(text, F.lit(", "), F.lit(" ,")), F.lit(". "), F.lit(".")), F.lit(" ,, visit google. com or bbc. co. uk"))


SPOILED = "(replace(replace(text, ', ', ' ,'), '. ', '.') || ' ,, visit google. com or bbc. co. uk')"


@query(DOCS.format(rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({SPOILED}, '\s+,', ',', 'g'), ',\s*,+', ', ', 'g'), ',\s+', ', ', 'g'), ',(\S)', ', \1', 'g')"))
def comma_spacing(spark, sf_dir):
    return _texts(spark, sf_dir, lambda t: T.comma_spacing(_spoiled(t)))


@query(DOCS.format(rf"regexp_replace({SPOILED}, '([.!?])([A-ZÁÉÍÓÚÑa-záéíóúñ¿¡])', '\1 \2', 'g')"))
def space_after_terminal(spark, sf_dir):
    return _texts(spark, sf_dir, lambda t: T.space_after_terminal(_spoiled(t)))


@query(r"""SELECT doc_id, lang, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, '.', '?.!') || ' x....', '\.\s*\?', '?', 'g'), '\?\s*\.', '?', 'g'), '\?\s*!', '!', 'g'), '\.{4,}', '...', 'g'), '!!+', '!', 'g') AS result FROM documents""")
def mixed_terminal(spark, sf_dir):
    return _texts(spark, sf_dir, lambda t: T.mixed_terminal(F.concat(F.replace(t, F.lit("."), F.lit("?.!")), F.lit(" x...."))))


SITES = "replace(text, ', ', ' www.site' || doc_id || '.co.uk, con.es; uno' || doc_id || '.com ')"


def _sites(text: Column) -> Column:
    """Domains in place of commas: with a subdomain, one whose name is a Spanish word, and a plain one."""
    return F.replace(text, F.lit(", "), F.concat(F.lit(" www.site"), F.col("doc_id"), F.lit(".co.uk, con.es; uno"), F.col("doc_id"), F.lit(".com ")))


def _masked_sql(text: str) -> str:
    """Four passes, as the longer forms go first; chr(2) keeps the dots behind Spanish words."""
    edge, label = r"(^|[^A-Za-z0-9\x{C0}-\x{17F}_-])", r"([A-Za-z0-9\x{C0}-\x{17F}-]+)"
    words, single, sub = "|".join(L.ES_NOT_LABELS), "|".join(L.SINGLE_TLDS), "|".join(L.SUBDOMAINS)
    out = f"regexp_replace({text}, '(?i){edge}({words})\\.(' || '{'|'.join([*L.COMPOUND_TLDS, *L.SINGLE_TLDS])}' || ')\\b', '\\1\\2' || chr(2) || '\\3', 'g')"
    for tld in L.COMPOUND_TLDS:
        a, b = tld.split(".")
        out = f"regexp_replace({out}, '(?i){edge}({sub})\\.{label}\\.({a})\\.({b})\\b', '\\1\\2__DOT__\\3__DOT__\\4_DOT_\\5', 'g')"
    out = f"regexp_replace({out}, '(?i){edge}({sub})\\.{label}\\.({single})\\b', '\\1\\2__DOT__\\3__DOT__\\4', 'g')"
    for tld in L.COMPOUND_TLDS:
        a, b = tld.split(".")
        out = f"regexp_replace({out}, '(?i){edge}{label}\\.({a})\\.({b})\\b', '\\1\\2__DOT__\\3_DOT_\\4', 'g')"
    out = f"regexp_replace({out}, '(?i){edge}{label}\\.({single})\\b', '\\1\\2__DOT__\\3', 'g')"
    return f"replace({out}, chr(2), '.')"


@query(DOCS.format(_masked_sql(SITES)))
def mask_domains(spark, sf_dir):
    return _texts(spark, sf_dir, lambda t: T.mask_domains(_sites(t)))


@query(DOCS.format("replace(text, ',', '.')"))
def unmask_domains(spark, sf_dir):
    """Marks of both kinds in place of commas."""
    mark = F.when(F.col("doc_id") % 2 == 0, T.MARK).otherwise(T.COMPOUND_MARK)
    return _texts(spark, sf_dir, lambda t: T.unmask_domains(F.replace(t, F.lit(","), mark)))


@query(DOCS.format(SITES))
def mask_unmask_roundtrip(spark, sf_dir):
    return _texts(spark, sf_dir, lambda t: T.unmask_domains(T.mask_domains(_sites(t))))


@query()
def fix_spaced_domains(spark, sf_dir):
    return _texts(spark, sf_dir, lambda t: T.fix_spaced_domains(_spoiled(t)))


@query()
def normalize_initials(spark, sf_dir):
    return _texts(spark, sf_dir, lambda t: T.initials(F.concat(t, F.lit(" by C. S. Lewis of the U. S. A."))))


@query()
def finalize_text(spark, sf_dir):
    return _texts(spark, sf_dir, lambda t: T.finalize(_spoiled(t)))


@query()
def paragraphs(spark, sf_dir):
    return _texts(spark, sf_dir, lambda t: T.paragraph(_spoiled(t), "en"))


def _list(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _any(values: list[str], form: str) -> str:
    return "(" + " OR ".join(form.format(v.replace("'", "''")) for v in values) + ")"


def _by_lang(cases: dict[str, str], otherwise: str) -> str:
    return "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cases.items()) + f" ELSE {otherwise} END"


def _listed(word: str, lists: dict[str, list[str]]) -> str:
    """Whether a word is in its language's list; of other languages, in the English one."""
    return _by_lang({k: f"lower({word}) IN {_list(v)}" for k, v in lists.items()}, f"lower({word}) IN {_list(lists['en'])}")


CONTAINS, STARTS, INSIDE = "contains(low, '{}')", "starts_with(low, '{} ')", "contains(low, ' {} ')"
LAST = r"list_extract(list_filter(string_split_regex(t, '\s+'), lambda x: x <> ''), -1)"


def _ends() -> str:
    """The end mark of `t`, as `w` is its last word."""
    return f"""CASE WHEN regexp_matches(t, '[.!?]$') THEN t WHEN {_listed('w', L.CONTINUATIONS)} THEN t
 WHEN lang = 'es' AND {_any(L.ES_CORE + L.ES_EXTRA, CONTAINS)} THEN rtrim(t, ',;: ') || '?' WHEN lang = 'es' AND low IN {_list(L.ES_FIXED_PHRASES)} THEN t || '.' ELSE rtrim(t, ',;: ') || '.' END"""


@query(f"SELECT doc_id, lang, {_ends()} AS result FROM (SELECT *, {LAST} AS w, lower(t) AS low FROM (SELECT doc_id, lang, rtrim(text, '.') || (CASE WHEN doc_id % 3 = 0 THEN ' and' WHEN doc_id % 3 = 1 THEN ',' ELSE '.' END) AS t FROM documents))")
def terminal_punctuation(spark, sf_dir):
    end = F.when(F.col("doc_id") % 3 == 0, " and").when(F.col("doc_id") % 3 == 1, ",").otherwise(".")
    return _texts(spark, sf_dir, lambda t: T.terminal_punctuation(F.concat(F.rtrim(t, F.lit(".")), end), F.col("lang")))


def _asks() -> str:
    """Whether words of `t`, in lower case `low`, mark a question; the first rule that applies decides."""
    starts, inside = (_by_lang({k: _any(v, form) for k, v in L.QUESTION_WORDS.items()}, _any(L.QUESTION_WORDS["en"], form)) for form in (STARTS, INSIDE))
    polite = _any([*L.GREETINGS["es"], "gracias", "por favor", "de nada", "no hay problema"], CONTAINS)
    es = "lang = 'es' AND "
    return f"""CASE WHEN {starts} THEN true WHEN {es}{_any([*L.ES_CORE, "como", "cuáles", *L.ES_VERB_STARTERS], STARTS)} THEN true WHEN {inside} AND NOT ({es}{polite}) THEN true
 WHEN {es}{_any(["por qué", "de quién", "a quién"], CONTAINS)} THEN true WHEN contains(t, '?') THEN true WHEN {es}{_any(L.ES_NOT_QUESTIONS, "starts_with(low, '{}')")} THEN false
 WHEN {es}{_any(L.ES_STATEMENTS + L.ES_SELF, CONTAINS)} AND NOT {_any(L.ES_CORE[:-1], CONTAINS)} THEN false WHEN {es}{_any(L.ES_INTRODUCTIONS, CONTAINS)} AND NOT {_any(L.ES_CORE, CONTAINS)} THEN false
 WHEN lang = 'en' AND {_any(L.EN_ASKS, CONTAINS)} THEN true WHEN {es}{_any(L.ES_ASKS + L.ES_ASK_PHRASES, CONTAINS)} THEN true ELSE false END"""


ASKED = "SELECT doc_id, lang, text AS t, lower(text) AS low FROM documents"


@query(f"SELECT doc_id, lang, {_asks()} AS result FROM ({ASKED})")
def question_indicators(spark, sf_dir):
    return _texts(spark, sf_dir, lambda t: T.question_indicators(t, F.col("lang")))


def _score() -> Column:
    """Stands for a model's score."""
    return (F.col("doc_id") % 20) / F.lit(20.0)


def _limits(name: str) -> str:
    return _by_lang({k: f"{L.thresholds(k)[name]}" for k in L.LANGUAGES}, f"{L.thresholds(None)[name]}")


@query(f"""SELECT doc_id, lang, CASE WHEN starts_with(ltrim(t, ' '), '¿') THEN true WHEN lang = 'es' AND NOT {_any([*L.ES_CORE, "como"], CONTAINS)} AND NOT {_any([*L.ES_CORE, "como"], STARTS)} AND {_any(L.ES_INTRODUCTIONS, CONTAINS)} THEN false
 ELSE score > CASE WHEN {_asks()} THEN {_limits("question_with_indicator")} ELSE {_limits("question")} END END AS question, score > {L.EXCLAMATION} AS exclamation FROM (SELECT *, (doc_id % 20) / 20.0::DOUBLE AS score FROM ({ASKED}))""")
def semantic_decisions(spark, sf_dir):
    text, lang = F.col("text"), F.col("lang")
    asked = T.question_indicators(text, lang)
    question = by_language(lang, {k: score.is_question(text, _score(), k, asked) for k in L.LANGUAGES}, score.is_question(text, _score(), "", asked))
    return views.table(spark, sf_dir, "documents").select("doc_id", "lang", question.alias("question"), score.is_exclamation(_score()).alias("exclamation"))


@query(f"""SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN ends_with(t, '?') THEN t ELSE rtrim(t, '.!,;: ') || '?' END WHEN doc_id % 3 = 1 THEN CASE WHEN ends_with(t, '!') THEN t ELSE rtrim(t, '.?,;: ') || '!' END
 WHEN regexp_matches(t, '[.!?]$') THEN t WHEN lang = 'es' AND lower(t) IN {_list(L.ES_FIXED_PHRASES)} THEN t || '.' ELSE rtrim(t, ',;: ') || '.' END AS result
FROM (SELECT doc_id, lang, rtrim(text, '.') || (CASE WHEN doc_id % 5 = 0 THEN '?' WHEN doc_id % 5 = 1 THEN ' ,' WHEN doc_id % 5 = 2 THEN '!' ELSE '' END) AS t FROM documents)""")
def semantic_punctuation(spark, sf_dir):
    end = F.when(F.col("doc_id") % 5 == 0, "?").when(F.col("doc_id") % 5 == 1, " ,").when(F.col("doc_id") % 5 == 2, "!").otherwise("")
    return _texts(spark, sf_dir, lambda t: T.semantic_punctuation(F.concat(F.rtrim(t, F.lit(".")), end), F.col("lang"), F.col("doc_id") % 3 == 0, F.col("doc_id") % 3 == 1))


@query(f"SELECT doc_id, lang, {_listed('w', L.CONTINUATIONS)} AS result FROM (SELECT *, {LAST} AS w FROM (SELECT doc_id, lang, text || CASE WHEN doc_id % 2 = 0 THEN ' and' WHEN doc_id % 3 = 0 THEN ' y' ELSE ' end' END AS t FROM documents))")
def carry_forward(spark, sf_dir):
    last = F.when(F.col("doc_id") % 2 == 0, " and").when(F.col("doc_id") % 3 == 0, " y").otherwise(" end")
    return _texts(spark, sf_dir, lambda t: T.carries_forward(F.concat(t, last), F.col("lang")))


EACH_WORD = r"SELECT doc_id, lang, unnest(range(len(l)))::INT AS idx, unnest(l) AS word FROM (SELECT doc_id, lang, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS l FROM documents)"


def _each_word(spark, sf_dir) -> DataFrame:
    """(doc_id, lang, idx, word, after) of every word of every document."""
    own = views.table(spark, sf_dir, "documents").select("doc_id", "lang", words(F.col("text")).alias("w"))
    after = F.concat(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), F.array(F.lit("")))
    each = own.select("doc_id", "lang", F.posexplode(F.arrays_zip(F.col("w").alias("word"), after.alias("after"))).alias("idx", "p"))
    return each.select("doc_id", "lang", "idx", "p.word", "p.after")


@query(f"SELECT doc_id, idx, {_listed('word', L.TRANSITIONS)} AS transition, {_listed('word', L.STRONG_ENDS)} AS strong_end FROM ({EACH_WORD})")
def word_roles(spark, sf_dir):
    return _each_word(spark, sf_dir).select("doc_id", "idx", T.is_transition(F.col("word"), F.col("lang")).alias("transition"), T.strong_end(F.col("word"), F.col("lang")).alias("strong_end"))


@query("SELECT doc_id, unnest(range(len(l)))::INT AS idx, unnest(l) AS part FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?]+|[.!?]+') AS l FROM documents)")
def sentences_with_marks(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences_with_marks(F.col("text"))).alias("idx", "part"))


@query(r"SELECT doc_id, unnest(range(len(l)))::INT AS idx, unnest(l) AS part FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+([A-ZÁÉÍÓÚÑ¿¡])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS l FROM documents)")
def domain_safe_split(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.domain_safe_split(F.col("text"))).alias("idx", "part"))


@query(DOCS.format(r"CASE WHEN regexp_matches(text, '\pL') THEN regexp_extract(text, '^[^\pL]*') || lower(substr(text, length(regexp_extract(text, '^[^\pL]*')) + 1, 1)) || substr(text, length(regexp_extract(text, '^[^\pL]*')) + 2) ELSE text END"))
def lowercase_first_letter(spark, sf_dir):
    return _texts(spark, sf_dir, lower_first)


@query()
def sentence_assembly(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    text = F.concat("text", F.lit(" at 99.9 and"))
    every = docs.select("doc_id", "lang", by_language(F.col("lang"), {k: T.assemble(text, k) for k in ("en", "fr", "es", "de")}, F.lit(None)).alias("a"))
    # explode would infer a filter on the array and work out all sentences once more for it
    return every.select("doc_id", "lang", F.posexplode_outer("a.sentences").alias("idx", "sentence")).where("idx is not null")


@query(f"""SELECT doc_id, lang, CASE WHEN len(w) < 5 THEN text ELSE array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i >= 3 AND lower(coalesce(w[i + 1], '')) IN ('dass', 'weil', 'ob', 'wenn') AND NOT ends_with(w[i], ',') THEN w[i] || ',' ELSE w[i] END), ' ') END AS result
FROM (SELECT doc_id, lang, text, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM (SELECT doc_id, lang, replace(text, ' der ', ' weil ') AS text FROM documents WHERE lang = 'de'))""")
def german_commas(spark, sf_dir):
    return _texts(spark, sf_dir, lambda t: T.german_commas(F.replace(t, F.lit(" der "), F.lit(" weil "))), "de")


@query()
def german_format(spark, sf_dir):
    return _texts(spark, sf_dir, lambda t: T.format_sentence(F.replace(F.lower(t), F.lit(" in "), F.lit(" herr berlin ")), "de"), "de")


@query()
def french_format(spark, sf_dir):
    return _texts(spark, sf_dir, lambda t: T.format_sentence(F.concat(F.lit("comment allez vous, "), t), "fr"), "fr")


@query()
def english_format(spark, sf_dir):
    return _texts(spark, sf_dir, lambda t: T.format_sentence(t, "en"), "en")


@query()
def spanish_cleanup(spark, sf_dir):
    return _texts(spark, sf_dir, lambda t: T.es_cleanup(F.concat(F.lit("Hola, a todos. ¿Listos. "), t)), "es")


def _spanish(name: str, rule: Callable[[Column], Column], instead: str, given: str, *steps: tuple[str, str]) -> None:
    """A rule over the Spanish documents, in which `given` stands instead of a mark; `steps` are its patterns in SQL."""
    sql = f"replace(text, '{instead}', '{given}')"
    for pattern, to in steps:
        sql = f"regexp_replace({sql}, '{pattern}', '{to}', 'g')"
    SQL[name] = f"SELECT doc_id, lang, {sql} AS result FROM documents WHERE lang = 'es'"
    QUERIES[name] = lambda spark, sf_dir: _texts(spark, sf_dir, lambda t: rule(F.replace(t, F.lit(instead), F.lit(given))), "es")


_spanish("es_tag_questions", T.es_tag_questions, ", ", ", ¿no.y eso, ¿Verdad .x bien ¿cierto ? ", (r"(?i),\s*¿\s*(no|cierto|verdad)\s*\.\b", r", ¿\1?"), (r"(?i)([^?,\.\s])\s+¿\s*(no|cierto|verdad)\s*\?", r"\1, ¿\2?"))
_spanish("es_collocations", T.es_collocations, ". ", ". Por? supuesto que por ?Supuesto! ", (r"\b[Pp]or\s*\?\s*[Ss]upuesto\b", "Por supuesto"), (r"(^|[\n.!?]\s*)(Por supuesto)\b", r"\1\2,"))
_spanish("es_gerunds", T.es_gerunds, ", ", " Estoy. comiendo, están.  leyendo y Estás. bien ", (r"(?i)\b(Estoy|Estás|Está|Estamos|Están)\.\s+([a-záéíóúñ]+(?:ando|iendo|yendo))\b", r"\1 \2"))
_spanish("es_capitalised_words", T.es_capitalised_words, ", ", ". Ana. Luz. De. ", (r"(^|[^\pL\pN_])([A-ZÁÉÍÓÚÑ][a-záéíóúñ]+)\.(\s+)([A-ZÁÉÍÓÚÑ][a-záéíóúñ]+)\.", r"\1\2 \4."))


@query()
def location_appositives(spark, sf_dir):
    return _texts(spark, sf_dir, lambda t: T.location_appositives(F.concat(F.lit("I am, from Austin. Texas is it. "), t), "en"), "en")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in L.LANGUAGES.items()) + ") AS t(code, name)")
def languages(spark, sf_dir):
    return spark.createDataFrame(list(L.LANGUAGES.items()), "code string, name string")


@query("SELECT d.doc_id, coalesce(t.name, d.lang) AS language FROM documents d LEFT JOIN (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in L.LANGUAGES.items()) + ") AS t(code, name)) t ON t.code = d.lang")
def language_names(spark, sf_dir):
    names = F.create_map(*(F.lit(x) for pair in L.LANGUAGES.items() for x in pair))
    return views.table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.try_element_at(names, F.col("lang")), "lang").alias("language"))


# ---- sentences

def _in(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


FLAGGED = f"""WITH w AS ({EACH_WORD}),
n AS (SELECT doc_id, lang, idx, word, nxt, trim(lower(word), '.,;:!?¿¡') AS a, trim(lower(nxt), '.,;:!?¿¡') AS b FROM (SELECT *, coalesce(lead(word) OVER (PARTITION BY doc_id ORDER BY idx), '') AS nxt FROM w))
"""
LOWER_NEXT = r"regexp_matches(nxt, '^\p{Ll}')"


def _per_lang(word: str, lists: dict[str, list[str]]) -> str:
    """Whether a word is in its language's list; other languages have none."""
    return _by_lang({k: f"{word} IN {_list(v)}" for k, v in lists.items()}, "false")


def _flag(spark, sf_dir, *names: str) -> DataFrame:
    flags = {k: split.guard_flags(F.col("word"), F.col("after"), k) for k in ("en", "es", "fr", "de")}
    other = split.guard_flags(F.col("word"), F.col("after"), "")
    return _each_word(spark, sf_dir).select("doc_id", "idx", *(by_language(F.col("lang"), {k: f[n] for k, f in flags.items()}, other[n]).alias(n) for n in names))


@query(FLAGGED + f"""SELECT doc_id, idx, a IN {_in(sorted(split.SETS["closed"]))} OR {_per_lang("a", L.FORBIDDEN_ENDS)} AS grammar, a IN {_in(L.NUMBERED_NOUNS)} AND regexp_matches(trim(nxt, '.,;:!?'), '^[0-9]+$') AS numbered_noun FROM n""")
def grammar_guard_flags(spark, sf_dir):
    return _flag(spark, sf_dir, "grammar", "numbered_noun")


@query(FLAGGED + f"""SELECT doc_id, idx, a IN {_in(L.AUXILIARIES)} AND (regexp_matches(b, '({"|".join(L.PARTICIPLE_ENDS)})$') OR b IN {_in(L.PARTICIPLES)} OR regexp_matches(b, '^ge.*(t|en)$')) AS participle, regexp_matches(a, '[0-9]') AND b IN {_in(L.UNITS)} AS number_unit FROM n""")
def participle_flags(spark, sf_dir):
    return _flag(spark, sf_dir, "participle", "number_unit")


@query(FLAGGED + f"""SELECT doc_id, idx, ({_per_lang("b", L.COMPARATIVES)} AND {_per_lang("a", L.DEGREES)}) OR ({_per_lang("a", L.COMPARATIVES)} AND {LOWER_NEXT}) AS comparative,
 {_per_lang("a", L.GOVERNORS)} AND {LOWER_NEXT} AND length(b) >= 2 AND regexp_matches(b, '{split.INFINITIVE.pattern}') AS modal_infinitive,
 lang = 'es' AND {LOWER_NEXT} AND length(a) >= 2 AND regexp_matches(a, '{split.INFINITIVE.pattern}') AS infinitive_complement FROM n""")
def bound_word_flags(spark, sf_dir):
    return _flag(spark, sf_dir, "comparative", "modal_infinitive", "infinitive_complement")


SAID = V + """, said AS (SELECT media_id, seq, text, CASE WHEN seq // 2 % 2 = 0 THEN 'A' ELSE 'B' END AS speaker FROM spaced)
"""


def _said(spark, sf_dir) -> DataFrame:
    """(media_id, s): each medium as one sentence, two turns at a time by one of two speakers."""
    speaker = F.when(F.floor(F.col("seq") / 2) % 2 == 0, "A").otherwise("B")
    each = views.spaced_segments(spark, sf_dir).select("media_id", F.struct("seq", "text", speaker.alias("speaker")).alias("u"))
    lists = each.groupBy("media_id").agg(F.array_sort(F.collect_list("u")).alias("u"))
    said = F.transform("u", lambda u: F.struct(u["text"].alias("text"), u["speaker"].alias("speaker")))
    return lists.select("media_id", F.struct(F.array_join(F.transform("u", lambda u: u["text"]), " ").alias("text"), F.lit("A").alias("speaker"), said.alias("utterances")).alias("s"))


@query(SAID + f""", marked AS (SELECT *, CASE WHEN lag(speaker) OVER v IS NOT DISTINCT FROM speaker THEN 0 ELSE 1 END AS new FROM said WHERE trim(text, ' ') <> '' WINDOW v AS (PARTITION BY media_id ORDER BY seq)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY media_id ORDER BY seq) AS run FROM marked),
runs AS (SELECT media_id, run, string_agg(text, ' ' ORDER BY seq) AS text FROM numbered GROUP BY media_id, run),
judged AS (SELECT *, count(*) OVER (PARTITION BY media_id) > 1 AND min(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))) OVER (PARTITION BY media_id) >= {sinks.LEAST_WORDS} AS apart FROM runs)
SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY run) - 1)::INT AS piece, text FROM judged WHERE apart UNION ALL
SELECT media_id, 0, string_agg(text, ' ' ORDER BY seq) FROM said WHERE media_id NOT IN (SELECT media_id FROM judged WHERE apart) GROUP BY media_id""")
def speaker_paragraphs(spark, sf_dir):
    return _said(spark, sf_dir).select("media_id", F.posexplode(sinks.pieces(F.col("s"))).alias("piece", "text"))


@query(SAID + """SELECT media_id, count(DISTINCT speaker) > 1 AS has_changes, arg_min(speaker, seq) AS first_speaker FROM said GROUP BY media_id""")
def sentence_speakers(spark, sf_dir):
    return _said(spark, sf_dir).select("media_id", split.speaker_changes(F.col("s")).alias("has_changes"), split.first_speaker(F.col("s")).alias("first_speaker"))


@query()
def split_sentences(spark, sf_dir):
    text = views.joined_texts(spark, sf_dir)
    ends = segments.word_ends(views.spaced_segments(spark, sf_dir), segments.words_of(text)).groupBy("media_id").agg(F.collect_list("word_idx").alias("segment_ends"))
    ranges = turn_word_ranges(spark, sf_dir).groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word", "speaker"))).alias("turns"))
    found = split.split_texts(text.join(ends, "media_id", "left").join(ranges, "media_id", "left").withColumn("lang", F.lit("en")))
    return found.select("media_id", F.posexplode("sentences").alias("idx", "s")).select("media_id", "idx", "s.text", "s.speaker", "s.split_reason", F.size("s.utterances").alias("n_utterances"))


def _broken(spark, sf_dir) -> DataFrame:
    """Documents as sentences, with some that were split at a domain, a decimal or an emphatic word."""
    cut = F.split(F.concat(F.lit("Visit google|Com for more|Cost 99|9% of it|No|No|No|"), F.replace("text", F.lit(". "), F.lit("|"))), r"\|", -1)
    ended = F.transform(cut, lambda s: F.struct(F.concat(s, F.lit(".")).alias("text"), F.lit(None).cast("string").alias("speaker")))
    return views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("media_id"), "lang", ended.alias("sentences"))


@query()
def sentence_merges(spark, sf_dir):
    return merge.format_sentences(_broken(spark, sf_dir)).select("media_id", F.posexplode("sentences").alias("idx", "s")).select("media_id", "idx", "s.text")


@query()
def merge_summary(spark, sf_dir):
    history = merge.format_sentences(_broken(spark, sf_dir)).select(F.explode("history").alias("h")).select("h.*")
    return merge.merge_summary(history)


# ---- scores

@query("""WITH p AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE label = 0 AND vec_id < 100)
SELECT s.vec_id AS id, round(max(list_cosine_similarity(s.embedding::DOUBLE[], p.e)), 5) AS score FROM embeddings s, p GROUP BY s.vec_id""")
def semantic_question_scores(spark, sf_dir):
    rows = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit("question").alias("kind"), "embedding", "label")
    return score.best_prototype(rows, rows.where("label = 0 and id < 100")).select("id", F.round("score", 5).alias("score"))


@query("""WITH n AS (SELECT label AS "group", vec_id AS ord, embedding::DOUBLE[] AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id)::DOUBLE[] AS b FROM embeddings)
SELECT "group", ord, round(list_cosine_similarity(a, b), 5) AS similarity FROM n WHERE b IS NOT NULL""")
def semantic_breaks(spark, sf_dir):
    rows = views.table(spark, sf_dir, "embeddings").select(F.col("label").alias("group"), F.col("vec_id").alias("ord"), "embedding")
    return score.semantic_breaks(rows).select("group", "ord", F.round("similarity", 5).alias("similarity"))


@query(r"""SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '[^\pL\pN_\s''-]', ' ', 'g'), '\s+', ' ', 'g')) AS result FROM benchmark""")
def wer_normalise(spark, sf_dir):
    return views.table(spark, sf_dir, "benchmark").select("item_id", T.wer_normalise(F.col("text")).alias("result"))


@query(r"""WITH RECURSIVE b AS (SELECT item_id, string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\pL\pN_\s''-]', ' ', 'g'), '\s+', ' ', 'g')), ' ') AS w FROM benchmark),
pairs AS (SELECT item_id, w AS a, flatten(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i % 4 = 0 THEN [] WHEN i % 5 = 0 THEN ['other'] WHEN i % 7 = 0 THEN [w[i], 'more', w[i]] ELSE [w[i]] END)) AS h FROM b),
d AS (SELECT item_id, a, h, 0 AS i, range(0, len(h) + 1) AS line FROM pairs UNION ALL
  SELECT item_id, a, h, i + 1, list_reduce([[line[1] + 1]] || list_transform(range(1, len(h) + 1), lambda j: [least(line[j] + (h[j] <> a[i + 1])::INT, line[j + 1] + 1)]), lambda x, y: x || [least(y[1], x[len(x)] + 1)]) FROM d WHERE i < len(a))
SELECT item_id, round_even(line[len(line)] / len(a), 4) AS wer FROM d WHERE i = len(a)""")
def wer(spark, sf_dir):
    """Against a copy with words left out, replaced and added."""
    ref = views.table(spark, sf_dir, "benchmark").select("item_id", score.word_array(T.wer_normalise(F.col("text"))).alias("ref"))
    spoilt = F.transform("ref", lambda w, i: F.when((i + 1) % 4 == 0, F.array().cast("array<string>")).when((i + 1) % 5 == 0, F.array(F.lit("other"))).when((i + 1) % 7 == 0, F.array(w, F.lit("more"), w)).otherwise(F.array(w)))
    both = ref.withColumn("hyp", F.flatten(spoilt))
    return both.select("item_id", score.wer(F.col("ref"), F.col("hyp")).alias("wer"))


@query("""WITH a AS (SELECT doc_id AS key, quality + 0.01 * (doc_id % 5) AS v FROM labels WHERE doc_id % 7 <> 0), b AS (SELECT doc_id AS key, quality + 0.01 * (doc_id % 9) AS v FROM labels WHERE doc_id % 11 <> 0)
SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'missing' WHEN a.key IS NULL THEN 'new' WHEN b.v - a.v > 0.02 THEN 'regression' WHEN b.v - a.v < -0.02 THEN 'improvement' ELSE 'same' END AS status FROM a FULL JOIN b ON a.key = b.key""")
def baseline_compare(spark, sf_dir):
    own = views.table(spark, sf_dir, "labels")
    value = lambda n: (F.col("quality") + F.lit(0.01).cast("decimal(3,2)") * (F.col("doc_id") % n)).alias("value")
    side = lambda n, m: own.where(F.col("doc_id") % m != 0).select(F.col("doc_id").alias("key"), value(n))
    return score.compare(side(5, 7), side(9, 11)).select("key", "status")


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) WHERE n <= 15")
def items_per_dataset(spark, sf_dir):
    """A report: the first items of each data set."""
    return score.first_per_group(views.table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 15)


@query("SELECT doc_id AS id, 'question' AS tag, contains(text, '?') AS passed FROM documents UNION ALL SELECT doc_id, 'inverted', regexp_matches(text, '[¿¡]') FROM documents")
def pattern_checks(spark, sf_dir):
    return score.pattern_checks(views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.array(F.lit("question"), F.lit("inverted")).alias("tags")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

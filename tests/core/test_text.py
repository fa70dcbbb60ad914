"""Text functions on fixed examples."""

import pytest
from pyspark.sql import functions as F

from talktide.functions import text as T

X = "x"
lang = lambda code: F.lit(code)

CASES = {
    "comma_spacing": (T.comma_spacing, {"a,b,c": "a, b, c", "palabra ,otra": "palabra, otra", "test  ,  value": "test, value", "a , b , c": "a, b, c", "test,,doble": "test, doble", "test, ,doble": "test, doble", "test,,,triple": "test, triple", "a, , , ,b": "a, b", "147,151,156": "147, 151, 156", "1,000,000": "1, 000, 000", "": "", None: "", ",": ",", ",,": ", ", " , ": ", "}),
    "mixed_terminal": (T.mixed_terminal, {"a.?": "a?", "a?.": "a?", "a! .": "a!", "a!?": "a!", "a?!": "a!", "a.....": "a...", "a..": "a.", "a...": "a...", "a!!!": "a!", "a??": "a?"}),
    "mask": (lambda x: T.mask_domains(x), {"Visit google.com for search": "Visit google__DOT__com for search", "Go to github.de for code": "Go to github__DOT__de for code", "Y que es uno.de los lugares": "Y que es uno.de los lugares", "Este.es muy importante": "Este.es muy importante", "Check bbc.co.uk for news": "Check bbc__DOT__co_DOT_uk for news", "see www.google.com": "see www__DOT__google__DOT__com", "www.bbc.co.uk": "www__DOT__bbc__DOT__co_DOT_uk"}),
    "mask_all": (lambda x: T.mask_domains(x, False), {"Y que es uno.de los lugares": "Y que es uno__DOT__de los lugares", "Este.es muy importante": "Este__DOT__es muy importante"}),
    "mask_es": (lambda x: T.mask_domains(x, True, "es"), {"ser tratada.de hecho": "ser tratada.de hecho", "marca.com": "marca__DOT__com"}),
    "round_trip": (lambda x: T.unmask_domains(T.mask_domains(x)), {"a www.bbc.co.uk b google.com uno.de": "a www.bbc.co.uk b google.com uno.de"}),
    "spaced": (lambda x: T.fix_spaced_domains(x), {"google. com": "google.com", "github. de": "github.de", "bbc. co. uk": "bbc.co.uk", "uno. de": "uno. de", "x. COM": "x.com", "a. gov. uk y": "a.gov.uk y"}),
    "spaced_all": (lambda x: T.fix_spaced_domains(x, False), {"uno. de": "uno.de"}),
    "initials": (T.initials, {"C. S. Lewis": "C.S. Lewis", "J. K. Rowling": "J.K. Rowling", "J. R. R. Tolkien": "J.R.R. Tolkien", "in the U. S. A.": "in the USA", "in the U. S. today": "in the US today", "the U. S. Capitol": "the U.S. Capitol", "": "", None: None}),
    "safely": (lambda x: T.safely(x, lambda t: F.regexp_replace(t, r"\.([A-Z])", ". $1")), {"Visit google.com.Then go": "Visit google.com. Then go"}),
    "aware": (lambda x: T.domain_aware_replace(r"\.([a-z])", ". $1")(x), {"a.b google.com": "a. b google.com"}),
    "paragraph": (lambda x: T.paragraph(x, "es"), {"hola.Que tal": "Hola. Que tal", "mejor Y aquí": "Mejor y aquí", "dos. En vez": "Dos. En vez", "ve a google. com, De verdad": "Ve a google.com, de verdad", "B-E-S-T": "B-E-S-T"}),
    "upper": (T.upper_first, {"¿qué": "¿Qué", "éa": "Éa", "": "", "12": "12", "Ab": "Ab"}),
    "lower": (T.lower_first, {"¿Qué": "¿qué", "(Ab": "(ab"}),
    "finalize": (T.finalize, {"hola.que tal": "hola. Que tal", "a ,b?c": "a, b? C", "visita google.com ya": "visita google.com ya", "": ""}),
    "wer": (T.wer_normalise, {"It's  well-known, Señor!": "it's well-known señor"}),
    "terminal_en": (lambda x: T.terminal_punctuation(x, lang("en")), {"hello,": "hello.", "go and": "go and", "done.": "done.", "": ""}),
    "terminal_es": (lambda x: T.terminal_punctuation(x, lang("es")), {"Ve a": "Ve a", "dónde estamos": "dónde estamos?", "todo bueno;": "todo bueno.", "claro": "claro."}),
    "fragment": (lambda x: T.terminal_punctuation(x, lang("en"), "fragment"), {"go and": "go and."}),
    "questions_es": (lambda x: T.question_indicators(x, lang("es")).cast("string"), {"qué hora es": "true", "yo soy de aquí": "false", "puedes venir": "true", "hola amigo": "false", "dime por qué": "true", "gracias a todos": "false"}),
    "questions_en": (lambda x: T.question_indicators(x, lang("en")).cast("string"), {"what now": "true", "can you go": "true", "i go": "false", "tell me where it is": "true", "x?": "true"}),
    "german_commas": (T.german_commas, {"ich weiß nicht genau ob er kommt": "ich weiß nicht genau, ob er kommt", "ich sage dass es": "ich sage dass es", "ja das ist gut, weil es": "ja das ist gut, weil es"}),
    "german_titles": (T.german_titles, {"Herr müller und Frau schmidt": "Herr Müller und Frau Schmidt"}),
    "german_names": (T.german_names, {"in berlin und österreich": "in Berlin und Österreich", "berliner": "berliner"}),
    "german_nouns": (T.german_nouns, {"das haus und eine katze, mein hut": "das Haus und eine Katze, mein hut", "diese blumen": "diese Blumen"}),
    "french": (T.french_hyphenation, {"Comment allez vous": "Comment allez-vous", "Pouvez vous m'aider": "Pouvez-vous m'aider", "Y a il": "Y a-t-il", "Va il": "Va-t-il", "est ce que tu": "est-ce que tu", "qu est ce que": "qu'est-ce que"}),
    "format_en": (lambda x: T.format_sentence(x, "en"), {"hello how are you": "Hello, how are you.", "what is it": "What is it?", "from London England": "From London England.", "i am from London England. ok": "I am from London, England. Ok."}),
    "format_de": (lambda x: T.format_sentence(x, "de"), {"wie ist das wetter": "Wie ist das Wetter?"}),
    "location": (lambda x: T.location_appositives(x, "en"), {"I am, from Austin. Texas": "I am, from Austin, Texas", "Austin, Texas. Then we": "Austin, Texas then we", "Austin, Texas. And I am": "Austin, Texas. And I am"}),
    "tags": (T.es_tag_questions, {"Está bien ¿verdad?": "Está bien, ¿verdad?"}),
    "collocations": (T.es_collocations, {"por? supuesto que": "Por supuesto, que"}),
    "possessives": (T.es_possessives, {"tu. Español": "tu español", "mi. Amigo": "mi amigo"}),
    "gerunds": (T.es_gerunds, {"Estamos. Hablando": "Estamos Hablando"}),
    "capitalised": (T.es_capitalised_words, {"Estados. Unidos.": "Estados Unidos."}),
    "introductions": (T.es_introductions, {"Yo soy Andrea de Santander, Colombia": "Yo soy Andrea, de Santander, Colombia"}),
    "starts": (T.es_sentence_starts, {"hola. ¿qué tal? google.com": "Hola. ¿Qué tal? google.com"}),
    "imperatives": (T.es_imperatives, {"Vamos a empezar.": "¡Vamos a empezar!", "Todo bien.": "Todo bien.", "vamos?": "vamos?"}),
    "pairs": (T.es_question_pairs, {"¿Dónde está.": "¿Dónde está?", "Cómo estás?": "¿Cómo estás?", "Hola a todos?": "Hola a todos?"}),
    "greetings": (T.es_greetings, {"Hola, a todos": "Hola a todos", "¡Hola a todos! ¡Bienvenidos a casa!": "Hola a todos, ¡bienvenidos a casa!", "Bueno vamos": "Bueno, vamos"}),
}


@pytest.mark.parametrize("name", CASES)
def test_examples(spark, name):
    change, pairs = CASES[name]
    df = spark.createDataFrame([(k,) for k in pairs], "x string")
    found = {r.x: r.y for r in df.select("x", change(F.col(X)).alias("y")).collect()}
    assert found == pairs


def test_assembly(spark):
    cases = {
        ("en", "It cost 99.9 in all. Then...we went. See site.org now"): (["It cost 99.9 in all.", "Then...we went."], "See site.org now"),
        ("fr", "Merci à toutes et tous, au. Moins en consultation. Bonjour."): (["Merci à toutes et tous, au moins en consultation.", "Bonjour."], ""),
        ("es", "Soy Ana, de Texas. Unidos. Vale."): (["Soy Ana, de Texas, Unidos.", "Vale."], ""),
    }
    for (code, text), (sentences, trailing) in cases.items():
        row = spark.createDataFrame([(text,)], "x string").select(T.assemble(F.col(X), code).alias("a")).first().a
        assert (list(row.sentences), row.trailing) == (sentences, trailing)


def test_timestamps(spark):
    df = spark.createDataFrame([(0.0,), (3661.5,), (59.9996,), (1.1,)], "x double")
    assert [r[0] for r in df.select(T.timestamp(F.col(X))).collect()] == ["00:00:00,000", "01:01:01,500", "00:00:59,999", "00:00:01,100"]

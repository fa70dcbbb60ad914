"""Personal data, found by fixed patterns, and terms that disclose it, found by what the corpus says of them.

Only DataFrame functions. The patterns give e-mail addresses, IP addresses, card and phone numbers as spans in code
points. Every value found so is a protected entity e. For a term t that occurs beside e, the corpus estimates how much
t tells about e: PMI(t; e) = log2(n(t,e) N / (n(t) n(e))) with numbers of documents n. It is at most the information
content IC(e) = log2(N / n(e)), which it reaches when t never occurs without e. In documents that hold e, terms whose
disclosure PMI / IC reaches a threshold are generalised, beyond a second one removed. One or two common documents are
little evidence, so that a share of their disclosure counts; the shares don't depend on the size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talktide.functions.rewrite import let
from talktide.llm.common import documents_of, join_hot, scratch_table

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, written so that the matcher neither recurses nor goes back over a run of characters again.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?![A-Za-z0-9-]|\.[A-Za-z0-9-])",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9\x20-]*?(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for its pattern to be tried.
NEEDS = {"email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike("[0-9]"), "phone": lambda t: F.contains(t, F.lit("+"))}
TERM = r"[\p{L}\p{N}]+"
EVIDENCE = {1: 0.5, 2: 0.85}  # share of the disclosure that counts, by the number of documents that hold both; 1 from three on
BROADCAST = 1 << 17  # rows of a term and an entity that are broadcast; more are joined by a shuffle
GENERALISE, REMOVE = 0.8, 0.95  # disclosure
CHUNK = 256


def running(sizes: Column) -> Column:
    """Exclusive running sums of an array, in chunks: a plain fold copies the whole array at each step."""
    n = F.size(sizes)
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / CHUNK), F.lit(0)).cast("int")), lambda c: F.slice(sizes, c * CHUNK + 1, F.lit(CHUNK)))
    grow = lambda start, by: F.concat(start, F.array(F.element_at(start, -1) + by))
    zero = F.array(F.lit(0).cast("long"))
    inner = F.transform(parts, lambda part: F.aggregate(part, zero, lambda a, x: grow(a, x.cast("long"))))
    base = F.aggregate(F.transform(inner, lambda part: F.element_at(part, -1)), zero, grow)
    return F.flatten(F.zip_with(inner, F.slice(base, 1, F.size(inner)), lambda part, b: F.transform(F.slice(part, 1, F.size(part) - 1), lambda x: x + b)))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the pattern's matches, leftmost and non-overlapping, in code points."""

    def of(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        return let(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m)), lambda steps: placed(found, steps))

    def placed(found: Column, steps: Column) -> Column:
        each = F.arrays_zip(running(steps).alias("before"), steps.alias("step"), found.alias("value"))
        end = lambda x: x["before"] + x["step"]
        return F.transform(each, lambda x: F.struct((end(x) - F.length(x["value"])).alias("start"), end(x).alias("end"), x["value"].alias("value")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


SPAN = "array<struct<start:bigint,end:bigint,value:string>>"


def base_spans(text: Column, kind: str) -> Column:
    """The valid matches of one kind; a text that can't hold any isn't searched."""
    return F.when(NEEDS[kind](text), F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))).otherwise(F.array().cast(SPAN))


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(column: str, rank: int) -> Column:
    return F.transform(column, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit([*KINDS, "term", "removed"][rank]).alias("kind")))


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t1, t2, email, ip, card, phone, body) of every row: 128 bits that stand for the text, the base spans, and the text where it has any."""
    rows = documents_of(docs, id_col, text_col)
    text = F.col("text")
    marked = rows.select("doc_id", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"), *(base_spans(text, k).alias(k) for k in KINDS), text)
    some = F.size("email") + F.size("ip") + F.size("card") + F.size("phone") > 0
    return marked.withColumn("body", F.when(some, text)).drop("text")


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _value(kind: str) -> Column:
    """What stands for an entity: kind and lower case, or digits."""
    return F.transform(kind, lambda m: F.concat(F.lit(kind + ":"), F.lower(m["value"]) if kind in ("email", "ip") else F.regexp_replace(m["value"], "[^0-9]", "")))


def _holders(base: DataFrame) -> DataFrame:
    """(t1, t2, m, body, ranges, entities): every text with an entity once, and how many documents have it."""
    ranges = F.flatten(F.array(*(F.transform(k, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))) for k in KINDS)))
    some = base.where("body is not null").select("t1", "t2", "body", ranges.alias("ranges"), F.array_distinct(F.flatten(F.array(*map(_value, KINDS)))).alias("entities"))
    return scratch_table(some.groupBy("t1", "t2").agg(F.count("*").alias("m"), *(F.first(c).alias(c) for c in ("body", "ranges", "entities"))))


def _told(docs: DataFrame, base: DataFrame, own: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(t1, t2, entity) of every text and entity of it that terms may disclose, and (entity, term, disclosure) as `disclosing` gives it."""
    total = float(base.count())
    # fewer common documents can't reach `least`, so an entity or a pair of fewer needs no further look
    fewest = next(n for n in (1, 2, 3) if EVIDENCE.get(n, 1.0) >= least or n == 3)
    each = scratch_table(own.select("t1", "t2", "m", F.explode("entities").alias("entity")))
    counts = scratch_table(each.groupBy("entity").agg(F.sum("m").alias("n_e"), F.count("*").alias("n")).where(F.col("n_e") >= fewest))
    held = scratch_table(join_hot(each, counts, ["entity"]).select("t1", "t2", "m", "entity", "n_e"))
    words = own.join(held.select("t1", "t2").distinct(), ["t1", "t2"], "left_semi").select("t1", "t2", F.explode(_terms(F.col("body"))).alias("term"))
    # ids meet, not texts; a row per pair and task is sent
    pairs = scratch_table(words.join(held, ["t1", "t2"]).groupBy("entity", "n_e", "term").agg(F.sum("m").alias("n_te")).where(F.col("n_te") >= fewest))
    names = scratch_table(pairs.select("term").distinct())
    names = F.broadcast(names) if names.count() <= BROADCAST else names
    terms = docs.select(F.explode(_terms(F.col("text"))).alias("term")).join(names, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    share = F.lit(1.0)
    for n, x in EVIDENCE.items():
        share = F.when(F.col("n_te") == n, x).otherwise(share)
    pmi = F.log2(F.col("n_te") * F.lit(total) / (F.col("n_t") * F.col("n_e")))
    content = F.log2(F.lit(total) / F.col("n_e"))
    # an entity in every document has no content to disclose
    told = pairs.join(terms, "term").where(content > 0).select("entity", "term", F.round(pmi / content * share, 9).alias("disclosure")).where(F.col("disclosure") >= least)
    return held.select("t1", "t2", "entity"), told


def disclosing(docs: DataFrame, base: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = GENERALISE) -> DataFrame:
    """(entity, term, disclosure): terms whose disclosure of a protected entity is `least` or more.

    Numbers of documents are taken over all of docs. Before anything is shuffled, each task adds up its own terms.
    """
    return _told(documents_of(docs, id_col, text_col), base, _holders(base), least)[1]


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t1, t2, email, ip, card, phone, terms) of every row; terms: array<struct<start, end, disclosure>>, none inside a base span."""
    base = scratch_table(found(docs, id_col, text_col))
    own = _holders(base)
    held, told = _told(documents_of(docs, id_col, text_col), base, own, GENERALISE)
    told = scratch_table(told)
    few = told.count() <= BROADCAST
    wanted = scratch_table(held.join(F.broadcast(told.select("entity").distinct()) if few else told.select("entity").distinct(), "entity", "left_semi"))
    some = own.join(wanted.select("t1", "t2").distinct(), ["t1", "t2"], "left_semi")
    tokens = some.select("t1", "t2", F.explode(matches(F.col("body"), TERM)).alias("m")).select("t1", "t2", F.lower("m.value").alias("term"), "m.start", "m.end")
    hits = tokens.join(F.broadcast(told) if few else told, "term").join(wanted, ["t1", "t2", "entity"], "left_semi")
    hits = hits.groupBy("t1", "t2", "start", "end").agg(F.max("disclosure").alias("disclosure"))
    terms = hits.groupBy("t1", "t2").agg(F.array_sort(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms"))
    outside = F.filter("terms", lambda x: ~F.exists("ranges", lambda r: (r["start"] < x["end"]) & (x["start"] < r["end"])))
    terms = own.select("t1", "t2", "ranges").join(terms, ["t1", "t2"]).select("t1", "t2", outside.alias("terms"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,disclosure:double>>")
    # rows of texts that hold nothing, of which one may have many copies, need no look
    some, nothing = (base.where(c).drop("body") for c in ("body is not null", "body is null"))
    return some.join(terms, ["t1", "t2"], "left").withColumn("terms", F.coalesce("terms", none)).unionByName(nothing.withColumn("terms", none))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans, n_terms) of every row of docs; spans as kind:start:end, comma-joined.

    A null text is the empty text and holds nothing; a null id stays null; repeated rows count each as a document
    and come back each for itself; other columns are ignored; an empty table gives an empty table.
    """
    every = spans(docs, id_col, text_col)
    base = F.concat(*(_of_kind(k, i) for i, k in enumerate(KINDS)))
    return every.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), _listed(base).alias("base_spans"), _listed(F.concat(base, _of_kind("terms", 4))).alias("spans"), F.size("terms").cast("long").alias("n_terms"),
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): base spans as [EMAIL], [IP], ..., disclosing terms as [TERM] or removed; of overlapping spans, the first counts."""
    kinds = F.concat(*(_of_kind(k, i) for i, k in enumerate(KINDS)), F.transform("terms", lambda m: F.struct(m["start"].alias("start"), F.when(m["disclosure"] >= REMOVE, 5).otherwise(4).alias("rank"), m["end"].alias("end"), F.when(m["disclosure"] >= REMOVE, "removed").otherwise("term").alias("kind"))))
    cuts = spans(docs, id_col, text_col).select("t1", "t2", F.array_sort(kinds).alias("cuts")).where(F.size("cuts") > 0).dropDuplicates(["t1", "t2"])
    rows = documents_of(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.when(s["kind"] == "removed", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out")))
    whole = F.aggregate("cuts", start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return rows.join(cuts, ["t1", "t2"], "left").select("doc_id", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(whole).alias("text"))

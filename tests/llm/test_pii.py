import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from talktide.llm import pii
from talktide.llm.queries import op7_disclosure

CONTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def base(text):
    out = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(CONTRACT.items()) for m in re.finditer(p, text or "") if valid(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_patterns_on_random_strings(spark):
    draw = random.Random(2)
    parts = ["a", "B.", "@", ".", "x.y", "-", " ", "1", "25", "255.", "256", "4111 1111-1111 1111", "+", "+1 (", ")", "é", "\U0001f600", "%", "_", "..", "me@site.org", "10.0.0.1", "+44 20 7946 0958", "\n", "--", "079927398713"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(25))) for _ in range(3000)] + ["a." * 3000 + "@" + "b." * 3000 + "c", "1 " * 5000, "1." * 5000, "7" * 5000, "x@y.z " * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in df.select("doc_id", *(pii.base_spans(F.col("text"), k).alias(k) for k in pii.KINDS)).collect()}
    for i, t in enumerate(texts):
        own = sorted((m.start, n, m.end, k) for n, k in enumerate(pii.KINDS) for m in found[i][k])
        assert ",".join(f"{k}:{a}:{b}" for a, _, b, k in own) == base(t), repr(t[:200])
        assert all(m.value == t[m.start : m.end] for k in pii.KINDS for m in found[i][k])


def brute_terms(docs):
    """{document: spans of disclosing terms}"""
    terms = [set(re.findall(r"[^\W_]+", (t or "").lower())) for _, t in docs]
    entity = []
    for _, t in docs:
        own = set()
        for x in filter(None, base(t).split(",")):
            k, a, b = x.split(":")
            v = (t or "")[int(a) : int(b)]
            own.add(k + ":" + (v.lower() if k in ("email", "ip") else re.sub("[^0-9]", "", v)))
        entity.append(own)
    n_t, n_e = Counter(x for s in terms for x in s), Counter(x for s in entity for x in s)
    n_te = Counter((e, t) for es, ts in zip(entity, terms, strict=True) for e in es for t in ts)
    total = len(docs)
    share = lambda n: {1: 0.5, 2: 0.85}.get(n, 1)
    bad = {p for p, n in n_te.items() if total > n_e[p[0]] and round(math.log2(n * total / (n_t[p[1]] * n_e[p[0]])) / math.log2(total / n_e[p[0]]) * share(n), 9) >= pii.GENERALISE}
    out = []
    for (_, t), es in zip(docs, entity, strict=True):
        ranges = [tuple(map(int, x.split(":")[1:])) for x in filter(None, base(t).split(","))]
        out.append([(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", t or "") if any((e, m[0].lower()) in bad for e in es) and not any(a < m.end() and m.start() < b for a, b in ranges)])
    return out


def check(rows, docs):
    terms = brute_terms(docs)
    want = []
    for (i, t), own in zip(docs, terms, strict=True):
        every = [(int(a), list(CONTRACT).index(k), int(b), k) for k, a, b in (x.split(":") for x in filter(None, base(t).split(",")))] + [(a, 4, b, "term") for a, b in own]
        want.append((str(i), base(t), ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(every))))
    assert sorted((str(r.doc_id), r.base_spans, r.spans) for r in rows) == sorted(want)


def test_disclosing_terms(spark, awkward, empty):
    docs = [(i, f"Agent Falcon wrote to me@site.org about the {w} zebra") for i, w in enumerate("abcd")]
    docs += [(10 + i, f"the weather of day {i} and about nothing") for i in range(20)] + [(40, None), (None, "call +44 20 7946 0958 now"), (41, "Falcon")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = pii.report(df).collect()
    check(rows, docs)
    assert {r.doc_id for r in rows if r.n_terms} == {0, 1, 2, 3}
    text = dict(pii.sanitise(df).collect())
    assert text[0] == " [TERM]   [EMAIL] about the a " and text[10] == docs[4][1] and text[None] == "call [PHONE] now"
    check(pii.report(awkward).collect(), [tuple(r) for r in awkward.select("doc_id", "text").collect()])
    assert pii.report(empty).count() == 0 and pii.sanitise(empty).count() == 0


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(pii.report(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)
    rows = op7_disclosure(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.base_sha256) for r in rows) == sorted((i, hashlib.sha256(base(t).encode()).hexdigest()) for i, t in docs)
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 0

import re

import pytest

from talktide.llm import common, units


def brute(docs, by):
    norm = lambda x: re.sub(r"[ \t\n\v\f\r]+", " ", x.lower()).strip(" ")
    ranked = sorted({(i is None, i or 0, t or "") for i, t in docs})
    first, out = {}, {}
    for none, i, t in ranked:
        for k, x in enumerate(t.split(by)):
            first.setdefault(norm(x), (none, i, t, k))
    for none, i, t in ranked:
        at, spans, kept, n = 0, [], [], 0
        for k, x in enumerate(t.split(by)):
            n += norm(x) != ""
            if norm(x) and first[norm(x)] != (none, i, t, k):
                spans.append(f"{at}:{at + len(x)}")
            else:
                kept.append(x)
            at += len(x) + len(by)
        out[none, i, t] = (n, ",".join(spans), by.join(kept))
    return sorted((str(i), *out[i is None, i or 0, t or ""]) for i, t in docs)


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_matches_brute_force(spark, small, unit):
    docs = [(r.doc_id, r.text) for r in small.collect()] + [(5, None), (6, ""), (7, " \n\n "), (None, "Same LINE\n\nother"), (900001, "same  line\n\nsame line \n\nother"), (900001, "same  line\n\nsame line \n\nother")]
    found = units.dedup(spark.createDataFrame(docs, "doc_id long, text string"), unit).collect()
    assert sorted((str(r.doc_id), r.n_units, r.spans, r.kept) for r in found) == brute(docs, units.SEPARATORS[unit][0])
    assert any(r.n_removed for r in found)


def test_awkward_rows(spark, awkward, empty):
    found = units.dedup(awkward).collect()
    assert sorted((str(r.doc_id), r.n_units) for r in found) == sorted((str(i), n) for i, _, n, _ in ((i, t, sum(bool(x.strip(" \t\v\f\r")) for x in (t or "").split("\n")), 0) for i, t in awkward.select("doc_id", "text").collect()))
    by = {r.doc_id: r for r in found}
    assert by[1].spans == "45:89" and by[None].n_removed == 1 and by[9].n_removed == 1 and by[8].n_removed == 0
    assert units.dedup(empty).count() == 0


LONG = "One of the sentences that stand in many a text and hold a dozen words. Another sentence follows it at once, again of more than ten words in all!"


@pytest.mark.parametrize("least_run", [0, 25])
def test_sentences(spark, least_run):
    docs = [(1, f"Start. {LONG} End."), (2, f"Other start of a text {LONG} And more."), (3, f"Begin.\n{LONG}  \nStart. Tail."), (4, "Start. End."), (5, LONG), (6, f"A.  {LONG}\n"), (None, f"Start. Q\n\n{LONG}"), (7, None)]
    found = {r.doc_id: r for r in units.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), "sentence", least_run=least_run).collect()}
    texts = dict(docs)
    for i, r in found.items():
        removed = [texts[i][int(s) : int(e)] for s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert len(removed) == r.n_removed and sum(map(len, removed)) == r.removed_chars
    kept = {i: r.kept for i, r in found.items()}
    second = LONG[LONG.index("Another") :]
    assert kept[1] == docs[0][1] and kept[7] == "" and found[1].n_units == 4
    if least_run:
        # a run goes on from line to line; the second text's first sentence runs into what stands before, so that fewer than 25 words repeat there
        assert kept == {1: docs[0][1], 2: docs[1][1], 3: "Begin.\nTail.", 4: "Start. End.", 5: "", 6: "A.\n", 7: "", None: "Start. Q\n"}
    else:
        assert kept[2] == docs[1][1].replace(second + " ", "") and kept[3] == "Begin.\nTail." and kept[4] == "" and kept[None] == "Q\n"


def test_one_digest_of_a_third_of_all(spark, monkeypatch):
    docs = [(i, "the same line\n" * 5 + f"own {i}\nshared {i // 2}") for i in range(300)]
    for hot in (1, 4, 1 << 14):  # none, the most frequent and all of the digests are broadcast
        monkeypatch.setattr(common, "HOT", hot)
        found = units.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
        assert sum(r.n_removed for r in found) == 300 * 5 - 1 + 150 and sum(r.n_units for r in found) == 300 * 7

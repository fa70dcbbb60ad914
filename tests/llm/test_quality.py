import re

from talktide.llm import quality
from talktide.llm.queries import op6_quality_rules


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    hit = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def stats(rows):
    return sorted((str(r.doc_id), (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in rows)


def test_base_counts_match_brute_force(spark, awkward, small):
    docs = awkward.select("doc_id", "text").union(small.select("doc_id", "text"))
    rows = quality.judge(docs, spark.createDataFrame([(1,), (8,)], "doc_id long")).collect()
    assert stats(rows) == sorted((str(i), base(t)) for i, t in docs.collect())
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows)


def test_joined_marks_give_the_same_counts(spark, small, monkeypatch):
    trusted = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1")
    known = quality.bin_counts(small, trusted)
    monkeypatch.setattr(quality, "MOST_IDS", 3)
    assert (quality.bin_counts(small, trusted) == known).all()


def test_trusted_documents_are_kept_and_foreign_text_is_not(spark):
    rows = op6_quality_rules(spark, "/root/testdata/sf0.01").collect()
    good = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").collect()}
    judged = [r for r in rows if not r.base_failed and r.doc_id in good]
    assert sum(r.kept for r in judged) >= 0.98 * len(judged)
    bad = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 0").collect()}
    poor = [r for r in rows if not r.base_failed and r.doc_id in bad]
    assert sum(r.kept for r in poor) <= 0.4 * len(poor)


def test_no_labels_and_no_rows(spark, empty, small):
    none = spark.createDataFrame([], "doc_id long")
    assert quality.judge(empty, none).count() == 0
    assert all(r.kept != r.base_failed for r in quality.judge(small, none).collect())

from talktide.llm import pii


def test_entities_of_few_documents(spark):
    docs = [(i, f"zebra {w} wrote to me@site.org about the weather") for i, w in enumerate(["kayak", "canoe"])] + [(9, "ask you@site.org about the weather")]
    docs += [(10 + i, f"someone wrote about the weather of day d{i}") for i in range(60)]
    rows = {r.doc_id: r for r in pii.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    # "zebra" and "to" are in both documents of the address; words of one document are no evidence in so few documents
    assert {i for i, r in rows.items() if r.n_terms} == {0, 1} and "term:0:5" in rows[0].spans.split(",") and rows[0].n_terms == 2


def test_alike_at_every_size(spark):
    """One common document is no evidence, two are, however large the corpus."""
    for n in (100, 200_000):
        docs = spark.range(n).selectExpr("id AS doc_id", "if(id = 7, 'kayak common you@else.net', if(id in (3, 5), 'zebra common me@site.org', 'common')) AS text")
        told = pii.disclosing(docs, pii.found(docs).cache()).collect()
        assert {(r.entity, r.term) for r in told} == {("email:me@site.org", x) for x in ("zebra", "me", "site", "org")}


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    base = pii.found(docs).cache()
    found = pii.disclosing(docs, base, least=-10.0)
    held = base.where("body is not null").count()
    assert held > 0 and found.select("entity").distinct().count() >= held / 2

"""Model plug-ins, the command line, and every query with SQL against DuckDB."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from talktide import cli, queries
from talktide.operators import models, split

SF = "/root/testdata/sf0.001"


def test_models(spark):
    protos = models.prototypes(spark, lambda texts: [[float(len(t)), 1.0] for t in texts], "es")
    assert protos.groupBy("kind").count().orderBy("kind").collect() == [("exclamation", 10), ("question", 32)]
    df = spark.createDataFrame([(1, "es", "vive ana de cali en x.com"), (2, "es", None)], "id long, lang string, text string")
    cased = dict(models.entity_casing(df, lambda t, lang: [(5, len(t))]).collect())
    assert cased == {1: "vive Ana de Cali en x.com", 2: None}
    assert models.embed(df, lambda t: [[1.0]] * len(t)).count() == 2
    words = spark.createDataFrame([("m", i, w) for i, w in enumerate("uno dos the tres cuatro cinco".split())], "media_id string, word_idx int, word string")
    found = models.foreign_words(words, spark.createDataFrame([("The",)], "word string")).orderBy("word_idx")
    assert [r.foreign for r in found.collect()] == [True, True, True, True, True, False]


def test_sentence_columns(spark):
    rows = [({"utterances": [{"speaker": "A"}, {"speaker": None}, {"speaker": "B"}], "speaker": "A"},), ({"utterances": [], "speaker": "C"},)]
    df = spark.createDataFrame(rows, "s struct<utterances:array<struct<speaker:string>>,speaker:string>")
    assert [tuple(r) for r in df.select(split.speaker_changes(F.col("s")), split.first_speaker(F.col("s"))).collect()] == [(True, "A"), (False, "C")]


def test_command_line_arguments(monkeypatch):
    assert cli.threads(3) == 3
    monkeypatch.setenv("OMP_NUM_THREADS", "5")
    assert cli.threads(None) == 5
    assert cli.language("auto") is None and cli.language("xx") == "xx"
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["x", "--output_dir", "y", "--cpu-threads", "0"])


def test_command_line(spark, tmp_path, monkeypatch):
    (tmp_path / "s.json").write_text(json.dumps({"media_id": "m", "seq": 0, "start": 0.0, "end": 2.0, "text": "hello there friend"}))
    monkeypatch.setattr("talktide.session.session", lambda **k: spark)
    assert cli.main([str(tmp_path / "s.json"), "--output_dir", str(tmp_path / "out")]) == 0
    assert [p.read_text().strip() for p in (tmp_path / "out/txt").rglob("part-*.txt")] == ["Hello there friend."]
    assert cli.main([str(tmp_path / "none.json"), "--output_dir", str(tmp_path / "out")]) == 2


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    import duckdb

    found = queries.queries()[name](spark, SF)
    rows = found.collect()
    assert rows
    if sql := queries.oracle_sql().get(name):
        db = duckdb.connect()
        for t in ("documents", "benchmark", "labels", "conversations", "events", "embeddings"):
            db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        known = db.execute(sql)
        names = [d[0] for d in known.description]
        assert sorted(found.columns) == sorted(names)
        assert sorted(str(tuple(r[c] for c in names)) for r in rows) == sorted(map(str, known.fetchall()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

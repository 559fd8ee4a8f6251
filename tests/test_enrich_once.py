"""Asking each text once copies no text but that of the rows."""

from pyspark.sql import functions as F

from feedloom.operators import enrich as enrichment
from feedloom.sources.answers import AnswerStore
from feedloom.sources.runs import Runs


def test_texts_are_written_once(spark, tmp_path, monkeypatch):
    written, real = {}, enrichment.materialize
    monkeypatch.setattr(
        enrichment, "materialize", lambda df, name, **o: (written.update({name: df.columns}), real(df, name, **o))[1]
    )
    kept, put = [], Runs._write
    monkeypatch.setattr(Runs, "_write", lambda self, rows, *a: (kept.append(rows), put(self, rows, *a))[1])
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, None)], "id long, text string")
    answers = AnswerStore(str(tmp_path / "answers"))
    for client in (lambda: lambda text: {"title_en": text.upper()}, lambda: lambda text: None):
        got = enrichment.enrich(df, client, text="text", answers=answers)
        assert got.columns == ["id", "text", "answer"]
        assert {r.id: r.answer and r.answer["title_en"] for r in got.collect()} == {0: "A", 1: "B", 2: "A", 3: None}
    assert not {"text", "_asked"} & {*written["known"], *written["given"]}
    assert len(kept) == 1 and "REBALANCE" not in kept[0]._jdf.queryExecution().analyzed().toString().upper()
    # A text that is an expression is told apart from the columns.
    upper = enrichment.enrich(df, lambda: lambda text: {"title_en": text}, text=F.upper("text"), answers=answers)
    assert {r.id: r.answer and r.answer["title_en"] for r in upper.collect()} == {0: "A", 1: "B", 2: "A", 3: None}

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from feedloom.llm.queries import ORACLES, QUERIES
from tools.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) is None


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert {*QUERIES, "pipeline"} <= set(entry.queries())


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
        counts.append(docs.count())
    quality, exact, near, passages = counts[1:]
    assert counts[0] > quality > exact >= near == passages > 0.7 * counts[0]


def test_run(spark):
    pieces = corpus_pipeline.run(spark, SF_DIR)
    assert {"doc_id", "sequence_id", "offset", "ids"} <= set(pieces.columns) and pieces.count() > 0


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0


def test_hostile_documents_pass_through_all_stages(spark, cases, tmp_path):
    """Nulls, missing numbers, repeats, very long texts and clashing columns, and labels of some."""
    docs = cases.docs()
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i % 4 > 0), 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count(), name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in docs.collect()}
    assert all(p.offset + p.length <= 1024 for p in pieces)

"""The registered queries of the text corpus package against DuckDB, and the pipeline by stage."""

import pytest
from oracle_check import connect, differences

import corpus_pipeline
from longitab.llm.oracle import ORACLE
from longitab.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) == ""


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, frame):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(1).selectExpr("-1L doc_id", "cast(null as string) text", "lang", "source", "n_chars").union(
        docs.orderBy("doc_id").limit(1).selectExpr("1000000L doc_id", "concat(text, ' ') text", "lang", "source", "n_chars"))
    docs = docs.union(extra)
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
        kept.append(docs.count())
    assert kept[1] == kept[0] - 1 and kept[2] < kept[1] and kept[3] < kept[2] and kept[4] < kept[3]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == kept[4]


def test_pipeline_on_odd_rows(spark, frame):
    from odd import ODD
    docs = frame(ODD)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs.count()

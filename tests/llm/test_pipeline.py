import pytest

pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    seen = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = docs.count()
    assert seen["toxicity"] < before and seen["simhash"] < seen["toxicity"] and seen["decontamination"] < seen["simhash"]
    rows = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {d for x in rows for d in x["doc_ids"]} == {x["doc_id"] for x in docs.select("doc_id").collect()}


def test_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).selectExpr("*", "1 AS `a.b`", "2 AS id", "3 AS m1")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() > 0


def test_run_over_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0

import corpus_pipeline


def test_stages(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = step.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == columns, name
        assert step.count() <= before
        before = step.count()
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in whole.select("doc_id").collect()} == {r["doc_id"] for r in step.select("doc_id").collect()}
    assert 0 < before < docs.count()

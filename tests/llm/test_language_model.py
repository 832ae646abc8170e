from cases import documents, prose

from millrace.llm import language_id


def test_without_a_model_neither_the_stage_nor_op5_accepts(spark, tmp_path):
    import random

    docs = documents(spark, [(i, prose(random.Random(i), 50)) for i in range(4)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "http://a.aa/1", "<html lang=en>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    judged = language_id.op5(spark, str(tmp_path)).collect()
    kept = language_id.stage(spark, docs, str(tmp_path))
    assert len(judged) == 4 and not any(r.accepted for r in judged)
    assert kept.count() == 0 and kept.columns == docs.columns

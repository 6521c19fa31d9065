"""The pipeline on tables without rows and on odd rows only."""

import corpus_pipeline

from .docs import odd_rows, table


def _folder(spark, tmp_path, rows, items):
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_pipeline_of_empty_tables(spark, tmp_path):
    out = corpus_pipeline.run(spark, _folder(spark, tmp_path, [], []))
    assert out.count() == 0 and "doc_id" in out.columns


def test_pipeline_of_odd_rows(spark, tmp_path):
    rows = odd_rows()
    out = corpus_pipeline.run(spark, _folder(spark, tmp_path, rows, [(1, None), (2, "")])).collect()
    assert {r.doc_id for r in out} <= {d for d, _ in rows}

"""What stages store on the way."""

import pyarrow.parquet as pq

import corpus_pipeline


def test_whole_texts_are_stored_packed(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 50) for i in (1, 1, 2)] + [(None, None)], "doc_id long, text string")
    rows, number = corpus_pipeline._numbered_rows(docs)
    assert sorted(rows.select("doc_id", "text").collect(), key=str) == sorted(docs.collect(), key=str)
    assert rows.select(number).distinct().count() == 4
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in rows.inputFiles()]
    kinds = {f.row_group(0).column(i).compression for f in files if f.num_row_groups for i in range(f.num_columns)}
    assert kinds == {"ZSTD"}

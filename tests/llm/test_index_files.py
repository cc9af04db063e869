"""A file of the positional index holds few segments, however many a task makes: Parquet's writer and batch reader hold rows by number."""

import os

import pyarrow.parquet as pq

from motionlake.llm import decontamination


def test_segments_are_filed_by_few(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} of a text that makes a segment of its own") for i in range(100)], "doc_id long, text string").coalesce(1)
    path = str(tmp_path / "index")
    decontamination.build_index(docs, path, segment_bytes=1)
    rows = [pq.ParquetFile(f"{path}/{f}").metadata.num_rows for f in os.listdir(path) if f.endswith(".parquet")]
    assert sum(rows) == 100 and max(rows) <= 8
    benchmark = spark.createDataFrame([(1, "a text that makes a segment of its own")], "item_id long, text string")
    found = decontamination.matches(spark.read.schema(decontamination.INDEX_SCHEMA).parquet(path), benchmark).collect()
    assert sorted(r.doc_id for r in found) == list(range(100)) and all([tuple(s) for s in r.spans] == [(2, 11)] and r["items"] == [1] for r in found)

"""Stages of the pipeline on documents with odd names of columns, and without the usual ones."""

from __future__ import annotations

import corpus_pipeline
from tests.conftest import SMALL

TEXT = "word number one two three four five six seven eight nine ten eleven twelve thirteen fourteen "


def test_names_with_dots_and_ticks_and_no_length(spark):
    rows = [(i, TEXT * 2 + f"tail {i} {'x' * i}", "en", "s", 1.5, "t") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `a.b` double, `c``d` string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SMALL)
        assert kept.columns == docs.columns, name
        found = kept.collect()
        assert found and all(r["a.b"] == 1.5 and r["c`d"] == "t" for r in found), name

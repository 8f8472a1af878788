"""The language stage keeps texts with letters when there is no language to learn."""

from __future__ import annotations

import corpus_pipeline


def test_texts_with_letters_stay_when_no_language_is_learned(spark, tmp_path):
    rows = [(1, "some words", None), (2, "漢字", None), (3, "... 123", None), (4, None, None), (5, "", None), (None, "é", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[0], rows[1], rows[5]], key=repr)

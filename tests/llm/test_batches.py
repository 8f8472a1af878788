"""Byte-level BPE of texts that Arrow cuts into several batches, differently for different columns."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from zephyra.llm import bpe
from zephyra.llm.texts import ROW_BYTES, steady_pieces

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@settings(deadline=None, max_examples=200)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aé", max_size=12)), max_size=30), st.lists(st.integers(1, 6), min_size=30, max_size=30), st.integers(1, 300))
def test_cuts_depend_on_the_rows_alone(texts, cuts, limit):
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    def some():
        start = 0
        for n in cuts:
            yield whole.slice(start, n)
            start += n

    one, two = (list(steady_pieces(b, limit=limit)) for b in (iter([whole]), some()))
    assert [p.column("doc_id").tolist() for p in one] == [p.column("doc_id").tolist() for p in two]
    assert [p.data.tobytes() for p in one] == [p.data.tobytes() for p in two]
    assert [i for p in one for i in p.column("doc_id")] == list(range(len(texts)))
    for p in one:
        assert len(p) == 1 or len(p.data) + ROW_BYTES * len(p) <= limit


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(text, encoding):
    ids = np.array(encoding.encode_ordinary(text or ""), "<u4")
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("most", ["1k", "20k", "1m", "64m"])
def test_any_size_of_arrow_batches(spark, tmp_path, most):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdeé "), 7)) for _ in range(300)]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 300)))) for _ in range(200)] + [None, "", "same", "same"] + [None] * 500
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs, encoding, before = spark.read.parquet(str(tmp_path / "docs")), library(), spark.conf.get(LIMIT)
    try:
        spark.conf.set(LIMIT, most)
        got = {r["doc_id"]: tuple(r)[1:4] for r in bpe.encode(docs, RANKS, public_tokenizers.PATTERN, batch_bytes=30_000).collect()}
    finally:
        spark.conf.set(LIMIT, before)
    assert got == {i: expected(t, encoding) for i, t in enumerate(texts)}


def test_more_text_than_a_batch_of_arrow(spark, tmp_path):
    rng = np.random.default_rng(5)
    words = np.array([f"w{i} " for i in range(5000)])
    pool = ["".join(rng.choice(words, 1500)) for _ in range(50)]
    rows = [(i, pool[i % 50] + str(i)) for i in range(10_000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    got = bpe.encode(spark.read.parquet(str(tmp_path / "docs")), RANKS, public_tokenizers.PATTERN, with_ids=False).collect()
    encoding = library()
    assert len(got) == 10_000
    for r in got[::500]:
        assert tuple(r)[1:4] == expected(rows[r["doc_id"]][1], encoding)

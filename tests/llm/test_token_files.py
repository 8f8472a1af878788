"""Files of token ids against the tokenizers library and a plain packing of bits."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.conftest import SMALL
from zephyra.llm import tokenfiles
from zephyra.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string, number int, file string"


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]


def expected(rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = ids_of(text)
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "f") for i, t in rows], SCHEMA)


def by_place(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: r[1])


@settings(deadline=None, max_examples=200)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=200), st.integers(0, 200), st.integers(0, 200))
def test_packing(bits, numbers, a, b):
    ids = np.array([n % 2**bits for n in numbers], np.uint32)
    packed = tokenfiles.pack(ids, bits)
    assert int.from_bytes(packed, "little") == sum(int(n) << i * bits for i, n in enumerate(ids))
    assert len(packed) == -(-len(ids) * bits // 8)
    a, b = sorted((min(a, len(ids)), min(b, len(ids))))
    assert tokenfiles.unpack(packed, bits, a, b).tolist() == ids[a:b].tolist()


def test_ids_that_do_not_fit():
    with pytest.raises(ValueError):
        tokenfiles.pack(np.array([4], np.uint32), 2)


@pytest.mark.parametrize("tail", [b"", b"\n", b"\r\n"])
@pytest.mark.parametrize("bits", [15, 16, 17])
def test_random_access(bits, tail):
    rng = np.random.default_rng(bits)
    ids, sizes = rng.integers(0, 2**15, 1000).astype(np.uint32), np.array([0, 1, 499, 0, 500])
    file = tokenfiles.TokenFile(tokenfiles.file_bytes(ids, sizes, [5, None, 7, -8, 9], bits, 64) + tail)
    assert file.doc_ids.to_pylist() == [5, None, 7, -8, 9] and file.n_ids == 1000
    for a, b in ((0, 1000), (63, 65), (64, 128), (999, 1000), (10, 10), (900, 2000)):
        assert (file.ids(a, b) == ids[a:b]).all()
    assert (file.document(2) == ids[1:500]).all() and len(file.document(3)) == 0
    with pytest.raises(ValueError):
        tokenfiles.TokenFile(tokenfiles.file_bytes(ids, sizes, [5, None, 7, -8, 9], bits, 64)[:-40])


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet=st.one_of(st.sampled_from("aAzZ09.,;:!?'sStTrevm <|>\t\n\r\x0b\x0c\x1c\x85\xa0̱́̊éÉßİΣ日本️🙂≠"), st.characters(codec="utf-8")), max_size=60))
def test_parts_of_a_text_have_its_ids(text):
    encoder = tokenfiles.WordIds(LIBRARY, 1000)
    for t in (text, f"<|endoftext|>{text}", f"{text}<|ENDOFTEXT|>.", f"Ḵ{text}"):
        data = np.frombuffer(t.encode(), np.uint8)
        ids, sizes = encoder.texts(data, np.array([0, len(data)]), 2)
        assert ids.tolist() == ids_of(t) and sizes.tolist() == [len(ids)]


def test_words_that_are_forgotten():
    texts = [f"word{i % 7} other{i}." for i in range(50)]
    encoder = tokenfiles.WordIds(LIBRARY, 3)
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        assert encoder.texts(data, np.array([0, len(data)]), 2)[0].tolist() == ids_of(t)


def test_query_equals_the_library(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    assert by_place(QUERIES["op13_token_files"](spark, SMALL).collect()) == expected(docs)


def test_nulls_repeats_and_small_files(spark):
    rows = [(3, "c c"), (None, "no id"), (1, None), (2, ""), (2, ""), (5, "x " * 300), (4, "same"), (4, "same"), (None, None), (-7, "first?")]
    made = by_place(tokenfiles.token_files(frame(spark, rows).repartition(3), PATH, 2, block_ids=8, file_ids=20, task_bytes=200).collect())
    assert [r[0] for r in made] == [None, None, -7, 1, 2, 2, 3, 4, 4, 5]
    assert sorted(r[3] for r in made) == sorted(r[3] for r in expected(rows))
    assert [r[1] for r in made] == np.cumsum([0, *[r[2] for r in made]])[:-1].tolist()
    ordered = expected(sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]))
    shift = made[2][1]
    assert [(a, b - shift, c, d) for a, b, c, d in made[2:]] == ordered


def test_files_hold_the_ids(spark, tmp_path):
    rows = [(i, f"text number {i} " * (i % 5)) for i in range(200)]
    folder = str(tmp_path / "ids")
    tokenfiles.write(frame(spark, rows), PATH, folder, 2, block_ids=64, file_ids=500, task_bytes=4000)
    files = sorted(tmp_path.glob("ids/part-*"))
    assert len(files) > 3
    read = [TokenIds for f in files for TokenIds in _documents(f.read_bytes())]
    assert sorted(read) == sorted((i, ids_of(t)) for i, t in rows)
    again = tokenfiles.read(spark, folder, with_ids=True)
    assert sorted((r["doc_id"], r["ids"]) for r in again.collect()) == sorted((i, ids_of(t)) for i, t in rows)
    total = {r["file"]: r["start"] for r in tokenfiles.file_starts(again).collect()}
    assert sorted(total.values())[0] == 0 and len(total) == len(files)


def _documents(content):
    file = tokenfiles.TokenFile(content)
    return [(i, file.document(k).tolist()) for k, i in enumerate(file.doc_ids.to_pylist())]


def test_an_empty_table(spark):
    made = tokenfiles.token_files(frame(spark, []), PATH, 2)
    assert made.collect() == [] and made.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_parts():
    data = np.frombuffer("ab, c9.d  e".encode() + b"f", np.uint8)
    starts, ends, first = tokenfiles.parts(data, np.array([0, 11, 12]))
    assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == [b"ab", b",", b"c9", b".", b"d", b"e", b"f"]
    assert first.tolist() == [0, 6, 7]
    assert tokenfiles.parts(np.zeros(0, np.uint8), np.array([0, 0]))[2].tolist() == [0, 0]
    assert pa.__version__

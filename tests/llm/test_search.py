"""Ranked search against a plain count of terms."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from zephyra.llm import search
from zephyra.llm.texts import LOWER, pieces

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, n long, terms string"


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, items, k=10):
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, Counter(t), len(t)) for i, t in own if t]
    n_docs, total = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, names in wanted.items():
        scores = []
        for doc, count, n in own:
            m = 100 - 90 + 90 * n * n_docs // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * count[t] // (1000 * count[t] + 8 * m))
                for t in names if t in count
            )
            if score > 0:
                scores.append((-score, doc is None, doc))
        for rank, (score, _, doc) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1):
            out.append((item, rank, doc, -score))
    return sorted(out, key=str)


def found(spark, docs, items, **sizes):
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in docs], SCHEMA).repartition(3)
    items = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in search.search(docs, items, **sizes).collect()), key=str)


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    names = ["alpha", "Beta", "ab", "a", "É", "été", "x1", "日本", "b", "ba"]
    glue = [" ", "-", "\n", ", ", "\t\t", "_", "'", "\x7f"]
    texts = ["".join(names[rng.integers(10)] + glue[rng.integers(8)] for _ in range(rng.integers(1, 40))) for _ in range(n)]
    return texts


def test_small_corpora(spark):
    texts = corpus(1)
    docs = [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (102, " \n-"), (103, texts[0]), (103, texts[1]), (None, texts[2])]
    items = [(1, "alpha beta"), (2, "a A a b"), (3, None), (4, ""), (5, "日本 été unseen"), (6, "unseen"), (6, "É"), (None, "ab")]
    expected = plain(docs, items)
    assert found(spark, docs, items) == expected and len(expected) > 30
    assert found(spark, docs, items, segment=7, cells=3) == expected
    assert found(spark, docs, items, block_bytes=30) == expected


def test_ties_go_to_smaller_ids_and_few_rows(spark):
    docs = [(i, "one two" if i % 2 else "three") for i in range(40, 0, -1)] + [(None, "one two")]
    assert found(spark, docs, [(1, "one")]) == plain(docs, [(1, "one")])
    assert [r[2] for r in sorted(found(spark, docs, [(1, "one")]), key=lambda r: r[1])] == list(range(1, 20, 2))
    assert found(spark, [(1, "one"), (2, "two"), (3, "four")], [(9, "one")]) == plain([(1, "one"), (2, "two"), (3, "four")], [(9, "one")])


def test_empty_tables(spark):
    assert found(spark, [], [(1, "one")]) == []
    assert found(spark, [(1, "one")], []) == []
    assert found(spark, [(1, None)], [(1, None)]) == []


def test_long_text_and_long_words(spark):
    docs = [(1, "a " * 50_000 + "b" * 100_000 + " c"), (2, "a c"), (3, "b" * 100_000)]
    items = [(1, "a"), (2, "c"), (3, "b" * 100_000), (4, "b")]
    assert found(spark, docs, items, segment=1000) == plain(docs, items)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.text(alphabet="abAB1é -", max_size=25), max_size=6), st.lists(st.text(alphabet="ab1é", min_size=1, max_size=3), min_size=1, max_size=5), st.integers(1, 12))
def test_occurrences_are_whole_terms(texts, wanted, segment):
    names = sorted({t.encode() for t in wanted})
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    for piece in pieces(iter([batch])):
        data, behind, n = search.guarded(piece, max(map(len, names)))
        term, at = search.occurrences(search.automaton_of(names), data, segment)
        counted = Counter(zip(np.searchsorted(behind, at).tolist(), term.tolist(), strict=True))
        expected = Counter((i, names.index(t.encode())) for i, x in enumerate(texts) for t in terms(x) if t.encode() in names)
        assert counted == expected and n.tolist() == [len(terms(x)) for x in texts]
    assert LOWER[65] == 97

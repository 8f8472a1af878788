"""Scores of vectors with large components are exact."""

from __future__ import annotations

import numpy as np

from zephyra.llm.topk import Shard


def test_large_components_are_scored_exactly():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-50, 50, (300, 8))
    vectors[5, 2], vectors[6, 2], vectors[7] = 2**30 + 1, 2**30, 2**28 + 1
    vectors[8] = vectors[7]
    ids = rng.permutation(300)
    shard = Shard(ids, vectors)
    for q in (5, 6, 7, 8, 9):
        places, scores = shard.best(int(ids[q]), vectors[q], 10)
        whole = vectors.astype(object)
        want = sorted((-int(v @ whole[q]), int(i)) for v, i in zip(whole, ids, strict=True) if i != ids[q])[:10]
        assert [(-int(s), int(shard.ids[p])) for p, s in zip(places, scores, strict=True)] == want

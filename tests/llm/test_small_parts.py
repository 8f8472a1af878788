"""The parts that are plain functions, against brute force."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from zephyra.llm import archives, bpe, langid, partenum, repeats, tokencount
from zephyra.llm.fmindex import FMIndex
from zephyra.llm.lookup import Lookup
from zephyra.llm.pieces import Matcher, load
from zephyra.llm.suffixes import suffix_array
from zephyra.llm.topk import Shard

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(symbols):
    symbols = [*symbols, 0]
    assert suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(5)
    runs = [rng.integers(1, 6, rng.integers(1, 30)).tolist() for _ in range(60)] + [[1, 2, 3] * 9] * 4
    symbols = np.array([x for run in runs for x in [*run, 0]])
    index = FMIndex(symbols, 6)
    text = symbols.tolist()
    for length in (1, 2, 3, 7):
        patterns = rng.integers(1, 6, (80, length))
        low, high = index.search(patterns)
        for pattern, a, b in zip(patterns.tolist(), low, high, strict=True):
            found = sorted(index.locate(np.arange(a, b)).tolist())
            assert found == [i for i in range(len(text)) if text[i : i + length] == pattern]


def test_lookup():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    table = Lookup(keys, np.arange(5000))
    assert (table.find(keys) == np.arange(5000)).all()
    assert (table.find(keys + np.uint64(1)) == -1).all()
    assert (Lookup(keys[:0], np.arange(0)).find(keys) == -1).all()


def _words(count, letters, seed=3):
    rng = random.Random(seed)
    words = [(" " + "".join(rng.choice(letters) for _ in range(rng.randint(1, 10)))).encode()[:41] for _ in range(count)]
    sizes = np.array([len(w) for w in words])
    return words, np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes


def test_forward_sums_all_segmentations_and_backward_agrees():
    vocabulary, _ = load(PIECES)
    match = Matcher(vocabulary)
    theta = np.random.default_rng(2).dirichlet(np.ones(len(vocabulary)), 2).T
    words, data, starts, sizes = _words(200, "abcdethinoé漢")
    of = {v: theta[i] for i, v in enumerate(vocabulary)}

    def total(word):
        sums = [np.ones(2)] + [np.zeros(2) for _ in word]
        for i in range(1, len(word) + 1):
            for j in range(i):
                if word[j:i] in of:
                    sums[i] = sums[i] + sums[j] * of[word[j:i]]
        return sums[-1]

    scores = langid.word_scores(match, langid._scaled(theta, match), data, starts, sizes)
    assert np.allclose(np.exp(scores), [total(w) for w in words], rtol=1e-9)
    edges = match.edges(data, starts, sizes)
    weight = langid._scaled(theta, match)[edges[0]]
    alpha, beta = langid.forward(edges, sizes, weight), langid.backward(edges, sizes, weight)
    base = np.cumsum(sizes + 1) - (sizes + 1)
    assert np.allclose(alpha[base + sizes], beta[base])


def test_token_counts_are_those_of_the_best_segmentation():
    vocabulary, own = load(PIECES)
    cost = dict(zip(vocabulary, tokencount.costs(vocabulary, own).tolist(), strict=True))

    def best(word):
        least = [0]
        for i in range(1, len(word) + 1):
            least.append(min(least[j] + cost[word[j:i]] for j in range(i) if word[j:i] in cost))
        return least[-1] % 64

    words, data, starts, sizes = _words(500, "abcdethinoé漢")
    made = tokencount.token_counts(Matcher(vocabulary), tokencount.costs(vocabulary, own), data, starts, sizes)
    assert made.tolist() == [best(w) for w in words]


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(bpe.load_ranks(RANKS))


def test_merges_equal_the_library(merges):
    tokens = bpe.load_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeéß漢 \n1") for _ in range(rng.choice([1, 3, 9, 40, 90, 500]))) for _ in range(300)]
    words += ["a" * 3000, "ab" * 700]
    raw = [w.encode() for w in words]
    ids, count = merges.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    ends = np.cumsum(count)
    for word, a, b in zip(words, ends - count, ends, strict=True):
        assert ids[a:b].tolist() == library.encode_ordinary(word)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(4)
    for size in [1, 2, 5, 20, 60, 63, 64, 70, 80, 84, 90, 200, 255, 256, 300, 341, 1100, 1400]:
        for _ in range(30):
            a = rng.integers(0, 2**63, size).astype(np.uint64)
            keep = rng.integers(int(np.ceil(0.75 * size)), size + 1)
            extra = rng.integers(0, int(keep / 0.75) - size + 1) if keep / 0.75 >= size else 0
            b = np.unique(np.concatenate([a[:keep], rng.integers(0, 2**63, extra).astype(np.uint64)]))
            a = np.unique(a)
            common = len(np.intersect1d(a, b))
            if 100 * common < 75 * (len(a) + len(b) - common):
                continue
            # as if every signature that the set can spare were crowded: any of them may be missing
            sides = []
            for x in (a, b):
                sides.append([np.sort(made)[: len(made) - spare] for made, spare in partenum.signatures(x, 75)])
            assert any(np.intersect1d(x, y).size for x in sides[0] for y in sides[1]), (size, len(a), len(b), common)
            assert partenum.apart(partenum.sketch(a), partenum.sketch(b)) <= len(a) + len(b) - 2 * common


def test_owners_of_windows():
    rng = np.random.default_rng(8)
    reach, width, length = repeats.REACH, repeats._WIDTH, repeats.LENGTH
    rows, group, least = [], [], []
    for g in range(60):
        middle = rng.integers(0, 256, width)
        for _ in range(rng.integers(1, 9)):
            row = middle.copy()
            for side in (slice(0, rng.integers(0, reach + 1)), slice(width - rng.integers(0, reach + 1), width)):
                row[side] = rng.choice([row[side], rng.integers(0, 2, len(row[side]))])
            if rng.random() < 0.2:
                row[: rng.integers(0, reach)] = repeats._PAD
            if rng.random() < 0.2:
                row[width - rng.integers(1, reach) :] = repeats._PAD
            if not any((row == r).all() and g == h for r, h in zip(rows, group, strict=True)):
                rows.append(row)
                group.append(g)
                least.append(int(rng.integers(0, 1000)))
    matrix, group, least = np.array(rows, np.int16), np.array(group), np.array(least)
    made = repeats.window_owners(matrix, group, least)
    for r in range(len(rows)):
        for o in range(reach + 1):
            window = matrix[r, o : o + length]
            if (window == repeats._PAD).any():
                continue
            same = [s for s in range(len(rows)) if group[s] == group[r] and (matrix[s, o : o + length] == window).all()]
            assert made[r, o] == least[same].min()


def test_threshold_search_equals_brute_force():
    rng = np.random.default_rng(6)
    vectors = rng.integers(-50, 50, (700, 6))
    vectors[::7] = vectors[0]  # ties
    ids = rng.permutation(700)
    shard = Shard(ids, vectors)
    for query in (vectors[3], vectors[0], np.zeros(6, int), np.array([5, 0, 0, 0, 0, -1])):
        places, scores = shard.best(int(ids[3]), query, 10)
        every = sorted((-int(v @ query), int(i)) for v, i in zip(vectors, ids, strict=True) if i != ids[3])[:10]
        assert [(-int(s), int(shard.ids[p])) for p, s in zip(places, scores, strict=True)] == every


def test_arc_versions_and_bad_lengths():
    one = b"filedesc://x 0.0.0.0 20200101000000 text/plain 70\n" + (b"1 0 x\n" + archives.FIELDS[1].encode() + b"\n").ljust(70, b" ")
    record = b"http://a/ 0.0.0.0 20200101000000 text/html 5\nhello"
    found = list(archives.parse_arc(one + b"\n" + record + b"\n"))
    assert [(f["URL"], c) for _, f, c in found] == [("http://a/", b"hello")]
    block = b"2 0 x\n" + archives.FIELDS[2].encode() + b"\n"
    two = b"filedesc://x 0.0.0.0 20200101000000 text/plain 200 - - 0 x %d\n" % len(block) + block
    record = b"http://a/ 0.0.0.0 20200101000000 text/html 200 - - 9 x 5\nhe\n\nl"
    assert [c for _, _, c in archives.parse_arc(two + b"\n" + record + b"\n")] == [b"he\n\nl"]
    assert list(archives.parse_arc(b"")) == []
    for bad in (one + b"\nhttp://a/ 0.0.0.0 1 text/html 50\nshort", one + b"\nhttp://a/ 5\nhello", b"x 1 2 3 4\nabcd"):
        with pytest.raises(archives.BadArchive):
            list(archives.parse_arc(bad))

"""Words of any length are one word: token counts and language sums against brute force, over several blocks."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers

from zephyra.llm import langid, tokencount
from zephyra.llm.pieces import Matcher, load, spaced_words

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _long_words():
    rng = random.Random(4)
    sizes = [39, 40, 41, 42, 63, 64, 65, 120, 300, 700, 1500]
    words = [(" " + "".join(rng.choice(letters) for _ in range(n))).encode() for n in sizes for letters in ("0123456789abcdef", "漢字の東京é", "ethano", "x")]
    lengths = np.array([len(w) for w in words])
    return words, np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths, lengths


def test_a_run_without_white_space_is_one_word():
    text = "ab " + "x" * 41 + " " + "漢" * 50 + " " + "0f" * 5000
    data = np.frombuffer(text.encode(), np.uint8)
    spaced, starts, lengths, first = spaced_words(data, np.array([0, len(data)]))
    assert first.tolist() == [0, 4] and lengths.tolist() == [3, 42, 151, 10_001]
    assert spaced.tobytes() == b" " + text.encode()


def test_tokens_of_long_words():
    vocabulary, own = load(PIECES)
    costs, longest = tokencount.costs(vocabulary, own), max(map(len, vocabulary))
    cost = dict(zip(vocabulary, (costs // 64).tolist(), strict=True))
    words, data, starts, lengths = _long_words()
    want = []
    for word in words:
        least = [(0, 0)]
        for i in range(1, len(word) + 1):
            before = range(max(0, i - longest), i)
            least.append(min((least[j][0] + cost[word[j:i]], least[j][1] + 1) for j in before if word[j:i] in cost))
        want.append(least[-1][1])
    match = Matcher(vocabulary)
    assert max(want) > 64
    for few in (1, 16, 10**6):
        assert tokencount.token_counts(match, costs, data, starts, lengths, few=few).tolist() == want
    for word, n in zip(words, want, strict=True):
        assert tokencount.single_count(match, costs, np.frombuffer(word, np.uint8), block=50) == n


def test_language_sums_of_long_words():
    vocabulary, _ = load(PIECES)
    match, longest = Matcher(vocabulary), max(map(len, vocabulary))
    theta = np.random.default_rng(2).dirichlet(np.ones(len(vocabulary)), 2).T
    logs = np.log(theta)
    of = {v: i for i, v in enumerate(vocabulary)}
    words, data, starts, lengths = _long_words()
    lang = np.arange(len(words)) % 2
    want, uses = [], np.zeros(theta.shape)
    for word, which in zip(words, lang, strict=True):
        edges = [(j, i, of[word[j:i]]) for i in range(1, len(word) + 1) for j in range(max(0, i - longest), i) if word[j:i] in of]
        alpha, beta = np.full((len(word) + 1, 2), -np.inf), np.full((len(word) + 1, 2), -np.inf)
        alpha[0] = beta[-1] = 0
        for j, i, p in edges:
            alpha[i] = np.logaddexp(alpha[i], alpha[j] + logs[p])
        for j, i, p in sorted(edges, reverse=True):
            beta[j] = np.logaddexp(beta[j], beta[i] + logs[p])
        for j, i, p in edges:
            uses[p, which] += np.exp(alpha[j] + logs[p] + beta[i] - alpha[-1])[which]
        want.append(alpha[-1])
    assert np.allclose(langid.word_scores(match, langid._scaled(theta, match), data, starts, lengths), want)
    assert np.isfinite(want).all()
    for block in (50, 256):
        assert np.allclose(langid.long_scores(match, logs, data, starts, lengths, block=block), want)
        made = np.zeros(theta.shape)
        for piece, word, expected in langid.long_uses(match, logs, data, starts, lengths, lang, block=block):
            np.add.at(made, (piece, lang[word]), expected)
        assert np.allclose(made, uses)

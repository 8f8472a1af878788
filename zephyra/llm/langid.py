"""Language of a text by unigrams over sub-word pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum, over all
ways to cut it into pieces, of the product of their probabilities; a forward pass gives it. The words of a text are
independent. Piece probabilities are fitted by expectation maximisation: the backward pass gives the expected number of uses
of each piece, from a table of distinct words with their counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyra.llm.pieces import Known, Matcher, distinct, load, spaced_words
from zephyra.llm.texts import carried, pieces as text_pieces, ranges, views
from zephyra.plans.tables import write_out

#: At most so many labelled documents of each language are used to fit the model, those of smallest hash of their id.
DOCUMENTS_PER_LANGUAGE = 4000
ROUNDS = 3
SMOOTHING = 0.1
#: Text looked at together; all matches of pieces in its distinct words are in memory.
PIECE = 1 << 20
#: Probabilities are multiplied by this for every byte, so that products of up to ``SHORT`` bytes stay in range. Longer words
#: are summed in logarithms, so many words and so many positions of each at a time.
_SCALE, SHORT = 1000.0, 41
LONG_WORDS, BLOCK = 1024, 256

#: What a text must hold to have a language.
LETTER = r"\p{L}"

_matchers: dict[str, Matcher] = {}


def matcher(path: str, vocabulary: list[bytes]) -> Matcher:
    """One table per worker and vocabulary."""
    if path not in _matchers:
        _matchers[path] = Matcher(vocabulary)
    return _matchers[path]


def forward(edges: tuple, lengths: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Sum over all segmentations up to every position of every word. ``theta`` has a row per edge."""
    _, first, end = edges
    base = np.cumsum(lengths + 1) - (lengths + 1)
    alpha = np.zeros((int((lengths + 1).sum()), theta.shape[1]))
    alpha[base] = 1.0
    depth = end - np.repeat(base, lengths + 1)[end]
    order = np.lexsort((end, depth))
    _relax(alpha, first[order], end[order], depth[order], theta[order])
    return alpha


def backward(edges: tuple, lengths: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Sum over all segmentations from every position to the end of its word."""
    _, first, end = edges
    last = np.cumsum(lengths + 1) - 1
    beta = np.zeros((int((lengths + 1).sum()), theta.shape[1]))
    beta[last] = 1.0
    depth = np.repeat(last, lengths + 1)[first] - first
    order = np.lexsort((first, depth))
    _relax(beta, end[order], first[order], depth[order], theta[order])
    return beta


def _relax(value: np.ndarray, source: np.ndarray, target: np.ndarray, depth: np.ndarray, theta: np.ndarray) -> None:
    """value[target] = sum of value[source] * theta, for edges sorted by depth and target, one depth after another."""
    cuts = np.searchsorted(depth, np.arange(1, int(depth.max(initial=0)) + 2))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        to = target[a:b]
        head = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        value[to[head]] = np.add.reduceat(value[source[a:b]] * theta[a:b], head, axis=0)


def by_blocks(
    match: Matcher, weigh, columns: int, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, flip: bool = False, block: int = BLOCK
) -> Iterator[tuple]:
    """Logarithms of the sums of ``forward`` (``backward`` with ``flip``) for words of any length, a block of positions at a
    time; only those from which a piece can reach on are kept for the next. ``weigh(pieces, words)`` gives the logarithms of
    probabilities, with ``columns`` columns.

    Yields for each block the words it has, the number of the first position of their stretch, the base of each stretch, its
    length, the piece, source, target and word (among those of the block) of each match that ends in it, the weights, and the
    values of all positions. Positions are counted from the end with ``flip``.
    """
    longest = int(match.lengths.max())
    block = max(block, longest)
    window = np.full((len(starts), longest + 1, columns), -np.inf)
    window[:, -1] = 0.0
    low, live = 0, np.arange(len(starts))
    while len(live):
        back = min(low, longest)
        size = np.minimum(lengths[live] - low, block)
        part = size + back
        at = starts[live] + (lengths[live] - low - size if flip else low - back)
        base = np.cumsum(part + 1) - (part + 1)
        word = np.repeat(np.arange(len(live)), part + 1)
        piece, source, target = match.edges(data[ranges(at, part)], np.cumsum(part) - part, part)
        if flip:
            mirror = (2 * base + part)[word[source]]
            source, target = mirror - target, mirror - source
        depth = target - base[word[target]] - back
        order = np.lexsort((target, depth))
        order = order[depth[order] > 0]
        piece, source, target, depth = piece[order], source[order], target[order], depth[order]
        value = np.full((len(word), columns), -np.inf)
        value[ranges(base, np.full(len(live), back + 1))] = window[:, longest - back :].reshape(-1, columns)
        weight = weigh(piece, live[word[target]])
        _relax_logs(value, source, target, depth, weight)
        yield live, low - back, base, part, (piece, source, target, word[target]), weight, value
        low += block
        more = lengths[live] > low
        window = value[(base + part)[more][:, None] + np.arange(-longest, 1)]
        live = live[more]


def _relax_logs(value: np.ndarray, source: np.ndarray, target: np.ndarray, depth: np.ndarray, weight: np.ndarray) -> None:
    """``_relax`` for logarithms."""
    cuts = np.searchsorted(depth, np.arange(1, int(depth.max(initial=0)) + 2))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        to = target[a:b]
        new = np.concatenate([[True], to[1:] != to[:-1]])
        head = np.flatnonzero(new)
        each = value[source[a:b]] + weight[a:b]
        most = np.maximum.reduceat(each, head, axis=0)
        each = np.exp(each - most[np.cumsum(new) - 1])
        value[to[head]] = most + np.log(np.add.reduceat(each, head, axis=0))


def long_scores(match: Matcher, logs: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """``word_scores`` for words of any length. ``logs``: pieces x languages."""
    out = np.zeros((len(starts), logs.shape[1]))
    for i in range(0, len(starts), LONG_WORDS):
        some = slice(i, i + LONG_WORDS)
        made = by_blocks(match, lambda piece, _: logs[piece], logs.shape[1], data, starts[some], lengths[some], block=block)
        for live, _, base, part, _, _, value in made:
            out[i + live] = value[base + part]
    return out


def long_uses(
    match: Matcher, logs: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lang: np.ndarray, block: int = BLOCK
) -> Iterator[tuple]:
    """Piece, word and expected number of uses of the matches in words of any length, each in its language."""
    for i in range(0, len(starts), LONG_WORDS):
        some = slice(i, i + LONG_WORDS)
        at, size, own = starts[some], lengths[some], lang[some]
        zero = np.cumsum(size + 1) - (size + 1)
        alpha = np.zeros(int((size + 1).sum()))

        def weigh(piece, word):
            return logs[piece, own[word]][:, None]  # noqa: B023

        for live, low, base, part, _, _, value in by_blocks(match, weigh, 1, data, at, size, block=block):
            alpha[ranges(zero[live] + low, part + 1)] = value[:, 0]
        whole = alpha[zero + size]
        for live, low, base, _, (piece, source, target, word), weight, value in by_blocks(match, weigh, 1, data, at, size, True, block):
            first = (zero + size)[live][word] - (low + target - base[word])
            yield piece, i + live[word], np.exp(alpha[first] + weight[:, 0] + value[source, 0] - whole[live[word]])


def word_scores(match: Matcher, theta: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Logarithm of the probability of each word in each language. ``theta``: pieces x languages, scaled."""
    out, long = np.zeros((len(starts), theta.shape[1])), lengths > SHORT
    if long.any():
        out[long] = long_scores(match, np.log(theta), data, starts[long], lengths[long])
    starts, sizes = starts[~long], lengths[~long]
    edges = match.edges(data, starts, sizes)
    alpha = forward(edges, sizes, theta[edges[0]])
    out[~long] = np.log(alpha[np.cumsum(sizes + 1) - 1])
    return out - lengths[:, None] * np.log(_SCALE)


def _scaled(theta: np.ndarray, match: Matcher) -> np.ndarray:
    return theta * (_SCALE ** match.lengths)[:, None]


class Model:
    """``languages`` and, for each, a probability of every piece (``theta``: pieces x languages)."""

    def __init__(self, path: str, vocabulary: list[bytes], languages: list[str], theta: np.ndarray):
        self.path, self.vocabulary, self.languages, self.theta = path, vocabulary, languages, theta

    def posteriors(self, data: np.ndarray, bounds: np.ndarray, known: Known) -> np.ndarray:
        """Texts x languages. ``known`` keeps scores of words between calls."""
        match = matcher(self.path, self.vocabulary)
        spaced, starts, lengths, first = spaced_words(data, bounds)
        total = np.zeros((len(bounds) - 1, len(self.languages)))
        if len(starts):
            hashes, place, inverse, _ = distinct(spaced, starts, lengths)
            theta = _scaled(self.theta, match)

            def work(new: np.ndarray) -> np.ndarray:
                return word_scores(match, theta, spaced, starts[place[new]], lengths[place[new]])

            scores = known.of(hashes, work)
            full = np.flatnonzero(first[1:] > first[:-1])
            total[full] = np.add.reduceat(scores[inverse], first[:-1][full], axis=0)
        total = np.exp(total - total.max(axis=1, keepdims=True))
        return total / total.sum(axis=1, keepdims=True)


def _remainder(divisor: int) -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, n`` over the texts of ``docs(lang, text)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_pieces(batches, limit=PIECE):
            langs = piece.column("lang")
            for lang in np.unique(langs):
                rows = np.flatnonzero(langs == lang)
                sizes = np.diff(piece.bounds)[rows]
                data = piece.data[ranges(piece.bounds[rows], sizes)]
                spaced, starts, lengths, _ = spaced_words(data, np.concatenate([[0], np.cumsum(sizes)]))
                if not len(starts):
                    continue
                _, place, _, n = distinct(spaced, starts, lengths)
                text = spaced.tobytes()
                found = [text[s : s + k] for s, k in zip(starts[place].tolist(), lengths[place].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found)), pa.array(found, pa.binary()), pa.array(n)], names=["lang", "word", "n"]
                )

    made = docs.mapInArrow(count, "lang string, word binary, n long")
    return made.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def expected_uses(counts: DataFrame, model: Broadcast) -> DataFrame:
    """``lang, piece, uses``: expected uses of every piece in ``counts(lang, word, n)`` under the model."""

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Model = model.value
        match, index = matcher(now.path, now.vocabulary), {x: i for i, x in enumerate(now.languages)}
        theta = _scaled(now.theta, match)
        uses = np.zeros(now.theta.shape)
        for batch in batches:
            if not batch.num_rows:
                continue
            data, bounds = views(batch.column("word"))
            n = batch.column("n").to_numpy()
            lang = np.array([index[x] for x in batch.column("lang").to_pylist()])
            starts, lengths = bounds[:-1], np.diff(bounds)
            long = lengths > SHORT
            if long.any():
                for piece, word, expected in long_uses(match, np.log(theta), data, starts[long], lengths[long], lang[long]):
                    np.add.at(uses, (piece, lang[long][word]), expected * n[long][word])
            starts, lengths, lang, n = starts[~long], lengths[~long], lang[~long], n[~long]
            edges = match.edges(data, starts, lengths)
            word = np.repeat(np.arange(len(lengths)), lengths + 1)[edges[2]]
            weight = theta[edges[0], lang[word]][:, None]
            alpha, beta = forward(edges, lengths, weight)[:, 0], backward(edges, lengths, weight)[:, 0]
            whole = alpha[np.cumsum(lengths + 1) - 1][word]
            np.add.at(uses, (edges[0], lang[word]), alpha[edges[1]] * weight[:, 0] * beta[edges[2]] / whole * n[word])
        piece, lang = np.nonzero(uses)
        names = np.array(now.languages, dtype=object)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[lang], pa.string()), pa.array(piece), pa.array(uses[piece, lang])], names=["lang", "piece", "uses"]
        )

    made = counts.mapInArrow(expect, "lang string, piece long, uses double")
    return made.groupBy("lang", "piece").agg(F.sum("uses").alias("uses"))


def fit(docs: DataFrame, path: str, documents_per_language: int = DOCUMENTS_PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """Fit on ``docs(doc_id, text, lang)``; rows without language or text are left out.

    The sample is bounded by ``documents_per_language``. The driver sees one row per piece and language.
    """
    vocabulary, _ = load(path)
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id")
    chosen = labelled.select("doc_id", "lang").distinct().withColumn("_at", F.row_number().over(order))
    chosen = chosen.where(F.col("_at") <= documents_per_language).drop("_at")
    # at most documents_per_language rows for each language
    sample = labelled.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    counts = write_out(word_counts(sample.select("lang", "text")))
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    theta = np.full((len(vocabulary), len(languages)), 1 / len(vocabulary))
    for _ in range(rounds if languages else 0):
        model = docs.sparkSession.sparkContext.broadcast(Model(path, vocabulary, languages, theta))
        uses = np.zeros(theta.shape)
        for row in expected_uses(counts, model).collect():
            uses[row["piece"], languages.index(row["lang"])] = row["uses"]
        uses += SMOOTHING
        theta = uses / uses.sum(axis=0)
        model.unpersist()
    return Model(path, vocabulary, languages, theta)


def predict(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row of ``docs(doc_id, text)``, from the text alone.

    ``score`` is the probability of the language among the learned ones, all equally likely beforehand. A text that is null or
    has no letter is ``und`` with score 0, and so is every text if no language was learned. Of languages with equal
    probability the first by name is taken. Repeated rows stay. Other columns are dropped; with ``carry`` those named are
    returned instead of the id, as ``row``, so that no name of theirs can clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Model = shared.value
        names, known = np.array([*now.languages, "und"], dtype=object), Known(len(now.languages))
        for piece in text_pieces(batches, limit=PIECE):
            lettered = piece.rows.column("_lettered").to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.full(len(piece), len(names) - 1), np.zeros(len(piece))
            if now.languages:
                chance = now.posteriors(piece.data, piece.bounds, known)
                best = np.where(lettered, chance.argmax(axis=1), best)
                score = np.where(lettered, np.clip(chance.max(axis=1), 0, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [piece.rows.column(0), pa.array(names[best], pa.string()), pa.array(score)],
                names=[piece.rows.schema.names[0], "lang_pred", "score"],
            )

    lettered = F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("_lettered")
    first = carried(carry) if carry else F.col("doc_id")
    given = docs.select(first, "text", lettered)
    schema = T.StructType([given.schema[0], *[T.StructField(*f) for f in (("lang_pred", T.StringType()), ("score", T.DoubleType()))]])
    return given.mapInArrow(label, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Documents whose ``crc32(doc_id) % 3`` is not 1. A null id counts as the empty text."""
    return docs.where(_remainder(3) != 1)


def identify(docs: DataFrame, path: str) -> DataFrame:
    """Learn from ``training_rows`` and predict all documents: ``doc_id, held_out, lang_pred, score``."""
    model = fit(training_rows(docs), path)
    return predict(docs, model).select("doc_id", (_remainder(3) == 1).alias("held_out"), "lang_pred", "score")

"""Benchmark passages in documents, by an FM-index per shard of the documents.

A task gathers documents into a shard, turns their words into symbols (the distinct words of the benchmark; all others are
breaks between runs), indexes the runs, and searches all phrases of the benchmark backwards at once. Found occurrences are
located by sampled suffix positions and merged into spans. Only stretches whose neighbouring words are neighbours in the
benchmark too can hold a phrase; the others are left out of the index, so it is small beside the shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyra.llm.fmindex import FMIndex
from zephyra.llm.texts import LOWER, Piece, carried, pieces, prefix_sums, ranges, span_hashes, words

WINDOW = 13
#: A block of phrases holds at most so many words (or one item). Blocks are searched one after another.
BLOCK_WORDS = 500_000
#: Words of documents in a shard, about.
SHARD_WORDS = 4_000_000

#: The bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: digits, a to z, and everything beyond ASCII.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and the first word of each text."""
    data = LOWER[data]
    starts, ends, first = words(data, bounds, WORD)
    return span_hashes(prefix_sums(data), starts, ends), starts, ends, first


class Phrases:
    """The windows of a block of items.

    ``vocabulary``: sorted hashes of their words; symbol s + 1 is entry s. ``windows``: by length, a matrix of symbols, and
    for each of its rows the items that have it (``items[item_from[r]:item_from[r + 1]]``).
    """

    def __init__(self, items: list[str], texts: list[bytes], window: int):
        data = np.frombuffer(b"".join(texts), np.uint8)
        hashes, _, _, first = word_hashes(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
        self.vocabulary, symbols = np.unique(hashes, return_inverse=True)
        symbols = symbols.astype(np.int64) + 1
        self.size = len(self.vocabulary) + 1
        self.names = items
        self.seen = np.zeros(1 << 16, bool)
        self.seen[self.vocabulary & np.uint64(0xFFFF)] = True
        counts = np.diff(first)
        pairs = [np.zeros(0, np.int64)]
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in np.unique(np.minimum(counts[counts > 0], window)).tolist():
            rows = np.flatnonzero(np.minimum(counts, window) == length)
            count = np.maximum(counts[rows] - length + 1, 1)
            at = ranges(first[rows], count)
            matrix = symbols[at[:, None] + np.arange(length)]
            owner = np.repeat(rows, count)
            unique, inverse = np.unique(matrix, axis=0, return_inverse=True)
            both = np.unique(np.stack([inverse.ravel(), owner], axis=1), axis=0)
            self.windows[length] = unique, both[:, 1], np.searchsorted(both[:, 0], np.arange(len(unique) + 1))
            if length > 1:
                pairs.append((unique[:, :-1] * self.size + unique[:, 1:]).ravel())
        self.pairs = np.unique(np.concatenate(pairs))
        self.single = 1 in self.windows

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbol of each word, 0 for a word that the block does not have."""
        out = np.zeros(len(hashes), np.int64)
        at = np.flatnonzero(self.seen[hashes & np.uint64(0xFFFF)])
        place = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), max(len(self.vocabulary) - 1, 0))
        if len(at):
            out[at] = np.where(self.vocabulary[place] == hashes[at], place + 1, 0)
        return out

    def runs(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that can belong to an occurrence, and whether the word after each follows it in a window."""
        symbol = self.symbols(hashes)
        joined = np.zeros(len(symbol) + 1, bool)
        both = np.flatnonzero((symbol[:-1] > 0) & (symbol[1:] > 0))
        inside = np.ones(len(symbol) + 1, bool)
        inside[first] = False
        both = both[inside[both + 1]]
        if len(both) and len(self.pairs):
            key = symbol[both] * self.size + symbol[both + 1]
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined[both[self.pairs[place] == key]] = True
        keep = joined[:-1] | np.concatenate([[False], joined[:-1]])[: len(symbol)]
        if self.single:
            keep |= symbol > 0
        at = np.flatnonzero(keep)
        # a run shorter than the shortest window holds none
        run = np.cumsum(np.concatenate([[0], ~joined[at[:-1]]])) if len(at) else at
        long = np.bincount(run, minlength=1)[run] >= min(self.windows, default=1) if len(at) else at.astype(bool)
        return at[long], joined[at[long]]


def phrase_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[Broadcast]:
    """The items of ``benchmark(item_id, text)`` in broadcast blocks of bounded size, whatever their number."""
    context, blocks, items, texts, size = benchmark.sparkSession.sparkContext, [], [], [], 0
    chosen = benchmark.selectExpr("cast(item_id as string) AS item_id", "text").where("text is not null").distinct()
    for row in chosen.toLocalIterator():
        text = row["text"].encode()
        count = len(text) // 2 + 1  # at least the number of its words
        if items and size + count > block_words:
            blocks.append(context.broadcast(Phrases(items, texts, window)))
            items, texts, size = [], [], 0
        items.append(row["item_id"] or "")
        texts.append(text)
        size += count
    if items:
        blocks.append(context.broadcast(Phrases(items, texts, window)))
    return blocks


class _Shard:
    """Documents of one index: their rows, and for each the words with their places."""

    def __init__(self):
        self.parts: list[tuple[Piece, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.words = 0

    def add(self, piece: Piece) -> None:
        hashes, starts, ends, first = word_hashes(piece.data, piece.bounds)
        self.parts.append((piece, hashes, starts - piece.bounds[:-1].repeat(np.diff(first)), ends - starts, first))
        self.words += len(hashes)

    def search(self, blocks: list[Broadcast]) -> pa.RecordBatch:
        hashes = np.concatenate([p[1] for p in self.parts])
        counts = np.concatenate([np.diff(p[4]) for p in self.parts])
        first = np.concatenate([[0], np.cumsum(counts)])
        hit = np.zeros(len(hashes) + 1, np.int32)
        items: dict[int, set[str]] = {}
        for block in blocks:
            self._find(block.value, hashes, first, hit, items)
        inside = np.cumsum(hit[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(inside)])
        n_hit = total[first[1:]] - total[first[:-1]]
        names = [sorted(items.get(i, ())) for i in range(len(counts))]
        starts, ends = self._spans(inside, first)
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([p[0].rows.column(0) for p in self.parts]),
                pa.array(counts),
                pa.array(n_hit),
                pa.array([len(x) for x in names], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]),
                pa.array((n_hit > 0) & (20 * n_hit >= counts)),
                starts,
                ends,
            ],
            names=[self.parts[0][0].rows.schema.names[0], "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "span_starts", "span_ends"],
        )

    def _find(self, phrases: Phrases, hashes: np.ndarray, first: np.ndarray, hit: np.ndarray, items: dict) -> None:
        at, joined = phrases.runs(hashes, first)
        if not len(at):
            return
        width = 1 + ~joined  # a run is followed by a break
        place = np.cumsum(width) - width
        symbols = np.zeros(int(width.sum()), np.int64)
        symbols[place] = phrases.symbols(hashes[at])
        word = np.zeros(len(symbols), np.int64)
        word[place] = at
        index = FMIndex(symbols, phrases.size)
        for length, (windows, owners, owner_from) in phrases.windows.items():
            low, high = index.search(windows)
            found = np.flatnonzero(high > low)
            count = (high - low)[found]
            if not len(found):
                continue
            begin = word[index.locate(ranges(low[found], count))]
            np.add.at(hit, begin, 1)
            np.add.at(hit, begin + length, -1)
            pairs = np.stack([np.searchsorted(first, begin, side="right") - 1, np.repeat(found, count)], axis=1)
            for doc, window in np.unique(pairs, axis=0).tolist():
                names = owners[owner_from[window] : owner_from[window + 1]]
                items.setdefault(doc, set()).update(phrases.names[i] for i in names)

    def _spans(self, inside: np.ndarray, first: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Merged stretches of hit words of each document, as bytes of its text."""
        start_of, size_of = np.concatenate([p[2] for p in self.parts]), np.concatenate([p[3] for p in self.parts])
        padded = np.concatenate([[False], inside, [False]])
        edge = np.zeros(len(inside) + 1, bool)
        edge[first] = True
        begins = np.flatnonzero(padded[1:-1] & (~padded[:-2] | edge[:-1]))
        ends = np.flatnonzero(padded[1:-1] & (~padded[2:] | edge[1:]))
        bounds = pa.array(np.searchsorted(begins, first), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (start_of[begins], start_of[ends] + size_of[ends])]
        return lists[0], lists[1]


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS, carry: list[str] | None = None,
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, span_starts, span_ends`` for each row of ``docs``.

    The spans are the merged stretches of hit words, as byte offsets into the text. A null or empty text has no words and is
    clean; so is every document if the benchmark is empty. Items with a null text are skipped, a null id is the empty
    string, repeated items count once, several texts under one id count as one item. Other columns are dropped; with ``carry``
    those named are returned instead of the id, as ``row``, so that no name of theirs can clash.
    """
    blocks = phrase_blocks(benchmark, window, block_words)
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for piece in pieces(batches):
            shard.add(piece)
            if shard.words >= shard_words:
                yield shard.search(blocks)
                shard = _Shard()
        if shard.parts:
            yield shard.search(blocks)

    given = docs.select(carried(carry) if carry else F.col("doc_id"), "text")
    kinds = {
        "n_words": T.LongType(), "n_hit": T.LongType(), "n_items": T.LongType(), "items_sha256": T.StringType(),
        "contaminated": T.BooleanType(), "span_starts": T.ArrayType(T.LongType()), "span_ends": T.ArrayType(T.LongType()),
    }
    return given.mapInArrow(search, T.StructType([given.schema[0], *[T.StructField(*f) for f in kinds.items()]]))

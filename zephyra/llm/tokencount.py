"""Numbers of tokens under a unigram tokenizer, by dynamic programming over a trie of the distinct pre-tokens.

A pre-token is a word with a space before it. Its tokens are the pieces of its best segmentation: the one of least cost, where a
piece of rank r among N costs -log of its Zipf probability 1 / ((r + 1) H_N), a single byte that is no piece costs more than any
piece, and of equal costs the fewest pieces win. The least cost up to a place depends on the prefix only. So the distinct
pre-tokens of a stretch of text are put into a trie, level by level, and each node is worked out once, for all words that
share it; a word's count stands at the node where it ends. Where only a few words are left in the trie, nothing is shared and a
level costs more than its words: each of these is worked out by itself, a block of its bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from zephyra.llm.pieces import Known, Matcher, distinct, load, spaced_words
from zephyra.llm.texts import pieces as text_pieces
from zephyra.llm.texts import prefix_sums, span_hashes

PIECE = 1 << 20
#: Costs are whole numbers: so many parts of a natural logarithm, times ``_COUNT``, plus one for the piece itself.
_PARTS, _COUNT = 1 << 16, 64
_FAR = np.int64(1) << 62
#: The trie ends at this depth, or where fewer than so many words are left.
DEPTH, FEW = 4096, 16
#: Inside the trie a sum of costs is moved left by so many bits, to make room for up to ``DEPTH`` pieces; a word by itself
#: may have more pieces and a greater sum than fit into 64 bits, and is summed in Python's numbers.
_BITS, _WIDE = 20, 40
#: Bytes of a word by itself whose matches are in memory together.
BLOCK = 1 << 16


def costs(vocabulary: list[bytes], pieces: int) -> np.ndarray:
    """Cost of each entry; those from ``pieces`` on are bytes that are no piece of their own."""
    rank = np.minimum(np.arange(len(vocabulary)), pieces - 1)
    harmonic = (1 / np.arange(1, pieces + 1)).sum()
    made = np.log(rank + 1.0) + np.log(harmonic) + np.where(np.arange(len(vocabulary)) >= pieces, 10.0, 0.0)
    return np.round(made * _PARTS).astype(np.int64) * _COUNT + 1


def token_counts(
    match: Matcher, cost: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, few: int = FEW
) -> np.ndarray:
    """Number of tokens of each word ``data[start:start + length]``, by one trie over all of them."""
    sums = prefix_sums(data)
    longest = int(match.lengths.max())
    step = cost // _COUNT << _BITS | 1
    out = np.zeros(len(starts), np.int64)
    live, node = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    best, parent = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]  # by level; the root costs nothing
    for depth in range(1, int(lengths.max(initial=0)) + 1):
        keep = lengths[live] >= depth
        live, node = live[keep], node[keep]
        if depth > DEPTH or len(live) < few:
            for i in live.tolist():
                out[i] = single_count(match, cost, data[starts[i] : starts[i] + lengths[i]])
            break
        # a node for each pair of parent and byte; the first word that has it shows its bytes
        _, first, inverse = np.unique(node << 8 | data[starts[live] + depth - 1], return_index=True, return_inverse=True)
        parent.append(node[first])
        end = starts[live[first]] + depth
        least, above = np.full(len(first), _FAR), np.arange(len(first))
        for n in range(1, min(depth, longest) + 1):
            above = parent[depth - n + 1][above]
            piece = match.find(span_hashes(sums, end - n, end))
            there = np.flatnonzero(piece >= 0)
            least[there] = np.minimum(least[there], best[depth - n][above[there]] + step[piece[there]])
        best.append(least)
        node = inverse
        ended = lengths[live] == depth
        out[live[ended]] = least[node[ended]] & ((1 << _BITS) - 1)
    return out


def single_count(match: Matcher, cost: np.ndarray, data: np.ndarray, block: int = BLOCK) -> int:
    """Number of tokens of the word ``data``. Only the last positions, from which a piece can reach on, go on to the next block."""
    longest, whole = int(match.lengths.max()), cost // _COUNT
    best = [0]  # up to each position of the stretch that is looked at
    for low in range(0, len(data), block):
        back = min(low, longest)
        stretch = data[low - back : low + block]
        piece, first, end = match.edges(stretch, np.zeros(1, np.int64), np.array([len(stretch)]))
        order = np.argsort(end, kind="stable")
        order = order[end[order] > back]
        best = best[-back - 1 :] + [None] * (len(stretch) - back)
        for a, b, c in zip(first[order].tolist(), end[order].tolist(), whole[piece[order]].tolist(), strict=True):
            now = best[a] + (c << _WIDE | 1)
            if best[b] is None or now < best[b]:
                best[b] = now
    return best[-1] & ((1 << _WIDE) - 1)


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_bytes, n_words, n_tokens`` for each row of ``docs(doc_id, text)``.

    ``path`` is a sentencepiece model whose pieces are the vocabulary, in order of rank. Null and empty texts, and those of
    white space only, have no words and no tokens. A run without white space is one word, however long. Repeated rows
    and null ids stay. Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))  # a fixed public file

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, cost, known = Matcher(shared.value[0]), costs(*shared.value), Known(1)
        for piece in text_pieces(batches, limit=PIECE):
            spaced, starts, lengths, first = spaced_words(piece.data, piece.bounds)
            tokens = np.zeros(len(piece), np.int64)
            if len(starts):
                hashes, place, inverse, _ = distinct(spaced, starts, lengths)

                def work(new: np.ndarray) -> np.ndarray:
                    return token_counts(match, cost, spaced, starts[place[new]], lengths[place[new]])[:, None].astype(float)  # noqa: B023

                each = np.concatenate([[0], np.cumsum(known.of(hashes, work)[inverse, 0].astype(np.int64))])
                tokens = each[first[1:]] - each[first[:-1]]
            columns = [pa.array(np.diff(piece.bounds)), pa.array(np.diff(first)), pa.array(tokens)]
            yield pa.RecordBatch.from_arrays(
                [piece.rows.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_words", "n_tokens"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_bytes long, n_words long, n_tokens long")


"""The fixed vocabulary of sub-word pieces, and all its matches inside many words at once.

A word is a maximal run of bytes that are not ASCII white space, however long, with one space before it. Pieces are byte
strings; the 256 single bytes belong to the vocabulary, so every word has at least one segmentation.
"""

from __future__ import annotations

import numpy as np
import sentencepiece

from zephyra.llm.texts import SPACE, prefix_sums, ranges, span_hashes, words

_SLOTS = 17


def load(path: str) -> tuple[list[bytes], int]:
    """The pieces of a sentencepiece model in the order of the file, then the single bytes that it lacks; and how many
    come before those."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, None] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            found[model.id_to_piece(i).replace("▁", " ").encode()] = None
    own = len(found)
    for b in range(256):
        found.setdefault(bytes([b]))
    return list(found), own


class Matcher:
    """Finds the pieces inside words by the hash of a stretch, in an open-addressed table."""

    def __init__(self, vocabulary: list[bytes]):
        self.lengths = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary))
        data = np.frombuffer(b"".join(vocabulary), np.uint8)
        ends = np.cumsum(self.lengths)
        hashes = span_hashes(prefix_sums(data), ends - self.lengths, ends)
        self.keys, self.ids = np.zeros(1 << _SLOTS, np.uint64), np.full(1 << _SLOTS, -1, np.int32)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[hashes & np.uint64((1 << 20) - 1)] = True
        for i, h in enumerate(hashes):
            slot = int(h) >> (64 - _SLOTS)
            while self.ids[slot] >= 0:
                slot = (slot + 1) % (1 << _SLOTS)
            self.keys[slot], self.ids[slot] = h, i

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int32)
        at = np.flatnonzero(self.seen[hashes & np.uint64((1 << 20) - 1)])
        slot = (hashes[at] >> np.uint64(64 - _SLOTS)).astype(np.int64)
        while len(at):
            there = self.ids[slot]
            hit = (self.keys[slot] == hashes[at]) & (there >= 0)
            out[at[hit]] = there[hit]
            more = ~hit & (there >= 0)
            at, slot = at[more], (slot[more] + 1) % (1 << _SLOTS)
        return out

    def edges(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All matches inside the words ``data[start:start + length]``: piece, and its first and end position.

        Position p of word w is the number ``p + sum(lengths[:w] + 1)``, so that each word has length + 1 positions.
        """
        sums = prefix_sums(data)
        base = np.cumsum(lengths + 1) - (lengths + 1)
        found = []
        for n in range(1, int(min(lengths.max(initial=0), self.lengths.max())) + 1):
            long = np.flatnonzero(lengths >= n)
            count = lengths[long] - n + 1
            at = ranges(starts[long], count)
            piece = self.find(span_hashes(sums, at, at + n))
            hit = np.flatnonzero(piece >= 0)
            first = ranges(base[long], count)[hit]
            found.append((piece[hit], first, first + n))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def spaced_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``spaced, starts, lengths, first``: the words of each text inside ``spaced``, with a space before each."""
    starts, ends, first = words(data, bounds, ~SPACE)
    sizes = ends - starts
    lengths = sizes + 1
    at = np.cumsum(lengths) - lengths
    spaced = np.full(int(lengths.sum()), 32, np.uint8)
    spaced[ranges(at + 1, sizes)] = data[ranges(starts, sizes)]
    return spaced, at, lengths, first


def distinct(
    spaced: np.ndarray, starts: np.ndarray, lengths: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first place, inverse and count of each distinct word, by hash."""
    hashes = span_hashes(prefix_sums(spaced), starts, starts + lengths)
    return np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)


class Known:
    """Values of the first ``most`` distinct words that a task meets, so that words which come again are not worked out again."""

    def __init__(self, width: int, most: int = 200_000):
        self.hashes, self.values, self.most = np.zeros(0, np.uint64), np.zeros((0, width)), most

    def of(self, hashes: np.ndarray, work) -> np.ndarray:
        """A row for each of the sorted ``hashes``; ``work`` gives the rows of those at some places."""
        out = np.empty((len(hashes), self.values.shape[1]))
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        there = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        out[there] = self.values[at[there]]
        new = np.flatnonzero(~there)
        if len(new):
            out[new] = work(new)
            if len(self.hashes) < self.most:
                hashes = np.concatenate([self.hashes, hashes[new]])
                order = np.argsort(hashes)
                self.hashes, self.values = hashes[order], np.concatenate([self.values, out[new]])[order]
        return out

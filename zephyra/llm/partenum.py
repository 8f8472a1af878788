"""Signatures for a set-similarity join (PartEnum): sufficiently similar sets of one size band share one.

Two sets with Jaccard similarity of at least p percent differ in at most ``D = (a + b) (100 - p) / (100 + p)`` elements. The
elements' domain is dealt into partitions; a set's signature for a subset of partitions is a hash of its elements there. Here
the second-level subsets are single partitions (one of two is left out of each pair: n2 = 2, k2 = 1), so a set has one
signature for each partition in which it has elements. Of two similar sets, the one with more signatures shares all but D of
them at least, so a pair has a signature in common whenever one of the two has more than D.

Size bands grow by a factor of four and set the number of partitions. A set within reach of the band below gives signatures
there too. Should a set's partitions not outnumber D, which chance alone does, it gives its elements as signatures besides;
two such sets meet there. So no pair is lost.

Signatures that many sets share can mostly be left out. Put the crowded ones last in the order of all signatures: a pair then
meets among the first D + 1 of each set, so a set with more than D signatures that are not crowded needs no crowded one. The
number of crowded ones that a set can spare is its ``spare``.
"""

from __future__ import annotations

import numpy as np

from zephyra.llm.texts import LOWER, MIX, SPACE, Piece, gram_hashes, mixed, prefix_sums, span_hashes, words

SHINGLE = 5
#: Sets below this size are their own band, in which every element is a partition.
SMALL = 64
FACTOR = 4
SKETCH = 512


def shingle_sets(piece: Piece, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one set after another, and the bounds of the sets."""
    data = LOWER[piece.data]
    starts, ends, first = words(data, piece.bounds, ~SPACE)
    hashes = span_hashes(prefix_sums(data), starts, ends)
    counts = np.diff(first)
    grams = gram_hashes(hashes, n)
    parts, sizes = [], np.zeros(len(counts), np.int64)
    for i in range(len(counts)):
        if counts[i] >= n:
            made = np.unique(grams[first[i] : first[i + 1] - n + 1])
        elif counts[i]:
            made = gram_hashes(hashes[first[i] : first[i + 1]], int(counts[i]))
        else:
            continue
        parts.append(made)
        sizes[i] = len(made)
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate([[0], np.cumsum(sizes)])


def most_different(a: int, b: int, percent: int) -> int:
    """The most elements in which sets of these sizes can differ and still be similar."""
    return (a + b) * (100 - percent) // (100 + percent)


def bands(size: int, percent: int) -> list[tuple[int, int, int]]:
    """Bands in which a set of this size gives signatures: first size of the band, partitions, differences to allow."""
    low, high = 0, SMALL
    below = None
    while size >= high:
        below = low, high
        low, high = high, high * FACTOR
    found = [(low, high // 2, most_different(size, size * 100 // percent, percent))]
    if below and size * percent <= (low - 1) * 100:
        found.append((below[0], below[1] // 2, most_different(low - 1, size, percent)))
    return found


def signatures(elements: np.ndarray, percent: int) -> list[tuple[np.ndarray, int]]:
    """For each band of a set of distinct hashes: its signatures there, and how many of them it can spare."""
    found = []
    for low, partitions, most in bands(len(elements), percent):
        made = np.zeros(0, np.uint64)
        if low:
            deal = ((elements >> np.uint64(24)) % np.uint64(partitions)).astype(np.int64)
            order = np.argsort(deal, kind="stable")
            head = np.flatnonzero(np.diff(deal[order], prepend=-1))
            content = np.add.reduceat(elements[order], head)
            made = mixed(content * MIX + deal[order][head].astype(np.uint64) + np.uint64(low))
        spare = len(made) - most - 1
        if spare < 0:
            made, spare = np.concatenate([made, mixed(elements + np.uint64(low + 1))]), 0 if low else len(elements) - most - 1
        found.append((made, max(spare, 0)))
    return found


def sketch(elements: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Bits as 64-bit words: for each bit, whether the number of elements dealt to it is odd.

    Each element in which two sets differ changes one bit, so sets that differ in d elements have sketches that differ in d
    bits at most. By default there are 16 to 32 bits for each element of a small set, and four to eight for those of a large one; a longer
    sketch can be folded to a shorter.
    """
    size = len(elements).bit_length()
    bits = bits or max(SKETCH, min(16 << size, 8192), 4 << size)
    count = np.bincount((elements >> np.uint64(24)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(count.astype(np.uint8)).view(np.uint64)


def apart(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two sketches differ, the longer one folded."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))

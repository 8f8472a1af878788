"""Byte-level BPE: every distinct word of the corpus is encoded once.

Texts are cut into pre-tokens by the tokenizer's pattern. A batch of documents has its distinct pre-tokens, numbered from the
most frequent, and for each document their numbers in order of position. The distinct pre-tokens of all batches meet in one
shuffle by the hash of the word, where a word is encoded once for all batches that have it. The ids go back to the batches,
which put them together by position. What is shuffled are packed blocks: the words of a batch that fall into one bucket, their
ids, and the positions of a batch; never a row per position.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyra.llm.lookup import Lookup
from zephyra.llm.texts import Piece, prefix_sums, ranges, span_hashes, steady_pieces, views

#: Text of a batch, about; a longer text is a batch by itself.
BATCH_BYTES = 8 << 20
#: Text whose distinct words meet in one bucket, about.
BUCKET_BYTES = 16 << 20
#: Longer words are merged one by one with a heap, so that work stays near linear.
_SIDE_BY_SIDE = 64
_NONE = np.int64(1) << 40

_merges: dict[str, Merges] = {}


def load_ranks(path: str) -> list[bytes]:
    """Token bytes in order of rank; ranks are ids and have no gaps."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError(f"{path}: ranks have gaps")
    return tokens


class Merges:
    """Which two tokens make which, from the ranks alone: every way to cut a token into two tokens."""

    def __init__(self, tokens: list[bytes]):
        rank = {t: i for i, t in enumerate(tokens)}
        self.byte = np.array([rank[bytes([b])] for b in range(256)], np.int64)
        left, right, made = [], [], []
        for i, t in enumerate(tokens):
            for k in range(1, len(t)):
                a = rank.get(t[:k])
                if a is not None and (b := rank.get(t[k:])) is not None:
                    left.append(a)
                    right.append(b)
                    made.append(i)
        self.table = Lookup(np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64), np.array(made))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.table.find(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)).astype(np.int64)
        return np.where(found < 0, _NONE, found)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words ``data[bounds[i]:bounds[i + 1]]``, one after another, and the number of ids of each word."""
        sizes = np.diff(bounds)
        long = np.flatnonzero(sizes > _SIDE_BY_SIDE)
        short = np.flatnonzero((sizes > 0) & (sizes <= _SIDE_BY_SIDE))
        done_word, done_token = [], []
        for w in long.tolist():
            made = self._one(self.byte[data[bounds[w] : bounds[w + 1]]])
            done_word.append(np.full(len(made), w))
            done_token.append(made)
        token, word = self.byte[data[ranges(bounds[short], sizes[short])]], np.repeat(short, sizes[short])
        rank = np.full(len(token), _NONE)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self.ranks(token[inner], token[inner + 1])
        while len(token):
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(head, len(word)))
            least = np.minimum.reduceat(rank, head)
            ended = np.repeat(least == _NONE, size)
            if ended.any():
                done_word.append(word[ended])
                done_token.append(token[ended])
                token, word, rank, least = token[~ended], word[~ended], rank[~ended], np.repeat(least, size)[~ended]
                if not len(token):
                    break
            else:
                least = np.repeat(least, size)
            # the leftmost pair of least rank in each word
            at = np.flatnonzero(rank == least)
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]
            token[at] = rank[at]
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            token, word, rank = token[keep], word[keep], rank[keep]
            for pair in (at - 1, at):
                pair = pair[(pair >= 0) & (pair < len(token))]
                rank[pair] = _NONE
                pair = pair[pair + 1 < len(token)]
                pair = pair[word[pair] == word[pair + 1]]
                rank[pair] = self.ranks(token[pair], token[pair + 1])
        if not done_word:
            return np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
        word, token = np.concatenate(done_word), np.concatenate(done_token)
        return token[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(sizes))

    def _one(self, token: np.ndarray) -> np.ndarray:
        """A long word: its pairs wait in a heap by rank, then place."""
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        value = token.tolist()
        waiting = [(r, i) for i, r in enumerate(self.ranks(token[:-1], token[1:]).tolist()) if r < _NONE]
        heapq.heapify(waiting)

        def rank(i: int, j: int) -> int:
            return int(self.ranks(np.array([value[i]]), np.array([value[j]]))[0])

        while waiting:
            r, i = heapq.heappop(waiting)
            j = after[i] if value[i] >= 0 else n
            if j >= n or rank(i, j) != r:
                continue  # one of the two has changed since
            value[i], value[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (made := rank(i, after[i])) < _NONE:
                    heapq.heappush(waiting, (made, i))
            if before[i] >= 0 and (made := rank(before[i], i)) < _NONE:
                heapq.heappush(waiting, (made, before[i]))
        return np.array([v for v in value if v >= 0], np.int64)


def _pack(numbers: np.ndarray) -> bytes:
    """Byte planes, low bytes first: most numbers are small, so the high planes are nearly empty."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unpack(packed: bytes) -> np.ndarray:
    plain = np.frombuffer(zstandard.decompress(packed), np.uint8)
    return np.ascontiguousarray(plain.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class Batch:
    """Pre-tokens of a piece of text: distinct ``words`` (bytes and bounds) by falling frequency, the ``codes`` that say which
    of them stand where, and how many each document has (``counts``). ``name`` is a hash of the content and of its place: the
    partition, and the number of the batch there."""

    def __init__(self, piece: Piece, find, number: int):
        found, counts = [], []
        for text in piece.rows.column("text").to_pylist():
            tokens = find(text) if text else []
            found += tokens
            counts.append(len(tokens))
        encoded = pa.array(found, pa.string()).dictionary_encode()
        codes = encoded.indices.to_numpy()
        order = np.argsort(-np.bincount(codes, minlength=len(encoded.dictionary)), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.codes, self.counts = place[codes], counts
        self.words = views(encoded.dictionary.take(pa.array(order)))
        content = xxhash.xxh3_64(piece.data.tobytes())
        content.update(piece.bounds.tobytes())
        content.update(np.array([TaskContext.get().partitionId(), number]).tobytes())
        self.name = int(np.uint64(content.intdigest()).view(np.int64))


def word_blocks(docs: DataFrame, pattern: str, batch_bytes: int, buckets: int) -> DataFrame:
    """``bucket, batch, steps, sizes, content``: the words of each batch that fall into each bucket, in order of number.
    ``steps`` are the differences of the numbers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        for number, piece in enumerate(steady_pieces(batches, limit=batch_bytes)):
            batch = Batch(piece, find, number)
            data, bounds = batch.words
            hashes = span_hashes(prefix_sums(data), bounds[:-1], bounds[1:])
            bucket = ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            heads = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            sizes = np.diff(bounds)
            rows = []
            for a, b in zip(heads.tolist(), np.append(heads, len(order))[1:].tolist(), strict=True):
                own = order[a:b]
                content = zstandard.compress(data[ranges(bounds[own], sizes[own])].tobytes(), 3)
                rows.append((int(bucket[own[0]]), batch.name, _pack(np.diff(own, prepend=0)), _pack(sizes[own]), content))
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int32(), pa.int64(), *[pa.binary()] * 3], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "batch", "steps", "sizes", "content"])

    schema = "bucket int, batch long, steps binary, sizes binary, content binary"
    return docs.select("doc_id", "text").mapInArrow(cut, schema)  # the columns of positions(): both read the same rows in the same order


def encoded_blocks(blocks: DataFrame, tokens: Broadcast) -> DataFrame:
    """``bucket, batch, steps, counts, ids`` for the blocks: a word is encoded once, whatever number of batches has it."""

    def encode(rows: pa.Table) -> pa.Table:
        merges = merges_of(tokens.value)
        sizes = [_unpack(x) for x in rows.column("sizes").to_pylist()]
        data = np.frombuffer(b"".join(zstandard.decompress(x) for x in rows.column("content").to_pylist()), np.uint8)
        every = np.concatenate(sizes)
        starts = np.cumsum(every) - every
        hashes = span_hashes(prefix_sums(data), starts, starts + every)
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        same = first[inverse]
        equal = (every[same] == every).all() and (data[ranges(starts[same], every)] == data[ranges(starts, every)]).all()
        if not equal:  # two words with one hash
            text = data.tobytes()
            number: dict[bytes, int] = {}
            cut = [text[s : s + n] for s, n in zip(starts.tolist(), every.tolist(), strict=True)]
            inverse = np.array([number.setdefault(w, len(number)) for w in cut])
            _, first = np.unique(inverse, return_index=True)
        words = data[ranges(starts[first], every[first])]
        ids, count = merges.encode(words, np.concatenate([[0], np.cumsum(every[first])]))
        begin = np.cumsum(count) - count
        out_counts, out_ids, at = [], [], 0
        for n in map(len, sizes):
            own = inverse[at : at + n]
            at += n
            out_counts.append(_pack(count[own]))
            out_ids.append(zstandard.compress(ids[ranges(begin[own], count[own])].astype("<u4").tobytes(), 3))
        return pa.table(
            [rows.column("bucket"), rows.column("batch"), rows.column("steps"), pa.array(out_counts, pa.binary()), pa.array(out_ids, pa.binary())],
            names=["bucket", "batch", "steps", "counts", "ids"],
        )

    return blocks.groupBy("bucket").applyInArrow(encode, "bucket int, batch long, steps binary, counts binary, ids binary")


def positions(docs: DataFrame, pattern: str, batch_bytes: int) -> DataFrame:
    """``batch, doc_ids, lengths, codes``: the documents of each batch, their numbers of pre-tokens, and which stand where."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        for number, piece in enumerate(steady_pieces(batches, limit=batch_bytes)):
            batch = Batch(piece, find, number)
            ids = pa.ListArray.from_arrays(pa.array([0, len(piece)], pa.int32()), piece.rows.column("doc_id"))
            lengths = pa.array([batch.counts], pa.list_(pa.int32()))
            columns = [pa.array([batch.name]), ids, lengths, pa.array([_pack(batch.codes)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["batch", "doc_ids", "lengths", "codes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"batch long, doc_ids array<{kind}>, lengths array<int>, codes binary")


def merges_of(tokens: list[bytes]) -> Merges:
    """One table per worker and vocabulary."""
    key = hashlib.sha256(b"\0".join(tokens)).hexdigest()
    if key not in _merges:
        _merges[key] = Merges(tokens)
    return _merges[key]


def decode(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that the ids stand for, joined from the table of token bytes (data, bounds), and the size of each."""
    data, bounds = table
    sizes = np.diff(bounds)[ids]
    return data[ranges(bounds[ids], sizes)], sizes


def _slices(values: bytes, ends: np.ndarray) -> Iterator[bytes]:
    start = 0
    for end in ends.tolist():
        yield values[start:end]
        start = end


def encode(
    docs: DataFrame, path: str, pattern: str, batch_bytes: int = BATCH_BYTES, buckets: int | None = None, with_ids: bool = True
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids`` for each row of ``docs(doc_id, text)``.

    ``ids`` are the ids of the text (left out without ``with_ids``), ``ids_sha256`` the hash of them as little-endian 32-bit
    numbers, ``decoded_sha256`` the hash of the bytes that the ids stand for in the table of tokens. A null text is the
    empty text and has no ids. Repeated rows and null ids stay. Other columns are not looked at. ``docs`` is read twice and
    must come in the same order both times, as a scan of files does; otherwise the job ends with an error. ``buckets``, by
    default as many as the text needs, bounds what a task has of the distinct words.
    """
    spark = docs.sparkSession
    tokens = spark.sparkContext.broadcast(load_ranks(path))  # a fixed public file
    if buckets is None:
        size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))).first()[0] or 0
        buckets = max(1, -(-size // BUCKET_BYTES))
    words = encoded_blocks(word_blocks(docs, pattern, batch_bytes, buckets), tokens)

    def join(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        blocks = {row["bucket"]: row for row in left.to_pylist()}.values()
        numbers = np.concatenate([np.zeros(0, np.int64), *[np.cumsum(_unpack(x["steps"])) for x in blocks]])
        counts = np.concatenate([np.zeros(0, np.int64), *[_unpack(x["counts"]) for x in blocks]])
        pool = np.frombuffer(b"".join(zstandard.decompress(x["ids"]) for x in blocks), "<u4")
        starts, sizes = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        if len(numbers) and numbers.max() != len(numbers) - 1:
            raise ValueError("documents came in another order the second time; write them to a table first")
        starts[numbers], sizes[numbers] = np.cumsum(counts) - counts, counts
        token_sizes = np.fromiter(map(len, tokens.value), np.int64, len(tokens.value))
        table = np.frombuffer(b"".join(tokens.value), np.uint8), np.concatenate([[0], np.cumsum(token_sizes)])
        parts = []
        for row in right.to_pylist():
            codes = _unpack(row["codes"])
            if len(codes) and codes.max() >= len(numbers):
                raise ValueError("documents came in another order the second time; write them to a table first")
            ids = pool[ranges(starts[codes], sizes[codes])]
            ends = np.concatenate([[0], np.cumsum(sizes[codes])])[np.cumsum(row["lengths"])]
            decoded, byte_sizes = decode(ids, table)
            byte_ends = np.concatenate([[0], np.cumsum(byte_sizes)])[ends]
            columns = {
                "doc_id": pa.array(row["doc_ids"], right.schema.field("doc_ids").type.value_type),
                "n_tokens": pa.array(np.diff(ends, prepend=0)),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in _slices(ids.tobytes(), 4 * ends)]),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in _slices(decoded.tobytes(), byte_ends)]),
            }
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
            parts.append(pa.table(columns))
        if not parts:
            raise ValueError("documents came in another order the second time; write them to a table first")
        return pa.concat_tables(parts)

    kind = docs.schema["doc_id"].dataType
    fields = [("doc_id", kind), ("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    schema = T.StructType([T.StructField(*f) for f in fields + [("ids", T.ArrayType(T.IntegerType()))] * with_ids])
    return words.groupBy("batch").cogroup(positions(docs, pattern, batch_bytes).groupBy("batch")).applyInArrow(join, schema)

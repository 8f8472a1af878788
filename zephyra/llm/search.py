"""Ranked lexical search without an index of the documents: one automaton of all query terms reads the texts.

The terms of all items become an Aho-Corasick automaton. A text is brought to lower case, everything between its terms becomes one
guard byte, and each pattern is a term with a guard on either side, so an occurrence is always a whole term. The automaton gives
the number of occurrences of each query term in each document in one pass over the text. When the number of documents of each
term is known, these outputs are mapped to the items that have the term, and each item's scores are summed by whole arrays.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zephyra.llm.texts import LOWER, Piece, pieces, ranges, words
from zephyra.plans.tables import write_out

#: Bytes of text that the automaton reads at once.
SEGMENT = 1 << 20
#: Bytes of the distinct terms of the items in a block; a block is broadcast, and each block reads the texts once.
BLOCK_BYTES = 8 << 20
#: Scores (documents times items) in memory at once.
CELLS = 1 << 20
#: First ranking of an item's best rows of all tasks, in so many groups.
GROUPS = 64

LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_GUARD = 32

_automata: dict[str, ahocorasick.Automaton] = {}


def terms_of(text: str | None) -> list[bytes]:
    """The terms of one text, in order."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]), LETTER)
    low = LOWER[data].tobytes()
    return [low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


@dataclass
class Items:
    """A block of items: its distinct ``terms``, and for term t the items ``places[first[t]:first[t + 1]]`` of ``ids``."""

    ids: list
    terms: list[bytes]
    first: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        """From pairs of an item's id and one of its terms, each pair once."""
        ids = list(dict.fromkeys(r[0] for r in rows))
        terms = sorted({r[1] for r in rows})
        item, term = {x: i for i, x in enumerate(ids)}, {x: i for i, x in enumerate(terms)}
        pairs = np.array([(term[t], item[i]) for i, t in rows], np.int64).reshape(-1, 2)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        return cls(ids, terms, np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1)), pairs[:, 1])


def automaton_of(terms: list[bytes]) -> ahocorasick.Automaton:
    """One per worker and block. A byte is a character of its own."""
    key = hashlib.sha256(b" ".join(terms)).hexdigest()
    if key not in _automata:
        made = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            made.add_word(f" {term.decode('latin-1')} ", i)
        made.make_automaton()
        _automata.clear()
        _automata[key] = made
    return _automata[key]


def guarded(piece: Piece, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes with guards, the place behind each text in them, and the number of terms of each text.

    Words longer than ``longest`` bytes are no query terms; they count, but become guards.
    """
    starts, ends, first = words(piece.data, piece.bounds, LETTER)
    sizes = np.diff(piece.bounds)
    # each text is moved by one more guard than the one before it
    shift = np.repeat(np.arange(1, len(piece) + 1), np.diff(first))
    out = np.full(len(piece.data) + len(piece) + 1, _GUARD, np.uint8)
    fit = np.flatnonzero(ends - starts <= longest)
    lengths = (ends - starts)[fit]
    out[ranges((starts + shift)[fit], lengths)] = LOWER[piece.data[ranges(starts[fit], lengths)]]
    return out, np.cumsum(sizes + 1), np.diff(first)


def occurrences(automaton: ahocorasick.Automaton, data: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Term and place (of the guard behind it) of each occurrence in ``data``, which starts and ends with a guard."""
    found_at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    guards, start = None, 0
    while start < len(data) - 1:
        end = len(data)
        if end - start > segment:  # cut at the last guard of the segment; both sides have it
            guards = np.flatnonzero(data == _GUARD) if guards is None else guards
            last = int(guards[np.searchsorted(guards, start + segment, side="right") - 1])
            end = 1 + (last if last > start else int(guards[np.searchsorted(guards, start, side="right")]))
        hits = np.array(list(automaton.iter(data[start:end].tobytes().decode("latin-1"))), np.int64).reshape(-1, 2)
        found_at.append(hits[:, 0] + start)
        found.append(hits[:, 1])
        start = end - 1
    return np.concatenate(found), np.concatenate(found_at)


def term_counts(docs: DataFrame, terms: list[bytes], segment: int = SEGMENT) -> DataFrame:
    """``doc_id, n, terms, counts`` for each row of ``docs(doc_id, text)`` that has a term of its own: how many it has, and
    which of the numbered ``terms`` occur how often."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # a block of bounded size
    longest = max(map(len, terms), default=0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(shared.value) if shared.value else None
        for piece in pieces(batches):
            data, behind, n = guarded(piece, longest)
            term, at = occurrences(automaton, data, segment) if automaton else (np.zeros(0, np.int64),) * 2
            size = max(1, len(shared.value))
            # the guard behind the last term of a text is the one between the texts
            cell, tf = np.unique(np.searchsorted(behind, at) * size + term, return_counts=True)
            row, term = np.divmod(cell, size)
            keep = np.flatnonzero(n > 0)
            edges = pa.array(np.append(np.searchsorted(row, keep), len(row)), pa.int32())
            columns = [
                piece.rows.column("doc_id").take(pa.array(keep)), pa.array(n[keep], pa.int64()),
                pa.ListArray.from_arrays(edges, pa.array(term, pa.int32())), pa.ListArray.from_arrays(edges, pa.array(tf, pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n long, terms array<int>, counts array<long>")


def document_counts(counted: DataFrame, n_terms: int) -> np.ndarray:
    """The number of documents that have each term. A task gives one row per term that it has met."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=n_terms)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], names=["term", "n"])

    out = np.zeros(n_terms, np.int64)
    for row in counted.select("terms").mapInArrow(add, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["term"]] = row["n"]
    return out


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def parts_of_score(tf: np.ndarray, n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """The part of a term's score that its weight multiplies, from its count and the length of the document."""
    most = int(n.max(initial=0))
    if 90 * most * max(n_docs, 1) < 2**63:
        m = 10 + 90 * n * n_docs // total
    else:  # beyond 64 bits in between, not at the end
        m = np.array([10 + 90 * x * n_docs // total for x in n.tolist()], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Best:
    """The best ``k`` rows of each item so far: higher scores first, then smaller ids, then null ids."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, np.int64)
        self.item, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.none = np.zeros(0, bool)

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, score])
        ids, none = np.concatenate([self.id, ids]), np.concatenate([self.none, none])
        order = np.lexsort((ids, none, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[rank < self.k]
        full = item[rank == self.k - 1]
        self.item, self.score, self.id, self.none = item[rank < self.k], score[order], ids[order], none[order]
        self.floor[full] = self.score[np.searchsorted(self.item, full) + self.k - 1]


def best_rows(counted: DataFrame, items: Items, weight: np.ndarray, n_docs: int, total: int, k: int, cells: int = CELLS) -> DataFrame:
    """``item, doc_id, score``: the best rows of each item among those of a task."""
    shared = counted.sparkSession.sparkContext.broadcast((items.first, items.places, weight))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, places, weight = shared.value
        n_items = int(places.max(initial=-1)) + 1
        best = Best(n_items, k)
        at_once = max(1, cells // max(n_items, 1))
        for batch in batches:
            doc_ids = batch.column("doc_id")
            none = doc_ids.is_null().to_numpy(zero_copy_only=False)
            ids = doc_ids.fill_null(0).to_numpy()
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                size = part.column("terms").value_lengths().to_numpy()
                term, tf = part.column("terms").flatten().to_numpy(), part.column("counts").flatten().to_numpy()
                row = np.repeat(np.arange(part.num_rows), size)
                value = weight[term] * parts_of_score(tf, part.column("n").to_numpy()[row], n_docs, total)
                many = (first[1:] - first[:-1])[term]
                cell = np.repeat(row * n_items, many) + places[ranges(first[term], many)]
                scores = np.zeros(part.num_rows * n_items, np.int64)
                np.add.at(scores, cell, np.repeat(value, many))
                scores = scores.reshape(part.num_rows, n_items)
                row, item = np.nonzero(scores >= best.floor)
                best.add(item, scores[row, item], ids[start + row], none[start + row])
        names = ["item", "doc_id", "score"]
        yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.id, mask=best.none), pa.array(best.score)], names=names)

    return counted.mapInArrow(rank, "item long, doc_id long, score long")


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term``: each item's terms once. Rows of one id are one item, and so are those without id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, text in enumerate(batch.column("text").to_pylist()):
                own = list(dict.fromkeys(terms_of(text)))
                ids = batch.column("item_id").take(pa.array([place] * len(own), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.binary())], names=["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(cut, f"item_id {kind}, term binary").distinct()


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES, segment: int = SEGMENT, cells: int = CELLS
) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each row of ``items(item_id, text)`` the ``k`` rows of ``docs(doc_id, text)``
    that score highest, above 0; equal scores by ascending id, null ids last. ``doc_id`` is a whole number.

    Null texts and texts without a term are no documents, and no items either. Rows of ``docs`` are documents of
    their own, also if an id or a text repeats; rows of ``items`` with one id (null is one) are one item with all their
    terms. An empty table gives no rows. Other columns are not looked at. Items are dealt by a hash to blocks whose terms take about
    ``block_bytes``, so that neither a broadcast nor the automaton grows with them; a block reads the texts once.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    terms = write_out(item_terms(items))
    size = terms.agg(F.sum(F.octet_length("term") + 16)).first()[0]
    if not size:
        return terms.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    blocks = -(-size // block_bytes)
    names = terms.withColumn("_block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    found, n_docs, total = None, 0, 0
    for block in range(blocks):
        own = Items.of([tuple(r) for r in names.where(F.col("_block") == block).select("item_id", "term").toLocalIterator()])
        if not own.ids:
            continue
        counted = write_out(term_counts(docs, own.terms, segment))
        if found is None:
            row = counted.agg(F.count("*").alias("n"), F.sum("n").alias("total")).first()
            n_docs, total = row["n"], row["total"] or 0
        weight = weights(n_docs, document_counts(counted, len(own.terms)))
        best = best_rows(counted, own, weight, n_docs, total, k, cells)
        ids = docs.sparkSession.createDataFrame(list(enumerate(own.ids)), f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        part = best.join(F.broadcast(ids), "item").select("item_id", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = Window.partitionBy("item_id", F.pmod(F.spark_partition_id(), F.lit(GROUPS))).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

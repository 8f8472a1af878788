"""Exact search for the vectors of largest inner product, by Fagin's threshold algorithm.

A task keeps a shard of vectors with one list per dimension, sorted by that component. For a query all lists are read side by
side from the end that is best for the sign of its component. A vector seen in any list is scored in full. No vector that
was not seen in any list can score more than the sum over the lists of the query's component times the value at the depth
reached; when that bound is below the k-th best score, the shard is done. The best of all shards are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
#: Vectors of a shard, at most.
SHARD_ROWS = 1 << 16
#: Queries that are broadcast at once.
QUERY_BLOCK = 4096
_FIRST_DEPTH = 32


def integer_vectors(rows: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: each component times ``scale``, rounded down. Vectors that are null, empty, or hold a null or a
    non-finite component are left out, and so are rows without id."""
    whole = f"{vector} is not null and size({vector}) > 0 and vec_id is not null and "
    whole += f"forall({vector}, x -> coalesce(abs(cast(x as double)) < double('infinity'), false))"
    made = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.where(whole).select(F.col("vec_id").cast("long"), made.alias("v"))


class Shard:
    """Vectors of equal length with their sorted lists. Rows are in order of id, so that ties go to the smaller."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.largest = _largest(vectors)
        self.exact = self.vectors.astype(np.float64)
        self.lists = np.argsort(self.vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.exact, self.lists, axis=0)

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best, best first."""
        n = len(self.ids)
        if self.largest * _largest(query) * len(query) >= 2**53:  # sums of products below that are exact as floats
            return self._best_of_all(query_id, query, k)
        used = np.flatnonzero(query)
        weight = query[used].astype(np.float64)
        up = weight > 0
        seen = np.zeros(n, bool)
        seen[self.ids == query_id] = True
        places, scores = np.zeros(0, np.int64), np.zeros(0)
        depth, step = 0, _FIRST_DEPTH
        while depth < n and len(used):
            stop = min(n, depth + step)
            fresh = np.zeros(n, bool)
            fresh[self.lists[n - stop : n - depth, used[up]].ravel()] = True
            fresh[self.lists[depth:stop, used[~up]].ravel()] = True
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh)
            places = np.concatenate([places, new])
            scores = np.concatenate([scores, self.exact[np.ix_(new, used)] @ weight])
            keep = np.lexsort((places, -scores))[:k]
            places, scores = places[keep], scores[keep]
            depth, step = stop, step * 2
            bound = (self.sorted[n - depth, used[up]] * weight[up]).sum() + (self.sorted[depth - 1, used[~up]] * weight[~up]).sum()
            if len(places) == k and scores[-1] > bound:
                break
        if not len(used):  # a query of zeros scores 0 with everything
            places = np.flatnonzero(~seen)[:k]
            scores = np.zeros(len(places))
        return places, scores


    def _best_of_all(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``best`` in Python's integers, over all vectors."""
        places = np.flatnonzero(self.ids != query_id)
        own = query.tolist()
        scores = [sum(a * b for a, b in zip(self.vectors[p].tolist(), own, strict=True)) for p in places]
        order = sorted(range(len(scores)), key=lambda i: -scores[i])[:k]
        if any(abs(scores[i]) >= 2**63 for i in order):
            raise ValueError("a score does not fit into 64 bits")
        return places[order], np.array([scores[i] for i in order], np.int64)


def _largest(whole: np.ndarray) -> int:
    """The largest size of a component."""
    most = max(int(whole.max(initial=0)), -int(whole.min(initial=0)))
    if most >= 2**63 - 1:  # rounding down stops there
        raise ValueError("a component does not fit into 64 bits")
    return most


def _search(vectors: DataFrame, queries: Broadcast, k: int, shard_rows: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def run(width: int) -> pa.RecordBatch:
            parts = waiting.pop(width)
            shard = Shard(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            out = [np.zeros((3, 0), np.int64)]
            for query_id, query in queries.value:
                if len(query) == width:
                    places, scores = shard.best(query_id, query, k)
                    out.append(np.stack([np.full(len(places), query_id), shard.ids[places], scores.astype(np.int64)]))
            columns = np.concatenate(out, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for start in range(0, batch.num_rows, shard_rows):
                part = batch.slice(start, shard_rows)
                lists = part.column("v")
                width = lists.value_lengths().to_numpy()
                ids, flat = part.column("vec_id").to_numpy(), lists.flatten().to_numpy()
                ends = np.cumsum(width)
                for w in np.unique(width).tolist():
                    rows = np.flatnonzero(width == w)
                    waiting.setdefault(w, []).append((ids[rows], flat[(ends[rows] - w)[:, None] + np.arange(w)]))
                    if sum(len(p[0]) for p in waiting[w]) >= shard_rows:
                        yield run(w)
        for w in list(waiting):
            yield run(w)

    return vectors.mapInArrow(search, "query_id long, vec_id long, score long")


def top_k(
    rows: DataFrame, queries: DataFrame, k: int = 10, vector: str = "embedding", scale: int = SCALE,
    shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``queries(vec_id, vector)`` against all of ``rows(vec_id, vector)``.

    ``rank`` counts from 1; ties go to the smaller id; fewer than k candidates give fewer rows. A row with the query's own id is
    no candidate, nor is a vector of another length. Repeated rows count once. See ``integer_vectors`` for what is left
    out. Scores are exact; one among the best, or a component times ``scale``, that does not fit into 64 bits ends the query
    with an error. Other columns are not looked at. Queries are searched in blocks, so that no broadcast grows with them.
    """
    context = rows.sparkSession.sparkContext
    vectors = integer_vectors(rows, vector, scale).distinct()
    asked = integer_vectors(queries, vector, scale).distinct()
    blocks = max(1, -(-asked.count() // query_block))
    # hashing spreads the ids evenly, so a block holds about query_block of them
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    found = None
    for block in range(blocks):
        own = [(r["vec_id"], np.array(r["v"], np.int64)) for r in asked.where(F.col("_block") == block).orderBy("vec_id").toLocalIterator()]
        part = _search(vectors, context.broadcast(own), k, shard_rows)
        found = part if found is None else found.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")

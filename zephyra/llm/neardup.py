"""Documents whose word shingles are similar, by signatures that similar sets must share, and their components.

Equal sets are one set from the start. Signatures meet in one shuffle. In a group of sets with one signature the smallest is
compared with all others; what links is one component. Only pairs of a group that are then in different components are still
open. They are looked at side by side inside a task through short sketches that never rule out a link, and the few that
remain are compared exactly. So a group of copies costs its size, and no link between different sets is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zephyra.llm.components import components
from zephyra.llm.partenum import SKETCH, shingle_sets, signatures, sketch
from zephyra.llm.texts import mixed, pieces
from zephyra.plans.tables import write_out

#: A signature of more sets than this is crowded: sets that can spare it drop it.
CROWDED = 20
#: Groups are compared side by side in slices of about so many rows.
SLICE_ROWS = 1024
#: A group's sets are compared in blocks of this many.
BLOCK = 4096
#: Open pairs of a set with so many nearest others are compared before all the rest.
NEAREST = 3
#: Up to so many keys are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
_WORDS = [f"s{i}" for i in range(SKETCH // 64)]
PIECE = 2 << 20


def set_number(elements: np.ndarray) -> int:
    """64-bit name of a set, by its elements."""
    sums = np.array([elements.sum(dtype=np.uint64), mixed(elements).sum(dtype=np.uint64)])
    return int(mixed(sums[:1] + (sums[1:] + np.uint64(1)) * np.array([len(elements)], np.uint64)).view(np.int64)[0])


def document_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, set, n, wide, s0...``: the set of each document (null and 0 if empty), with a sketch that grows
    with the set and one of fixed size."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=PIECE):
            elements, bounds = shingle_sets(piece)
            n = np.diff(bounds)
            names, sketches = np.zeros(len(n), np.int64), np.zeros((len(n), len(_WORDS)), np.int64)
            wide: list[bytes | None] = [None] * len(n)
            for i in np.flatnonzero(n).tolist():
                own = elements[bounds[i] : bounds[i + 1]]
                names[i], sketches[i], wide[i] = set_number(own), sketch(own, SKETCH).view(np.int64), sketch(own).tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    piece.rows.column("doc_id"),
                    piece.rows.column("text_hash"),
                    pa.array(names, mask=n == 0),
                    pa.array(n),
                    pa.array(wide, pa.binary()),
                    *[pa.array(sketches[:, k]) for k in range(len(_WORDS))],
                ],
                names=["doc_id", "text_hash", "set", "n", "wide", *_WORDS],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, set long, n long, wide binary, " + ", ".join(f"{w} long" for w in _WORDS)
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(describe, schema)


def signature_rows(docs: DataFrame, percent: int) -> DataFrame:
    """``sig, set, about``: the signatures of the distinct sets that a task meets. ``about`` packs the size of the set (32 bits),
    the number of its signatures that it can spare in the band (31 bits) and which of its bands it is."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for piece in pieces(batches, limit=PIECE):
            elements, bounds = shingle_sets(piece)
            sigs, names, about, counts = [], [], [], []
            for i in np.flatnonzero(np.diff(bounds)).tolist():
                own = elements[bounds[i] : bounds[i + 1]]
                name = set_number(own)
                if name in seen:
                    continue
                seen.add(name)
                for band, (made, spare) in enumerate(signatures(own, percent)):
                    sigs.append(made)
                    names.append(name)
                    about.append(len(own) << 32 | spare << 1 | band)
                    counts.append(len(made))
            if sigs:
                rest = [np.repeat(np.array(x, np.int64), counts) for x in (names, about)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(sigs).view(np.int64)), *map(pa.array, rest)], names=["sig", "set", "about"]
                )

    return docs.select("text").mapInArrow(sign, "sig long, set long, about long")


def _alike_in_size(a: str, b: str, percent: int) -> F.Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def memberships(rows: DataFrame, percent: int, crowded: int = CROWDED) -> DataFrame:
    """``sig, set, n, hub, hub_n``: sets of each signature that several sets share, with the smallest of them as hub.
    Crowded signatures that a set can spare are left out."""
    rows = rows.repartition("sig")
    # both sides use all columns, so that they read one shuffle; only signatures of several sets go on
    shared = rows.groupBy("sig").agg(F.min("set").alias("_low"), F.max("set").alias("_high"), F.max("about").alias("_about"))
    shared = shared.where("_low != _high and _about is not null").select("sig")
    rows = rows.join(shared.hint("shuffle_hash"), "sig").distinct()
    by = Window.partitionBy("sig")
    rows = rows.withColumn("_size", F.count("*").over(by)).withColumn("_hub", F.min(F.struct("set", "about")).over(by))
    size = F.shiftright("about", 32)
    rows = write_out(
        rows.select(
            "sig", "set", size.alias("n"), (F.col("about") % 2).alias("band"),
            F.shiftright(F.col("about") % (1 << 32), 1).alias("spare"), "_size",
            F.col("_hub.set").alias("hub"), F.shiftright("_hub.about", 32).alias("hub_n"),
        )
    )
    # a set needs the first of its crowded signatures only, in one order for all sets
    busy = rows.where(F.col("_size") > crowded)
    own = Window.partitionBy("set", "band")
    busy = busy.withColumn("_held", F.count("*").over(own)).withColumn("_at", F.row_number().over(own.orderBy("_size", "sig")))
    busy = busy.where("_at <= _held - spare")
    columns = ["sig", "set", "n", "hub", "hub_n"]
    kept = write_out(rows.where(F.col("_size") <= crowded).select(columns).union(busy.select(columns)))
    # many signatures have the same sets; one of them stands for all
    prints = kept.groupBy("sig").agg(
        F.count("*").alias("n"), F.min("hub").alias("hub"), F.bit_xor(F.xxhash64("set")).alias("x"), F.bit_xor(F.xxhash64("set", F.lit(1))).alias("y")
    )
    one = prints.groupBy("n", "hub", "x", "y").agg(F.min("sig").alias("sig")).select("sig")
    return write_out(kept.join(one, "sig", "left_semi"))


def keyed(df: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """Join with a table of keys: broadcast if it was counted to be small."""
    keys = write_out(keys)
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, how)


def linked(pairs: DataFrame, sets: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of sets that are similar. Sketches rule out most others before any set is fetched."""
    for end in "ab":
        pairs = pairs.join(sets.select(F.col("set").alias(end), F.col("n").alias(f"n{end}"), F.col("wide").alias(f"wide_{end}")), end)

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            rows = np.arange(len(sizes))
            bits = _apart(pa.concat_arrays([batch.column("wide_a"), batch.column("wide_b")]), rows, rows + len(rows))
            yield batch.select(["a", "b"]).filter(pa.array(bits * (100 + percent) <= sizes * (100 - percent)))

    pairs = pairs.where(_alike_in_size("na", "nb", percent)).select("a", "b", "na", "nb", "wide_a", "wide_b")
    pairs = write_out(pairs.mapInArrow(possible, "a long, b long"))
    wanted = pairs.select(F.col("a").alias("set")).union(pairs.select(F.col("b").alias("set"))).distinct()
    texts = keyed(docs.select("text", F.xxhash64("text").alias("text_hash")), sets.join(wanted, "set").select("text_hash").distinct(), "text_hash", "left_semi")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for piece in pieces(batches, limit=PIECE):
            elements, bounds = shingle_sets(piece)
            names, contents = [], []
            for i in np.flatnonzero(np.diff(bounds)).tolist():
                own = elements[bounds[i] : bounds[i + 1]]
                name = set_number(own)
                if name not in seen:
                    seen.add(name)
                    names.append(name)
                    contents.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(contents, pa.binary())], names=["set", "elements"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    contents = write_out(texts.select("text").mapInArrow(fetch, "set long, elements binary").groupBy("set").agg(F.first("elements").alias("elements")))
    with_a = pairs.join(contents.select(F.col("set").alias("a"), F.col("elements").alias("x")), "a")
    with_both = with_a.join(contents.select(F.col("set").alias("b"), F.col("elements").alias("y")), "b")
    return with_both.mapInArrow(compare, "a long, b long")


def open_pairs(
    members: DataFrame, found: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK, nearest: int | None = None
) -> DataFrame:
    """Pairs of a group that are in different components and that their sketches do not rule out.

    A large group is dealt into blocks, and each two blocks are a task's work. With ``nearest`` a set is looked at in its
    largest group only, and gives only the pairs with so many sets whose sketches are nearest to its own: most of what links
    at all links there, and then is one component.
    """
    rest = members.where("set != hub").select("sig", "set")
    rest = rest.join(found.select(F.col("node").alias("set"), "component"), "set", "left")
    rest = rest.withColumn("component", F.coalesce("component", "set"))
    by = Window.partitionBy("sig")
    for name, value in (("_low", F.min("component")), ("_high", F.max("component")), ("_size", F.count("*"))):
        rest = rest.withColumn(name, value.over(by))
    rest = rest.where("_low != _high").drop("_low", "_high")
    if nearest is not None:  # each set in its largest group
        largest = Window.partitionBy("set").orderBy(F.desc("_size"), "sig")
        rest = rest.withColumn("_at", F.row_number().over(largest)).where("_at = 1").drop("_at")
    parts = F.ceil(F.col("_size") / block)
    rest = rest.withColumn("_own", F.pmod(F.xxhash64("set"), parts)).withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rest = rest.select(
        "sig", "set", "component", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "_own"
    ).join(sets.select("set", "n", "wide", *_WORDS), "set")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if left is None else [left, batch]).combine_chunks()
            batch = table.to_batches()[0]
            keys = [batch.column(c).to_numpy() for c in ("sig", "i", "j")]
            last = np.flatnonzero(~np.logical_and.reduce([k == k[-1] for k in keys]))
            cut = last[-1] + 1 if len(last) else 0
            yield from slices(batch.slice(0, cut))
            left = batch.slice(cut)
        if left is not None:
            yield from slices(left)

    def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """A few groups at a time, or one large group: what a task holds grows with the pairs of a slice."""
        keys = [batch.column(c).to_numpy() for c in ("sig", "i", "j")]
        heads = np.flatnonzero(np.logical_or.reduce([np.diff(k, prepend=k[:1] - 1) != 0 for k in keys])) if batch.num_rows else []
        start = 0
        for head in [*heads[1:], batch.num_rows]:
            if head - start >= SLICE_ROWS or head == batch.num_rows > start:
                yield side_by_side(batch.slice(start, head - start))
                start = head

    def side_by_side(batch: pa.RecordBatch) -> pa.RecordBatch:
        sig, i, j, own, component, name, n = (batch.column(c).to_numpy() for c in ("sig", "i", "j", "_own", "component", "set", "n"))
        bits = np.stack([batch.column(w).to_numpy() for w in _WORDS], axis=1).view(np.uint64)
        head = np.concatenate([[True], (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        group = np.cumsum(head)
        at, found = np.arange(len(sig) - 1), [np.zeros((3, 0), np.int32)]
        for k in range(1, len(sig)):
            at = at[at + k < len(sig)]
            at = at[group[at] == group[at + k]]
            if not len(at):
                break
            other = at + k
            ok = (component[at] != component[other]) & ((i[at] == j[at]) | (own[at] != own[other]))
            ok &= np.minimum(n[at], n[other]) * 100 >= np.maximum(n[at], n[other]) * percent
            x, y = at[ok], other[ok]
            differ = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            ok = differ * (100 + percent) <= (n[x] + n[y]) * (100 - percent)
            found.append(np.stack([x[ok], y[ok], differ[ok]]).astype(np.int32))
        x, y, differ = np.concatenate(found, axis=1)
        a, b = np.minimum(name[x], name[y]), np.maximum(name[x], name[y])
        order = np.lexsort((b, a))
        order = order[np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])[: len(order)]]
        x, y, differ = x[order], y[order], differ[order]
        keep = _apart(batch.column("wide"), x, y) * (100 + percent) <= (n[x] + n[y]) * (100 - percent)
        x, y, differ = x[keep], y[keep], differ[keep]
        if nearest is not None:
            ends, both, pair = np.concatenate([name[x], name[y]]), np.tile(differ, 2), np.tile(np.arange(len(x)), 2)
            order = np.lexsort((both, ends))
            first = np.searchsorted(ends[order], ends[order])
            chosen = np.unique(pair[order[np.arange(len(order)) - first < nearest]])
            x, y = x[chosen], y[chosen]
        pairs = np.sort(np.stack([name[x], name[y]], axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    together = rest.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return together.mapInArrow(compare, "a long, b long").distinct()


def _apart(sketches: pa.Array, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which the sketches of rows x and y differ, for whole arrays of pairs with the same two lengths at a time."""
    size = pc.binary_length(sketches).to_numpy().astype(np.int64) // 8
    out = np.zeros(len(x), np.int64)
    matrix, place = {}, np.zeros(len(size), np.int64)
    for width in np.unique(size[np.concatenate([x, y])]).tolist():
        rows = np.flatnonzero(size == width)
        place[rows] = np.arange(len(rows))
        matrix[width] = np.frombuffer(b"".join(sketches.take(pa.array(rows)).to_pylist()), np.uint64).reshape(-1, width)
    for p in matrix:
        for q in matrix:
            at = np.flatnonzero((size[x] == p) & (size[y] == q))
            step = max(1, (8 << 20) // (8 * max(p, q)))
            for part in (at[k : k + step] for k in range(0, len(at), step)):
                a, b = matrix[p][place[x[part]]], matrix[q][place[y[part]]]
                while a.shape[1] > b.shape[1]:
                    a = a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2 :]
                while b.shape[1] > a.shape[1]:
                    b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
                out[part] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return out


def near_duplicates(docs: DataFrame, percent: int = 75, crowded: int = CROWDED, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest id that links reach, the row's own included. Texts are lower-cased (A to Z) and cut at ASCII
    white space; a text of fewer than five words is one shingle. Null and empty texts have no shingle, link with nothing
    and are their own component. Repeated rows and equal sets are one component. Null ids are passed over in the minimum; a
    component of null ids only has a null id. Other columns are not looked at. Sets are named by 64-bit hashes.
    """
    rows = write_out(document_sets(docs))
    sets = write_out(
        rows.where("set is not null").groupBy("set").agg(
            F.first("n").alias("n"), F.first("text_hash").alias("text_hash"), F.min("doc_id").alias("least"),
            *[F.first(w).alias(w) for w in ["wide", *_WORDS]],
        )
    )
    members = memberships(signature_rows(docs, percent), percent, crowded)
    hubs = members.where("set != hub").where(_alike_in_size("n", "hub_n", percent))
    hubs = hubs.select(F.col("hub").alias("a"), F.col("set").alias("b")).distinct()
    links = write_out(linked(hubs, sets, docs, percent))
    found = write_out(components(links))
    for nearest in (NEAREST, None):
        more = linked(open_pairs(members, found, sets, percent, block, nearest), sets, docs, percent)
        links = write_out(links.union(more))
        found = write_out(components(links))
    named = sets.join(found.select(F.col("node").alias("set"), "component"), "set", "left")
    named = named.withColumn("component", F.coalesce("component", "set"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("set", "component_id")
    out = rows.select("doc_id", "set", F.col("n").alias("n_shingles")).join(named, "set", "left")
    own = F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))

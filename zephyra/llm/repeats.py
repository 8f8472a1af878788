"""Stretches of 50 bytes that an earlier document has too are removed.

Every window of 50 bytes has an anchor: the 25 bytes inside it with the smallest hash. Equal windows have equal anchors at equal
places, so only windows around an anchor that several documents share can repeat. Anchors meet in one shuffle; those that are
shared go back to their documents and fetch their context, the bytes that windows around them can reach. The contexts of one
anchor then meet. Their common part becomes one symbol, a suffix array over the rest puts equal windows side by side, and the
smallest document of each run of equal windows keeps it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyra.llm.suffixes import suffix_array
from zephyra.llm.texts import MIX, carried, mixed, pieces, prefix_sums, ranges, span_hashes
from zephyra.plans.tables import write_out

LENGTH = 50
GRAM = 25
#: Bytes of a window beyond its anchor, on either side.
REACH = LENGTH - GRAM
_WIDTH = 2 * REACH + GRAM
#: Order of a document without id: after all others.
LAST = (1 << 63) - 1
#: Symbols that go into one suffix array, about.
SYMBOLS = 200_000
#: Anchors with more contexts than this are compared window by window instead.
CROWDED = 50_000
PIECE = 1 << 20
#: An anchor that more documents of a task than this have is spread over many tasks.
BUSY = 64
_SEVERAL = (1 << 52) - 1
_PAD = 256
_PROBE = 4


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place and text of every anchor; of equal hashes in a window the first counts."""
    n, span = len(data), REACH + 1
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.astype(np.uint64), none, none
    sums, at = prefix_sums(data), np.arange(n - GRAM + 1)
    hashes = span_hashes(sums, at, at + GRAM)
    # the place of the smallest hash of each window: minima over doubling stretches, the left one wins ties
    least, place, width = hashes, at, 1
    while width < span:
        step = min(width, span - width)
        right = least[step:] < least[:-step]
        place = np.where(right, place[step:], place[:-step])
        least = np.minimum(least[step:], least[:-step])
        width += step
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(place)]
    place = place[np.arange(len(place)) + LENGTH <= bounds[text + 1]]
    place = place[np.concatenate([[True], place[1:] != place[:-1]])] if len(place) else place
    place = np.unique(place)
    return hashes[place], place, np.searchsorted(bounds, place, side="right") - 1


def _contexts(place: np.ndarray, text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the bytes that windows around each anchor can reach begin and end."""
    return np.maximum(place - REACH, bounds[text]), np.minimum(place + LENGTH, bounds[text + 1])


def anchor_rows(docs: DataFrame, busy: int = BUSY) -> DataFrame:
    """``key, doc, mark`` for each anchor of ``docs(doc, text)``. A mark packs a hash of the context (52 bits) and a side.

    All rows of a key have side 0, but those of an anchor that more than ``busy`` documents of a task have: they get sides
    that spread them, and their smallest document stands for them at side 0, with all bits of the context set (``_SEVERAL``).
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=4 * PIECE):
            keys, docs_of, contents = [], [], []
            for part in pieces(iter([piece.rows]), limit=PIECE):
                hashes, place, text = anchors(part.data, part.bounds)
                low, high = _contexts(place, text, part.bounds)
                content = span_hashes(prefix_sums(part.data), low, high) + (place - low).astype(np.uint64) * MIX
                keys.append(hashes.view(np.int64))
                docs_of.append(part.column("doc")[text])
                contents.append((content >> np.uint64(12)).astype(np.int64))
            key, doc, content = map(np.concatenate, (keys, docs_of, contents))
            order = np.lexsort((doc, key))
            key, doc, content = key[order], doc[order], content[order]
            head = np.diff(key, prepend=key[:1] - 1) != 0
            group = np.cumsum(head) - 1
            crowd = (np.bincount(group, minlength=1) > busy)[group] if len(key) else head
            lead = head & crowd
            side = np.where(crowd, 1 + (doc.view(np.uint64) % np.uint64(4095)).astype(np.int64), 0)
            mark = content << 12 | side
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([key, key[lead]])),
                    pa.array(np.concatenate([doc, doc[lead]])),
                    pa.array(np.concatenate([mark, np.full(int(lead.sum()), -4096)])),
                ],
                names=["key", "doc", "mark"],
            )

    return docs.mapInArrow(find, "key long, doc long, mark long")


def shared_anchors(rows: DataFrame) -> DataFrame:
    """``doc, gone, open``: for each document the anchors that another one has too. If all documents have one context around
    an anchor, the smallest keeps it and for the others it is ``gone``; if contexts differ it is ``open`` for all."""
    rows = rows.withColumn("side", F.col("mark").bitwiseAND(F.lit(4095))).withColumn("content", F.shiftrightunsigned("mark", 12))
    by = Window.partitionBy("key", "side")
    for name, value in (("_low", F.min("doc")), ("_high", F.max("doc")), ("_least", F.min("content")), ("_most", F.max("content"))):
        rows = rows.withColumn(name, value.over(by))
    several = (F.col("side") > 0) | (F.col("_least") != F.col("_most")) | (F.col("_most") == _SEVERAL)
    rows = rows.where((F.col("side") > 0) | (F.col("_low") != F.col("_high"))).where(several | (F.col("doc") != F.col("_low")))
    return rows.groupBy("doc").agg(
        F.collect_set(F.when(~several, F.col("key"))).alias("gone"), F.collect_set(F.when(several, F.col("key"))).alias("open")
    )


def _among(lists: pa.ListArray, hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether the hash of each anchor is in the list of its text."""
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    wanted = (mixed(lists.flatten().to_numpy().view(np.uint64) + mixed(owner.astype(np.uint64))))
    return np.isin(mixed(hashes + mixed(text.astype(np.uint64))), wanted)


def contexts(docs: DataFrame) -> DataFrame:
    """``key, left, context, docs, places, sizes`` for ``docs(doc, tag, text, gone, open)``.

    A row with a context belongs to an open anchor: ``left`` is the number of bytes before it, and ``docs`` and ``places`` are
    the documents of a task that have it there. A place packs the tag of the text and the start of the anchor. A row without
    context has merged stretches around gone anchors: ``places`` are their starts and ``sizes`` their lengths.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=PIECE):
            hashes, place, text = anchors(piece.data, piece.bounds)
            doc, tag = piece.column("doc"), piece.column("tag").astype(np.int64) << 40
            gone = _among(piece.rows.column("gone"), hashes, text)
            low, high = _contexts(place[gone], text[gone], piece.bounds)
            if len(low):
                # texts lie one after another, so no stretch joins the next text's unless they touch
                reach = np.maximum.accumulate(high)
                fresh = np.concatenate([[True], (low[1:] > reach[:-1]) | (text[gone][1:] != text[gone][:-1])])
                first = np.flatnonzero(fresh)
                last = np.append(first[1:], len(low)) - 1
                owner = text[gone][first]
                one = pa.array([0, len(first)], pa.int32())
                yield _context_rows(
                    pa.array([None], pa.int64()), pa.array([None], pa.int32()), pa.array([None], pa.binary()),
                    *[pa.ListArray.from_arrays(one, pa.array(x)) for x in (doc[owner], tag[owner] | (low[first] - piece.bounds[owner]), reach[last] - low[first])],
                )
            keep = _among(piece.rows.column("open"), hashes, text)
            hashes, place, text = hashes[keep].view(np.int64), place[keep], text[keep]
            if not len(place):
                continue
            low, high = _contexts(place, text, piece.bounds)
            content = span_hashes(prefix_sums(piece.data), low, high).view(np.int64)
            order = np.lexsort((content, place - low, hashes))
            cell = np.stack([hashes, place - low, content])[:, order]
            head = np.flatnonzero(np.concatenate([[True], (cell[:, 1:] != cell[:, :-1]).any(axis=0)]))
            bounds = pa.array(np.append(head, len(order)), pa.int32())
            places = tag[text] | (place - piece.bounds[text])
            data = piece.data.tobytes()
            first = order[head]
            yield _context_rows(
                pa.array(hashes[first]),
                pa.array((place - low)[first].astype(np.int32)),
                pa.array([data[a:b] for a, b in zip(low[first].tolist(), high[first].tolist(), strict=True)], pa.binary()),
                pa.ListArray.from_arrays(bounds, pa.array(doc[text][order])),
                pa.ListArray.from_arrays(bounds, pa.array(places[order])),
                pa.array([None] * len(first), pa.list_(pa.int64())),
            )

    schema = "key long, left int, context binary, docs array<long>, places array<long>, sizes array<long>"
    return docs.mapInArrow(cut, schema)


def _context_rows(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=["key", "left", "context", "docs", "places", "sizes"])


def window_owners(matrix: np.ndarray, group: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each context and window start, the smallest document of any context of its group with the same window.

    ``matrix``: a context per row, aligned at the anchor, ``_PAD`` beyond the text; ``group`` ascends; ``least``: the smallest
    document of each context. Windows that reach beyond the text get the document of their own row.
    """
    head = np.flatnonzero(np.diff(group, prepend=-1))
    size = np.diff(np.append(head, len(group)))
    equal = np.logical_and.reduceat(matrix == matrix[np.repeat(head, size)], head, axis=0)
    # the columns around the anchor in which all contexts of the group agree: from begin up to end
    begin = REACH - np.argmin(np.concatenate([equal[:, :REACH][:, ::-1], np.zeros((len(head), 1), bool)], axis=1), axis=1)
    end = REACH + GRAM + np.argmin(np.concatenate([equal[:, REACH + GRAM :], np.zeros((len(head), 1), bool)], axis=1), axis=1)
    owners = np.repeat(least[:, None], REACH + 1, axis=1)
    smallest = np.repeat(np.minimum.reduceat(least, head), size)
    row_begin, row_end = np.repeat(begin, size), np.repeat(end, size)
    starts = np.arange(REACH + 1)
    inside = (starts >= row_begin[:, None]) & (starts + LENGTH <= row_end[:, None])
    owners = np.where(inside, smallest[:, None], owners)
    # one context, or two, have nothing more in common; of more, a row needs as many bytes on either side as others may share
    several = np.repeat(size, size) > 2
    left = np.where(several, _shared_bytes(matrix, group, row_begin, -1), 0)
    right = np.where(several, _shared_bytes(matrix, group, row_end, 1), 0)
    ordered = np.flatnonzero((left > 0) | (right > 0))
    total = np.cumsum(left[ordered] + 2 + right[ordered])
    cuts = [0]
    while cuts[-1] < len(ordered):
        stop = int(np.searchsorted(total, (total[cuts[-1] - 1] if cuts[-1] else 0) + SYMBOLS)) + 1
        while stop < len(ordered) and group[ordered[stop]] == group[ordered[stop - 1]]:
            stop += 1
        cuts.append(min(stop, len(ordered)))
        rows = ordered[cuts[-2] : cuts[-1]]
        of_rows = _by_suffixes(matrix[rows], group[rows], least[rows], row_begin[rows], row_end[rows], left[rows], right[rows])
        owners[rows] = np.minimum(owners[rows], of_rows)
    return owners


def _shared_bytes(matrix: np.ndarray, group: np.ndarray, edge: np.ndarray, way: int) -> np.ndarray:
    """How many bytes from the common part outwards (``way``) a row may share with another of its group: none, fewer than
    ``_PROBE``, or all. ``edge`` is where the common part begins or ends."""
    room = edge if way < 0 else _WIDTH - edge
    at = edge - 1 if way < 0 else edge
    seen = []
    for n in (1, _PROBE):
        columns = at[:, None] + way * np.arange(n)
        inside = (columns >= 0) & (columns < _WIDTH)
        values = np.where(inside, np.take_along_axis(matrix, np.clip(columns, 0, _WIDTH - 1), axis=1), _PAD + 1)
        key = group.astype(np.int64)
        for k in range(n):
            key = key * 1024 + values[:, k]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        seen.append(count[inverse] > 1)
    return np.where(seen[0], np.where(seen[1], room, np.minimum(room, _PROBE - 1)), 0)


def _by_suffixes(
    matrix: np.ndarray, group: np.ndarray, least: np.ndarray, begin: np.ndarray, end: np.ndarray, left: np.ndarray, right: np.ndarray
) -> np.ndarray:
    """``window_owners`` by one suffix array over all rows: the ``left`` bytes before the common part of a group, a symbol that
    stands for that part, the ``right`` bytes behind it, and a break."""
    lengths = left + 2 + right
    base = np.cumsum(lengths) - lengths
    core = base + left
    symbols = np.ones(int(lengths.sum()) + 1, np.int64)
    symbols[-1] = 0
    row = np.repeat(np.arange(len(begin)), left)
    symbols[ranges(base, left)] = matrix[row, ranges(begin - left, left)] + 2
    _, number = np.unique(group, return_inverse=True)
    symbols[core] = _PAD + 3 + number
    row = np.repeat(np.arange(len(begin)), right)
    symbols[ranges(core + 1, right)] = matrix[row, ranges(end, right)] + 2
    order = np.array(suffix_array(symbols.tolist()), np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    padded = np.concatenate([symbols, np.zeros(_WIDTH + 2, np.int64)])

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that two suffixes share, up to a break."""
        out, live = np.zeros(len(a), np.int64), np.arange(len(a))
        for k in range(LENGTH + 2):
            mine = padded[a[live] + k]
            live = live[(mine == padded[b[live] + k]) & (mine > 1)]
            out[live] = k + 1
        return out

    def least_of_runs(rows: np.ndarray, need: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Rows in order of their suffix: those that share all they need with the one before form a run."""
        run = np.cumsum(np.concatenate([[True], shared < need[1:]])) - 1
        return np.minimum.reduceat(least[rows], np.flatnonzero(np.diff(run, prepend=-1)))[run]

    owners = np.repeat(least[:, None], REACH + 1, axis=1)
    # windows that start before the common part
    count = np.clip(np.minimum(begin, REACH + 1) - (begin - left), 0, None)
    rows, column = np.repeat(np.arange(len(begin)), count), ranges(begin - left, count)
    if len(rows):
        sort = np.argsort(rank[core[rows] - begin[rows] + column])
        rows, column = rows[sort], column[sort]
        at = core[rows] - begin[rows] + column
        need = begin[rows] - column + 1 + np.maximum(0, column + LENGTH - end[rows])
        owners[rows, column] = least_of_runs(rows, need, common(at[:-1], at[1:]))
    # windows that start inside it
    rows = np.argsort(rank[core])
    shared = common(core[rows][:-1], core[rows][1:])
    for column in range(int(begin.min()), REACH + 1):
        need = 1 + np.maximum(0, column + LENGTH - end[rows])
        own = least_of_runs(rows, need, shared)
        use = begin[rows] <= column
        owners[rows[use], column] = own[use]
    return owners


def _spans(owners: np.ndarray, left: np.ndarray, size: np.ndarray, row: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """``doc, place, size`` for each occurrence (``row, doc, place``) and each run of its windows that an earlier document owns."""
    start = np.arange(REACH + 1)
    valid = (start >= REACH - left[:, None]) & (start + LENGTH <= (REACH - left + size)[:, None])
    hit = valid[row] & (owners[row] < doc[:, None])
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    which, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    columns = [doc[which], place[which] - REACH + first, last - first + LENGTH - 1]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc", "place", "size"])


def repeated_spans(found: DataFrame) -> DataFrame:
    """``doc, place, size`` for ``found(key, left, context, docs, places)``, by suffix arrays over the contexts of many anchors."""

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_over = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if left_over is not None:
                batch = pa.Table.from_batches([left_over, batch]).combine_chunks().to_batches()[0]
            key = batch.column("key").to_numpy()
            last = np.flatnonzero(key != key[-1])
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield resolve(batch.slice(0, cut))
            left_over = batch.slice(cut)
        if left_over is not None:
            yield resolve(left_over)

    def resolve(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, left = batch.column("key").to_numpy(), batch.column("left").to_numpy().astype(np.int64)
        text = batch.column("context")
        size = pc.binary_length(text).to_numpy().astype(np.int64)
        data = np.frombuffer(b"".join(text.to_pylist()), np.uint8)
        lists = batch.column("docs")
        count = lists.value_lengths().to_numpy().astype(np.int64)
        doc, place = lists.flatten().to_numpy(), batch.column("places").flatten().to_numpy()
        row = np.repeat(np.arange(len(key)), count)
        least = np.minimum.reduceat(doc, np.cumsum(count) - count)
        matrix = np.full((len(key), _WIDTH), _PAD, np.int16)
        matrix[np.repeat(np.arange(len(key)), size), ranges(REACH - left, size)] = data
        # contexts of several tasks that are the same count once
        _, number = np.unique(key, return_inverse=True)
        cells = np.concatenate([number[:, None].astype(np.int32).view(np.int16).reshape(len(key), 2), matrix], axis=1)
        packed = np.ascontiguousarray(cells).view([("", np.void, cells.shape[1] * 2)]).ravel()
        _, first, inverse = np.unique(packed, return_index=True, return_inverse=True)
        smallest = np.full(len(first), LAST)
        np.minimum.at(smallest, inverse, least)
        by_group = np.argsort(number[first], kind="stable")
        owners = np.empty((len(first), REACH + 1), np.int64)
        owners[by_group] = window_owners(matrix[first[by_group]], number[first[by_group]], smallest[by_group])
        return _spans(owners[inverse], left, size, row, doc, place)

    return found.repartition("key").sortWithinPartitions("key").mapInArrow(order, "doc long, place long, size long")


def crowded_spans(found: DataFrame) -> DataFrame:
    """As ``repeated_spans``, for anchors with very many contexts: each window is a key, with a pre-aggregated minimum."""
    start = F.explode(F.sequence(F.lit(0), F.lit(REACH))).alias("start")
    each = found.select("left", F.length("context").alias("size"), "context", "docs", "places", start)
    each = each.where(f"start >= {REACH} - left and start + {LENGTH} <= {REACH} - left + size")
    window = F.expr(f"substring(context, start - {REACH} + left + 1, {LENGTH})")
    each = each.select("start", "docs", "places", window.alias("window"))
    owners = each.groupBy("window").agg(F.min(F.array_min("docs")).alias("owner"))
    each = each.join(owners, "window").select("owner", "start", F.explode(F.arrays_zip("docs", "places")).alias("at"))
    each = each.where("owner < at.docs")
    place = F.col("at.places") - REACH + F.col("start")
    return each.select(F.col("at.docs").alias("doc"), place.alias("place"), F.lit(LENGTH).cast("long").alias("size"))


def removed(docs: DataFrame, crowded: int = CROWDED, busy: int = BUSY, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of ``docs(doc_id, text)``.

    Texts are UTF-8 bytes, null is empty. A byte goes if a stretch of 50 bytes that covers it also starts in a document with
    a smaller id; stretches are judged on the input. Texts under 50 bytes stay whole. Rows that share an id do not remove from
    each other; a null id counts as larger than all others. Other columns are dropped; with ``carry`` those named are
    returned instead of the id, as ``row``, so that no name of theirs can clash, and the text that is left as ``kept``, without
    the rest of a character that was cut.
    """
    plain = docs.select(
        carried(carry) if carry else F.col("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
        # tells texts of one id apart
        (F.xxhash64("text").bitwiseAND(F.lit(0x7FFF))).alias("tag"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    keys = write_out(shared_anchors(anchor_rows(plain.select("doc", "text"), busy)))
    every = write_out(contexts(plain.select("doc", "tag", "text").join(keys, "doc")))
    found = every.where("key is not null").drop("sizes")
    crowd = write_out(found.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > crowded).select("key"))
    spans = repeated_spans(found if crowd.isEmpty() else found.join(crowd, "key", "left_anti"))
    if not crowd.isEmpty():
        spans = spans.union(crowded_spans(found.join(crowd, "key", "left_semi")))
    sure = every.where("key is null").select(F.explode(F.arrays_zip("docs", "places", "sizes")).alias("_at"))
    spans = spans.union(sure.select("_at.docs", "_at.places", "_at.sizes"))
    spans = write_out(spans.groupBy("doc").agg(F.collect_set(F.struct("place", "size")).alias("spans")))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=PIECE):
            tags, out = piece.column("tag"), []
            for i, spans_of in enumerate(piece.rows.column("spans")):
                data = piece.data[piece.bounds[i] : piece.bounds[i + 1]]
                mark = np.zeros(len(data) + 1, np.int32)
                if spans_of.is_valid:
                    place, size = (spans_of.values.field(k).to_numpy() for k in range(2))
                    own = place >> 40 == tags[i]
                    begin = place[own] & ((1 << 40) - 1)
                    np.add.at(mark, begin, 1)
                    np.add.at(mark, begin + size[own], -1)
                gone = np.cumsum(mark[:-1]) > 0
                left = data[~gone].tobytes()
                runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
                out.append((len(data), int(gone.sum()), runs, hashlib.sha256(left).hexdigest(), left.decode(errors="ignore") if carry else None))
            columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([piece.rows.column(0), *columns], names=schema.names)

    given = plain.join(spans, "doc", "left").select("row" if carry else "doc_id", "tag", "text", "spans")
    kinds = [pa.int64()] * 3 + [pa.string()] * 2
    fields = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType(), "kept": T.StringType()}
    schema = T.StructType([given.schema[0], *[T.StructField(*f) for f in fields.items()]])
    made = given.mapInArrow(keep, schema)
    return made if carry else made.drop("kept")

"""Token ids in binary files: a fixed number of bits for each id.

Every id takes as many bits as the largest id of the vocabulary needs, so the place of an id follows from its number and any
stretch can be unpacked by whole arrays. A file is

* a header: ``ZTOKENS1``, bits of an id, ids of a block (two 32-bit numbers);
* blocks, each of so many ids (the last may have fewer), packed from the lowest bit on and filled up to a whole byte;
* the offset of each block, and of the end of the last, in the file (64 bits each);
* for each document the number of ids up to its end (64 bits), then its id (64 bits), then one byte that is 0 if it has no id;
* a footer: number of ids, number of documents, offset of the tables (64 bits each), ``ZTOKENS1``.

All numbers are little-endian. Bytes after the footer are a line end at most. Documents are in ascending order of id over the
files of a folder, in order of their names. Files are written and read by Spark alone, so they may lie in any store.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from zephyra.llm.texts import LOWER, SPACE, pieces, ranges
from zephyra.plans.tables import write_out
from zephyra.session import shared_dir

MAGIC = b"ZTOKENS1"
HEADER, FOOTER = struct.Struct("<8sII"), struct.Struct("<QQQ8s")
#: Ids of a block. A multiple of eight, so that a full block ends at a whole byte.
BLOCK_IDS = 1 << 16
#: A file is closed after the document that reaches so many ids.
FILE_IDS = 1 << 22
#: Text of a task, about.
TASK_BYTES = 32 << 20
#: Distinct words whose ids a task remembers at once.
KNOWN_WORDS = 1_000_000
#: Words that the library gets at once.
AT_ONCE = 4000
#: Files whose sizes are summed in one group.
_GROUP = 4096

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True

_tokenizers: dict[str, Tokenizer] = {}


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The lowest ``bits`` bits of each id, one after another, from the lowest bit on."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit into {bits} bits")
    planes = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
    return np.packbits(planes.ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, start: int, stop: int) -> np.ndarray:
    """The ids of places ``start`` to ``stop`` of a packed block, as unsigned 32-bit numbers."""
    at = np.arange(start, stop, dtype=np.int64) * bits
    low = start * bits >> 3
    wide = np.frombuffer(data, np.uint8)[low : (stop * bits + 7 >> 3)]
    wide = np.concatenate([wide, np.zeros(5, np.uint8)]).astype(np.uint64)
    byte = (at >> 3) - low
    value = wide[byte]
    for k in range(1, (bits + 14) // 8):  # bytes that an id which starts inside a byte can reach
        value |= wide[byte + k] << np.uint64(8 * k)
    return (value >> (at & 7).astype(np.uint64) & np.uint64((1 << bits) - 1)).astype("<u4")


def file_bytes(ids: np.ndarray, sizes: np.ndarray, names: list[int | None], bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    """A file of the documents ``names``, of ``sizes`` ids each."""
    parts, offsets = [HEADER.pack(MAGIC, bits, block_ids)], []
    at = HEADER.size
    for start in range(0, len(ids), block_ids):
        offsets.append(at)
        parts.append(pack(ids[start : start + block_ids], bits))
        at += len(parts[-1])
    known = np.array([n is not None for n in names], np.uint8)
    parts += [
        np.array([*offsets, at], "<u8").tobytes(),
        np.cumsum(sizes).astype("<u8").tobytes(),
        np.array([n or 0 for n in names], "<i8").tobytes(),
        known.tobytes(),
        FOOTER.pack(len(ids), len(names), at, MAGIC),
    ]
    return b"".join(parts)


class TokenFile:
    """A file that was read: ``ends`` (ids up to the end of each document), ``doc_ids``, and any stretch of its ids."""

    def __init__(self, content: bytes):
        self.content = memoryview(content)
        tail = content[-len(MAGIC) - 2 :].rfind(MAGIC)  # a line end may follow
        foot = len(content) - len(content[-len(MAGIC) - 2 :]) + tail + len(MAGIC) - FOOTER.size if tail >= 0 else -1
        if foot < HEADER.size:
            raise ValueError("not a file of token ids")
        self.n_ids, n_docs, tables, end = FOOTER.unpack_from(content, foot)
        magic, self.bits, self.block_ids = HEADER.unpack_from(content, 0)
        blocks = -(-self.n_ids // self.block_ids)
        if magic != MAGIC or end != MAGIC or tables + 8 * (blocks + 1) + 17 * n_docs != foot:
            raise ValueError("not a file of token ids, or cut short")
        self.offsets = np.frombuffer(content, "<u8", blocks + 1, tables)
        at = tables + 8 * (blocks + 1)
        self.ends = np.frombuffer(content, "<u8", n_docs, at).astype(np.int64)
        known = np.frombuffer(content, np.uint8, n_docs, at + 16 * n_docs)
        self.doc_ids = pa.array(np.frombuffer(content, "<i8", n_docs, at + 8 * n_docs), pa.int64(), mask=known == 0)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids of places ``start`` to ``stop`` of the file. Only the blocks that hold them are looked at."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        found = [np.zeros(0, "<u4")]
        for block in range(start // self.block_ids, -(-stop // self.block_ids)):
            first = block * self.block_ids
            data = self.content[int(self.offsets[block]) : int(self.offsets[block + 1])]
            found.append(unpack(data, self.bits, max(start - first, 0), min(stop - first, self.block_ids)))
        return np.concatenate(found)

    def document(self, number: int) -> np.ndarray:
        """The ids of the document of this number, from 0."""
        return self.ids(int(self.ends[number - 1]) if number else 0, int(self.ends[number]))


def parts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of text that the tokenizer works out independently of each other: starts, ends, and ``first`` as in ``words``.

    White space separates, and so does the change between an ASCII letter or digit and one of ``.,;:!?``. That is
    right for tokenizers that drop white space and put letters, digits and other characters into different pre-tokens.
    """
    inside = ~SPACE[data]
    opens = np.ones(len(data) + 1, bool)
    alnum, stop = _ALNUM[data], _STOP[data]
    opens[1:-1] = ~inside[:-1] | (alnum[:-1] & stop[1:]) | (stop[:-1] & alnum[1:])
    opens[bounds] = True
    starts = np.flatnonzero(inside & opens[:-1])
    after = np.ones(len(data), bool)
    after[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (after | opens[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


class WordIds:
    """Ids of words, each worked out once by the library while it is remembered."""

    def __init__(self, tokenizer: Tokenizer, known: int):
        self.tokenizer, self.most = tokenizer, known
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.sizes, self.ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words without white space: of one text of them all, where the offset of an id tells its word."""
        made = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        offsets = np.fromiter((start for start, _ in made.offsets), np.int64, len(made))
        word = np.searchsorted(np.cumsum(lengths), offsets, side="right")
        return np.bincount(word, minlength=len(words)), np.array(made.ids, np.uint32)

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of each distinct word, and the sizes and ids of all known words by place."""
        if len(self.number) + len(words) > self.most:
            self.forget()
        wanted = words.to_pylist()
        new = [w for w in wanted if w not in self.number]
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            for start in range(0, len(new), AT_ONCE):
                sizes, ids = self.encode([w.decode() for w in new[start : start + AT_ONCE]])
                self.sizes.append(sizes)
                self.ids.append(ids)
            self.sizes, self.ids = [np.concatenate(self.sizes)], [np.concatenate(self.ids)]
        place = np.fromiter(map(self.number.__getitem__, wanted), np.int64, len(wanted))
        return place, self.sizes[0], self.ids[0]

    def texts(self, data: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts ``data[bounds[i]:bounds[i + 1]]``, each with ``end_id`` after it, and the number of ids of each."""
        starts, ends, first = parts(data, bounds)
        if data.tobytes().find(b"<|") < 0:  # names of special tokens count in lower case only
            # a letter before a byte above ASCII may be composed with it, which need not have both cases
            alone = np.ones(len(data), bool)
            alone[:-1] = data[1:] < 128
            data = np.where(alone, LOWER[data], data)
        sizes = ends - starts
        edges = pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
        content = pa.py_buffer(data[ranges(starts, sizes)].tobytes())
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, edges, content]).dictionary_encode()
        place, known, pool = self.of(words.dictionary)
        place = place[words.indices.to_numpy()]
        begin, count = (np.cumsum(known) - known)[place], known[place]
        total = np.concatenate([[0], np.cumsum(count)])[first]
        found = pool[ranges(begin, count)]
        return np.insert(found, total[1:], end_id), np.diff(total) + 1


def tokenizer_of(definition: str) -> Tokenizer:
    """One per worker and definition."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        _tokenizers[key] = Tokenizer.from_str(definition)
    return _tokenizers[key]


def write(
    docs: DataFrame, path: str, folder: str, end_id: int, block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS,
    task_bytes: int = TASK_BYTES, known: int = KNOWN_WORDS,
) -> None:
    """Write the ids of ``docs(doc_id, text)`` to ``folder``, in ascending order of id (null first; rows of one id in
    order of a hash of their text).

    ``path`` is a definition for the tokenizers library; bits follow from its vocabulary. Null and empty texts have the end id
    only. A document is never split between files, so a file exceeds ``file_ids`` by its last document at most.
    """
    spark = docs.sparkSession
    definition = Path(path).read_text(encoding="utf-8")  # a fixed public file
    bits = max(1, (max(Tokenizer.from_str(definition).get_vocab_size(with_added_tokens=True) - 1, end_id)).bit_length())
    shared = spark.sparkContext.broadcast(definition)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    weight = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 64)).first()[0] or 0
    order = ["doc_id", "_hash", "_at"]  # no id, and no repeated row, has to be one task
    rows = rows.withColumn("_hash", F.xxhash64("text")).withColumn("_at", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(max(1, -(-int(weight) // task_bytes)), *order).sortWithinPartitions(*order)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds(tokenizer_of(shared.value), known)
        waiting: list[tuple[np.ndarray, np.ndarray, list]] = []
        held = 0

        def close() -> pa.RecordBatch:
            ids, sizes = (np.concatenate([w[k] for w in waiting]) for k in (0, 1))
            content = file_bytes(ids, sizes, [n for w in waiting for n in w[2]], bits, block_ids)
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["value"])

        for piece in pieces(batches):
            ids, sizes = encoder.texts(piece.data, piece.bounds, end_id)
            names, ends = piece.rows.column("doc_id").to_pylist(), np.cumsum(sizes)
            start = 0
            while start < len(names):
                done = int(ends[start - 1]) if start else 0
                # documents up to the one that reaches the size of a file
                stop = min(int(np.searchsorted(ends, done + file_ids - held)) + 1, len(names))
                waiting.append((ids[done : ends[stop - 1]], sizes[start:stop], names[start:stop]))
                held += int(ends[stop - 1]) - done
                start = stop
                if held >= file_ids:
                    yield close()
                    waiting, held = [], 0
        if waiting:
            yield close()

    files = rows.select("doc_id", "text").mapInArrow(made, "value binary")
    # a row is a file; its bytes are written as they are, with a line end after them
    whole = files.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
    whole.option("lineSep", "\n").option("compression", "none").text(folder)


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """``file, number, doc_id, place, n_tokens, ids_crc32, ids`` for each document of the files in ``folder``: the file, its
    number and the place of its first id there, how many ids it has, and the unsigned checksum of them as little-endian
    32-bit numbers; ``ids`` only if asked for."""
    kinds = "file string, number int, doc_id long, place long, n_tokens long, ids_crc32 long"
    kinds += ", ids array<int>" if with_ids else ""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                if not len(content.as_buffer()):
                    continue  # a task without documents may leave an empty file
                file = TokenFile(content.as_buffer().to_pybytes())
                ids = file.ids()
                starts = np.concatenate([[0], file.ends[:-1]])
                raw, n = memoryview(ids.tobytes()), len(file.ends)
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), file.ends.tolist(), strict=True)]
                columns = [
                    pa.array([path.as_py()] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)), file.doc_ids,
                    pa.array(starts, pa.int64()), pa.array(file.ends - starts), pa.array(sums, pa.int64()),
                ]
                names = ["file", "number", "doc_id", "place", "n_tokens", "ids_crc32"]
                if with_ids:
                    edges = pa.array(np.concatenate([[0], file.ends]), pa.int32())
                    columns.append(pa.ListArray.from_arrays(edges, pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "content").mapInArrow(parsed, kinds)


def file_starts(documents: DataFrame) -> DataFrame:
    """``file, start`` for the files of ``read``: the ids of all files before it. One row per file, summed in two levels."""
    part = F.regexp_extract("file", r"part-(\d+)-", 1).cast("long")
    within = F.regexp_extract("file", r"-c(\d+)[^/]*$", 1).cast("long")
    files = documents.groupBy("file").agg(F.sum("n_tokens").alias("_n")).withColumns({"_part": part, "_within": within})
    files = files.withColumn("_group", F.floor(F.col("_part") / _GROUP))
    groups = files.groupBy("_group").agg(F.sum("_n").alias("_sum"))
    groups = groups.select("_group", (F.sum("_sum").over(Window.orderBy("_group")) - F.col("_sum")).alias("_before"))
    inside = Window.partitionBy("_group").orderBy("_part", "_within")
    files = files.withColumn("_own", F.sum("_n").over(inside) - F.col("_n")).join(groups, "_group")
    return files.select("file", (F.col("_own") + F.col("_before")).alias("start"))


def token_files(docs: DataFrame, path: str, end_id: int, **sizes: int) -> DataFrame:
    """Write the ids of ``docs(doc_id, text)`` to files and read them back: ``doc_id, start, n_tokens, ids_crc32``, a row
    for each row of ``docs``.

    ``start`` counts the ids of all documents before, in ascending order of id; null ids come first, repeated ids in order of a
    hash of their text. A null or empty text has one id, ``end_id``. An empty table gives no rows. Ids are integers; other
    columns are not looked at. The files stay in the shared folder, under ``tokens``.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens/{uuid.uuid4().hex}"
    write(docs, path, folder, end_id, **sizes)
    documents = write_out(read(spark, folder))
    found = documents.join(file_starts(documents), "file")
    return found.select("doc_id", (F.col("start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")

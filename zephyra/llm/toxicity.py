"""Toxicity of a text by a factorization machine over hashed terms.

Terms are the words of a text and their beginnings, each counted once, hashed into slots; every term takes part. The score is the
logistic function of a bias, a weight for each slot, and for each pair of slots the inner product of their factors, so that two
terms can mean together what neither means alone. The sum over all pairs takes one pass: half of the squared sum of the factors
less the sum of their squares.

Training is full-batch: a written table holds the slots of a bounded sample of labelled texts, tasks sum the gradients of their
rows, and the driver, which holds the model, takes the step. A slot's step is scaled by its evidence: how far its gradient is from
what rows with labels by chance would give, in standard deviations. So the many terms of few texts, which could tell any
training text from any other, move little, and none is left out. Weights move first; then factors, on what weights leave
unexplained. A fifth of the sample is set aside: on it the scale and the bias of the scores are fitted at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyra.llm.decontaminate import WORD
from zephyra.llm.texts import LOWER, Piece, pieces, prefix_sums, span_hashes, words
from zephyra.plans.tables import write_out

#: At most so many labelled rows are used to fit, those of smallest hash of their id.
TRAINING_ROWS = 40_000
#: Of these one in so many is set aside for the scale of the scores.
SET_ASIDE = 5
#: Beginnings of words, in bytes, that are terms besides the words.
BEGINNINGS = (4, 5)
SLOT_BITS, FACTORS = 18, 4
SLOTS = 1 << SLOT_BITS
#: Rounds in all, and those in which only weights move.
ROUNDS, WEIGHT_ROUNDS = 36, 14
STEP, MOMENTUM, DECAY, START = 0.3, 0.5, 1e-4, 0.02
#: Steps are halved when the mean squared error has grown by so much over its least.
WORSE = 1.1
#: Standard deviations at which a slot takes half a step, and how sharply the steps of others differ.
EVIDENCE, SHARPNESS = 10.0, 6
#: Parts of the bounded sample; a part gives one gradient, and the driver holds one gradient at a time.
PARTS = 4
PIECE = 1 << 20


def terms(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every term of every text, with repeats."""
    data = LOWER[piece.data]
    starts, ends, first = words(data, piece.bounds, WORD)
    sums, text = prefix_sums(data), np.repeat(np.arange(len(piece)), np.diff(first))
    hashes, owners = [span_hashes(sums, starts, ends)], [text]
    for n in BEGINNINGS:
        long = ends - starts > n
        hashes.append(span_hashes(sums, starts[long], starts[long] + n) + np.uint64(n))
        owners.append(text[long])
    return np.concatenate(hashes), np.concatenate(owners)


def slots(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of each text, one text after another, and their bounds."""
    hashes, text = terms(piece)
    both = np.unique(text * SLOTS + (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64))
    return both % SLOTS, np.searchsorted(both // SLOTS, np.arange(len(piece) + 1))


class Machine:
    """``bias``, ``weight`` (slots) and ``factor`` (slots x factors); ``scale`` and ``shift`` of the value."""

    def __init__(self):
        self.bias, self.scale, self.shift, self.paired = 0.0, 1.0, 0.0, False
        self.size, self.least = STEP, np.inf
        self.weight, self.factor = np.zeros(SLOTS, np.float32), np.zeros((SLOTS, FACTORS), np.float32)

    def start(self, share: np.ndarray, seed: int = 11) -> None:
        """Small random factors, smaller for slots that few texts, or nearly all, have."""
        spread = 2 * np.sqrt(share * (1 - share))
        self.paired = True
        self.factor = (np.random.default_rng(seed).normal(0, START, (SLOTS, FACTORS)) * spread[:, None]).astype(np.float32)

    def margins(self, slot: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the value before scale and logistic function, and the sum of its factors."""
        rows = len(bounds) - 1
        owner = np.repeat(np.arange(rows), np.diff(bounds))
        linear = self.bias + np.bincount(owner, self.weight[slot], rows)
        if not self.paired:
            return linear, np.zeros((rows, FACTORS))
        factor = self.factor[slot].astype(float)
        sums = np.stack([np.bincount(owner, factor[:, f], rows) for f in range(FACTORS)], axis=1)
        squares = np.bincount(owner, (factor**2).sum(axis=1), rows)
        return linear + ((sums**2).sum(axis=1) - squares) / 2, sums

    def scores(self, slot: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return logistic(self.scale * self.margins(slot, bounds)[0] + self.shift)

    @property
    def width(self) -> int:
        """Numbers of a slot that move: its weight, and its factors once there are any."""
        return 1 + FACTORS if self.paired else 1

    def gradient(self, slot: np.ndarray, bounds: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the rows. First the gradient, and beside it the sum of squares of what each error is multiplied by (numbers
        of a slot x slots each); then the sum of the errors and that of their squares."""
        margin, sums = self.margins(slot, bounds)
        error = logistic(margin) - label
        owner = np.repeat(np.arange(len(label)), np.diff(bounds))
        each = error[owner]
        out = np.zeros((2, self.width, SLOTS))
        out[0, 0], out[1, 0] = np.bincount(slot, each, SLOTS), np.bincount(slot, minlength=SLOTS)
        for f in range(self.width - 1):
            others = sums[owner, f] - self.factor[slot, f]
            out[0, f + 1], out[1, f + 1] = np.bincount(slot, each * others, SLOTS), np.bincount(slot, others**2, SLOTS)
        return out, np.array([error.sum(), (error**2).sum()])

    def step(self, gradient: np.ndarray, errors: np.ndarray, n: int, motion: np.ndarray) -> np.ndarray:
        """Move by the evidence of the summed gradient; ``motion`` is the average of the steps before, and the new one returned."""
        variance = max(errors[1] / n, 1e-9)
        if variance > WORSE * self.least:
            self.size /= 2
        self.least = min(self.least, variance)
        if len(motion) < len(gradient[0]):
            motion = np.pad(motion, ((0, len(gradient[0]) - len(motion)), (0, 0)))
        motion *= MOMENTUM
        for moved, first, squares in zip(motion, *gradient, strict=True):  # one number of all slots at a time
            power = (first**2 / np.maximum(squares * variance, 1e-12)) ** (SHARPNESS / 2)
            moved += (1 - MOMENTUM) * (np.sign(first) * power / (power + EVIDENCE**SHARPNESS))
        self.weight = ((1 - DECAY) * self.weight - self.size * motion[0]).astype(np.float32)
        if self.paired:
            for f, moved in enumerate(motion[1:]):
                self.factor[:, f] = (1 - DECAY) * self.factor[:, f] - self.size * moved
        self.bias -= self.size * float(np.clip(errors[0] / n / np.sqrt(variance / n) / 4, -1, 1))
        return motion

    def calibrate(self, margin: np.ndarray, label: np.ndarray, rounds: int = 50) -> None:
        """Scale and shift that make the labels of rows that did not take part likeliest; few rows change little."""
        scale, shift = 1.0, 0.0
        for _ in range(rounds):
            p = logistic(scale * margin + shift)
            error, curve = p - label, p * (1 - p)
            slope = np.array([(error * margin).sum() + scale - 1, error.sum() + shift])
            bend = np.array([[(curve * margin**2).sum() + 1, (curve * margin).sum()], [(curve * margin).sum(), curve.sum() + 1]])
            move = np.linalg.solve(bend, slope)
            scale, shift = scale - float(np.clip(move[0], -0.5, 0.5)), shift - float(np.clip(move[1], -0.5, 0.5))
        if scale > 0:
            self.scale, self.shift = scale, shift


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _remainder(divisor: int) -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``text, label`` of at most ``rows`` labelled documents. An id labelled twice counts as toxic if one label says so."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    # at most `rows` of them
    return docs.select("doc_id", "text").join(F.broadcast(write_out(chosen)), "doc_id").select("text", F.col("label").cast("double"))


def fit(texts: DataFrame, rounds: int = ROUNDS, weight_rounds: int = WEIGHT_ROUNDS) -> Machine:
    """Fit on ``texts(text, label)``, a bounded sample. No rows give a model that scores one half."""
    context = texts.sparkSession.sparkContext
    machine = Machine()

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=PIECE):
            slot, bounds = slots(piece)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(slot.astype(np.int32)))
            columns = [piece.rows.column("label"), piece.rows.column("aside"), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "aside", "slots"])

    texts = write_out(texts)  # the scan for the sample runs in as many tasks as it needs
    marked = texts.withColumn("aside", F.pmod(F.xxhash64("text", F.lit(SET_ASIDE)), F.lit(SET_ASIDE)) == 0)
    rows = write_out(marked.mapInArrow(prepare, "label double, aside boolean, slots array<int>").coalesce(PARTS))
    used = rows.where("not aside").drop("aside")
    n, rate = used.agg(F.count("*"), F.avg("label")).first()
    if not n:
        return machine
    rate = min(max(rate, 1 / (n + 1)), n / (n + 1))
    machine.bias = float(np.log(rate / (1 - rate)))
    motion, gradient = np.zeros((1, SLOTS)), np.zeros((2, 1, SLOTS))
    for number in range(rounds):
        now = context.broadcast(machine)  # a model of fixed size
        if gradient.shape[1] != machine.width:
            gradient = np.zeros((2, machine.width, SLOTS))
        gradient[:], errors = 0, np.zeros(2)
        for row in gradients(used, now).toLocalIterator():  # a few of the size of the model, one at a time
            part = np.frombuffer(zstandard.decompress(row["gradient"]), np.float32)
            gradient += part.reshape(gradient.shape)
            errors += row["errors"]
        now.destroy()  # its files too: there is one for each round
        motion = machine.step(gradient, errors, n, motion)
        if number + 1 == weight_rounds:
            machine.start(gradient[1, 0] / n)
    last = context.broadcast(machine)
    known = margins_of(rows.where("aside").drop("aside"), last).collect()  # of a fifth of the bounded sample
    last.destroy()
    if known:
        machine.calibrate(*np.array([(r["margin"], r["label"]) for r in known]).T)
    return machine


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column("slots")
    return lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])


def gradients(rows: DataFrame, machine: Broadcast) -> DataFrame:
    """A row per task with the sums of :meth:`Machine.gradient` over its rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, errors = np.zeros((2, machine.value.width, SLOTS)), np.zeros(2)
        for batch in batches:
            if batch.num_rows:
                made, wrong = machine.value.gradient(*_lists(batch), batch.column("label").to_numpy())
                total += made
                errors += wrong
        packed = zstandard.compress(total.astype(np.float32).tobytes(), 1)  # most slots of a task are empty
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary()), pa.array([errors.tolist()])], names=["gradient", "errors"])

    return rows.mapInArrow(add, "gradient binary, errors array<double>")


def margins_of(rows: DataFrame, machine: Broadcast) -> DataFrame:
    """``margin, label`` of prepared rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = machine.value.margins(*_lists(batch))[0]
            yield pa.RecordBatch.from_arrays([pa.array(margin), batch.column("label")], names=["margin", "label"])

    return rows.mapInArrow(work, "margin double, label double")


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id, score`` for each row of ``docs(doc_id, text)``; a text without terms, so a null one too, scores by the bias."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=PIECE):
            scores = shared.value.scores(*slots(piece))
            yield pa.RecordBatch.from_arrays([piece.rows.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs(doc_id, text)``.

    Learns from ``labels(doc_id, toxic)`` whose ``crc32(doc_id) % 5`` is not 0; null labels and labels without document are
    left out. Without labels every score is one half. A null id counts as the empty text in the remainder. Repeated rows
    stay. Other columns are not looked at.
    """
    machine = fit(sample(docs, labels.where(_remainder(5) != 0), rows))
    scored = score(docs, machine)
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int")
    return scored.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", predicted.alias("predicted"))

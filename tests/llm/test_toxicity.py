"""The factorization machine: sums over pairs by brute force, a pair among many words, held-out accuracy."""

from __future__ import annotations

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from zephyra.llm import toxicity
from zephyra.llm.queries import QUERIES
from zephyra.llm.texts import pieces


def small_machine(seed=1):
    rng = np.random.default_rng(seed)
    machine = toxicity.Machine()
    machine.bias, machine.paired = 0.3, True
    machine.weight = rng.normal(size=toxicity.SLOTS).astype(np.float32)
    machine.factor = rng.normal(size=(toxicity.SLOTS, toxicity.FACTORS)).astype(np.float32)
    return machine


def rows_of_slots(seed=2):
    rng = np.random.default_rng(seed)
    rows = [sorted(rng.choice(50, n, replace=False).tolist()) for n in (0, 1, 2, 7, 12)]
    return rows, np.concatenate([np.array(r, np.int64) for r in rows]), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def margin(machine, row):
    pairs = sum(
        float(machine.factor[a].astype(float) @ machine.factor[b].astype(float)) for i, a in enumerate(row) for b in row[i + 1 :]
    )
    return machine.bias + sum(float(machine.weight[a]) for a in row) + pairs


def test_margins_are_sums_over_all_pairs():
    machine, (rows, slot, bounds) = small_machine(), rows_of_slots()
    assert machine.margins(slot, bounds)[0] == pytest.approx([margin(machine, r) for r in rows])


def test_gradient_is_the_change_of_the_loss():
    machine, (rows, slot, bounds) = small_machine(), rows_of_slots()
    machine.weight, machine.factor = machine.weight * 0.1, machine.factor * 0.1
    label = np.array([0.0, 1.0, 1.0, 0.0, 1.0])

    def loss():
        m = np.array([margin(machine, r) for r in rows])
        return float(np.sum(np.logaddexp(0, m) - label * m))

    (gradient, squares), errors = machine.gradient(slot, bounds, label)
    for s in (rows[3][0], rows[4][5], 49, rows[2][1]):
        for f in range(1 + toxicity.FACTORS):
            values, place = (machine.weight, s) if f == 0 else (machine.factor, (s, f - 1))
            kept = values[place]
            step = 2.0**-7
            values[place] = kept + step
            up = loss()
            values[place] = kept - step
            down = loss()
            values[place] = kept
            assert gradient[f, s] == pytest.approx((up - down) / (2 * step), abs=2e-4)
    assert squares[0].sum() == len(slot) and errors[0] == pytest.approx(_errors(machine, rows, label).sum())
    assert errors[1] == pytest.approx((_errors(machine, rows, label) ** 2).sum())
    machine.paired = False
    assert machine.gradient(slot, bounds, label)[0].shape == (2, 1, toxicity.SLOTS)


def _errors(machine, rows, label):
    return 1 / (1 + np.exp(-np.array([margin(machine, r) for r in rows]))) - label


def test_every_term_has_a_slot():
    texts = ["one word", "", None, "Word word WORD", "word " * 5]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    piece = next(pieces(iter([batch])))
    slot, bounds = toxicity.slots(piece)
    assert np.diff(bounds).tolist() == [2, 0, 0, 1, 1]
    assert slot[bounds[3]] == slot[bounds[4]] and slot[bounds[3]] in slot[bounds[0] : bounds[1]]


def _frames(spark, texts, labels):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")


def test_a_pair_of_neutral_words_among_ten_thousand_others(spark):
    rng = np.random.default_rng(0)
    words = np.array([f"w{i}x{i * 7919 % 10007}" for i in range(10_000)])
    texts, labels = [], []
    for _ in range(5000):
        a, b = rng.random(2) < 0.5
        text = [*rng.choice(words, 60), *["zorbal"] * int(a), *["mintak"] * int(b)]
        rng.shuffle(text)
        texts.append(" ".join(text))
        labels.append(int(a != b))
    got = toxicity.toxicity(*_frames(spark, texts, labels)).collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 900 and np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) >= 0.95


def test_rare_insults_count(spark):
    rng = random.Random(4)
    insults = [f"insult{c}{c}" for c in "abcdefghijklmnopqrst"]  # each in about seven training texts
    texts, labels = [], []
    for i in range(3000):
        text = [f"plain{rng.randrange(2000)}" for _ in range(30)]
        toxic = i % 15 == 0
        if toxic:
            text[rng.randrange(30)] = rng.choice(insults)
        texts.append(" ".join(text))
        labels.append(int(toxic))
    got = toxicity.toxicity(*_frames(spark, texts, labels)).collect()
    held = [r for r in got if r["held_out"]]
    caught = [r["predicted"] for r in held if labels[r["doc_id"]]]
    assert np.mean(caught) >= 0.8 and not any(r["predicted"] for r in held if not labels[r["doc_id"]])


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in QUERIES["op8_toxicity"](spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null").select("doc_id", "toxic").collect()
    held = [(r["toxic"], got[r["doc_id"]]["predicted"]) for r in labels if r["doc_id"] in got and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    caught, raised = [p for t, p in held if t], [t for t, p in held if p]
    assert np.mean(caught) >= 0.86 and np.mean(raised) >= 0.97


def test_a_step_needs_little_memory():
    """The driver takes the steps; beside the gradient and the motion it holds a few numbers of each slot."""
    machine = toxicity.Machine()
    machine.start(np.full(toxicity.SLOTS, 0.5))
    rng = np.random.default_rng(3)
    gradient, motion = rng.normal(0, 9, (2, machine.width, toxicity.SLOTS)), np.zeros((machine.width, toxicity.SLOTS))
    gradient[1] = np.abs(gradient[1])
    square = gradient[0] ** 2 / np.maximum(gradient[1] * 0.25, 1e-12)
    power = square ** (toxicity.SHARPNESS / 2)
    expected = (1 - toxicity.MOMENTUM) * np.sign(gradient[0]) * power / (power + toxicity.EVIDENCE**toxicity.SHARPNESS)
    tracemalloc.start()
    moved = machine.step(gradient, np.array([1.0, 25.0]), 100, motion)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(moved, expected) and peak < 2 * gradient[0].nbytes

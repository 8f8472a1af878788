"""Sliding windows over buckets against a plain pass over all rows, and how little of the state an event touches."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from zephyra.functions.sliding import HOUR, ROW, Sliding


class Memory:
    """Buckets in a dictionary; counts what is read and written."""

    def __init__(self):
        self.held, self.content, self.last = {}, {}, None
        self.rows_read = self.rows_written = 0

    def summaries(self):
        return dict(self.held)

    def rows(self, bucket):
        self.rows_read += len(self.content[bucket]) // ROW.itemsize
        return self.content[bucket]

    def put(self, bucket, summary, rows):
        self.rows_written += len(rows) // ROW.itemsize
        self.held[bucket], self.content[bucket] = summary, rows

    def remove(self, bucket):
        del self.held[bucket], self.content[bucket]

    def older(self):
        return self.last

    def keep_older(self, row):
        self.last = row


def points(rows):
    made = np.array(sorted(rows), ROW) if rows else np.zeros(0, ROW)
    return made


def plain(seen, row, lags, windows, span):
    """The features of one row from all rows that are there."""
    us = row[0]
    out = {}
    for n in lags:
        before = [r for r in seen if r[0] <= us - n * HOUR]
        out[f"lag_{n}"] = max(before)[2] if before else math.nan
    for n in windows:
        part = [r[2] for r in seen if us - n * HOUR < r[0] < us]
        stats = (np.mean(part), np.std(part), min(part), max(part)) if part else (math.nan,) * 4
        out |= dict(zip((f"{s}_{n}" for s in ("mean", "std", "min", "max")), stats, strict=True))
    held = [r[0] for r in seen if us - span * HOUR < r[0] <= us]
    return out | {"buffer_size": len(held), "oldest_us": min(held)}


row = st.tuples(st.integers(0, 40 * 12), st.integers(-50, 50))


@settings(deadline=None, max_examples=150)
@given(st.lists(st.lists(row, min_size=1, max_size=12), min_size=1, max_size=6), st.sampled_from([HOUR, HOUR // 4, HOUR // 60]))
def test_every_feature_equals_a_plain_pass(batches, bucket):
    sliding = Sliding((1, 3, 5), (1, 2, 4), 6, 100 * HOUR, bucket)  # rows come late without limit
    store, seen, seq = Memory(), [], 0
    for batch in batches:
        rows = []
        for at, value in batch:
            rows.append((at * HOUR // 12, seq, float(value)))
            seq += 1
        seen += rows
        made = sliding.add(store, points(rows))
        for i, r in enumerate(sorted(rows)):
            for name, value in plain(seen, r, (1, 3, 5), (1, 2, 4), 6).items():
                got = made[name][i]
                assert (math.isnan(got) and math.isnan(value)) or got == pytest.approx(value, abs=1e-9), (name, r)


def test_rows_in_time_order_leave_the_state(tmp_path):
    sliding, store, seen = Sliding((1, 4), (2, 4), 4, HOUR, HOUR // 2), Memory(), []
    rng = np.random.default_rng(0)
    stamps = np.sort(rng.integers(0, 300 * HOUR, 600))
    for part in np.array_split(np.arange(600), 60):
        rows = [(int(stamps[i]), int(i), float(rng.normal())) for i in part]
        seen += rows
        made = sliding.add(store, points(rows))
        for i, r in enumerate(rows):
            for name, value in plain(seen, r, (1, 4), (2, 4), 4).items():
                assert (math.isnan(made[name][i]) and math.isnan(value)) or made[name][i] == pytest.approx(value, abs=1e-9)
        newest = rows[-1][0]
        assert all((b + 1) * HOUR // 2 > newest - 5 * HOUR for b in store.held)
    sliding.rest(store)
    assert store.held == {} and store.last == seen[-1]


def test_a_row_that_comes_after_its_day_has_left():
    sliding, store = Sliding((1,), (2,), 2, 0, HOUR), Memory()
    sliding.add(store, points([(0, 0, 1.0), (HOUR, 1, 2.0), (10 * HOUR, 2, 3.0)]))
    assert store.last == (HOUR, 1, 2.0)
    made = sliding.add(store, points([(HOUR + 5, 3, 9.0)]))
    assert math.isnan(made["lag_1"][0]) and made["buffer_size"][0] == 1
    assert sliding.add(store, points([(3 * HOUR, 4, 9.0)]))["lag_1"][0] == 9.0


def test_work_of_a_busy_day():
    """10^5 events of one city in a day, a thousand at a time: what is read and written is a few buckets a batch."""
    n, at_once, bucket = 100_000, 1000, HOUR // 12
    sliding, store = Sliding((1, 3, 6, 12, 24), (3, 6, 12, 24), 24, HOUR, bucket), Memory()
    rng = np.random.default_rng(1)
    rows = np.zeros(n, ROW)
    rows["us"], rows["seq"], rows["value"] = np.sort(rng.integers(0, 24 * HOUR, n)), np.arange(n), rng.normal(100, 30, n)
    late = rng.permutation(n)[: n // 100]
    arrival = np.argsort(np.where(np.isin(np.arange(n), late), rows["us"] + HOUR // 2, rows["us"]), kind="stable")
    sample = {}
    for start in range(0, n, at_once):
        part = np.sort(rows[arrival[start : start + at_once]], order=["us", "seq"])
        made = sliding.add(store, part)
        sample[start] = (part[-1], {k: v[-1] for k, v in made.items()}, rows[arrival[: start + at_once]])
    a_bucket = n * bucket / (24 * HOUR)
    batch_buckets = at_once / a_bucket + 2
    late_buckets = 12  # late rows fall into buckets of the last half hour and its edges
    per_batch = (6 * (batch_buckets + late_buckets)) * a_bucket
    assert store.rows_read / (n / at_once) < per_batch < n / 2
    assert store.rows_written / (n / at_once) < (batch_buckets + late_buckets) * a_bucket
    for start in (20_000, 60_000, 99_000):
        row, found, seen = sample[start]
        expected = plain([tuple(r) for r in seen.tolist()], tuple(row.tolist()), (1, 12), (3, 24), 24)
        for name, value in expected.items():
            assert (math.isnan(found[name]) and math.isnan(value)) or found[name] == pytest.approx(value, rel=1e-12), name


def test_settings_that_cannot_be():
    with pytest.raises(ValueError):
        Sliding((1,), (1,), 24, 0, HOUR // 7 + 1)
    with pytest.raises(ValueError):
        Sliding((25,), (1,), 24, 0)

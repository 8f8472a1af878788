"""Suppression of repeats: the greedy rule, and its composition over chunks."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from zephyra.functions.spacing import entered, exits, followed, passing

stamps = st.lists(st.integers(0, 400), min_size=1, max_size=60, unique=True).map(sorted)


def greedy(times, window, last=None):
    sent = []
    for t in times:
        if last is None or t - last >= window:
            sent.append(t)
            last = t
    return sent


@settings(deadline=None, max_examples=200)
@given(stamps, st.integers(1, 50), st.one_of(st.none(), st.integers(-60, -1)))
def test_passing_is_greedy(times, window, last):
    times = np.array(times)
    assert times[passing(times, window, last)].tolist() == greedy(times.tolist(), window, last)


@settings(deadline=None, max_examples=200)
@given(stamps, st.integers(1, 50), st.integers(-60, -1))
def test_exit_map_gives_the_last_pass(times, window, last):
    array = np.array(times)
    upto, end = exits(array, window)
    at = int(np.searchsorted(upto, last + window, side="left"))
    sent = greedy(times, window, last)
    assert (int(end[at]) if at < len(end) else None) == (sent[-1] if sent else None)
    assert (np.diff(upto) > 0).all()


def test_repeats(spark, hourly):
    from pyspark.sql import functions as F

    from tests.conftest import by_seq
    from zephyra.operators.alerts import suppress_repeats

    second = lambda s: F.timestamp_seconds(F.lit(1_000_000) + s)
    rows = spark.createDataFrame(
        [
            (0, "Delhi", "warning", 0),
            (1, "Delhi", "warning", 1800),
            (2, "Delhi", "warning", 3601),
            (3, "Delhi", "severe", 1800),
            (4, "Mumbai", "warning", 1800),
            (5, "Delhi", "warning", 3601),
            (6, "Delhi", "warning", 7200),
            (7, "Delhi", "warning", 7201),
        ],
        "seq long, city string, level string, s long",
    ).withColumn("timestamp", second(F.col("s")))
    assert by_seq(suppress_repeats(rows), "seq") == [0, 2, 3, 4, 7]
    for wrong in (0, -1, 1.5, True):
        with pytest.raises(ValueError):
            suppress_repeats(rows, wrong)


@settings(deadline=None, max_examples=300)
@given(stamps, st.integers(1, 50), st.lists(st.integers(0, 400), min_size=1, max_size=4), st.one_of(st.none(), st.integers(-60, -1)))
def test_maps_of_neighbours_make_the_map_of_both(times, window, cuts, last):
    times = np.array(times)
    parts = [p for p in np.split(times, np.searchsorted(times, sorted(cuts))) if len(p)]
    upto, end = exits(parts[0], window)
    for part in parts[1:]:
        upto, end = followed(upto, end, *exits(part, window), window)
    sent = greedy(times.tolist(), window, last)
    assert entered(upto, end, window, last) == (sent[-1] if sent else last)
    assert (np.diff(upto) > 0).all() and len(upto) <= np.count_nonzero(times < times[0] + window) + 1


@pytest.mark.parametrize("chunks", [2, 8, 64, 512])
def test_the_map_of_many_chunks_stays_within_a_window(chunks):
    window, rng = 50, np.random.default_rng(chunks)
    for times in (np.arange(50 * chunks), np.flatnonzero(rng.random(50 * chunks) < 0.4)):
        level = [exits(part, window) for part in np.array_split(times, chunks) if len(part)]
        while len(level) > 1:
            pairs = [followed(*a, *b, window) for a, b in zip(level[::2], level[1::2], strict=False)]
            level = pairs + ([level[-1]] if len(level) % 2 else [])
        upto, end = level[0]
        assert len(upto) <= np.count_nonzero(times < times[0] + window) + 1 <= window + 1
        for last in (None, times[0] - 1, times[0] - window // 2, times[0] - window, times[0] - 10 * window):
            sent = greedy(times.tolist(), window, last)
            assert entered(upto, end, window, last) == sent[-1]

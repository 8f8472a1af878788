"""Sliding time windows over buckets of time, an event at a time or many.

The time line of a key is cut into buckets that divide an hour. A bucket has its rows and a small summary. The open range of
``n`` hours before an instant is the end of one bucket, whole buckets in between, and the start of the instant's own bucket: so
an event looks at the rows of its own bucket and of one bucket for each offset, and at summaries for everything else. Sums are
taken about the mean of a bucket and nothing is subtracted from running totals, so no digits are lost; smallest and
greatest values come from running ones in either direction.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np

HOUR = 3_600_000_000
ROW = np.dtype([("us", "<i8"), ("seq", "<i8"), ("value", "<f8")])
#: What a summary holds of a bucket: moments, range, its first stamp, and its last row.
SUMMARY = ("n", "mean", "m2", "lo", "hi", "first_us", "last_us", "last_seq", "last")
STATS = ("mean", "std", "min", "max")


class Store(Protocol):
    """Where the buckets of one key are kept."""

    def summaries(self) -> dict[int, tuple]: ...
    def rows(self, bucket: int) -> bytes: ...
    def put(self, bucket: int, summary: tuple, rows: bytes) -> None: ...
    def remove(self, bucket: int) -> None: ...
    def older(self) -> tuple | None: ...
    def keep_older(self, row: tuple) -> None: ...


def summary_of(rows: np.ndarray) -> tuple:
    values, last = rows["value"], rows[-1]
    mean = float(values.mean())
    spread = float(((values - mean) ** 2).sum())
    ends = int(rows["us"][0]), int(last["us"]), int(last["seq"]), float(last["value"])
    return (len(rows), mean, spread, float(values.min()), float(values.max()), *ends)


class Bucket:
    """Rows in order of stamp and number, with running sums from either end."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.us = rows, rows["us"]
        self.mean = float(rows["value"].mean()) if len(rows) else 0.0
        self._runs: dict[bool, tuple[np.ndarray, ...]] = {}

    def part(self, at: np.ndarray, end: bool) -> tuple[np.ndarray, ...]:
        """Count, mean, spread, least and greatest of the rows before each place, or with ``end`` of those from it on."""
        if end not in self._runs:
            values = self.rows["value"][::-1] if end else self.rows["value"]
            far = values - self.mean
            self._runs[end] = (
                np.append(0.0, np.cumsum(far)), np.append(0.0, np.cumsum(far * far)),
                np.append(np.inf, np.minimum.accumulate(values)), np.append(-np.inf, np.maximum.accumulate(values)),
            )
        count = len(self.rows) - at if end else at
        s1, s2, lo, hi = (run[count] for run in self._runs[end])
        step = s1 / np.maximum(count, 1)
        return count, self.mean + step, np.maximum(s2 - s1 * step, 0.0), lo, hi


def pooled(parts: list[tuple]) -> tuple:
    """The moments and the range of several parts together."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / np.maximum(n, 1)
    spread = sum(p[2] + p[0] * (p[1] - mean) ** 2 for p in parts)
    lo, hi = parts[0][3], parts[0][4]
    for p in parts[1:]:
        lo, hi = np.minimum(lo, p[3]), np.maximum(hi, p[4])
    return n, mean, spread, lo, hi


@dataclass(frozen=True)
class Sliding:
    """Features of events from the buckets of their key. ``lags`` and ``windows`` are in hours; rows are kept for ``span``
    hours and ``lateness`` microseconds."""

    lags: tuple[int, ...]
    windows: tuple[int, ...]
    span: int
    lateness: int
    bucket: int = HOUR

    def __post_init__(self):
        if self.bucket <= 0 or HOUR % self.bucket:
            raise ValueError("a bucket must divide an hour")
        if max(*self.lags, *self.windows) > self.span:
            raise ValueError("lags and windows must lie within the span")

    def add(self, store: Store, fresh: np.ndarray) -> dict[str, np.ndarray]:
        """Put ``fresh`` (a ``ROW`` array in order of stamp and number) into the buckets, and give the features of each of its
        rows: what they see of all rows that are there by then."""
        summaries = store.summaries()
        place = fresh["us"] // self.bucket
        own = np.unique(place)
        back = {n: n * HOUR // self.bucket for n in {*self.lags, *self.windows, self.span}}
        edges = {int(b) - w for b in own for w in back.values()}
        loaded = {b: Bucket(np.frombuffer(store.rows(b), ROW)) for b in edges - set(own.tolist()) if b in summaries}
        bounds = np.append(np.searchsorted(place, own), len(fresh))
        for b, start, stop in zip(own.tolist(), bounds[:-1], bounds[1:], strict=True):
            rows = fresh[start:stop]
            if b in summaries:
                rows = np.concatenate([np.frombuffer(store.rows(b), ROW), rows])
                rows = rows[np.lexsort((rows["seq"], rows["us"]))]
            summaries[b] = summary_of(rows)
            loaded[b] = Bucket(rows)
            store.put(b, summaries[b], rows.tobytes())
        nothing = Bucket(np.zeros(0, ROW))
        keys = np.array(sorted(summaries), np.int64)
        table = np.array([summaries[k] for k in keys.tolist()], float).reshape(len(keys), len(SUMMARY)) if len(keys) else None
        older = store.older()
        out = {name: np.full(len(fresh), np.nan) for name in self.names()}
        size, oldest = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64)
        for b, start, stop in zip(own.tolist(), bounds[:-1], bounds[1:], strict=True):
            mine, at, here = loaded[b], fresh["us"][start:stop], slice(start, stop)
            head = mine.part(np.searchsorted(mine.us, at, side="left"), end=False)
            for n in sorted(back):
                edge = loaded.get(b - back[n], nothing)
                after = np.searchsorted(edge.us, at - n * HOUR, side="right")
                low, high = np.searchsorted(keys, [b - back[n] + 1, b])
                if n in self.lags:
                    before = int(np.searchsorted(keys, b - back[n]))
                    if before:
                        earlier = np.full(len(at), summaries[int(keys[before - 1])][-1])
                    else:  # a row that comes very late may ask for a time before the row that was kept
                        earlier = np.where(older[0] <= at - n * HOUR, older[2], np.nan) if older else np.full(len(at), np.nan)
                    out[f"lag_{n}"][here] = np.where(after > 0, np.append(edge.rows["value"], 0.0)[after - 1], earlier)
                if n in self.windows:
                    middle = table[low:high]
                    parts = [edge.part(after, end=True), head]
                    if len(middle):
                        count = middle[:, 0]
                        mean = float((count * middle[:, 1]).sum() / count.sum())
                        spread = float((middle[:, 2] + count * (middle[:, 1] - mean) ** 2).sum())
                        parts.append((float(count.sum()), mean, spread, float(middle[:, 3].min()), float(middle[:, 4].max())))
                    count, mean, spread, lo, hi = pooled(parts)
                    some = count > 0
                    deviation = np.where(lo == hi, 0.0, np.sqrt(spread / np.maximum(count, 1)))
                    for name, values in zip(STATS, (mean, deviation, lo, hi), strict=True):
                        out[f"{name}_{n}"][here] = np.where(some, values, np.nan)
                if n == self.span:
                    within = np.searchsorted(mine.us, at, side="right")
                    size[here] = len(edge.us) - after + int(table[low:high, 0].sum()) + within
                    first = summaries[int(keys[low])][5] if high > low else int(mine.us[0])
                    oldest[here] = np.where(after < len(edge.us), np.append(edge.us, 0)[after], first)
        self._evict(store, summaries)
        return {**out, "buffer_size": size, "oldest_us": oldest}

    def names(self) -> list[str]:
        return [f"lag_{n}" for n in self.lags] + [f"{s}_{n}" for n in self.windows for s in STATS]

    def _evict(self, store: Store, summaries: dict[int, tuple], cutoff: int | None = None) -> None:
        """Drop the buckets that end before all that a row may still ask for; of their rows the last one stays."""
        if cutoff is None:
            cutoff = max(s[6] for s in summaries.values()) - self.span * HOUR - self.lateness
        gone = [b for b in summaries if (b + 1) * self.bucket <= cutoff]
        if not gone:
            return
        last = max((*summaries[b][6:8], summaries[b][8]) for b in gone)
        older = store.older()
        if older is None or tuple(older) < last:
            store.keep_older(last)
        for b in gone:
            store.remove(b)

    def rest(self, store: Store) -> None:
        """Drop all buckets; the last row stays."""
        summaries = store.summaries()
        if summaries:
            self._evict(store, summaries, (max(summaries) + 1) * self.bucket)

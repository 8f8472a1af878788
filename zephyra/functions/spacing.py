"""Which of a sorted run of instants pass when each needs a distance to the last one that passed."""

from __future__ import annotations

import numpy as np


def next_allowed(stamps: np.ndarray, window: int) -> np.ndarray:
    """For each instant, the position of the first one at least ``window`` later; the length where there is none."""
    return np.searchsorted(stamps, stamps + window, side="left")


def passing(stamps: np.ndarray, window: int, last: int | None = None) -> np.ndarray:
    """Mask of the instants that pass, given the last pass before them."""
    mask = np.zeros(len(stamps), dtype=bool)
    follow = next_allowed(stamps, window)
    at = 0 if last is None else int(np.searchsorted(stamps, last + window, side="left"))
    while at < len(stamps):
        mask[at] = True
        at = int(follow[at])
    return mask


def exits(stamps: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """How a run of instants maps the last pass before it to the last pass in it.

    A pass before the run allows the first instant at or after ``last + window``. Returns ``(upto, exit)``: when that
    moment is at most ``upto[i]`` (and above ``upto[i - 1]``), the last pass in the run is ``exit[i]``. Moments above
    the last ``upto`` leave the run without a pass. Equal neighbours are merged, but for the first entry, which is the first
    instant of the run. A pass before the run cannot reach further than ``window`` beyond that, so there is at most one entry
    for each instant of the first ``window``, and one more.
    """
    n = len(stamps)
    end = np.arange(n)
    hop = np.append(next_allowed(stamps, window), n)
    end = np.append(end, n)
    while True:  # doubling: follow the chains of all starts at once
        further = hop[:n] < n
        if not further.any():
            break
        end[:n] = np.where(further, end[hop[:n]], end[:n])
        hop[:n] = np.where(further, hop[hop[:n]], hop[:n])
    starts = min(n, int(np.searchsorted(stamps, stamps[0] + window, side="left")) + 1)
    reached = stamps[end[:starts]]
    return _merged(stamps[:starts], reached)


def _merged(upto: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One entry for each run of equal ends after the first entry."""
    kept = np.append(end[1:] != end[:-1], True)
    kept[0] = True
    return upto[kept], end[kept]


def entered(upto: np.ndarray, end: np.ndarray, window: int, last: int | None) -> int | None:
    """The last pass in a run, or before it, given the last pass before it and the run's :func:`exits`."""
    at = 0 if last is None else int(np.searchsorted(upto, last + window, side="left"))
    return int(end[at]) if at < len(upto) else last


def followed(
    upto: np.ndarray, end: np.ndarray, next_upto: np.ndarray, next_end: np.ndarray, window: int
) -> tuple[np.ndarray, np.ndarray]:
    """The :func:`exits` of two neighbouring runs taken together, from those of each. Entries that no pass before both can
    reach are left out, so the map does not grow with the runs."""
    at = np.searchsorted(next_upto, end + window, side="left")
    through = np.where(at < len(next_upto), np.append(next_end, 0)[np.minimum(at, len(next_upto))], end)
    later = next_upto > upto[-1]
    upto, end = np.append(upto, next_upto[later]), np.append(through, next_end[later])
    reachable = int(np.searchsorted(upto, upto[0] + window, side="left")) + 1
    return _merged(upto[:reachable], end[:reachable])

"""Suffix array by Lyndon groups, in linear time and without renaming.

Suffixes start in groups by their first symbol. Groups are taken from the highest down. The suffixes of a group are known by
then to share their longest Lyndon prefix u. Each points to the previous suffix of a lower group; a suffix that k of them point
to continues with u k times, and so belongs above the others of its own group: it moves to a new group just behind, further
for a larger k. When all groups are taken, each is one Lyndon prefix. The array is then filled from the front: behind each
placed suffix the one before it and its chain of pointers take the next free places of their groups.
"""

from __future__ import annotations

from collections import Counter


def suffix_array(symbols: list[int]) -> list[int]:
    """Start positions of the suffixes in order. The last symbol must be smaller than all others and occur once."""
    n = len(symbols)
    previous, group_of, done = _groups(symbols)
    size = Counter(group_of)
    free, at = {}, 0
    for group in done:
        free[group] = at
        at += size[group]
    order, placed = [0] * n, bytearray(n)
    order[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        s = order[i] - 1
        while s >= 0 and not placed[s]:
            placed[s] = 1
            group = group_of[s]
            order[free[group]] = s
            free[group] += 1
            s = previous[s]
    return order


def _groups(symbols: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Previous smaller suffix and group of each suffix, and the groups in ascending order."""
    n = len(symbols)
    members: list[list[int]] = []
    number = {}
    for symbol in sorted(set(symbols)):
        number[symbol] = len(members)
        members.append([])
    group_of = [number[x] for x in symbols]
    for s, group in enumerate(group_of):
        members[group].append(s)
    size = [len(m) for m in members]
    # groups form a list; each knows the next lower one
    lower = list(range(-1, len(members) - 1))
    upper = [*range(1, len(members)), -1]
    previous, taken = [-1] * n, bytearray(n)
    descending = []
    group = len(members) - 1
    while group >= 0:
        own = members[group]
        if len(own) != size[group]:
            own = [s for s in own if group_of[s] == group]
        if len(own) > 1:
            own.sort()
        pointed = []
        for s in own:
            p = s - 1
            while p >= 0 and taken[p]:
                p = previous[p]
            previous[s] = p
            taken[s] = 1
            if p >= 0:
                pointed.append(p)
        members[group] = []
        if len(pointed) == 1:
            moves = (((group_of[pointed[0]], 1), pointed),) if size[group_of[pointed[0]]] > 1 else ()
        else:
            split: dict[tuple[int, int], list[int]] = {}
            for p, k in Counter(pointed).items():
                old = group_of[p]
                if size[old] > 1:
                    split.setdefault((old, k), []).append(p)
            moves = sorted(split.items(), reverse=True)
        for (old, _), moved in moves:
            if size[old] == len(moved):
                continue  # all that is left of the group
            new = len(members)
            members.append(moved)
            size.append(len(moved))
            size[old] -= len(moved)
            for p in moved:
                group_of[p] = new
            above = upper[old]
            lower.append(old)
            upper.append(above)
            upper[old] = new
            if above >= 0:
                lower[above] = new
        descending.append(group)
        group = lower[group]
    descending.reverse()
    return previous, group_of, descending

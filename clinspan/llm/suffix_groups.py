"""Suffix sorting by linear grouping over Lyndon prefixes.

First part: suffixes are held in groups that share a prefix; groups are taken in descending order.
Each suffix of the group points to the nearest earlier suffix in a lower group (its previous smaller
one); the suffixes pointed at grow their shared prefix by as many copies of the group's prefix as
point at them, so they leave their group for new ones right above it, more copies higher. In the end
a group is exactly the suffixes with one longest Lyndon prefix, and nothing is renamed.

Second part: the order is emitted from the lowest suffix on. Behind each emitted suffix stands the
chain of previous-smaller pointers of the position before it; those not yet emitted have it as their
next smaller suffix, and take the next free place of their group.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in ascending order; of two with one beginning, the shorter is lower."""
    if not len(text):
        return []
    groups, previous = lyndon_groups(text)
    return emit(groups, previous)


def lyndon_groups(text: Sequence[int]) -> tuple[list[list[int]], list[int]]:
    """The groups of equal longest Lyndon prefix, lowest first, and each suffix's previous smaller one (-1: none)."""
    n = len(text)
    symbols = sorted(set(text))
    first = {symbol: i for i, symbol in enumerate(symbols)}
    group = [first[symbol] for symbol in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(symbols) - 1))
    above = list(range(1, len(symbols) + 1))
    previous = [-1] * n
    taken = bytearray(n)
    order = []
    g = len(symbols) - 1
    while g >= 0:
        live = [s for s in members[g] if group[s] == g]  # ascending, as every move keeps the order
        if live:
            order.append(live)
        for s in live:
            taken[s] = 1
        if len(live) == 1:
            p = live[0] - 1
            while p >= 0 and taken[p]:
                p = previous[p]
            previous[live[0]] = p
            moves = {(1, group[p]): [p]} if p >= 0 else {}
        else:
            counts: dict[int, int] = {}
            for s in live:
                p = s - 1
                while p >= 0 and taken[p]:
                    p = previous[p]
                previous[s] = p
                if p >= 0:
                    counts[p] = counts.get(p, 0) + 1
            moves = {}
            for p, copies in counts.items():
                moves.setdefault((copies, group[p]), []).append(p)
        # Each new group is put right above the one it leaves: most copies first, so that they end up highest.
        for key in sorted(moves, reverse=True) if len(moves) > 1 else moves:
            old, new, moved = key[1], len(members), moves[key]
            members.append(moved)
            for p in moved:
                group[p] = new
            up = above[old]
            above.append(up)
            below.append(old)
            above[old] = below[up] = new
        members[g] = []
        g = below[g]
    order.reverse()
    return order, previous


def emit(groups: list[list[int]], previous: list[int]) -> list[int]:
    """The suffix order out of the groups and the previous-smaller pointers."""
    n = len(previous)
    place, at = [0] * n, 0
    head = []
    for number, members in enumerate(groups):
        head.append(at)
        at += len(members)
        for s in members:
            place[s] = number
    out = [0] * n
    waiting = bytearray(b"\x01") * n
    s = n - 1
    for i in range(-1, n - 1):
        if i >= 0:
            s = out[i] - 1
        while s >= 0 and waiting[s]:
            g = place[s]
            out[head[g]] = s
            head[g] += 1
            waiting[s] = 0
            s = previous[s]
    return out

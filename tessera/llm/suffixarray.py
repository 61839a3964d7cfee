"""Linear-time suffix sorting by groups of Lyndon prefixes (Baier 2016)."""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(s: Sequence[int]) -> list[int]:
    """The starts of the suffixes of s in lexicographic order (a suffix comes before those that it is a prefix of).

    First, suffixes are grouped by their first symbol, and the groups are processed from the highest down. Each suffix of
    the current group points to the nearest one before it of a lower group; those pointed at are split from the rest of
    their group, higher the more pointers they got. After that the suffixes of a group share their longest Lyndon prefix.
    Then the suffixes come out in order: each one emitted, from the lowest, puts the one before it, and along its pointers those
    that are next in their groups, at the front of their group. No string is renamed and nothing recurs."""
    n = len(s)
    by: dict[int, set[int]] = {}
    for i, c in enumerate(s):
        if c in by:
            by[c].add(i)
        else:
            by[c] = {i}
    members = [by[c] for c in sorted(by)]
    group = [0] * n
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    top = len(members)
    # Neighbours in the order of groups; the last place is a stop above the highest group, for which its number moves on.
    below, above = list(range(-1, top)), list(range(1, top + 1)) + [-1]
    members.append(set())
    done, prev, up = bytearray(n), [-1] * n, list(range(-1, n - 1))
    g = top - 1
    while g >= 0:
        m = members[g]
        if m:
            for i in m:
                done[i] = 1
            counts: dict[int, int] = {}
            for i in m:
                j = up[i]
                if j >= 0 and done[j]:
                    path = [i]
                    while j >= 0 and done[j]:
                        path.append(j)
                        j = up[j]
                    for k in path:
                        up[k] = j
                prev[i] = j
                if j >= 0:
                    counts[j] = counts.get(j, 0) + 1
            for most in sorted(set(counts.values()), reverse=True):
                parts: dict[int, list[int]] = {}
                for p, k in counts.items():
                    if k == most:
                        h = group[p]
                        if h in parts:
                            parts[h].append(p)
                        else:
                            parts[h] = [p]
                for h, ps in parts.items():
                    if len(ps) == len(members[h]):
                        continue
                    new, over = len(members), above[h]
                    members[h].difference_update(ps)
                    members.append(set(ps))
                    for p in ps:
                        group[p] = new
                    above.append(over)
                    below.append(h)
                    below[over], above[h] = new, new
        g = below[g]
    front, g, at = [0] * len(members), 0, 0
    while g != top:
        front[g] = at
        at += len(members[g])
        g = above[g]
    out, placed = [0] * n, bytearray(n)
    for k in range(-1, n):
        i = (n if k < 0 else out[k]) - 1
        while i >= 0 and not placed[i]:
            placed[i] = 1
            g = group[i]
            out[front[g]] = i
            front[g] += 1
            i = prev[i]
    return out

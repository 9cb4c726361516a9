"""Edit distance of two sequences of integers within a band, bit-parallel (Myers 1999, Hyyrö 2003)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence


def whole_distance(a: Sequence[int], b: Sequence[int]) -> int:
    """Edit distance; a's places are the bits of one integer."""
    n = len(a)
    if not n:
        return len(b)
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    every, top = (1 << n) - 1, 1 << (n - 1)
    vp, vn, score = every, 0, n
    for y in b:
        x = at.get(y, 0)
        d0 = (((x & vp) + vp) ^ vp) | x | vn
        hp = vn | ~(d0 | vp)
        hn = d0 & vp
        score += bool(hp & top) - bool(hn & top)
        hp = hp << 1 | 1
        vp = (hn << 1 | ~(d0 | hp)) & every
        vn = d0 & hp & every
    return score


def band_distance(a: Sequence[int], b: Sequence[int], most: int) -> int | None:
    """Edit distance if at most `most`; only cells at most `most` off the main diagonal are computed."""
    if abs(len(a) - len(b)) > most:
        return None
    start = 0
    least = min(len(a), len(b))
    while start < least and a[start] == b[start]:
        start += 1
    end = 0
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not len(a) or not len(b):
        return max(len(a), len(b))
    left, right = Counter(a), Counter(b)
    if max((left - right).total(), (right - left).total()) > most:
        return None
    if len(a) <= 2 * most + 2:
        d = whole_distance(a, b)
        return d if d <= most else None
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    width = 2 * most + 2
    every, corner, edge = (1 << width) - 1, 1 << (width - 1), 1 << (width - 2)
    vp, vn, score, shift = every ^ ((1 << (width - most - 1)) - 1), 0, most, most + 1 - width
    for i, y in enumerate(b):
        x = at.get(y, 0)
        x = (x >> shift if shift >= 0 else x << -shift) & every
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & every
        hp = (vn | ~(d0 | vp)) & every
        hn = d0 & vp
        if i < len(a) - most:
            score += not d0 & corner
        else:
            score += bool(hp & edge) - bool(hn & edge)
            edge >>= 1
        if score > 2 * most + len(b) - len(a) + most:
            return None
        vp = (hn | ~(d0 >> 1 | hp)) & every
        vn = d0 >> 1 & hp
        shift += 1
    return score if score <= most else None

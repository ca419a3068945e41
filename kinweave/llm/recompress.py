"""Locally consistent naming of text by recompression, as array programs over batches of code points.

A text starts as one symbol per character. First, runs of one character become single symbols; then, round after round,
every symbol is called left or right by a bit of its name, and each left symbol followed by a right one becomes a pair with
a new name. Names are computed from the names they replace, so all workers give equal stretches equal names without asking
each other. Beside its extent every symbol carries its context: the characters that fix how it came about. Wherever those
stand again, the same symbol stands again, whatever is around them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_U = np.uint64
_SEP = _U(0xFFFFFFFFFFFFFFFF)
_K1, _K2, _K3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit names (finaliser of a public hash)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


@dataclass
class Level:
    """Symbols of one round: name, extent [start, end) and context [low, high), in positions of the batch."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _before(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x[:1], x[:-1]])


def _after(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x[1:], x[-1:]])


def characters(points: np.ndarray, breaks: np.ndarray) -> Level:
    """The first level; at `breaks` stand separators between texts."""
    name = mix(points.astype(_U) + _K1)
    name[breaks] = _SEP
    at = np.arange(len(points), dtype=np.int32)
    return Level(name, at, at + np.int32(1), at, at + np.int32(1))


def name_runs(v: Level, longest: int) -> Level:
    """Runs of equal symbols of one character become one symbol, but for runs of more than `longest` characters."""
    n = len(v.name)
    first = np.ones(n, dtype=bool)
    first[1:] = (v.name[1:] != v.name[:-1]) | (v.name[1:] == _SEP)
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, n))
    joined = (size > 1) & (size <= longest)
    group = np.cumsum(first) - 1
    keep = first | ~joined[group]
    name = v.name.copy()
    at_joined = at[joined]
    name[at_joined] = mix(name[at_joined] * _K2 + size[joined].astype(_U) * _K3)
    end = v.end.copy()
    end[at_joined] = at_joined + size[joined]
    low, high = _before(v.low), end.copy()
    high[at] = np.append(v.high, v.high[-1:])[np.minimum(at + size, n)]
    inside = np.flatnonzero((size > longest)[group])
    if len(inside):
        g = group[inside]
        lo = np.maximum(at[g], np.minimum(inside, at[g] + size[g] - longest - 1))
        low[inside], high[inside] = lo, lo + longest + 1
    return Level(name[keep], v.start[keep], end[keep], low[keep].astype(np.int32), high[keep].astype(np.int32))


def name_pairs(v: Level, turn: int, longest: int) -> Level:
    """One round of pairs; no symbol grows beyond `longest` characters."""
    odd = _U((2 * turn + 1) * int(_K2) & 0xFFFFFFFFFFFFFFFF | 1)
    left = (v.name * odd) >> _U(63) == 0
    apart = v.name == _SEP
    pair = left[:-1] & ~left[1:] & ~apart[:-1] & ~apart[1:]
    pair &= v.end[1:] - v.start[:-1] <= longest
    i = np.flatnonzero(pair)
    keep = np.ones(len(left), dtype=bool)
    keep[i + 1] = False
    name, end = v.name.copy(), v.end.copy()
    name[i] = mix(v.name[i] * _K1 + (v.name[i + 1] ^ (v.name[i + 1] >> _U(29))) * _K3)
    end[i] = v.end[i + 1]
    low = np.where(left, v.low, _before(v.low))
    high = np.where(left, _after(v.high), v.high)
    return Level(name[keep], v.start[keep], end[keep], low[keep], high[keep])


_BASES = ((_U(0x5851F42D4C957F2D), _K1), (_U(0xD1342543DE82EF95), _K2))
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _power(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, kept for later batches."""
    while len(_powers) <= k:
        _powers.append((np.ones(1, dtype=_U), np.ones(1, dtype=_U)))
    if len(_powers[k][0]) < n:
        base = _BASES[k][0]
        p, q = np.full(n, base, dtype=_U), np.full(n, _U(pow(int(base), -1, 1 << 64)), dtype=_U)
        p[0] = q[0] = 1
        _powers[k] = (np.multiply.accumulate(p), np.multiply.accumulate(q))
    return _powers[k]


class Hashes:
    """Fingerprints of any stretch of a batch, 64 bits for each k: polynomials modulo 2**64 over scrambled characters."""

    def __init__(self, points: np.ndarray):
        self.points, self.sums = points, {}

    def one(self, low: np.ndarray, high: np.ndarray, k: int = 0) -> np.ndarray:
        """Equal for equal stretches, wherever they lie."""
        n = len(self.points)
        p, q = _power(k, n + 1)
        if k not in self.sums:
            x = np.zeros(n + 1, dtype=_U)
            np.cumsum(mix(self.points.astype(_U) + _BASES[k][1]) * p[:n], out=x[1:])
            self.sums[k] = x
        x = self.sums[k]
        return mix((x[high] - x[low]) * q[low])


def least_in_ranges(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Position of the least of values[a:b] for each non-empty range, the first of equal ones."""
    n, width = len(values), int((b - a).max(initial=1))
    best = [np.arange(n)]
    step = 1
    while 2 * step <= width:
        x = best[-1]
        y = x[np.minimum(np.arange(n) + step, n - 1)]
        best.append(np.where(values[y] < values[x], y, x))
        step *= 2
    level = np.frexp((b - a).astype(np.float64))[1] - 1
    out = np.empty(len(a), dtype=np.int64)
    for k in range(len(best)):
        m = level == k
        if m.any():
            x, y = best[k][a[m]], best[k][b[m] - (1 << k)]
            out[m] = np.where(values[y] < values[x], y, x)
    return out


def choose(v: Level, order: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """For all windows [p, p + width) with first <= p <= last of each given range, the symbol chosen to stand for them.

    A window's symbol is the one of least `order` among those whose context lies inside the window, so that equal windows
    choose equal symbols at equal places. Returns symbol, lowest and highest p of each stretch of windows with one choice,
    and the ranges of windows without any.
    """
    low, high = v.low.astype(np.int64), v.high.astype(np.int64)
    cuts = np.unique(np.concatenate([first, last + 1, low + 1, np.maximum(high - width, 0)]))
    r = np.searchsorted(first, cuts, "right") - 1
    inside = (r >= 0) & (cuts <= last[np.maximum(r, 0)])
    p1 = cuts[inside]
    p2 = np.minimum(np.append(cuts[1:], cuts[-1:] + 1)[inside] - 1, last[r[inside]])
    a, b = np.searchsorted(low, p1, "left"), np.searchsorted(high, p1 + width, "right")
    some = b > a
    none = (p1[~some], p2[~some])
    p1, p2, r = p1[some], p2[some], r[inside][some]
    s = least_in_ranges(order, a[some], b[some])
    if len(s):
        new = np.ones(len(s), dtype=bool)
        new[1:] = (s[1:] != s[:-1]) | (p1[1:] != p2[:-1] + 1) | (r[1:] != r[:-1])
        at = np.flatnonzero(new)
        s, p1, p2 = s[at], p1[at], np.maximum.reduceat(p2, at)
    return s, p1, p2, none


def anchors(points: np.ndarray, breaks: np.ndarray, width: int, rounds: tuple[int, ...] = (11, 8), longest: int = 64) -> tuple[np.ndarray, ...]:
    """(key, at, p1, p2): stretches of windows [p, p + width), p1 <= p <= p2, with the key and place of their chosen symbol.

    Symbols of the last round stand for most windows, those of an earlier one for windows that hold none whole with its
    context; windows without any stand for themselves. Equal windows have equal keys at equal distances.
    """
    first, last = breaks[:-1] + 1, breaks[1:] - width
    some = last >= first
    first, last = first[some], last[some]
    if not len(first):
        e = np.empty(0, dtype=np.int64)
        return e.astype(_U), e, e, e
    v, kept = name_runs(characters(points, breaks), longest), {}
    for turn in range(1, max(rounds) + 1):
        v = name_pairs(v, turn, longest)
        if turn in rounds:
            kept[turn] = v
    h, out = Hashes(points), []
    for turn in sorted(rounds, reverse=True):
        v = kept[turn]
        ok = (v.name != _SEP) & (v.high - v.low <= width)
        v = Level(v.name[ok], v.start[ok], v.end[ok], v.low[ok], v.high[ok])
        if not len(v.name):
            continue
        s, p1, p2, (first, last) = choose(v, mix(v.name), first, last, width)
        low, high = v.low[s].astype(np.int64), v.high[s].astype(np.int64)
        out.append((h.one(low, high) ^ mix(v.name[s] + _U(turn)), v.start[s].astype(np.int64), p1, p2))
        if not len(first):
            break
    if len(first):
        p = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
        out.append((h.one(p, p + width), p, p, p))
    return tuple(np.concatenate(x) for x in zip(*out))

"""Blocks of cells that share a key of phonetic codes, compared where they meet after one exchange.

A cell (cells.py) enters several blocks. A row of a block is (key, fit, cell, spelt, mark, words): the key is a hash of its text; mark one of CallNames.mark, 0 if empty; fit
holds years of birth, parish and place (12 and 16 bits of them), censuses, sex, kind of key and side in one number, its order being that of the years.
A task holds no more of a block than a window of years and the cells without year. Names are compared once for each two
spellings that meet in a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from kinweave.llm.cells import CENSUSES, NEAR
from kinweave.llm.names import CallNames, phonetic, stem_of_patronymic, words_alike

#: Years that a year of birth rounded down to the decade may be off.
ROUNDED = 10
#: Likeness of names from which two cells at one place need no count of others to be one.
SURE = 0.84
#: Most years between the first and last year of birth of a cell that a row holds.
SPAN = 15
ROWS = "key bigint, fit bigint, cell bigint, spelt bigint, mark bigint, words string"
_NAMES = ["key", "fit", "cell", "spelt", "mark", "words"]
_MET = (1 << CENSUSES) - 1
_U, _ALL = np.uint64, (1 << 64) - 1


def fit_of(lo, hi, parish, place, met, sex, kind, side) -> np.ndarray:
    return (lo << 51) | (np.minimum(hi - lo, SPAN) << 47) | (parish << 35) | (place << 19) | (met << 5) | (sex << 3) | (kind << 1) | side


def fit_parts(fit: np.ndarray) -> dict[str, np.ndarray]:
    lo = (fit >> 51).astype(np.int32)
    return {
        "lo": lo, "hi": lo + ((fit >> 47) & SPAN).astype(np.int32), "parish": ((fit >> 35) & 0xFFF).astype(np.int32), "place": ((fit >> 19) & 0xFFFF).astype(np.int32), "met": ((fit >> 5) & _MET).astype(np.int32),
        "sex": ((fit >> 3) & 3).astype(np.int8), "kind": ((fit >> 1) & 3).astype(np.int8), "side": (fit & 1).astype(np.int8),
    }


def _mixed(seed: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (seed ^ (x.astype(_U) * _U(0x9E3779B97F4A7C15))) * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(32)
    h *= _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(29))


_seeds: dict[int, dict[str, tuple]] = {}


class _Seeds:
    """Hashes of each name's codes, for the three kinds of keys; given names also as what they may be call names of.

    Names are taken in any order that their last token leaves open: a last token that is no patronymic may as well be the first.
    A worker keeps the hashes for the tasks that follow with the same call names.
    """

    def __init__(self, calls: CallNames):
        import xxhash

        mark = xxhash.xxh64_intdigest(repr((sorted((k, sorted(v)) for k, v in calls.of.items()), len(calls.known))))
        if mark not in _seeds:
            _seeds.clear()
        self.digest, self.calls, self.known, self.codes = xxhash.xxh64_intdigest, calls, _seeds.setdefault(mark, {}), {}

    def code(self, token: str) -> int:
        got = self.codes.get(token)
        if got is None:
            if len(self.codes) > 200_000:
                self.codes.clear()
            got = self.codes[token] = self.digest(phonetic(token))
        return got

    def of(self, words: str) -> tuple[tuple[int, ...], ...]:
        got = self.known.get(words)
        if got is None:
            t = words.split(" ") if words else []
            one, two, three = set(), set(), set()
            orders = [(t[0], t[-1])] if len(t) > 1 else [(t[0], "")] if t else []
            if len(t) > 1 and not stem_of_patronymic(t[-1])[1]:
                orders.append((t[-1], t[0]))
            for first, last in orders:
                code = self.code(stem_of_patronymic(last)[0]) if last else 0
                for g in (first, *self.calls.roots(first)):
                    f = self.code(g)
                    two.add(f ^ 2)
                    if last:
                        one.add((code * 31 + ord(g[0]) * 0x9E3779B97F4A7C15 + 1) & _ALL)
                        three.add(((f + code) * 0x9E3779B97F4A7C15 ^ f ^ code) & _ALL)
            if len(t) > 2:
                all_of = sum(map(self.code, t))
                three.add((all_of * 0xC4CEB9FE1A85EC53 + 4) & _ALL)
            got = tuple(one), tuple(two), tuple(three)
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[words] = got
        return got


def key_rows(calls: CallNames, side: int, bands: str):
    """Rows of blocks for cells (cells.CELL). Kinds of keys:

    1 last-name code, first letter, parish and sex; 2 first-name code, parish, sex and years of birth in eights; 3 the codes of
    a first and a last name, sorted, or of all of three tokens or more, with sex and such years. A place of no known parish
    stands for one. bands: `own` for the eights of
    the cell's years, `next` also for those that begin within two years, `both` also for those that ended within two years.
    Two cells within two years of each other meet if both have `next`, or if one has `own` and the other `both`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _Seeds(calls)
        for b in batches:
            if not b.num_rows:
                continue
            names = b.column(1).dictionary_encode()
            code = names.indices.to_numpy(zero_copy_only=False)
            text = names.dictionary.to_pylist()
            lists = [seeds.of(x) for x in text]
            marks = np.array([seeds.digest(m) if (m := calls.mark(x)) else 0 for x in text], dtype=_U).view(np.int64)
            sexes, lo, hi, met = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (5, 6, 7, 8))
            hi = np.minimum(hi, lo + SPAN)
            parish = np.where(b.column(4).is_null().to_numpy(zero_copy_only=False), 0, b.column(4).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) % 4_093 + 1)
            placed = ~b.column(3).is_null().to_numpy(zero_copy_only=False)
            place = b.column(3).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            # One number for a parish, another for a place without one.
            zone = np.where(parish > 0, 2 * b.column(4).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), 2 * place + 1)
            first, last = (lo - NEAR * (bands == "both")) // 8, (hi + NEAR * (bands != "own")) // 8
            keys, rows, kinds = [], [], []
            for kind in (1, 2, 3):
                flat = np.array([h for x in lists for h in x[kind - 1]], dtype=_U)
                n = np.array([len(x[kind - 1]) for x in lists], dtype=np.int64)
                row, at = _spread((np.cumsum(n) - n)[code], np.cumsum(n)[code], np.arange(len(code)))
                seed = flat[at] if len(at) else np.empty(0, dtype=_U)
                if kind < 3:
                    seed, row = seed[placed[row]], row[placed[row]]
                    seed = _mixed(seed, zone[row])
                # A cell of unknown sex enters the blocks of both.
                both = np.flatnonzero(sexes[row] == 0)
                of = np.concatenate([np.maximum(sexes[row], 1), np.full(len(both), 2)])
                seed, row = np.concatenate([seed, seed[both]]), np.concatenate([row, row[both]])
                seed = _mixed(seed, of)
                if kind > 1:
                    dated = lo[row] > 0
                    seed, row = seed[dated], row[dated]
                    at, eight = _spread(first[row], last[row] + 1, np.arange(len(row)))
                    seed, row = _mixed(seed[at], eight), row[at]
                keys.append(seed), rows.append(row), kinds.append(np.full(len(row), kind))
            row, key, kind = np.concatenate(rows), np.concatenate(keys), np.concatenate(kinds)
            where = np.where(placed, place % 65_521 + 1, 0)[row]
            fit = fit_of(lo[row], hi[row], parish[row], where, met[row], sexes[row], kind, side)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fit), b.column(0).take(take), b.column(2).take(take), pa.array(marks[code[row]]), b.column(1).take(take)], names=_NAMES)

    return run


def _spread(lo: np.ndarray, hi: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.maximum(hi - lo, 0)
    return np.repeat(i, n), np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Met(NamedTuple):
    """Pairs of cells that met: all arrays of one length."""

    one: np.ndarray
    two: np.ndarray
    met_1: np.ndarray  # bits of the censuses
    met_2: np.ndarray
    kind: np.ndarray
    here: np.ndarray  # at one place
    parish: np.ndarray  # of one parish
    gap: np.ndarray  # years between the years of birth, -1 if unknown
    alike: np.ndarray
    mixed: np.ndarray
    equal: np.ndarray  # spelling
    others: np.ndarray  # other persons near in years, as alike to one of the two: at the place or in the parish of a pair that has one, else anywhere
    rate: np.ndarray  # share of all names that is as these two are, in two-sided blocks, else 1
    large: np.ndarray  # the larger of the shares of records that are at the two's places, 0 unless a place is large
    placed: np.ndarray  # both at a known place
    wide: np.ndarray  # years between the first and last year of birth of the two, together


def compared(calls: CallNames, judge: Callable, two_sided: bool, rows: int = 100_000, most: int = 1_500_000, large: dict[int, float] | None = None):
    """Runs over rows sorted by (key, fit): enumerates the pairs of each block and hands them to `judge` as `Met`.

    One-sided blocks give each pair once; two-sided ones pairs of side 0 (one) and side 1 (two). Cells meet whose years of
    birth are within NEAR; under kind 1 also all of which one has no year, or one rounded down, within ROUNDED. Two cells of
    one census are two persons, and in one-sided blocks no pair. `others` counts cells near in years whose names are alike (or
    alike as much as the pair's, in two-sided blocks, on side 0 only), in the census that has most of them, less the pair's own:
    those at the pair's place if it has one, else those of its parish, else all.
    large: places that hold many of the records, with the share that they hold.
    """
    held_at = np.zeros(65_522)
    for bi, share in (large or {}).items():
        held_at[bi % 65_521 + 1] = share

    def alikes(text: list[str], code: np.ndarray, mark: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        """(i, likeness, mixed, rate) of the pairs of rows whose names are alike or mixed."""
        i = np.flatnonzero((mark[x] == 0) | (mark[y] == 0) | (mark[x] == mark[y]))
        if not len(i):
            return i, np.zeros(0), np.zeros(0, dtype=bool), np.zeros(0)
        once, back = np.unique(code[x[i]].astype(np.int64) * len(text) + code[y[i]], return_inverse=True)
        got = [words_alike(text[v // len(text)], text[v % len(text)], calls) for v in once.tolist()]
        rate = np.array([calls.rate(text[v // len(text)], text[v % len(text)], g[1]) if two_sided and (g[0] or g[1]) else 1.0 for v, g in zip(once.tolist(), got)])[back]
        alike, mixed = np.array([g[0] for g in got])[back], np.array([g[1] for g in got])[back]
        on = (alike > 0) | mixed
        return i[on], alike[on], mixed[on], rate[on]

    def sliced(lo: np.ndarray, hi: np.ndarray, i: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i[k], l) with lo[k] <= l < hi[k], some at a time."""
        upto, at = np.cumsum(np.maximum(hi - lo, 0)), 0
        while at < len(lo):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most // 4, "right")))
            yield _spread(lo[at:end], hi[at:end], i[at:end])
            at = end

    def pairs(t: pa.Table, fresh: int, upto: int) -> Iterator[pa.RecordBatch]:
        """Pairs whose later row comes at `fresh` or later and before `upto`."""
        t = t.combine_chunks()
        key, part = t.column("key").to_numpy(), fit_parts(t.column("fit").to_numpy())
        n = len(key)
        lo, hi, met, kind, place, parish, side, sex = (part[x] for x in ("lo", "hi", "met", "kind", "place", "parish", "side", "sex"))
        block = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
        ends = np.searchsorted(block, np.arange(block[-1] + 1), "right")[block]
        names = t.column("words").combine_chunks().dictionary_encode()
        names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
        text, code = names.dictionary.to_pylist(), names.indices.to_numpy()
        same, mark = t.column("spelt").to_numpy(), t.column("mark").to_numpy()
        cell = t.column("cell").to_numpy()
        bits = [c for c in range(CENSUSES) if np.bitwise_or.reduce(met) >> c & 1]
        dated, ten = lo > 0, (lo == hi) & (lo % 10 == 0)

        def gaps(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return np.where(dated[i] & dated[j], np.maximum(0, np.maximum(lo[j] - hi[i], lo[i] - hi[j])), -1)

        def sexed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return (sex[i] == sex[j]) | (sex[i] == 0) | (sex[j] == 0)

        def told(i, j, gap, alike, mixed, others, rate) -> Iterator[pa.RecordBatch]:
            if len(i):
                at = (place[i] == place[j]) & (place[i] > 0), (parish[i] == parish[j]) & (parish[i] > 0)
                yield from judge(Met(cell[i], cell[j], met[i], met[j], kind[i], *at, gap, alike, mixed, same[i] == same[j], others, rate, np.maximum(held_at[place[i]], held_at[place[j]]), (place[i] > 0) & (place[j] > 0), (hi - lo)[i] + (hi - lo)[j]))

        def levels(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Which pairs are of one parish (or one place), and which of one place."""
            at = (place[i] == place[j]) & (place[i] > 0)
            return at | ((parish[i] == parish[j]) & (parish[i] > 0)), at

        def as_alike(i: np.ndarray, r: np.ndarray, gap: np.ndarray, alike: np.ndarray) -> np.ndarray:
            """How many others are as alike to r as i is, of pairs sorted by r and, from the most alike on, by likeness."""
            begins = np.concatenate([[True], r[1:] != r[:-1]])
            starts = np.flatnonzero(begins)
            last = np.flatnonzero(np.concatenate([begins[1:] | (alike[1:] != alike[:-1]), [True]]))
            last = last[np.searchsorted(last, np.arange(len(r)))]
            counts, persons = (gap <= NEAR) & ((gap >= 0) | ~dated[r]), np.zeros(len(r), dtype=np.int64)
            for c in bits:
                sums = np.cumsum((met[i] >> c & 1) * counts)
                before = np.where(starts > 0, sums[starts - 1], 0)[np.cumsum(begins) - 1]
                persons = np.maximum(persons, sums[last] - before - (met[i] >> c & 1) * counts)
            return persons

        def crossed() -> Iterator[pa.RecordBatch]:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                return
            at = block.astype(np.int64) * 8192
            years, wide = (at + lo)[left], int((hi - lo)[left].max())
            start, end = np.searchsorted(block[left], block[right], "left"), np.searchsorted(block[left], block[right], "right")
            # Under kind 1 all years of the block from those of a rounded gap, and all without year; a right cell without year meets all.
            first, far = kind[right] == 1, np.where(kind[right] == 1, ROUNDED, NEAR)
            begin = np.where(dated[right], np.searchsorted(years, (at + np.maximum(1, lo - wide))[right] - far, "left"), np.where(first, start, 0))
            begin = np.maximum(begin, start)
            stop = np.where(dated[right], np.searchsorted(years, (at + hi)[right] + far, "right"), np.where(first, end, 0))
            undated = np.searchsorted(years, at[right], "right")
            extra = np.where(first & dated[right], np.minimum(undated, begin), start)
            for los, his in ((begin, stop), (start, extra)):
                for r, l in sliced(los, his, right):
                    i = left[l]
                    gap = gaps(i, r)
                    ok = sexed(i, r) & ((gap <= NEAR) | np.where(lo[i] < lo[r], ten[i], ten[r])) & (cell[i] != cell[r])
                    i, r, gap = i[ok], r[ok], gap[ok]
                    ok, alike, mixed, rate = alikes(text, code, mark, i, r)
                    i, r, gap = i[ok], r[ok], gap[ok]
                    if not len(i):
                        continue
                    order = np.lexsort((-alike, r))
                    i, r, gap, alike, mixed, rate = i[order], r[order], gap[order], alike[order], mixed[order], rate[order]
                    persons = as_alike(i, r, gap, alike)
                    for of in levels(i, r):
                        on = np.flatnonzero(of)
                        if len(on):
                            persons[on] = as_alike(i[on], r[on], gap[on], alike[on])
                    later = np.maximum(i, r)
                    on = (later >= fresh) & (later < upto)
                    yield from told(i[on], r[on], gap[on], alike[on], mixed[on], persons[on], rate[on])

        def within() -> Iterator[pa.RecordBatch]:
            at = block.astype(np.int64) * 8192
            years, index = at + lo, np.arange(n)
            near = np.where(dated, np.searchsorted(years, at + hi + NEAR, "right"), index + 1)
            found = []
            count = np.zeros((3, 2, len(bits), n), dtype=np.int32)  # anywhere, in the parish, at the place
            for k, j in sliced(index + 1, np.minimum(near, ends), index):
                # Under kind 1 nobody is counted: who else is near with a first name alike shows under kind 2.
                ok = sexed(k, j) & (cell[k] != cell[j]) & ((kind[k] != 1) | ((met[k] & met[j]) == 0))
                k, j = k[ok], j[ok]
                ok, alike, mixed, rate = alikes(text, code, mark, k, j)
                k, j = k[ok], j[ok]
                ok = (kind[k] != 1) | (alike >= SURE)
                k, j, alike, mixed, rate = k[ok], j[ok], alike[ok], mixed[ok], rate[ok]
                for of, among in enumerate((None, *levels(k, j))):
                    k_of, j_of, named = (k, j, alike > 0) if among is None else (k[among], j[among], alike[among] > 0)
                    for c, b in enumerate(bits):
                        for x, y in ((k_of, j_of), (j_of, k_of)):
                            has = (met[y] >> b & 1) > 0
                            count[of, 1, c] += np.bincount(x[has], minlength=n).astype(np.int32)
                            has &= named
                            count[of, 0, c] += np.bincount(x[has], minlength=n).astype(np.int32)
                found.append((k, j, alike, mixed, rate))
            # Without a year a cell meets all of its block under kind 1, and with a rounded one those within ten years.
            first = kind == 1
            wide = np.where(dated, np.searchsorted(years, at + hi + ROUNDED, "right"), ends)
            lone = index[first]
            for k, j in sliced(np.maximum(near, index + 1)[lone], np.minimum(wide, ends)[lone], lone):
                ok = sexed(k, j) & (cell[k] != cell[j]) & ((met[k] & met[j]) == 0) & (ten[k] | ~dated[k])
                k, j = k[ok], j[ok]
                ok, alike, mixed, rate = alikes(text, code, mark, k, j)
                on = alike >= SURE
                found.append((k[ok][on], j[ok][on], alike[on], mixed[on], rate[on]))
            for k, j, alike, mixed, rate in found:
                ok = (met[k] & met[j]) == 0
                ok &= (kind[k] != 3) | (place[k] != place[j]) | (place[k] == 0)  # pairs of one place meet under the other kinds
                ok &= (np.maximum(k, j) >= fresh) & (np.maximum(k, j) < upto)
                k, j, alike, mixed, rate = k[ok], j[ok], alike[ok], mixed[ok], rate[ok]
                others, sort = np.zeros(len(k), dtype=np.int32), (alike == 0).astype(np.int8)
                of = np.add(*(x.astype(np.int8) for x in levels(k, j)))
                for c, b in enumerate(bits):
                    for x, y in ((k, j), (j, k)):
                        others = np.maximum(others, count[of, sort, c, x] - (met[y] >> b & 1))
                yield from told(k, j, gaps(k, j), alike, mixed, others, rate)

        yield from crossed() if two_sided else within()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        fresh = 0
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < rows:
                continue
            key = held.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut:  # whole blocks
                yield from pairs(held.slice(0, cut), fresh, cut)
                held, fresh = held.slice(cut), max(0, fresh - cut)
            if held.num_rows >= 2 * rows:
                # One large block: its last years wait for what follows, and those before them and the cells without year go on.
                lo = fit_parts(held.column("fit").to_numpy())["lo"]
                wait = int(np.searchsorted(lo, lo[-1] - 2 * NEAR, "left"))
                if wait > fresh:
                    yield from pairs(held, fresh, wait)
                    stay = np.flatnonzero((lo == 0) | (lo >= lo[-1] - 2 * NEAR - ROUNDED - SPAN))
                    fresh = int(np.searchsorted(stay, wait, "left"))
                    held = held.take(pa.array(stay))
        if held is not None and held.num_rows:
            yield from pairs(held, fresh, held.num_rows)

    return run

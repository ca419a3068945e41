"""Problem 7: free-entered values mapped to a reference list."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinweave.llm.fold import folded

_TOKEN = re.compile(r"[^\s,;:()\[\]/\"'!?*+=]+")


def edit_distances(left: list[str], right: list[str]) -> np.ndarray:
    """Edit distances, swaps of neighbours included, of every left text to every right text, as one array program."""
    def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(w) for w in words], dtype=np.int64)
        out = np.zeros((len(words), max(1, n.max(initial=0))), dtype=np.int32)
        for i, w in enumerate(words):
            out[i, : len(w)] = [ord(c) for c in w]
        return out, n

    (a, na), (b, nb) = coded(left), coded(right)
    wa, wb = a.shape[1], b.shape[1]
    rows = [np.broadcast_to(np.arange(wb + 1, dtype=np.int16), (len(left), len(right), wb + 1)).copy()]
    result = np.where(na[:, None] == 0, nb[None, :], 0).astype(np.int16)
    for i in range(1, wa + 1):
        prev = rows[-1]
        cur = np.empty_like(prev)
        cur[:, :, 0] = i
        for j in range(1, wb + 1):
            same = a[:, i - 1][:, None] == b[:, j - 1][None, :]
            d = np.minimum(np.minimum(prev[:, :, j], cur[:, :, j - 1]) + 1, prev[:, :, j - 1] + ~same)
            if i > 1 and j > 1:
                swap = (a[:, i - 1][:, None] == b[:, j - 2][None, :]) & (a[:, i - 2][:, None] == b[:, j - 1][None, :])
                d = np.where(swap, np.minimum(d, rows[-2][:, :, j - 2] + 1), d)
            cur[:, :, j] = d
        rows = [prev, cur]
        at = na == i
        if at.any():
            result[at] = np.take_along_axis(cur[at], np.broadcast_to(nb[None, :, None], (at.sum(), len(right), 1)), axis=2)[:, :, 0]
    return result


class Canon:
    """A reference list in the memory of a worker: an automaton over its names, and the rest by similarity of token sets.

    entries: (entry id, names). A value means, in this order:
    1. the entry of the longest name or alias mentioned in it, mentions taken longest first without overlap; the first
       of equally long ones. Case, accents, spaces and hyphens inside a name don't count, word limits do;
    2. of a word cut off with a full stop, the entry whose name begins so; among several entries the heaviest in `weight`;
    3. the entry of the name whose set of tokens is most similar to the value's, `least` at least, tokens in any order: the
       mean, by length, of how near in edits (of the longer one) each token of the name comes to a token of the value or to
       up to `widest` neighbouring ones written as one; a name written as one word stands for its set too;
    4. else 0.
    """

    def __init__(self, entries: Iterable[tuple[int, list[str]]], weight: dict[int, float] | None = None, least: float = 0.68, least_prefix: int = 3, widest: int = 3):
        import ahocorasick

        self.least, self.least_prefix, self.widest, self.weight = least, least_prefix, widest, weight or {}
        names: dict[str, int] = {}
        sets: dict[str, tuple[str, ...]] = {}
        for entry, texts in entries:
            for text in texts:
                key = self._key(text)
                if key:
                    names.setdefault(key, entry)
                    sets.setdefault(key, tuple(dict.fromkeys(t for t in map(self._key, _TOKEN.findall(folded(text))) if t)))
        self.names, self.ids = list(names), np.array(list(names.values()), dtype=np.int64)
        # Texts that tokens of a value are held against, and the sets of names of several tokens as their places.
        self.words = list(dict.fromkeys([*self.names, *(w for t in sets.values() for w in t)]))
        place = {w: i for i, w in enumerate(self.words)}
        self.sets = [(k, np.array([place[w] for w in sets[n]]), np.array([len(w) for w in sets[n]], dtype=np.float64)) for k, n in enumerate(self.names) if len(sets[n]) > 1]
        self.automaton = ahocorasick.Automaton()
        for k, name in enumerate(self.names):
            self.automaton.add_word(name, (len(name), k))
        if self.names:
            self.automaton.make_automaton()
        self.known: dict[str, int] = {}

    @staticmethod
    def _key(text: str) -> str:
        return re.sub(r"[^0-9a-z]", "", folded(text))

    def _mention(self, text: str) -> int | None:
        letters, starts, ends = [], set(), set()
        for m in re.finditer(r"[0-9a-z]+", text):
            starts.add(len(letters))
            letters.extend(m.group())
            ends.add(len(letters))
        found = []
        for end, (n, k) in self.automaton.iter("".join(letters)):
            if end + 1 in ends and end + 1 - n in starts:
                found.append((-n, end + 1 - n, k))
        taken: list[tuple[int, int, int]] = []
        for n, at, k in sorted(found):
            if all(at - n <= s or e <= at for s, e, _ in taken):
                taken.append((at, at - n, k))
        return int(self.ids[taken[0][2]]) if taken else None

    def _cut(self, text: str) -> int | None:
        best: tuple[float, int] | None = None
        for m in re.finditer(r"([0-9a-z][0-9a-z -]*)\.", text):
            stem = re.sub(r"[ -]", "", m.group(1))
            for s, least in ((stem, self.least_prefix), (re.split(r"[ -]", m.group(1))[-1], self.least_prefix + 1)):
                if len(s) < least:
                    continue
                for k, name in enumerate(self.names):
                    if name.startswith(s):
                        e = int(self.ids[k])
                        best = max(best or (-1.0, 0), (self.weight.get(e, 0.0), -e))
                if best:
                    return -best[1]
        return None

    def _windows(self, text: str) -> list[str]:
        tokens = [t for t in (re.sub(r"[^0-9a-z]", "", x) for x in _TOKEN.findall(text)) if t and not t.isdigit()]
        joined = {"".join(tokens[i : i + w]) for w in range(1, self.widest + 1) for i in range(len(tokens) - w + 1)}
        longest = max(map(len, self.names), default=0)
        return [w for w in joined if 3 <= len(w) <= longest / self.least]

    def _similar(self, texts: list[str]) -> list[int]:
        spans = [self._windows(t) for t in texts]
        every = sorted({w for s in spans for w in s}, key=lambda w: (len(w), w))
        at = {w: i for i, w in enumerate(every)}
        near = np.zeros((len(every), len(self.words)), dtype=np.float32)
        lengths = np.array([len(n) for n in self.words], dtype=np.float32)
        for lo in range(0, len(every), 256):
            part = every[lo : lo + 256]
            own = np.array([len(w) for w in part], dtype=np.float32)[:, None]
            for k in range(0, len(self.words), 1024):
                near[lo : lo + 256, k : k + 1024] = 1 - edit_distances(part, self.words[k : k + 1024]) / np.maximum(own, lengths[None, k : k + 1024])
        whole = near[:, : len(self.names)]
        best = whole.argmax(axis=1) if self.names else np.zeros(len(every), dtype=np.int64)
        out = []
        for s in spans:
            rows = [at[w] for w in s]
            top = max(((float(whole[i, best[i]]), len(every[i]), -int(self.ids[best[i]])) for i in rows), default=(0.0, 0, 0))
            for k, words, size in self.sets if rows else ():
                each = near[rows][:, words].max(axis=0)
                top = max(top, (float((each * size).sum() / size.sum()), int(size.sum()), -int(self.ids[k])))
            out.append(-top[2] if top[0] >= self.least else 0)
        return out

    def map(self, values: list[str]) -> list[int]:
        rest: dict[str, str] = {}
        for v in dict.fromkeys(values):
            if v in self.known:
                continue
            t = folded(v)
            hit = (self._mention(t) or self._cut(t)) if self.names else 0
            if hit is None:
                rest[v] = t
            else:
                self.known[v] = hit
        if rest:
            texts = list(rest.values())
            found = [x for lo in range(0, len(texts), 512) for x in self._similar(texts[lo : lo + 512])]
            self.known.update(zip(rest, found))
        out = [self.known[v] for v in values]
        if len(self.known) > 500_000:  # bounds the worker's memory; a value met again is only worked out again
            self.known.clear()
        return out


def missing(c: str) -> F.Column:
    return F.col(c).isNull() | F.col(c).isin("", "NaN")


def reference_entries(listed: DataFrame, key: str, name: str, aliases: str, limit: int = 100_000) -> list[tuple[int, list[str]]]:
    """The list for the workers, proven to have at most `limit` entries."""
    got = listed.select(key, name, aliases).limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"the reference list has more than {limit} entries")
    return [(r[0], [x for x in [r[1], *((r[2] or "").split(";"))] if x]) for r in got if r[0] is not None]


def map_to_canon(rows: DataFrame, listed: DataFrame, value: str = "stada", known: str = "cleaned_status", key: str = "id", entry: str = "stada_id", aliases: str = "onnur_heiti") -> DataFrame:
    """(key, entry): for each distinct key with `known` missing and `value` present, the entry meant, or 0.

    Missing is NULL, empty or `NaN`. Cut-off words that fit several entries go to the entry that the rows with `known`
    name most often (counted over all of them). Repeated rows of a key give one row, the largest entry if they differ.
    NULL keys are left out; an empty reference list maps everything to 0. Values are worked out where they lie, each
    distinct one once per task; only (key, entry) is shuffled, combined before.
    """
    entries = reference_entries(listed, entry, known, aliases)
    names = listed.select(F.col(entry).alias("_e"), F.lower(F.trim(F.col(known))).alias("_n")).where("_n is not null")
    used = rows.where(~missing(known)).select(F.lower(F.trim(F.col(known))).alias("_n")).groupBy("_n").count()
    weight = {r["_e"]: float(r["n"]) for r in used.join(F.broadcast(names), "_n").groupBy("_e").agg(F.sum("count").alias("n")).collect()}
    todo = rows.where(missing(known) & ~missing(value) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(value).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon(entries, weight)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(canon.map(b.column(1).to_pylist()), pa.int32())], names=[key, entry])

    return todo.mapInArrow(run, f"{key} bigint, {entry} int").groupBy(key).agg(F.max(entry).alias(entry))

"""Names as people type them: tokens, phonetic codes, Jaro-Winkler, call names."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

from kinweave.llm.fold import folded

#: Endings that make a patronymic, folded; with their shortened and foreign forms. Fixed values.
_SON, _DAUGHTER = ("sson", "son", "ssen", "sen", "ss", "s"), ("dottir", "dotter", "datter", "dottr", "dtr", "dott", "d")
#: Factor of the likeness of two names of which only one has a middle name.
NO_MIDDLE = 0.7
#: How common a token is taken to be that is not established, one cut to a letter or two, and any last name of another kind.
RARE, INITIAL, MIXED = 1 / 40_000, 0.05, 0.05
#: Words beside a name that don't belong to it. Fixed values.
_BESIDE = frozenset({"yngri", "eldri", "gamli", "gamla", "yngsti", "elsti", "fra", "baenum", "jr", "sr", "hr", "fru", "jomfru", "madame", "sgr", "md", "mad", "mme", "mr"})


#: The letters of most names, as folded() has them.
_PLAIN = str.maketrans({c: folded(c) for c in "áéíóúýðþæöäøåüèë"})


@lru_cache(maxsize=200_000)
def tokens(name: str) -> tuple[str, ...]:
    """Folded tokens of a name in the order given names first: a comma moves what stands before it to the end."""
    t = name.lower().translate(_PLAIN)
    if t.isascii() and t.replace(" ", "").isalpha():
        out = [x for x in t.split() if x not in _BESIDE]
        if len(out) > 1 and _full_patronymic(out[0]) and not _full_patronymic(out[-1]):
            out = out[1:] + out[:1]
        return tuple(out)
    t = folded(_mended(name).replace(" ", " "))
    t = re.sub(r"\([^)]*\)|\"[^\"]*\"", " ", t)
    if "," in t:
        head, _, tail = t.partition(",")
        t = f"{tail} {head}"
    out = [x for x in re.findall(r"[0-9a-z]+[.:]?", t.replace("'", "").replace("-", "")) if x.rstrip(".:") not in _BESIDE]
    if len(out) > 2 and len(out[0]) > 2 and out[0][-1] in ".:" and not re.search("[aeiouy]", out[0]):  # a title
        out = out[1:]
    if len(out) > 1 and _full_patronymic(out[0]) and not _full_patronymic(out[-1]):
        out = out[1:] + out[:1]
    return tuple(out)


def _full_patronymic(token: str) -> bool:
    return len(token) > 6 and token.endswith(("sson", "dottir", "datter", "ssen"))


def _mended(name: str) -> str:
    """UTF-8 once read as a one-byte encoding is read again, pair by pair."""
    return re.sub("[\u00c2-\u00c5].", _pair, name) if re.search("[\u00c2-\u00c5]", name) else name


def _pair(m: re.Match) -> str:
    for code in ("cp1252", "latin-1"):
        try:
            return m.group().encode(code).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    return m.group()


@lru_cache(maxsize=200_000)
def stem_of_patronymic(token: str) -> tuple[str, str]:
    """(stem, sex) of a patronymic in any of its written forms; sex is empty for other tokens."""
    cut = token.endswith((".", ":"))
    t = token.rstrip(".:")
    for suffix in _DAUGHTER:
        if t.endswith(suffix) and len(t) > len(suffix) + 2 and (len(suffix) > 3 or cut):
            return t[: -len(suffix)].rstrip("s"), "Kona"
    for suffix in _SON:
        if t.endswith(suffix) and len(t) > len(suffix) + 2 and (len(suffix) > 2 or cut):
            return t[: -len(suffix)].rstrip("s"), "Karl"
    return t, ""


@lru_cache(maxsize=200_000)
def phonetic(token: str) -> str:
    """Consonants as they sound, vowels dropped after the first letter, doubles once; at most six."""
    t = token.rstrip(".:")
    for a, b in (("th", "t"), ("ph", "f"), ("w", "v"), ("ck", "k"), ("c", "k"), ("q", "k"), ("x", "ks"), ("z", "s"), ("hj", "j"), ("hv", "kv"), ("d", "t"), ("b", "p")):
        t = t.replace(a, b)
    if not t:
        return ""
    first = "a" if t[0] in "aeiouy" else t[0]
    rest = re.sub(r"[aeiouyhj0-9]", "", t[1:])
    return re.sub(r"(.)\1+", r"\1", first + rest)[:6]


@lru_cache(maxsize=500_000)
def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    hit_a = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hit_a.append(c)
                break
    m = len(hit_a)
    if not m:
        return 0.0
    hit_b = [b[j] for j in range(len(b)) if used[j]]
    moved = sum(x != y for x, y in zip(hit_a, hit_b)) / 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@lru_cache(maxsize=500_000)
def edits(a: str, b: str, most: int = 3) -> int:
    """Edit distance with swaps of neighbours, or `most` if it is that or more."""
    if abs(len(a) - len(b)) >= most:
        return most
    older, prev = None, list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        cur = [i]
        for j, d in enumerate(b, 1):
            x = min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != d))
            if older and j > 1 and c == b[j - 2] and a[i - 2] == d:
                x = min(x, older[j - 2] + 1)
            cur.append(x)
        if min(cur) >= most:
            return most
        older, prev = prev, cur
    return min(most, prev[-1])


@lru_cache(maxsize=200_000)
def sounded(token: str) -> str:
    """Foreign letters as their usual ones, doubles once."""
    t = token.replace("w", "v").replace("ck", "k").replace("c", "k").replace("q", "k").replace("z", "s").replace("x", "ks")
    return re.sub(r"(.)\1+", r"\1", t)


def misspelt(a: str, b: str, known: frozenset[str] = frozenset()) -> bool:
    """Whether two tokens may be one with slips: Jaro-Winkler 0.84 at least, and one edit, or two in six letters.

    Two tokens that are both `known`, established as names of their own, are no slips of each other unless they sound alike.
    """
    settled = a in known and b in known
    a, b = sounded(a), sounded(b)
    if a == b:
        return True
    if settled:
        return False
    n = max(len(a), len(b))
    if n < 4 or abs(len(a) - len(b)) > 2 or len(set(a) ^ set(b)) > 4:  # an edit changes two letters of the set at most
        return False
    return edits(a, b) <= (2 if n >= 6 else 1) and jaro_winkler(a, b) >= 0.84


class CallNames:
    """The call names of first names, both ways, the diminutives in -si and -sa, and the tokens established as names.

    shares: of established tokens, the share of the names that they stand in."""

    def __init__(self, pairs: list[tuple[str, str]], known: frozenset[str] = frozenset(), shares: dict[str, float] | None = None):
        self.of: dict[str, set[str]] = {}
        self.known = known
        self.shares = shares or {}
        self.sorted: list[str] | None = None
        self.seen: dict[str, tuple[tuple[str, ...], bool]] = {}
        for call, full in pairs:
            self.of.setdefault(folded(call), set()).add(folded(full))

    def read(self, words: str) -> tuple[tuple[str, ...], bool]:
        """Tokens of a name given as words(), and whether it is settled: every token an established name, the first of five letters at least, the last a
        patronymic."""
        got = self.seen.get(words)
        if got is None:
            t = tuple(words.split(" ")) if words else ()
            got = (t, len(t) > 1 and len(t[0]) > 4 and all(x in self.known for x in t) and bool(stem_of_patronymic(t[-1])[1]) and not stem_of_patronymic(t[0])[1])
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[words] = got
        return got

    def mark(self, words: str) -> str:
        """How a name sounds in its first token and in the last one's stem, with the sex of the last, if the name is settled, of two tokens and
        no call name; else empty. Two names of different marks are two names."""
        t, settled = self.read(words)
        if not settled or len(t) > 2 or t[0] in self.of or t[0][-2:] in ("si", "sa") or t[-1].endswith("sen"):
            return ""
        stem, of = stem_of_patronymic(t[-1])
        return f"{sounded(t[0])} {sounded(stem)} {of}"

    def roots(self, token: str) -> set[str]:
        """The names that a token may be a call name of: those listed, and for one in -si or -sa the established ones of its stem."""
        t = token.rstrip(".:")
        found = self.of.get(t, set())
        return found | self._stemmed(t) if len(t) > 4 and t[-2:] in ("si", "sa") else found

    def _stemmed(self, token: str) -> set[str]:
        if self.sorted is None:
            self.sorted = sorted(self.known)
        stem, out = token[:-2], set()
        for x in self.sorted[bisect_left(self.sorted, stem) :]:
            if not x.startswith(stem):
                break
            if len(x) > len(token) and not stem_of_patronymic(x)[1]:
                out.add(x)
        return out

    def rate(self, a: str, b: str, mixed: bool) -> float:
        """What share of all names is as these two alike ones (given as words()) are: by their first, second of three and last tokens, the commoner of either."""
        s, t = self.read(a)[0], self.read(b)[0]
        first = max(self._share(s[0]), self._share(t[0]))
        if mixed:
            return first * MIXED
        if len(s) > 2 and len(t) > 2:
            first *= max(self._share(s[1]), self._share(t[1]))
        last = [self._share(x[-1]) for x in (s, t) if len(x) > 1]
        return first * max(last) if len(last) == 2 else first

    def _share(self, token: str) -> float:
        t = token.rstrip(".:")
        return max(self.shares.get(t, RARE), INITIAL if len(t) < 3 else 0.0)

    def alike(self, a: str, b: str) -> bool:
        if b in self.of.get(a, ()) or a in self.of.get(b, ()):
            return True
        return any(x[-2:] in ("si", "sa") and len(x) > 3 and y.startswith(x[:-2]) and len(y) > len(x) - 1 for x, y in ((a, b), (b, a)))


def given_alike(a: str, b: str, calls: CallNames) -> float:
    """How alike two given names are: 1 equal, 0.95 call names, 0.93 slips, 0.92 cut-off forms, else 0."""
    x, y = a.rstrip(".:"), b.rstrip(".:")
    if x == y:
        return 1.0
    if calls.alike(x, y):
        return 0.95
    short, long = (x, y) if len(x) < len(y) else (y, x)
    marked = a if short == x else b
    if long.startswith(short) and (marked != short or len(short) <= 4 or short not in calls.known):
        return 0.92
    return 0.93 if misspelt(x, y, calls.known) else 0.0


def last_alike(a: str, b: str, calls: CallNames) -> tuple[float, bool]:
    """How alike two last names are, and whether one of them is no patronymic, which a person may have beside one or change."""
    x, y = a.rstrip(".:"), b.rstrip(".:")
    if x == y:
        return 1.0, False
    (sa, ka), (sb, kb) = stem_of_patronymic(a), stem_of_patronymic(b)
    if ka and kb:
        if ka != kb:  # a family name in -sen beside a patronymic
            return 0.0, (ka == "Karl" and x.endswith("sen")) or (kb == "Karl" and y.endswith("sen"))
        settled = x in calls.known and y in calls.known and sounded(sa) != sounded(sb)
        return (1.0 if sa == sb else 0.0 if settled else 0.93 if misspelt(sa, sb) else 0.0), False
    short, long, marked = (x, y, a) if len(x) < len(y) else (y, x, b)
    if long.startswith(short) and marked != short:
        return 0.92, False
    return (0.93 if misspelt(x, y, calls.known) else 0.0), not (ka and kb)


def words(name: str) -> str:
    """The tokens of a name in one text."""
    return " ".join(tokens(name))


def name_alike(a: str, b: str, calls: CallNames) -> tuple[float, bool]:
    """words_alike() of two names as typed."""
    return words_alike(words(a), words(b), calls)


def words_alike(a: str, b: str, calls: CallNames) -> tuple[float, bool]:
    """How alike two whole names are, 0 to 1, and whether only a patronymic and another last name stand against it.

    Tokens are compared in order of given names and last name, and, where no order shows, the other way round too. One
    token split in two is joined again. A name of given names only is compared by the first of them.
    """
    (s, settled_a), (t, settled_b) = calls.read(a), calls.read(b)
    if not s or not t:
        return 0.0, False
    if s == t:
        return 1.0, False
    if "".join(s) == "".join(t) or sorted(s) == sorted(t):
        return 1.0, False
    if settled_a and settled_b and sounded(s[0]) != sounded(t[0]) and not calls.alike(s[0], t[0]):
        return 0.0, False  # two established given names in their place
    best, swapped = _in_order(s, t, calls)
    if best == 0.0 and not (settled_a and settled_b) and len(s) > 1 and len(t) > 1:
        for u, v in ((s[1:] + s[:1], t), (s, t[1:] + t[:1])):
            got, _ = _in_order(u, v, calls)
            best = max(best, got)
        for u, v in ((s, t), (t, s)):
            for k in range(len(u) - 1) if len(u) > 2 else range(1 if len(u) == 2 and len(v) == 1 else 0):
                one = u[k] + u[k + 1]
                if any(abs(len(one) - len(x)) <= 1 for x in v):
                    got, _ = _in_order(u[:k] + (one,) + u[k + 2 :], v, calls)
                    best = max(best, got)
    return best, swapped and best == 0.0


def _in_order(s: tuple[str, ...], t: tuple[str, ...], calls: CallNames) -> tuple[float, bool]:
    first = given_alike(s[0], t[0], calls)
    if len(s) == 1 or len(t) == 1:
        return (0.9 * first if len(s) == len(t) or first else 0.0), False
    last, mixed = last_alike(s[-1], t[-1], calls)
    if len(s) > 2 and len(t) > 2 and not any(given_alike(x, y, calls) for x in s[1:-1] for y in t[1:-1]):
        return 0.0, False
    if first and last:
        return first * last * (1.0 if (len(s) > 2) == (len(t) > 2) else NO_MIDDLE), False
    return 0.0, bool(first == 1.0 and mixed)

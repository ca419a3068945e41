"""Problem 3: records of one person in two tables without a common key, each pair with a confidence."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinweave.llm.blocks import ROWS, Met, compared, key_rows
from kinweave.llm.cells import CELL, NEAR, cells, censuses_of, changes, full_names, mixed, parishes
from kinweave.llm.names import CallNames, phonetic, stem_of_patronymic
from kinweave.llm.variants import call_names, token_shares
from kinweave.runtime import Scratch, small_side

#: How often the years of birth of one person's records differ by 0, 1, 2, more as one is rounded, and how often one is gone.
GAPS = (0.6, 0.16, 0.04, 0.03, 0.04)
#: What a likeness of names below equality costs (natural logarithm), from the least likeness on; one without the middle name,
#: one short or slipped twice, one slipped, equal; and a last name of another kind.
LEVELS, COST, MIXED_COST = (0.0, 0.8, 0.9, 0.99), (4.0, 2.5, 1.2, 0.0), 3.0
#: How often a person is found at the place of before, elsewhere in its parish, and elsewhere.
STAYED, BESIDE, MOVED = 0.5, 0.25, 0.25
#: Records of chance: how many for each other person as alike and near in years, at one place or in one parish, and what stands
#: for persons unseen.
CHANCE, UNSEEN = 0.02, (0.0005, 0.006, 0.3)
#: Beyond the parish: how dear a name is, between two small places, where one is large, and where a place is unknown, in the
#: middle of what a table's _Beyond may say. What stands for persons of a name that the shares of its tokens leave out, and how much
#: likelier or less a chance record is to be 0, 1, 2, more (as one is rounded) or unknown years away.
FAR, EMPTY, FAR_GAPS = (4.0, 6.0, 4.0), 0.02, (1.0, 0.2, 0.05, 0.05, 0.07)
#: The share of records from which a place is large, if it has three times those of the mean place too.
LARGE = 0.01
#: What a likeness of names costs more in one parish than at one place: from the least likeness on, and a last name of another kind.
IN_PARISH, MIXED_IN_PARISH = (0.0, 2.0, 0.0, 0.0), 2.0
#: Years of birth that are judged together, log-odds from which a partner near by is taken to be found, and by how many persons
#: of the mean share the share of such a range is steadied.
RANGE, FOUND, STEADY = 5, 2.0, 20
#: The share of persons who are found beyond the parish, and how much of what the shares of a range say is taken: between years
#: before and from 1830 of check_l, pairs of chance (years moved by 7) show odds of 2.4 where the shares say 4.
MOVED_FAR, TAKEN = 0.2, 0.65
#: Names of fewer records in a census than this tell who is found beyond the parish. Chance records of a name, for each that the
#: shares of its tokens let expect. Of the persons of rare names found near by, the share of those found beyond too that are so by chance, and for
#: each of these the odds that a record of the censuses before is the person's. Where a place is unknown: the odds of a person found near by, and what is taken of the odds of being
#: in the first table at all. Measured between censuses of the first table by curated persons. And the share of the open who have
#: moved, where a table is too small to say.
RARE_NAME, NAMESAKES, BY_CHANCE, AGAIN, UNPLACED, ANYWHERE, USUAL = 0.25, 1.5, 0.65, 2.0, 0.5, 0.3, 0.15
#: What a pair beyond the parish costs that would have a person in two places in turn.
IN_TURN = 5.0
EDGE = ["a", "b", "near", "placed", "hit", "odds"]


def prior(x: Met, people: float) -> np.ndarray:
    """Prior log-odds of each candidate pair: how likely a true record looks like this against how many chance ones do.

    people: records of the first table in a census. Those of a name are counted near a place, but expected by the shares of
    its tokens beyond: how many chance records there are far away grows with all persons, not with the others seen.
    """
    g = np.where(x.gap < 0, 4, np.where(x.gap > 2, 3, x.gap))
    level = np.searchsorted(np.array(LEVELS), x.alike, "right") - 1
    bare = x.alike == 0
    cost = np.where(bare, MIXED_COST, np.array(COST)[level]) + np.where((g > 2) & (bare | (level == 0)), 3.0, 0.0)
    cost = cost + np.where(x.parish & ~x.here, np.where(bare, MIXED_IN_PARISH, np.array(IN_PARISH)[level]), 0.0)
    # A record without a year or with a rounded one stands beside the person's dated one.
    others = np.where(g > 2, np.maximum(0, x.others - 1), x.others)
    near = np.where(x.here, 0, np.where(x.parish, 1, 2))
    before = np.where((near > 1) & (bare | (level < 1)), 0.0, np.array([STAYED, BESIDE, MOVED])[near])
    named = people * x.rate
    chance = CHANCE * (others + np.array(UNSEEN)[near] + np.where(near == 0, named * x.large, 0.0))
    far = np.array(FAR)[np.where(x.placed, x.large > 0, 2)] * np.array(FAR_GAPS)[g] / ((named + EMPTY) * (1 + np.maximum(0, x.wide - 1) / 2))
    with np.errstate(divide="ignore"):
        odds = np.where(near < 2, before * np.array(GAPS)[g] / chance, np.where(before > 0, far, 0.0))
        return np.clip(np.log(odds) - np.where((near == 2) & (level == 2), 0.0, cost), -12.0, 12.0)


def _judged(least: float, people: float):
    def judge(x: Met) -> Iterator[pa.RecordBatch]:
        value = prior(x, people)
        keep = value >= least
        if keep.any():
            near = x.here | x.parish
            hit = ~near & x.placed & (x.gap == 0) & (x.alike == 1)
            yield pa.RecordBatch.from_arrays([pa.array(y[keep]) for y in (x.one, x.two, near, x.placed, hit, value)], names=EDGE)

    return judge


def _excluded(x: str, met: str, r: Column, bits: Sequence[int]) -> list[Column]:
    """The sums of r over the rows of one x by the censuses of `met`; see _rivals."""
    return [F.sum(F.when(F.col(met).bitwiseAND(1 << c) != 0, r).otherwise(0.0)).over(Window.partitionBy(x)).alias(f"s{c}") for c in bits]


def _rivals(met: str, r: Column, bits: Sequence[int]) -> Column:
    """Of the sums by census, the largest among the row's own censuses, less its own part."""
    most = F.greatest(F.lit(0.0), F.lit(0.0), *[F.when(F.col(met).bitwiseAND(1 << c) != 0, F.col(f"s{c}")).otherwise(0.0) for c in bits])
    return F.greatest(F.lit(0.0), most - r)


def believe(pairs: DataFrame, scratch: Scratch, bits_a: Sequence[int], bits_b: Sequence[int], rounds: int = 90, settled: float = 0.01, damping: float = 0.25, at_once: int = 3) -> DataFrame:
    """(a, b, p): marginal probabilities by loopy belief propagation.

    pairs: a, b, met_a, met_b (sets of the censuses that either end has records in, of the bits `bits_a` and `bits_b`), odds
    (prior log-odds of the pair). One-to-one factors: partners of a that have a census in common exclude each other, and so do those of b. A
    factor tells a pair -log(1 + sum of the exponentials of what its rivals tell it), over the census in which they are most; both
    kinds of factors send in turn, `at_once` rounds between two looks, until a round moves no marginal by more than `settled`.
    After the first look messages are damped, and only ends that have a pair that moved send again. A pair without rivals has its
    prior for marginal and takes no part. Beyond `rounds` rounds the messages are taken as they are, with a warning.
    """
    w = F.lit(1.0)
    sums = [f"s{c}" for c in {*bits_a, *bits_b}]
    e = pairs.select("*", *_excluded("a", "met_b", w, bits_b)).withColumn("ra", _rivals("met_b", w, bits_b)).drop(*sums)
    e = e.select("*", *_excluded("b", "met_a", w, bits_a)).withColumn("rb", _rivals("met_a", w, bits_a)).drop(*sums)
    e = scratch.keep(e)
    alone = e.where("ra = 0 and rb = 0").select("a", "b", (1 / (1 + F.exp(-F.col("odds")))).alias("p"))
    state = e.where("ra > 0 or rb > 0").select(*pairs.columns).withColumns({"to_a": F.lit(0.0), "to_b": F.lit(0.0), "p": F.lit(0.0), "moved": F.lit(1.0)})
    rest, live, old, done = None, state.withColumns({"on_a": F.lit(True), "on_b": F.lit(True)}), None, 0
    while True:
        keep = F.lit(damping if done else 0.0)
        for k in range(at_once):
            r = F.exp(F.col("odds") + F.col("to_b"))
            s = live.select("*", *_excluded("a", "met_b", r, bits_b))
            new = F.col("to_a") * keep - F.log1p(_rivals("met_b", r, bits_b)) * (1 - keep)
            s = s.withColumn("to_a", F.when(F.col("on_a"), new).otherwise(F.col("to_a"))).drop(*sums)
            q = F.exp(F.col("odds") + F.col("to_a"))
            s = s.select("*", *_excluded("b", "met_a", q, bits_a))
            new = F.col("to_b") * keep - F.log1p(_rivals("met_a", q, bits_a)) * (1 - keep)
            s = s.withColumn("new", F.when(F.col("on_b"), new).otherwise(F.col("to_b"))).drop(*sums)
            p = 1 / (1 + F.exp(-F.col("odds") - F.col("to_a") - F.col("new")))
            live = s.withColumns({"p": p, "moved": F.abs(p - F.col("p")), "to_b": F.col("new")}).drop("new")
        state = live.drop("on_a", "on_b")
        state = scratch.keep(state if rest is None else state.unionByName(rest))
        scratch.drop(old)
        old, done = state, done + at_once
        moving = scratch.keep(state.where(F.col("moved") > settled).select("a", "b"))
        if moving.isEmpty():
            break
        if done >= rounds:
            warnings.warn(f"beliefs did not settle in {done} rounds", stacklevel=2)
            break
        ends = [small_side(moving.select(x).distinct().withColumn(f"on_{x}", F.lit(True))) for x in "ab"]
        both = state.join(ends[0], "a", "left").join(ends[1], "b", "left").select(*state.columns, *[F.coalesce(f"on_{x}", F.lit(False)).alias(f"on_{x}") for x in "ab"])
        live, rest = both.where("on_a or on_b"), both.where("not on_a and not on_b").select(*state.columns)
    return alone.unionByName(state.select("a", "b", "p"))


def _places(one: DataFrame, two: DataFrame, censuses: int) -> tuple[dict[int, float], float]:
    """The large places of two tables of cells with the share of records that each holds, and the records of `one` in a census."""
    n = F.size("ids").alias("n")
    each = one.select("place", n, F.lit(1).alias("first")).unionByName(two.select("place", n, F.lit(0).alias("first")))
    each = each.groupBy("place").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("first")).alias("first"))
    total = each.agg(F.sum("n"), F.sum("first"), F.count("*")).first()
    found = each.where((F.col("n") >= max(LARGE, 3 / max(1, total[2])) * (total[0] or 0)) & F.col("place").isNotNull()).collect()
    return {r["place"]: r["n"] / total[0] for r in found}, (total[1] or 0) / max(1, censuses)


def _rare(text: list[str], calls: CallNames, people: float) -> bool:
    """Whether a name of two established tokens is one of few records in a census."""
    return len(text) == 2 and all(x in calls.known for x in text) and people * calls.rate(" ".join(text), " ".join(text), False) < RARE_NAME


def _sounding(calls: CallNames, people: float):
    """Rows of _TOLD with a hash of the place, the table and the codes of the first and last token in either order for the name, and whether that is rare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _sounded(b, calls, people)

    return run


def _sounded(b: pa.RecordBatch, calls: CallNames, people: float) -> pa.RecordBatch:
    from xxhash import xxh64_intdigest

    names = b.column(0).dictionary_encode()
    text = [x.split(" ") for x in names.dictionary.to_pylist()]
    codes = [" ".join(sorted((phonetic(t[0]), phonetic(stem_of_patronymic(t[-1])[0])))) if len(t) > 1 else "" for t in text]
    code = names.indices.to_numpy(zero_copy_only=False)
    sound, whole = np.array([xxh64_intdigest(x) for x in codes], dtype=np.uint64).view(np.int64), np.array([x != "" for x in codes], dtype=bool)
    side, cell, lo, hi = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (1, 2, 5, 6))
    placed = ~b.column(3).is_null().to_numpy(zero_copy_only=False)
    place = b.column(3).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    with_others = placed & whole[code] if len(code) else placed
    at = np.where(with_others, (sound[code] if len(code) else cell) ^ mixed(2 * place + side), mixed(~(2 * cell + side)))
    sure = (lo > 0) & ~((lo == hi) & (lo % 10 == 0))
    rare = np.array([_rare(x, calls, people) for x in text], dtype=bool)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(sure), b.column(1), b.column(2), pa.array(np.where(with_others, place, -1)), *b.columns[4:], pa.array(rare[code] if len(code) else np.zeros(0, dtype=bool))], names=[x.split()[0] for x in _TOLD.split(", ")])


_TOLD = "at bigint, sure boolean, side int, cell bigint, place bigint, sex int, lo int, hi int, met int, person_lo bigint, person_hi bigint, rare boolean"
_PARTS = "side int, cell bigint, part bigint, met int, person bigint, born int, head boolean, rare boolean"


def _parted(t: pa.Table, large: Sequence[int]) -> pa.RecordBatch:
    """_PARTS of whole groups, sorted by (at, sure, lo, cell)."""
    at, sure, cell, place, sex, lo, hi, met, person_lo, person_hi = (t.column(c).to_numpy() for c in ("at", "sure", "cell", "place", "sex", "lo", "hi", "met", "person_lo", "person_hi"))
    most, least = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    low, high = np.where(person_lo != 0, person_lo, most), np.where(person_hi != 0, person_hi, least)

    def one_person(start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each range from a start on, whether it is one person, and the first and last year of its dated cells."""
        sexes = np.minimum.reduceat(np.where(sex > 0, sex, 9), start), np.maximum.reduceat(sex, start)
        persons = np.minimum.reduceat(low, start), np.maximum.reduceat(high, start)
        years = np.minimum.reduceat(np.where(sure, lo, 9999), start), np.maximum.reduceat(np.where(sure, hi, -1), start)
        once = np.add.reduceat(np.bitwise_count(met).astype(np.int64), start) == np.bitwise_count(np.bitwise_or.reduceat(met, start))
        one = once & ((sexes[1] == 0) | (sexes[0] == sexes[1])) & ((persons[0] == most) | (persons[1] == least) | (persons[0] == persons[1]))
        return one & (years[1] > 0) & (years[1] - years[0] <= 2 * NEAR), *years

    begins = changes(at, place)
    half = changes(at, place, sure)
    # The last year of the cells before, within each half of a group.
    up_to = np.maximum.accumulate(hi + np.cumsum(half) * 10_000) - np.cumsum(half) * 10_000
    cut = half.copy()
    cut[1:] |= lo[1:] - up_to[:-1] > NEAR
    start, group = np.flatnonzero(begins), np.cumsum(begins) - 1
    whole, first, last = one_person(start)
    # Years rounded down come before those of the dated cells, by nine at most.
    fits = sure | (lo == 0) | ((lo <= last[group] + NEAR) & (lo >= first[group] - 10 - NEAR))
    whole &= np.logical_and.reduceat(fits, start) & ~np.isin(place[start], np.array([*large, -1]))
    run, of_run = np.flatnonzero(cut), np.cumsum(cut) - 1
    some, _, _ = one_person(run)
    part = np.where(whole[group], np.minimum.reduceat(cell, start)[group], np.where(some[of_run], np.minimum.reduceat(cell, run)[of_run], cell))
    head = begins | changes(part)
    own, of_own = np.flatnonzero(head), np.cumsum(head) - 1
    person = np.minimum.reduceat(low, own)
    known = (person == np.maximum.reduceat(high, own))[of_own]
    together = np.bitwise_or.reduceat(met, own)[of_own]
    born = np.minimum.reduceat(np.where(sure, lo, 9999), own)
    born = np.where(born < 9999, born, np.maximum.reduceat(lo, own))[of_own].astype(np.int32)
    return pa.RecordBatch.from_arrays([t.column("side").combine_chunks(), pa.array(cell), pa.array(part), pa.array(together), pa.array(person[of_own], mask=~known), pa.array(born), pa.array(head), t.column("rare").combine_chunks()], names=[x.split()[0] for x in _PARTS.split(", ")])


def _by_group(large: Sequence[int], rows: int = 100_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < rows:
                continue
            at = held.column("at").to_numpy()
            whole = int(np.searchsorted(at, at[-1], "left"))
            if whole:
                yield _parted(held.slice(0, whole).combine_chunks(), large)
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield _parted(held.combine_chunks(), large)

    return run


def _told_apart(one: DataFrame, two: DataFrame, large: Sequence[int], calls: CallNames, people: float) -> DataFrame:
    """(side, cell, part, met, person, born, head, rare): parts of the cells (cells.py) of two tables that are one person in all likelihood.

    Cells at one place whose names sound alike are one part if they have no two records of a census, one sex and one curated
    person at most, and years of birth within NEAR of each other; those rounded or without year go with the dated ones, but not
    at a large place. side: 0 or 1 for the table; met: the censuses of the part; person: the curated person of a part or NULL; born: its first
    year of birth that is not rounded, else any, 0 if unknown; head: on one cell of each part; rare: whether the cell's name is.
    """
    columns = ["words", "side", "cell", "place", "sex", "lo", "hi", "met", "person_lo", "person_hi"]
    rows = one.withColumn("side", F.lit(0)).select(*columns).unionByName(two.withColumn("side", F.lit(1)).select(*columns))
    return rows.mapInArrow(_sounding(calls, people), _TOLD).repartition("at").sortWithinPartitions("at", "sure", "lo", "cell").mapInArrow(_by_group(large), _PARTS)


def _elsewhere(found: dict[int, int], open_: dict[int, int], all_: dict[int, int]) -> dict[int, float]:
    """What a range of years of birth adds to the log-odds of pairs beyond the parish.

    found, open_, all_: persons of the second table by range, with a partner near by, with candidates but none near by, and all.
    Where most persons are found near by, nearly all are in the first table, so that many of the others have moved; where few
    are, most of the others are strangers, who meet as many records of chance. The mean of the open ones is 0.
    """
    ranges = [k for k in all_ if found.get(k, 0) + open_.get(k, 0)]
    mean = sum(found.values()) / max(1, sum(all_[k] for k in ranges))
    ratio = {}
    for k in ranges:
        share = (found.get(k, 0) + STEADY * mean) / (all_[k] + STEADY)
        ratio[k] = max(1e-3, min(1.0, share / (1 - MOVED_FAR)) * MOVED_FAR) / max(0.1, 1 - share)
    middle = sum(open_.get(k, 0) * np.log(x) for k, x in ratio.items()) / max(1, sum(open_.get(k, 0) for k in ratio))
    return {k: float(np.clip(TAKEN * (np.log(x) - middle), -2.5, 2.5)) for k, x in ratio.items()}


class _Beyond(NamedTuple):
    """Log-odds that a person of the second table has a given record of the first beyond the parish, by range of years of birth,
    beside what its name says: of those open (not found near by), of open ones where a place is unknown, and, for a person found near
    by, the same two."""

    open: dict[int, float]
    unplaced: dict[int, float]
    again: dict[int, float]
    again_unplaced: dict[int, float]


def _beyond(tally: dict[int, dict[str, int]], first: dict[int, int], people: float) -> _Beyond:
    """tally: of the persons of the second table by range: all, found (near by), open (with candidates, none near by), rare and
    open_rare (those of a rare name, and of them the ones not found near by), hit and open_hit (of those, the ones that have a record
    beyond the parish of equal name and year). first: persons of the first table by range.

    Of rare names hardly any are met by chance, so that they show how many of the open have moved; the others are strangers.
    A range with few of them is steadied by the mean, weighed by the shares found near by.
    """
    total = {k: sum(x[k] for x in tally.values()) for k in ("rare", "open_rare", "hit", "open_hit")}
    found_hit = (total["hit"] - total["open_hit"] + 1) / (total["rare"] - total["open_rare"] + 50)
    chance = BY_CHANCE * found_hit
    weight = _elsewhere(*[{k: x[c] for k, x in tally.items()} for c in ("found", "open", "all")])
    some = [x for k, x in tally.items() if k in weight]
    moved = (sum(max(0.0, x["open_hit"] - chance * x["open_rare"]) for x in some) + STEADY * USUAL) / (sum(x["open_rare"] for x in some) + STEADY)
    out = _Beyond({}, {}, {}, {})
    for k, x in tally.items():
        share = (x["found"] + STEADY / 2) / (x["all"] + STEADY)
        usual = moved * np.exp(weight.get(k, 0.0))
        hits = max(0.0, x["open_hit"] - chance * x["open_rare"])
        here = min(0.95, max(1e-4, (hits + STEADY * usual / (1 + usual)) / (x["open_rare"] + STEADY)))
        # Chance records are those of the years of birth, or of all years where none is known.
        met = NAMESAKES * max(first.get(k, 0), 1e-3 * sum(first.values())) / (RANGE if k else 1) / max(1.0, people)
        for of, odds in ((out.open, here / (1 - here)), (out.unplaced, max(here / (1 - here), ANYWHERE * share / (1.1 - share))), (out.again, AGAIN * found_hit), (out.again_unplaced, UNPLACED)):
            of[k] = float(np.clip(np.log(odds / max(met, 1e-6) / FAR[0]), -12.0, 12.0))
    return out


def link_tables(first: DataFrame, second: DataFrame, called: DataFrame, places: DataFrame | None = None, least: float = -2.0, report: float = 0.0) -> DataFrame:
    """(id_census, id_second, p): candidate pairs of records of the two tables with the probability that they are one person.

    Both tables: id, manntal, nafn, faedingarar, kyn, bi_baer; first also bi_einstaklingur; called: gaelunafn, fornafn;
    places: bi_baer, bi_sokn (where given, movers within a parish count for more).
    Where `nafn` is missing, the name is that of fornafn, millinafn, eftirnafn and aettarnafn, of those that the table has.
    Records without id, census or any name are in no pair; repeated rows count once; other columns are ignored.

    Records become cells (cells.py); candidates share a block of phonetic name codes with the place, or with the years of
    birth and the sex (blocks.py). Prior log-odds weigh likeness of names, years of birth and place against the number of
    other persons whose names are alike as much; pairs below `least` are dropped, since a marginal is never above the prior.
    Cells of the first table of one curated person (not NULL, not 0, one record a census) are one node of the graph, with the best prior of its
    cells and the censuses of all. Marginals: believe(). A pair of nodes is the pairs of all their records. Pairs of a
    marginal below `report` are left out of the result.
    """
    spark = first.sparkSession
    scratch = Scratch(spark, "crosslink")
    of_first, of_second = censuses_of(first), censuses_of(second)
    censuses = sorted({*of_first, *of_second})
    bits = [[k for k, c in enumerate(censuses) if c in own] for own in (of_first, of_second)]
    at = None if places is None else scratch.keep(parishes(places))
    one = cells(full_names(first), censuses, F.nullif(F.col("bi_einstaklingur").cast("long"), F.lit(0)), scratch, at)
    two = cells(full_names(second), censuses, F.lit(0), scratch, at)
    shares = token_shares(one.select("words").unionByName(two.select("words")))
    calls = call_names(called, frozenset(shares), shares=shares)
    large, people = _places(one, two, len(of_first))
    rows = one.select(*CELL).mapInArrow(key_rows(calls, 0, "own"), ROWS).unionByName(two.select(*CELL).mapInArrow(key_rows(calls, 1, "both"), ROWS))
    rows = rows.repartition(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", "fit")
    scored = rows.mapInArrow(compared(calls, _judged(least, people), True, large=large), "a bigint, b bigint, near boolean, placed boolean, hit boolean, odds double")
    # Nodes of the first table: the parts of a person with one record a census at most, else a part; of the second: parts.
    told = scratch.keep(_told_apart(one, two, list(large), calls, people))
    mine = told.where("side = 0")
    people_of = mine.where("head and person is not null").groupBy("person").agg(F.min("part").alias("node"), F.sum(F.bit_count("met")).alias("n"), F.expr("bit_or(met)").alias("all"))
    people_of = people_of.where(F.col("n") == F.bit_count("all")).drop("n")
    nodes = scratch.keep(mine.join(people_of, "person", "left").select("cell", F.coalesce("node", "part").alias("node"), F.coalesce("all", "met").alias("met_a")))
    others = told.where("side = 1").select(F.col("cell").alias("b"), F.col("part").alias("node_b"), F.col("met").alias("met_b"), (F.col("born") / RANGE).cast("int").alias("range"))
    scored = scored.join(nodes.withColumnRenamed("cell", "a"), "a").join(others, "b")
    best = [F.first("met_a").alias("met_a"), F.first("met_b").alias("met_b"), F.max("odds").alias("odds"), F.max_by("near", "odds").alias("near"), F.max_by("placed", "odds").alias("placed"), F.max("hit").alias("hit"), F.first("range").alias("range")]
    pairs = scratch.keep(scored.groupBy(F.col("node").alias("a"), F.col("node_b").alias("b")).agg(*best))
    # How likely a person is somewhere else shows in those of rare names, by how many born in such years are found near by.
    each = pairs.groupBy("b").agg(F.max((F.col("near") & (F.col("odds") > FOUND)).cast("int")).alias("found"), F.max(F.col("hit").cast("int")).alias("hit"), F.lit(1).alias("met"))
    heads = told.where("side = 1 and head").select(F.col("part").alias("b"), (F.col("born") / RANGE).cast("int").alias("range"), F.col("rare").cast("int").alias("rare"))
    each = heads.join(each, "b", "left").select("range", "rare", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("found", "hit", "met")])
    tally = {"all": F.lit(1), "found": F.col("found"), "open": F.col("met") - F.col("found"), "rare": F.col("rare"), "open_rare": F.col("rare") * (1 - F.col("found")), "hit": F.col("rare") * F.col("hit"), "open_hit": F.col("rare") * F.col("hit") * (1 - F.col("found"))}
    tally = {r["range"]: r.asDict() for r in each.groupBy("range").agg(*[F.sum(v).alias(k) for k, v in tally.items()]).collect()}
    firsts = told.where("side = 0 and head").groupBy((F.col("born") / RANGE).cast("int").alias("range")).count().collect()
    beyond = _beyond(tally, {r["range"]: r["count"] for r in firsts}, people)
    by_range = lambda of: F.element_at(F.array(*[F.lit(of.get(k, 0.0)) for k in range(2200 // RANGE + 1)]), F.col("range") + 1)
    # Who is found near by may have lived beyond before, and whose record is found near by may have moved on after, but nobody
    # is in two places in turn.
    sure = F.col("near") & (F.col("odds") > FOUND)
    first_of = lambda c: F.col(c).bitwiseAND(-F.col(c))
    early, late = F.min(F.when(sure, first_of("met_a"))).over(Window.partitionBy("b")), F.max(F.when(sure, F.col("met_b"))).over(Window.partitionBy("a"))
    best = F.max(F.when(F.col("near"), F.col("odds"))).over(Window.partitionBy("b"))
    found = F.coalesce(1 / (1 + F.exp(1 - best)), F.lit(0.0))
    open_, again = [F.when(F.col("placed"), by_range(x)).otherwise(by_range(y)) for x, y in ((beyond.open, beyond.unplaced), (beyond.again, beyond.again_unplaced))]
    again = again - F.when(F.col("placed") & (F.col("met_a") >= F.col("early")), IN_TURN).otherwise(0.0)
    pairs = pairs.withColumns({"early": early, "late": late, "found": found})
    more = F.log(F.col("found") * F.exp(again) + (1 - F.col("found")) * F.exp(open_)) - F.when(F.col("placed") & (F.col("late") >= first_of("met_b")), IN_TURN).otherwise(0.0)
    pairs = pairs.withColumn("odds", F.col("odds") + F.when(F.col("near"), 0.0).otherwise(more)).where(F.col("odds") >= least).drop("near", "placed", "hit", "range", "early", "late", "found")
    p = scratch.keep(believe(pairs, scratch, *bits).where(F.col("p") >= report))
    left = nodes.select("cell", F.col("node").alias("a")).join(one.select("cell", F.col("ids").alias("left")), "cell").drop("cell")
    right = two.select(F.col("cell").alias("b"), F.col("ids").alias("right")).join(others.drop("met_b"), "b").drop("b").withColumnRenamed("node_b", "b")
    ends = p.join(left, "a").join(right, "b")
    each = ends.select("p", "right", F.explode("left").alias("id_census")).select("p", "id_census", F.explode("right").alias("id_second"))
    return each.groupBy("id_census", "id_second").agg(F.max("p").alias("p"))

"""The evidence pool: a bounded list of patterns (sets of statements with a truth value), ordered by expectation."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kinweave.functions.evidence import HIGH, LOW, longer_expectation, pattern_likeness

POOL = "rank int, statements array<string>, f double, c double, e double"


def bounded(c: float) -> float:
    return max(min(c, HIGH), LOW)


def expectation(f: float, c: float) -> float:
    return c * (f - 0.5) + 0.5


def revised(f1: float, c1: float, f2: float, c2: float) -> tuple[float, float]:
    w1, w2 = c1 / (1 - c1), c2 / (1 - c2)
    return (f1 * w1 + f2 * w2) / (w1 + w2), bounded((w1 + w2) / (w1 + w2 + 1))


@dataclass
class Pool:
    """Patterns as (statements, f, c), highest expectation first."""

    size: int = 100
    patterns: list[tuple[frozenset[str], float, float]] = field(default_factory=list)

    def add(self, said: frozenset[str], f: float, c: float) -> None:
        """An equal set is replaced, where it stands, by a more confident one; a new one goes behind all that expect as much
        or more; an overfull pool loses its middle."""
        at = next((i for i, p in enumerate(self.patterns) if p[0] == said), None)
        if at is not None:
            if c > self.patterns[at][2]:
                self.patterns[at] = (said, f, c)
            return
        e = expectation(f, c)
        at = next((i for i, p in enumerate(self.patterns) if e > expectation(p[1], p[2])), len(self.patterns))
        self.patterns.insert(at, (said, f, c))
        if len(self.patterns) > self.size:
            del self.patterns[len(self.patterns) // 2]

    def references(self, n: int) -> list[tuple[frozenset[str], float, float]]:
        """n // 2 from the top and the others from the bottom, in the pool's order, none twice."""
        low = len(self.patterns) - (n - n // 2)
        return [p for i, p in enumerate(self.patterns) if i < n // 2 or i >= low]

    def learn(self, said: frozenset[str], same: bool, n: int = 10) -> float:
        """Answers a labelled pair from its references, and takes in what the comparison leaves and shares."""
        f, c = float(same), 0.9
        told = []
        for theirs, tf, tc in self.references(n):
            shared = said & theirs
            mine, other = len(said), len(theirs)
            e, te = expectation(f, c), expectation(tf, tc)
            told.append((e if mine > other else te if mine < other else max(e, te), len(shared) / max(mine, other, 1)))
            rf, rc = revised(f, c, tf, tc)
            for part, pf, pc in ((said - shared, f, c), (shared, rf, rc), (theirs - shared, tf, tc)):
                if part:
                    self.add(part, pf, pc)
        if not told:
            self.add(said, f, c)
            return 0.5
        f, c = told[0][0], bounded(told[0][1])
        for x, y in told[1:]:
            f, c = revised(f, c, x, bounded(y))
        return expectation(f, c)


def trained_pool(pairs: DataFrame, order: list[str], size: int = 100, references: int = 10) -> DataFrame:
    """The pool after learning the pairs (statements, same) in the given order.

    Every answer changes the pool, so that learning is one sequence: the pairs stream, sorted, through one task that holds
    no more than the pool. The number of pairs is the caller's choice; what is learnt is applied in parallel
    (frozen_scores).
    """
    columns = [*order, "statements", "same"]

    def run(batches: Iterable[pd.DataFrame]):
        pool = Pool(size)
        for b in batches:
            for said, same in zip(b["statements"], b["same"]):
                pool.learn(frozenset(said), bool(same), references)
        yield pd.DataFrame({
            "rank": range(len(pool.patterns)), "statements": [sorted(p[0]) for p in pool.patterns], "f": [p[1] for p in pool.patterns],
            "c": [p[2] for p in pool.patterns], "e": [expectation(p[1], p[2]) for p in pool.patterns],
        })

    return pairs.select(*columns).repartition(1).sortWithinPartitions(*order).mapInPandas(run, POOL)


def frozen_scores(pairs: DataFrame, pool: DataFrame, references: int = 10, key: tuple[str, str] = ("id_1", "id_2")) -> DataFrame:
    """pairs with `expectation`, answered from a pool that no longer changes.

    The references (at most `references` rows) go to all tasks as one array; likeness, expectation and their revision in
    the order of the pool are column functions.
    """
    n = pool.agg(F.max("rank")).first()[0]
    if n is None:
        return pairs.withColumn("expectation", F.lit(0.5))
    refs = pool.where((F.col("rank") < references // 2) | (F.col("rank") >= n + 1 - (references - references // 2)))
    refs = F.broadcast(refs.agg(F.array_sort(F.collect_list(F.struct("rank", "statements", "e"))).alias("_refs")))
    mine = F.when(F.col("same"), F.lit(expectation(1.0, 0.9))).otherwise(F.lit(expectation(0.0, 0.9)))

    def told(r):
        likeness = pattern_likeness(F.col("statements"), r["statements"])
        return F.struct(longer_expectation(F.col("statements"), mine, r["statements"], r["e"]).alias("f"), F.least(F.greatest(likeness, F.lit(LOW)), F.lit(HIGH)).alias("c"))

    def weigh(s, x):
        ws, wx = s["c"] / (1 - s["c"]), x["c"] / (1 - x["c"])
        total = ws + wx
        return F.struct(((s["f"] * ws + x["f"] * wx) / total).alias("f"), F.least(F.greatest(total / (total + 1), F.lit(LOW)), F.lit(HIGH)).alias("c"))

    out = pairs.crossJoin(refs).withColumn("_t", F.transform("_refs", told))
    folded = F.aggregate(F.slice("_t", 2, 1000), F.element_at("_t", 1), weigh)
    return out.withColumn("_r", folded).withColumn("expectation", F.col("_r.c") * (F.col("_r.f") - 0.5) + 0.5).drop("_refs", "_t", "_r")


def successes(scored: DataFrame) -> DataFrame:
    """Share of pairs answered rightly: above one half for one person, below for two; one half is wrong."""
    ok = (F.col("same") & (F.col("expectation") > 0.5)) | (~F.col("same") & (F.col("expectation") < 0.5))
    return scored.agg(F.count("*").alias("comparisons"), F.sum(ok.cast("int")).alias("right"), F.avg(ok.cast("double")).alias("success_rate"))


def rule_lines(pool: DataFrame) -> DataFrame:
    """The pool as text: statements, then frequency and confidence with three decimals."""
    return pool.orderBy("rank").select(F.concat(F.concat_ws(",", "statements"), F.lit(" | "), F.format_string("%.3f, %.3f", F.bround("f", 3), F.bround("c", 3))).alias("value"))

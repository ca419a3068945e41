"""Problem 4: records of one person whose name is written in different ways."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinweave.llm.blocks import ROWS, Met, compared, key_rows
from kinweave.llm.cells import CELL, cells, censuses_of, parishes
from kinweave.llm.components import propagate_labels
from kinweave.llm.names import CallNames
from kinweave.runtime import Scratch


def established(words: DataFrame, one_in: int = 20_000, least: int = 5) -> frozenset[str]:
    """Tokens that stand in one of `one_in` names at least: at most `one_in` times the tokens of a name of them."""
    return frozenset(token_shares(words, one_in, least))


def token_shares(words: DataFrame, one_in: int = 20_000, least: int = 5) -> dict[str, float]:
    """The tokens of established() with the share of names that each stands in, a name being of two tokens.

    words: one column of names as words(). Counted over all rows, combined per task before the shuffle.
    """
    each = words.toDF("words").select(F.explode(F.split("words", " ")).alias("t")).select(F.rtrim(F.col("t"), F.lit(".:")).alias("token")).where("token <> ''")
    counted = Scratch(words.sparkSession, "tokens").keep(each.groupBy("token").agg(F.count("*").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    return {r["token"]: 2 * r["n"] / total for r in counted.where(F.col("n") >= max(least, total / (2 * one_in))).collect()}


def call_names(listed: DataFrame, known: frozenset[str] = frozenset(), limit: int = 100_000, shares: dict[str, float] | None = None) -> CallNames:
    got = listed.select("gaelunafn", "fornafn").where("gaelunafn is not null and fornafn is not null").limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"more than {limit} call names")
    return CallNames([(r[0], r[1]) for r in got], known, shares)


#: Log-odds of a pair at one place and away from one, and what the years between the years of birth take from it: 0, 1, 2,
#: rounded, unknown.
HERE, GAPS = 4.0, (0.0, 0.7, 1.5, 2.5, 2.0)
AWAY, AWAY_GAPS = 1.95, (0.0, 0.9, 2.5, np.inf, np.inf)
#: Log-odds of a pair at two places of one parish; the years, likeness and others of the parish take what they do at one place, and
#: a name cut takes this more. A last name of another kind (right in a third of 111 such pairs of curated persons of check_l) is refused.
BESIDE, BESIDE_CUT = 3.5, 1.0
#: By likeness of the names, from the least on (below 0.8 one has no middle name, below 0.84 one is short): what it costs at one place and
#: what another person near in years takes (n others what log2(1 + n) do), and what it costs away from one.
LEVELS = (0.0, 0.8, 0.84, 0.99)
COST, OTHER, AWAY_COST = (2.0, 1.0, 0.5, 0.0), (1.5, 1.0, 0.6, 0.6), (np.inf, np.inf, 0.3, 0.0)
#: The same for a last name of another kind.
MIXED_COST, MIXED_OTHER, AWAY_OTHER = 1.5, 1.8, 1.0
#: What is unlikely on its own, a name cut or of another kind with years rounded or gone.
DOUBTFUL = 3.0
EDGE = ["a", "b", "met_a", "met_b", "equal", "odds"]


def odds(x: Met) -> np.ndarray:
    """Log-odds that two cells are one person if no other cell contests it."""
    g = np.where(x.gap < 0, 4, np.where(x.gap > 2, 3, x.gap))
    level = np.searchsorted(np.array(LEVELS), x.alike, "right") - 1
    bare = x.alike == 0
    cost, each = np.where(bare, MIXED_COST, np.array(COST)[level]), np.where(bare, MIXED_OTHER, np.array(OTHER)[level])
    more = np.where(level < 2, x.others, np.maximum(0, x.others - 1))
    here = HERE - np.array(GAPS)[g] - cost - each * np.log2(1 + more) - DOUBTFUL * ((level == 0) & (g > 2))
    least = np.where(bare, np.inf, np.array(AWAY_COST)[level])
    away = AWAY - np.array(AWAY_GAPS)[g] - least - AWAY_OTHER * np.log2(1 + x.others)
    beside = here + BESIDE - HERE - np.where(bare, np.inf, np.where(level == 0, BESIDE_CUT, 0.0))
    return np.where(x.here, here, np.where(x.parish, beside, away))


def _judged(x: Met) -> Iterator[pa.RecordBatch]:
    value = odds(x)
    keep = value > -1
    if keep.any():
        turn = (x.one > x.two)[keep]
        one, two, met_1, met_2 = (y[keep] for y in (x.one, x.two, x.met_1, x.met_2))
        sides = [np.where(turn, two, one), np.where(turn, one, two), np.where(turn, met_2, met_1), np.where(turn, met_1, met_2)]
        yield pa.RecordBatch.from_arrays([pa.array(y) for y in (*sides, x.equal[keep], value[keep])], names=EDGE)


def contested(edges: DataFrame, censuses: int) -> DataFrame:
    """(a, b, equal, p): the share of a pair's odds among those of its cells with any cells of the same censuses, and with none.

    A cell is one person, who is in a census once: of the partners of a cell that are in one census, one at most is right.
    """
    w = F.exp("odds").alias("w")
    ends = edges.select("a", "b", "equal", F.col("a").alias("x"), F.col("met_b").alias("met"), w).unionByName(edges.select("a", "b", "equal", F.col("b").alias("x"), F.col("met_a").alias("met"), w))
    has = [F.col("met").bitwiseAND(1 << c) != 0 for c in range(censuses)]
    sums = ends.select("*", *[F.sum(F.when(h, F.col("w")).otherwise(0.0)).over(Window.partitionBy("x")).alias(f"s{c}") for c, h in enumerate(has)])
    most = F.greatest(F.lit(0.0), F.lit(0.0), *[F.when(h, F.col(f"s{c}")).otherwise(0.0) for c, h in enumerate(has)])
    return sums.groupBy("a", "b").agg(F.max("equal").alias("equal"), F.min(F.col("w") / (1 + most)).alias("p"))


def name_variants(rows: DataFrame, called: DataFrame, places: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """(id_1, id_2), id_1 < id_2: distinct pairs of records of one person under two spellings of `nafn`.

    rows: id, manntal, nafn, faedingarar, kyn, bi_baer, bi_einstaklingur; called: gaelunafn, fornafn; places: bi_baer, bi_sokn (where given, movers within a parish count for more). A spelling is `nafn` in
    NFC and lower case with single spaces. Records without id, census or `nafn` have no pair; a missing or zero year of
    birth, place or sex only leaves a record out of the blocks that need it. Repeated rows give a pair once; other columns
    are ignored.

    Records become cells (cells.py), which meet in blocks of phonetic codes of their tokens with the place or the years of
    birth (blocks.py): names are compared by Jaro-Winkler and edits, call names, cut-off forms and order
    (names.name_alike). Two tokens that are both established as names are two names. Odds weigh the likeness of
    the names, the place, the years and how many other persons it might be; a pair is accepted if its share among all pairs
    that exclude each other is `least` or more. Accepted pairs make components, and records of a component in
    different censuses and spellings are the result. A component with two records of one census, or with two curated persons,
    holds more than one person: its pairs join it again from the
    likeliest on, but those that would bring two such records together. Curated persons only reject: records of two of them are never one.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "variants")
    censuses = censuses_of(rows)
    made = cells(rows, censuses, F.nullif(F.col("bi_einstaklingur").cast("long"), F.lit(0)), scratch, None if places is None else parishes(places))
    calls = call_names(called, established(made.select("words")))
    blocked = made.select(*CELL).mapInArrow(key_rows(calls, 0, "next"), ROWS).repartition(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", "fit")
    found = blocked.mapInArrow(compared(calls, _judged, False), "a bigint, b bigint, met_a int, met_b int, equal boolean, odds double")
    edges = scratch.keep(found.groupBy(*EDGE[:-1]).agg(F.max("odds").alias("odds")))
    accepted = scratch.keep(contested(edges, len(censuses)).where(F.col("p") >= least))
    labels = propagate_labels(accepted, "a", "b").select(F.col("node").alias("cell"), "component")
    of = Window.partitionBy("component")
    several = F.sum(F.bit_count("met")).over(of) > F.bit_count(F.expr("bit_or(met)").over(of))
    persons = F.coalesce(F.min(F.nullif("person_lo", F.lit(0))).over(of) != F.max(F.nullif("person_hi", F.lit(0))).over(of), F.lit(False))
    whole = made.join(labels, "cell").select("cell", "component", "met", "spelt", "person_lo", "person_hi", "ids", "bits", "persons")
    # Only components of two spellings have records to tell.
    whole = whole.withColumns({"clash": several | persons, "told": F.min("spelt").over(of) != F.max("spelt").over(of)}).where("told").drop("told")
    whole = scratch.keep(whole)
    clash = whole.where("clash").select("cell", "component", "met", F.when(F.col("person_lo") == F.col("person_hi"), F.col("person_lo")).otherwise(0).alias("person"))
    ends = [clash.select(F.col("cell").alias(x), F.col("met").alias(f"met_{x}"), F.col("person").alias(f"person_{x}"), *(["component"] if x == "a" else [])) for x in "ab"]
    cut = accepted.join(ends[0], "a").join(ends[1], "b").select("component", "p", "a", "b", "met_a", "met_b", "person_a", "person_b")
    cut = cut.repartition("component").sortWithinPartitions("component", F.desc("p"), "a", "b").mapInArrow(_joined_again, "cell bigint, part bigint")
    parts = whole.where("not clash").unionByName(whole.where("clash").drop("component").join(cut.withColumnRenamed("part", "component"), "cell"))
    x, y = parts.alias("x"), parts.alias("y")
    return _records(x.join(y, (F.col("x.component") == F.col("y.component")) & (F.col("x.cell") < F.col("y.cell")) & (F.col("x.spelt") != F.col("y.spelt")))).distinct()


def _joined_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, part) of pairs sorted by component and, from the likeliest on, by p: parts hold one record a census and one known person, as far as cells do."""
    component, up, held = None, {}, {}

    def top(c: int) -> int:
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([top(c) for c in up], pa.int64())], names=["cell", "part"])

    for batch in batches:
        for of, _, a, b, met_a, met_b, person_a, person_b in zip(*(c.to_pylist() for c in batch.columns)):
            if of != component:
                if up:
                    yield told()
                component, up, held = of, {}, {}
            for c, met, person in ((a, met_a, person_a), (b, met_b, person_b)):
                if c not in up:
                    up[c], held[c] = c, (met, person)
            a, b = sorted((top(a), top(b)))
            (m, p), (n, q) = held[a], held[b]
            if a != b and not m & n and (p == q or not p or not q):
                up[b], held[a] = a, (m | n, p or q)
    if up:
        yield told()


def _records(pairs: DataFrame) -> DataFrame:
    """(id_1, id_2) of the records of pairs of cells x and y, but those of one census or of two persons."""
    one = pairs.select(F.explode(F.arrays_zip(F.col("x.ids").alias("id"), F.col("x.bits").alias("bit"), F.col("x.persons").alias("person"))).alias("m"), F.arrays_zip(F.col("y.ids").alias("id"), F.col("y.bits").alias("bit"), F.col("y.persons").alias("person")).alias("others"))
    two = one.select("m", F.explode("others").alias("o")).where("m.id <> o.id and m.bit <> o.bit and (m.person = o.person or m.person = 0 or o.person = 0)")
    return two.select(F.least("m.id", "o.id").alias("id_1"), F.greatest("m.id", "o.id").alias("id_2"))

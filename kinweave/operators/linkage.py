"""Rule-based linkage: blocking, edit-distance caps, additive score, accept rule, assignment to individuals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinweave.functions.compare import Marital, age_distance, edits_within, location_distance, marital_distance, name_distance
from kinweave.runtime import Scratch, small_side

#: Largest edit distances of the name columns. Fixed values.
CAPS = {"fornafn": 2, "millinafn": 8, "eftirnafn": 4}
#: Below this score an edge may hold; a seed's uniqueness times it is the bound for its census; the cap beyond. Fixed values.
HOLDS, WIDEST = 10, 20
TERMS = ("name", "age", "location", "marital", "stada")
#: Units from the narrowest on, and what each one more that differs costs.
UNITS, STEP = ("bi_baer", "bi_sokn", "bi_hreppur", "bi_sysla"), 5
#: Years of birth of one block, and records from which a block is divided by names.
BLOCK_YEARS, LARGE = 8, 2_000


def candidates(records: DataFrame, seeds: DataFrame | None = None, years: int = 2, same: str = "kyn") -> DataFrame:
    """Pairs (columns of `seed` and of `match` as structs) of one sex, born within `years` of each other, ordered both ways
    and with each record itself.

    The band becomes an equi-join: a seed enters each of its years. A missing sex meets none.
    """
    seed = (records if seeds is None else seeds).select(F.struct("*").alias("seed"))
    match = records.select(F.struct("*").alias("match"))
    steps = F.explode(F.sequence(F.lit(-years), F.lit(years)))
    left = seed.select("seed", F.col(f"seed.{same}").alias("_s"), steps.alias("_k")).withColumn("_y", F.floor("seed.faedingarar") + F.col("_k"))
    right = match.select("match", F.col(f"match.{same}").alias("_s"), F.floor("match.faedingarar").alias("_y"))
    near = F.abs(F.col("seed.faedingarar") - F.col("match.faedingarar")) <= years
    return left.join(right, ["_s", "_y"]).where(near).select("seed", "match")


def candidate_counts(records: DataFrame, years: int = 2, same: str = "kyn", key: str = "id") -> DataFrame:
    """(key, n_candidates): how many candidates() a record has, by sums over the distinct years of birth and not over pairs."""
    n = records.where(F.col(same).isNotNull() & F.col("faedingarar").isNotNull()).groupBy(same, "faedingarar").agg(F.count("*").alias("n"))
    each = candidates(n, years=years, same=same).groupBy(F.col(f"seed.{same}").alias(same), F.col("seed.faedingarar").alias("faedingarar")).agg(F.sum("match.n").alias("n_candidates"))
    return records.join(small_side(each), [same, "faedingarar"]).select(key, "n_candidates")


def close_values(values: DataFrame, most: int) -> DataFrame:
    """(a, b): ordered pairs of distinct values (one text column, no NULL) within `most` edits of each other, each with itself.

    A text longer than `most` is cut into most + 1 pieces, of which one stands untouched in any text within `most` edits, no
    more than `most` places off; so pairs meet in an equi-join on (length, piece, its text), and only those are compared. Shorter
    texts meet by their length.
    """
    v = values.toDF("v").distinct().withColumn("n", F.length("v"))
    cut = "int(i * {n} / {k})".replace("{k}", str(most + 1))
    begin, end = cut.format(n="n"), cut.replace("i *", "(i + 1) *").format(n="n")
    whole = v.where(F.col("n") > most).select("v", "n", F.explode(F.expr(f"sequence(0, {most})")).alias("i"))
    index = whole.select(F.col("v").alias("a"), "n", "i", F.expr(f"substring(v, {begin} + 1, {end} - {begin})").alias("piece"))
    # The probe of length m meets texts of n letters, m - most to m + most.
    probe = v.select(F.col("v").alias("b"), F.col("n").alias("m"), F.explode(F.expr(f"sequence(greatest({most + 1}, n - {most}), greatest({most + 1}, n + {most}))")).alias("n")).where(f"n <= m + {most}")
    probe = probe.select("*", F.explode(F.expr(f"sequence(0, {most})")).alias("i")).withColumn("from", F.expr(begin)).withColumn("size", F.expr(f"{end} - {begin}"))
    probe = probe.where(f"greatest(0, from - {most}) <= least(from + {most}, m - size)").select("*", F.explode(F.expr(f"sequence(greatest(0, from - {most}), least(from + {most}, m - size))")).alias("at"))
    met = index.join(probe.select("b", "n", "i", F.expr("substring(b, at + 1, size)").alias("piece")).distinct(), ["n", "i", "piece"]).select("a", "b")
    short = v.where(F.col("n") <= most).select(F.col("v").alias("a"), F.explode(F.expr(f"sequence(0, n + {most})")).alias("n"))
    met = met.unionByName(short.join(v.select(F.col("v").alias("b"), "n"), "n").select("a", "b")).distinct()
    return met.where(F.levenshtein("a", "b", most) >= 0)


def capped_candidates(records: DataFrame, seeds: DataFrame | None = None, caps: Mapping[str, int] = CAPS, years: int = 2, same: str = "kyn") -> DataFrame:
    """The pairs of candidates() within the caps, without making the others: close_values() of the column of the least cap
    give the values that a seed's may meet, and records join on that value, the sex and the year of birth."""
    by = min(caps, key=lambda c: caps[c])
    text = lambda df: F.coalesce(df[by], F.lit(""))
    seeds = records if seeds is None else seeds
    values = records.select(text(records)).union(seeds.select(text(seeds)))
    scratch = Scratch(records.sparkSession, "close")
    close = small_side(scratch.keep(close_values(values, caps[by])))
    band = F.explode(F.sequence(F.lit(-years), F.lit(years)))
    left = seeds.select(F.struct("*").alias("seed"), text(seeds).alias("a"), F.col(same).alias("_s"), F.col("faedingarar").alias("_b"), band.alias("_k")).withColumn("_y", F.floor("_b") + F.col("_k"))
    right = records.select(F.struct("*").alias("match"), text(records).alias("b"), F.col(same).alias("_s"), F.floor("faedingarar").alias("_y"))
    near = F.abs(F.col("seed.faedingarar") - F.col("match.faedingarar")) <= years
    pairs = left.join(close, "a").join(right, ["_s", "_y", "b"]).where(near).select("seed", "match")
    return within_caps(pairs, {c: m for c, m in caps.items() if c != by})


def capped_counts(records: DataFrame, caps: Mapping[str, int] = CAPS, years: int = 2, same: str = "kyn", key: str = "id") -> DataFrame:
    """(key, n_candidates): how many of the pairs of capped_candidates() a record has, by sums over the groups of records that
    agree in all that is compared and not over pairs of records."""
    by = [same, "faedingarar", *caps]
    groups = Scratch(records.sparkSession, "counts").keep(records.where(F.col(same).isNotNull() & F.col("faedingarar").isNotNull()).groupBy(*by).agg(F.count("*").alias("n")))
    met = capped_candidates(groups, caps=caps, years=years, same=same)
    each = met.groupBy(*[F.col(f"seed.{c}").alias(f"_{c}") for c in by]).agg(F.sum("match.n").alias("n_candidates"))
    on = F.lit(True)
    for c in by:
        on &= records[c].eqNullSafe(F.col(f"_{c}"))
    return records.join(small_side(each), on).select(key, "n_candidates")


def within_caps(pairs: DataFrame, caps: Mapping[str, int] = CAPS) -> DataFrame:
    for c, most in caps.items():
        pairs = pairs.where(edits_within(F.col(f"seed.{c}"), F.col(f"match.{c}"), most))
    return pairs


def transition_score(pairs: DataFrame, transitions: DataFrame, column: str = "stada_group", out: str = "stada") -> DataFrame:
    """Score of the change from the seed's group to the match's; a pair that isn't listed means 0, the last of equal ones holds."""
    t = transitions.groupBy(F.col("from_group").alias("_f"), F.col("to_group").alias("_t")).agg(F.max("score").alias("_score"))
    on = (F.col(f"seed.{column}") == F.col("_f")) & (F.col(f"match.{column}") == F.col("_t"))
    return pairs.join(small_side(t), on, "left").withColumn(out, F.coalesce("_score", F.lit(0.0))).drop("_f", "_t", "_score")


def scored(pairs: DataFrame, transitions: DataFrame, names: Sequence[str], weights: Mapping[str, float] | None = None, marital: Marital = Marital()) -> DataFrame:
    """(seed_id, seed_u, match_id, manntal, the five terms, score)."""
    w = {t: 1.0 for t in TERMS} | dict(weights or {})
    p = transition_score(pairs, transitions)
    p = p.select(
        F.col("seed.id").alias("seed_id"), F.col("seed.uniqueness_score").alias("seed_u"), F.col("match.id").alias("match_id"), F.col("match.manntal").alias("manntal"),
        name_distance("seed", "match", names).alias("name"), age_distance("seed", "match").alias("age"), location_distance("seed", "match").alias("location"),
        marital_distance("seed", "match", marital).alias("marital"), "stada",
    )
    total = F.lit(0.0)
    for t in TERMS:
        total = total + F.col(t) * w[t]
    return p.withColumn("score", total)


def accepted(edges: DataFrame) -> DataFrame:
    """Edges that hold: score below 10, and the best score of the seed in that census below 10 times the seed's uniqueness."""
    w = Window.partitionBy("seed_id", "manntal")
    best = edges.withColumn("_best", F.min("score").over(w))
    return best.where((F.col("score") < HOLDS) & (F.col("_best") < F.col("seed_u") * float(HOLDS)) & (F.col("score") < F.col("seed_u") * float(HOLDS) + WIDEST)).drop("_best")


def first_seed(edges: DataFrame) -> DataFrame:
    """(match_id, id_individual, score): every record goes to the first seed that accepts it."""
    return edges.groupBy("match_id").agg(F.min("seed_id").alias("id_individual"), F.min_by("score", "seed_id").alias("score"))


def greedy_cover(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(match_id, id_individual, score) where a record that an earlier seed took is no seed itself.

    A seed is in if no earlier seed that is in accepts it, and out if one does; rounds settle seeds whose earlier
    acceptors are settled, until all are. Each round is written to the shared folder.
    """
    scratch = Scratch(edges.sparkSession, "cover")
    e = scratch.keep(edges.select("seed_id", "match_id", "score"))
    before = scratch.keep(e.where("seed_id < match_id").select(F.col("seed_id").alias("by"), F.col("match_id").alias("seed")))
    state = scratch.keep(e.select(F.col("seed_id").alias("seed")).distinct().withColumn("active", F.lit(None).cast("boolean")))
    for _ in range(max_rounds):
        if state.where("active is null").isEmpty():
            break
        told = before.join(state.select(F.col("seed").alias("by"), "active"), "by").groupBy("seed").agg(
            F.max(F.coalesce(F.col("active"), F.lit(False))).alias("taken"), F.max(F.col("active").isNull()).alias("open"))
        now = F.when(F.col("active").isNotNull(), F.col("active")).when(F.coalesce("taken", F.lit(False)), F.lit(False)).when(~F.coalesce("open", F.lit(False)), F.lit(True))
        nxt = scratch.keep(state.join(told, "seed", "left").select("seed", now.alias("active")))
        scratch.drop(state)
        state = nxt
    active = state.where("active").select(F.col("seed").alias("seed_id"))
    return first_seed(e.join(active, "seed_id", "left_semi"))


def near_edges(records: DataFrame, transitions: DataFrame, names: Sequence[str], marital: Marital = Marital(), caps: Mapping[str, int] = CAPS, seeds: DataFrame | None = None, years: int = 2, same: str = "kyn") -> DataFrame:
    """(seed_id, seed_u, match_id, manntal, score): of the candidates within the caps those that decide what accepted() holds,
    which are the scores below 10 (below 10 times the largest uniqueness, if that is more).

    No term but the transition's is negative, so such a score is only reached in a common unit (two missing ones agree) up to a
    width that follows from the least transition. Records meet in blocks of that unit, the sex and some years of birth; a narrower
    unit makes a block of its own only where its records are in several of the wider one. Large blocks are divided by the
    values close to a seed's in the column of the least cap.
    """
    scratch = Scratch(records.sparkSession, "near")
    by = min(caps, key=lambda c: caps[c])
    used = list(dict.fromkeys(["id", "uniqueness_score", "manntal", "faedingarar", same, *UNITS, "hjuskapur", "stada_group", *names, *caps]))
    known = lambda df: df.select(*used).where(F.col(same).isNotNull() & F.col("faedingarar").isNotNull())
    match = scratch.keep(known(records))
    seed = match if seeds is None else scratch.keep(known(seeds))
    least = transitions.agg(F.min("score")).first()[0]
    top = seed.agg(F.max("uniqueness_score")).first()[0]
    bound = HOLDS * max(1.0, top or 0.0)
    within = [k for k in range(len(UNITS)) if STEP * k + min(0.0, least or 0.0) < bound]
    # Beyond the last unit records agree in none.
    units = [] if STEP * len(UNITS) + min(0.0, least or 0.0) < bound else [UNITS[k] for k in within]
    block = lambda level, value, year: F.xxhash64(F.lit(level), value, F.col(same), year)
    year = lambda d: F.floor((F.floor("faedingarar") + d) / BLOCK_YEARS)

    def placed(df: DataFrame) -> DataFrame:
        """The rows once for each level (from 0, the widest unit) that they may first meet at, with the value of the unit."""
        if not units:
            return df.withColumns({"level": F.lit(0), "unit": F.lit(0).cast("string")})
        widest = F.col(units[-1]).cast("string")
        out = df.withColumns({"level": F.lit(0), "unit": widest})
        for k, u in enumerate(reversed(units[:-1]), 1):
            # Missing values count as a unit of their own.
            told = match.select(u, units[-1]) if seed is match else match.select(u, units[-1]).unionByName(seed.select(u, units[-1]))
            split = told.groupBy(F.col(u).alias("_u")).agg(F.min(units[-1]).alias("lo"), F.max(units[-1]).alias("hi"), F.max(F.col(units[-1]).isNull()).alias("gone"))
            split = scratch.keep(split.where("lo <> hi or (gone and lo is not null)").select("_u"))
            out = out.unionByName(df.join(small_side(split), df[u].eqNullSafe(split["_u"]), "left_semi").withColumns({"level": F.lit(k), "unit": F.col(u).cast("string")}))
        return out

    right = placed(match).withColumn("block", block(F.col("level"), "unit", year(0)))
    hot = scratch.keep(right.groupBy("block").agg(F.count("*").alias("_n")).where(F.col("_n") > LARGE).select("block", F.lit(True).alias("hot")))
    text = F.coalesce(F.col(by), F.lit(""))
    right = right.join(small_side(hot), "block", "left")
    left = placed(seed).withColumn("_y", F.explode(F.sequence(year(-years), year(years)))).withColumn("block", block(F.col("level"), "unit", F.col("_y")))
    left = left.join(small_side(hot), "block", "left")
    # A seed may enter a large block of years before or after its own.
    values = right.where("hot").select(text.alias("v")).unionByName(left.where("hot").select(text.alias("v")))
    close = small_side(scratch.keep(close_values(values, caps[by])))
    # A seed goes to those of its close values that the block has.
    met = left.where("hot").select("block", text.alias("a")).distinct().join(close, "a")
    met = scratch.keep(met.join(right.where("hot").select("block", text.alias("b")).distinct(), ["block", "b"]))
    packed = lambda df, side, key: df.select(key.alias("key"), "level", F.struct(*used).alias(side))
    cut = lambda c: F.xxhash64("block", c)
    lefts = packed(left.where("hot is null"), "seed", F.col("block")).unionByName(packed(left.where("hot").withColumn("a", text).join(met, ["block", "a"]), "seed", cut("b")))
    rights = packed(right, "match", F.when(F.col("hot"), cut(text)).otherwise(F.col("block")))
    # Hashes only bring rows together: all that they stand for is compared.
    alike = F.col(f"seed.{same}") == F.col(f"match.{same}")
    alike &= F.abs(F.col("seed.faedingarar") - F.col("match.faedingarar")) <= years
    agree = [F.col(f"seed.{u}").eqNullSafe(F.col(f"match.{u}")) for u in reversed(units)]
    first = F.lit(False) if units else F.lit(True)
    for k, x in enumerate(agree):
        first = first | ((F.col("level") == k) & x & ~F.greatest(F.lit(False), F.lit(False), *agree[:k]))
    pairs = lefts.join(rights, ["key", "level"]).where(alike & first).select("seed", "match")
    edges = scored(within_caps(pairs, caps), transitions, names, marital=marital)
    return edges.where(F.col("score") < bound).select("seed_id", "seed_u", "match_id", "manntal", "score")


def link(records: DataFrame, transitions: DataFrame, names: Sequence[str], mode: str = "first_seed", marital: Marital = Marital(), caps: Mapping[str, int] = CAPS, seeds: DataFrame | None = None) -> DataFrame:
    """Whole linkage; records has uniqueness_score. mode: first_seed or greedy_cover.

    Without given seeds, records that agree in all that is judged are linked as one, by the least id: they have the same edges,
    so if any of them is a seed that holds, the least one is, and all go to the same seed.
    """
    cover = greedy_cover if mode == "greedy_cover" else first_seed
    if seeds is not None:
        return cover(accepted(near_edges(records, transitions, names, marital, caps, seeds)))
    by = list(dict.fromkeys(["uniqueness_score", "manntal", "faedingarar", "kyn", *UNITS, "hjuskapur", "stada_group", *names, *caps]))
    one = Scratch(records.sparkSession, "same").keep(records.groupBy(*by).agg(F.min("id").alias("id"), F.collect_list("id").alias("ids")))
    out = cover(accepted(near_edges(one, transitions, names, marital, caps)))
    return out.join(one.select(F.col("id").alias("match_id"), "ids"), "match_id").select(F.explode("ids").alias("match_id"), "id_individual", "score")


def same_person_flag(pairs: DataFrame) -> Column:
    return F.coalesce(F.col("seed.bi_einstaklingur") == F.col("match.bi_einstaklingur"), F.lit(False))

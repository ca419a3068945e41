"""Problem 5: train, validation and test splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinweave.llm.components import large_small_star
from kinweave.runtime import small_side


def record_name(keys: list[str]) -> Column:
    return F.coalesce(*[F.concat(F.lit(f"{i}:"), F.col(k).cast("string")) for i, k in enumerate(keys)])


def linked_labels(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(_c, n_rows, component): a text label shared by all rows that agree in some key, directly or through other rows.

    The keys are folded in one by one. Per value of the component so far only its least value of the next key stays in the
    large pass; values that meet in one component give the edges for large-star and small-star, so that the iterated graph
    holds only entities with something to merge. NULL keys bind nothing: a row is known by its first key that is not NULL
    (`record_name`), and rows with none have no label.
    """
    at = rows.select(record_name(keys).alias("_c"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys[1:])]).where("_c is not null")
    ids = at.groupBy("_c").agg(*[F.min(f"_k{i}").alias(f"_m{i}") for i in range(len(keys) - 1)], F.count("*").alias("_n")) if len(keys) > 1 else at.groupBy("_c").agg(F.count("*").alias("_n"))
    ids = ids.withColumn("_label", F.col("_c"))
    for i in range(len(keys) - 1):
        m, low = F.col(f"_k{i}"), F.col("_low")
        pairs = at.where(m.isNotNull()) if i == 0 else at.join(ids.select("_c", "_label"), "_c").where(m.isNotNull())
        by = "_c" if i == 0 else "_label"
        lows = pairs.groupBy(by).agg(F.min(m).alias("_low"), F.max(m).alias("_high"))
        several = lows.where("_low <> _high").select(by, "_low")
        edges = pairs.join(several, by).where(m != low).select(m.alias("a"), low.alias("b"))
        merged = large_small_star(edges)
        lows = lows.select(by, "_low").join(small_side(merged), F.col("_low") == F.col("node"), "left")
        lows = lows.select(F.col(by), F.concat(F.lit(f"{i + 1}:"), F.coalesce("component", "_low").cast("string")).alias("_new"))
        ids = ids.join(lows, by, "left").withColumn("_label", F.coalesce("_new", "_label")).drop("_new")
    return ids.select("_c", F.col("_n").alias("n_rows"), F.col("_label").alias("component"))


def _unit(label: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(label, F.lit(seed)), F.lit(1 << 32)) / F.lit(float(1 << 32))


def split_ranges(sizes: DataFrame, shares: dict[str, float], seed: int) -> tuple[list[tuple[str, float]], float]:
    """Upper bounds of the hash ranges, and the size from which a component is placed in the first split outright.

    A component larger than the smallest split's share of all rows would upset any range it fell into; such components
    (fewer of them than 1 / share) join the largest split, whose range shrinks by as many rows.
    """
    total = sizes.agg(F.sum("n_rows")).first()[0] or 0
    limit = min(shares.values()) * total
    big = sizes.where(F.col("n_rows") > limit).agg(F.sum("n_rows")).first()[0] or 0
    largest = max(shares, key=shares.get)
    rest = {k: max(0.0, v * total - (big if k == largest else 0)) for k, v in shares.items()}
    all_rest, upto, out = sum(rest.values()) or 1.0, 0.0, []
    for k, v in rest.items():
        upto += v / all_rest
        out.append((k, upto))
    return out, limit


def grouped_splits(rows: DataFrame, keys: list[str], shares: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """`rows` with `component` (text) and `split`: rows that share a value in any of `keys`, even through others, agree.

    The component label's hash falls into ranges in proportion to `shares`; see split_ranges for giant components. A row
    whose keys are all NULL is bound by nothing and is placed by the hash of its content. Columns of the
    input named like the results are replaced. An empty table stays empty.
    """
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    rows = rows.drop("component", "split")
    labels = linked_labels(rows, keys)
    sizes = labels.groupBy("component").agg(F.sum("n_rows").alias("n_rows"))
    ranges, limit = split_ranges(sizes, shares, seed)
    largest = max(shares, key=shares.get)
    big = small_side(sizes.where(F.col("n_rows") > limit).select("component", F.lit(True).alias("_big")))
    content = F.concat(F.lit("row:"), F.xxhash64(*[F.col(c) for c in rows.columns]).cast("string"))
    out = rows.withColumn("_c", record_name(keys)).join(labels.drop("n_rows"), "_c", "left").withColumn("component", F.coalesce("component", content)).join(big, "component", "left")
    u = _unit(F.col("component"), seed)
    chosen = F.lit(ranges[-1][0])
    for name, upto in reversed(ranges[:-1]):
        chosen = F.when(u < upto, name).otherwise(chosen)
    return out.withColumn("split", F.when(F.col("_big"), largest).otherwise(chosen)).select(*rows.columns, "component", "split")

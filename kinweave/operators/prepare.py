"""Preparation of record tables: null policies, narrowing, lookups, frequencies, uniqueness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinweave.runtime import small_side


def fill_missing(df: DataFrame, texts: Sequence[str] = (), numbers: Sequence[str] = ()) -> DataFrame:
    """Missing texts as the empty text, missing numbers as 0."""
    return df.fillna("", list(texts)).fillna(0, list(numbers))


def whole_numbers(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "bigint"]


def narrowed(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """64-bit columns as the narrowest type that holds all their values, found in one pass; empty columns stay."""
    columns = list(columns or whole_numbers(df))
    if not columns:
        return df
    ends = df.agg(*[F.min(c).alias(f"{c}_lo") for c in columns], *[F.max(c).alias(f"{c}_hi") for c in columns]).first()

    def kind(c: str) -> str:
        lo, hi = ends[f"{c}_lo"], ends[f"{c}_hi"]
        if lo is None:
            return "bigint"
        return "smallint" if lo >= -32768 and hi < 32767 else "int" if lo >= -(2**31) and hi < 2147483647 else "bigint"

    return df.withColumns({c: F.col(c).cast(kind(c)) for c in columns})


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key by an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_location(records: DataFrame, lookup: DataFrame, keys: Sequence[str] = ("bi_baer", "manntal"), values: Sequence[str] = ("bi_hreppur", "bi_sokn", "bi_sysla"), order: Sequence[str] = ("id",)) -> DataFrame:
    """Left join with the first lookup row of each key; missing keys meet missing keys. The lookup is broadcast only
    where its size is proven small."""
    side = small_side(first_rows(lookup, keys, order).select(*[F.col(k).alias(f"_{k}") for k in keys], *values))
    on = [records[k].eqNullSafe(side[f"_{k}"]) for k in keys]
    return records.drop(*values).join(side, on, "left").drop(*[f"_{k}" for k in keys])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def value_extremes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column the largest and smallest count of a value, how many values have it, and the first such value."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("s")).select("s.*")
    n = each.where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))
    ends = n.groupBy("field").agg(F.max("n").alias("max_n"), F.min("n").alias("min_n"))
    at = n.join(F.broadcast(ends), "field")
    return at.groupBy("field", "max_n", "min_n").agg(
        F.sum(F.when(F.col("n") == F.col("max_n"), 1).otherwise(0)).alias("max_ties"),
        F.sum(F.when(F.col("n") == F.col("min_n"), 1).otherwise(0)).alias("min_ties"),
        F.min(F.when(F.col("n") == F.col("max_n"), F.col("value"))).alias("max_value"),
        F.min(F.when(F.col("n") == F.col("min_n"), F.col("value"))).alias("min_value"),
    )


def with_uniqueness(df: DataFrame, columns: Sequence[str], out: str = "uniqueness_score") -> DataFrame:
    """How rare a record's names are, from 0 to 1.

    Per column 100 for the rarest value down to 0 for the most frequent, the mean over the columns with one decimal, then
    scaled by its extremes. A column whose values are all equally frequent gives NULL for all. Counts come from groups,
    not from windows over a hot value, and their extremes from one row.
    """
    result, parts = df, []
    for k, c in enumerate(columns):
        n = df.groupBy(F.col(c).alias(f"_v{k}")).agg(F.count("*").alias(f"_n{k}"))
        ends = F.broadcast(n.agg(F.max(f"_n{k}").alias(f"_hi{k}"), F.min(f"_n{k}").alias(f"_lo{k}")))
        span = F.nullif(F.col(f"_hi{k}") - F.col(f"_lo{k}"), F.lit(0))
        score = n.crossJoin(ends).select(f"_v{k}", (100.0 - (F.col(f"_n{k}") - F.col(f"_lo{k}")) / span * 100.0).alias(f"_s{k}"))
        result = result.join(score, result[c].eqNullSafe(score[f"_v{k}"])).drop(f"_v{k}")
        parts.append(F.col(f"_s{k}"))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    result = result.withColumn("_u", F.bround(total / float(len(columns)), 1)).drop(*[f"_s{k}" for k in range(len(columns))])
    ends = F.broadcast(result.agg(F.max("_u").alias("_hi"), F.min("_u").alias("_lo")))
    scaled = (F.col("_u") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return result.crossJoin(ends).withColumn(out, scaled).drop("_u", "_hi", "_lo")


def row_positions(df: DataFrame, order: Sequence[str], out: str = "row_pos") -> DataFrame:
    """0-based positions in a global order without a task that holds all rows: rows are range-partitioned, counted per
    partition, and numbered from each partition's offset."""
    spark = df.sparkSession
    # Kept, so that the counts and the numbers see the same ranges.
    from kinweave.runtime import Scratch

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    kept = Scratch(spark, "positions").keep(ranged)
    counts = {r["_p"]: r["count"] for r in kept.groupBy("_p").count().collect()}
    at, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, at))
        at += counts[p]
    start = F.broadcast(spark.createDataFrame(offsets, "_p int, _at long"))
    w = Window.partitionBy("_p").orderBy(*order)
    return kept.join(start, "_p").withColumn(out, (F.row_number().over(w) - 1 + F.col("_at")).cast("long")).drop("_p", "_at")


def running_sums(df: DataFrame, order: Column | str, columns: Sequence[str], suffix: str = "_upto") -> DataFrame:
    """Sums of `columns` from the first row of a global order to each row, itself included, without a task that holds all
    rows: rows are range-partitioned, summed per partition, and go on from what the partitions before hold. Order values are
    distinct."""
    from kinweave.runtime import Scratch

    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id())
    kept = Scratch(df.sparkSession, "sums").keep(ranged)  # kept, so that both passes see the same ranges
    parts = kept.groupBy("_p").agg(*[F.sum(c).alias(c) for c in columns]).orderBy("_p").collect()  # a row a partition
    before, rows = [0] * len(columns), []
    for r in parts:
        rows.append((r["_p"], *before))
        before = [x + (r[c] or 0) for x, c in zip(before, columns)]
    kinds = dict(kept.dtypes)
    kind = {c: "double" if kinds[c] in ("double", "float") else "long" for c in columns}
    start = F.broadcast(df.sparkSession.createDataFrame([(p, *[float(x) if kind[c] == "double" else int(x) for x, c in zip(v, columns)]) for p, *v in rows], ", ".join(["_p int", *[f"_at_{c} {kind[c]}" for c in columns]])))
    w = Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return kept.join(start, "_p").withColumns({f"{c}{suffix}": F.sum(c).over(w) + F.col(f"_at_{c}") for c in columns}).drop("_p", *[f"_at_{c}" for c in columns])

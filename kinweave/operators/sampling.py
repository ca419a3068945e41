"""Pairs, samples and splits that come out alike on every run: order by md5 of the key with a seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def hash_order(key: str, seed: int = 42) -> list[Column]:
    return [F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), F.col(key)]


def unit(key: str, seed: int = 42) -> Column:
    """A number in [0, 1) from the key's md5: a split needs no global order."""
    head = F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 8)
    return F.conv(head, 16, 10).cast("double") / float(1 << 32)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in hash order; a top-k per partition, merged."""
    return df.orderBy(*hash_order(key, seed)).limit(n)


def sample_fraction(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    return df.where(unit(key, seed) < fraction)


def split_clusters(df: DataFrame, cluster: str, shares: dict[str, float], seed: int = 42, out: str = "split") -> DataFrame:
    """Rows of one cluster on one side; clusters fall into ranges of the hash."""
    upto, chosen = 1.0, F.lit(list(shares)[-1])
    for name, share in reversed(list(shares.items())):
        low = upto - share
        chosen = F.when(unit(cluster, seed) < upto, name).otherwise(chosen) if upto < 1 - 1e-9 else F.lit(name)
        upto = low
    return df.withColumn(out, chosen)


def all_pairs(df: DataFrame, key: str, within: Sequence[str] = ()) -> DataFrame:
    """Unordered pairs (id_1 < id_2) of rows that agree in `within`."""
    a = df.select(*within, F.col(key).alias("id_1"))
    b = df.select(*within, F.col(key).alias("id_2"))
    return a.join(b, list(within)).where("id_1 < id_2") if within else a.join(b, F.col("id_1") < F.col("id_2"))


def ordered_pairs(df: DataFrame, key: str, within: Sequence[str]) -> DataFrame:
    """Pairs of different rows, both ways."""
    p = all_pairs(df, key, within)
    return p.unionByName(p.select(*[c for c in p.columns if c not in ("id_1", "id_2")], F.col("id_2").alias("id_1"), F.col("id_1").alias("id_2")))


def random_pairs(positioned: DataFrame, key: str, n: int, seed: int = 42, pos: str = "row_pos") -> DataFrame:
    """n draws of two different positions, looked up by two joins; a table of fewer than two rows gives none."""
    rows = positioned.count()
    spark = positioned.sparkSession
    if rows < 2:
        return positioned.limit(0).select(F.lit(0).cast("long").alias("draw"), F.col(key).alias("id_1"), F.col(key).alias("id_2"))
    a = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(rows))
    b = F.pmod(a + 1 + F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(rows - 1)), F.lit(rows))
    draws = spark.range(n).select(F.col("id").alias("draw"), a.alias("_a"), b.alias("_b"))
    p = positioned.select(F.col(key).alias("_k"), F.col(pos).alias("_p"))
    for c, k in (("_a", "id_1"), ("_b", "id_2")):
        draws = draws.join(p.withColumnsRenamed({"_k": k, "_p": c}), c)
    return draws.select("draw", "id_1", "id_2")


def neighbour_pairs(positioned: DataFrame, key: str, scope: int, pos: str = "row_pos") -> DataFrame:
    """Each row with itself and the next scope - 1 rows by position."""
    a = positioned.select(F.col(key).alias("id_1"), F.col(pos).alias("_p"), F.explode(F.sequence(F.lit(0), F.lit(scope - 1))).alias("step"))
    b = positioned.select(F.col(key).alias("id_2"), F.col(pos).alias("_q"))
    return a.join(b, F.col("_p") + F.col("step") == F.col("_q")).select("id_1", "id_2", "step")


def two_members(df: DataFrame, key: str, cluster: str, seed: int = 42) -> DataFrame:
    """(cluster, id_1, id_2): one pair of rows of every cluster with two rows, by least hashes.

    Two aggregations of one value each instead of a window over a hot cluster.
    """
    h = F.struct(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")).alias("h"), F.col(key).alias("k"))
    first = df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.min(h).alias("a"))
    rest = df.join(first, cluster).where(h != F.col("a"))
    second = rest.groupBy(cluster, "a").agg(F.min(h).alias("b"))
    return second.select(cluster, F.col("a.k").alias("id_1"), F.col("b.k").alias("id_2"))


def positive_pairs(df: DataFrame, key: str, cluster: str, seed: int = 42) -> DataFrame:
    return two_members(df, key, cluster, seed).select("id_1", "id_2", F.col(cluster).alias("cluster_1"), F.col(cluster).alias("cluster_2"), F.lit(1).alias("label"))


def negative_pairs(df: DataFrame, key: str, cluster: str, seed: int = 42) -> DataFrame:
    """For each cluster with two rows, its first row with the first row of the next such cluster in hash order (the last
    with the first): as many pairs as positive ones, of different clusters. The order is cut into ranges by the first
    two hex digits of the hash, and each range ends with the head of the next one."""
    firsts = two_members(df, key, cluster, seed).select(F.col(cluster).alias("c"), F.col("id_1").alias("id"))
    h = firsts.withColumn("h", F.md5(F.concat(F.col("c").cast("string"), F.lit(f":{seed}")).cast("binary"))).withColumn("r", F.substring("h", 1, 2))
    w = Window.partitionBy("r").orderBy("h", "c")
    inner = h.withColumn("nxt", F.lead(F.struct("c", "id")).over(w))
    heads = h.groupBy("r").agg(F.min(F.struct("h", "c", "id")).alias("s"))
    order = Window.orderBy("r")  # at most 256 rows
    circle = heads.select("r", F.coalesce(F.lead("s").over(order), F.first("s").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("s"))
    out = inner.join(F.broadcast(circle), "r").withColumn("nxt", F.coalesce("nxt", F.struct(F.col("s.c").alias("c"), F.col("s.id").alias("id"))))
    return out.where("c <> nxt.c").select(F.col("id").alias("id_1"), F.col("nxt.id").alias("id_2"), F.col("c").alias("cluster_1"), F.col("nxt.c").alias("cluster_2"), F.lit(0).alias("label"))


def oversampled(df: DataFrame, key: str, cluster: str, least: int = 20) -> DataFrame:
    """Clusters with fewer than `least` rows repeated in turn up to it; larger ones as they are. `copy` counts from 0."""
    w = Window.partitionBy(cluster)
    at = F.row_number().over(w.orderBy(*hash_order(key))) - 1
    n = F.count("*").over(w)
    d = df.withColumn("_at", at).withColumn("_n", n)
    times = F.when(F.col("_n") >= least, 1).otherwise(F.expr(f"({least} - _at + _n - 1) div _n"))
    return d.withColumn("copy", F.explode(F.sequence(F.lit(0), times.cast("int") - 1))).drop("_at", "_n")


def singletons(df: DataFrame, cluster: str) -> tuple[DataFrame, DataFrame]:
    """(rows of clusters with one row, rows of the others); rows without cluster are in neither."""
    one = df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("_n")).where("_n = 1").select(cluster)
    known = df.where(F.col(cluster).isNotNull())
    return known.join(one, cluster, "left_semi"), known.join(one, cluster, "left_anti")

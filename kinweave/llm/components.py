"""Connected components over edge tables, two ways.

Both take an edge table with two columns of one orderable type and return one row per node that has an edge:
(node, component), component being the smallest node of the group. Self edges, repeated edges and rows with a NULL end
bind nothing; an empty edge table gives an empty result. Hubs are safe: per-node work is a minimum that is combined
before the shuffle, neighbours are never collected, and every round is written to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from kinweave.runtime import Scratch


def _edges(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")


def propagate_labels(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """Minimum labels spread over edges, with pointer jumping and contraction.

    A round gives every node the least label among itself and its neighbours, lets labels jump along their own pointers, and rewrites the edges to the labels reached; edges inside one label vanish. The rounds end when no edge
    is left, that is when no label would change. The per-round pointer tables shrink with the edges and are chained
    backwards at the end, so the total work is about linear in the edges.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "labels")
    e = scratch.keep(_edges(edges, a, b).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    pointers: list[DataFrame] = []
    for _ in range(max_rounds):
        if e.isEmpty():
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p"))
        first = scratch.keep(low)
        jump = first.select(F.col("a").alias("p"), F.col("p").alias("q"))
        p = scratch.keep(first.join(jump, "p").select("a", F.col("q").alias("p")))
        pa, pb = p.select("a", F.col("p").alias("pa")), p.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = e.join(pa, "a").join(pb, "b").where("pa <> pb")
        nxt = scratch.keep(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        scratch.drop(e, first)
        e = nxt
        pointers.append(p)
    else:
        raise RuntimeError("labels did not settle")
    if not pointers:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    scratch.drop(e)
    def chain(later: DataFrame, earlier: DataFrame) -> DataFrame:
        at = later.select(F.col("a").alias("p"), F.col("p").alias("q"))
        return earlier.join(at, "p", "left").select("a", F.coalesce("q", "p").alias("p"))
    labels = reduce(chain, reversed(pointers))
    return labels.select(F.col("a").alias("node"), F.col("p").alias("component"))


def large_small_star(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """Alternating large-star and small-star steps until the edge set is a forest of stars.

    Large-star links every larger neighbour of a node to the least node of its neighbourhood, small-star does so for the
    smaller neighbours and the node itself. The edge set never grows beyond its start, and a fixed point is reached when a
    whole round leaves it as it was (compared by count and two independent hash sums).
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "stars")

    def mark(df: DataFrame):
        h = F.xxhash64("a", "b")
        return tuple(df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first())

    e = scratch.keep(_edges(edges, a, b).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.keep(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        nxt = scratch.keep(small)
        scratch.drop(e, large)
        e, before = nxt, seen
        seen = mark(e)
        if seen == before:
            break
    else:
        raise RuntimeError("stars did not settle")
    centres = e.select(F.col("b").alias("a"), "b").distinct()
    return e.unionByName(centres).select(F.col("a").alias("node"), F.col("b").alias("component"))

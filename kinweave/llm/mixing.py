"""Problem 9: a mixture of sources by target shares of the tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kinweave.llm.tokens import TOKENIZER, encoder
from kinweave.runtime import Scratch, small_side

_U = np.uint64


def quotas(have: dict[str, int], share: dict[str, float], repeats: dict[str, int], total: int | None = None, hopeless: float = 0.5) -> dict[str, float]:
    """Tokens that each source contributes.

    A source can give its tokens times its repeats. With `total` given, sources that can't give their share of it give all
    they can, and the others fill up in proportion to their targets as far as they can. Without it the mixture is as large
    as it can be with every target met, but at most one pass over the tokens at hand, where sources that could not meet
    their target in a mixture of `hopeless` times that size don't limit it: they give all they can.
    """
    can = {s: float(have.get(s, 0)) * max(0, repeats[s] or 0) for s in share}
    full = sum(float(have.get(s, 0)) for s in share)
    want = {s: max(0.0, share[s] or 0.0) for s in share}
    limits = {s: can[s] / want[s] for s in share if want[s] > 0}
    if total is None:
        able = [x for s, x in limits.items() if x >= hopeless * full and x > 0]
        x = min([full, *able]) if able else 0.0
        return {s: min(can[s], want[s] * x) for s in share}
    done: dict[str, float] = {s: 0.0 for s in share if want[s] == 0}
    while len(done) < len(share):
        rest = {s: w for s, w in want.items() if s not in done}
        x = (total - sum(done.values())) / sum(rest.values())
        over = [s for s in rest if rest[s] * x > can[s]]
        if not over:
            return done | {s: w * x for s, w in rest.items()}
        done |= {s: can[s] for s in over}
    return done


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at the places i: a four-round Feistel network on the next even number of bits,
    walked until it falls below n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = _U((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> _U(half), x & mask
        for r in range(4):
            h = (b + _U((key * 0x9E3779B97F4A7C15 + r * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF)) * _U(0xFF51AFD7ED558CCD)
            h ^= h >> _U(33)
            h = h * _U(0xC4CEB9FE1A85EC53)
            a, b = b, a ^ ((h >> _U(29)) & mask)
        return (a << _U(half)) | b

    x = once(i.astype(_U))
    while len(at := np.flatnonzero(x >= _U(n))):
        x[at] = once(x[at])
    return x.astype(np.int64)


def _sized(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                n = [len(encode(x)) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return run


def _offset(df: DataFrame, by: str, order: list, size: str, per: int, scratch: Scratch) -> DataFrame:
    """`df` with `_at`: the sum of `size` before each row of its group, without a task that holds a whole group.

    Rows of a group are dealt by hash into cells of about `per` rows; sums run within cells, and the totals of the cells
    before come from a table of one row per `per` rows.
    """
    w = Window.partitionBy(by, "_cell").orderBy(*order)
    cells = df.groupBy(by, "_cell").agg(F.sum(size).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(by).orderBy("_cell")) - F.col("_sum")
    cells = small_side(cells.select(by, "_cell", before.alias("_before")))
    inner = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    return df.withColumn("_inner", inner).join(cells, [by, "_cell"]).withColumn("_at", F.col("_inner") + F.col("_before")).drop("_inner", "_before", "_cell")


def mix_sources(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", total: int | None = None, block: int = 1024, shard_slots: int = 512, seed: int = 42, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    mixture: (out_shard, slot, source, copy, doc_id, tok_start, tok_end), the stretch of a text's tokens that stands in a
    slot of an output shard, `copy` counting the passes over the source from 0. report: (source, target_share, max_repeats,
    n_texts, n_tokens, quota, used_tokens, actual_share, most_copies, met), one row per target, sources without texts too.

    The texts of a source, in pseudorandom order, are one row of tokens, cut into blocks of `block` (the last may be
    shorter). Every output shard draws the sources of its slots from the multinomial of the quotas, seeded by its number.
    The slots of a source are numbered through all shards; slot i takes the block at place i of a pseudorandom permutation
    of the source's blocks, another one for each pass, so that a block stands in as many slots as there are passes or one
    less. Slots that a source drew beyond its quota go to the sources that drew too few, so that the shares don't hang on the
    draw; slots beyond all passes allowed stay empty. Rows with a NULL key, NULL or empty texts and sources without
    target contribute nothing; target rows must be unique by source (the first by share counts); other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    wanted = targets.where(F.col(source).isNotNull()).groupBy(source).agg(F.max(F.struct("target_share", "max_repeats")).alias("t"))
    listed = wanted.select(source, "t.target_share", "t.max_repeats").limit(10_001).collect()
    if len(listed) > 10_000:
        raise ValueError("more than 10,000 sources in the targets")
    share = {r[0]: float(r[1] or 0.0) for r in listed}
    repeats = {r[0]: int(r[2] or 0) for r in listed}
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    base = base.where(F.col("doc_id").isNotNull() & (F.col("text") != "") & F.col("source").isin(list(share) or [""]))
    sized = scratch.keep(base.mapInArrow(_sized(tokenizer), "doc_id bigint, source string, n_tokens bigint").where("n_tokens > 0"))
    stats = {r["source"]: r for r in sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}
    have = {s: int(r["t"]) for s, r in stats.items()}
    quota = quotas(have, share, repeats, total)
    blocks = {s: -(-have.get(s, 0) // block) for s in share}
    rows = sum(int(r["n"]) for r in stats.values())

    cells = max(1, rows // 20_000)
    mixed = F.xxhash64("doc_id", F.lit(seed))
    placed = _offset(sized.withColumn("_h", mixed).withColumn("_cell", F.pmod(F.col("_h"), F.lit(cells))), "source", ["_h", "doc_id"], "n_tokens", 20_000, scratch)
    first, last = F.expr(f"_at div {block}"), F.expr(f"(_at + n_tokens - 1) div {block}")
    cut = placed.select("source", "doc_id", "n_tokens", "_at", F.explode(F.sequence(first, last)).alias("block"))
    pieces = cut.select(
        "source", "block", "doc_id",
        F.greatest(F.lit(0), F.col("block") * block - F.col("_at")).alias("tok_start"),
        F.least(F.col("n_tokens"), (F.col("block") + 1) * block - F.col("_at")).alias("tok_end"),
    )

    names = [s for s in sorted(share) if quota[s] > 0 and blocks[s] > 0]
    slots = int(round(sum(quota[s] * blocks[s] / have[s] for s in names))) if names else 0
    p = np.array([quota[s] * blocks[s] / have[s] for s in names]) if names else np.ones(1)
    p = p / p.sum()
    n_shards = -(-slots // shard_slots)
    index = {s: k for k, s in enumerate(names)}

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            n = np.minimum(shard_slots, slots - ids * shard_slots)
            got = np.stack([np.random.Generator(np.random.Philox(key=[seed, int(i)])).multinomial(m, p) for i, m in zip(ids, n)]) if len(ids) else np.zeros((0, len(p)), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, len(p))), pa.array(np.tile(np.arange(len(p)), len(ids)).astype(np.int32)), pa.array(got.reshape(-1))], names=["out_shard", "s", "n"])

    counts = spark.range(n_shards if names else 0).mapInArrow(drawn, "out_shard bigint, s int, n bigint").withColumn("_cell", F.expr("out_shard div 20000"))
    numbered = _offset(counts, "s", ["out_shard"], "n", 20_000, scratch)
    size = [blocks[s] for s in names]
    goal = np.floor(p * slots).astype(np.int64)
    goal[np.argsort(goal - p * slots, kind="stable")[: slots - goal.sum()]] += 1
    goal = np.minimum(goal, [blocks[s] * repeats[s] for s in names] or [0])
    totals = np.zeros(len(p), dtype=np.int64)
    for r in counts.groupBy("s").agg(F.sum("n").alias("n")).collect():
        totals[r["s"]] = r["n"]
    # Slots drawn beyond a source's goal, numbered through all sources, go in this order to those drawn too seldom.
    vacant_at = np.cumsum(np.maximum(totals - goal, 0)) - np.maximum(totals - goal, 0)
    lack = np.maximum(goal - totals, 0)
    lack_ends = np.cumsum(lack)

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, s, n, at in zip(*(b.column(c).to_pylist() for c in range(4))):
                i = at + np.arange(n)
                own, v = i[i < goal[s]], i[i >= goal[s]] - goal[s] + vacant_at[s]
                u = np.searchsorted(lack_ends, v, "right")
                v, u = v[u < len(p)], u[u < len(p)]
                i = np.concatenate([own, totals[u] + v - (lack_ends - lack)[u]])
                who = np.concatenate([np.full(len(own), s), u])
                copy, where = np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=np.int64)
                for w in np.unique(who):
                    of = who == w
                    copy[of] = i[of] // size[w]
                    for c in np.unique(copy[of]):
                        m = of & (copy == c)
                        where[m] = permuted(i[m] % size[w], size[w], seed * 1_000_003 + int(w) * 1009 + int(c))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), shard)), pa.array([names[w] for w in who], pa.string()), pa.array(i), pa.array(copy.astype(np.int32)), pa.array(where)], names=["out_shard", "source", "k", "copy", "block"])

    slot_rows = numbered.select("out_shard", "s", "n", "_at").mapInArrow(taken, "out_shard bigint, source string, k bigint, copy int, block bigint")
    shuffled = F.xxhash64("source", "k", F.lit(seed))
    slot_rows = slot_rows.withColumn("slot", F.row_number().over(Window.partitionBy("out_shard").orderBy(shuffled, "source", "k")) - 1)
    # The size of the slots can't be seen from the shards they come from; without the hint they may be broadcast.
    out = scratch.keep(slot_rows.hint("merge").join(pieces.hint("merge"), ["source", "block"]).select("out_shard", "slot", "source", "copy", "doc_id", "tok_start", "tok_end"))

    used = out.groupBy("source").agg(F.sum(F.col("tok_end") - F.col("tok_start")).alias("used_tokens"), (F.max("copy") + 1).alias("most_copies"))
    known = spark.createDataFrame(
        [(s, share[s], repeats[s], int(stats[s]["n"]) if s in stats else 0, have.get(s, 0), int(round(quota[s]))) for s in sorted(share)],
        "source string, target_share double, max_repeats int, n_texts bigint, n_tokens bigint, quota bigint",
    )
    report = known.join(used, "source", "left").fillna(0, ["used_tokens", "most_copies"])
    every = out.agg(F.sum(F.col("tok_end") - F.col("tok_start")).alias("_all"))
    report = report.crossJoin(F.broadcast(every)).withColumn("actual_share", F.round(F.col("used_tokens") / F.col("_all"), 6)).drop("_all")
    met = F.coalesce(F.col("actual_share") >= F.col("target_share") * 0.99, F.lit(False))
    return out.withColumnRenamed("doc_id", key), report.withColumn("met", met)

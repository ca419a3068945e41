"""Problem 8: texts packed into containers of a fixed number of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from kinweave.llm.tokens import TOKENIZER, encoder, vocabulary
from kinweave.runtime import Scratch


def _tokenised(path: str, capacity: int):
    """(doc_id, salt, n_tokens, terms, tfs) per text, terms being those of the part left after whole containers.

    At its end a task adds one row with doc_id NULL: the number of its texts in n_tokens, and in how many of them each
    token occurs. Document frequencies are counted over whole texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = encoder(path), vocabulary(path)
        df, texts, seen = np.zeros(size, dtype=np.int64), 0, {}
        names = ["doc_id", "salt", "n_tokens", "terms", "tfs"]
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                salt, n, terms, tfs = [], [], [], []
                ids = part.column(0).to_pylist()
                for doc, text in zip(ids, part.column(1).to_pylist()):
                    tokens = np.array(encode(text), dtype=np.uint32)
                    df[np.unique(tokens)] += 1
                    texts += 1
                    t, f = np.unique(tokens[len(tokens) // capacity * capacity :], return_counts=True)
                    terms.append(t.astype("<u4").tobytes())
                    tfs.append(np.minimum(f, 65535).astype("<u2").tobytes())
                    n.append(len(tokens))
                    salt.append(seen.get(doc, 0))
                    seen[doc] = salt[-1] + 1
                if len(seen) > 500_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(salt, pa.int32()), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], names=names)
        t = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([0], pa.int32()), pa.array([texts], pa.int64()), pa.array([t.astype("<u4").tobytes()], pa.binary()), pa.array([df[t].astype("<u8").tobytes()], pa.binary())], names=names)

    return run


class Shard:
    """Inverted index of one shard's items with BM25 weights, and the greedy filling of its containers."""

    def __init__(self, sizes: np.ndarray, terms: list[np.ndarray], tfs: list[np.ndarray], idf: np.ndarray, k1: float = 1.2, b: float = 0.75):
        self.sizes = sizes
        n = len(sizes)
        item = np.repeat(np.arange(n), [len(t) for t in terms])
        term = np.concatenate(terms) if n else np.empty(0, dtype=np.uint32)
        tf = (np.concatenate(tfs) if n else np.empty(0)).astype(np.float32)
        use = idf[term] > 0
        item, term, tf = item[use], term[use], tf[use]
        mean = sizes.mean() if n else 1.0
        weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[item] / mean))
        order = np.argsort(term, kind="stable")
        self.post_item, self.post_weight = item[order], weight[order].astype(np.float32)
        self.terms, at = np.unique(term[order], return_index=True)
        self.at = np.append(at, len(term))
        # Terms of each item, as positions in self.terms.
        by_item = np.argsort(item, kind="stable")
        self.item_terms = np.searchsorted(self.terms, term[by_item])
        self.item_at = np.searchsorted(item[by_item], np.arange(n + 1))

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused items with a term in common, best BM25 score first."""
        t = self.item_terms[self.item_at[seed] : self.item_at[seed + 1]]
        if not len(t):
            return t
        lo, n = self.at[t], self.at[t + 1] - self.at[t]
        pick = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        who = self.post_item[pick]
        score = np.bincount(who, weights=self.post_weight[pick], minlength=len(unused))
        found = np.flatnonzero((score > 0) & unused)
        return found[np.lexsort((found, -score[found]))]

    def fill(self, capacity: int) -> np.ndarray:
        """Container number of each item. Seeds are taken largest first; a seed's neighbours fill its container as far as
        they fit, then the largest items that fit fill what is left over."""
        n = len(self.sizes)
        container, unused = np.full(n, -1, dtype=np.int64), np.ones(n, dtype=bool)
        stacks: dict[int, list[int]] = {}
        order = np.lexsort((np.arange(n), -self.sizes))
        for i in order[::-1].tolist():
            stacks.setdefault(int(self.sizes[i]), []).append(i)
        count = np.bincount(self.sizes, minlength=capacity + 1)
        k = 0

        def take(i: int) -> int:
            container[i], unused[i] = k, False
            count[self.sizes[i]] -= 1
            return int(self.sizes[i])

        for seed in order.tolist():
            if not unused[seed]:
                continue
            room = capacity - take(seed)
            smallest = np.flatnonzero(count)
            if len(smallest) and smallest[0] <= room:
                near = self.neighbours(seed, unused & (self.sizes <= room))
                for i in near.tolist():
                    if self.sizes[i] <= room:
                        room -= take(i)
                        if room < smallest[0]:
                            break
            while room:
                fits = np.flatnonzero(count[: room + 1])
                if not len(fits):
                    break
                stack = stacks[int(fits[-1])]
                while not unused[stack[-1]]:
                    stack.pop()
                room -= take(stack.pop())
            k += 1
        return container


_PACKED = "container_id bigint, doc_id bigint, piece int, n_tokens int, salt int, terms binary, tfs binary"


def _filled(capacity: int, idf: np.ndarray, good: float, turn: int):
    """Items of a shard (doc_id, salt, n_tokens, piece, terms, tfs) in containers. In containers that are not `good` full,
    items keep their terms, by which they may be packed again. turn: told apart in container_id."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        doc, n = t.column("doc_id").to_numpy(), t.column("n_tokens").to_numpy()
        order = np.lexsort((t.column("salt").to_numpy(), doc))
        t = t.take(pa.array(order)).combine_chunks()
        doc, n, salt, of = (t.column(c).to_numpy() for c in ("doc_id", "n_tokens", "salt", "piece"))
        bytes_of, counts_of = t.column("terms").combine_chunks(), t.column("tfs").combine_chunks()
        terms = [np.frombuffer(x, "<u4") for x in bytes_of.to_pylist()]
        tfs = [np.frombuffer(x, "<u2") for x in counts_of.to_pylist()]
        whole, rest = n // capacity, n % capacity
        left = np.flatnonzero(rest)
        shard = Shard(rest[left].astype(np.int64), [terms[i] for i in left], [tfs[i] for i in left], idf)
        packed = shard.fill(capacity)
        used = int(packed.max(initial=-1)) + 1
        poor = (np.bincount(packed, weights=rest[left], minlength=used) < good * capacity)[packed] if used else np.zeros(0, dtype=bool)
        piece = np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)
        full = np.repeat(np.arange(len(n)), whole)
        rows = np.concatenate([left, full])
        base = ((int(key[0].as_py() if hasattr(key[0], "as_py") else key[0]) << 1) + turn) << 32
        again = pa.array(np.where(np.concatenate([poor, np.zeros(len(full), dtype=bool)]), rows, -1))
        again = pc.if_else(pc.greater_equal(again, 0), again, None)
        return pa.table({
            "container_id": pa.array(base + np.concatenate([packed, used + np.arange(len(full))])),
            "doc_id": pa.array(doc[rows]),
            "piece": pa.array(np.concatenate([(of + whole)[left], piece]).astype(np.int32)),
            "n_tokens": pa.array(np.concatenate([rest[left], np.full(len(full), capacity)]).astype(np.int32)),
            "salt": pa.array(salt[rows]),
            "terms": bytes_of.take(again),
            "tfs": counts_of.take(again),
        })

    return run


def pack_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 1024, tokenizer: str = TOKENIZER, shard_items: int = 4096, common: float = 0.05, known: int = 8, good: float = 0.97) -> DataFrame:
    """(container_id, doc_id, piece, n_tokens): every text with tokens, assigned to a container of `capacity` tokens.

    A text longer than a container is cut into whole containers and a rest (`piece` counts from 0); no other is divided.
    Rows are items: a repeated row is packed again. Rows with a NULL key, and NULL and empty texts, which need no room, are
    left out. Other columns are ignored; an empty table gives an empty result.

    Items are spread by content over shards of about `shard_items`, which bounds a task whatever the data: by the term that
    says most in a text among those that stand in `known` texts at least (of two, else), since texts on one matter share it; terms
    fill shards in turn, and one of more items than a shard takes is divided by the next such term. Each shard builds an
    inverted index of its items; each seed's best BM25 neighbours not yet used fill its container. What lies in containers that
    are not `good` full is packed once more, in shards by hash, where sizes are more mixed. The terms are the
    tokenizer's tokens. Their document frequencies are counted over all texts; they are at most as many as the vocabulary
    has entries, so that they can be sent to all shards. Tokens in more than `common` of all texts carry no weight.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text <> ''")
    kept = scratch.keep(base.mapInArrow(_tokenised(tokenizer, capacity), "doc_id bigint, salt int, n_tokens bigint, terms binary, tfs binary"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, t, f in zip(*(b.column(c).to_pylist() for c in range(3))):
                t, f = np.frombuffer(t, "<u4").astype(np.int64), np.frombuffer(f, "<u8").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(t, -1)), pa.array(np.append(f, n))], names=["term", "n"])

    partial = kept.where("doc_id is null").select("n_tokens", "terms", "tfs")
    counts = partial.mapInArrow(spread, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(vocabulary(tokenizer), dtype=np.float64)
    texts = int(counts.loc[counts.term < 0, "n"].sum())
    real = counts[counts.term >= 0]
    df[real.term.to_numpy()] = real.n.to_numpy()
    idf = np.where((df > 0) & (df <= max(common * texts, 1)), np.log1p((texts - df + 0.5) / (df + 0.5)), 0.0).astype(np.float32)
    told = np.where(df >= known, idf, 0.0), np.where(df >= 2, idf, 0.0)

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leads = [_leads(np.frombuffer(t, "<u4"), np.frombuffer(f, "<u2"), told) for t, f in zip(b.column("terms").to_pylist(), b.column("tfs").to_pylist())]
            one, two = (pa.array([x[k] for x in leads], pa.int32()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, one, two], names=[*b.schema.names, "lead", "next"])

    items = kept.where("doc_id is not null").mapInArrow(led, "doc_id bigint, salt int, n_tokens bigint, terms binary, tfs binary, lead int, next int")
    items = scratch.keep(items)
    # At most as many terms as the vocabulary has: which shard each begins in, and how many it takes.
    n = items.groupBy("lead").agg(F.count("*").alias("n")).orderBy("lead").toPandas()
    parts = np.maximum(1, -(-n.n.to_numpy() // shard_items)).astype(np.int64)
    first, at, filled = np.zeros(len(n), dtype=np.int64), 0, 0
    for i, (size, of) in enumerate(zip(n.n.tolist(), parts.tolist())):
        if filled and filled + size > shard_items:
            at, filled = at + 1, 0
        first[i] = at
        if of > 1:
            at, filled = at + of, 0
        else:
            filled += size
    plan = F.broadcast(spark.createDataFrame(list(zip(n.lead.tolist(), first.tolist(), parts.tolist())), "lead int, first long, parts long"))
    # Texts without such a term are divided by their own hash.
    split = F.when((F.col("lead") < 0) | (F.col("next") < 0), F.xxhash64("doc_id", "salt")).otherwise(F.xxhash64("next"))
    columns = ["doc_id", "salt", "n_tokens", "piece", "terms", "tfs"]
    items = items.join(plan, "lead").withColumn("piece", F.lit(0)).select((F.col("first") + F.pmod(split, F.col("parts"))).alias("shard"), *columns)
    packed = scratch.keep(items.groupBy("shard").applyInArrow(_filled(capacity, idf, good, 0), _PACKED))
    poor = packed.where("terms is not null")
    shards = max(1, -(-poor.count() // shard_items))
    poor = poor.withColumn("n_tokens", F.col("n_tokens").cast("long")).select(F.pmod(F.xxhash64("doc_id", "salt"), F.lit(shards)).alias("shard"), *columns)
    packed = packed.where("terms is null").unionByName(poor.groupBy("shard").applyInArrow(_filled(capacity, idf, 0.0, 1), _PACKED))
    return packed.select("container_id", F.col("doc_id").alias(key), "piece", "n_tokens")


def _leads(terms: np.ndarray, tfs: np.ndarray, told: tuple[np.ndarray, ...]) -> tuple[int, int]:
    """The two terms that say most in a text, -1 where there is none."""
    for weight in told:
        w = weight[terms] * tfs / (tfs + 1.2)
        if len(w) and w.max() > 0:
            one = int(w.argmax())
            lead, w[one] = int(terms[one]), 0.0
            two = int(w.argmax())
            return lead, int(terms[two]) if w[two] > 0 else -1
    return -1, -1

"""Problem 10: long exact spans shared between records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kinweave.llm import recompress
from kinweave.runtime import Scratch, small_side

_PART = 250_000


def joined_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts with a separator before, between and after them, and where the separators stand."""
    one = "\0" + "\0".join(texts) + "\0"
    points = np.frombuffer(one.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.concatenate([[0], np.cumsum(np.array([len(t) for t in texts], dtype=np.int64) + 1)])


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of about `_PART` bytes of text, so that a worker's memory holds one such slice at a time."""
    for b in batches:
        ends = np.cumsum(pa.compute.binary_length(b.column(column)).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PART, "right")))
            part = b.slice(at, upto - at)
            yield part, part.column(column).to_pylist()
            at = upto


def _chosen_anchors(width: int, cap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        counts: dict[int, int] = {}
        for part, texts in _parts(batches, 1):
            points, breaks = joined_points(texts)
            key, at, p1, p2 = recompress.anchors(points, breaks, width)
            d = np.searchsorted(breaks, p1, "right") - 1
            off = breaks[d] + 1
            # Keys met `cap` times in this task are hot for sure; further rows of theirs needn't meet the others.
            keys, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
            many = n > 1
            hot = np.zeros(len(keys), dtype=bool)
            if len(counts):
                hot = np.isin(keys, np.fromiter((k for k, c in counts.items() if c >= cap), dtype=np.uint64))
            for k, c in zip(keys[many].tolist(), n[many].tolist()):
                counts[k] = counts.get(k, 0) + c
            if len(counts) > 200_000:
                counts = {k: c for k, c in counts.items() if c >= cap}
            ids = part.column(0).cast(pa.int64()).to_numpy()[d]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(ids), pa.array((at - off).astype(np.int32)), pa.array((p1 - off).astype(np.int32)), pa.array((p2 - off).astype(np.int32)), pa.array(hot[inverse])],
                names=["key", "doc_id", "at", "p1", "p2", "hot"],
            )

    return run


def _shared_classes(cap: int):
    """Rows of keys that two documents hold, from rows sorted by (hot, key, doc_id); hot rows pass, and so do the `cap` and
    more cold ones of a key, be they of one document, since others may have passed as hot."""
    names = ["key", "doc_id", "at", "p1", "p2", "hot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def settle(t: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table | None]:
            key, doc, hot = (t.column(c).to_numpy() for c in ("key", "doc_id", "hot"))
            n = len(key)
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (hot[1:] != hot[:-1])]))
            size = np.diff(np.append(starts, n))
            ends = starts + size - 1
            apart = doc[starts] != doc[ends]
            rest = None
            if not last:
                if not (hot[starts[-1]] or size[-1] >= cap):
                    rest = t.slice(int(starts[-1]))
                    starts, size, apart = starts[:-1], size[:-1], apart[:-1]
                    n -= rest.num_rows
            g = np.repeat(np.arange(len(starts)), size)
            hot = hot[:n] | (size >= cap)[g]
            take = np.flatnonzero(hot | apart[g])
            if not len(take):
                return None, rest
            out = t.slice(0, n).set_column(5, "hot", pa.array(hot)).take(pa.array(take))
            return out.combine_chunks().to_batches()[0], rest

        passed: int | None = None  # a hot key whose first rows were let through already
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.table(dict(zip(names, b.columns)))
            if passed is not None:
                more = (t.column("key").to_numpy() == passed) & ~t.column("hot").to_numpy()
                k = int(np.argmin(more)) if not more.all() else len(more)
                if k:
                    yield t.slice(0, k).set_column(5, "hot", pa.array(np.ones(k, dtype=bool))).combine_chunks().to_batches()[0]
                if k == len(more):
                    continue
                t, passed = t.slice(k), None
            if held is not None:
                t = pa.concat_tables([held, t]).combine_chunks()
            out, held = settle(t, False)
            if held is None and not t.column("hot")[-1].as_py():
                passed = t.column("key")[-1].as_py()
            if out is not None:
                yield out
        if held is not None:
            out, _ = settle(held, True)
            if out is not None:
                yield out

    return run


def _pieces(width: int):
    """The text around every candidate; for hot ones the fingerprints of each of its windows instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                doc, text = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                # A key may have several texts, and a place of one of them need not exist in the others.
                last = len(text) - width
                rows = [r | {"p2": min(r["p2"], last)} for r in b.column(2)[i].as_py() if r["p1"] <= last]
                cold = [r for r in rows if not r["hot"]]
                n = len(cold)
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["key"] for r in cold], pa.int64()), pa.nulls(n, pa.int64()), pa.array([doc] * n, pa.int64()), pa.array([r["p1"] for r in cold], pa.int32()), pa.array([r["p2"] for r in cold], pa.int32()), pa.array([text[r["p1"] : r["p2"] + width] for r in cold], pa.string())],
                        names=["key", "second", "doc_id", "p1", "p2", "piece"],
                    )
                if n < len(rows):
                    points, _ = joined_points([text])
                    h = recompress.Hashes(points)
                    p = np.unique(np.concatenate([np.arange(r["p1"], r["p2"] + 1) for r in rows if r["hot"]]))
                    for lo in range(0, len(p), 20_000):
                        q = p[lo : lo + 20_000]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(h.one(q + 1, q + 1 + width).view(np.int64)), pa.array(h.one(q + 1, q + 1 + width, 1).view(np.int64)), pa.array(np.full(len(q), doc)), pa.array(q.astype(np.int32)), pa.array(q.astype(np.int32)), pa.nulls(len(q), pa.string())],
                            names=["key", "second", "doc_id", "p1", "p2", "piece"],
                        )

    return run


def _matches(width: int):
    """Spans (doc_id, low, high) of windows that two documents hold, from pieces sorted by key."""

    def resolve(t: pa.Table) -> pa.RecordBatch | None:
        texts = t.column("piece").to_pylist()
        points, breaks = joined_points(texts)
        doc, p1, p2 = (t.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "p1", "p2"))
        size = p2 - p1 + 1
        row = np.repeat(np.arange(len(size)), size)
        step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        low = breaks[row] + 1 + step
        h = recompress.Hashes(points)
        a, b = h.one(low, low + width), h.one(low, low + width, 1)
        order = np.lexsort((b, a))
        first = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
        starts, d = np.flatnonzero(first), doc[row][order]
        apart = np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)
        shared = np.zeros(len(row), dtype=bool)
        shared[order] = apart[np.cumsum(first) - 1]
        at = np.flatnonzero(shared)
        if not len(at):
            return None
        new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (row[at][1:] != row[at][:-1])])
        s, e = at[new], at[np.concatenate([new[1:], [True]])]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[row[s]]), pa.array((p1[row[s]] + step[s]).astype(np.int32)), pa.array((p1[row[e]] + step[e] + width).astype(np.int32))], names=["doc_id", "low", "high"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            key = t.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))
            for lo, hi in _cuts(key[:cut], 1500):
                if (out := resolve(t.slice(lo, hi - lo))) is not None:
                    yield out
            held = t.slice(cut)
        if held is not None and held.num_rows and (out := resolve(held)) is not None:
            yield out

    return run


def _cuts(key: np.ndarray, about: int) -> Iterator[tuple[int, int]]:
    """Slices of about so many rows that don't divide a key."""
    lo = 0
    while lo < len(key):
        hi = min(lo + about, len(key))
        hi = int(np.searchsorted(key, key[hi - 1], "right"))
        yield lo, hi
        lo = hi


def united(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, span_start, span_end) from spans (key, low, high) that may overlap or touch."""
    w = Window.partitionBy(key).orderBy("low", "high")
    reach = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(reach.isNull() | (F.col("low") > reach), 1).otherwise(0))
    island = marked.withColumn("_island", F.sum("_new").over(w))
    return island.groupBy(key, "_island").agg(F.min("low").cast("int").alias("span_start"), F.max("high").cast("int").alias("span_end")).drop("_island")


def shared_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 200, cap: int = 512) -> DataFrame:
    """(doc_id, span_start, span_end): stretches of at least `width` characters that stand verbatim under another key too.

    Positions count code points, the end is exclusive; overlapping and touching runs are one row. Rows with a NULL key or
    text are left out, texts shorter than `width` share nothing, a stretch repeated under one key only isn't shared; a key
    with several texts has the spans of all. Other columns are ignored.

    1. Every text is named by recompression (recompress.py) where it lies; each window of `width` characters is stood for
       by one symbol whose context it holds, which makes about one anchor per 60 characters. Names depend on content only,
       so this round needs no exchange between workers.
    2. Anchors meet by key, (a name with its context), sorted; only those of two documents go on. A key met `cap` times
       within a task is known to be hot and its further rows go round the meeting.
    3. Only documents with such anchors are read again, and every candidate takes along the text of its windows.
    4. Within a key's rows all windows are compared by 128-bit fingerprints. Rows of hot keys (`cap` or more) are compared
       by an aggregation over windows that is combined before the shuffle: the exact way for what the cap holds back.
    Exact copies of one text are found by digest first: each is shared whole, and only one of them takes part from step 3 on.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "spans")
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where((F.char_length("text") >= width) & F.col("doc_id").isNotNull())
    prints = scratch.keep(base.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("m"), F.char_length("text").alias("n")).distinct())
    several = prints.groupBy("m", "n").agg(F.min("doc_id").alias("kept"), F.max("doc_id").alias("_other")).where("kept <> _other").drop("_other")
    copies = scratch.keep(prints.join(several, ["m", "n"]).select("doc_id", "n", (F.col("doc_id") != F.col("kept")).alias("spare")))

    shape = "key bigint, doc_id bigint, at int, p1 int, p2 int, hot boolean"
    met = base.mapInArrow(_chosen_anchors(width, cap), shape)
    met = met.repartition(F.when(F.col("hot"), F.xxhash64("doc_id", "p1")).otherwise(F.col("key"))).sortWithinPartitions("hot", "key", "doc_id")
    met = met.mapInArrow(_shared_classes(cap), shape)
    # A key takes no part only if all its texts are spare copies.
    texts = prints.groupBy("doc_id").agg(F.count("*").alias("_texts")).where("_texts > 1")
    spare = copies.where("spare").groupBy("doc_id").agg(F.count("*").alias("_spare")).join(texts, "doc_id", "left").where("_texts is null or _spare = _texts").select("doc_id")
    found = scratch.keep(met.join(small_side(spare), "doc_id", "left_anti"))

    ids = small_side(found.select("doc_id").distinct())
    per_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("key", "p1", "p2", "hot")).alias("rows"))
    again = base.join(ids, "doc_id", "left_semi").join(per_doc, "doc_id").select("doc_id", "text", "rows")
    pieces = scratch.keep(again.mapInArrow(_pieces(width), "key bigint, second bigint, doc_id bigint, p1 int, p2 int, piece string"))

    cold = pieces.where("piece is not null").select("key", "doc_id", "p1", "p2", "piece").repartition("key").sortWithinPartitions("key")
    spans = cold.mapInArrow(_matches(width), "doc_id bigint, low int, high int")
    windows = pieces.where("piece is null").select("key", "second", "doc_id", "p1")
    common = windows.groupBy("key", "second").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).where("_a <> _b").select("key", "second")
    hot = windows.join(common, ["key", "second"], "left_semi").select("doc_id", F.col("p1").alias("low"), (F.col("p1") + width).alias("high"))
    whole = copies.select("doc_id", F.lit(0).alias("low"), F.col("n").alias("high"))
    return united(spans.unionByName(hot).unionByName(whole)).withColumnRenamed("doc_id", key)

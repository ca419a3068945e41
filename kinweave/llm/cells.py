"""Cells: records of one spelling at one place, born about the same years, in different censuses.

Repeated records are most of a register, and one comparison serves all of a cell. A cell is one person in all likelihood;
where a spelling has several at one place in one census, its records are told apart by their very year of birth, and where
one year still has two in one census, each of its records is a cell.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kinweave.llm.names import words
from kinweave.runtime import Scratch, small_side

#: Years of birth of one person's records lie no further apart, unless rounded or gone.
NEAR = 2
#: Censuses that a set of censuses has bits for.
CENSUSES = 14
#: Spellings of the two sexes. Fixed values.
SEXES = {"karl": 1, "kk": 1, "kona": 2, "kvk": 2}
#: Columns that hold the parts of a name, in its order.
FIELDS = ("fornafn", "millinafn", "eftirnafn", "aettarnafn")
#: What blocks take of cells.
CELL = ["cell", "words", "spelt", "place", "parish", "sex", "lo", "hi", "met"]
_TYPED = "at bigint, born int, id bigint, bit int, person bigint, sex int, place bigint, spelt bigint, name string"
_CELLS = "cell bigint, words string, place bigint, sex int, lo int, hi int, met int, spelt bigint, person_lo bigint, person_hi bigint, ids array<bigint>, bits array<int>, persons array<bigint>"


def written(name: str) -> str:
    """A name in NFC and lower case with single spaces; empty where it is missing."""
    return "" if name in ("", "NaN") else " ".join(unicodedata.normalize("NFC", name).lower().split())


def full_names(df: DataFrame) -> DataFrame:
    """`df` with `nafn` put together from the fields of the name (those that df has) where it is missing."""
    there = lambda c: F.when((F.col(c) != "NaN") & F.col(c).rlike("[^\\s\u00a0]"), F.col(c))
    fields = [there(c) for c in FIELDS if c in df.columns]
    return df.withColumn("nafn", F.coalesce(there("nafn"), F.nullif(F.concat_ws(" ", *fields), F.lit("")))) if fields else df


def sex(value: Column) -> Column:
    v = F.lower(F.trim(value))
    out = F.lit(0)
    for text, code in SEXES.items():
        out = F.when(v == text, code).otherwise(out)
    return F.coalesce(out, F.lit(0))


def censuses_of(*tables: DataFrame) -> list[int]:
    """The censuses of the tables, ascending: bit k of a set of censuses is the k-th."""
    found = [t.select(F.col("manntal").cast("int").alias("c")).where("c between 1 and 4000").distinct() for t in tables]
    years = sorted({r["c"] for t in found for r in t.limit(1000).collect()})
    if len(years) > CENSUSES:
        raise ValueError(f"more than {CENSUSES} censuses")
    return years


def parishes(listed: DataFrame) -> DataFrame:
    """(place, parish): of each bi_baer the bi_sokn that most rows name, the least of equals; places without one are left out."""
    known = listed.select(F.col("bi_baer").cast("long").alias("place"), F.col("bi_sokn").cast("long").alias("parish")).where("place is not null and parish is not null")
    each = known.groupBy("place", "parish").agg(F.count("*").alias("n"))
    return each.groupBy("place").agg(F.min_by("parish", F.struct(-F.col("n"), "parish")).alias("parish"))


def mixed(x: np.ndarray) -> np.ndarray:
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (name, born, id, bit, person, sex, place): the hash of the spelling and, with that of the place, of the group."""
    from xxhash import xxh64_intdigest

    for b in batches:
        if not b.num_rows:
            continue
        names = b.column(0).dictionary_encode()
        plain = [written(x) for x in names.dictionary.to_pylist()]
        spelt = np.array([xxh64_intdigest(x) if x else 0 for x in plain], dtype=np.uint64).view(np.int64)
        there = np.array([x != "" for x in plain], dtype=bool)
        code = names.indices.to_numpy(zero_copy_only=False)
        spelt, there = spelt[code], there[code]
        place, ids = b.column(6), b.column(2).to_numpy(zero_copy_only=False)
        # Records without a place are not known to be at one.
        placed = ~place.is_null().to_numpy(zero_copy_only=False)
        at = spelt ^ mixed(np.where(placed, place.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ~ids))
        columns = [pa.array(at), b.column(1), b.column(2), b.column(3), b.column(4), b.column(5), place, pa.array(spelt), b.column(0)]
        # A record that comes again and again in a batch goes on once.
        if len(np.unique(ids)) < len(ids):
            columns_of = [at, *(b.column(c).to_numpy(zero_copy_only=False) for c in (1, 3, 4)), ids]
            order = np.lexsort(columns_of)
            there[order] &= changes(*[x[order] for x in columns_of])
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _TYPED.split(", ")]).filter(pa.array(there))


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any of the columns."""
    out = np.zeros(len(columns[0]), dtype=bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _joined(t: pa.Table, crowded: bool, goes_on: bool = False) -> pa.RecordBatch:
    """Cells of rows sorted by (at, born, id). crowded: the first part goes on from rows before that hold several persons;
    goes_on: the last part does so in rows after."""
    t = t.combine_chunks()
    at, born, ids, bit, person, sexes, spelt = (t.column(c).to_numpy().astype(np.int64) for c in ("at", "born", "id", "bit", "person", "sex", "spelt"))
    once = changes(at, born, ids, bit, spelt)
    if not once.all():
        t = t.filter(pa.array(once))
        at, born, ids, bit, person, sexes, spelt = (x[once] for x in (at, born, ids, bit, person, sexes, spelt))
    fresh = changes(at, spelt)
    cut = fresh.copy()
    cut[1:] |= (born[1:] - born[:-1] > NEAR) | ((born[:-1] == 0) & (born[1:] > 0))
    part = np.cumsum(cut) - 1
    start = np.flatnonzero(cut)
    flag = np.int64(1) << bit
    several = np.add.reduceat(np.ones(len(at), dtype=np.int64), start) > np.bitwise_count(np.bitwise_or.reduceat(flag, start))
    several[0] |= crowded
    several[-1] |= goes_on
    cut[1:] |= several[part][1:] & (born[1:] != born[:-1])
    start = np.flatnonzero(cut)
    n = np.diff(np.append(start, len(at)))
    cut |= np.repeat(n > np.bitwise_count(np.bitwise_or.reduceat(flag, start)), n)
    start = np.flatnonzero(cut)
    met = np.bitwise_or.reduceat(flag, start)
    low_sex, high_sex = np.minimum.reduceat(np.where(sexes > 0, sexes, 9), start), np.maximum.reduceat(sexes, start)
    low = np.minimum.reduceat(np.where(person != 0, person, np.iinfo(np.int64).max), start)
    high = np.maximum.reduceat(np.where(person != 0, person, np.iinfo(np.int64).min), start)
    known = high > np.iinfo(np.int64).min
    offsets = pa.array(np.append(start, len(at)).astype(np.int32))
    first = pa.array(start)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.minimum.reduceat(ids, start)), pa.array([words(x) for x in t.column("name").combine_chunks().take(first).to_pylist()], pa.string()), t.column("place").combine_chunks().take(first), pa.array(np.where(low_sex == high_sex, high_sex, 0).astype(np.int32)),
            pa.array(born[start].astype(np.int32)), pa.array(np.maximum.reduceat(born, start).astype(np.int32)), pa.array(met.astype(np.int32)), pa.array(spelt[start]),
            pa.array(np.where(known, low, 0)), pa.array(np.where(known, high, 0)), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(bit.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(person)),
        ],
        names=[x.split()[0] for x in _CELLS.split(", ")],
    )


def _grouped(rows: int = 100_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        crowded = False
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < rows:
                continue
            at = held.column("at").to_numpy()
            whole = int(np.searchsorted(at, at[-1], "left"))
            if whole:
                yield _joined(held.slice(0, whole), crowded)
                held, crowded = held.slice(whole), False
            if held.num_rows >= 2 * rows:
                # One large group goes on by parts, and a part that holds several persons by years of birth.
                born, ids, bit = (held.column(c).to_numpy().astype(np.int64) for c in ("born", "id", "bit"))
                part = int(np.flatnonzero(np.concatenate([[True], (born[1:] - born[:-1] > NEAR) | ((born[:-1] == 0) & (born[1:] > 0))]))[-1])
                several = (crowded and part == 0) or len(np.unique(ids[part:])) > len(np.unique(bit[part:]))
                year = int(np.searchsorted(born, born[-1], "left"))
                if several and year:
                    yield _joined(held.slice(0, year), crowded, year > part)
                    held, crowded = held.slice(year), True if year > part else crowded and part == 0
                elif part:
                    yield _joined(held.slice(0, part), crowded)
                    held, crowded = held.slice(part), False
        if held is not None and held.num_rows:
            yield _joined(held, crowded)

    return run


def cells(df: DataFrame, censuses: list[int], person: Column, scratch: Scratch, at: DataFrame | None = None) -> DataFrame:
    """Cells of records (id, manntal, nafn, faedingarar, kyn, bi_baer), written to the shared folder.

    cell (the least id), words (folded tokens of the name), place, parish (by `at`: place, parish; NULL if not known), sex (0 unknown, 1, 2),
    lo and hi (years of birth, 0 unknown), met (bits of the censuses), spelt (hash of the spelling), person_lo and
    person_hi (least and largest known person), and of the records ids, bits (each one's census) and persons (0 unknown).
    Records without id, census or name are in no cell; repeated ones count once; missing and impossible years are unknown
    and form cells of their own.
    """
    birth = F.when(F.col("faedingarar").between(1000, 2200), F.col("faedingarar").cast("int"))
    bit = (F.array_position(F.array(*[F.lit(c) for c in censuses or [0]]), F.col("manntal").cast("int")) - 1).cast("int")
    rows = df.select(
        F.col("nafn").alias("name"), F.coalesce(birth, F.lit(0)).alias("born"), F.col("id").cast("long").alias("id"), bit.alias("bit"), F.coalesce(person, F.lit(0)).cast("long").alias("person"),
        sex(F.col("kyn")).alias("sex"), F.col("bi_baer").cast("long").alias("place"),
    ).where("id is not null and bit >= 0 and name is not null")
    rows = rows.mapInArrow(_typed, _TYPED).repartition("at").sortWithinPartitions("at", "born", "id")
    made = rows.mapInArrow(_grouped(), _CELLS)
    made = made.withColumn("parish", F.lit(None).cast("long")) if at is None else made.join(small_side(at), "place", "left")
    return scratch.keep(made)


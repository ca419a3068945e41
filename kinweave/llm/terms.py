"""Problem 2: how often every distinct term occurs, and in how many records."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: White space as Unicode has it, the four separators that Python also counts, and the comma.
SEPARATORS = r"[\p{IsWhite_Space}\x1c-\x1f,]+"
#: Below U+0300 nothing composes, so a text of such characters is in NFC already.
_PLAIN = r"^[\x{0}-\x{2ff}]*$"


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def nfc(value: Column) -> Column:
    """Unicode NFC; only texts with a character from U+0300 on reach Python."""
    return F.coalesce(F.when(value.rlike(_PLAIN), value), _nfc(F.when(~value.rlike(_PLAIN), value)))


def terms_of(value: Column) -> Column:
    """Terms of a value in NFC and lower case; NULL, the empty text and exactly `NaN` have none."""
    return F.when(value.isNull() | value.isin("", "NaN"), F.array().cast("array<string>")).otherwise(F.filter(F.split(F.lower(value), SEPARATORS), lambda t: t != ""))


def term_frequencies(rows: DataFrame, fields: list[str], key: str = "id", rare: int = 2, common_percent: int = 1) -> DataFrame:
    """(field, term, n_occur, n_records, mark) for every term of every field.

    n_occur counts occurrences over all rows, n_records distinct non-NULL keys. `rare`: n_records <= rare; `common`:
    n_records is over common_percent percent of the table's distinct keys; else `usable`. Rows of a NULL key count as
    occurrences only. Counts of one record are combined by hash on the map side, so a repeated record, a hot key or a hot
    term sends one row per map task; the second step shuffles only partial sums per term.
    """
    named = rows.select(F.col(key).alias("_key"), *[nfc(F.col(f)).alias(f"_f{i}") for i, f in enumerate(fields)])

    def tagged(i: int, f: str) -> Column:
        return F.transform(terms_of(F.col(f"_f{i}")), lambda t: F.struct(F.lit(f).alias("field"), t.alias("term")))

    pairs = F.concat(*[tagged(i, f) for i, f in enumerate(fields)])
    each = named.select("_key", F.explode(pairs).alias("t")).select("_key", "t.field", "t.term")
    per_record = each.groupBy("field", "term", "_key").agg(F.count("*").alias("n"))
    summed = per_record.groupBy("field", "term").agg(F.sum("n").alias("n_occur"), F.count("_key").alias("n_records"))
    total = rows.select(F.col(key).alias("_key")).where("_key is not null").distinct().agg(F.count("*").alias("_all"))
    mark = F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") * 100 > F.col("_all") * common_percent, "common").otherwise("usable")
    return summed.crossJoin(F.broadcast(total)).select("field", "term", "n_occur", "n_records", mark.alias("mark"))

"""Column functions that compare two records of a person; null policies are those of each comparison."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

NAMES = ("nafn", "fornafn", "millinafn", "eftirnafn", "aettarnafn")


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over code points; NULL counts as the empty text."""
    return F.levenshtein(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def edits_within(a: Column, b: Column, most: int) -> Column:
    """Whether the distance is at most `most`; the bounded form stops early."""
    return F.levenshtein(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")), most) >= 0


def name_distance(a: str, b: str, columns: Sequence[str] = NAMES) -> Column:
    """Sum of the edit distances of the name columns of rows aliased a and b."""
    out = F.lit(0)
    for c in columns:
        out = out + edit_distance(F.col(f"{a}.{c}"), F.col(f"{b}.{c}"))
    return out


def age_distance(a: str, b: str) -> Column:
    return F.abs(F.col(f"{a}.faedingarar") - F.col(f"{b}.faedingarar"))


def same_or_both_missing(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def location_distance(a: str, b: str, units: Sequence[str] = ("bi_baer", "bi_sokn", "bi_hreppur", "bi_sysla"), step: int = 5) -> Column:
    """0 in one farm, then a step more for each higher unit until one agrees; two missing units agree."""
    out = F.lit(step * len(units))
    for k in range(len(units) - 1, -1, -1):
        out = F.when(F.col(f"{a}.{units[k]}").eqNullSafe(F.col(f"{b}.{units[k]}")), step * k).otherwise(out)
    return out


@dataclass(frozen=True)
class Marital:
    """Codes of never married, once married and married. Fixed values."""

    never: str = "Ó"
    once: tuple[str, ...] = ("S", "L", "E")
    married: str = "G"


def marital_distance(a: str, b: str, codes: Marital = Marital()) -> Column:
    """10 where the later record says never married and the other something else; 5 from once married to once or now
    married; 0 for equal codes and records of one census. A missing code equals none, but fits no code either."""
    ma, mb = F.col(f"{a}.hjuskapur"), F.col(f"{b}.hjuskapur")
    ya, yb = F.col(f"{a}.manntal"), F.col(f"{b}.manntal")
    earlier, later = F.when(ya < yb, ma).otherwise(mb), F.when(ya < yb, mb).otherwise(ma)
    after = (*codes.once, codes.married)
    cost = F.when(later == codes.never, 10).when(earlier.isin(*codes.once) & later.isin(*after), 5).otherwise(0)
    return F.when((ma == mb) | (ya == yb), 0).otherwise(cost)


def euclidean(a: Column, b: Column, eps: float = 0.0) -> Column:
    """Distance of two arrays of numbers; eps is added to each difference."""
    parts = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double") + F.lit(eps), 2))
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))


def contrastive_loss(distance: Column, label: Column, margin: float = 1.0, same_is: int = 0) -> Column:
    """Squared distance for pairs labelled `same_is`, squared shortfall to the margin for the others."""
    short = F.pow(F.greatest(F.lit(0.0), F.lit(margin) - distance), 2)
    return F.when(label == same_is, F.pow(distance, 2)).otherwise(short)


def argmax(v: Column) -> Column:
    """0-based place of the largest entry, the first of equal ones."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def pair_vector(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def clean_name(name: Column) -> Column:
    """Only Icelandic and Latin letters and spaces stay."""
    return F.regexp_replace(name, "[^a-zA-ZáéíóúýðæöþÁÉÍÓÚÝÐÆÖÞ ]", "")


def words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def ids_text(ids: Column) -> Column:
    return F.concat_ws(",", F.transform(F.array_sort(ids), lambda x: x.cast("string")))


def half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def width_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Histogram bin from 0; the largest value falls into the last bin."""
    return F.when(high == low, 0).otherwise(F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1))).cast("int")

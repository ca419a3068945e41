"""Truth values with frequency and confidence, and statements about pairs of records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

#: Bounds of a confidence. Fixed values.
LOW, HIGH = 0.01, 0.99


@dataclass(frozen=True)
class Truth:
    """A truth value as two columns; the confidence is kept within bounds."""

    f: Column
    c: Column

    @staticmethod
    def of(f: Column, c: Column) -> "Truth":
        return Truth(f, F.least(F.greatest(c, F.lit(LOW)), F.lit(HIGH)))

    def weight(self) -> Column:
        return self.c / (1 - self.c)

    def expectation(self) -> Column:
        return self.c * (self.f - 0.5) + 0.5

    def revised(self, other: "Truth") -> "Truth":
        """Both bodies of evidence together: their weights add up."""
        pro = self.f * self.weight() + other.f * other.weight()
        total = self.weight() + other.weight()
        return Truth.of(pro / total, total / (total + 1))


def statements(a: str, b: str) -> Column:
    """Sorted distinct statements about rows aliased a and b. A comparison with a missing side says nothing; of positions
    each side that is there is stated."""

    def both(c: str, same: str, other: str) -> Column:
        x, y = F.col(f"{a}.{c}"), F.col(f"{b}.{c}")
        return F.when(x.isNotNull() & y.isNotNull(), F.when(x == y, same).otherwise(other))

    def stated(c: str, side: str) -> Column:
        return F.concat(F.lit(f"{c}_is_"), F.col(f"{side}.{c}").cast("string"))

    # The wording of the statements: fixed values.
    years = F.abs(F.col(f"{a}.manntal").cast("double") - F.col(f"{b}.manntal").cast("double"))
    said = F.array(
        F.concat(F.lit("differ_in_"), years.cast("string"), F.lit("_years")),
        both("nafn", "same_name", "different_name"), both("fornafn", "same_first_name", "different_first_name"),
        both("eftirnafn", "same_last_name", "different_last_name"), both("faedingarar", "same_birth_year", "different_birth_year"),
        both("kyn", "same_gender", "different_gender"), stated("stada", a), stated("stada", b),
        both("hjuskapur", "same_marital_status", "different_marital_status"), both("bi_baer", "same_residence_ID", "different_residence_ID"),
        stated("cleaned_status", a), stated("cleaned_status", b),
    )
    return F.array_sort(F.array_distinct(F.filter(said, lambda s: s.isNotNull())))


def same_person(a: str, b: str) -> Column:
    return F.coalesce(F.col(f"{a}.bi_einstaklingur") == F.col(f"{b}.bi_einstaklingur"), F.lit(False))


def pattern_likeness(mine: Column, theirs: Column) -> Column:
    """Shared statements against the longer of the two sets."""
    return F.size(F.array_intersect(mine, theirs)) / F.greatest(F.size(mine), F.size(theirs), F.lit(1))


def longer_expectation(mine: Column, my_e: Column, theirs: Column, their_e: Column) -> Column:
    """The expectation of the longer pattern, the larger one of equally long ones."""
    n, m = F.size(mine), F.size(theirs)
    return F.when(n > m, my_e).when(n < m, their_e).otherwise(F.greatest(my_e, their_e))

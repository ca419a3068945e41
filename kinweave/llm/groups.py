"""Problem 1: pairwise matches of sampling runs, consolidated into groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinweave.llm.components import propagate_labels


def listed_positions(text: str) -> "F.Column":
    """Positions held by a list written in any notation, e.g. `[1, 2]`, `[ 1  2]`, `1;2`, `array([1])`, `{1.0}`.

    NULL, empty lists and texts without digits give an empty array; a fraction `.0` belongs to its number.
    """
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?<![\d.\-])(\d{1,18})(?:\.0*)?(?![\d.]*\d)"), F.lit(1)), lambda x: x.cast("long")))


def matched_ids(rows: DataFrame) -> DataFrame:
    """Edges (a, b) between ids, from each row's list of positions in its run.

    rows has id, run_no, row_pos, ensemble_classification; other columns are ignored. Repeated rows count once; a position
    that no row of the run holds, a NULL run or NULL id links nothing.
    """
    r = rows.select("id", "run_no", F.col("row_pos").cast("long").alias("row_pos"), "ensemble_classification").where("id is not null and run_no is not null")
    held = r.where("row_pos is not null").select(F.col("id").alias("b"), "run_no", F.col("row_pos").alias("pos")).distinct()
    listed = r.select(F.col("id").alias("a"), "run_no", F.explode(listed_positions("ensemble_classification")).alias("pos")).distinct()
    return listed.join(held, ["run_no", "pos"]).where("a <> b").select("a", "b")


def match_groups(rows: DataFrame) -> DataFrame:
    """(id, group_id): every distinct non-NULL id with the smallest id it is linked to, directly or through others.

    An unlinked id is its own group. An empty table gives an empty result.
    """
    found = propagate_labels(matched_ids(rows)).select(F.col("node").alias("id"), F.col("component").alias("group_id"))
    ids = rows.select("id").where("id is not null").distinct()
    return ids.join(found, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))

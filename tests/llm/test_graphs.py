import random

import pytest
from pyspark.sql import functions as F

from kinweave.llm.components import large_small_star, propagate_labels
from kinweave.llm.groups import match_groups
from kinweave.llm.splits import grouped_splits


def united(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


GRAPHS = {
    "random": [(r.randrange(300), r.randrange(300)) for r in [random.Random(1)] for _ in range(260)],
    "chain": [(i, i + 1) for i in range(70)],
    "zigzag": [((i * 37) % 101, ((i + 1) * 37) % 101) for i in range(100)],
    "hub": [(0, i) for i in range(1, 300)] + [(i, i + 300) for i in range(1, 100)],
    "dirty": [(1, 1), (None, 2), (3, None), (5, 6), (5, 6), (6, 5), (-4, 6)],
}


@pytest.mark.parametrize("name", GRAPHS)
@pytest.mark.parametrize("way", [propagate_labels, large_small_star])
def test_components(spark, name, way):
    df = spark.createDataFrame(GRAPHS[name], "a long, b long")
    assert {r["node"]: r["component"] for r in way(df).collect()} == united(GRAPHS[name])


@pytest.mark.parametrize("way", [propagate_labels, large_small_star])
def test_no_edges(spark, way):
    assert way(spark.createDataFrame([], "a long, b long")).count() == 0


def test_match_groups(spark, rows):
    data = [
        (10, 1, 0, "[1, 9]"), (20, 1, 1, None), (30, 1, 2, "[ 1  0]"), (30, 1, 2, "[ 1  0]"), (40, 2, 0, "1.0"), (20, 2, 1, "NaN"), (50, 2, 2, ""), (60, 3, 0, "array([0])"), (70, 3, 1, "{-1}"), (80, 3, 2, "3;4"),
        (90, 3, 3, "[]"), (100, 3, 4, "[]"), (None, 3, 5, "[1]"), (110, None, 1, "[0]"), (120, 4, 0, "[5.0, 5]"),
    ]
    df = spark.createDataFrame([(*x, "g", 1.0) for x in data], "id long, run_no long, row_pos int, ensemble_classification string, group_id string, pca_0 double")
    want = {10: 10, 20: 10, 30: 10, 40: 10, 50: 50, 60: 60, 70: 70, 80: 80, 90: 80, 100: 80, 110: 110, 120: 120}
    assert dict(rows(match_groups(df))) == want
    assert match_groups(df.limit(0)).count() == 0


def test_splits(spark):
    r = random.Random(2)
    data = [(r.randrange(3000), r.choice([None, r.randrange(2000)]), "x", "y") for _ in range(6000)] + [(None, 5, "x", "y"), (None, None, "x", "y")]
    df = spark.createDataFrame(data, "id long, person long, split string, note string")
    got = grouped_splits(df, ["id", "person"])
    held = got.collect()
    assert len(held) == len(data) and {x["split"] for x in held} == {"train", "validation", "test"}
    for k in ("id", "person"):
        assert got.where(f"{k} is not null").groupBy(k).agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    same = united([(f"i{a}", f"p{b}") for a, b, *_ in data if a is not None and b is not None])
    by = {}
    for x in held:
        if x["id"] is not None and x["person"] is not None:
            by.setdefault(same[f"i{x['id']}"], set()).add(x["component"])
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_splits_with_a_giant_component_and_shares(spark):
    data = [(i, 1 if i < 4000 else i) for i in range(12_000)]
    df = spark.createDataFrame(data, "id long, person long")
    n = {x["split"]: x["count"] for x in grouped_splits(df, ["id", "person"]).groupBy("split").count().collect()}
    assert abs(n["train"] / 12_000 - 0.8) < 0.02 and abs(n["test"] / 12_000 - 0.1) < 0.02
    assert grouped_splits(df.limit(0), ["id", "person"]).count() == 0
    three = spark.createDataFrame([(1, None, 7), (2, 5, 7), (3, 5, None), (4, None, None)], "id long, p long, q long")
    got = {x["id"]: x["component"] for x in grouped_splits(three, ["id", "p", "q"]).collect()}
    assert got[1] == got[2] == got[3] != got[4]

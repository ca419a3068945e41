import random

import pytest
from pyspark.sql import functions as F

from kinweave.functions import compare as cmp, evidence as ev
from kinweave.operators import linkage, prepare
from kinweave.sources.tables import LOOKUP, RECORD, literal_records, read_csv, write_csv

TWO = [
    "470497,1880,Helga Jónsdóttir,Helga,,Jónsdóttir,,1833.0,Kona,kona hans,G,4,4781,320,385,14,Eiginkona,0.31065989847715736,10,0.0",
    "497208,1890,Helga Jónsdóttir,Helga,,Jónsdóttir,,1833.0,Kona,húsmóðir,E,4,4784,320,385,14,Heimavinnandi,0.31065989847715736,11,0.0",
]


@pytest.fixture(scope="module")
def pair(spark):
    r = literal_records(spark, TWO, RECORD)
    return r.where("manntal = 1880").alias("a").crossJoin(r.where("manntal = 1890").alias("b"))


def test_terms_of_a_known_pair(pair):
    got = pair.select(cmp.name_distance("a", "b"), cmp.age_distance("a", "b"), cmp.location_distance("a", "b"), cmp.marital_distance("a", "b")).first()
    assert tuple(got) == (0, 0.0, 5, 0)


def test_statements_of_a_known_pair(pair):
    said = pair.select(ev.statements("a", "b"), ev.same_person("a", "b")).first()
    assert set(said[0]) == {
        "differ_in_10.0_years", "same_name", "same_first_name", "same_last_name", "same_birth_year", "same_gender", "stada_is_kona hans", "stada_is_húsmóðir", "different_marital_status",
        "different_residence_ID", "cleaned_status_is_Eiginkona", "cleaned_status_is_Heimavinnandi",
    } and said[1]


def test_truth(spark):
    one, two = ev.Truth.of(F.lit(1.0), F.lit(0.9)), ev.Truth.of(F.lit(0.0), F.lit(0.9))
    r = one.revised(two)
    got = spark.range(1).select(one.expectation(), two.expectation(), r.f, r.c, r.expectation()).first()
    assert [round(x, 9) for x in got] == [0.95, 0.05, 0.5, round(18 / 19, 9), 0.5]


@pytest.mark.parametrize(
    ("years", "codes", "cost"),
    [((1835, 1840), ("G", "Ó"), 10), ((1840, 1835), ("Ó", "G"), 10), ((1835, 1840), ("S", "G"), 5), ((1835, 1840), ("Ó", "G"), 0), ((1835, 1835), ("G", "Ó"), 0), ((1835, 1840), (None, "Ó"), 10), ((1835, 1840), ("G", None), 0), ((1835, 1840), (None, None), 0)],
)
def test_marital_distance(spark, years, codes, cost):
    a, b = (spark.createDataFrame([(y, c)], "manntal int, hjuskapur string").alias(n) for n, y, c in zip("ab", years, codes))
    assert a.crossJoin(b).select(cmp.marital_distance("a", "b")).first()[0] == cost


def test_location_with_missing_units(spark):
    s = "bi_baer long, bi_sokn long, bi_hreppur long, bi_sysla long"
    for x, y, d in (((None,) * 4, (None,) * 4, 0), ((1, None, 1, 1), (2, None, 2, 2), 5), ((1, 1, 1, 1), (2, 2, 1, 1), 10), ((1, 1, 1, 1), (2, 2, 2, 1), 15), ((1, 1, 1, 1), (None, 2, 2, 2), 20)):
        a, b = spark.createDataFrame([x], s).alias("a"), spark.createDataFrame([y], s).alias("b")
        assert a.crossJoin(b).select(cmp.location_distance("a", "b")).first()[0] == d


def test_candidates_against_all_pairs(spark, rows):
    r = random.Random(1)
    data = [(i, r.choice(["K", "L", None]), float(r.randrange(1800, 1812)) if r.random() < 0.9 else None) for i in range(60)]
    df = spark.createDataFrame(data, "id long, kyn string, faedingarar double")
    got = rows(linkage.candidates(df).select("seed.id", "match.id"))
    want = sorted(((a[0], b[0]) for a in data for b in data if a[1] and a[1] == b[1] and a[2] and b[2] and abs(a[2] - b[2]) <= 2), key=repr)
    assert got == want


def test_assignments_against_loops(spark):
    for seed in range(3):
        r = random.Random(seed)
        n = 40
        edges = {(s, m): float(r.randrange(10)) for s in range(n) for m in range(n) if r.random() < 0.06 or s == m and r.random() < 0.8}
        df = spark.createDataFrame([(s, m, x) for (s, m), x in edges.items()], "seed_id long, match_id long, score double")
        first, cover = {}, {}
        for (s, m), x in sorted(edges.items()):
            first.setdefault(m, (s, x))
        for s in range(n):
            if s in cover:
                continue
            for m in range(n):
                if (s, m) in edges and m not in cover:
                    cover[m] = (s, edges[s, m])
        assert {q[0]: (q[1], q[2]) for q in linkage.first_seed(df).collect()} == first
        assert {q[0]: (q[1], q[2]) for q in linkage.greedy_cover(df).collect()} == cover


def test_accept_rule(spark):
    df = spark.createDataFrame([(1, 0.5, 1, 1835, 0.0), (1, 0.5, 2, 1840, 4.0), (1, 0.5, 3, 1840, 9.0), (1, 0.5, 4, 1845, 6.0), (2, 0.0, 2, 1840, 0.0)], "seed_id long, seed_u double, match_id long, manntal int, score double")
    assert sorted(r["match_id"] for r in linkage.accepted(df).collect()) == [1, 2, 3]


def test_prepare(spark, rows):
    df = spark.createDataFrame([(i, i % 3 if i % 5 else None, 40_000 * (i % 2)) for i in range(50)], "id long, v long, w long")
    assert dict(prepare.narrowed(df, ["v", "w"]).dtypes) == {"id": "bigint", "v": "smallint", "w": "int"}
    assert dict(prepare.narrowed(df.limit(0), ["v"]).dtypes)["v"] == "bigint"
    assert rows(prepare.row_positions(df.select("id"), ["id"])) == [(i, i) for i in sorted(range(50), key=lambda i: repr((i, i)))]
    u = prepare.with_uniqueness(spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "n string"), ["n"])
    assert {(r["n"], r["uniqueness_score"]) for r in u.collect()} == {("a", 0.0), ("b", 1.0), (None, 1.0)}
    flat = prepare.with_uniqueness(spark.createDataFrame([("a",), ("b",)], "n string"), ["n"])
    assert {r["uniqueness_score"] for r in flat.collect()} == {None}
    look = spark.createDataFrame([(2, 1, 1835, 9, 9, 9), (1, 1, 1835, 5, 6, 7), (3, None, 1835, 1, 1, 1)], "id long, bi_baer long, manntal int, bi_hreppur long, bi_sokn long, bi_sysla long")
    rec = spark.createDataFrame([(10, 1, 1835), (11, None, 1835), (12, 4, 1835)], "id long, bi_baer long, manntal int")
    assert rows(prepare.with_location(rec, look).select("id", "bi_hreppur")) == [(10, 5), (11, 1), (12, None)]


def test_csv_round_trip(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text("bi_baer;manntal;bi_hreppur;bi_sokn;bi_sysla\n1.0;1835;;NaN;4\n2;1840;5\n3;1845;x;6;7\n")
    got = read_csv(spark, str(tmp_path / "a.csv"), LOOKUP, ";")
    assert rows(got) == [(1, 1835, None, None, 4), (3, 1845, None, 6, 7)]
    write_csv(got.withColumn("l", F.array("bi_baer")), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2


def test_close_values_against_all_pairs(spark, rows):
    r = random.Random(4)
    words = sorted({"".join(r.choice("abð") for _ in range(r.randrange(0, 9))) for _ in range(150)} | {"", "x" * 3000, "x" * 2999 + "y"})
    df = spark.createDataFrame([(w,) for w in words], "v string")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row = following(row, i, c, b)
        return row[-1]

    def following(prev, i, c, b):
        cur = [i]
        for j, d in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != d)))
        return cur

    short = [w for w in words if len(w) < 100]
    for most in (1, 2):
        want = {(a, b) for a in short for b in short if edits(a, b) <= most} | {(a, b) for a in words for b in words if len(a) == len(b) == 3000}
        assert {tuple(x) for x in rows(linkage.close_values(df, most))} == want
    assert linkage.close_values(df.limit(0), 2).count() == 0


def test_capped_candidates_are_those_within_the_caps(spark, rows):
    r = random.Random(6)
    data = [(i, r.choice(["K", "L", None]), r.choice([None, 1800.0 + r.randrange(8) + r.choice([0, 0.5])]), r.choice(["Jon", "Jons", "Jan", "Anna", "Ana", "", None, "J"]), r.choice(["Ab", None]), r.choice(["Olafsson", "Olafson", "Petursson"])) for i in range(80)]
    df = spark.createDataFrame(data, "id long, kyn string, faedingarar double, fornafn string, millinafn string, eftirnafn string")
    ids = lambda p: rows(p.select("seed.id", "match.id"))
    assert ids(linkage.capped_candidates(df)) == ids(linkage.within_caps(linkage.candidates(df)))
    assert ids(linkage.capped_candidates(df, df.where("id < 9"))) == ids(linkage.within_caps(linkage.candidates(df, df.where("id < 9"))))
    n = {x["seed"]: x["n"] for x in linkage.candidates(df).groupBy(F.col("seed.id").alias("seed")).agg(F.count("*").alias("n")).collect()}
    assert {x["id"]: x["n_candidates"] for x in linkage.candidate_counts(df).collect()} == n


def test_counts_within_the_caps_by_groups(spark):
    r = random.Random(7)
    data = [(i, r.choice(["K", "L", None]), r.choice([None, 1800.0 + r.randrange(6)]), r.choice(["Jon", "Jons", "Anna", "", None]), r.choice(["Ab", None]), r.choice(["Olafsson", "Petursson"])) for i in range(150)]
    df = spark.createDataFrame(data, "id long, kyn string, faedingarar double, fornafn string, millinafn string, eftirnafn string")
    n = {x["id"]: x["n"] for x in linkage.within_caps(linkage.candidates(df)).groupBy(F.col("seed.id").alias("id")).agg(F.count("*").alias("n")).collect()}
    assert {x["id"]: x["n_candidates"] for x in linkage.capped_counts(df).collect()} == n
    # No row of pairs: half a million records of one name are counted as one.
    many = spark.range(500_000).selectExpr("id", "'K' AS kyn", "1800.0D AS faedingarar", "'Jon' AS fornafn", "'' AS millinafn", "'Olafsson' AS eftirnafn")
    assert linkage.capped_counts(many).agg(F.sum("n_candidates")).first()[0] == 500_000**2


LINKED = "id long, kyn string, faedingarar double, manntal int, nafn string, fornafn string, millinafn string, eftirnafn string, aettarnafn string, hjuskapur string, stada_group string, bi_baer long, bi_sokn long, bi_hreppur long, bi_sysla long, uniqueness_score double"


def people(r, n):
    out = []
    for i in range(n):
        f, e, farm = r.choice(["Jon", "Jons", "Anna", "Ana", None]), r.choice(["Olafsson", "Olafson", "Petursson"]), r.choice([1, 2, 3, 4, 5, 6, None])
        units = (farm, *((farm // 2, farm // 3, farm // 6) if farm and r.random() < 0.9 else (r.choice([1, None]),) * 3))
        out.append((i, r.choice("KKKL"), r.choice([None, 1800.0 + r.randrange(12) + r.choice([0, 0, 0.5])]), r.choice([1835, 1840]), f"{f} {e}", f, r.choice(["", None]), e, "", r.choice(["\u00d3", "G", None]), r.choice("ab"), *units, {"Jon": 0.3, "Anna": 0.9, None: None}.get(f, 1.0)))
    return out


@pytest.mark.parametrize("least", [0.5, -4.95, -12.0])
def test_linkage_by_blocks_is_that_of_all_pairs(spark, rows, monkeypatch, least):
    """Blocks of units, large ones by names, and one record for all that are alike give what all pairs give."""
    names = ["nafn", "fornafn", "millinafn", "eftirnafn", "aettarnafn"]
    data = people(random.Random(8), 120)
    df = spark.createDataFrame(data + [(x[0] + 1000, *x[1:]) for x in data[::3]] + [(x[0] + 2000, *x[1:]) for x in data[::6]], LINKED).cache()
    moves = spark.createDataFrame([("a", "a", least), ("a", "b", 1.0)], "from_group string, to_group string, score double")
    want = linkage.accepted(linkage.scored(linkage.capped_candidates(df), moves, names))
    for large in (400, 3):
        monkeypatch.setattr(linkage, "LARGE", large)
        for mode in ("first_seed", "greedy_cover"):
            assert rows(linkage.link(df, moves, names, mode)) == rows(getattr(linkage, mode)(want))
        seeds = df.where("id % 4 = 0")
        assert rows(linkage.link(df, moves, names, seeds=seeds)) == rows(linkage.first_seed(linkage.accepted(linkage.scored(linkage.capped_candidates(df, seeds), moves, names))))


def test_records_alike_are_linked_as_one(spark):
    """Thirty thousand records of one sort are 900 million pairs, but one edge."""
    row = people(random.Random(8), 1)[0]
    one = spark.createDataFrame([(0, "K", 1800.0, *row[3:])], LINKED).drop("id")
    df = spark.range(30_000).crossJoin(one).withColumn("uniqueness_score", F.lit(1.0))
    moves = spark.createDataFrame([("a", "b", 1.0)], "from_group string, to_group string, score double")
    for mode in ("first_seed", "greedy_cover"):
        got = linkage.link(df, moves, ["nafn"], mode)
        assert got.agg(F.count("*"), F.max("id_individual")).first()[:] == (30_000, 0)

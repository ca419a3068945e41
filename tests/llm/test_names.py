import math
import random
from itertools import combinations

import pytest

from kinweave.llm.crosslink import believe, link_tables
from kinweave.llm.names import CallNames, edits, jaro_winkler, misspelt, name_alike, phonetic, tokens, words
from kinweave.llm.variants import name_variants
from kinweave.runtime import Scratch

CALLS = CallNames([("Vammi", "Rafviður")], frozenset({"drifdis", "drifros"}))
ROW = "id long, manntal int, nafn string, faedingarar double, kyn string, bi_baer long, bi_einstaklingur long, component string"


def test_known_likeness():
    assert round(jaro_winkler("martha", "marhta"), 4) == 0.9611 and round(jaro_winkler("dixon", "dicksonx"), 4) == 0.8133
    assert edits("abcd", "acbd") == 1 and edits("abc", "xyz", 3) == 3
    assert tokens("Álftfastsson, Röstleifur") == tokens("Röstleifur Álftfastsson") == ("rostleifur", "alftfastsson")
    assert phonetic("thor") == phonetic("tor") and not misspelt("drifdis", "drifros", CALLS.known)


@pytest.mark.parametrize(
    ("a", "b", "alike"),
    [
        ("Snæm: Kvistviðsson", "Snæmóður Kvistviðsson", True), ("D. Sjávkelsson", "Drifsteinn Sjávkelsson", True), ("Vammi Úðsteinsson", "Rafviður Úðsteinsson", True), ("Sjávsi Eldkelsson", "Sjávgeir Eldkelsson", True),
        ("Raf veig Eldgeirsdóttir", "Rafveig Eldgeirsdóttir", True), ("Lynghildur Lyngsteinsdatter", "Lynghildur Lyngsteinsdóttir", True), ("Kvistfastur MÃ½rsen", "Kvistfastur Mýrsen", True),
        ("Drifdís Eldkelsdóttir", "Drifrós Eldkelsdóttir", False), ("Jón Jónsson", "Jóna Jónsdóttir", False), ("Eldgeir Glóðar Jónsson", "Eldgeir Snæar Jónsson", False), ("", "Jón", False),
    ],
)
def test_names_alike(a, b, alike):
    assert (name_alike(a, b, CALLS)[0] > 0.8) == alike == (name_alike(b, a, CALLS)[0] > 0.8)


def called(spark):
    return spark.createDataFrame([("Vammi", "Rafviður", "Karl"), (None, "x", None)], "gaelunafn string, fornafn string, kyn string")


def test_variants(spark, rows):
    data = [
        (1, 1835, "Rafviður Úðsteinsson", 1800.0, "Karl", 5, None), (2, 1840, "Vammi Úðsteinsson", 1801.0, "karl", 5, None), (3, 1845, "rafviður  úðsteinsson", 1800.0, None, 5, None), (4, 1850, "Rafviður Uðsteinson", 1800.0, "Kk", 9, None),
        (5, 1840, "Kolfríður Úðsteinsdóttir", 1800.0, "Kona", 5, None), (6, 1845, "Rafviður Úðsteinsson", 1830.0, "Karl", 5, None), (7, 1835, None, 1800.0, "Karl", 5, None), (8, 1835, "NaN", None, None, None, None),
        (10, 1835, "Eldkell Bárríksson", 1790.0, "Karl", 6, 77), (11, 1840, "Etdkell Bárríksson", 1790.0, "Karl", 6, 78), (12, 1845, "Etdkell Bárríksson", 1790.0, "Karl", 6, 77), (12, 1845, "Etdkell Bárríksson", 1790.0, "Karl", 6, 77),
        (None, 1835, "Eldkell Bárríksson", 1790.0, "Karl", 6, 77), (13, 1850, "Brimríksdóttir Skelbót", 0.0, "Kona", 8, None), (14, 1855, "Skelbót Brimríksdóttir", None, "Kona", 8, None), (15, 1855, "x" * 50_000, 1800.0, "Karl", 5, None),
    ]
    df = spark.createDataFrame([(*x, "c") for x in data], ROW)
    assert rows(name_variants(df, called(spark))) == [(1, 2), (1, 4), (10, 12), (13, 14), (2, 3), (2, 4), (3, 4)]
    assert name_variants(df.limit(0), called(spark)).count() == 0


def slow_marginals(pairs):
    """Exact marginals by all sets of pairs in which no end has two partners of one census."""
    total, each = 0.0, [0.0] * len(pairs)
    for m in range(1 << len(pairs)):
        on = [i for i in range(len(pairs)) if m >> i & 1]
        clash = any((pairs[i][0] == pairs[j][0] and pairs[i][3] & pairs[j][3]) or (pairs[i][1] == pairs[j][1] and pairs[i][2] & pairs[j][2]) for i, j in combinations(on, 2))
        if not clash:
            w = math.exp(sum(pairs[i][4] for i in on))
            total += w
            for i in on:
                each[i] += w
    return [x / total for x in each]


def test_beliefs_on_trees_are_exact(spark):
    # (a, b, censuses of a, censuses of b, odds)
    pairs = [(1, 10, 1, 8, 2.0), (1, 11, 1, 8, 1.0), (2, 11, 1, 8, 0.5), (3, 12, 1, 8, -1.0), (1, 20, 1, 16, 0.3), (4, 20, 2, 16, 0.1), (5, 20, 2, 16, 0.4)]
    df = spark.createDataFrame(pairs, "a long, b long, met_a int, met_b int, odds double")
    got = {(r["a"], r["b"]): r["p"] for r in believe(df, Scratch(spark, "t"), range(3), range(3, 5), settled=1e-6).collect()}
    for x, p in zip(pairs, slow_marginals(pairs)):
        assert abs(got[x[0], x[1]] - p) < 1e-3
    assert believe(df.limit(0), Scratch(spark, "t"), range(3), range(3, 5)).count() == 0
    with pytest.warns(UserWarning, match="settle"):
        believe(df, Scratch(spark, "t"), range(3), range(3, 5), rounds=1, settled=0.0, at_once=1).count()


def test_two_tables(spark):
    r = random.Random(3)
    given, stems = ["Rafviður", "Kolbergur", "Eldkell", "Snævaldur", "Mosgeir", "Tindmar"], ["Úðstein", "Bárrík", "Lyngþór", "Drifkel", "Hrísmar", "Ögleif"]
    people = [(g, f"{s}sson", 1795 + r.randrange(60), 1000 + i) for i, (g, s) in enumerate((g, s) for g in given for s in stems)]
    one, two, truth = [], [], set()
    for k, (g, s, y, farm) in enumerate(people):
        one.append((k, 1860, f"{g} {s}", float(y), "Karl", farm, None, "c"))
        if k % 3:
            name = f"{g[0]}. {s}" if k % 5 == 0 else f"{g} {s}"
            two.append((9000 + k, 1870, name, float(y + (k % 2)), "Karl", farm if k % 4 else 77, None, "c"))
            truth.add((k, 9000 + k))
    two += [(9999, 1870, None, 1800.0, "Karl", 1000, None, "c"), (9998, 1870, "Rafviður Úðsteinsson", 1850.0, "Kona", 1000, None, "c"), (None, 1870, "x", None, None, None, None, "c")]
    a, b = spark.createDataFrame(one + one[:5], ROW), spark.createDataFrame(two + two[:5], ROW)
    p = link_tables(a, b, called(spark)).collect()
    found = {(x["id_census"], x["id_second"]) for x in p if x["p"] >= 0.5}
    assert len(found & truth) >= 0.85 * len(truth) and len(found - truth) <= 1 and all(0 <= x["p"] <= 1 for x in p)
    assert link_tables(a.limit(0), b, called(spark)).count() == 0


def test_movers_among_names_of_one_code(spark):
    """Other names of a block, repeated deliveries and a person's own records are no chance records of an equal name."""
    full, crowd = "Rafviður Glóðar Úðsteinsson", [f"{x} Úðsteinsson" for x in ("Rafviður Snæar", "Rafviður Mosar", "Rafviður Tindar")]
    years = (1835, 1840, 1845, 1850, 1855, 1860)
    one = [(10 * k + c, y, name, 1820.0, "Karl", 100 + k, None, "c") for k, name in enumerate([full, *crowd]) for c, y in enumerate(years)]
    two = [(9000, 1870, full, 1820.0, "Karl", 77, None, "c")]
    df = spark.createDataFrame(one * 2, ROW), spark.createDataFrame(two, ROW)
    got = {x["id_census"] for x in link_tables(*df, called(spark)).collect() if x["p"] >= 0.5}
    assert got == set(range(6))
    # Of three persons of one full name none is told apart.
    one = [(i, y, full, 1820.0, "Karl", p, b, c) for k in range(3) for i, y, _, _, _, p, b, c in one[6 * k : 6 * k + 6]]
    assert not [x for x in link_tables(spark.createDataFrame(one, ROW), df[1], called(spark)).collect() if x["p"] >= 0.5]


def test_variants_of_movers_among_names_of_one_code(spark, rows):
    """Other names of a block, repeated deliveries and a person's own records leave its spellings at two places one person's."""
    years = (1835, 1840, 1845, 1850, 1855, 1860)
    one = [(c, y, "Rafviður Glóðar Úðsteinsson" if c < 3 else "Rafviður Glóðar Uðsteinson", 1820.0 + 2 * (c == 5), "Karl", 100 + c // 3, None, "c") for c, y in enumerate(years)]
    crowd = [(10 * k + c, y, f"Rafviður {x} Úðsteinsson", 1820.0, "Karl", 200 + k, None, "c") for k, x in enumerate(("Snæar", "Mosar", "Tindar"), 1) for c, y in enumerate(years)]
    df = spark.createDataFrame((one + crowd) * 2, ROW)
    assert rows(name_variants(df, called(spark))) == [(a, b) for a in range(3) for b in range(3, 6)]


@pytest.mark.parametrize("crowd", [8, 100])
def test_neighbours_of_other_names_take_nothing(spark, rows, crowd):
    """A pair without a year on one side stays found however many others of its last name live on the farm."""
    given = [f"{a}{b}" for a in ("Drif", "Hrím", "Mos", "Ög", "Röst", "Tind", "Víka", "Þok", "Bár", "Fann") for b in ("ný", "rós", "dís", "lín", "laug", "veig", "hildur", "borg", "unn", "fríður")]
    pair = [(1, 1835, "Skelbót Brimríksdóttir", None, "Kona", 8, None), (2, 1840, "Skelbot Brimriksdotter", 1820.0, "Kona", 8, None)]
    others = [(10 + k, (1835, 1840, 1845)[k % 3], f"{given[k]} Brimríksdóttir", 1790.0 + k % 50, "Kona", 8, None) for k in range(crowd)]
    df = spark.createDataFrame([(*x, "c") for x in pair + others], ROW)
    assert (1, 2) in rows(name_variants(df, called(spark)))


def test_curated_persons_only_reject(spark, rows):
    r = random.Random(5)
    given, stems = ["Rafviður", "Kolbergur", "Eldkell", "Snævaldur"], ["Úðstein", "Bárrík", "Lyngþór"]
    data = []
    for k in range(60):
        g, s, y, farm = r.choice(given), r.choice(stems), 1790 + r.randrange(40), 1 + r.randrange(6)
        for c in r.sample((1835, 1840, 1845, 1850), 3):
            name = f"{g} {s}sson" if r.random() < 0.6 else f"{g} {s}s." if r.random() < 0.5 else f"{g[:4]}. {s}sson"
            data.append((len(data), c, name, float(y + r.randrange(2)), "Karl", farm, k + 1 if r.random() < 0.7 else r.choice((None, 0)), "c"))
    df = spark.createDataFrame(data, ROW)
    blind = df.selectExpr("id", "manntal", "nafn", "faedingarar", "kyn", "bi_baer", "cast(null as bigint) bi_einstaklingur", "component")
    found, free = set(rows(name_variants(df, called(spark)))), set(rows(name_variants(blind, called(spark))))
    person = {x[0]: x[6] or 0 for x in data}
    assert found <= free and len(found) > 20
    assert all(not person[a] or not person[b] or person[a] == person[b] for a, b in found)


def test_large_blocks_come_in_parts(spark):
    """The pairs of a block that is read in windows of years are those of the whole block."""
    import numpy as np
    import pyarrow as pa

    from kinweave.llm.blocks import compared, fit_of

    r = random.Random(9)
    names = ["Rafviður Úðsteinsson", "Rafvidur Udsteinsson", "Rafv. Úðsteinsson", "Rafviður Úðsteinss."]
    n = 1500
    lo = np.array([0 if r.random() < 0.02 else 1600 + r.randrange(300) for _ in range(n)])
    fit = np.array([fit_of(y, y, 1, 1, 1 << r.randrange(5), 1, 1, r.randrange(2)) for y in lo.tolist()])
    order = np.argsort(fit, kind="stable")
    t = pa.table({"key": np.zeros(n, dtype=np.int64), "fit": fit[order], "cell": np.arange(n), "spelt": np.arange(n), "mark": np.zeros(n, dtype=np.int64), "words": [words(names[r.randrange(4)]) for _ in range(n)]})

    def judge(x):
        yield pa.RecordBatch.from_arrays([pa.array(x.one), pa.array(x.two), pa.array(x.gap)], names=["a", "b", "g"])

    for two_sided in (False, True):
        got = []
        for size in (10_000, 150):
            run = compared(CALLS, judge, two_sided, rows=size)
            pairs = [tuple(sorted(p[:2])) + (p[2],) for b in run(iter(t.to_batches(max_chunksize=100))) for p in zip(*(c.to_pylist() for c in b.columns))]
            assert len(pairs) == len(set(pairs))
            got.append(set(pairs))
        assert got[0] == got[1] and len(got[0]) > 1000


def test_names_in_any_order_meet(spark, rows):
    data = [(1, 1835, "Nesbro Klettvaldur", 1823.0, "Karl", 4, None), (2, 1840, "Klettvaldur Nesbro", 1823.0, "Karl", 4, None), (3, 1835, "Anna Guðrún Kolbergsdóttir", 1820.0, "Kona", 4, None), (4, 1840, "Guðrún Anna Kolbergsdóttir", 1820.0, "Kona", 9, None)]
    assert rows(name_variants(spark.createDataFrame([(*x, "c") for x in data], ROW), called(spark))) == [(1, 2), (3, 4)]


def test_names_of_fields_and_namesakes_of_one_census(spark, rows):
    named = "id long, manntal int, nafn string, fornafn string, eftirnafn string, faedingarar double, kyn string, bi_baer long, bi_einstaklingur long"
    one = [(1, 1860, None, "Rafviður", "Úðsteinsson", 1800.0, "Karl", 5, None), (2, 1860, "NaN", "NaN", None, 1800.0, "Karl", 5, None)]
    twins = [(k, 1860, "Eldkell Bárríksson", None, None, 1790.0, "Karl", 6, None) for k in (3, 4)]
    two = [(11, 1870, " ", "Rafviður", "Úðsteinsson", 1800.0, "Karl", 5, None), (12, 1870, "Eldkell Bárríksson", None, None, 1790.0, "Karl", 6, None)]
    first = spark.createDataFrame(one + twins, named)
    got = {(x["id_census"], x["id_second"]): x["p"] for x in link_tables(first, spark.createDataFrame(two, named), called(spark)).collect()}
    assert sorted(got) == [(1, 11), (3, 12), (4, 12)] and got[1, 11] > 0.5
    # Of two namesakes born in one year the one without a slip is found, and neither is left out.
    other = [(5, 1850, "Etdkell Bárríksson", None, None, 1790.0, "Karl", 6, None)]
    assert rows(name_variants(first.where("id = 3").unionByName(spark.createDataFrame(other, named)), called(spark))) == [(3, 5)]


def test_common_names_far_away_are_no_evidence(spark):
    """A namesake of a common name at another small place is somebody else as likely as not; one of a rare name isn't."""
    common = [(k, 1860, "Jón Jónsson", 1701.0 + k, "Karl", 1000 + k, None, "c") for k in range(100)]
    others = [(500 + k, 1860, f"{g} {s}sson", 1801.0 + k % 40, "Karl", 3000 + k, None, "c") for k, (g, s) in enumerate((g, s) for g in ("Rafviður", "Kolbergur", "Eldkell") for s in ("Úðstein", "Bárrík", "Lyngþór"))]
    one = common + others + [(900, 1860, "Tindmar Ögleifsson", 1842.0, "Karl", 5000, None, "c")]
    two = [(9000, 1870, "Jón Jónsson", 1750.0, "Karl", 6000, None, "c"), (9001, 1870, "Tindmar Ögleifsson", 1842.0, "Karl", 6001, None, "c")]
    p = {(x["id_census"], x["id_second"]): x["p"] for x in link_tables(spark.createDataFrame(one, ROW), spark.createDataFrame(two, ROW), called(spark)).collect()}
    assert p.get((49, 9000), 0.0) < 0.5 <= p[(900, 9001)]


def test_rows_of_one_person_at_a_place_go_together(spark):
    """A record without year or with a slip, beside a dated one of a person at its new place, is linked with it."""
    one = [(1, 1860, "Tindmar Ögleifsson", 1842.0, "Karl", 5000, None, "c"), (2, 1855, "Tindmarr Ögleifsson", None, "Karl", 5000, None, "c"), (3, 1860, "Kolbergur Bárriksson", 1820.0, "Karl", 5001, None, "c")]
    two = [(9001, 1870, "Tindmar Ögleifsson", 1842.0, "Karl", 6001, None, "c"), (9002, 1880, "Tindmar Ögleifsson", None, "Karl", 6001, None, "c"), (9003, 1890, "Tindmar Øgleifsson", 1844.0, "Karl", 6001, None, "c")]
    got = {(x["id_census"], x["id_second"]) for x in link_tables(spark.createDataFrame(one, ROW), spark.createDataFrame(two, ROW), called(spark)).collect() if x["p"] >= 0.5}
    assert got == {(a, b) for a in (1, 2) for b in (9001, 9002, 9003)}


def test_movers_within_a_parish(spark, rows):
    """A cut or split name, another last name or a missing year is found at another place of the parish, not of another one."""
    people = [("Lyngvaldur Hraunsteinsson", "L. Hraunsteinsson", 1820.0), ("Mosmar Fannleifsson", "Mo smar Fannleifsson", 1830.0), ("Fannfastur Úðríksson", "Fannfastur Úðríksson", None), ("Þytfastur Mýrbergsson", "Þytfastur Skerbech", 1855.0)]
    one = [(k, 1860, name, y or 1840.0, "Karl", 100 + k, None, "c") for k, (name, _, y) in enumerate(people)]
    two = [(9000 + k, 1870, name, y, "Karl", 200 + k, None, "c") for k, (_, name, y) in enumerate(people)]
    near, far = ([(place, 7 if place < 150 or same else 8) for place in (*range(100, 104), *range(200, 204))] for same in (True, False))
    df = spark.createDataFrame(one, ROW), spark.createDataFrame(two, ROW), called(spark)
    found = [link_tables(*df, spark.createDataFrame(x, "bi_baer long, bi_sokn long")).where("p >= 0.5").select("id_census", "id_second") for x in (near, far)]
    assert rows(found[0]) == [(k, 9000 + k) for k in range(4)] and not set(rows(found[1])) & {(0, 9000), (2, 9002), (3, 9003)}


def test_namesakes_of_a_parish_take_nothing_at_a_place(spark):
    """The persons who count against a pair are those of its place, of its parish, or all."""
    one = [(k, 1860, "Tindmar Ögleifsson", 1842.0, "Karl", 5000 + k, None, "c") for k in range(4)]
    two = [(9000, 1870, "Tindmar Ögleifsson", 1842.0, "Karl", 5000, None, "c")]
    at = [[(5000 + k, parish) for k, parish in enumerate(x)] for x in ((1, 1, 1, 1), (1, 2, 2, 2))]
    p = [{x["id_census"]: x["p"] for x in link_tables(spark.createDataFrame(one, ROW), spark.createDataFrame(two, ROW), called(spark), spark.createDataFrame(x, "bi_baer long, bi_sokn long")).collect()} for x in at]
    assert p[0][0] > 0.9 and p[1][0] > 0.9 and all(x.get(k, 0.0) < 0.5 for x in p for k in (1, 2, 3))


def test_strangers_of_a_range_of_years(spark):
    """Who is not found near by has moved, where nearly all born in such years are found, and is a stranger where few are."""
    from kinweave.llm.crosslink import _elsewhere

    got = _elsewhere({360: 780, 370: 300}, {360: 100, 370: 100}, {360: 1000, 370: 1000, 380: 500})
    assert got[360] > 0.3 and got[370] < -0.3 and abs(got[360] + got[370]) < 1e-9 and 380 not in got
    assert _elsewhere({}, {}, {0: 5}) == {}


def test_nobody_is_in_two_places_in_turn(spark):
    """Who is found at the old place in 1880 was not elsewhere in 1870, but may be in 1890; and who is found near by in 1850 may have come from elsewhere."""
    one = [(1, 1860, "Tindmar Ögleifsson", 1842.0, "Karl", 5000, None, "c"), (2, 1840, "Rafviður Úðsteinsson", 1821.0, "Karl", 5001, None, "c"), (3, 1850, "Rafviður Úðsteinsson", 1821.0, "Karl", 5002, None, "c")]
    one += [(100 + k, 1835 + 5 * (k % 6), f"{g} {s}sson", 1820.0 + k, "Karl", 7000 + k, None, "c") for k, (g, s) in enumerate((g, s) for g in ("Kolbergur", "Eldkell", "Mosmar", "Lyngvaldur", "Fannfastur") for s in ("Bárrík", "Lyngþór", "Hraunstein", "Fannleif", "Mýrberg"))]
    two = [(9000, 1880, "Tindmar Ögleifsson", 1842.0, "Karl", 5000, None, "c"), (9001, 1870, "Tindmar Ögleifsson", 1842.0, "Karl", 6001, None, "c"), (9002, 1890, "Tindmar Ögleifsson", 1842.0, "Karl", 6002, None, "c"), (9003, 1870, "Rafviður Úðsteinsson", 1821.0, "Karl", 5002, None, "c")]
    p = {(x["id_census"], x["id_second"]): x["p"] for x in link_tables(spark.createDataFrame(one, ROW), spark.createDataFrame(two, ROW), called(spark)).collect()}
    assert p[1, 9000] > 0.9 and p[1, 9002] >= 0.5 and p[3, 9003] > 0.9 and p[2, 9003] >= 0.5 and p.get((1, 9001), 0.0) < 0.5


def test_rare_names_tell_who_moved():
    """The share of persons of rare names who are found beyond the parish, less what chance gives, is that of all who are not found near by."""
    from kinweave.llm.crosslink import _beyond

    few, many = ({"all": 1000, "found": 500, "open": 300, "rare": 400, "open_rare": 200, "hit": hit + 2, "open_hit": hit} for hit in (10, 120))
    got = _beyond({360: few, 370: many}, {360: 1000, 370: 1000}, 1000.0)
    assert got.open[370] - got.open[360] > 2.5 and got.again[370] < got.open[370] and got.unplaced[360] >= got.open[360]
    assert _beyond({}, {}, 0.0) == ({}, {}, {}, {})


def test_variants_within_a_parish(spark, rows):
    """Namesakes of other parishes, however many, take nothing from two spellings in one parish, nor do a cut name and a missing year."""
    pairs = [("Skelbót Brimríksdóttir", "Skelbot Brimriksdotter", 1820.0), ("Mosdís Fannleifsdóttir", "M. Fannleifsd.", 1830.0), ("Hrímveig Úðríksdóttir", "Hrímveig Úðriksdóttir", None)]
    data = [(10 * k + c, year, name, 1830.0 if not born and not c else born, "Kona", 100 + 10 * k + c, None, "c") for k, (one, two, born) in enumerate(pairs) for c, (year, name) in enumerate(((1840, one), (1845, two)))]
    data += [(1000 + k, 1835, "Skelbót Brimríksdóttir", 1820.0 + k % 3, "Kona", 1000 + k, None, "c") for k in range(60)]
    places = [(100 + 10 * k + c, 7 + k) for k in range(3) for c in range(2)] + [(1000 + k, 100 + k) for k in range(60)]
    df = spark.createDataFrame(data, ROW), called(spark), spark.createDataFrame(places, "bi_baer long, bi_sokn long")
    assert rows(name_variants(*df)) == [(0, 1), (10, 11), (20, 21)]

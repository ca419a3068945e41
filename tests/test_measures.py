import random

import pytest
from pyspark.sql import functions as F

from kinweave.functions import compare as cmp
from kinweave.operators import features, metrics, models, pool, sampling

#: Published confusion matrices (TN, FP, FN, TP) with their accuracy and adjusted Rand index.
PUBLISHED = [((9396, 6791, 2752, 13435), 0.7052, 0.1684), ((13990, 2197, 2481, 13706), 0.8555, 0.5055), ((10095, 6092, 10542, 5645), 0.4862, 0.0007), ((4100, 850, 0, 0), 0.8283, 0.0)]


def judged(spark, tn, fp, fn, tp):
    return spark.range(1).select(F.explode(F.expr(f"concat(array_repeat(named_struct('label',0,'predicted',0),{tn}),array_repeat(named_struct('label',0,'predicted',1),{fp}),array_repeat(named_struct('label',1,'predicted',0),{fn}),array_repeat(named_struct('label',1,'predicted',1),{tp}))")).alias("s")).select("s.*")


@pytest.mark.parametrize(("counts", "acc", "ari"), PUBLISHED)
def test_published_measures(spark, counts, acc, ari):
    df = judged(spark, *counts)
    assert round(metrics.accuracy(df).first()[0], 4) == acc and round(metrics.adjusted_rand(df).first()[0], 4) == ari
    assert {r[0]: (r[1], r[2]) for r in metrics.confusion(df).collect()}[0] == counts[:2]


def test_curves_against_pairs(spark):
    r = random.Random(3)
    data = [(int(r.random() < 0.4), r.randrange(6) / 5) for _ in range(200)]
    df = spark.createDataFrame(data, "label int, score double")
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(metrics.auc(df).first()[0] - want) < 1e-9
    pts = {q["threshold"]: (q["tp"], q["fp"]) for q in metrics.roc_points(df).collect()}
    assert pts == {t: (sum(s >= t for s in pos), sum(s >= t for s in neg)) for t in {s for _, s in data}}
    j = max((round(sum(s >= t for s in pos) / len(pos) - sum(s >= t for s in neg) / len(neg), 12), t) for t in pts)
    assert tuple(metrics.youden(df).first()) == (j[1], j[0])
    assert metrics.auc(df.limit(0)).first()[0] is None


def test_votes_and_partners(spark, rows):
    v = spark.createDataFrame([(1, x) for x in (1, 1, 1, 0, 0, 0)] + [(2, x) for x in (1, 1, None)], "id int, vote int")
    assert rows(metrics.majority(v)) == [(1, 0), (2, 1)]
    p = spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "id_1 long, id_2 long")
    assert {r[0]: r[1] for r in metrics.partners(p).collect()} == {1: [2, 3], 2: [1], 3: [1]}
    c = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,)], "c long")
    assert tuple(metrics.pair_counts(c, "c").first()) == (3.0, 6.0, 3.0)
    assert rows(metrics.cluster_histogram(c, "c", 2)) == [(0, 1), (1, 1)]


def test_sampling(spark, rows):
    df = spark.createDataFrame([(i, i % 7 if i % 11 else None) for i in range(200)], "id long, c long")
    s = sampling.split_clusters(df, "c", {"train": 0.6, "test": 0.2, "compare": 0.2})
    assert s.groupBy("c").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    many = spark.range(20_000).withColumnRenamed("id", "c")
    n = {r["split"]: r["count"] for r in sampling.split_clusters(many, "c", {"train": 0.8, "test": 0.2}).groupBy("split").count().collect()}
    assert abs(n["train"] / 20_000 - 0.8) < 0.02
    pos, neg = sampling.positive_pairs(df, "id", "c"), sampling.negative_pairs(df, "id", "c")
    assert pos.count() == neg.count() == 7 and neg.where("cluster_1 = cluster_2").count() == 0
    over = sampling.oversampled(df.where("c is not null"), "id", "c", 40).groupBy("c").count().collect()
    assert {r["count"] for r in over} == {40}
    big = sampling.oversampled(spark.createDataFrame([(i, 1) for i in range(50)], "id long, c long"), "id", "c", 20)
    assert big.count() == 50
    one, more = sampling.singletons(spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, None)], "id long, c long"), "c")
    assert rows(one.select("id")) == [(1,)] and rows(more.select("id")) == [(2,), (3,)]
    pos3 = spark.createDataFrame([(10, 0), (11, 1), (12, 2)], "id long, row_pos long")
    assert rows(sampling.neighbour_pairs(pos3, "id", 2)) == [(10, 10, 0), (10, 11, 1), (11, 11, 0), (11, 12, 1), (12, 12, 0)]
    assert sampling.all_pairs(pos3, "id").count() == 3
    assert sampling.ordered_pairs(pos3.withColumn("g", F.lit(1)), "id", ["g"]).count() == 6
    drawn = sampling.random_pairs(pos3, "id", 50)
    assert drawn.count() == 50 and drawn.where("id_1 = id_2").count() == 0 and sampling.random_pairs(pos3.limit(1), "id", 5).count() == 0


def test_pool():
    p = pool.Pool(size=3)
    assert p.learn(frozenset("ab"), True) == 0.5 and len(p.patterns) == 1
    e = p.learn(frozenset("ab"), True)
    assert abs(e - (0.99 * 0.45 + 0.5)) < 1e-9 and p.patterns[0][2] > 0.9  # more confident, where it stood
    for s, same in (("cd", False), ("ae", True), ("xyz", False)):
        p.learn(frozenset(s), same)
    assert len(p.patterns) <= 3
    q = pool.Pool(size=10, patterns=[(frozenset(str(i)), 1.0, 0.9) for i in range(7)])
    assert [sorted(x[0])[0] for x in q.references(5)] == ["0", "1", "4", "5", "6"]


def test_frozen_scores_agree_with_the_pool(spark):
    r = random.Random(5)
    pairs = [(i, [x for x in "abcdefg" if r.random() < 0.5] or ["z"], r.random() < 0.5) for i in range(60)]
    df = spark.createDataFrame(pairs, "id_1 long, statements array<string>, same boolean").withColumn("id_2", F.col("id_1"))
    trained = pool.trained_pool(df, ["id_1"], size=20)
    local = pool.Pool(20)
    for _, s, same in pairs:
        local.learn(frozenset(s), same)
    held = trained.orderBy("rank").collect()
    assert [frozenset(x["statements"]) for x in held] == [x[0] for x in local.patterns]
    refs = local.references(10)
    for q in pool.frozen_scores(df, trained).collect():
        said, told = frozenset(q["statements"]), []
        mine = pool.expectation(float(q["same"]), 0.9)
        for theirs, f, c in refs:
            te, a, b = pool.expectation(f, c), len(said), len(theirs)
            told.append((mine if a > b else te if a < b else max(mine, te), pool.bounded(len(said & theirs) / max(a, b))))
        f, c = told[0]
        for x, y in told[1:]:
            f, c = pool.revised(f, c, x, y)
        assert abs(q["expectation"] - pool.expectation(f, c)) < 1e-9
    assert pool.rule_lines(trained).first()[0].count(" | ") == 1


def test_vectors_and_encoders(spark, rows):
    df = spark.createDataFrame([(1, [0.0, 3.0], [4.0, 0.0]), (2, [1.0, 5.0], [1.0, 5.0])], "id long, a array<double>, b array<double>")
    got = rows(df.select("id", cmp.euclidean(F.col("a"), F.col("b")), cmp.argmax(F.col("a")), cmp.contrastive_loss(F.lit(0.25), F.lit(1), same_is=1), cmp.contrastive_loss(F.lit(0.25), F.lit(0), same_is=1)))
    assert got == [(1, 5.0, 1, 0.0625, 0.5625), (2, 0.0, 1, 0.0625, 0.5625)]
    c = spark.createDataFrame([("b", 1.0), ("a", 3.0), (None, 5.0)], "k string, x double")
    assert {(r["k"], r["code"]) for r in features.label_encoded(c, "k", "code").collect()} == {("a", 0), ("b", 1), (None, 2)}
    assert {(r["k_a"], r["k_b"], r["k_missing"]) for r in features.one_hot(c, "k").collect()} == {(1, 0, 0), (0, 1, 0), (0, 0, 1)}
    assert [round(r["x"], 4) for r in features.standardised(c, ["x"]).orderBy("x").collect()] == [-1.2247, 0.0, 1.2247]
    assert rows(spark.createDataFrame([("Jón2 J. ",)], "n string").select(cmp.words(cmp.clean_name(F.col("n"))))) == [(["Jón", "J"],)]


def test_components_and_models(spark, tmp_path):
    r = random.Random(0)
    data = [(i, i % 2, [(i % 2) * 2.0 + r.random(), r.random() * 0.1, r.random() * 0.01]) for i in range(120)]
    df = spark.createDataFrame(data, "id long, label int, features array<double>")
    wide = df.select("id", *[F.col("features")[k].alias(f"x{k}") for k in range(3)])
    out, shares = features.principal_components(wide, ["x0", "x1", "x2"])
    assert len(shares) == 1 and shares[0] > 0.95 and out.count() == 120
    near = {q["id"]: q["predicted"] for q in models.nearest_vote(df, df, block=7).collect()}
    assert all(near[i] == y for i, y, _ in data)
    d = df.withColumn("features_1", F.col("features")).withColumn("features_2", F.col("features")).withColumn("id_1", F.col("id")).withColumn("id_2", F.col("id")).drop("features")
    d = models.as_features(d)
    known = models.registry(6)
    assert len(known) >= 14
    pick = {k: known[k] for k in ("logistic_regression", "decision_tree")}
    assert [x["accuracy"] for x in models.evaluate(d, d, pick).collect()] == [1.0, 1.0]
    fitted = known["logistic_regression"].fit(d)
    models.save_model(fitted, str(tmp_path / "m"))
    assert models.load_model(str(tmp_path / "m")).transform(d).where("label <> prediction").count() == 0
    assert models.vote(d, d, pick).where("label <> predicted").count() == 0


def test_running_sums_over_ranges(spark):
    from kinweave.operators.prepare import running_sums

    r = random.Random(8)
    data = [(i, r.randrange(-5, 9), r.random()) for i in range(500)]
    df = spark.createDataFrame(data, "k long, n long, x double").repartition(7)
    up, down = 0, 0
    got = {q["k"]: q for q in running_sums(df, "k", ["n", "x"]).collect()}
    back = {q["k"]: q for q in running_sums(df, F.desc("k"), ["n"]).collect()}
    for k, n, _ in data:
        up += n
        assert got[k]["n_upto"] == up and abs(got[k]["x_upto"] - sum(x for i, _, x in data if i <= k)) < 1e-9
    for k, n, _ in reversed(data):
        down += n
        assert back[k]["n_upto"] == down
    assert running_sums(df.limit(0), "k", ["n"]).count() == 0

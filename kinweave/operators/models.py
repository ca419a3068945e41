"""Classifiers of labelled pairs, their evaluation and their vote."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, FMClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import Binarizer, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from kinweave.operators import metrics


def registry(width: int, seed: int = 42) -> dict[str, Pipeline]:
    """Named estimators over the column `features` with labels 0 and 1, one for each family used for pair classification."""

    def one(*stages) -> Pipeline:
        return Pipeline(stages=list(stages))

    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    sc = {"featuresCol": "scaled"}
    return {
        "svm": one(scale, LinearSVC(maxIter=50, **sc)),
        "gradient_boosting": one(GBTClassifier(maxIter=20, maxDepth=3, seed=seed)),
        "boosted_deep": one(GBTClassifier(maxIter=30, maxDepth=6, seed=seed)),
        "boosted_sampled": one(GBTClassifier(maxIter=30, maxDepth=5, subsamplingRate=0.8, seed=seed)),
        "boosted_shrunk": one(GBTClassifier(maxIter=40, maxDepth=5, stepSize=0.05, seed=seed)),
        "boosted_binned": one(GBTClassifier(maxIter=30, maxDepth=5, maxBins=64, seed=seed)),
        "random_forest": one(RandomForestClassifier(numTrees=60, maxDepth=10, seed=seed)),
        "sgd": one(scale, LinearSVC(maxIter=5, **sc)),
        "logistic_regression": one(scale, LogisticRegression(maxIter=50, **sc)),
        "perceptron": one(scale, LinearSVC(maxIter=1, regParam=0.0, **sc)),
        "passive_aggressive": one(scale, LinearSVC(maxIter=10, regParam=0.01, **sc)),
        "gaussian_nb": one(NaiveBayes(modelType="gaussian")),
        "bernoulli_nb": one(Binarizer(inputCol="features", outputCol="signs", threshold=0.0), NaiveBayes(modelType="bernoulli", featuresCol="signs")),
        "decision_tree": one(DecisionTreeClassifier(maxDepth=8, seed=seed)),
        "factorisation": one(scale, FMClassifier(maxIter=30, stepSize=0.05, factorSize=4, seed=seed, **sc)),
        "neural_net": one(scale, MultilayerPerceptronClassifier(layers=[width, 128, 64, 2], maxIter=30, blockSize=64, seed=seed, **sc)),
    }


def as_features(pairs: DataFrame) -> DataFrame:
    """Array pair columns features_1 and features_2 as one vector."""
    return pairs.withColumn("features", array_to_vector(F.concat("features_1", "features_2"))).withColumn("label", F.col("label").cast("double"))


def evaluate(train: DataFrame, test: DataFrame, models: Mapping[str, Pipeline]) -> DataFrame:
    """(model, accuracy, adjusted_rand) on the test pairs, one row for each model."""
    out = None
    for name, est in models.items():
        p = est.fit(train).transform(test).select(F.col("label").cast("int"), F.col("prediction").cast("int").alias("predicted"))
        row = metrics.accuracy(p).crossJoin(metrics.adjusted_rand(p)).withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.select("model", F.round("accuracy", 4).alias("accuracy"), F.round("adjusted_rand", 4).alias("adjusted_rand"))


def vote(train: DataFrame, test: DataFrame, models: Mapping[str, Pipeline], key: tuple[str, str] = ("id_1", "id_2")) -> DataFrame:
    """Pairs with the rounded mean of the models' predictions; a tie means different."""
    scored, names = test, []
    for name, est in models.items():
        m = est.fit(train)
        scored = m.transform(scored)
        scored = scored.withColumn(f"vote_{name}", F.col("prediction")).drop(*[c for c in scored.columns if c in ("prediction", "rawPrediction", "probability", "scaled", "signs")])
        names.append(f"vote_{name}")
    total = F.lit(0.0)
    for n in names:
        total = total + F.col(n)
    return scored.select(*key, F.col("label").cast("int").alias("label"), F.bround(total / len(names), 0).cast("int").alias("predicted"))


def nearest_vote(points: DataFrame, queries: DataFrame, k: int = 5, block: int = 10_000) -> DataFrame:
    """(id, predicted): the majority label of the k nearest labelled points (id, label, features as arrays).

    Exact: about `block` queries at a time go to every batch of points, where distances are one matrix product; each batch
    sends on its k nearest of each query only.
    """
    turns = max(1, -(-queries.count() // block))
    best = None
    for turn in range(turns):
        some = _nearest(points, queries.where(F.pmod(F.xxhash64("id"), F.lit(turns)) == turn), k)
        best = some if best is None else best.unionByName(some)
    w = Window.partitionBy("id").orderBy("d", "other")
    top = best.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    n = top.groupBy("id", "label").agg(F.count("*").alias("n"))
    return n.groupBy("id").agg(F.max(F.struct(F.col("n"), (-F.col("label")).alias("l"))).alias("b")).select("id", (-F.col("b.l")).alias("predicted"))


def _nearest(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(id, other, label, d): of every batch of points the k nearest to each query, itself left out; d is the squared distance."""
    import numpy as np
    import pyarrow as pa

    q = queries.select("id", "features").collect()
    ids, m = np.array([r[0] for r in q]), np.array([r[1] for r in q], dtype=np.float64)

    def near(batches):
        for b in batches:
            v = np.stack(b.column(2).to_numpy(zero_copy_only=False)).astype(np.float64)
            label, pid = b.column(1).to_numpy(), b.column(0).to_numpy()
            for lo in range(0, len(ids), 500):
                d = ((m[lo : lo + 500] ** 2).sum(1)[:, None] + (v**2).sum(1)[None, :] - 2 * m[lo : lo + 500] @ v.T).clip(0)
                d[ids[lo : lo + 500][:, None] == pid[None, :]] = np.inf
                n = min(k, len(v))
                i = np.argpartition(d, n - 1, axis=1)[:, :n]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[lo : lo + 500], n)), pa.array(pid[i].reshape(-1)), pa.array(label[i].reshape(-1).astype(np.int32)), pa.array(np.take_along_axis(d, i, 1).reshape(-1))], names=["id", "other", "label", "d"])

    return points.select("id", "label", "features").mapInArrow(near, "id bigint, other bigint, label int, d double").where(F.col("d") < float("inf"))


def save_model(model: PipelineModel, path: str) -> None:
    """A fitted pipeline, its encoders and scalers included."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)

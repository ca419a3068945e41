"""Feature engineering: encoders, scaling, principal components, name embeddings, pair vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, VectorAssembler, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from kinweave.functions.compare import clean_name, words
from kinweave.operators.prepare import row_positions
from kinweave.runtime import small_side


def one_hot(df: DataFrame, column: str, limit: int = 50) -> DataFrame:
    """A 0/1 column for every value, in sorted order, NULL being a value of its own (`_missing`).

    For columns with at most `limit` values; more raise an error and belong to label_encoded.
    """
    got = [r[0] for r in df.select(column).distinct().limit(limit + 2).collect()]
    values = sorted(v for v in got if v is not None)
    if len(values) > limit:
        raise ValueError(f"{column} has more than {limit} values")
    cols = {f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values}
    if None in got:
        cols[f"{column}_missing"] = F.col(column).isNull().cast("int")
    return df.withColumns(cols)


def label_encoded(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Codes from 0 in sorted order, NULL last. Ranks are given to the distinct values and joined back."""
    values = df.select(column).distinct()
    codes = row_positions(values.select(F.col(column).alias("_v"), F.col(column).isNull().alias("_none")), ["_none", "_v"], out or f"{column}_code").drop("_none")
    codes = small_side(codes)
    return df.join(codes, df[column].eqNullSafe(codes["_v"])).drop("_v")


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0."""
    stats = F.broadcast(df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]))
    scaled = {c: F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.when(F.col(c).isNotNull(), 0.0)) for c in columns}
    return df.crossJoin(stats).withColumns(scaled).drop(*[f"_m_{c}" for c in columns], *[f"_s_{c}" for c in columns])


def principal_components(df: DataFrame, columns: Sequence[str], share: float = 0.95, out: str = "pca") -> tuple[DataFrame, list[float]]:
    """Centred data on as few components as explain more than `share` of the variance; their shares."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    centred = df.withColumns({f"_c_{c}": F.col(c) - F.lit(means[c]) for c in columns})
    v = VectorAssembler(inputCols=[f"_c_{c}" for c in columns], outputCol="_v").transform(centred)
    full = PCA(k=len(columns), inputCol="_v", outputCol="_p").fit(v)
    shares, total, k = list(full.explainedVariance), 0.0, 0
    while k < len(shares) and total <= share:
        total += shares[k]
        k += 1
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(v)
    res = model.transform(v).withColumn(out, vector_to_array("_p"))
    return res.drop("_v", "_p", *[f"_c_{c}" for c in columns]), shares[:k]


def name_embeddings(df: DataFrame, name: str, size: int = 100, window: int = 5, seed: int = 42, out: str = "embedding"):
    """(rows with the mean vector of the name's words, the model); a name without known words has the zero vector."""
    d = df.withColumn("_w", words(clean_name(F.coalesce(F.col(name), F.lit("")))))
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=1, seed=seed, inputCol="_w", outputCol="_e").fit(d.where(F.size("_w") > 0))
    return model.transform(d).withColumn(out, vector_to_array("_e")).drop("_w", "_e"), model


def pair_features(pairs: DataFrame, features: DataFrame, key: str = "id", vector: str = "features") -> DataFrame:
    """pairs with features_1 and features_2 by two joins on the key."""
    f = features.select(F.col(key).alias("_k"), F.col(vector).alias("_v"))
    for k in (1, 2):
        pairs = pairs.join(f.withColumnsRenamed({"_k": f"id_{k}", "_v": f"features_{k}"}), f"id_{k}")
    return pairs

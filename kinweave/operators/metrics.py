"""Quality measures as DataFrames; every one is a grouped aggregation over label and prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinweave.operators.prepare import running_sums


def _known(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df


def accuracy(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return _known(df, label, predicted).agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """(label, n_0, n_1) for the labels 0 and 1."""
    n = _known(df, label, predicted).groupBy(F.col(label).cast("int").alias("label"))
    return n.agg(*[F.sum(F.when(F.col(predicted) == k, 1).otherwise(0)).alias(f"n_{k}") for k in (0, 1)])


def _choose2(n: Column) -> Column:
    return n * (n - 1) / 2.0


def adjusted_rand(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Adjusted Rand index from the contingency table in pair-confusion form; 1 where no pair disagrees.

    Sums of pairs are doubles, so that no count overflows.
    """
    table = _known(df, label, predicted).groupBy(label, predicted).agg(F.count("*").cast("double").alias("n"))
    both = table.agg(F.sum(F.col("n") * F.col("n")).alias("s"), F.sum("n").alias("t"))
    rows = table.groupBy(label).agg(F.sum("n").alias("m")).agg(F.sum(F.col("m") * F.col("m")).alias("a"))
    cols = table.groupBy(predicted).agg(F.sum("n").alias("m")).agg(F.sum(F.col("m") * F.col("m")).alias("b"))
    all_ = both.crossJoin(rows).crossJoin(cols)
    tp, fp, fn = F.col("s") - F.col("t"), F.col("b") - F.col("s"), F.col("a") - F.col("s")
    tn = F.col("t") * F.col("t") - F.col("a") - F.col("b") + F.col("s")
    ari = 2.0 * (tp * tn - fn * fp) / F.nullif((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn), F.lit(0.0))
    return all_.select(F.when((fn == 0) & (fp == 0), 1.0).otherwise(F.coalesce(ari, F.lit(0.0))).alias("adjusted_rand"))


def roc_points(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, tp, fp, tpr, fpr) for each distinct score, from the highest down; sums run over ranges of the distinct scores."""
    g = _known(df, label, score).groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))
    total = F.broadcast(g.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n")))
    at = running_sums(g, F.desc("threshold"), ["p", "n"]).withColumnsRenamed({"p_upto": "tp", "n_upto": "fp"}).crossJoin(total)
    return at.select("threshold", "tp", "fp", (F.col("tp") / F.col("all_p")).alias("tpr"), (F.col("fp") / F.col("all_n")).alias("fpr"))


def auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the curve as the share of positive-negative pairs in the right order, ties half."""
    g = _known(df, label, score).groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("double")).alias("p"), F.sum(1.0 - F.col(label).cast("double")).alias("n"))
    below = running_sums(g, "s", ["n"]).withColumn("below", F.col("n_upto") - F.col("n"))
    good = below.agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2.0)).alias("g"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return good.select((F.col("g") / F.nullif(F.col("p") * F.col("n"), F.lit(0.0))).alias("auc"))


def youden(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """The threshold of the largest tpr - fpr, the highest of equal ones."""
    best = F.struct((F.round(F.col("tpr") - F.col("fpr"), 12)).alias("j"), F.col("threshold").alias("threshold"))
    return roc_points(df, label, score).agg(F.max(best).alias("b")).select(F.col("b.threshold").alias("threshold"), F.col("b.j").alias("youden"))


def correct_by_row(pairs: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """(id, n_pairs, n_correct): each pair counts for both of its rows."""
    ok = (F.col(label) == F.col(predicted)).cast("int")
    return pairs.select(F.explode(F.array("id_1", "id_2")).alias("id"), ok.alias("ok")).groupBy("id").agg(F.count("*").alias("n_pairs"), F.sum("ok").alias("n_correct"))


def chunked(df: DataFrame, position: str, size: int, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Accuracy per chunk of `size` positions."""
    return _known(df, label, predicted).groupBy(F.floor(F.col(position) / size).cast("long").alias("chunk")).agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def pair_counts(df: DataFrame, cluster: str) -> DataFrame:
    """Pairs within clusters, all pairs, and the rest."""
    n = df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").cast("double").alias("n"))
    total = n.agg(F.sum(_choose2(F.col("n"))).alias("positive"), F.sum("n").alias("rows"))
    return total.select("positive", _choose2(F.col("rows")).alias("all_pairs"), (_choose2(F.col("rows")) - F.col("positive")).alias("negative"))


def cluster_histogram(df: DataFrame, cluster: str, bins: int = 30) -> DataFrame:
    """(bin, n): sizes of clusters in equal bins between the smallest and the largest."""
    from kinweave.functions.compare import width_bin

    n = df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").cast("double").alias("n"))
    ends = F.broadcast(n.agg(F.min("n").alias("lo"), F.max("n").alias("hi")))
    return n.crossJoin(ends).groupBy(width_bin(F.col("n"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count("*").alias("n"))


def majority(votes: DataFrame, key: str = "id", vote: str = "vote") -> DataFrame:
    """(id, vote): the rounded mean of 0/1 votes, a tie being 0; missing votes are left out."""
    return votes.where(F.col(vote).isNotNull()).groupBy(key).agg(F.bround(F.avg(F.col(vote).cast("double")), 0).cast("int").alias("vote"))


def partners(pairs: DataFrame) -> DataFrame:
    """(id, matches): sorted distinct partners of each id, both ways."""
    both = pairs.select(F.col("id_1").alias("id"), F.col("id_2").alias("m")).unionByName(pairs.select(F.col("id_2").alias("id"), F.col("id_1").alias("m")))
    return both.groupBy("id").agg(F.array_sort(F.collect_set("m")).alias("matches"))


def pair_sanity(pairs: DataFrame) -> DataFrame:
    """Per label: pairs and distinct clusters among their sides."""
    side = pairs.select("label", F.explode(F.array("cluster_1", "cluster_2")).alias("c"))
    n = pairs.groupBy("label").agg(F.count("*").alias("n_pairs"))
    return n.join(side.groupBy("label").agg(F.countDistinct("c").alias("n_clusters")), "label")

"""Record tables made of the general driver tables, for queries whose SQL can only compare ASCII names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.functions.compare import Marital
from kinweave.operators.prepare import with_uniqueness
from kinweave.runtime import table

ASCII_MARITAL = Marital(never="O")
PART_NAMES = ("nafn", "fornafn", "millinafn", "eftirnafn", "aettarnafn")
PART_UNIQUE = ("nafn", "fornafn", "eftirnafn")

REC_PARTS_SQL = """rec AS (SELECT p_partkey AS id, CAST(1835 + 5 * (p_partkey % 5) AS INTEGER) AS manntal, p_name AS nafn, split_part(p_name, ' ', 1) AS fornafn, '' AS millinafn,
 split_part(p_name, ' ', 2) AS eftirnafn, '' AS aettarnafn, CAST(p_size AS DOUBLE) AS faedingarar, p_type AS kyn, p_partkey % 12 AS bi_baer, p_partkey % 6 AS bi_sokn, p_partkey % 3 AS bi_hreppur,
 CAST(0 AS BIGINT) AS bi_sysla, CASE p_partkey % 6 WHEN 0 THEN 'O' WHEN 1 THEN 'G' WHEN 2 THEN 'S' WHEN 3 THEN 'L' WHEN 4 THEN 'E' END AS hjuskapur, p_brand AS stada_group FROM part)"""
TRANSITIONS_SQL = """tr AS (SELECT a.b AS from_group, c.b AS to_group, CAST(length(a.b) - length(c.b) AS DOUBLE) / 2 + 1 AS score FROM (SELECT DISTINCT p_brand AS b FROM part) a, (SELECT DISTINCT p_brand AS b FROM part) c WHERE a.b <= c.b)"""


def rec_parts(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("p_partkey")
    code = F.when(k % 6 == 0, "O").when(k % 6 == 1, "G").when(k % 6 == 2, "S").when(k % 6 == 3, "L").when(k % 6 == 4, "E")
    return table(spark, root, "part").select(
        k.alias("id"), (1835 + 5 * (k % 5)).cast("int").alias("manntal"), F.col("p_name").alias("nafn"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("fornafn"), F.lit("").alias("millinafn"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("eftirnafn"), F.lit("").alias("aettarnafn"), F.col("p_size").cast("double").alias("faedingarar"), F.col("p_type").alias("kyn"),
        (k % 12).alias("bi_baer"), (k % 6).alias("bi_sokn"), (k % 3).alias("bi_hreppur"), F.lit(0).cast("long").alias("bi_sysla"), code.alias("hjuskapur"), F.col("p_brand").alias("stada_group"),
    )


def rec_parts_unique(spark: SparkSession, root: str) -> DataFrame:
    return with_uniqueness(rec_parts(spark, root), PART_UNIQUE)


def transitions(spark: SparkSession, root: str) -> DataFrame:
    b = table(spark, root, "part").select(F.col("p_brand").alias("from_group")).distinct()
    pairs = b.join(b.select(F.col("from_group").alias("to_group")), F.col("from_group") <= F.col("to_group"))
    return pairs.withColumn("score", (F.length("from_group") - F.length("to_group")).cast("double") / 2 + 1)


def rec_orders(spark: SparkSession, root: str) -> DataFrame:
    """Orders as records of their customers."""
    o, c, n = table(spark, root, "orders"), table(spark, root, "customer"), table(spark, root, "nation")
    d = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return d.select(
        F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("manntal"), F.col("o_custkey").alias("bi_einstaklingur"), F.col("c_name").alias("nafn"), F.col("c_mktsegment").alias("kyn"),
        F.col("o_orderstatus").alias("hjuskapur"), F.col("o_orderpriority").alias("stada"), F.col("c_nationkey").alias("bi_hreppur"), F.col("n_regionkey").alias("bi_sysla"), "o_totalprice",
    )

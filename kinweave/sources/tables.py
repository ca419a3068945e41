"""Readers and writers of record tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

RECORD = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("manntal", T.IntegerType()), T.StructField("nafn", T.StringType()), T.StructField("fornafn", T.StringType()),
    T.StructField("millinafn", T.StringType()), T.StructField("eftirnafn", T.StringType()), T.StructField("aettarnafn", T.StringType()), T.StructField("faedingarar", T.DoubleType()),
    T.StructField("kyn", T.StringType()), T.StructField("stada", T.StringType()), T.StructField("hjuskapur", T.StringType()), T.StructField("bi_einstaklingur", T.LongType()),
    T.StructField("bi_baer", T.LongType()), T.StructField("bi_hreppur", T.LongType()), T.StructField("bi_sokn", T.LongType()), T.StructField("bi_sysla", T.LongType()),
    T.StructField("cleaned_status", T.StringType()), T.StructField("uniqueness_score", T.DoubleType()), T.StructField("id_individual", T.LongType()), T.StructField("score", T.DoubleType()),
])
LOOKUP = T.StructType([T.StructField(c, T.LongType()) for c in ("bi_baer", "manntal", "bi_hreppur", "bi_sokn", "bi_sysla")])
TRANSITION = T.StructType([T.StructField("from_group", T.StringType()), T.StructField("to_group", T.StringType()), T.StructField("score", T.DoubleType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, separator: str = ",") -> DataFrame:
    """A headed CSV file with a known schema; lines of the wrong shape are skipped, blanks and `NaN` are missing."""
    wide = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.schema(wide).options(header=True, sep=separator, mode="DROPMALFORMED", nullValue="NaN", escape='"', enforceSchema=False, multiLine=True).csv(path)

    def typed(f: T.StructField):
        v = F.nullif(F.col(f.name), F.lit(""))
        if isinstance(f.dataType, (T.LongType, T.IntegerType)):
            v = F.regexp_replace(v, r"\.0+$", "")
        return v.try_cast(f.dataType).alias(f.name)

    return raw.select(*[typed(f) for f in schema])


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays become JSON text."""
    cols = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.csv(path, header=True)


def literal_records(spark: SparkSession, lines: list[str], schema: T.StructType) -> DataFrame:
    """Records given as comma-separated text."""
    one = spark.createDataFrame([(x,) for x in lines], "v string")
    return one.select(F.from_csv("v", schema.simpleString()[7:-1].replace(":", " "), {"nullValue": "NaN"}).alias("r")).select("r.*")


def write_pairs(pairs: DataFrame, path: str) -> None:
    """A pair table, by split and label."""
    pairs.write.partitionBy("split", "label").parquet(path)


def append_metrics(row: DataFrame, path: str, digits: int = 4) -> None:
    """Numbers with four decimals, added to what is there."""
    cols = [F.bround(c, digits).alias(c) if t == "double" else F.col(c) for c, t in row.dtypes]
    row.select(*cols).write.mode("append").option("header", True).csv(path)


def write_rules(lines: DataFrame, path: str) -> None:
    lines.write.text(path)


def whole_if_whole(column: str):
    """A number without decimals where it has none, for display."""
    return F.when(F.col(column) == F.floor(column), F.col(column).cast("bigint").cast("string")).otherwise(F.col(column).cast("string"))

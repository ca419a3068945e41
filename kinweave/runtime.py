"""Session helpers: shared storage for intermediate tables, bounded broadcasts, table loading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Largest side, in rows, that `small_side` broadcasts.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: spark.checkpoint.dir of the session.

    Only where the session names none (tests, one machine) a temporary folder is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    held = sc.getCheckpointDir()
    if not held:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kinweave-"))
        held = sc.getCheckpointDir()
    return held.rstrip("/")


class Scratch:
    """Intermediate tables of one operator call, written to the shared folder to cut lineage.

    A written table survives the loss of an executor. `drop` removes a table that a later one replaced.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kept = path
        return out

    def drop(self, *kept: DataFrame | None) -> None:
        jvm = self.spark._jvm
        for df in kept:
            path = getattr(df, "_kept", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if it is proven to have at most `limit` rows, else `df` as it is (shuffled join)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, once per application, so that it needn't be installed on them."""
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_kinweave_shipped", False):
        return
    home = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="kinweave-")) / "kinweave.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    sc.addPyFile(str(path))
    sc._kinweave_shipped = True

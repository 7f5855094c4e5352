"""Tables of one run in the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_freed = 0.0


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Without one, local mode takes a temporary folder, and on a cluster it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/glyphmill-checkpoints"
    return folder.rstrip("/")


def free_shuffles(spark: SparkSession, least: float = 0.0) -> None:
    """Shuffle files of finished steps go when the driver collects its garbage, which it may not do for long by itself.

    Nothing happens within ``least`` seconds of the last time.
    """
    global _freed
    if time.monotonic() - _freed >= least:
        gc.collect()
        spark._jvm.System.gc()
        _freed = time.monotonic()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out to all of the cluster's slots: for work that costs far more than the few bytes by which Spark would share it out."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


class Scratch:
    """Tables of one run in the shared folder: they cut lineage and survive a lost executor.

    Rows are written as Parquet and read again. ``drop`` removes a table as soon as nothing reads it any more; the run's
    folder goes when the driver ends. ``held`` bounds the bytes of a table that a task has in memory while it writes or reads it, which
    counts where rows are large.
    """

    def __init__(self, spark: SparkSession, name: str, held: int | None = None):
        self.options = {"parquet.block.size": str(held), "parquet.page.size.row.check.min": "1"} if held else {}  # sizes are looked at from the first row on, not from the hundredth
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        path = self._path("")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").options(**self.options).parquet(path)
        free_shuffles(self.spark, 1.0)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """The saved table and its number of rows, which are counted while they are written."""
        seen = Observation()
        saved = self.save(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
        return saved, seen.get["n"]

    def drop(self, name: str) -> None:
        path = self._path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

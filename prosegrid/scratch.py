"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from prosegrid.session import ship


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    ``spark.checkpoint.dir`` decides.  Where it is unset, a folder set on the
    SparkContext, then (local mode only, as in tests) a temporary folder, and
    on a cluster a folder in the warehouse, which is shared as well.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        path = tempfile.mkdtemp(prefix="prosegrid-")
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir().rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


class Scratch:
    """Writes tables that cut lineage, and removes them once they are used up.

    A written table survives the loss of executors, is read by any of them and
    carries its size, so that later joins can choose to broadcast it.  Tables
    that are not dropped go when the application ends in good order.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = ship(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        path, files = self._files(self.root)
        files.deleteOnExit(path)

    def _files(self, path: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def store(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self._n}"
        self._n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete stored tables that nothing will read again."""
        for df in tables:
            path, files = self._files(df._scratch_path)
            files.delete(path, True)

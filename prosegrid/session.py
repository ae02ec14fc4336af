"""Sessions, and the package's code on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch where the session sets no number: whole texts of some kilobytes each stay within megabytes.
BATCH_ROWS = 2048
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Hand this package's code to the executors, once for each application.

    Python functions are found by name in a worker, so the package has to be
    importable there whatever the worker's folder and path are.
    """
    sc = spark.sparkContext
    if not sc.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="prosegrid-code-")) / "prosegrid.zip"
        with zipfile.ZipFile(target, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        sc.addPyFile(str(target))
        _SHIPPED.add(sc.applicationId)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """The rows, dealt anew if they come in fewer partitions than the session has cores.

    For work that takes long for each row on files too small to be split; what
    a cluster reads comes in more partitions than that and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

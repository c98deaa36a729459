"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: What Spark puts into one Arrow batch, unless the session says otherwise: rows may hold images or texts of any size.
ARROW_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Let Python workers of this session import this package, by path on one machine, as an added archive on several, and hand
    them small Arrow batches."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, ARROW_BYTES)
    sc = spark.sparkContext
    root = str(PACKAGE.parent)
    env = sc.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    if sc.applicationId not in _shipped and not sc.master.startswith("local[") and sc.master != "local":
        _shipped.add(sc.applicationId)
        archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{PACKAGE.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(PACKAGE.rglob("*.py")):
                z.write(file, str(file.relative_to(PACKAGE.parent)))
        sc.addPyFile(str(archive))


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the folder that the cluster names in spark.checkpoint.dir, and read from there by all that follows.

    Spark deletes the files when the table is no longer in use (spark.cleaner.referenceTracking.cleanCheckpoints).
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="spark-")  # a single machine, as in tests
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def dealt(df: DataFrame) -> DataFrame:
    """df, a plain scan, on all cores: fewer splits than the session has cores are dealt out anew. More splits stay as they are,
    so that only inputs of a few files are ever shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

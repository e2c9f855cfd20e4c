"""Session settings the operators are tuned for, and the shared checkpoint folder."""

from __future__ import annotations

import gc
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # 100-element vectors are aggregated as one column per element.
    "spark.sql.codegen.maxFields": "400",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Superseded checkpoints of iterative operators are removed with their references.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def builder(app_name: str = "paperlens") -> SparkSession.Builder:
    chain = SparkSession.builder.appName(app_name)
    for key, value in SETTINGS.items():
        chain = chain.config(key, value)
    return chain


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``; a local one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="paperlens-")
    context.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """Store ``df`` in the shared folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def released(spark: SparkSession) -> None:
    """Spark removes shuffle files when the driver's garbage is collected, which may be long after they were last read."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the folder of checkpoints, read again: it cuts lineage as checkpoint() does,
    is compressed, and is read by column. Shuffle files of steps that are over are given back first."""
    ensure_checkpoint_dir(df.sparkSession)
    released(df.sparkSession)
    folder = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, where it is not installed on them."""
    package = Path(__file__).resolve().parent
    if package.name + ".zip" in (getattr(spark.sparkContext, "_python_includes", None) or []):
        return
    archive = str(Path(tempfile.mkdtemp(prefix="paperlens-zip-")) / package.name)
    spark.sparkContext.addPyFile(shutil.make_archive(archive, "zip", package.parent, package.name))

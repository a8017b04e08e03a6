"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoints(spark: SparkSession) -> None:
    """Sees to a checkpoint folder: spark.checkpoint.dir, or in local mode a folder of our own. On a
    cluster without one this is an error: each executor would write to its own disk, and later reads
    would miss those files."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="assaykit-")
    sc.setCheckpointDir(at)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by ``keys`` over as many tasks as the session shuffles to, twice its cores at least: for short
    rows with much work each, of which a file's one block or one coalesced partition holds very many."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)

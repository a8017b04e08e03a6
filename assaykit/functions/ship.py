"""Makes the package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


#: What of the package goes to the workers: its code, and the rule files that the code reads as it is imported.
SHIPPED = (".py", ".toml")


def ship(spark: SparkSession) -> None:
    """Sends the package's sources and rule files to the executors, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_assaykit_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    at = os.path.join(tempfile.mkdtemp(prefix="assaykit-"), "assaykit_sources.zip")
    with zipfile.ZipFile(at, "w") as out:
        for folder, _, names in os.walk(package):
            for n in sorted(names):
                if n.endswith(SHIPPED):
                    full = os.path.join(folder, n)
                    out.write(full, os.path.join("assaykit", os.path.relpath(full, package)))
    sc.addPyFile(at)
    sc._assaykit_shipped = True


#: Bytes of a batch that goes to a Python worker, in place of Spark's own setting: both sides hold a
#: batch more than once.
BATCH_BYTES, _KEY, _OWN = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow with the package at hand in the workers, in batches of BATCH_BYTES unless the session
    has a size of its own."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(_KEY, _OWN) == _OWN:
        spark.conf.set(_KEY, BATCH_BYTES)
    return df.mapInArrow(run, schema)

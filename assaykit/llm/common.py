"""Shared helpers of the training-data operators: tables, scratch storage, text arrays."""

from __future__ import annotations

import functools
import sys
import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a folder of
    our own is set in local mode; on a cluster that is an error, as each executor would write to its
    own disk and later reads would miss those files."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="assaykit-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, so a lost
    executor costs at most the tasks that were running, and later passes prune columns."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/assaykit-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._assaykit_at = at
    return out


def discard(*written: DataFrame) -> None:
    """Deletes tables of scratch() that no later read needs."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._assaykit_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Asks the driver's JVM for a collection, after which Spark removes the shuffle files of jobs that are
    over. It does so by itself every half hour, which is too late for a loop of many small jobs."""
    spark.sparkContext._jvm.System.gc()


def spare(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores appended until none is that of a column, in either case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bitmaps of 32,768 rows, 4 KB each, that are broadcast at most.
MAPS = 8192


def among(df: DataFrame, row: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose ``row`` (bigint) is among ``ids``, one column of such, repeats allowed. A bit stands for
    each id, in bitmaps where there are ids, and those are broadcast, so df, which may hold texts, is not shuffled.
    Of more than MAPS bitmaps none is broadcast, and the ids are joined as they are."""
    (key,) = ids.columns
    ids = ids.distinct()
    at, bits = spare(df.columns, "__at", "__bits")
    # dealt first: a partial bitmap in each task would be 4 KB for a few ids
    maps = ids.select(F.shiftright(key, 15).alias(at), F.col(key).bitwiseAND(F.lit(32767)).alias("bit")).repartition(at)
    maps = scratch(maps.groupBy(at).agg(F.bitmap_construct_agg("bit").alias(bits)), "bits")
    if maps.count() > MAPS:
        return df.join(ids.withColumnRenamed(key, at), F.col(row) == F.col(at), "left_semi")
    bit = F.col(row).bitwiseAND(F.lit(32767)).cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    # a semi join, as Spark may put an inner one behind joins that shuffle df
    return df.join(F.broadcast(maps), (F.shiftright(row, 15) == F.col(at)) & (F.getbit(byte, bit.bitwiseAND(F.lit(7))) == 1), "left_semi")


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row, however often body uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def binary_column(batch, name: str):
    """The bytes of a string column of an Arrow record batch, null as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    col = batch.column(batch.schema.get_field_index(name))
    col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
    return pc.fill_null(col, b"")


@functools.cache
def letter_tables():
    """(is letter, is letter or digit, simple lower case) by code point, built once per worker."""
    import numpy as np

    n = sys.maxunicode + 1
    letter = np.fromiter((chr(i).isalpha() for i in range(n)), bool, n)
    alnum = np.fromiter((chr(i).isalnum() for i in range(n)), bool, n)
    lower = np.arange(n, dtype=np.uint32)
    for i in np.flatnonzero(letter):
        if len(low := chr(i).lower()) == 1:
            lower[i] = ord(low)
    return letter, alnum, lower


def code_points(raw: bytes):
    """Code points of UTF-8 bytes as uint32."""
    import numpy as np

    return np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)

"""Ordered operators: running totals, prefixes, batches, cuts, islands, look-back.

A global order is never put into one task: rows are range-partitioned once, each partition sums
itself, and the partitions' offsets (one row each) are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions.storage import checkpoints


def in_order(df: DataFrame, order: list[Column], total: Column | None = None) -> DataFrame:
    """df with __rank (from 1) and, if ``total`` is given, __running, its running sum in ``order``."""
    value = F.lit(0).cast("bigint") if total is None else total
    spark = df.sparkSession
    checkpoints(spark)
    dealt = df.withColumn("__value", value).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).checkpoint()
    sums = dealt.groupBy("__part").agg(F.count("*").alias("__n"), F.sum("__value").alias("__s"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    sums = sums.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s0"))
    own = Window.partitionBy("__part").orderBy(*order)
    here = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.join(F.broadcast(sums), "__part").withColumns({"__rank": F.col("__n0") + F.row_number().over(own), "__running": F.col("__s0") + F.sum("__value").over(here)})
    return out.drop("__part", "__value", "__n0", "__s0", *([] if total is not None else ["__running"]))


def first_arrivals(rows: DataFrame, ref: str, order: list[Column]) -> DataFrame:
    """The first row of each ref; the others are duplicates, not omissions. Rows are dealt by a hash of
    the ref and reduced before they are, so long refs and frequent ones aren't sorted."""
    keys = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    picked = F.min_by(F.struct(*rows.columns), keys).alias("__row")
    return rows.groupBy(F.xxhash64(ref), F.xxhash64(F.lit(1), ref)).agg(picked).select("__row.*")


def byte_budget(rows: DataFrame, limit: int, tier: str = "tier", arrival: str = "arrival", size: str = "bytes", ref: str = "ref") -> DataFrame:
    """Rows in tier, then arrival order while their bytes fit ``limit``; it stops at the first that
    doesn't. Adds __running. A limit that is not positive is an error."""
    if limit <= 0:
        raise ValueError("the byte limit must be positive")
    order = [F.col(tier), F.col(arrival)]
    return in_order(first_arrivals(rows, ref, order), order, F.col(size).cast("bigint")).where(F.col("__running") <= limit)


def batches(rows: DataFrame, order: list[Column], size: int = 200) -> DataFrame:
    """Rows with their batch number, from 1."""
    return in_order(rows, order).withColumn("batch", F.ceil(F.col("__rank") / size).cast("int")).drop("__rank")


def first_share(rows: DataFrame, order: list[Column], parts: int = 10) -> DataFrame:
    """The first ceil(n / parts) rows in order: ties are broken by the order."""
    n = rows.count()
    return in_order(rows, order).where(F.col("__rank") <= -(-n // parts)).drop("__rank")


def top_with_ties(rows: DataFrame, value: str, size: int) -> DataFrame:
    """Rows whose value is at least that at position ``size`` from the top: ties at the cut stay in.

    The cut is found on counts by value, so no row is sorted.
    """
    per_value = rows.groupBy(value).agg(F.count("*").alias("__n"))
    above = in_order(per_value, [F.desc(value)], F.col("__n")).withColumn("__before", F.col("__running") - F.col("__n"))
    keep = above.where(F.col("__before") < max(1, size)).select(value)
    return rows.join(keep, value, "left_semi")


def islands(spans: DataFrame, key: str, start: str, stop: str) -> DataFrame:
    """(key, start, stop): closed integer spans joined where they touch or overlap."""
    w = Window.partitionBy(key).orderBy(start, stop)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    opens = (F.col(start) > F.max(stop).over(before) + 1) | F.max(stop).over(before).isNull()
    marked = spans.withColumn("__new", opens.cast("int"))
    marked = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "__island").agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("__island")


def last_above(lines: DataFrame, key: str, pos: str, value: Column, name: str, within: int | None = None) -> DataFrame:
    """The nearest value that is not null on a line's own or an earlier line, at most ``within`` above."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding if within is None else -within, 0)
    return lines.withColumn(name, F.last(value, ignorenulls=True).over(w))


def depth(lines: DataFrame, key: str, pos: str, opens: Column, closes: Column, name: str = "depth") -> DataFrame:
    """Running bracket depth after each line."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.sum(opens - closes).over(w))


def examples(rows: DataFrame, key: str, order: list[Column], top: int = 20) -> DataFrame:
    """The first ``top`` rows of each key with __omitted, how many the key has beyond them. Counts are
    aggregated apart, so a window holds no more than each partition's first rows of a key."""
    totals = rows.groupBy(key).agg(F.count("*").alias("__n")).select(F.col(key).alias("__key"), "__n")
    ranked = rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__k") <= top)
    both = ranked.join(totals, ranked[key].eqNullSafe(totals["__key"]))
    return both.withColumn("__omitted", F.greatest(F.col("__n") - top, F.lit(0))).drop("__key", "__n")

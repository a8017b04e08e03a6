"""Set operations with reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing(sought: DataFrame, found: DataFrame, examined: DataFrame, key: str = "source") -> DataFrame:
    """What was sought and not found: ``not found`` where it was looked for, else ``not examined``."""
    seen = examined.select(key).distinct().withColumn("__seen", F.lit(True))
    return sought.join(found, key, "left_anti").join(seen, key, "left").select(key, F.when(F.col("__seen"), "not found").otherwise("not examined").alias("reason"))


def removed(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of before that after does not have again."""
    return before.select(*keys).distinct().join(after.select(*keys).distinct(), keys, "left_anti")


def overlay(base: DataFrame, local: DataFrame, keys: list[str]) -> DataFrame:
    """The union of a table and a local layer on top: the layer adds, its rows win, nothing is removed."""
    rows = base.withColumn("__layer", F.lit(0)).unionByName(local.withColumn("__layer", F.lit(1)))
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in base.columns if c not in keys]), "__layer").alias("r"))
    return best.select(*keys, "r.*")

"""The long table of metrics: a number or a reason, never both, and every number cites its evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHOLE_SET, LOCAL = "whole_set", "evidence_local"


def ratio(found: Column, of: Column) -> Column:
    """found / of, null where there is nothing to divide by."""
    return found.cast("double") / F.nullif(of.cast("double"), F.lit(0.0))


def share_of(condition: Column) -> Column:
    return ratio(F.count_if(condition), F.count("*"))


def per_kloc(hits: Column, lines: Column) -> Column:
    return ratio(hits * 1000, lines)


def long_table(values: DataFrame, kinds: dict[str, str], key: str = "dimension", truncated: str | None = None, reason: str = "no_denominator") -> DataFrame:
    """(key, metric, kind, value, abstain_reason) from one column per metric.

    A null value abstains. On a truncated pack whole-set metrics abstain whatever their value; local
    ones stand.
    """
    cut = F.lit(False) if truncated is None else F.coalesce(F.col(truncated), F.lit(False))
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(k).alias("kind"), F.col(m).cast("double").alias("value")) for m, k in kinds.items()))
    out = values.select(F.col(key), cut.alias("__cut"), F.explode(rows).alias("m")).select(key, "__cut", "m.*")
    lost = F.col("__cut") & (F.col("kind") == WHOLE_SET)
    why = F.when(lost, "truncated_evidence").when(F.col("value").isNull(), reason)
    return out.withColumn("abstain_reason", why).withColumn("value", F.when(F.col("abstain_reason").isNull(), F.col("value"))).drop("__cut")


def uncited(metrics: DataFrame, refs: DataFrame) -> DataFrame:
    """Cited refs that no pack has: must be empty. metrics: dimension, computed_from; refs: dimension, ref."""
    cited = metrics.select("dimension", F.explode("computed_from").alias("ref")).distinct()
    return cited.join(refs, ["dimension", "ref"], "left_anti")


def calibration(answers: DataFrame, group: str | None = None) -> DataFrame:
    """(ece, n): expected calibration error over ten bins of equal width, the last one closed. answers:
    confidence, correct; a missing answer is wrong at confidence 0."""
    keys = [group] if group else []
    c, ok = F.coalesce(F.col("confidence"), F.lit(0.0)), F.coalesce(F.col("correct"), F.lit(False)).cast("int")
    bins = answers.groupBy(*keys, F.least(F.floor(c * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.sum(ok).alias("hits"), F.sum(c).alias("mass"))
    return bins.groupBy(*keys).agg((F.sum(F.abs(F.col("hits") - F.col("mass"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def nearest_rank(value: str, part: float) -> Column:
    """Nearest-rank percentile: an element of the values."""
    return F.expr(f"percentile_disc({part}) within group (order by {value})")

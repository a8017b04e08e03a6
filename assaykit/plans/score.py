"""The whole evaluation of a corpus: files to facts to metrics to ratings to one overall value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.operators import joins, metrics, rating
from assaykit.plans import measures
from assaykit.sources.roles import ROLES, SOUGHT


@dataclass
class Score:
    metrics: DataFrame
    inputs: DataFrame
    ratings: DataFrame
    overall: DataFrame
    plan: DataFrame
    gates: DataFrame


def from_metrics(spark: SparkSession, files: DataFrame, table: DataFrame, sought: dict[str, tuple[str, ...]], failed: list[str] = ()) -> Score:
    """Ratings and what follows from them of a table of metrics. A dimension that seeks no role is open:
    its coverage is whole."""
    rules = rating.rule_table(spark, [r for r in rating.RULES if r[0] in sought])
    rule_inputs = rating.inputs(table, rules)
    roles = joins.resolve_roles(files, {k: list(v) for k, v in ROLES.items()}).select("role").distinct().withColumn("there", F.lit(1))
    wanted = spark.createDataFrame([(d, r) for d, rs in sought.items() for r in rs], "dimension string, role string")
    cover = wanted.join(roles, "role", "left").groupBy("dimension").agg(metrics.ratio(F.count("there"), F.count("*")).alias("coverage"))
    base = spark.createDataFrame([(d, rating.FLOORS.get(d, 0.0), d in failed, not rs) for d, rs in sought.items()], "dimension string, floor double, failed boolean, open boolean")
    packs = base.join(cover, "dimension", "left").select("dimension", F.when(F.col("open"), 1.0).otherwise(F.col("coverage")).alias("coverage"), "floor", "failed", F.lit(False).alias("has_docs"))
    ratings = rating.rate(rule_inputs, packs)
    return Score(table, rule_inputs, ratings, rating.overall(ratings), rating.plan(rule_inputs, ratings), rating.gates(rule_inputs, ratings))


def score(spark: SparkSession, files: DataFrame, inputs: measures.Inputs | None = None) -> Score:
    """The score of files (path, text, size, read_status), with the history and the change of ``inputs``.
    Metrics that nothing could be read for abstain."""
    table = measures.measure(spark, inputs or measures.Inputs(files))
    return from_metrics(spark, files, table, {d: SOUGHT.get(d, ()) for d in rating.FLOORS})

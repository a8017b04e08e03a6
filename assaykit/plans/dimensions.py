"""Dimensions as plug-ins: declared data, and metrics of the shared plan or of a function of one's own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.operators import rating
from assaykit.plans import measures
from assaykit.plans import score as plan
from assaykit.sources.roles import SOUGHT

Collect = Callable[[SparkSession, DataFrame], DataFrame]


@dataclass(frozen=True)
class Dimension:
    """collect gives (dimension, metric, value) of files; without it the dimension's rows are those of
    the shared plan, which is run once for all such dimensions."""

    name: str
    purpose: str
    sought: tuple[str, ...]
    collect: Collect | None = None


DIMENSIONS = {
    name: Dimension(name, purpose, SOUGHT.get(name, ()))
    for name, purpose in (
        ("architecture", "documents that say how the system is built and why, cycles and layers"),
        ("solution-fit", "what was asked for beside what was built; rated from outside only"),
        ("requirement-fidelity", "requirements, routes and criteria traced to code and tests"),
        ("code-quality", "complexity, debt, escapes from types, lint and format settings"),
        ("security", "sinks, secrets, cookies and lockfiles"),
        ("test-strategy", "what the tests cover, assert and skip"),
        ("blast-radius", "what a change reaches and what it removes"),
        ("reliability", "calls without limits, errors that vanish, queries in loops"),
        ("supply-chain", "lockfiles, pinned references, provenance and licences"),
        ("api", "specifications, versions, validation and what a change breaks"),
        ("data", "migrations, what undoes them and what they destroy"),
        ("operations", "logging, audit trails, owners, pins and environments"),
        ("infrastructure", "grants, open ingress, encryption, state and databases"),
        ("change-risk", "what a change of its kind must bring"),
        ("finance", "money in floating types, ledgers without a trail"),
        ("healthcare", "personal values in test data and logs"),
        ("frontend-a11y", "images, controls, hidden focus, viewports"),
    )
}


def discover(spark: SparkSession) -> DataFrame:
    """(dimension, purpose, sought, rules, floor), whatever the corpus."""
    rows = [(d.name, d.purpose, list(d.sought), sum(r[0] == d.name for r in rating.RULES), rating.FLOORS[d.name]) for d in DIMENSIONS.values()]
    return spark.createDataFrame(rows, "dimension string, purpose string, sought array<string>, rules int, floor double")


def combined(spark: SparkSession, files: DataFrame, names: list[str] | None = None, dimensions: dict[str, Dimension] | None = None, inputs: measures.Inputs | None = None) -> plan.Score:
    """The score of some dimensions. One that fails is rated as failed, with its error among the metrics,
    and leaves the others alone; an unknown name is an error."""
    known = DIMENSIONS if dimensions is None else dimensions
    names = list(known) if names is None else names
    if unknown := sorted(set(names) - set(known)):
        raise ValueError(f"unknown dimensions: {', '.join(unknown)}")
    table = spark.createDataFrame([], measures.SCHEMA)
    failed = []
    shared = [n for n in names if known[n].collect is None]
    if shared:
        table = measures.measure(spark, inputs or measures.Inputs(files)).where(F.col("dimension").isin(shared) | (F.col("metric") == "failed"))
    for name in (n for n in names if known[n].collect is not None):
        try:
            rows = [(r.dimension, r.metric, "evidence_local", r.value, None if r.value is not None else "no_denominator", None, []) for r in known[name].collect(spark, files).collect()]
        except Exception as error:  # noqa: BLE001  isolation is the point: the rating says dimension_failed
            failed.append(name)
            rows = [(name, "failed", "evidence_local", None, f"error: {error!s:.500}", None, [])]
        table = table.unionByName(spark.createDataFrame(rows, measures.SCHEMA))
    return plan.from_metrics(spark, files, table, {n: known[n].sought for n in names}, failed)

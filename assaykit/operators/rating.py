"""Ratings: rules, floors, gates, plan, assessment, divergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions.text import blend, half_even, within_band

#: Dimension, metric, weight, comparison, threshold, area.
RULES = (
    ("architecture", "architecture_description_missing", 10, "at_most", 0.0, "#1"),
    ("architecture", "decision_records_missing", 10, "at_most", 0.0, "#1"),
    ("architecture", "top_level_import_cycles", 40, "at_most", 0.0, "#1"),
    ("architecture", "layer_direction_violations", 40, "at_most", 0.0, "#1"),
    ("requirement-fidelity", "requirements_doc_missing", 10, "at_most", 0.0, "#27"),
    ("requirement-fidelity", "code_commits_with_docs_share", 10, "at_least", 0.3, "#27"),
    ("requirement-fidelity", "routes_without_test_share", 40, "at_most", 0.2, "#2"),
    ("requirement-fidelity", "commits_with_issue_reference_share", 20, "at_least", 0.5, "#2"),
    ("requirement-fidelity", "requirement_items_traced_share", 20, "at_least", 0.8, "#2"),
    ("code-quality", "functions_over_ccn_10_share", 25, "at_most", 0.1, "#18"),
    ("code-quality", "max_function_ccn", 15, "at_most", 15.0, "#18"),
    ("code-quality", "lint_config_missing", 10, "at_most", 0.0, "#17"),
    ("code-quality", "format_config_missing", 10, "at_most", 0.0, "#17"),
    ("code-quality", "type_escapes_per_kloc", 15, "at_most", 5.0, "#17"),
    ("code-quality", "todo_without_ticket_share", 15, "at_most", 0.5, "#31"),
    ("code-quality", "strict_type_config_missing", 10, "at_most", 0.0, "#17"),
    ("security", "redaction_hits_observed", 35, "at_most", 0.0, "#10"),
    ("security", "sink_hits_observed", 35, "at_most", 0.0, "#10"),
    ("security", "lockfile_missing", 15, "at_most", 0.0, "#20"),
    ("security", "cookie_flags_missing_observed", 15, "at_most", 0.0, "#8"),
    ("test-strategy", "source_files_without_covering_test_share", 25, "at_most", 0.2, "#16"),
    ("test-strategy", "assertion_density_per_test", 20, "at_least", 1.0, "#16"),
    ("test-strategy", "test_config_and_ci_missing", 20, "at_most", 0.0, "#16"),
    ("test-strategy", "tests_without_assertions_share", 15, "at_most", 0.1, "#16"),
    ("test-strategy", "skipped_test_share", 10, "at_most", 0.05, "#16"),
    ("test-strategy", "network_calls_in_unit_tests_observed", 10, "at_most", 0.0, "#16"),
    ("blast-radius", "max_fan_in_changed", 35, "at_most", 20.0, "#5"),
    ("blast-radius", "changed_files_in_churn_hotspots_share", 35, "at_most", 0.2, "#5"),
    ("blast-radius", "public_symbols_removed", 15, "at_most", 0.0, "#5"),
    ("blast-radius", "destructive_migration_ops", 15, "at_most", 0.0, "#5"),
    ("blast-radius", "high_reach_files_without_test_share", 50, "at_most", 0.2, "#5"),
    ("blast-radius", "high_reach_churn_hotspot_share", 50, "at_most", 0.3, "#5"),
    ("reliability", "swallowed_errors_observed", 35, "at_most", 0.0, "#12"),
    ("reliability", "outbound_calls_without_timeout_observed", 35, "at_most", 0.0, "#13"),
    ("reliability", "retries_without_backoff_observed", 10, "at_most", 0.0, "#13"),
    ("reliability", "queries_in_loops_observed", 20, "at_most", 0.0, "#15"),
    ("supply-chain", "lockfile_missing", 20, "at_most", 0.0, "#20"),
    ("supply-chain", "licence_file_missing", 15, "at_most", 0.0, "#20"),
    ("supply-chain", "ci_actions_unpinned_share", 20, "at_most", 0.0, "#21"),
    ("supply-chain", "ci_lockfile_install_missing", 20, "at_most", 0.0, "#21"),
    ("supply-chain", "ci_provenance_step_missing", 25, "at_most", 0.0, "#22"),
    ("api", "api_spec_missing", 30, "at_most", 0.0, "#7"),
    ("api", "api_version_missing", 20, "at_most", 0.0, "#7"),
    ("api", "request_validation_missing", 30, "at_most", 0.0, "#7"),
    ("api", "breaking_api_changes_observed", 20, "at_most", 0.0, "#7"),
    ("data", "migrations_missing", 30, "at_most", 0.0, "#4"),
    ("data", "migrations_without_rollback_share", 30, "at_most", 0.0, "#4"),
    ("data", "schema_constraints_missing", 20, "at_most", 0.0, "#4"),
    ("data", "destructive_migration_ops_observed", 20, "at_most", 0.0, "#4"),
    ("operations", "logging_library_missing", 20, "at_most", 0.0, "#14"),
    ("operations", "audit_log_writes_missing", 10, "at_most", 0.0, "#14"),
    ("operations", "codeowners_missing", 20, "at_most", 0.0, "#26"),
    ("operations", "agent_guardrails_missing", 10, "at_most", 0.0, "#29"),
    ("operations", "agent_config_secrets_observed", 20, "at_most", 0.0, "#29"),
    ("operations", "tool_version_pin_missing", 10, "at_most", 0.0, "#30"),
    ("operations", "dev_environment_missing", 10, "at_most", 0.0, "#30"),
    ("infrastructure", "iac_wildcard_iam_observed", 20, "at_most", 0.0, "#11"),
    ("infrastructure", "iac_open_ingress_observed", 20, "at_most", 0.0, "#11"),
    ("infrastructure", "iac_unencrypted_storage_observed", 15, "at_most", 0.0, "#11"),
    ("infrastructure", "terraform_locked_remote_state_missing", 15, "at_most", 0.0, "#23"),
    ("infrastructure", "terraform_environment_separation_missing", 5, "at_most", 0.0, "#23"),
    ("infrastructure", "database_backup_unconfigured", 15, "at_most", 0.0, "#24"),
    ("infrastructure", "database_ha_unconfigured", 10, "at_most", 0.0, "#24"),
    ("change-risk", "bugfix_without_regression_test", 25, "at_least", 1.0, "#16"),
    ("change-risk", "new_code_without_test_share", 25, "at_most", 0.2, "#16"),
    ("change-risk", "refactor_tests_deleted", 25, "at_most", 0.0, "#16"),
    ("change-risk", "refactor_uncovered_share", 25, "at_most", 0.2, "#16"),
    ("healthcare", "phi_values_in_test_data_observed", 50, "at_most", 0.0, "#9"),
    ("healthcare", "phi_values_in_log_statements_observed", 50, "at_most", 0.0, "#9"),
    ("finance", "float_money_observed", 50, "at_most", 0.0, "#3"),
    ("finance", "ledger_tables_without_audit_columns_observed", 25, "at_most", 0.0, "#3"),
    ("finance", "ledger_rows_mutated_observed", 25, "at_most", 0.0, "#3"),
    ("frontend-a11y", "images_without_alt_observed", 25, "at_most", 0.0, "#19"),
    ("frontend-a11y", "form_controls_without_label_observed", 25, "at_most", 0.0, "#19"),
    ("frontend-a11y", "aria_hidden_focusable_observed", 20, "at_most", 0.0, "#19"),
    ("frontend-a11y", "viewport_missing_or_zoom_disabled_observed", 15, "at_most", 0.0, "#19"),
    ("frontend-a11y", "browser_support_declaration_missing", 15, "at_most", 0.0, "#19"),
)
#: Least coverage by dimension.
FLOORS = {
    "architecture": 0.4,
    "solution-fit": 0.5,
    "requirement-fidelity": 0.5,
    "code-quality": 0.16,
    "security": 0.25,
    "test-strategy": 0.2,
    "blast-radius": 0.25,
    "reliability": 0.25,
    "supply-chain": 0.4,
    "api": 0.25,
    "data": 0.25,
    "operations": 0.25,
    "infrastructure": 0.25,
    "change-risk": 1.0,
    "healthcare": 0.25,
    "finance": 0.25,
    "frontend-a11y": 0.25,
}
#: Points that a finding takes by severity, and the share by confidence in percent.
PENALTY = {"low": 5, "medium": 15, "high": 30}
CONFIDENCE = {"low": 25, "medium": 60, "high": 100}
#: Least part of the declared weight that must be measured.
MEASURED = 0.5


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """dimension, metric, weight, comparison, threshold, area: a fixed table of under a hundred rows."""
    return spark.createDataFrame(list(rules), "dimension string, metric string, weight int, comparison string, threshold double, area string")


def passes(value: Column, comparison: Column, threshold: Column) -> Column:
    return F.when(comparison == "at_least", value >= threshold).otherwise(value <= threshold)


def inputs(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules with their metric's value and abstention and what they earn. A metric without a row has
    abstained. metrics: dimension, metric, value, abstain_reason. The rules are few: they are broadcast
    from the right, and the left side keeps every rule."""
    values = metrics.select("dimension", "metric", "value", "abstain_reason")
    out = rules.join(values, ["dimension", "metric"], "left")
    ok = passes(F.col("value"), F.col("comparison"), F.col("threshold"))
    return out.withColumns({
        "available": F.when(F.col("value").isNotNull(), F.col("weight")).otherwise(0),
        "earned": F.when(F.col("value").isNotNull() & ok, F.col("weight")).otherwise(0),
        "passed": F.when(F.col("value").isNotNull(), ok),
    })


def rate(rule_inputs: DataFrame, packs: DataFrame) -> DataFrame:
    """(dimension, value, reason_code, earned, available, declared): a number or the first reason that
    holds. packs: dimension, coverage, floor, failed, has_docs."""
    sums = rule_inputs.groupBy("dimension").agg(F.sum("earned").alias("earned"), F.sum("available").alias("available"), F.sum("weight").alias("declared"))
    c = packs.join(sums, "dimension", "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in ("earned", "available", "declared")})
    share = F.col("available") / F.nullif(F.col("declared"), F.lit(0))
    reason = (
        F.when(F.col("failed"), "dimension_failed")
        .when((F.col("declared") == 0) & F.col("has_docs"), "documentation_only")
        .when(F.col("declared") == 0, "no_static_rule")
        .when(F.col("coverage").isNull(), "coverage_not_applicable")
        .when(F.col("coverage") < F.col("floor"), "below_coverage_floor")
        .when(F.col("available") == 0, "all_metrics_abstained")
        .when(share < MEASURED, "insufficient_measured_weight")
    )
    number = half_even(F.lit(100.0) * F.col("earned") / F.nullif(F.col("available"), F.lit(0)))
    return c.withColumn("reason_code", reason).withColumn("value", F.when(F.col("reason_code").isNull(), number)).select("dimension", "value", "reason_code", "earned", "available", "declared")


def overall(ratings: DataFrame, without: tuple[str, ...] = ("change-risk",)) -> DataFrame:
    """(value, reason_code, n): the mean of the ratings there are."""
    return ratings.where(~F.col("dimension").isin(list(without))).agg(half_even(F.avg("value")).alias("value"), F.when(F.count("value") == 0, "no_dimension_rated").alias("reason_code"), F.count("value").alias("n"))


def gates(rule_inputs: DataFrame, ratings: DataFrame) -> DataFrame:
    """(dimension, gate): dimensions without static rules, or with a value near its threshold."""
    near = rule_inputs.where(within_band(F.col("value"), F.col("threshold"))).select("dimension").distinct().withColumn("near", F.lit(True))
    out = ratings.join(near, "dimension", "left").where((F.col("reason_code") == "no_static_rule") | F.coalesce("near", F.lit(False)))
    return out.select("dimension", F.when(F.col("reason_code") == "no_static_rule", "no_static_rule").otherwise("borderline").alias("gate"))


def blended(ratings: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Ratings with ``final``: blended where an evaluation (dimension, score, confidence) is there; the
    score alone, and ``label`` says so, where the rating abstained."""
    out = ratings.join(evaluations, "dimension", "left")
    final = F.when(F.col("score").isNull(), F.col("value")).when(F.col("value").isNull(), F.col("score").cast("int")).otherwise(blend(F.col("value"), F.col("score"), F.col("confidence")))
    label = F.when(F.col("score").isNull(), "rules").when(F.col("value").isNull(), "evaluation_only").otherwise("blended")
    return out.withColumns({"final": final, "label": label})


def plan(rule_inputs: DataFrame, ratings: DataFrame) -> DataFrame:
    """(priority, dimension, metric, gain_low, gain_high): what each unmet or unmeasured rule could add
    to its dimension's rating. P0 is near its threshold, P1 unmet, P2 unmeasured."""
    rated = ratings.where("value is not null").select("dimension", F.col("value").alias("rating"), F.col("earned").alias("sum_earned"), F.col("available").alias("sum_available"))
    x = rule_inputs.join(rated, "dimension").where(~F.coalesce("passed", F.lit(False)))
    score = lambda e, a: half_even(F.lit(100.0) * e / a)
    met = score(F.col("sum_earned") + F.col("weight"), F.col("sum_available")) - F.col("rating")
    low = score(F.col("sum_earned"), F.col("sum_available") + F.col("weight")) - F.col("rating")
    high = score(F.col("sum_earned") + F.col("weight"), F.col("sum_available") + F.col("weight")) - F.col("rating")
    unmeasured = F.col("value").isNull()
    priority = F.when(unmeasured, "P2").when(within_band(F.col("value"), F.col("threshold")), "P0").otherwise("P1")
    out = x.select(priority.alias("priority"), "dimension", "metric", F.when(unmeasured, low).otherwise(met).alias("gain_low"), F.when(unmeasured, high).otherwise(met).alias("gain_high"))
    return out.orderBy("priority", F.desc(F.greatest("gain_low", "gain_high")), "dimension", "metric")


def assess(findings: DataFrame) -> DataFrame:
    """(dimension, value, n): 100 less the findings' points, weighted by confidence, never under 0; a
    finding without a severity counts as medium."""
    look = lambda table, col: F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[col]
    points = look(PENALTY, F.coalesce("severity", F.lit("medium"))) * look(CONFIDENCE, F.col("confidence"))
    return findings.groupBy("dimension").agg(F.greatest(F.lit(0), F.lit(100) - half_even(F.sum(points) / F.lit(100.0))).alias("value"), F.count("*").alias("n"))


def compare(ratings: DataFrame, assessments: DataFrame) -> DataFrame:
    """(dimension, rating, assessment, divergence, direction), side by side; null where either is."""
    both = ratings.select("dimension", F.col("value").alias("rating")).join(assessments.select("dimension", F.col("value").alias("assessment")), "dimension", "full")
    gap = F.col("assessment") - F.col("rating")
    way = F.when(gap < 0, "agent_harsher").when(gap > 0, "agent_kinder").when(gap == 0, "equal")
    return both.withColumns({"divergence": gap, "direction": way})


def pooled_coverage(packs: DataFrame) -> DataFrame:
    """(coverage, failed): found over sought, of the dimensions that gave a pack; failed ones are named."""
    ok = ~F.col("failed")
    total = F.sum(F.when(ok, F.col("sought")))
    return packs.agg((F.sum(F.when(ok, F.col("found"))) / F.nullif(total, F.lit(0))).alias("coverage"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("failed"), F.col("dimension")))), ",").alias("failed"))


def areas_without_rule(areas: DataFrame, rules: DataFrame) -> DataFrame:
    return areas.join(rules.select("area").distinct(), "area", "left_anti")


def validate_findings(findings: DataFrame, refs: DataFrame, most: int = 500) -> DataFrame:
    """Every finding with ``errors``, all of them at once; refs: evidence_ref. If there are more than
    ``most`` findings, that is an error of each: which of them came first isn't known."""
    known = refs.select("evidence_ref").distinct().withColumn("__cited", F.lit(True))
    rows = findings.join(known, "evidence_ref", "left")
    many = F.lit(findings.count() > most)
    levels = list(PENALTY)
    checks = [
        F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "title is empty"),
        F.when(~F.coalesce(F.col("confidence").isin(levels), F.lit(False)), "confidence is unknown"),
        F.when(F.col("severity").isNotNull() & ~F.col("severity").isin(levels), "severity is unknown"),
        F.when(F.col("__cited").isNull(), "evidence is not cited"),
        F.when(many, "too many findings"),
    ]
    return rows.withColumn("errors", F.array_compact(F.array(*checks))).drop("__cited")

"""Changes: what a diff's files are, what covers them, and what a change of a kind must bring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.operators import code, joins, ranking
from assaykit.operators.metrics import ratio

#: Least commits of a share over history, and signals and pairs that a proposal lists at most.
LEAST_COMMITS, SIGNALS, PAIRS = 20, 20, 50


def changed_files(parsed: DataFrame) -> DataFrame:
    """(path, old_path, status, kind): the files of a diff's rows; kind is test, source or null."""
    return parsed.select("path", "old_path", "status").distinct().withColumn("kind", code.code_kind(F.col("path")))


def unpaired(sources: DataFrame, pairs: DataFrame) -> DataFrame:
    """(n, without, share): sources (path) that no pair (path, test) has."""
    found = sources.select("path").distinct().join(pairs.select("path").distinct().withColumn("there", F.lit(1)), "path", "left")
    bare = F.count_if(F.col("there").isNull())
    return found.agg(F.count("*").alias("n"), bare.alias("without"), ratio(bare, F.count("*")).alias("share"))


def kind_rules(changed: DataFrame, in_change: DataFrame, in_corpus: DataFrame) -> DataFrame:
    """One row: what each kind of change is rated by. in_change: pairs (path, test) of changed sources and
    changed tests; in_corpus: those of changed sources and any test."""
    sources = changed.where("kind = 'source' and status <> 'deleted'")
    tests = changed.where("kind = 'test'")
    new, old = unpaired(sources, in_change), unpaired(sources, in_corpus)
    matched = in_change.join(sources.select("path"), "path", "left_semi").agg(F.countDistinct("test").alias("m"))
    gone = tests.agg(F.count_if(F.col("status") == "deleted").alias("gone"))
    row = new.crossJoin(old.select(F.col("share").alias("old_share"))).crossJoin(matched).crossJoin(gone)  # one row each
    some = F.col("n") > 0
    return row.select(
        F.when(some, F.col("m")).alias("bugfix_without_regression_test"),
        F.when(some, F.col("share")).alias("new_code_without_test_share"),
        F.col("gone").alias("refactor_tests_deleted"),
        F.when(some, F.col("old_share")).alias("refactor_uncovered_share"),
        F.col("n").alias("sources"),
    )


def enough_history(commit_files: DataFrame, least: int = LEAST_COMMITS) -> bool:
    """Whether there are commits enough to rank files by."""
    return commit_files.select("sha").distinct().limit(least).count() >= least


def hotspots(commit_files: DataFrame) -> DataFrame:
    """(path, commits): the first tenth of files by commits, then path. commit_files: sha, path."""
    churn = commit_files.distinct().groupBy("path").agg(F.count("*").alias("commits"))
    return ranking.first_share(churn, [F.desc("commits"), F.col("path")]).select("path", "commits")


def hotspot_share(changed: DataFrame, hot: DataFrame) -> DataFrame:
    marked = changed.select("path").distinct().join(hot.select("path").withColumn("hot", F.lit(1)), "path", "left")
    return marked.agg(F.count("*").alias("n"), F.count("hot").alias("hot"), ratio(F.count("hot"), F.count("*")).alias("share"))


def share_of_commits(commits: DataFrame, condition: Column, least: int = LEAST_COMMITS) -> DataFrame:
    """(n, found, share); null under ``least`` commits."""
    n, found = F.count("*"), F.count_if(condition)
    return commits.agg(n.alias("n"), found.alias("found"), F.when(n >= least, ratio(found, n)).alias("share"))


def high_reach(edges: DataFrame, sources: int, least: int = 3) -> DataFrame:
    """(dst, fan_in): the tenth of ``sources`` files with the most importers, ties at the cut included."""
    return ranking.top_with_ties(joins.fan_in(edges).where(F.col("fan_in") >= least), "fan_in", -(-sources // 10))

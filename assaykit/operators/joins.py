"""Joins between files, tests, imports, commits and text, all on equal keys."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions import text as T


def expected_tests(sources: DataFrame, templates: dict[str, list[str]], path: str = "path") -> DataFrame:
    """(path, test_name, same_dir): the test names that a source's suffix asks for.

    A template has ``{stem}`` and ``{ext}``; one that starts with ``./`` holds in the source's own
    directory only.
    """
    rows = [(s, t.removeprefix("./"), t.startswith("./")) for s, ts in templates.items() for t in ts]
    table = sources.sparkSession.createDataFrame(rows, "suffix string, template string, same_dir boolean")
    named = F.replace(F.replace(F.col("template"), F.lit("{stem}"), T.stem(F.col(path))), F.lit("{ext}"), F.ltrim(F.regexp_replace("suffix", r"^\.", "")))
    return sources.withColumn("suffix", T.suffix(F.col(path))).join(F.broadcast(table), "suffix").select(F.col(path).alias("path"), named.alias("test_name"), "same_dir")


def project_boundary(files: DataFrame, manifests: DataFrame, layout: list[str], path: str = "path") -> DataFrame:
    """files with ``project``: the longer of the path before the first layout segment and the deepest
    directory above it that holds a manifest. Ancestors are exploded, so the join has equal keys."""
    cut = F.regexp_extract(F.concat(F.lit("/"), F.col(path)), "^(.*?)/(?:" + "|".join(map(re.escape, layout)) + ")/", 1)
    dirs = manifests.select(T.parent(F.col(path)).alias("__dir")).distinct()
    up = files.select(F.col(path).alias("__path"), F.explode(T.ancestors(F.col(path))).alias("__dir")).join(dirs, "__dir")
    deepest = up.groupBy("__path").agg(F.max_by("__dir", F.length("__dir")).alias("__deep"))
    own = F.regexp_replace(cut, "^/", "")
    out = files.join(deepest, F.col(path) == F.col("__path"), "left")
    return out.withColumn("project", F.when(F.length(F.coalesce("__deep", F.lit(""))) > F.length(own), F.col("__deep")).otherwise(own)).drop("__path", "__deep")


def correspondence(expected: DataFrame, tests: DataFrame) -> DataFrame:
    """(path, test): sources and tests by expected name within one project. expected: path, test_name,
    same_dir, project; tests: path, project."""
    t = tests.select(F.col("path").alias("test"), T.base_name(F.col("path")).alias("test_name"), "project")
    both = expected.join(t, ["test_name", "project"])
    return both.where(~F.col("same_dir") | (T.parent(F.col("path")) == T.parent(F.col("test")))).select("path", "test").distinct()


def uncovered(sources: DataFrame, pairs: DataFrame, key: str = "path") -> DataFrame:
    return sources.join(pairs, key, "left_anti")


def unique_owners(names: DataFrame, name: str = "name", owner: str = "owner") -> DataFrame:
    """Names that exactly one owner holds."""
    return names.groupBy(name).agg(F.min(owner).alias(owner), F.max(owner).alias("__max")).where(F.col(owner) == F.col("__max")).drop("__max")


def fan_in(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """(dst, fan_in): distinct sources of each target, itself left out. Two steps of counting, so a
    target that a third of all rows point to is pre-aggregated before its key is dealt."""
    once = edges.where(F.col(source) != F.col(target)).select(source, target).distinct()
    return once.groupBy(target).agg(F.count("*").alias("fan_in"))


def prefix_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(importer, path): files that stand directly in a directory that an import names. imports:
    importer, prefix; files: path."""
    wanted = imports.select("importer", F.regexp_replace("prefix", "^\\./|/+$", "").alias("__dir"))
    return wanted.join(files.select("path", T.parent(F.col("path")).alias("__dir")), "__dir").where("importer <> path").select("importer", "path").distinct()


def token_lines(lines: DataFrame, tokens: DataFrame, pattern: str = "[A-Za-z0-9_]+") -> DataFrame:
    """(path, line_no, token, owner): lines that hold a token of another path. tokens: token, owner."""
    words = lines.select("path", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(pattern), F.lit(0)))).alias("token"))
    return words.join(tokens, "token").where("path <> owner").select("path", "line_no", "token", "owner")


def co_change(commit_files: DataFrame, seeds: DataFrame, commit: str = "sha", path: str = "path") -> DataFrame:
    """(path, n): files outside the seeds by the number of commits that they share with any seed."""
    touched = commit_files.join(seeds, path, "left_semi").select(commit).distinct()
    return commit_files.join(touched, commit, "left_semi").join(seeds, path, "left_anti").select(commit, path).distinct().groupBy(path).agg(F.count("*").alias("n"))


def resolve_roles(files: DataFrame, roles: dict[str, list[str]], cap: int = 50, path: str = "path") -> DataFrame:
    """(role, path): files by glob, at most ``cap`` a role, the shallowest first, then by path.

    Each file is matched against the roles' combined patterns in one projection: no join.
    """
    from pyspark.sql import Window

    hits: list[Column] = [F.when(F.col(path).rlike(T.any_glob(globs)), F.lit(role)) for role, globs in sorted(roles.items())]
    found = files.select(F.col(path).alias("path"), F.explode(F.array_compact(F.array(*hits))).alias("role"))
    slashes = F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))
    w = Window.partitionBy("role").orderBy(slashes, "path")
    return found.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= cap).select("role", "path")


def roles_of(path: Column, roles: dict[str, tuple[str, ...]]) -> Column:
    """The roles whose globs fit a path, in the order of ``roles``."""
    return F.array_compact(F.array(*(F.when(path.rlike(T.any_glob(globs)), F.lit(role)) for role, globs in roles.items())))

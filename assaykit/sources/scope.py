"""Scopes: which files an evaluation is of. Git is asked read-only, without a shell, on the driver; its
answers are names and one diff, and become rows."""

from __future__ import annotations

import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions import text as T
from assaykit.operators import domain, ranking
from assaykit.operators.facts import lines_of

#: The tree without a file, which a first commit is compared with.
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
#: Characters of a file's part of a diff from which on it is marked as clipped where it is quoted.
DIFF_LIMIT = 200_000
#: Most documents, and the limits of the code index.
DOCUMENTS, INDEX_FILES, INDEX_BYTES, FILE_BYTES = 200, 5_000, 50 << 20, 1 << 20
#: Directories of other people's code by name.
THIRD_PARTY = r"(?:^|/)(?:third[_-]?party|vendor|vendors|vendored|external|externals|node_modules|bower_components|Godeps/_workspace)/"


def git(repo: str, *args: str, timeout: int = 120) -> str | None:
    """What git says, or null where it fails; the user's configuration and prompts are kept out."""
    env = {"PATH": os.environ.get("PATH", ""), "GIT_CONFIG_NOSYSTEM": "1", "GIT_CONFIG_GLOBAL": os.devnull, "GIT_TERMINAL_PROMPT": "0", "LC_ALL": "C"}
    try:
        said = subprocess.run(["git", "-c", "core.quotepath=off", "-c", "core.fsmonitor=false", "-C", repo, *args], capture_output=True, timeout=timeout, env=env, stdin=subprocess.DEVNULL)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return said.stdout.decode("utf-8", "replace") if said.returncode == 0 else None


def normal_range(repo: str, ref: str) -> str | None:
    """A range of commits: a single one is compared with its parent, a first one with the empty tree. Null
    for what git doesn't know, and for anything that could be an option."""
    if not ref or ref.startswith("-") or any(c.isspace() for c in ref):
        return None
    if ".." in ref:
        return ref if all(git(repo, "rev-parse", "--verify", "--quiet", f"{p.strip('.') or 'HEAD'}^{{commit}}") for p in ref.split("..", 1)) else None
    commit = git(repo, "rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}")
    if commit is None:
        return None
    parent = git(repo, "rev-parse", "--verify", "--quiet", f"{ref}^")
    return f"{(parent or EMPTY_TREE).strip()}..{commit.strip()}"


def changes(spark: SparkSession, repo: str, ref: str) -> tuple[DataFrame, DataFrame]:
    """(paths, diffs) of a range: (path) and (diff_id, diff, clipped), a row a file of the diff, whole. An
    unknown range is an error."""
    span = normal_range(repo, ref)
    if span is None:
        raise ValueError(f"no such range: {ref}")
    a, _, b = span.partition("..")
    names = (git(repo, "diff", "--name-only", "-z", "--no-renames", a, b) or "").split("\0")
    diff = git(repo, "diff", "--no-ext-diff", "--no-textconv", "-M", a, b) or ""
    paths = spark.createDataFrame([(n,) for n in names if n], "path string")
    return paths, diff_rows(spark, span, diff)


def diff_rows(spark: SparkSession, name: str, diff: str) -> DataFrame:
    parts = re.split(r"(?m)^(?=diff --git )", diff)
    return spark.createDataFrame([(name, p, len(p) > DIFF_LIMIT) for p in parts if p], "diff_id string, diff string, clipped boolean")


def worktree_changes(spark: SparkSession, repo: str) -> tuple[DataFrame, DataFrame]:
    """(paths, diffs) of what is not committed: staged and changed files as a diff, untracked ones by path."""
    paths = worktree(spark, repo).select("path")
    return paths, diff_rows(spark, "worktree", git(repo, "diff", "--no-ext-diff", "--no-textconv", "-M", "HEAD") or "")


def worktree(spark: SparkSession, repo: str) -> DataFrame:
    """(path, state) of files that are staged, changed or untracked; the new name of a renamed one."""
    rows, said = [], iter((git(repo, "status", "--porcelain=v1", "-z", "--untracked-files=all") or "").split("\0"))
    for entry in said:
        if entry:
            state, path = entry[:2], entry[3:]
            if state[0] in "RC":
                next(said, None)  # the old name
            rows.append((path, "untracked" if state == "??" else "staged" if state[1] == " " else "changed"))
    return spark.createDataFrame(rows, "path string, state string")


def ignored(spark: SparkSession, repo: str) -> DataFrame:
    """(path): files and directories, with a slash at the end, that git is told to ignore."""
    said = git(repo, "ls-files", "--others", "--ignored", "--exclude-standard", "--directory", "-z") or ""
    return spark.createDataFrame([(p,) for p in said.split("\0") if p], "path string")


def without_ignored(files: DataFrame, ignored_paths: DataFrame) -> DataFrame:
    """files less ignored ones and those below an ignored directory, by equal keys of all ancestors."""
    marks = ignored_paths.select(F.regexp_replace("path", "/$", "").alias("__at")).distinct()
    own = files.select("path", F.explode(F.array_union(T.ancestors(F.col("path")), F.array("path"))).alias("__at"))
    return files.join(own.join(marks, "__at", "left_semi").select("path").distinct(), "path", "left_anti")


def task(files: DataFrame, task_id: str) -> tuple[DataFrame, DataFrame]:
    """(guide, criteria) of a task: the file that guides it, and rows of acceptance criteria in it."""
    safe = "".join(c for c in task_id if c.isalnum() or c in "_-")
    guide = files.where(T.base_name(F.col("path")).rlike(rf"^TASK_GUIDE_{safe}\.md$") & F.array_contains(F.split("path", "/"), "tasks"))
    return guide, domain.criteria(lines_of(guide))


def third_party(files: DataFrame, declared: list[str] = ()) -> DataFrame:
    """(path, root, why) of other people's code: declared globs, git attributes (the deepest file, then the
    last line wins), directories by name, and directories below the top that hold both a licence and a
    notice. The outermost root counts."""
    paths = files.select("path")
    up = paths.select("path", F.explode(F.filter(T.ancestors(F.col("path")), lambda a: a != "")).alias("root"))
    glob = "|".join(map(T.glob_regex, declared)) or "(?!)"
    by_glob = paths.where(F.col("path").rlike(glob)).select("path", F.col("path").alias("root"), F.lit("declared").alias("why"))
    by_name = up.where(F.concat("root", F.lit("/")).rlike(THIRD_PARTY + "$")).select("path", "root", F.lit("name").alias("why"))
    name = F.upper(T.stem(F.col("path")))
    holds = paths.where(T.parent(F.col("path")) != "").groupBy(T.parent(F.col("path")).alias("root")).agg(F.max(name.rlike("^(?:LICEN[SC]E|COPYING)")).alias("a"), F.max(name.rlike("^NOTICE")).alias("b")).where("a and b").select("root")
    by_notice = up.join(holds, "root", "left_semi").select("path", "root", F.lit("licence and notice").alias("why"))
    told = attributes(files)
    vendored = told.where("vendored").select("path", F.col("path").alias("root"), F.lit("attributes").alias("why"))
    every = by_glob.unionAll(by_name).unionAll(by_notice).unionAll(vendored)
    own = told.where("not vendored").select("path")
    return every.join(own, "path", "left_anti").groupBy("path").agg(F.min(F.struct(F.length("root").alias("n"), "root", "why")).alias("m")).select("path", "m.root", "m.why")


def attributes(files: DataFrame) -> DataFrame:
    """(path, vendored): what .gitattributes say of files. A rule is a pattern in its directory."""
    said = files.where(T.base_name(F.col("path")) == ".gitattributes").select(T.parent(F.col("path")).alias("dir"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    rules = said.select("dir", "n", F.regexp_extract("line", r"^\s*([^\s#]+)\s", 1).alias("pattern"), F.regexp_extract("line", r"\s(-?)linguist-vendored(=false)?(?:\s|$)", 0).alias("hit")).where("pattern <> '' and hit <> ''")
    rows = rules.select("dir", "n", "pattern", (~F.col("hit").rlike("-linguist|=false")).alias("vendored")).collect()  # one row a rule of a repository
    out = files.select("path", F.lit(None).cast("boolean").alias("vendored"))
    for r in sorted(rows, key=lambda r: (r.dir.count("/") + bool(r.dir), r.n)):
        inner = r.pattern.lstrip("/")
        glob = f"{r.dir + '/' if r.dir else ''}{'' if '/' in r.pattern.rstrip('/') else '**/'}{inner}"
        glob += "**" if glob.endswith("/") else ""
        out = out.withColumn("vendored", F.when(F.col("path").rlike(T.glob_regex(glob)), r.vendored).otherwise(F.col("vendored")))
    return out.where("vendored is not null")


def documents(files: DataFrame, most: int = DOCUMENTS) -> DataFrame:
    """(path, rank): documents in order of what they are, then path, at most so many."""
    low = F.lower("path")
    rank = F.when(T.base_name(low).startswith("readme"), 0).when(low.rlike(r"(?:^|/)docs?/"), 1).when(low.rlike(r"(?:^|/)(?:adrs?|decisions)/"), 2).when(T.base_name(low).startswith("contributing"), 3)
    text = low.rlike(r"\.(?:md|rst|adoc|txt)$") | T.base_name(low).startswith("readme")
    return files.select("path", rank.alias("rank")).where(F.col("rank").isNotNull() & text).orderBy("rank", "path").limit(most)


def code_index(files: DataFrame, order: list) -> DataFrame:
    """Source and test files up to the index's limits, in order, to before the first that overflows; one
    that is too large by itself is left out. files: path, kind, size and what the order needs."""
    fit = files.where(F.col("kind").isNotNull() & (F.col("size") <= FILE_BYTES))
    placed = ranking.in_order(fit, order, F.col("size").cast("bigint"))
    return placed.where((F.col("__running") <= INDEX_BYTES) & (F.col("__rank") <= INDEX_FILES)).drop("__running", "__rank")


class IndexCache:
    """The checkpointed index of the last sets of files, told apart by paths, sizes and, where there are any,
    texts; the oldest goes first."""

    def __init__(self, most: int = 4):
        self.held: dict[tuple, DataFrame] = {}
        self.most = most

    def of(self, files: DataFrame, order: list) -> DataFrame:
        digest = F.xxhash64(*(c for c in ("path", "size", "text") if c in files.columns))
        row = tuple(files.agg(F.count("*"), F.bit_xor(digest), F.sum(digest.cast("decimal(38,0)"))).first())
        if row not in self.held:
            self.held[row] = code_index(files, order).checkpoint()
            while len(self.held) > self.most:
                del self.held[next(iter(self.held))]
        return self.held[row]

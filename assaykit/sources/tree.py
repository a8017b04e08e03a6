"""A directory as a data source: ``spark.read.format("tree").load(root)``.

Directories near the root are the partitions, and tasks list and read what is below them; the driver lists only
these. Globs reach the listing, so directories that no wanted path is below are not entered and nothing else is
opened. They are an option and not pushed down from filters: Spark takes scans of one source for equal
whatever was pushed into them, and would reuse the one for the other. The directory has to be on a file system
that all executors see.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from assaykit.functions.ship import ship
from assaykit.functions.text import glob_regex
from assaykit.sources import scope
from assaykit.sources.corpus import EXCLUDED_DIRS, SECRET_NAMES

SCHEMA = "path string, text string, size bigint, read_status string"
MAX_BYTES = 1_000_000


class Part(InputPartition):
    def __init__(self, at: str, deep: bool):
        self.at, self.deep = at, deep


class Reader(DataSourceReader):
    """Rows of one directory, or of all below it. A link is left out, and so is what it leads to; a file that
    holds secrets by its name is never opened; one too large, or not UTF-8, has a status and no text."""

    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.most = int(options.get("maxbytes", MAX_BYTES))
        self.levels = int(options.get("levels", 2))
        self.refused = re.compile("|".join(map(glob_regex, SECRET_NAMES)))
        self.skipped = frozenset(options.get("ignored", "").split("\n")) - {""}
        globs = [g for g in options.get("globs", "").split("\n") if g]
        self.globs = re.compile("|".join(map(glob_regex, globs))) if globs else None
        self.heads = [re.match(r"[^*?]*", g)[0] for g in globs] or [""]

    def _wanted(self, path: str) -> bool:
        return self.globs is None or self.globs.search(path) is not None

    def _leads(self, directory: str) -> bool:
        """Whether a wanted path may be below a directory (with a slash at its end, or empty for the root), by
        what globs begin with."""
        return any(v.startswith(directory) or directory.startswith(v) for v in self.heads)

    def _open_to(self, name: str, path: str, full: str) -> bool:
        return name not in EXCLUDED_DIRS and f"{path}/" not in self.skipped and not os.path.islink(full) and self._leads(f"{path}/")

    def partitions(self):
        if not os.path.isdir(self.root):
            raise ValueError(f"no such directory: {self.root}")
        parts, level = [], [""]
        for depth in range(self.levels + 1):
            below = []
            for at in level:
                parts.append(Part(at, depth == self.levels))
                if depth < self.levels:
                    with os.scandir(os.path.join(self.root, at)) as found:
                        below += sorted(p for e in found if e.is_dir(follow_symlinks=False) and self._open_to(e.name, p := os.path.join(at, e.name), e.path))
            level = below
        return parts

    def read(self, part):
        for at, dirs, names in os.walk(os.path.join(self.root, part.at)):
            here = os.path.relpath(at, self.root).replace(os.sep, "/")
            prefix = "" if here == "." else f"{here}/"
            dirs[:] = sorted(d for d in dirs if self._open_to(d, prefix + d, os.path.join(at, d))) if part.deep else []
            for name in sorted(names):
                path, full = prefix + name, os.path.join(at, name)
                if path in self.skipped or not self._wanted(path) or os.path.islink(full) or not os.path.isfile(full):
                    continue
                yield (path, *self._text(path, full))

    def _text(self, path: str, full: str):
        try:
            size = os.path.getsize(full)
            if self.refused.search(path):
                return None, size, "secret-bearing"
            if size > self.most:
                return None, size, "too large"
            with open(full, "rb") as f:
                return f.read(self.most + 1).decode("utf-8"), size, "read"
        except UnicodeDecodeError:
            return None, size, "not utf-8"
        except OSError:
            return None, None, "not readable"


class Tree(DataSource):
    """Options: globs of the paths that are wanted, one a line; maxBytes, of a file that is read; levels of directories that are partitions of their own;
    ignored, paths (directories with a slash at the end) that are left out, one a line."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(Tree)


def repository(spark: SparkSession, root: str, declared: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(files, others): a repository's own files and other people's (path, root, why). What git is told to
    ignore is not listed; ``declared`` globs are other people's too."""
    register(spark)
    said = scope.git(root, "ls-files", "--others", "--ignored", "--exclude-standard", "--directory", "-z") or ""
    files = spark.read.format("tree").option("ignored", "\n".join(p for p in said.split("\0") if p)).load(root)
    others = scope.third_party(files, list(declared))
    return files.join(others.select("path"), "path", "left_anti"), others

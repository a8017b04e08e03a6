"""Corpora as rows: directories, tables, git history, rule files; and the sinks."""

from __future__ import annotations

import json
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions.ship import map_batches

#: Directories and file names that are never read.
EXCLUDED_DIRS = (".git", "node_modules", "vendor", "__pycache__", ".venv", "dist", "build", "target")
SECRET_NAMES = ("**/.env", "**/*.pem", "**/*.key", "**/id_rsa*", "**/*.p12", "**/*.pfx", "**/.npmrc", "**/.netrc")


def files(spark: SparkSession, root: str, max_bytes: int = 1_000_000, per_task: int = 200) -> DataFrame:
    """(path, text, size, read_status) of a directory on a shared file system.

    The names are listed once (Spark's own listing leaves out names that start with a dot) and tasks
    read the files. Excluded directories and links are left out; files that hold secrets by name,
    that are too large or that are not UTF-8 have a status instead of text. Secret-bearing files are
    never opened.
    """
    import os

    from assaykit.functions.text import glob_regex

    listed = []
    for at, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in EXCLUDED_DIRS and not os.path.islink(os.path.join(at, d)))
        full = [os.path.join(at, n) for n in sorted(names)]
        listed += [(os.path.relpath(f, root), os.path.getsize(f)) for f in full if os.path.isfile(f) and not os.path.islink(f)]
    rows = spark.createDataFrame(listed, "path string, size bigint").repartition(max(1, len(listed) // per_task))
    refused = F.when(F.col("path").rlike("|".join(map(glob_regex, SECRET_NAMES))), "secret-bearing").when(F.col("size") > max_bytes, "too large")

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            texts, status = [], []
            for path, why in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                text = None
                if why is None:
                    try:
                        with open(os.path.join(root, path), encoding="utf-8", newline="") as f:
                            text, why = f.read(), "read"
                    except UnicodeDecodeError:
                        why = "not utf-8"
                    except OSError:
                        why = "not readable"
                texts.append(text)
                status.append(why)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(1), pa.array(status, pa.string())], names=["path", "text", "size", "read_status"])

    return map_batches(rows.withColumn("why", refused), read, "path string, text string, size bigint, read_status string")


def documents_as_files(docs: DataFrame) -> DataFrame:
    """The table of documents as files under source and language."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md")))
    return docs.select(path.alias("path"), "text", F.octet_length("text").cast("long").alias("size"), F.lit("read").alias("read_status"))


def git_history(spark: SparkSession, repo: str, last: int = 400, merges: bool = True) -> tuple[DataFrame, DataFrame]:
    """(commits, commit_files) of the last commits: seq, sha, message, is_merge; and sha, path. One
    read-only git call without a shell."""
    out = subprocess.run(["git", "-C", repo, "log", f"-n{last}", *([] if merges else ["--no-merges"]), "--name-only", "-z", "--format=%x01%H%x02%P%x02%s%x02"], capture_output=True, timeout=120, check=True, env={"PATH": "/usr/bin:/bin", "GIT_CONFIG_NOSYSTEM": "1", "GIT_OPTIONAL_LOCKS": "0", "HOME": "/nonexistent"})  # noqa: S603, S607
    commits, touched = [], []
    for i, block in enumerate(out.stdout.decode("utf-8", "replace").split("\x01")[1:]):
        sha, parents, subject, names = block.split("\x02", 3)
        commits.append((i, sha, subject, len(parents.split()) > 1))
        touched += [(sha, n.strip("\n")) for n in names.split("\0") if n.strip("\n")]
    return spark.createDataFrame(commits, "seq int, sha string, message string, is_merge boolean"), spark.createDataFrame(touched, "sha string, path string")


def registry(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """(entry, field, value, citation_url, source_tag) of rule files in TOML, by entry name. A value
    without a citation is an error; all errors are told at once."""
    import tomllib

    rows, errors = [], []
    for entry, text in sorted(texts.items()):
        for field, blocks in tomllib.loads(text).items():
            for b in blocks if isinstance(blocks, list) else []:
                if not isinstance(b, dict) or not b.get("value") or not b.get("citation_url") or not b.get("source_tag"):
                    errors.append(f"{entry}.{field}: value, citation_url and source_tag are needed")
                    continue
                values = b["value"] if isinstance(b["value"], list) else [b["value"]]
                rows += [(entry, field, str(v), b["citation_url"], b["source_tag"]) for v in values]
    if errors:
        raise ValueError("; ".join(errors))
    return spark.createDataFrame(rows, "entry string, field string, value string, citation_url string, source_tag string")


def agent_input(text: str) -> dict:
    """A saved answer document, with unknown keys refused."""
    known = {"picks", "gate_evaluations", "registry_entries", "reviews", "packs", "batches", "change_kind", "test_pairs"}
    document = json.loads(text)
    if not isinstance(document, dict) or set(document) - known:
        raise ValueError(f"unknown keys: {sorted(set(document) - known) if isinstance(document, dict) else document}")
    return document


def write_json(rows: DataFrame, at: str) -> None:
    """One JSON object a row, null fields left out; never over an earlier result."""
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value")).write.mode("errorifexists").text(at)


def write_report(title: str, tables: dict[str, DataFrame], at: str, most: int = 200) -> None:
    """A self-contained HTML page of small result tables; never over an earlier one. A report is a
    summary: each table shows its first rows and says so."""
    import html

    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows[:most])
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>" + ("<p>First rows only.</p>" if len(rows) > most else ""))
    with open(at, "x", encoding="utf-8") as f:
        f.write("".join(parts) + "</body></html>")

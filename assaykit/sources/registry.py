"""The registry: pattern data of languages as rows, from rule files that a caller can add to.

A rule file is TOML: one list of tokens by field, named after its language. Files of a further folder
add to what is there and take nothing away.
"""

from __future__ import annotations

import functools
import os
import tomllib
from importlib import resources
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.sources import patterns as P

#: The package's own rule files. Workers import it from an archive, where nothing is a file by itself.
FOLDER = resources.files("assaykit.sources").joinpath("registry")
#: Fields whose values are key=token.
KEYED = ("sinks", "concat_sinks", "routes")
SCHEMA = "language string, field string, position int, value string, key string, entry string"


def _read(folder) -> dict[str, dict[str, list[str]]]:
    """Tokens by language and field of a folder's rule files."""
    files = sorted((f for f in folder.iterdir() if f.name.endswith(".toml")), key=lambda f: f.name)
    return {f.name.removesuffix(".toml"): tomllib.loads(f.read_text(encoding="utf-8")) for f in files}


@functools.cache
def fields(folder: str | None = None) -> dict[str, dict[str, tuple[str, ...]]]:
    """Tokens by language and field: this package's, and those of ``folder`` beside them."""
    out: dict[str, dict[str, tuple[str, ...]]] = {k: dict(v) for k, v in P.TOKENS.items()}
    for language, sinks in P.SINKS.items():
        out[language]["sinks"] = tuple(f"{cwe}={token}" for cwe, token in sinks)
    for at in (FOLDER, *([Path(folder)] if folder else [])):
        for language, found in _read(at).items():
            own = out.setdefault(language, {})
            for field, values in found.items():
                if not isinstance(values, list) or not all(isinstance(v, str) and v.strip() for v in values):
                    raise ValueError(f"{language}.{field}: a list of tokens is expected")
                own[field] = (*own.get(field, ()), *(v for v in values if v not in own.get(field, ())))
    return out


def tokens(field: str, folder: str | None = None) -> dict[str, tuple[str, ...]]:
    """Tokens of a field by language, of the languages that have any."""
    return {k: v[field] for k, v in fields(folder).items() if v.get(field)}


def load(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """The registry as rows; key is what stands before = in keyed fields, entry an id by content."""
    rows = []
    for language, found in sorted(fields(folder).items()):
        for field, values in sorted(found.items()):
            for i, v in enumerate(values):
                key, eq, token = v.partition("=") if field in KEYED else ("", "", v)
                rows.append((language, field, i, token, key or None, None))
    out = spark.createDataFrame(rows, SCHEMA)
    digest = F.substring(F.sha2(F.concat_ws("\x1f", "language", "field", F.coalesce("key", F.lit("")), "value"), 256), 1, 12)
    return out.withColumn("entry", F.concat_ws(".", "language", "field", digest))


def merge(language: DataFrame, frameworks: DataFrame) -> DataFrame:
    """Entries of a language and of frameworks, which add and never take away."""
    key = ["language", "field", "key", "value"]
    both = language.select(*key, F.lit(0).alias("rank"), "position").unionAll(frameworks.select(*key, F.lit(1).alias("rank"), "position"))
    return both.groupBy(*key).agg(F.min(F.struct("rank", "position")).alias("at")).select(*key)


def missing(registry: DataFrame, wanted: DataFrame, most: int = 20) -> DataFrame:
    """(language, field): what ``wanted`` (language, field) asks for and no entry has, at most so many."""
    have = registry.select("language", "field").distinct()
    return wanted.select("language", "field").distinct().join(have, ["language", "field"], "left_anti").orderBy("language", "field").limit(most)


def problems(entries: DataFrame, known_fields: list[str]) -> DataFrame:
    """entries (language, field, value) with ``errors``, all of them at once."""
    checks = [
        F.when(~F.coalesce(F.col("language").rlike("^[a-z][a-z0-9-]*$"), F.lit(False)), "language is no name"),
        F.when(~F.coalesce(F.col("field").isin(known_fields), F.lit(False)), "field is unknown"),
        F.when(F.coalesce(F.trim("value"), F.lit("")) == "", "value is empty"),
        F.when(F.length("value") > 200, "value is too long"),
    ]
    return entries.withColumn("errors", F.array_compact(F.array(*checks)))


def save(entries: list[tuple[str, str, str]], folder: str) -> None:
    """Adds (language, field, value) to the rule files of a folder; each file is replaced at once."""
    known = _read(Path(folder)) if os.path.isdir(folder) else {}
    os.makedirs(folder, exist_ok=True)
    for language in sorted({e[0] for e in entries}):
        own = {k: list(v) for k, v in known.get(language, {}).items()}
        for _, field, value in (e for e in entries if e[0] == language):
            if value not in own.setdefault(field, []):
                own[field].append(value)
        quoted = lambda v: '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
        at = os.path.join(folder, f"{language}.toml")
        with open(f"{at}.new", "w", encoding="utf-8") as f:
            f.writelines(f"{field} = [{', '.join(map(quoted, values))}]\n" for field, values in sorted(own.items()))
        os.replace(f"{at}.new", at)
    fields.cache_clear()

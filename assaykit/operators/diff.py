"""Unified diffs as rows. A diff is one document, so each is read line by line by itself: no line is dealt
out or sorted, and a task holds one diff and a piece of its rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.functions.ship import map_batches

#: Rows that a task holds before they leave it.
ROWS = 20_000
#: What ends a line for a name, besides the line feeds that lines are split at.
_REST, _END = "[^\r\u0085\u2028\u2029]*", "[\r\u0085\u2028\u2029]?\\Z"
#: Names in a file's head, the first that is there counts: (old, new).
NAMES = tuple(
    tuple(re.compile(p.replace("~", _REST) + _END) for p in side)
    for side in (("rename from (~)", "--- a/(~)", "diff --git a/(~) b/~"), ("rename to (~)", r"\+\+\+ b/(~)", "diff --git a/~ b/(~)"))
)
HUNK = re.compile(r"@@ -(\d+)(?:,\d+)?(?: \+(\d+))?")


def rows_of(text: str) -> Iterator[tuple]:
    """(path, old_path, status, hunk, sign, line_no, text) of a diff, in order."""
    names: list[list[str | None]] | None = None
    told: tuple = ()
    added = gone = False
    hunk, old, new = 0, None, None
    for raw in text.split("\n"):
        if raw.startswith("diff --git "):
            names, added, gone, hunk = [[None] * 3, [None] * 3], False, False, 0
        if names is None:
            continue
        if raw.startswith("@@ "):
            if not hunk:
                was, path = (next((n for n in side if n is not None), None) for side in names)
                told = (path, was, "added" if added else "deleted" if gone else "renamed" if was is not None and path is not None and was != path else "modified")
            hunk += 1
            at = HUNK.match(raw)
            old, new = (int(x) if x else None for x in at.groups()) if at else (None, None)
        elif not hunk:
            for side, patterns in zip(names, NAMES):
                for k, p in enumerate(patterns):
                    if (m := p.match(raw)) and (side[k] is None or m[1] > side[k]):
                        side[k] = m[1]
            added, gone = added or raw.startswith("new file"), gone or raw.startswith("deleted file")
        elif (sign := raw[:1]) in ("+", "-", " ") and sign:
            yield (*told, hunk, sign, old if sign == "-" else new, raw[1:])
            old = old + 1 if old is not None and sign != "+" else old
            new = new + 1 if new is not None and sign != "-" else new


def parse(diffs: DataFrame, key: str = "diff_id", text: str = "diff") -> DataFrame:
    """(key, path, old_path, status, hunk, sign, line_no, text): the changed and context lines.

    line_no counts in the new file, for removed lines in the old one; it is null in a hunk whose head has no
    numbers. status is added, deleted, renamed or modified.
    """
    kind = diffs.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())

        def made(batch, at, rows):
            columns = list(zip(*rows)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["key", "path", "old_path", "status", "hunk", "sign", "line_no", "text"])

        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(1)):
                for row in rows_of(t.as_py() or ""):
                    at.append(i)
                    rows.append(row)
                    if len(rows) >= ROWS:
                        yield made(batch, at, rows)
                        at, rows = [], []
            yield made(batch, at, rows)

    found = map_batches(diffs.select(F.col(key).alias("key"), F.col(text).alias("diff")), run, f"key {kind}, path string, old_path string, status string, hunk bigint, sign string, line_no bigint, text string")
    return found.withColumnRenamed("key", key)


def removed_symbols(parsed: DataFrame, declaration: str, group: int = 1) -> DataFrame:
    """(path, symbol): names declared on removed lines and on no added line of any file."""
    names = parsed.where("sign <> ' '").withColumn("symbol", F.regexp_extract("text", declaration, group)).where("symbol <> ''")
    return names.where("sign = '-'").select("path", "symbol").distinct().join(names.where("sign = '+'").select("symbol").distinct(), "symbol", "left_anti").select("path", "symbol")


def drop_paths(parsed: DataFrame, paths: DataFrame) -> DataFrame:
    return parsed.join(paths.select("path").distinct(), "path", "left_anti")

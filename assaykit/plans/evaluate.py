"""An evaluation of a repository: its scope, its history, evidence packs of all units, and the score.

Everything that the operators offer is put to use here: ignored files and other people's code are left out,
the commits and a change reach the metrics, excerpts are redacted and packed within each unit's bytes before
anything is told of them, and optional units take part only when they are asked for.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions import text as T
from assaykit.operators import code, delivery, excerpts, facts, joins, lexer, markup, packs
from assaykit.plans import dimensions, measures
from assaykit.plans import score as plan
from assaykit.sources import corpus, scope, tree
from assaykit.sources.roles import CONTEXT, ROLES, SOUGHT

#: Units that are off unless a repository or a caller names them.
OPTIONAL = ("finance", "healthcare", "frontend-a11y")
#: A repository's own settings.
CONFIG = ".assaykit.toml"
SCOPES = ("project", "changes", "worktree", "task")


@dataclass
class Evaluation:
    """files: what is evaluated; others: other people's code; narrow: the scope's paths, null for all of the
    project; packs: what each unit may quote; score: what follows."""

    files: DataFrame
    others: DataFrame
    narrow: DataFrame | None
    packs: packs.Packs
    score: plan.Score


def settings_of(files: DataFrame) -> dict:
    """The repository's own settings: active_packs, third_party (globs), roles (globs by role). One that is no
    TOML, or has another field, is an error."""
    import tomllib

    row = files.where(F.col("path") == CONFIG).select("text").first()
    said = tomllib.loads(row.text or "") if row else {}
    if unknown := sorted(set(said) - {"active_packs", "third_party", "roles"}):
        raise ValueError(f"{CONFIG}: unknown fields: {', '.join(unknown)}")
    if odd := sorted(set(said.get("active_packs", ())) - set(OPTIONAL)):
        raise ValueError(f"{CONFIG}: unknown packs: {', '.join(odd)}")
    return said


def _hits(prepared: DataFrame) -> DataFrame:
    """(unit, path, line_no) of what units quote the lines around."""
    sources = prepared.where("kind = 'source'")
    lines, marked = measures._lines(sources), measures._lines(sources, "marked")
    texts = facts.lines_of(prepared.select("path", "text"))
    found = {
        "security": code.sink_hits(marked),
        "reliability": code.reliability(lines),
        "api": code.routes(measures._lines(sources, "text")),
        "operations": delivery.token_hits(lines, "logging"),
        "infrastructure": delivery.infrastructure_hits(texts.where(F.col("path").rlike("|".join(T.glob_regex(g) for r in ("terraform-file", "k8s-manifest", "cloud-template") for g in ROLES[r])))),
        "frontend-a11y": markup.checks(markup.markup_files(prepared)).where("state = 'hit'").withColumn("line_no", F.col("line")),
    }
    out = None
    for unit, rows in found.items():
        mine = rows.select(F.lit(unit).alias("unit"), "path", F.col("line_no").cast("int").alias("line_no")).distinct()
        out = mine if out is None else out.unionAll(mine)
    return out


def collected(prepared: DataFrame, names: list[str], roles: dict[str, tuple[str, ...]] = ROLES, narrow: DataFrame | None = None) -> DataFrame:
    """Excerpts (unit, path, start, stop, text, arrival) of units: the files of the roles that each seeks,
    clipped, in order of role and path; then lines around its hits, and for the quality of code its outermost
    functions. Files of context roles are read whatever the scope."""
    sought = [(u, r, i) for u in names for i, r in enumerate(SOUGHT.get(u, ()))]
    wanted = prepared.sparkSession.createDataFrame(sought, "unit string, role string, place int")
    text = prepared.where("text is not null").select("path", "text")
    filled = text.select("path", F.explode(joins.roles_of(F.col("path"), roles)).alias("role"))
    filled = excerpts.in_scope(filled, narrow, CONTEXT)
    quoted = filled.join(wanted, "role").join(text, "path").withColumn("text", excerpts.clip(F.col("text")))
    n = lambda c: F.size(F.split(c, "\n", -1))
    whole = quoted.select("unit", "path", F.lit(1).alias("start"), n("text").alias("stop"), "text", F.struct(F.lit(0).alias("stage"), "place", "path", F.lit(1).alias("line")).alias("order"))

    lines = facts.lines_of(text)
    inside = lambda rows: rows if narrow is None else rows.join(narrow.select("path").distinct(), "path", "left_semi")
    hits = inside(_hits(prepared)).where(F.col("unit").isin(names))
    # each unit's windows are islands of their own: the unit goes along in the key
    key = F.concat_ws("\x1f", "unit", "path")
    held = lines.join(hits.select("unit", "path").distinct(), "path").select(key.alias("path"), "line_no", "line")
    around = excerpts.quoted(hits.select(key.alias("path"), "line_no"), held)
    split = F.split("path", "\x1f")
    around = around.select(split[0].alias("unit"), split[1].alias("path"), "start", "stop", "text").withColumn("order", F.struct(F.lit(1).alias("stage"), F.lit(0).alias("place"), "path", F.col("start").alias("line")))
    bodies = inside(excerpts.outermost(lexer.functions(prepared.where("kind = 'source'"))))
    bodies = bodies.join(text, "path").select(F.lit("code-quality").alias("unit"), "path", "start", "stop", F.array_join(F.slice(F.split("text", "\n", -1), F.col("start"), F.col("stop") - F.col("start") + 1), "\n").alias("text"), F.struct(F.lit(1).alias("stage"), (-F.col("ccn")).alias("place"), "path", F.col("start").alias("line")).alias("order"))
    both = whole.unionByName(around).unionByName(bodies if "code-quality" in names else bodies.limit(0))
    # arrival is the order itself, as text of equal width, so that no rank of all excerpts is needed
    o = F.col("order")
    arrival = F.concat_ws("\x1f", o.stage.cast("string"), F.lpad((o.place + 1_000_000).cast("string"), 8, "0"), o.path, F.lpad(o.line.cast("string"), 8, "0"))
    return both.select("unit", "path", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), "text", arrival.alias("arrival"))


def evaluate(spark: SparkSession, root: str, kind: str = "project", ref: str | None = None, task_id: str | None = None, names: list[str] | None = None, active: tuple[str, ...] = (), limit: int = packs.LIMIT) -> Evaluation:
    """The evaluation of a directory, a git repository or not. kind: project; changes, of a range ``ref``;
    worktree; task, of ``task_id``. names: the units, otherwise all but optional ones that neither the
    repository's settings nor ``active`` name."""
    if kind not in SCOPES or kind == "changes" and not ref or kind == "task" and not task_id:
        raise ValueError(f"no such scope: {kind}" if kind not in SCOPES else f"{kind} needs a {'range' if kind == 'changes' else 'task'}")
    files, others = tree.repository(spark, root)
    own = settings_of(files)
    if own.get("third_party"):
        files, others = tree.repository(spark, root, own["third_party"])
    files = files.checkpoint()
    names = names if names is not None else [n for n in dimensions.DIMENSIONS if n not in OPTIONAL or n in (*active, *own.get("active_packs", ()))]
    narrow = diffs = referenced = commits = touched = None
    if os.path.isdir(os.path.join(root, ".git")) and scope.git(root, "rev-parse", "--verify", "--quiet", "HEAD"):
        commits, touched = corpus.git_history(spark, root)
    if kind == "changes":
        narrow, diffs = scope.changes(spark, root, ref)
    elif kind == "worktree":
        narrow, diffs = scope.worktree_changes(spark, root)
    elif kind == "task":
        referenced = scope.task(files, task_id)[0].select("path")
        narrow = referenced
    prepared = measures.prepared(spark, files)
    roles = {r: (*ROLES.get(r, ()), *own.get("roles", {}).get(r, ())) for r in {**ROLES, **own.get("roles", {})}}
    found = packs.pack(collected(prepared, names, roles, narrow), limit, narrow if kind in ("changes", "worktree") else None, referenced)
    quoted = found.excerpts.select("path", F.col("start").alias("start_line"), F.col("stop").alias("end_line"))
    inputs = measures.Inputs(files, commits, touched, diffs, quoted)
    return Evaluation(files, others, narrow, found, dimensions.combined(spark, files, names, inputs=inputs))

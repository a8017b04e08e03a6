"""Evidence packs: what each unit may quote, redacted, once, in order of relevance, within its bytes.

All units' excerpts are one stream: they are put in order and totalled once, by ranges and not by unit, so
neither a unit with most of the excerpts nor the whole stream goes through one task. Citations are
joined to the excerpts that were admitted, by path and stretch of lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.storage import checkpoints
from assaykit.operators import redaction
from assaykit.operators.ranking import in_order

#: Bytes of a unit's excerpts, and what findings may say.
LIMIT = 120_000
LEVELS = ("low", "medium", "high")
FIELDS = ("dimension", "title", "detail", "evidence_ref", "confidence", "suggestion", "severity")
MOST_FINDINGS = 500
#: Lines of a stretch by which citations meet excerpts.
STRETCH = 64


@dataclass
class Packs:
    """excerpts (unit, position, path, start, stop, text, bytes, ref), admitted ones; secrets (unit, path,
    line, detector, fingerprint) of all excerpts that were looked at, the first rejected one included;
    units (unit, admitted, bytes, truncated, omitted, secrets)."""

    excerpts: DataFrame
    secrets: DataFrame
    units: DataFrame


def reference(path: Column, start: Column, stop: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), stop.cast("string"))


def tiers(excerpts: DataFrame, changed: DataFrame | None = None, referenced: DataFrame | None = None) -> DataFrame:
    """excerpts with tier: 1 for changed paths, 2 for those that the task refers to, 3 for others."""
    out = excerpts
    for name, paths in (("__changed", changed), ("__referenced", referenced)):
        known = None if paths is None else paths.select("path").distinct().withColumn(name, F.lit(True))
        out = out.withColumn(name, F.lit(None).cast("boolean")) if known is None else out.join(known, "path", "left")
    return out.withColumn("tier", F.when(F.col("__changed"), 1).when(F.col("__referenced"), 2).otherwise(3)).drop("__changed", "__referenced")


def pack(excerpts: DataFrame, limit: int = LIMIT, changed: DataFrame | None = None, referenced: DataFrame | None = None) -> Packs:
    """Packs of excerpts (unit, path, start, stop, text, arrival); arrival orders a unit's excerpts.

    Excerpts are redacted before anything is counted; the bytes are those of the redacted text. A reference
    (redacted path and lines) comes once a unit, at its first place. In order of tier, then arrival, a unit's
    excerpts are admitted while their bytes fit the limit; the first that does not ends its pack, counts as
    the one omitted, and its secrets still are reported. A null text is an empty one. A limit that is not
    positive is an error.
    """
    if limit <= 0:
        raise ValueError("the byte limit must be positive")
    spark = excerpts.sparkSession
    checkpoints(spark)
    rows = tiers(excerpts.select("unit", "path", "start", "stop", F.coalesce("text", F.lit("")).alias("text"), "arrival"), changed, referenced)
    # ids that stay: a row's text is scanned and redacted apart from its place in the order
    rows = rows.withColumn("id", F.monotonically_increasing_id()).checkpoint()
    safe = redaction.redact_rows(rows, ["path", "text"])
    safe = safe.withColumn("ref", reference(F.col("path"), F.col("start"), F.col("stop"))).withColumn("bytes", F.octet_length("text").cast("bigint"))
    order = F.struct("tier", "arrival", "id")
    first = safe.groupBy("unit", F.xxhash64("ref").alias("h"), F.xxhash64(F.lit(1), "ref").alias("k")).agg(F.min_by(F.struct("id", "tier", "arrival", "bytes"), order).alias("x")).select("unit", "x.*")
    # one order over all units; a unit's own total is the common one less what stood before the unit
    placed = in_order(first, [F.col("unit"), F.col("tier"), F.col("arrival"), F.col("id")], F.col("bytes"))
    before = placed.groupBy("unit").agg(F.min(F.col("__running") - F.col("bytes")).alias("__before"), F.min("__rank").alias("__first"))
    own = placed.join(before, "unit").withColumn("used", F.col("__running") - F.col("__before")).withColumn("position", F.col("__rank") - F.col("__first") + 1)
    # what does not fit comes after all that does, for totals only grow
    cut = own.where(F.col("used") > limit).groupBy("unit").agg(F.min("position").alias("cut"))
    seen = own.select("unit", "id", "position", "used").join(cut, "unit", "left").where(F.col("cut").isNull() | (F.col("position") <= F.col("cut")))
    seen = seen.withColumn("admitted", F.coalesce(F.col("position") < F.col("cut"), F.lit(True))).select("unit", "id", "position", "used", "admitted").checkpoint()
    looked_at = seen.select("id", "position", "admitted")
    kept = safe.join(looked_at.where("admitted"), "id").select("unit", "position", "path", "start", "stop", "text", "bytes", "ref")
    secrets = found_secrets(rows.join(looked_at.select("id"), "id", "left_semi"))
    counted = secrets.groupBy("unit").agg(F.count("*").alias("n"))
    units = seen.groupBy("unit").agg(F.count_if("admitted").alias("admitted"), F.coalesce(F.max(F.when(F.col("admitted"), F.col("used"))), F.lit(0)).alias("bytes"), F.count_if(~F.col("admitted")).alias("omitted"))
    units = units.join(counted, "unit", "left").select("unit", "admitted", "bytes", (F.col("omitted") > 0).alias("truncated"), "omitted", F.coalesce("n", F.lit(0)).alias("secrets"))
    return Packs(kept, secrets, units)


def found_secrets(rows: DataFrame) -> DataFrame:
    """(unit, path, line, detector, fingerprint) of the secrets in paths and texts; lines are the file's, and
    null for a path's own."""
    texts = redaction.scan(rows, "id", "text").select("id", "detector", "fingerprint", F.col("line").alias("n"))
    paths = redaction.scan(rows, "id", "path").select("id", "detector", "fingerprint", F.lit(None).cast("int").alias("n"))
    places = redaction.redact_rows(rows.select("id", "unit", "path", "start"), ["path"])
    both = texts.unionAll(paths).join(places, "id")
    return both.select("unit", "path", (F.col("start") + F.col("n") - 1).cast("int").alias("line"), "detector", "fingerprint")


def cited_lines(citations: DataFrame, excerpts: DataFrame) -> DataFrame:
    """citations (unit, path, line) with ``ref``, the excerpt of the unit over that line that starts last,
    null where none was admitted. Both meet at stretches of STRETCH lines, so an excerpt is as many rows as it
    has stretches and no range is searched."""
    at = lambda line: F.floor((line - 1) / STRETCH)
    spans = excerpts.select("unit", "path", "start", "stop", "ref", F.explode(F.sequence(at(F.col("start")), at(F.col("stop")))).alias("stretch"))
    asked = citations.withColumn("stretch", at(F.col("line")))
    places = asked.select("unit", "path", "line", "stretch").distinct()
    hits = places.join(spans, ["unit", "path", "stretch"]).where(F.col("line").between(F.col("start"), F.col("stop")))
    best = hits.groupBy("unit", "path", "line").agg(F.max_by("ref", F.struct("start", "stop", "ref")).alias("ref"))
    return citations.join(best, ["unit", "path", "line"], "left")


def validate(findings: DataFrame, excerpts: DataFrame, units: DataFrame) -> DataFrame:
    """findings (FIELDS) with ``errors``, an array of (field, reason), all of them at once.

    What is missing or out of its domain is told first; only a finding in form has its evidence looked up:
    a reference must have the form path:start-stop, its dimension a pack, and the pack that excerpt. Of a
    pack that was cut, the reason says so. Columns beyond the known ones are an error of every finding, and
    so are more than MOST_FINDINGS findings.
    """
    unknown = sorted(set(findings.columns) - set(FIELDS))
    rows = findings
    for c in FIELDS:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    error = lambda when, field, reason: F.when(when, F.struct(F.lit(field).alias("field"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason")))
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    said = lambda c: F.coalesce(F.col(c).isin(*LEVELS), F.lit(False))
    form = F.array_compact(
        F.array(
            error(F.lit(bool(unknown)), "<unknown>", f"unknown fields: {', '.join(unknown)}"),
            *(error(none(c), c, f"{c} is missing") for c in ("dimension", "title", "detail", "evidence_ref")),
            error(none("confidence"), "confidence", "confidence is missing"),
            error(~none("confidence") & ~said("confidence"), "confidence", F.concat(F.lit("confidence is not low, medium or high: "), F.col("confidence"))),
            error(F.col("severity").isNotNull() & ~said("severity"), "severity", F.concat(F.lit("severity is not low, medium or high: "), F.col("severity"))),
            error(F.lit(findings.limit(MOST_FINDINGS + 1).count() > MOST_FINDINGS), "<payload>", f"more than {MOST_FINDINGS} findings"),
        )
    )
    packs = units.select(F.col("unit").alias("dimension"), F.col("truncated").alias("__cut"))
    refs = excerpts.select(F.col("unit").alias("dimension"), F.col("ref").alias("evidence_ref"), F.lit(True).alias("__there")).distinct()
    both = rows.withColumn("__form", form).join(packs, "dimension", "left").join(refs, ["dimension", "evidence_ref"], "left")
    canonical = F.col("evidence_ref").rlike(r"^(?s).+:\d+-\d+$")
    lost = F.when(F.col("__cut"), "no such excerpt in the pack, which was cut at its limit: cite one that is left").otherwise("no such excerpt in the pack")
    found = F.array_compact(F.array(F.coalesce(error(~canonical, "evidence_ref", "not of the form path:start-stop"), error(F.col("__cut").isNull(), "dimension", "this dimension has no pack"), error(F.col("__there").isNull(), "evidence_ref", lost))))
    return both.withColumn("errors", F.when(F.size("__form") > 0, F.col("__form")).otherwise(found)).select(*findings.columns, "errors")


def write(packs: Packs, at: str) -> None:
    """A folder a unit with its pack as JSON lines in order: a head (the unit's row), then its excerpts. Never
    over an earlier one; equal packs give equal lines. A unit's pack is within its limit, so one task has it."""
    body = packs.excerpts.select("unit", "position", F.to_json(F.struct("ref", "path", "start", "stop", "text")).alias("value"))
    heads = packs.units.select("unit", F.lit(0).cast("bigint").alias("position"), F.to_json(F.struct("admitted", "bytes", "truncated", "omitted", "secrets")).alias("value"))
    lines = heads.unionByName(body).repartition("unit").sortWithinPartitions("unit", "position")
    lines.select("unit", "value").write.mode("errorifexists").partitionBy("unit").text(at)

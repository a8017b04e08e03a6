"""Domain facts: names of money and ledgers, kinds of change, documents' parts, markup controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions import text as T
from assaykit.operators import facts
from assaykit.sources import patterns as P


def _in(values) -> Column:
    return F.array(*map(F.lit, values))


def is_money_name(name: Column) -> Column:
    words = T.name_words(name)
    return F.arrays_overlap(words, _in(P.MONEY)) & ~F.arrays_overlap(words, _in(P.NOT_MONEY))


def is_ledger_name(name: Column) -> Column:
    """A word, plural or not, names a ledger, and the last word is no kind, status or setting."""
    words = T.name_words(name)
    kept = F.filter(words, lambda w: ~w.isin(*P.NAME_ENDINGS))
    return F.arrays_overlap(F.transform(kept, T.singular), _in(P.LEDGERS)) & ~F.coalesce(F.element_at(words, -1).isin(*P.NOT_LEDGER_HEADS), F.lit(False))


def float_money(lines: DataFrame) -> DataFrame:
    """(path, line_no, name): declarations of money in a floating type."""
    rule = r"\b([A-Za-z_]\w*)\s*\??:\s*(?:Optional\[)?\s*(float|double|number|f64|f32|Float|Double)\b"
    return lines.withColumn("name", F.regexp_extract("line", rule, 1)).where((F.col("name") != "") & is_money_name(F.col("name"))).select("path", "line_no", "name")


def change_kind(commits: DataFrame, key: str = "scope") -> DataFrame:
    """(key, kind, signals): the strongest kind that branch, subjects, fix references or files give;
    feature without any. commits: key, branch, message, only_other_files."""
    table = F.create_map(*(F.lit(x) for kv in P.PREFIXES.items() for x in kv))
    branch = table[F.regexp_extract(F.lower("branch"), "^([a-z]+)[/-]", 1)]
    subject = table[F.lower(F.regexp_extract("message", r"^([A-Za-z]+)(?:\([^)]*\))?!?:", 1))]
    fixes = F.when(F.col("message").rlike(r"(?i)\b(?:close|closes|closed|fix|fixes|fixed|resolve|resolves|resolved) #[0-9]+\b"), "bugfix")
    signals = F.array_compact(F.array(branch, subject, fixes))
    rows = commits.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_set(signals))).alias("signals"), F.min("only_other_files").alias("other"))
    rows = rows.withColumn("signals", F.array_sort(F.when(F.col("other"), F.array_union("signals", F.array(F.lit("chore")))).otherwise(F.col("signals"))))
    kind = F.lit("feature")
    for k in reversed(P.CHANGE_KINDS):
        kind = F.when(F.array_contains("signals", k), k).otherwise(kind)
    return rows.select(key, kind.alias("kind"), "signals")


def symbol_pairs(sources: DataFrame, tests: DataFrame, common: tuple[str, ...] = ("main", "init", "setup", "test", "data", "name", "value")) -> DataFrame:
    """(source, test, symbol): sources and tests of one project by a symbol that both change; the one on
    an added line first, then by line, then by name. Both: path, project, symbol, line_no, added."""
    fit = (F.length("symbol") >= 4) & ~F.lower("symbol").isin(*common)
    a = sources.where(fit).select(F.col("path").alias("source"), "project", "symbol", "line_no", F.when(F.col("added"), 0).otherwise(1).alias("rank"))
    b = tests.where(fit).select(F.col("path").alias("test"), "project", "symbol").distinct()
    return a.join(b, ["project", "symbol"]).groupBy("source", "test").agg(F.min_by("symbol", F.struct("rank", "line_no", "symbol")).alias("symbol"))


def sections(lines: DataFrame) -> DataFrame:
    """(path, start, level, title, stop): markdown sections, each to before the next heading of the same
    or a higher level. lines: path, line_no, line."""
    heads = facts.headings(lines).select("path", F.col("line_no").alias("start"), "level", "title")
    last = lines.groupBy("path").agg(F.max("line_no").alias("last"))
    nexts = heads.select("path", F.col("start").alias("n"), F.col("level").alias("l"))
    ends = heads.join(nexts, "path", "left").where((F.col("n") > F.col("start")) & (F.col("l") <= F.col("level"))).groupBy("path", "start").agg((F.min("n") - 1).alias("stop"))
    return heads.join(ends, ["path", "start"], "left").join(last, "path").select("path", "start", "level", "title", F.coalesce("stop", "last").alias("stop"))


def requirement_lists(lines: DataFrame, least: int = 3) -> DataFrame:
    """(path, start, items): sections on requirements with at least so many list items before the next
    heading of the same or a higher level."""
    about = sections(lines).where(F.lower("title").rlike("requirement|acceptance|user stor"))
    items = lines.where(F.col("line").rlike(r"^\s*(?:[-*+]|[0-9]+[.)])\s+\S")).select("path", "line_no")
    found = about.join(items, "path").where(F.col("line_no").between(F.col("start"), F.col("stop")))
    return found.groupBy("path", "start").agg(F.count("*").alias("items")).where(F.col("items") >= least)


def decisions(files: DataFrame) -> DataFrame:
    """(path, by): documents that record a decision: a decision heading and one that supports it, or a
    dated entry with a verb of deciding and a reason."""
    has = lambda p: F.col("text").rlike(p)
    fields = has(r"(?im)^(?:#{1,6}\s*|\**)decision\b") & has(r"(?im)^(?:#{1,6}\s*|\**)(?:context|consequences|status|rationale|alternatives)\b")
    entry = has(r"(?is)\b20[0-9]{2}-[0-9]{2}-[0-9]{2}\b.{0,800}\b(?:decided|chose|adopted|rejected)\b.{0,800}\b(?:because|since|so that|rationale)\b")
    return files.select("path", F.when(fields, "fields").when(entry, "entry").alias("by")).where("by is not null")


def criteria(lines: DataFrame) -> DataFrame:
    """(path, line_no, criterion): rows of tables whose head has a criterion column."""
    rows = lines.where(F.col("line").rlike(r"^\s*\|.*\|\s*$")).withColumn("cells", F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|", -1), lambda c: F.trim(c)))
    at = F.when(F.exists("cells", lambda c: F.lower(c).rlike("^criteri")), F.array_position(F.transform("cells", lambda c: F.lower(c).rlike("^criteri")), F.lit(True)).cast("int"))
    broken = F.when(F.col("line_no") - F.lag("line_no").over(Window.partitionBy("path").orderBy("line_no")) > 1, F.lit(0))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("head", F.coalesce(at, broken)).withColumn("column", F.last("head", ignorenulls=True).over(w))
    rows = rows.where((F.col("column") > 0) & F.col("head").isNull() & ~F.col("line").rlike(r"^[\s|:-]+$"))
    return rows.select("path", "line_no", F.get("cells", F.col("column") - 1).alias("criterion")).where("criterion <> ''")


def entity_key(name: Column) -> Column:
    """What a name stands for: its words in singular, less endings such as model or table."""
    return F.array_join(F.transform(F.filter(T.name_words(name), lambda w: ~w.isin(*P.NAME_ENDINGS)), T.singular), "_")


def masked(line: Column) -> Column:
    """A line with personal values replaced by their kind."""
    put = lambda text, s: F.replace(text, s.value, F.concat(F.lit("[PHI "), s.kind, F.lit(" redacted]")))
    return F.aggregate(facts.phi_spans(line), line, put)


def static_prefix(route: Column) -> Column:
    """The part of a route before its first parameter."""
    return F.regexp_replace(F.regexp_extract(route, r"^/?((?:[^/:{<*]+(?:/|$))*)", 1), "/+$", "")

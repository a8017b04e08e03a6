"""Gates: questions to an outside judge where rules can't decide, and what its answers do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions import text as T

#: Most candidates, fields, entries and pairs that a question lists.
MOST, MOST_PAIRS = 20, 50


def capped(rows: DataFrame, key: str, order: list[str], most: int = MOST) -> DataFrame:
    """The first rows of each key, with ``omitted``, how many it has beyond them."""
    totals = rows.groupBy(key).agg(F.count("*").alias("__n"))
    first = rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__k") <= most)
    return first.join(totals, key).withColumn("omitted", F.greatest(F.col("__n") - most, F.lit(0))).drop("__k", "__n")


def shape(path):
    """A path's shape: its directory's depth and its suffix; digits in names don't tell files apart."""
    return F.concat_ws("/", (F.size(F.split(path, "/")) - 1).cast("string"), T.suffix(path))


def picks(unfilled: DataFrame, candidates: DataFrame, most: int = MOST) -> DataFrame:
    """(role, shape, paths, omitted): candidates (role, path) of roles that no file fills, by shape."""
    rows = candidates.join(unfilled.select("role").distinct(), "role", "left_semi").withColumn("shape", shape(F.col("path")))
    rows = rows.withColumn("group", F.concat_ws("\x1f", "role", "shape"))
    kept = capped(rows, "group", ["path"], most)
    return kept.groupBy("role", "shape").agg(F.array_sort(F.collect_list("path")).alias("paths"), F.max("omitted").alias("omitted"))


def accepted(answers: DataFrame, asked: DataFrame) -> DataFrame:
    """Answers (role, path) with ``errors``: a path that was not offered for its role is refused."""
    offered = asked.select("role", F.explode("paths").alias("path")).distinct().withColumn("__offered", F.lit(True))
    return answers.join(offered, ["role", "path"], "left").withColumn("errors", F.array_compact(F.array(F.when(F.col("__offered").isNull(), "path was not offered for the role")))).drop("__offered")


def reviews(entries: DataFrame, most: int = MOST) -> DataFrame:
    """Entries of the local registry that no one has reviewed yet, at most so many, by entry."""
    return entries.where("reviewed is null or not reviewed").orderBy("entry").limit(most)


def change_kind_question(kinds: DataFrame, most: int = MOST) -> DataFrame:
    """(scope, proposal, signals, omitted) from change_kind(): the proposal and what speaks for it."""
    cut = F.slice("signals", F.lit(1), F.lit(most))
    return kinds.select("scope", F.col("kind").alias("proposal"), cut.alias("signals"), F.greatest(F.size("signals") - most, F.lit(0)).alias("omitted"))


def test_pairs_question(pairs: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """(scope, pairs, omitted): proposals (scope, source, test, symbol) in order of source and test."""
    kept = capped(pairs, "scope", ["source", "test"], most)
    rows = F.array_sort(F.collect_list(F.struct("source", "test", "symbol")))
    return kept.groupBy("scope").agg(rows.alias("pairs"), F.max("omitted").alias("omitted"))


def decided_pairs(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pairs that stand: confirmed ones, and those without a verdict; refuted ones go."""
    told = verdicts.select("source", "test", "verdict")
    return pairs.join(told, ["source", "test"], "left").where("verdict is null or verdict = 'confirmed'").drop("verdict")


def documentation(rules: DataFrame, files: DataFrame) -> DataFrame:
    """(dimension, rule, state): present or missing, never a number. rules: dimension, rule, glob regex
    as ``pattern``. Every pattern is a column of one projection over the files, which is reduced before it is
    dealt, so neither the rules are broadcast nor files and rules multiplied; rules are read to the driver."""
    said = rules.select("dimension", "rule", "pattern").distinct().collect()
    hits = files.select(F.explode(F.array_compact(F.array(*(F.when(F.col("path").rlike(r.pattern), F.struct(F.lit(r.dimension).alias("dimension"), F.lit(r.rule).alias("rule"))) for r in said)))).alias("x")).select("x.*").distinct() if said else rules.select("dimension", "rule").limit(0)
    hits = hits.withColumn("there", F.lit(True))
    return rules.select("dimension", "rule").distinct().join(hits, ["dimension", "rule"], "left").select("dimension", "rule", F.when(F.col("there"), "present").otherwise("missing").alias("state"))

"""Excerpts: what of a corpus is quoted, in which order, and how much of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions import text as T
from assaykit.operators import code, redaction
from assaykit.operators.ranking import islands

#: Lines quoted around a hit, lines of one excerpt at most, and the mark of a clipped one.
AROUND, MOST_LINES, CLIPPED = 3, 60, "… [clipped]"
#: The order in which files matter to security, files of a tier that are read at most.
CATEGORIES = ("credential material", "dependency manifest", "permission, container, or CI configuration", "auth or crypto code")
CANDIDATES = 200


def quoted(hits: DataFrame, lines: DataFrame, around: int = AROUND) -> DataFrame:
    """(path, start, stop, text): hits (path, line_no) with the lines around them; what overlaps or touches
    is one excerpt. Hits are dealt to their lines by equal keys, so no range is joined."""
    spans = hits.select("path", F.greatest(F.col("line_no") - around, F.lit(1)).cast("int").alias("start"), (F.col("line_no") + around).cast("int").alias("stop")).distinct()
    wide = islands(spans, "path", "start", "stop")
    each = wide.select("path", "start", F.explode(F.sequence("start", "stop")).alias("line_no"))
    found = each.join(lines.select("path", "line_no", "line"), ["path", "line_no"])
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return found.groupBy("path", "start").agg(F.max("line_no").alias("stop"), F.array_join(F.transform(rows, lambda r: r.line), "\n").alias("text"))


def clip(text: Column, most: int = MOST_LINES) -> Column:
    """The first lines of a text; a longer one ends with a mark."""
    parts = F.split(text, "\n", -1)
    return F.when(F.size(parts) <= most, text).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), most), "\n"), F.lit("\n" + CLIPPED)))


def is_clipped(text: Column) -> Column:
    return F.rtrim(text).endswith(CLIPPED)


def outermost(functions: DataFrame) -> DataFrame:
    """Functions (path, start, stop, ccn) that are in no other, the most complex first, then by place."""
    w = Window.partitionBy("path").orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    return functions.withColumn("__before", F.max("stop").over(w)).where("__before is null or start > __before").drop("__before").orderBy(F.desc("ccn"), "path", "start")


def security_order(files: DataFrame) -> DataFrame:
    """(path, category, rank): files that matter to security, in order of why, then by path."""
    rows = files.select("path", code.security_category(F.col("path")).alias("category")).where("category is not null")
    order = F.array(*map(F.lit, CATEGORIES))
    return rows.withColumn("rank", F.array_position(order, F.col("category")).cast("int")).orderBy("rank", "path")


def test_order(tests: DataFrame, corresponding: DataFrame, configs: DataFrame) -> DataFrame:
    """(path, rank): tests of what is looked at first, then configurations, then other tests."""
    near = corresponding.select("path").distinct().withColumn("__near", F.lit(1))
    rows = tests.select("path").distinct().join(near, "path", "left").select("path", F.when(F.col("__near") == 1, 0).otherwise(2).alias("rank"))
    both = rows.unionAll(configs.select("path").distinct().withColumn("rank", F.lit(1)))
    return both.groupBy("path").agg(F.min("rank").alias("rank")).orderBy("rank", "path")


def focus(plan: DataFrame, most: int = 5) -> DataFrame:
    """The steps of a plan that gain most, three to five of them."""
    return plan.orderBy(F.desc(F.greatest("gain_low", "gain_high")), "priority", "dimension", "metric").limit(max(3, min(5, most)))


def in_scope(role_files: DataFrame, scope: DataFrame | None, context: tuple[str, ...]) -> DataFrame:
    """Role files (role, path) of a scope (path): those of context roles from the whole corpus, the others
    only within; without a scope all."""
    if scope is None:
        return role_files
    inside = scope.select("path").distinct().withColumn("__in", F.lit(True))
    return role_files.join(inside, "path", "left").where(F.col("role").isin(list(context)) | F.col("__in")).select("role", "path")


def without_secrets(entries: DataFrame, value: str = "value") -> DataFrame:
    """Entries whose value redaction leaves as it is."""
    marked = entries.withColumn("__key", F.concat_ws("\x1f", *entries.columns))
    flagged = redaction.scan(marked, "__key", value).select("__key").distinct()
    return marked.join(flagged, "__key", "left_anti").drop("__key")


def common_directory(paths: DataFrame) -> DataFrame:
    """(dir): the longest directory that all paths share: that of the least and the greatest one."""
    ends = paths.agg(F.min(F.split(T.parent(F.col("path")), "/")).alias("a"), F.max(F.split(T.parent(F.col("path")), "/")).alias("b"))
    equal = F.transform(F.sequence(F.lit(1), F.size("a")), lambda n: F.slice("a", F.lit(1), n) == F.slice("b", F.lit(1), n))
    return ends.select(F.array_join(F.slice("a", F.lit(1), F.size(F.filter(equal, lambda x: x))), "/").alias("dir"))

"""Settings that are inherited: what a configuration says itself, and what it takes over from others.

Inheritance is a graph of any depth. It is settled by doubling: a node holds the list of ancestors that it
still has to ask, nearest first, and in each round every ancestor in the lists is replaced by what that
ancestor would have to ask. Chains of n links take about log2(n) rounds, and what goes in circles is what
rounds leave over.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions import text as T
from assaykit.functions.storage import checkpoints
from assaykit.sources import registry

#: States: set, switched off, not said, and not to be known.
STRICT, OFF, UNSET, UNSEEN = "strict", "off", "unset", "unseen"
#: What starts a comment line in a configuration.
COMMENTS = r"^\s*(?:#|;|//|/\*|\*)"
_ITEM = "struct<ref:string,state:string>"


def _settled(items: Column) -> Column:
    """A list of ancestors and states: what is unset falls out, nothing after a known state counts, and an
    ancestor is asked once."""
    none = F.array().cast(f"array<{_ITEM}>")
    start = F.struct(none.alias("kept"), F.lit(False).alias("shut"))

    def step(was: Column, x: Column) -> Column:
        known = F.coalesce(x.state, F.lit(""))
        skip = was.shut | (known == UNSET) | (x.ref.isNotNull() & F.exists(was.kept, lambda k: k.ref == x.ref))
        return F.when(skip, was).otherwise(F.struct(F.concat(was.kept, F.array(x)).alias("kept"), (known != "").alias("shut")))

    return F.aggregate(items, start, step, lambda x: x.kept)


def inherited(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(key, state) of nodes (key, state): a state that is unset is that of the first parent (key, place,
    parent) by place that has one, of its parents in turn. A parent that is no node, and a circle, make it
    unseen; without a parent that says anything it stays unset."""
    spark = nodes.sparkSession
    checkpoints(spark)
    item = lambda ref, state: F.struct(ref.alias("ref"), state.alias("state")).cast(_ITEM)
    none = F.lit(None).cast("string")
    known = nodes.select(F.col("key").alias("parent"), F.lit(True).alias("__there"))
    asked = parents.join(known, "parent", "left").select("key", "place", F.when(F.col("__there"), item(F.col("parent"), none)).otherwise(item(none, F.lit(UNSEEN))).alias("x"))
    lists = asked.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda v: v.x).alias("items"))
    own = F.when(F.col("state") != UNSET, F.array(item(none, F.col("state")))).otherwise(F.coalesce("items", F.array().cast(f"array<{_ITEM}>")))
    table = nodes.join(lists, "key", "left").select("key", _settled(own).alias("items")).checkpoint()
    n = table.count()
    for _ in range(math.ceil(math.log2(n + 1)) + 1):
        open_ = table.where(F.exists("items", lambda x: x.ref.isNotNull()))
        if open_.isEmpty():
            break
        each = open_.select("key", F.posexplode("items").alias("place", "x"))
        theirs = table.select(F.col("key").alias("ref"), F.col("items").alias("more"))
        found = each.withColumn("ref", F.col("x.ref")).join(theirs, "ref", "left")
        # an ancestor without anything left to ask is unset
        found = found.select("key", "place", F.when(F.col("ref").isNull(), F.array("x")).otherwise(F.col("more")).alias("more"))
        again = found.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "more"))), lambda v: v.more)).alias("next"))
        table = table.join(again, "key", "left").select("key", _settled(F.coalesce("next", "items")).alias("items")).checkpoint()
    first = F.get("items", F.lit(0))
    return table.select("key", F.when(F.size("items") == 0, UNSET).otherwise(F.coalesce(first.state, F.lit(UNSEEN))).alias("state"))


def sections(files: DataFrame) -> DataFrame:
    """(path, language, header, body) of the type checkers' configurations among files (path, text): the
    whole file, or from a header on a line of its own to before the next line that starts with a bracket."""
    out = None
    lines = F.split("text", "\n", -1)
    for language, names in registry.tokens("type_config_files").items():
        for name, _, header in (n.partition(" ") for n in names):
            here = files.where(T.base_name(F.col("path")).rlike(T.glob_regex(name)) & F.col("text").isNotNull())
            if header:
                at = F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x) == F.lit(header), i)), lambda i: i.isNotNull())  # noqa: B023
                here = here.select("path", lines.alias("lines"), F.explode(at).alias("at")).withColumn("rest", F.slice("lines", F.col("at") + 2, F.size("lines")))
                ends = F.array_position(F.transform("rest", lambda x: x.startswith("[")), True)
                body = F.array_join(F.when(ends > 0, F.slice("rest", F.lit(1), (ends - 1).cast("int"))).otherwise(F.col("rest")), "\n")
            else:
                body = F.col("text")
            rows = here.select("path", F.lit(language).alias("language"), F.lit(header).alias("header"), body.alias("body"))
            out = rows if out is None else out.unionAll(rows)
    return out


def _last(text: Column, pattern: str) -> Column:
    """Where the last match starts, -1 for none."""
    return F.when(text.rlike(pattern), F.length(F.regexp_extract(text, f"(?s)^(.*)(?:{pattern})", 1))).otherwise(F.lit(-1))


def said(language: Column, body: Column, clipped: Column | None = None) -> Column:
    """The state that a configuration's text gives itself, comment lines left out: of on and off the last
    wins. Of a text that was cut, only a last on is known."""
    clean = F.regexp_replace(body, f"(?m){COMMENTS}.*$", "")
    on, off = F.lit(-1), F.lit(-1)
    for name, tokens in registry.tokens("type_strict").items():
        on = F.when(language == name, _last(clean, T.any_token(tokens))).otherwise(on)
    for name, tokens in registry.tokens("type_strict_off").items():
        off = F.when(language == name, _last(clean, T.any_token(tokens))).otherwise(off)
    cut = F.lit(False) if clipped is None else clipped
    return F.when(on > off, STRICT).when(cut, UNSEEN).when(off >= 0, OFF).otherwise(UNSET)


def extended(language: Column, path: Column, body: Column) -> Column:
    """Paths, in the order given, that a configuration extends: of the string or list of strings after the
    word for it. A path that is absolute or leaves the corpus is null."""
    clean = F.regexp_replace(body, f"(?m){COMMENTS}.*$", "")
    text = r'"(?:[^"\\\n]|\\.)*"'
    raw = F.array().cast("array<string>")
    for name, tokens in registry.tokens("type_config_extends").items():
        after = F.regexp_extract_all(clean, F.lit(rf"{T.any_token(tokens)}[ \t]*(\[[^\]]*|{text})"), F.lit(1))
        raw = F.when(language == name, after).otherwise(raw)
    words = F.flatten(F.transform(raw, lambda x: F.regexp_extract_all(x, F.lit(r'"((?:[^"\\\n]|\\.)*)"'), F.lit(1))))

    def placed(target: Column) -> Column:
        parts = F.filter(F.concat(F.split(T.parent(path), "/"), F.split(target, "/")), lambda p: ~p.isin("", "."))
        start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("inside"))
        up = lambda was: F.struct(F.slice(was["at"], F.lit(1), F.greatest(F.size(was["at"]) - 1, F.lit(0))).alias("at"), (was.inside & (F.size(was["at"]) > 0)).alias("inside"))
        down = lambda was, p: F.struct(F.concat(was["at"], F.array(p)).alias("at"), was.inside.alias("inside"))
        walked = F.aggregate(parts, start, lambda was, p: F.when(p == "..", up(was)).otherwise(down(was, p)), lambda w: F.when(w.inside & (F.size(w["at"]) > 0), F.array_join(w["at"], "/")))
        return F.when((target != "") & ~target.startswith("/") & ~target.contains("\\"), walked)

    return F.transform(words, placed)


def strict_states(files: DataFrame) -> DataFrame:
    """(language, path, header, state, base) of every type checker's configuration in files (path, text);
    base: another one extends it, and it is no project of its own. Bases are files of any name, whole."""
    roots = sections(files).withColumn("whole", F.lit(False))
    languages = F.array(*map(F.lit, registry.tokens("type_config_files")))
    bases = files.where(F.col("text").isNotNull()).where(F.col("path").rlike(r"\.(?:json|toml|ini|cfg)$")).select("path", F.explode(languages).alias("language"), F.lit("").alias("header"), F.col("text").alias("body"), F.lit(True).alias("whole"))
    rows = roots.unionAll(bases).select("language", "path", "header", "whole", said(F.col("language"), F.col("body")).alias("own"), extended(F.col("language"), F.col("path"), F.col("body")).alias("targets"))
    key = lambda whole, *cols: F.concat_ws("\x1f", F.when(whole, "w").otherwise("r"), *cols)
    # a section may come more than once in a file: what is strictest holds, and the first that extends says what
    order = F.create_map(*(F.lit(x) for kv in ((STRICT, 0), (OFF, 1), (UNSET, 2)) for x in kv))
    rows = rows.groupBy("language", "path", "header", "whole").agg(F.min_by("own", order[F.col("own")]).alias("own"), F.max_by("targets", F.size("targets") > 0).alias("targets"))
    rows = rows.withColumn("key", key(F.col("whole"), "language", "path", "header")).checkpoint()
    last_first = F.reverse("targets")
    asked = rows.where(F.col("own") == UNSET).select("key", "language", F.posexplode(last_first).alias("place", "target"))
    known = files.select("path").distinct()
    exact = known.select(F.col("path").alias("target"), F.col("path").alias("found"))
    other = known.where(F.col("path").endswith(".json")).select(F.regexp_replace("path", r"\.json$", "").alias("target"), F.col("path").alias("with_suffix"))
    asked = asked.join(exact, "target", "left").join(other, "target", "left")
    parents = asked.select("key", "place", key(F.lit(True), F.col("language"), F.coalesce("found", "with_suffix", F.lit("?")), F.lit("")).alias("parent"))
    states = inherited(rows.select("key", F.col("own").alias("state")), parents)
    targets = rows.where("not whole").select(F.explode("targets").alias("t")).where("t is not null")
    used = targets.select(F.col("t").alias("path")).unionAll(targets.where(~F.col("t").endswith(".json")).select(F.concat("t", F.lit(".json")))).distinct().withColumn("base", F.lit(True))
    own = rows.where("not whole").select("key", "language", "path", "header")
    return own.join(states, "key").join(used, "path", "left").select("language", "path", "header", "state", F.coalesce("base", F.lit(False)).alias("base"))


def strict_languages(found: DataFrame) -> DataFrame:
    """(language, state): strict if any configuration of its own is, unseen if one can't be known, else off;
    of strict_states()."""
    rank = F.create_map(*(F.lit(x) for kv in ((STRICT, 0), (UNSEEN, 1), (OFF, 2), (UNSET, 2)) for x in kv))
    least = found.where("not base").groupBy("language").agg(F.min(rank[F.col("state")]).alias("rank"))
    return least.select("language", F.element_at(F.array(*map(F.lit, (STRICT, UNSEEN, OFF))), F.col("rank") + 1).alias("state"))

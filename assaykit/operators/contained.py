"""Many strings in many texts: which names occur in which texts.

A text that has a name has all q-grams of the name. Of each run of q-grams both sides keep the one with the least
hash, so a name is looked for only in the texts that share its rarest kept q-gram, and only there by an automaton.
A pass drops what no name keeps by a bitmap of bounded size, which may let too much through and never loses any.
Names of under SHORT characters have too few q-grams: for these, texts are read once for each shard of names,
whose bytes are bounded, and a task gives each name of a batch once.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions import storage
from assaykit.functions import text as T
from assaykit.functions.ship import map_batches

#: (least length of a name, q, q-grams in a run): the longest of these that a name has. q is a power of two.
LEVELS = ((30, 16, 15), (12, 8, 5), (4, 4, 1))
SHORT = LEVELS[-1][0]
#: q-grams that a name is looked for by at first; all of it, if each of these is in more than HOT texts.
TRIED, HOT = 4, 16
#: Bits of the bitmap: so many for each q-gram that names keep, 2 to these powers at least and at most.
BITS_EACH, BITS = 16, (16, 26)
#: Characters of a text whose q-grams are held at a time.
PIECE = 1 << 20
#: Bytes of names in a shard; each is collected and goes to the tasks with their code.
SHARD_BYTES = 4 << 20
#: What a whole word is bounded by: letters, digits, underscores and hyphens are part of it.
_PART = re.compile(r"[\w-]")
#: What an item of a requirement looks like; id anywhere, line at the start of a line.
ITEM_IDS = ("FR-<0-9>*", "NFR-<0-9>*", "REQ-<A-Za-z0-9>*", "US-<0-9>*", "AC-<0-9>*")
ITEM_LINES = ("Scenario:", "Scenario Outline:")


def automaton(names: list[tuple[str, bool]]):
    """Of (name, whether a whole word); a name is tried as a whole word only if it comes as one only."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for name, whole in names:
        out.add_word(name, (name, whole))
    if len(out):
        out.make_automaton()
    return out


def found_in(tree, text: str) -> set[tuple[str, bool]]:
    """The (name, whole) that occur in a text."""
    out: set[tuple[str, bool]] = set()
    if not len(tree):
        return out
    for end, (name, whole) in tree.iter(text):
        if whole and (name, whole) not in out:
            start = end - len(name)
            if start >= 0 and _PART.match(text[start]) or end + 1 < len(text) and _PART.match(text[end + 1]):
                continue
        out.add((name, whole))
    return out


def least_hashes(text: str, q: int, run: int):
    """The least hash of each run of so many q-grams of a text, in the order of the text, as 64 bits with a sign."""
    import numpy as np

    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    if len(h) < q + run - 1:
        return np.empty(0, np.int64)
    step = 1
    while step < q:  # q-grams from two halves
        h = h[:-step] * np.uint64(0xD6E8FEB86659FD93 + 2 * step) + h[step:]
        step *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    step = 1
    while 2 * step <= run:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    if step < run:
        h = np.minimum(h[: step - run], h[run - step :])
    return h.view(np.int64)


def kept_hashes(text: str, levels=LEVELS):
    """The distinct least hashes of a text at these levels, read piece by piece."""
    import numpy as np

    parts = [np.unique(least_hashes(text[at : at + PIECE + q + run - 2], q, run)) for _, q, run in levels for at in range(0, len(text), PIECE)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)


def _grams(named: DataFrame, most: int | None) -> DataFrame:
    """named with ``hashes`` of its names, all of them or ``most`` from places all over a name."""

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                _, q, run = next(x for x in LEVELS if len(name) >= x[0])
                h = least_hashes(name, q, run)
                out.append(np.unique(h if most is None else h[np.linspace(0, len(h) - 1, most).astype(int)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], names=[*batch.schema.names, "hashes"])

    return map_batches(named, rows, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in named.schema)}, hashes array<bigint>")


def _texts_by_gram(texts: DataFrame, grams: DataFrame) -> DataFrame:
    """(h, key): the q-grams of grams (h) that each text keeps, and some that it need not."""
    import numpy as np

    spark, kind = texts.sparkSession, texts.schema["key"].dataType.simpleString()
    n, lengths = grams.agg(F.count("*"), F.collect_set("least")).first()
    levels = [x for x in LEVELS if x[0] in lengths]
    power = min(max((BITS_EACH * n).bit_length(), BITS[0]), BITS[1])
    at = F.shiftrightunsigned("h", 64 - power)
    words = grams.select(at.alias("slot")).groupBy(F.shiftrightunsigned("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits"))
    found = words.toArrow()  # 2 to the power of BITS[1] - 6 rows at most
    bitmap = np.zeros(1 << power - 6, np.uint64)
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    sent = spark.sparkContext.broadcast(bitmap)

    def rows(batches):
        import pyarrow as pa

        bits = sent.value
        for batch in batches:
            hashes, of = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            for i, text in enumerate(batch.column(1).to_pylist()):
                h = kept_hashes(text or "", levels)
                slot = h.view(np.uint64) >> np.uint64(64 - power)
                h = h[(bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)]
                hashes.append(h)
                of.append(np.full(len(h), i, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), batch.column(0).take(pa.array(np.concatenate(of)))], names=["h", "key"])

    return map_batches(texts, rows, f"h bigint, key {kind}")


def _candidates(texts: DataFrame, named: DataFrame) -> DataFrame:
    """(key, name, whole, part): texts that may have a name of named (name, whole, part), all that do among them."""
    storage.checkpoints(texts.sparkSession)
    named, out = _grams(named, TRIED).checkpoint(), None
    for last in (False, True):
        least = F.coalesce(*(F.when(F.length("name") >= x[0], x[0]) for x in LEVELS))
        grams = named.select(F.sha2("name", 256).alias("id"), least.alias("least"), F.explode("hashes").alias("h"))
        by_gram = _texts_by_gram(texts, grams).checkpoint()
        told = by_gram.groupBy("h").agg(F.count("*").alias("n"), F.min("key").alias("first"))
        # a name without a text for each of its q-grams is in none, and in none before the last of their first texts
        rarest = grams.join(told, "h", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h")).alias("rare"), F.max("first").alias("first")).where("rare.n > 0")
        picked = named.withColumn("id", F.sha2("name", 256)).join(rarest.select("id", "rare.n", "rare.h", "first"), "id").drop("id", "hashes")
        rare = picked if last else picked.where(F.col("n") <= HOT)
        pairs = rare.join(by_gram, "h").where(F.col("key").isNull() | F.col("first").isNull() | (F.col("key") >= F.col("first"))).select("key", "name", "whole", "part")
        out = pairs if out is None else out.unionAll(pairs)
        if last:
            break
        named = _grams(picked.where(F.col("n") > HOT).select("name", "whole", "part"), None).checkpoint()
        if named.isEmpty():
            break
    return out


def _found(texts: DataFrame, names: DataFrame, shard_bytes: int) -> DataFrame:
    """(key, name, whole): the names (name, whole) that occur in each text, once a row of texts (key, text)."""
    spark, kind = texts.sparkSession, texts.schema["key"].dataType.simpleString()
    schema = f"key {kind}, name string, whole boolean"
    named = names.where("name <> ''").groupBy("name").agg(F.max("whole").alias("whole"), F.max(~F.col("whole")).alias("part"))
    short, long = F.length("name") < SHORT, F.length("name") >= SHORT
    bytes_, n = named.agg(F.coalesce(F.sum(F.when(short, F.octet_length("name"))), F.lit(0)), F.count_if(long)).first()
    shards = -(-bytes_ // shard_bytes)
    parts = []
    for i in range(shards):
        rows = named.where(short & (F.pmod(F.xxhash64("name"), F.lit(shards)) == i)).collect()  # a shard's bytes are bounded
        parts.append(map_batches(texts, _scan([(r.name, w) for r in rows for w in (True, False) if (r.whole if w else r.part)]), schema))
    if n:
        pairs = _candidates(texts, named.where(long)).groupBy("key").agg(F.collect_set(F.struct("name", "whole", "part")).alias("names"))
        asked = texts.withColumnRenamed("key", "of").join(pairs, F.col("of").eqNullSafe(F.col("key"))).select("key", "text", "names")
        parts.append(map_batches(asked, _sought(shard_bytes), schema))
    return functools.reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)


def _told(batch, at: list[int], found: list[tuple[str, bool]]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array([n for n, _ in found], pa.string()), pa.array([w for _, w in found], pa.bool_())], names=["key", "name", "whole"])


def _scan(mine: list[tuple[str, bool]]):
    """An Arrow function that looks for the same names in each text."""

    def rows(batches):
        trees = [automaton([n for n in mine if n[1] == whole]) for whole in (True, False)]
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                hits = sorted(h for t in trees for h in found_in(t, text or ""))
                at += [i] * len(hits)
                found += hits
            yield _told(batch, at, found)

    return rows


def _sought(shard_bytes: int):
    """An Arrow function that looks for each text's own names, in automata of so many bytes."""

    def shards(names):
        held, size = [], 0
        for name in names:
            held.append(name)
            size += len(name.encode("utf-8", "surrogatepass"))
            if size >= shard_bytes:
                yield held
                held, size = [], 0
        yield held

    def rows(batches):
        for batch in batches:
            at, found = [], []
            for i in range(batch.num_rows):
                text, names = batch.column(1)[i].as_py() or "", batch.column(2)[i].as_py()
                for whole in (True, False):
                    for mine in shards(x["name"] for x in names if x["whole" if whole else "part"]):
                        hits = sorted(found_in(automaton([(n, whole) for n in mine]), text))
                        at += [i] * len(hits)
                        found += hits
            yield _told(batch, at, found)

    return rows


def holders(texts: DataFrame, names: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, name, whole): the names that occur in each text, once a row of texts (key, text). names has name
    and whole: as a whole word, in which hyphens count, or as any part of the text. A null text has none."""
    return _found(texts.select("key", "text"), names, shard_bytes)


def first_holders(texts: DataFrame, names: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(name, whole, key): the least key of the texts that a name occurs in; names that occur in none are left
    out."""
    found = _found(texts.where("key is not null").select("key", "text"), names, shard_bytes)
    return found.groupBy("name", "whole").agg(F.min("key").alias("key"))


def requirement_items(docs: DataFrame, ids: tuple[str, ...] = ITEM_IDS, lines: tuple[str, ...] = ITEM_LINES) -> DataFrame:
    """(path, kind, item) of documents (path, text), each item once a document: ids anywhere, not after a
    letter, digit or underscore; and the rest of lines that start with a token, without quotes around it or a
    comma behind."""
    found = F.regexp_extract_all("text", F.lit("(?<!\\w)" + T.any_token(ids)), F.lit(0))
    rest = F.regexp_extract_all("text", F.lit(rf"(?m)^[ \t]*{T.any_token(lines)}([^\n]*)$"), F.lit(1))
    blanks = F.lit(" \t\r")
    bare = F.transform(rest, lambda x: F.btrim(F.btrim(F.btrim(F.rtrim(F.btrim(x, blanks), F.lit(",")), blanks), F.lit("\"'")), blanks))
    told = lambda kind, items: F.transform(items, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("item")))
    both = F.array_distinct(F.concat(told("id", found), told("line", F.filter(bare, lambda x: x != ""))))
    return docs.where(F.col("text").isNotNull()).select("path", F.explode(both).alias("x")).select("path", "x.kind", "x.item")


def flat(text: Column) -> Column:
    """Small letters, white space as single blanks."""
    return F.lower(F.regexp_replace(text, r"\s+", " "))


def traced_items(items: DataFrame, texts: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """items (path, kind, item) with ``found``, the least path among texts (path, text) that has the item: an id
    as a whole word, a line by its text whatever its case and spacing; null where none has."""
    ids = items.where("kind = 'id'").select(F.col("item").alias("name"), F.lit(True).alias("whole"))
    lines = items.where("kind = 'line'").select(flat(F.col("item")).alias("name"), F.lit(False).alias("whole"))
    by_id = first_holders(texts.select(F.col("path").alias("key"), "text"), ids, shard_bytes)
    by_line = first_holders(texts.select(F.col("path").alias("key"), flat(F.col("text")).alias("text")), lines, shard_bytes)
    found = by_id.unionAll(by_line).select("name", "whole", F.col("key").alias("found"))
    asked = items.withColumns({"name": F.when(F.col("kind") == "id", F.col("item")).otherwise(flat(F.col("item"))), "whole": F.col("kind") == "id"})
    return asked.join(found, ["name", "whole"], "left").select("path", "kind", "item", "found")

"""Line dedup: winnowing over line hashes, with DataFrame operations only.

A text is a sequence of lines. Every window of ``window`` neighbouring lines selects its line of
the smallest hash (the leftmost on ties), and a line that is selected is one fingerprint, with its
position, however many windows select it; so a run of at least ``window`` equal lines in two places
is sure to share one. Positions are joined by fingerprint, and fingerprints that stand at one position
only can't start a match and go no further. At the others the match is extended both ways over the
lines around it: equal surroundings have one key, and of each key the first position in (doc_id, line)
order stays. Extensions that repeat an earlier one are joined to maximal runs, which are deleted. A
line of ``long_words`` words or more is selected by itself, so a long passage on one line counts as a
run; with ``pairs``, so are two neighbouring lines of as many words together (three are a run anyway).
No pairs of positions are made: a fingerprint that stands at n positions costs n rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import discard, let, scratch, spare

WINDOW = 3
LONG_WORDS = 50
#: Keys are two hashes of 64 bits, the second salted.
_SALT = 0x5EED


def _selected(text: Column, window: int, long_words: int, pairs: bool) -> Column:
    """Array of (fp, pos, around) of the selected lines of a text; around: the matches that extend from
    the line at ``pos``, as (at, size, k1, k2)."""
    words = lambda x: F.regexp_count(x, F.lit("[^ \\t-\\r]+"))
    # a line of n words has 2 n - 1 characters at least
    count = words if pairs else lambda x: F.when(F.length(x) >= 2 * long_words - 1, words(x)).otherwise(0)
    one = lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(_SALT), x).alias("g"), (F.length(F.trim(x)) == 0).alias("blank"), count(x).alias("words"))
    return let(F.transform(F.split(text, "\n", -1), one), lambda lines: let(F.transform(lines, lambda x: x.h), lambda hashes: _positions(lines, hashes, window, long_words, pairs)))


def _positions(lines: Column, hashes: Column, window: int, long_words: int, pairs: bool) -> Column:
    n = F.size(lines)
    none = F.array().cast("array<int>")

    def lowest(size: int):
        of = lambda i: let(F.slice(hashes, i + 1, size), lambda own: i + F.array_position(own, F.array_min(own)).cast("int") - 1)
        return F.when(n >= size, F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), of)).otherwise(none)

    def match(i: Column, size: int):
        line = lambda j: F.get(lines, i + j)
        blank = line(0).blank
        for j in range(1, size):
            blank = blank & line(j).blank
        total = sum((line(j).words for j in range(size)), F.lit(0))
        wanted = ~blank if size == window else total >= long_words
        return F.struct(i.alias("at"), F.lit(size).alias("size"), F.xxhash64(*(line(j).h for j in range(size))).alias("k1"), F.xxhash64(*(line(j).g for j in range(size))).alias("k2"), wanted.alias("wanted"))

    def around(p: Column, low: Column, size: int):
        starts = F.filter(F.array(*(p - j for j in range(size - 1, -1, -1))), lambda i: (i >= 0) & (i <= n - size) & F.coalesce(F.get(low, i) == p, F.lit(False)))
        return F.transform(starts, lambda i: match(i, size))

    def of_lines(low: Column, low2: Column | None):
        def at(x: Column, p: Column):
            found = [around(p, low, window), F.array(match(p, 1))]
            if low2 is not None:
                found.append(around(p, low2, 2))
            kept = F.transform(F.filter(F.concat(*found), lambda m: m.wanted), lambda m: F.struct(m.at.alias("at"), m.size.alias("size"), m.k1.alias("k1"), m.k2.alias("k2")))
            return F.struct(x.h.alias("fp"), p.alias("pos"), kept.alias("around"))

        return F.filter(F.transform(lines, at), lambda s: F.size(s.around) > 0)

    if pairs:
        return let(lowest(window), lambda low: let(lowest(2), lambda low2: of_lines(low, low2)))
    return let(lowest(window), lambda low: of_lines(low, None))


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, long_words: int = LONG_WORDS, pairs: bool = False) -> DataFrame:
    """(d1, d2, dead): by document key, the sorted line numbers (from 0) of later repeated runs."""
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = keyed.select("doc_id", F.xxhash64("doc_id", "text").alias("d1"), F.xxhash64(F.lit(_SALT), "doc_id", "text").alias("d2"), _selected(F.col("text"), window, long_words, pairs).alias("found"))
    found = keyed.select("doc_id", "d1", "d2", F.explode("found").alias("s")).select("doc_id", "d1", "d2", "s.fp", "s.pos", "s.around")
    found = scratch(found.withColumn("place", F.xxhash64("d1", "d2", "pos")), "fingerprints")
    # written, so that both sides of the joins are dealt for them and a hot fingerprint's rows can be split
    shared = scratch(found.groupBy("fp").agg(F.min("place").alias("a"), F.max("place").alias("z")).where("a <> z").select("fp"), "shared")
    extended = found.join(shared, "fp", "left_semi").select("doc_id", "d1", "d2", F.explode("around").alias("m")).select("doc_id", "d1", "d2", "m.*")
    extended = scratch(extended, "extended")
    discard(found, shared)
    first = extended.groupBy("k1", "k2", "size").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "d1", "d2", "at")).alias("first")).where("n > 1")
    first = scratch(first, "first")
    later = extended.join(first, ["k1", "k2", "size"]).where("first.d1 <> d1 or first.d2 <> d2 or first.at <> at")
    lines = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("size") - 1)))))
    return later.groupBy("d1", "d2").agg(lines.alias("dead"))


def _kept(lines: Column, dead: Column) -> Column:
    """The lines less those at the sorted positions ``dead``: slices between runs, so that the work is
    that of the lines, not of lines times removed lines."""
    starts = F.filter(dead, lambda x, i: (i == 0) | (F.get(dead, i - 1) < x - 1))
    ends = F.filter(dead, lambda x, i: (i == F.size(dead) - 1) | (F.get(dead, i + 1) > x + 1))

    def slices(ls: Column, s: Column, e: Column) -> Column:
        begin = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get(e, j - 1) + 1)
        end = lambda j: F.when(j == F.size(s), F.size(ls)).otherwise(F.get(s, j))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(s)), lambda j: F.slice(ls, begin(j) + 1, end(j) - begin(j))))

    return let(lines, lambda ls: let(starts, lambda s: let(ends, lambda e: slices(ls, s, e))))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, long_words: int = LONG_WORDS, pairs: bool = False, added: tuple[str, str, str] = ("__n_lines", "__n_removed_lines", "__n_runs")) -> DataFrame:
    """docs with ``text`` less its later repeated runs, and three BIGINT columns: the numbers of lines,
    of removed lines and of removed runs, under the names ``added``, which must not be in docs.

    The first occurrence in (doc_id, line) order stays, a null doc_id comes first, and rows that
    repeat a doc_id with the same text are one document: they keep and lose the same lines. A null
    text stays null with no lines; an empty one has one empty line. Lines are compared by 128-bit
    hashes; windows of blank lines only are no runs. An empty table gives an empty result, and other
    columns may have any names. ``pairs`` is off for op2, whose SQL has no such windows.
    """
    dead = repeated_runs(docs, doc_id, text, window, long_words, pairs)
    d1, d2, gone = spare([*docs.columns, *added], "__d1", "__d2", "__dead")
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumns({d1: F.xxhash64(F.col(doc_id), body), d2: F.xxhash64(F.lit(_SALT), F.col(doc_id), body)})
    dead = dead.select(F.col("d1").alias(d1), F.col("d2").alias(d2), F.col("dead").alias(gone))
    lines = F.split(F.col(text), "\n", -1)
    runs = F.size(F.filter(gone, lambda x, i: (i == 0) | (F.get(gone, i - 1) < x - 1)))
    numbers = (
        F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)),
        F.when(F.col(gone).isNull(), 0).otherwise(runs),
    )
    out = keyed.join(dead, [d1, d2], "left").withColumns({name: x.cast("bigint") for name, x in zip(added, numbers)})
    out = out.withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(_kept(lines, F.col(gone)), "\n")))
    return out.select(*docs.columns, *added)

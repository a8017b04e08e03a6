"""Repeated strings of symbols: column-wise suffix sorting of anchored windows.

Symbols are the bytes of a text, or its words. Every window of ``length`` symbols is dealt by its
minimizer, the smallest hash among its strings of ``k`` symbols (leftmost on ties). Equal windows have
equal minimizers at equal offsets, so strings of consecutive windows with one minimizer ("spans") are
laid under each other at that anchor, and only suffixes that start in the same column can match. The
collection's Burrows-Wheeler order and common prefixes are then built column by column from the right:
each round inserts one symbol of each string by a stable counting step and updates the common
prefixes, reading the previous column's order and the symbol columns front to back. The symbols that a
round reads, in the order of the round before, are that column's part of the transform. Large groups
keep their columns in an external file, written once and read in sequence.

Spans whose minimizer occurs once in the corpus cannot hold a repeat and go no further; spans of
equal content are one string with a count. A group of more than ``GROUP`` different strings is split by
the distance of windows from the anchor, halved until the group is small: the windows of one half share
all symbols but a few at either end, and are dealt by a hash of those. All steps are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.functions.ship import map_batches
from assaykit.llm.common import discard, scratch

LENGTH = 400
ANCHOR = 64
#: A passage is at least so many words, anchored at strings of so many.
PASSAGE_WORDS, PASSAGE_ANCHOR = 51, 8
#: Different strings of one minimizer that are sorted together; larger groups are split.
GROUP = 512
#: Bytes of strings sorted together; one group of a minimizer may be larger and is kept in a file.
BATCH = 12 << 20
IN_MEMORY = 48 << 20
#: Documents are cut into pieces of so many window starts, so that positions fit 24 bits.
PIECE = 1 << 23
#: Bytes of a symbol.
BYTE, WORD = 1, 4


def word_symbols(raw: bytes, memo: dict) -> bytes:
    """The words of a text as symbols of four bytes, their hashes."""
    from xxhash import xxh32_digest

    if len(memo) > 1 << 18:
        memo.clear()
    words = raw.split()
    for w in set(words).difference(memo):
        memo[w] = xxh32_digest(w)
    return b"".join(map(memo.__getitem__, words))


def _spans(raw: bytes, length: int, k: int, powers: dict, unit: int = BYTE):
    """(start, windows, anchor offset, minimizer hash) arrays of one text, counted in symbols."""
    import numpy as np

    out = []
    w, size_of = length - k + 1, len(raw) // unit
    for base in range(0, size_of - length + 1, PIECE):
        b = np.frombuffer(raw, f"u{unit}", min(size_of - base, PIECE + length - 1), base * unit)
        n = len(b)
        if len(powers.setdefault("p", np.ones(1, np.uint64))) < n + 1:
            m = max(2 * n, 1 << 16)
            up, down = np.full(m, 0x9E3779B97F4A7C15, np.uint64), np.full(m, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            powers["p"], powers["q"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers["p"][:n], out=total[1:])
        h = (total[k:] - total[:-k]) * powers["q"][: n - k + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        size = len(h)
        v = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(size, dtype=np.uint64)
        padded = np.full(-(-size // w) * w, np.iinfo(np.uint64).max, np.uint64)
        padded[:size] = v
        blocks = padded.reshape(-1, w)
        left = np.minimum.accumulate(blocks, axis=1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(right[: n - length + 1], left[w - 1 : w - 1 + n - length + 1]) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        out.append((first + base, np.diff(np.concatenate((first, [len(at)]))), at[first] - first, h[at[first]].view(np.int64)))
    return out


def _pointers(docs: DataFrame, length: int, k: int, unit: int) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        from assaykit.llm.common import binary_column

        powers: dict = {}
        memo: dict = {}
        names = ["k1", "k2", "mh", "c1", "c2", "start", "n", "anchor"]
        for batch in batches:
            ids = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            rows, starts, ns, anchors, hashes, content = [], [], [], [], [], []
            for i, raw in enumerate(binary_column(batch, "text")):
                raw = raw.as_py()
                if unit == WORD:
                    raw = word_symbols(raw, memo)
                if len(raw) < length * unit:
                    continue
                for s, n, a, mh in _spans(raw, length, k, powers, unit):
                    rows.append(np.full(len(s), i))
                    starts.append(s), ns.append(n), anchors.append(a), hashes.append(mh)
                    content += [xxh3_128_digest(raw[x * unit : (x + y + length - 1) * unit]) for x, y in zip(s.tolist(), n.tolist())]
            if rows:
                r = np.concatenate(rows)
                c = np.frombuffer(b"".join(content), np.int64).reshape(-1, 2)
                cols = [ids[0][r], ids[1][r], np.concatenate(hashes), c[:, 0], c[:, 1], np.concatenate(starts), np.concatenate(ns).astype(np.int32), np.concatenate(anchors).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in cols], names=names)

    return map_batches(docs.select("k1", "k2", "text"), run, "k1 bigint, k2 bigint, mh bigint, c1 bigint, c2 bigint, start bigint, n int, anchor int")


def column_sort(group, offset, size, data, length: int, unit: int = BYTE):
    """Repeated windows among anchored strings, by column-wise insertion from the right.

    group: non-decreasing group numbers; offset: the anchor's position in each string; data: the
    strings as bytes objects, ``unit`` bytes a symbol; offsets and sizes count symbols. Yields (column, strings) with the indices of strings whose window
    starting in that column has its ``length`` symbols in another string of the group as well.
    """
    import tempfile

    import numpy as np

    m = len(data)
    left, right = -offset.astype(np.int64), size.astype(np.int64) - offset
    lo, hi = int(left.min()), int(right.max())
    with tempfile.TemporaryFile() as file:
        shape = (hi - lo, m)
        # one row a column: written string by string, read row by row
        kind = np.dtype(f"u{unit}")
        symbols = np.zeros(shape, kind) if shape[0] * m * unit <= IN_MEMORY else np.memmap(file, kind, "w+", shape=shape)
        block = max(1, (8 << 20) // (shape[0] * unit))
        for i in range(0, m, block):
            part = np.zeros((min(block, m - i), shape[0]), kind)
            for j, x in enumerate(data[i : i + block]):
                a = int(left[i + j]) - lo
                part[j, a : a + len(x) // unit] = np.frombuffer(x, kind)
            symbols[:, i : i + block] = part.T
        entering = np.argsort(-right, kind="stable")
        order, lcp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        seen = 0
        for x in range(hi - 1, lo - 1, -1):
            more = seen
            while more < m and right[entering[more]] > x:
                more += 1
            if more > seen:  # strings that end here enter with the empty suffix, before all others of their group
                new = np.sort(entering[seen:more])
                seen = more
                at = np.searchsorted(group[order], group[new])
                order = np.insert(order, at, new)
                before = np.zeros(len(order), bool)
                before[at + np.arange(len(new))] = True
                grown = np.zeros(len(order), np.int64)
                grown[~before] = lcp
                follow = np.flatnonzero(before) + 1
                grown[follow[follow < len(order)]] = 0
                lcp = grown
            gone = left[order] > x
            if gone.any():  # whole strings have no symbol in this column: they leave, their neighbours meet
                stay = np.flatnonzero(~gone)
                if not len(stay):
                    order, lcp = order[:0], lcp[:0]
                    continue
                ranges = np.concatenate(([0], stay[:-1] + 1))
                lcp = np.minimum.reduceat(lcp[: stay[-1] + 1], ranges)
                lcp[0] = 0
                order = order[stay]
            g, s = group[order], symbols[x - lo][order]
            key = g.astype(np.int64) << 8 * unit | s.astype(np.int64)
            if (key[1:] >= key[:-1]).all():
                rank, same = None, key[1:] == key[:-1]
                lcp = np.concatenate(([0], np.where(same, np.minimum(lcp[1:] + 1, length), 0)))
            else:
                rank = np.argsort(key, kind="stable")
                sorted_key = key[rank]
                same = sorted_key[1:] == sorted_key[:-1]
                pairs = np.stack((rank[:-1][same] + 1, rank[1:][same] + 1), axis=1).ravel()
                fresh = np.zeros(len(order), np.int64)
                if len(pairs):
                    padded = np.append(lcp, 0)
                    fresh[1:][same] = np.minimum(np.minimum.reduceat(padded, pairs)[::2] + 1, length)
                order, lcp = order[rank], fresh
            long = lcp >= length
            if long.any():
                hit = long.copy()
                hit[:-1] |= long[1:]
                yield x, order[hit]
        del symbols


def _repeats_in_groups(rows: DataFrame, length: int, unit: int) -> DataFrame:
    """(mh, c1, c2, from, to): window ranges of each string that another string of its group repeats."""

    def solve(held):
        import numpy as np
        import pyarrow as pa

        mh, c1, c2, anchor, data = (np.concatenate([h[i] for h in held]) for i in range(5))
        rank = np.lexsort((c2, c1, mh))
        mh, c1, c2, anchor, data = mh[rank], c1[rank], c2[rank], anchor[rank], data[rank]
        once = np.concatenate(([True], (mh[1:] != mh[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])))
        mh, c1, c2, anchor, data = mh[once], c1[once], c2[once], anchor[once], data[once]
        group = np.concatenate(([0], np.cumsum(mh[1:] != mh[:-1])))
        size = np.fromiter(map(len, data), np.int64, len(data)) // unit
        who, where = [], []
        for x, strings in column_sort(group, anchor, size, data, length, unit):
            who.append(strings), where.append(x + anchor[strings])
        if not who:
            return None
        who, where = np.concatenate(who), np.concatenate(where)
        rank = np.lexsort((where, who))
        who, where = who[rank], where[rank]
        first = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (where[1:] != where[:-1] + 1))))
        last = np.concatenate((first[1:], [len(who)])) - 1
        s = who[first]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (mh[s], c1[s], c2[s], where[first].astype(np.int64), where[last].astype(np.int64) + 1)], names=["mh", "c1", "c2", "from", "to"])

    def run(batches):
        import numpy as np

        held, total, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            edge = np.flatnonzero(np.concatenate(([last is not None and cols[0][0] != last], cols[0][1:] != cols[0][:-1])))
            cut_at = int(edge[-1]) if len(edge) else None
            size = batch.nbytes
            if cut_at is not None and total + size > BATCH:
                held.append([c[:cut_at] for c in cols])
                if (out := solve(held)) is not None:
                    yield out
                held, total = [[c[cut_at:] for c in cols]], size
            else:
                held.append(cols)
                total += size
            last = cols[0][-1]
        if held and (out := solve(held)) is not None:
            yield out

    dealt = rows.select("mh", "c1", "c2", "anchor", "data").repartition("mh").sortWithinPartitions("mh")
    return map_batches(dealt, run, "mh bigint, c1 bigint, c2 bigint, `from` bigint, `to` bigint")


def _split(rows: DataFrame, length: int, unit: int, bits: int) -> DataFrame:
    """The rows' windows in blocks of 2 ** bits distances from the anchor, as strings of their own:
    (mh, c1, c2, n, anchor, data) and the row that each is of, as (of, of1, of2, at)."""
    wide = 1 << bits

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest, xxh3_64_intdigest

        names = ["mh", "c1", "c2", "n", "anchor", "data", "of", "of1", "of2", "at"]
        kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()] + [pa.int64()] * 3 + [pa.int32()]
        for batch in batches:
            out = []
            for mh, c1, c2, n, anchor, data in zip(*(batch.column(i).to_pylist() for i in range(6))):
                for b in range((anchor - n + 1) >> bits, (anchor >> bits) + 1):
                    low, high = max(anchor - n + 1, b * wide), min(anchor, (b + 1) * wide - 1)
                    at = anchor - high
                    part = data[at * unit : (anchor - low + length) * unit]
                    core = data[(anchor - b * wide) * unit : (anchor - (b + 1) * wide + 1 + length) * unit]
                    named = mh.to_bytes(8, "little", signed=True) + b.to_bytes(4, "little") + core
                    key = np.uint64(xxh3_64_intdigest(named, bits)).astype(np.int64)
                    k1, k2 = np.frombuffer(xxh3_128_digest(part), np.int64).tolist()
                    out.append((int(key), k1, k2, high - low + 1, high, part, mh, c1, c2, at))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    return map_batches(rows.select("mh", "c1", "c2", "n", "anchor", "data"), run, "mh bigint, c1 bigint, c2 bigint, n int, anchor int, data binary, of bigint, of1 bigint, of2 bigint, at int")


def _repeats(pieces: DataFrame, length: int, unit: int, bits: int, group: int) -> DataFrame:
    """(mh, c1, c2, from, to): window ranges of each string (mh, c1, c2, n, anchor, data) that another
    string of its mh repeats; no task holds more than ``group`` strings of one mh."""
    hot = scratch(pieces.groupBy("mh").agg(F.count("*").alias("m")).where(F.col("m") > group).select("mh"), "hot")
    if bits < 0 or hot.isEmpty():
        return _repeats_in_groups(pieces, length, unit)
    parts = scratch(_split(pieces.join(hot, "mh", "left_semi"), length, unit, bits), "parts")
    strings = parts.groupBy("mh", "c1", "c2", "n", "anchor").agg(F.count("*").alias("times"), F.first("data").alias("data"))
    strings = scratch(strings, "strings")
    several = strings.groupBy("mh").agg(F.count("*").alias("m")).where("m > 1").select("mh")
    below = scratch(strings.join(several, "mh", "left_semi").drop("times"), "pieces")
    found = _repeats(below, length, unit, bits - 1, group).unionAll(_whole(strings))
    back = parts.join(found, ["mh", "c1", "c2"]).select(F.col("of").alias("mh"), F.col("of1").alias("c1"), F.col("of2").alias("c2"), (F.col("from") + F.col("at")).alias("from"), (F.col("to") + F.col("at")).alias("to"))
    return _repeats_in_groups(pieces.join(hot, "mh", "left_anti"), length, unit).unionAll(back)


def _whole(strings: DataFrame) -> DataFrame:
    """All windows of strings that occur more than once."""
    return strings.where("times > 1").select("mh", "c1", "c2", F.lit(0).cast("long").alias("from"), F.col("n").cast("long").alias("to"))


def _fetched(texts: DataFrame, length: int, unit: int) -> DataFrame:
    """The strings that are ``wanted`` of each text."""

    def run(batches):
        import pyarrow as pa

        from assaykit.llm.common import binary_column

        memo: dict = {}
        names = ["mh", "c1", "c2", "n", "anchor", "data"]
        kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()]
        for batch in batches:
            for raw, wanted in zip(binary_column(batch, "text"), batch.column(1)):
                raw = raw.as_py()
                if unit == WORD:
                    raw = word_symbols(raw, memo)
                rows = [(w["mh"], w["c1"], w["c2"], w["n"], w["anchor"], raw[w["start"] * unit : (w["start"] + w["n"] + length - 1) * unit]) for w in wanted.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return map_batches(texts.select("text", "wanted"), run, "mh bigint, c1 bigint, c2 bigint, n int, anchor int, data binary")


def _anchored(keyed: DataFrame, length: int, k: int, unit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(some, strings, fetch): the spans whose minimizer occurs more than once, their different strings
    with counts, and by text those strings of it that must be compared."""
    pointers = scratch(_pointers(keyed, length, k, unit), "spans")
    # written, so that both sides of the join are dealt for it and a hot key's rows can be split
    shared = scratch(pointers.groupBy("mh").agg(F.count("*").alias("m")).where("m > 1").select("mh"), "minimizers")
    some = scratch(pointers.join(shared, "mh"), "shared")
    discard(pointers, shared)
    strings = some.groupBy("mh", "c1", "c2", "n", "anchor").agg(F.count("*").alias("times"), F.min(F.struct("k1", "k2", "start")).alias("at"))
    strings = scratch(strings, "strings")
    several = scratch(strings.groupBy("mh").agg(F.count("*").alias("m")).where("m > 1").select("mh"), "several")
    fetch = strings.join(several, "mh").groupBy("at.k1", "at.k2").agg(F.collect_list(F.struct("mh", "c1", "c2", F.col("at.start").alias("start"), "n", "anchor")).alias("wanted"))
    return some, strings, fetch


def _ranges(some: DataFrame, strings: DataFrame, pieces: DataFrame, length: int, k: int, unit: int, group: int) -> DataFrame:
    """(k1, k2, ranges): by text the ranges [from, to) of symbols in repeated windows, unsorted."""
    found = _repeats(pieces, length, unit, (length - k).bit_length() - 1, group).unionAll(_whole(strings))
    ranges = some.join(found, ["mh", "c1", "c2"]).select("k1", "k2", (F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("to") + F.lit(length - 1)).alias("to"))
    return ranges.groupBy("k1", "k2").agg(F.collect_set(F.struct("from", "to")).alias("ranges"))


def merged(ranges) -> list[list[int]]:
    """Maximal runs of ranges [from, to), sorted."""
    out: list[list[int]] = []
    for a, b in sorted((r["from"], r["to"]) for r in ranges or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return base.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit(1), "doc_id", "text")})


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = PASSAGE_WORDS, k: int = PASSAGE_ANCHOR, group: int = GROUP) -> DataFrame:
    """(k1, k2, n_passages, n_passage_words), for texts with any: the maximal runs of words that strings
    of ``words`` words cover which also start anywhere else, and the words in them. Words are told apart
    by 32-bit hashes. k1 and k2 are hashes of doc_id and text, which equal rows share."""
    k = min(k, words)
    keyed = _keyed(docs, doc_id, text)
    some, strings, fetch = _anchored(keyed, words, k, WORD)
    pieces = scratch(_fetched(keyed.join(fetch, ["k1", "k2"]), words, WORD), "pieces")
    ranges = _ranges(some, strings, pieces, words, k, WORD, group)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            runs = [merged(r.as_py()) for r in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(r) for r in runs], pa.int64()), pa.array([sum(b - a for a, b in r) for r in runs], pa.int64())], names=["k1", "k2", "n_passages", "n_passage_words"])

    out = scratch(map_batches(ranges, run, "k1 bigint, k2 bigint, n_passages bigint, n_passage_words bigint"), "passages")
    discard(some, strings, pieces)
    return out


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = ANCHOR, passage_words: int = PASSAGE_WORDS, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept BINARY or null, kept_sha256, n_passages,
    n_passage_words), a row per input row.

    Every byte covered by a ``length``-byte string that also starts anywhere else is removed; all
    strings are judged on the input. kept is null where nothing is removed, as the text itself is
    what stays. A passage of so many words may be shorter than ``length`` bytes: passages() reports
    those and removes nothing. Texts shorter than ``length``, empty and null ones lose nothing, null
    doc_ids are kept, repeated rows count as repeats of each other, and an empty table gives an empty
    result. Other columns of docs aren't read, whatever their names.
    """
    k = min(k, length)
    kind = docs.schema[doc_id].dataType.simpleString()
    keyed = _keyed(docs, doc_id, text)
    told = passages(docs, doc_id, text, passage_words, group=group)
    some, strings, fetch = _anchored(keyed, length, k, BYTE)
    held = some.select("k1", "k2").distinct().join(fetch, ["k1", "k2"], "left").withColumn("held", F.lit(True))
    joined = keyed.join(held, ["k1", "k2"], "left").join(told, ["k1", "k2"], "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_passages", "n_passage_words")]
    joined = joined.select("k1", "k2", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.expr("case when held is null then sha2(text, 256) end").alias("sha256"), F.expr("case when held then text end").alias("text"), "wanted", *counts)
    joined = scratch(joined, "held")
    pieces = scratch(_fetched(joined.where("wanted is not null"), length, BYTE), "pieces")
    ranges = _ranges(some, strings, pieces, length, k, BYTE, group)
    touched = joined.where("sha256 is null").select("k1", "k2", "doc_id", "text", "n_passages", "n_passage_words").join(ranges, ["k1", "k2"], "left").select("doc_id", "text", "ranges", "n_passages", "n_passage_words")

    def run(batches):
        import hashlib

        import pyarrow as pa

        from assaykit.llm.common import binary_column

        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for raw, ranges in zip(binary_column(batch, "text"), batch.column(2)):
                raw, runs = raw.as_py(), merged(ranges.as_py())
                ends = [0, *(x for r in runs for x in r), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2]))
                for col, x in zip(out, (len(raw), len(raw) - len(kept), len(runs), kept if runs else None, hashlib.sha256(kept).hexdigest())):
                    col.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds)), *batch.columns[3:]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "n_passages", "n_passage_words"])

    changed = map_batches(touched, run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string, n_passages bigint, n_passage_words bigint")
    return changed.unionAll(joined.where("sha256 is not null").select("doc_id", "n_bytes", F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("binary"), "sha256", "n_passages", "n_passage_words"))

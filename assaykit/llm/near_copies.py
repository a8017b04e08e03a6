"""Near copies by word shingles: one row of each group of texts that share most of their shingles.

A text is the set of its shingles of ``SHINGLE`` words. Two texts are linked if the Jaccard
similarity of their sets is at least ``SIMILARITY``; a group is what links connect. The first candidates
are op8's: SimHash fingerprints of the sets within its budget, found by its tries' self-join. Linked
texts may differ in more bits than any trie can search, so further ones come from MinHash: ``BANDS`` keys
of ``ROWS`` minima each, of which two linked texts share none with a probability of under 1e-6. The texts
of one key are a bucket.

Each text is compared with those that stand for its fingerprint and for its tries' components. Every bucket
is seen through whole: a task gets the sets of its texts, compares those that are not in one group yet, and
returns only the links that join two groups. So no link within a bucket is missed, no pairs are listed, and
there are no rounds. A bucket of more than ``BLOCK`` texts, or of longer ones, is cut into blocks, which are
seen through first by themselves, then, when what was found has been put together, two by two; blocks of
nothing but the bucket's largest group are not compared with each other. What is left is quadratic in the
texts of such a bucket that are not in its largest group, in bounded memory and over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.functions.ship import map_batches
from assaykit.llm.common import MAPS, among, discard, scratch, spare, tidy
from assaykit.llm.simhash import components, folded, link_stars

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 36, 5
#: Texts that a block of a bucket has on average at most, and bytes of their sets.
BLOCK, BYTES = 1024, 4 << 20
#: Pairs of one text that a task checks; beyond, its pairs are dealt over several.
PAIRS = 4000


def shingles(raw: bytes, shingle: int = SHINGLE):
    """Sorted distinct XXH64 of the shingles of a text; fewer words than ``shingle`` are one."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = raw.lower().split()
    n = len(words)
    if n <= shingle:
        return np.array([xxh64_intdigest(b" ".join(words), 42)] if n else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    stops = (ends - 1).tolist()[shingle - 1 :]
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, len(stops)))


def similar(a, b, similarity: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two sorted sets of hashes is at least ``similarity``."""
    import numpy as np

    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    if not len(a):
        return True
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(row, s1, s2, n, fp, keys): 128 bits of each text's set of shingles, its size, its SimHash and the keys of its
    bands."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        from assaykit.llm.common import binary_column

        rng = np.random.default_rng(42)
        a, b = (rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False) for _ in range(2))
        a |= np.uint64(1)
        for batch in batches:
            names, keys = np.zeros((batch.num_rows, 4), np.uint64), []
            for i, raw in enumerate(binary_column(batch, "text")):
                held = shingles(raw.as_py(), shingle)
                names[i] = [*(xxh64_intdigest(held.tobytes(), seed) for seed in (1, 2)), len(held), folded(held) if len(held) else 0]
                if not len(held):
                    keys.append([])
                    continue
                low = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
                for at in range(0, len(held), 1024):
                    low = np.minimum(low, (held[at : at + 1024, None] * a + b).min(0))
                keys.append(np.fromiter((xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low.reshape(BANDS, ROWS))), np.uint64, BANDS).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.view(np.int64)) for x in names.T.copy()), pa.array(keys, pa.list_(pa.int64()))], names=["row", "s1", "s2", "n", "fp", "keys"])

    return map_batches(rows, run, "row bigint, s1 bigint, s2 bigint, n bigint, fp bigint, keys array<bigint>")


def _checked(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of rows whose texts are similar enough. b's text is sent once to each task that
    checks pairs of it, and a task holds the shingles of one b at a time."""
    load = scratch(pairs.groupBy("b").agg((F.floor(F.count("*") / PAIRS) + 1).cast("int").alias("parts")), "load")
    part = F.lit(0)
    if not (heavy := load.where("parts > 1")).isEmpty():
        pairs, part = pairs.join(heavy, "b", "left"), F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int")
    left = pairs.select("b", part.alias("part"), "a")
    left = left.join(texts, left.a == texts.row).select("b", "part", "a", "text")
    right = load.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(texts, F.col("b") == texts.row).select("b", "part", F.lit(None).cast("bigint").alias("a"), "text")

    def run(batches):
        import pyarrow as pa

        from assaykit.llm.common import binary_column

        of, lead = None, None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for b, a, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), binary_column(batch, "text")):
                held = shingles(raw.as_py(), shingle)
                if a is None:
                    of, lead = b, held
                elif of == b and similar(held, lead, similarity):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    dealt = left.unionAll(right).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return map_batches(dealt, run, "a bigint, b bigint")


def _by_fingerprint(sets: DataFrame) -> DataFrame:
    """(a, b): each row of ``sets`` (row, fp) with the one that stands for its fingerprint, and those with the
    ones that stand for the components of op8's tries that they are in."""
    fps = scratch(sets.groupBy("fp").agg(F.min("row").alias("row")), "fps")
    same = sets.select("row", "fp").join(fps.select("fp", F.col("row").alias("b")), "fp").select(F.col("row").alias("a"), "b")
    stars = scratch(link_stars(fps.select("fp"), fps.count()).distinct(), "stars")
    near = stars.join(fps.select(F.col("fp").alias("a"), F.col("row").alias("x")), "a").join(fps.select(F.col("fp").alias("b"), F.col("row").alias("y")), "b")
    return same.unionAll(near.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))).where("a <> b").distinct()


def joining(sets: list, root, side, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Places (i, j) of linked ones of ``sets`` (sorted, not empty), each joining two groups, until all that are
    linked are in one. root: the groups so far; side: where there are two, only sets of different ones are
    compared."""
    import numpy as np

    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    stops = np.cumsum(sizes)
    words, place = np.unique(np.concatenate(sets), return_inverse=True)
    place = np.split(place.astype(np.int32), stops[:-1])
    of = np.unique(root, return_inverse=True)[1]
    two, held, out = (side != side[0]).any(), np.zeros(len(words), np.int32), []
    for i in range(len(sets) - 1):
        other = of[i + 1 :] != of[i]
        if two:
            other &= side[i + 1 :] != side[i]
        rows = i + 1 + np.flatnonzero(other & (np.minimum(sizes[i + 1 :], sizes[i]) >= similarity * np.maximum(sizes[i + 1 :], sizes[i]) - 1e-9))
        if not len(rows):
            if (of == of[0]).all():
                break
            continue
        held[place[i]] = 1
        ends = np.cumsum(sizes[rows])
        both = np.add.reduceat(held[np.concatenate([place[j] for j in rows])], np.concatenate(([0], ends[:-1])))
        held[place[i]] = 0
        for j in rows[both >= similarity * (sizes[i] + sizes[rows] - both) - 1e-9]:
            if of[i] != of[j]:
                of[of == of[j]] = of[i]
                out.append((i, int(j)))
    return out


def _parts(rows, n, block: int):
    """Blocks of so many rows whose sets have n hashes."""
    return F.ceil(F.greatest(rows / block, n * 8 / BYTES)).cast("bigint")


def _at(parts: str):
    return F.pmod(F.xxhash64("row"), F.col(parts))


def _cells(named: DataFrame, block: int) -> DataFrame:
    """(bucket, lo, hi, side, row, root): the rows of ``named`` (bucket, row, root, n) in each cell, two blocks of a
    bucket or one, in which they are compared: any two but for two of the largest group."""
    sizes = named.groupBy("bucket", "root").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    of = sizes.groupBy("bucket").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.max(F.struct("rows", "root", "n")).alias("main"), F.count("*").alias("groups")).where("groups > 1")
    of = of.select("bucket", F.col("main.root").alias("main"), _parts(F.col("main.rows"), F.col("main.n"), block).alias("first"), _parts(F.col("rows") - F.col("main.rows"), F.col("n") - F.col("main.n"), block).alias("more"))
    rows = named.join(of, "bucket").withColumn("side", F.when(F.col("root") == F.col("main"), _at("first")).otherwise(F.col("first") + _at("more")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(F.col("side") < F.col("first"), F.col("first")).otherwise(F.lit(0)), F.col("first") + F.col("more") - 1)))
    return rows.select("bucket", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "row", "root")


def _joined(cells: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): links between rows of a cell that join its groups."""

    def hashes(batches):
        import pyarrow as pa

        from assaykit.llm.common import binary_column

        for batch in batches:
            held = pa.array([shingles(raw.as_py(), shingle).tobytes() for raw in binary_column(batch, "text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), held], names=["row", "held"])

    held = map_batches(texts.join(cells.select("row").distinct(), "row", "left_semi"), hashes, "row bigint, held binary")
    cell = ["bucket", "lo", "hi"]
    dealt = cells.join(held, "row").select(*cell, "side", "row", "root", "held").repartition(*cell).sortWithinPartitions(*cell)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def links(rows):
            side, row, root = (np.array([r[i] for r in rows], np.int64) for i in range(3))
            found = np.array(joining([np.frombuffer(r[3], np.uint64) for r in rows], root, side, similarity), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(f(row[found[:, 0]], row[found[:, 1]])) for f in (np.maximum, np.minimum)], names=["a", "b"])

        last, rows = None, []
        for batch in batches:
            for bucket, lo, hi, *x in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, lo, hi) != last:
                    if rows:
                        yield links(rows)
                    last, rows = (bucket, lo, hi), []
                rows.append(x)
        if rows:
            yield links(rows)

    return map_batches(dealt, run, "a bigint, b bigint")


def _grouped(links: DataFrame) -> DataFrame:
    """(node, root): what links (a, b) connect, roots included."""
    found = components(links)
    return scratch(found.unionAll(found.select(F.col("root").alias("node"), "root")).distinct(), "grouped")


def groups(sets: DataFrame, texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(node, root): the rows of ``sets`` (row, n, fp, keys) in groups of two or more, with the group's least."""
    keys = sets.select("row", "n", F.posexplode("keys").alias("band", "key")).select("row", "n", F.xxhash64("band", "key").alias("bucket"))
    shared = scratch(keys.groupBy("bucket").agg(F.count("*").alias("rows")).where("rows > 1").select("bucket"), "shared")
    # nearly all buckets hold one row: a bit of 16 for each shared one leaves few others' keys to the join
    slots = F.lit(min(16 * shared.count() + 1, MAPS << 15)).cast("bigint")
    held = among(keys.withColumn("slot", F.pmod("bucket", slots)), "slot", shared.select(F.pmod("bucket", slots).alias("slot"))).drop("slot")
    held = scratch(held.join(shared, "bucket"), "held")
    tidy(held.sparkSession)
    # buckets of the same texts are one
    buckets = held.groupBy("bucket").agg(F.count("*").alias("rows"), F.sum("n").alias("all"), F.sum(F.xxhash64("row").cast("decimal(20,0)")).alias("s"), F.min("row").alias("first"))
    buckets = scratch(buckets.groupBy("rows", "all", "s", "first").agg(F.min("bucket").alias("bucket")).select("bucket", _parts(F.col("rows"), F.col("all"), block).alias("parts")), "buckets")
    members = scratch(held.join(buckets, "bucket").select("bucket", "row", "n", "parts"), "members")
    discard(shared, held, buckets)
    cells = members.withColumn("side", _at("parts")).select("bucket", F.col("side").alias("lo"), F.col("side").alias("hi"), "side", "row", F.col("row").alias("root"))
    pairs = scratch(_by_fingerprint(sets), "pairs")
    # only texts that are compared are dealt out
    texts = among(texts, "row", members.select("row").unionAll(pairs.select("a")).unionAll(pairs.select("b")))
    tidy(pairs.sparkSession)
    links = scratch(_checked(pairs, texts, shingle, similarity).unionAll(_joined(cells, texts, shingle, similarity)), "links")
    tidy(links.sparkSession)
    found = _grouped(links)
    large = members.where("parts > 1")
    if not large.isEmpty():
        named = large.join(found.withColumnRenamed("node", "row"), "row", "left").select("bucket", "row", F.coalesce("root", "row").alias("root"), "n")
        cells = scratch(_cells(named, block), "cells")
        links, old = scratch(links.unionAll(_joined(cells, texts, shingle, similarity)), "links"), links
        discard(old, found, cells)
        found = _grouped(links)
    discard(members, links)
    return found


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs less the near copies: of each group one row stays, that of the smallest
    doc_id, then hash of the text, then place. A null doc_id comes last; rows that repeat a doc_id are
    rows like others, and of equal rows one stays. Texts without a word (null, empty, blank) are equal,
    so one of them stays. Empty table: empty result. Further columns may have any names.
    """
    (row,) = spare(docs.columns, "__row")
    rows = scratch(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    texts = rows.select(F.col(row).alias("row"), F.col(text).alias("text"))
    sets = scratch(_sets(texts, shingle), "sets")
    ranks = rows.select(F.col(row).alias("row"), F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.xxhash64(text), F.col(row).alias("row")).alias("rank"))
    named = sets.select("row", "s1", "s2").join(ranks, "row")
    # equal sets need no check: one row stands for them
    lead = scratch(named.groupBy("s1", "s2").agg(F.min("row").alias("row"), F.min("rank").alias("rank")), "leads")
    found = groups(among(sets, "row", lead.select("row")), texts, shingle, similarity)
    discard(sets)
    kept = lead.join(found, lead.row == found.node, "left").groupBy(F.coalesce("root", "row")).agg(F.min("rank").getField("row").alias(row))
    return among(rows, row, kept.select(row)).select(*docs.columns)

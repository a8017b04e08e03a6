"""SimHash near-duplicates: a self-join of binary tries under a Hamming budget.

Two fingerprints within ``budget`` bits agree on at least ``blocks - budget`` of ``blocks`` bit
blocks. For each choice of that many blocks the fingerprints are seen through a bit order that
puts the chosen blocks first, so every link lies below one trie node at the depth of those
blocks. The rows are dealt by that node; each task walks its tries from there: node pairs are
split bit by bit together, differing bits are added up, and a pair whose count passes the budget
is dropped with everything below it. What leaves a task is a star per local component, never
all pairs, so a large group of near copies gives no more rows than it has members.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.ship import map_batches
from assaykit.llm.common import cut, discard, scratch, tidy

BUDGET = 4
SHINGLE = 4
#: A node pair with at most this many candidate pairs is compared directly.
LEAF = 64
#: Node pairs handled at once; more wait on a stack.
CHUNK = 1 << 17


def folded(h) -> int:
    """The SimHash of shingles' hashes, uint64: a bit is set if it is in over half of them."""
    import numpy as np

    by_byte = h.view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    count = np.concatenate([np.bincount(by_byte[:, k], minlength=256) @ bits for k in range(8)])
    return np.packbits(2 * count > len(h), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp BIGINT): the 64-bit SimHash of each whole text.

    Null, empty and wordless texts have fingerprint 0. Fewer words than ``shingle``: one shingle
    of all words. A bit is 1 if set in over half the shingles' XXH64 (seed 42), repeats included.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        from assaykit.llm.common import binary_column

        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for i, raw in enumerate(binary_column(batch, "text")):
                words = raw.as_py().lower().split()
                n = len(words)
                if not n:
                    continue
                if n <= shingle:
                    out[i] = xxh64_intdigest(b" ".join(words), 42)
                    continue
                joined = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
                starts = np.concatenate(([0], ends[:-1])).tolist()
                stops = (ends - 1).tolist()[shingle - 1 :]
                h = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, len(stops))
                out[i] = folded(h)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, fp bigint")


def bit_orders(budget: int, blocks: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(bit fields from the top as (shift, width), depth) for each choice of blocks - budget blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    fields = [(64 - b, b - a) for a, b in zip(edges, edges[1:])]
    orders = []
    for chosen in itertools.combinations(range(blocks), blocks - budget):
        first = [fields[i] for i in chosen]
        orders.append((tuple(first + [f for i, f in enumerate(fields) if i not in chosen]), sum(w for _, w in first)))
    return orders


def permuted(fp, order):
    """Fingerprints with their bit fields in the given order, most significant first."""
    import numpy as np

    out, left = np.zeros_like(fp), 64
    for shift, width in order:
        left -= width
        out |= ((fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)) << np.uint64(left)
    return out


class _Sets:
    """Union-find over array indices, vectorised; the smallest index names a set."""

    def __init__(self, n: int):
        import numpy as np

        self.of = np.arange(n)

    def join(self, a, b) -> None:
        import numpy as np

        while len(a):
            x, y = self.of[a], self.of[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            while (self.of != (up := self.of[self.of])).any():
                self.of = up


def trie_links(values, depth: int, budget: int = BUDGET):
    """Star links (member, root) as index pairs over sorted distinct uint64 ``values``.

    Two values are linked if they share the top ``depth`` bits and differ in at most ``budget``
    of the rest. Equal components get equal roots; singletons give nothing.
    """
    import numpy as np

    n = len(values)
    sets = _Sets(n)
    top = values >> np.uint64(64 - depth) if depth else np.zeros(n, np.uint64)
    start = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1]))) if n else np.zeros(0, np.int64)
    stop = np.concatenate((start[1:], [n])).astype(np.int64)
    some = stop - start > 1
    start, stop = start[some], stop[some]
    stack = [(depth, start, stop, start, stop, np.zeros(len(start), np.int8))]
    while stack:
        d, a0, a1, b0, b1, err = stack.pop()
        if not len(a0):
            continue
        if len(a0) > CHUNK:
            for i in range(0, len(a0), CHUNK):
                stack.append((d, *(x[i : i + CHUNK] for x in (a0, a1, b0, b1, err))))
            continue
        small = (a1 - a0) * (b1 - b0) <= LEAF
        if d >= 64:
            small[:] = True
        if small.any():
            x0, x1, y0, y1 = (x[small] for x in (a0, a1, b0, b1))
            for i in range(0, len(x0), CHUNK // 8):
                p0, q0, wide = x0[i : i + CHUNK // 8], y0[i : i + CHUNK // 8], (y1 - y0)[i : i + CHUNK // 8]
                many = (x1 - x0)[i : i + CHUNK // 8] * wide
                which = np.repeat(np.arange(len(many)), many)
                k = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
                p, q = p0[which] + k // wide[which], q0[which] + k % wide[which]
                near = (p < q) & (np.bitwise_count(values[p] ^ values[q]) <= budget)
                sets.join(p[near], q[near])
            a0, a1, b0, b1, err = (x[~small] for x in (a0, a1, b0, b1, err))
            if not len(a0):
                continue
        bit = np.uint64(1) << np.uint64(63 - d)
        clear = ~np.uint64((1 << (64 - d)) - 1) if d else np.uint64(0)
        am = np.clip(np.searchsorted(values, (values[a0] & clear) | bit), a0, a1)
        bm = np.clip(np.searchsorted(values, (values[b0] & clear) | bit), b0, b1)
        other = a0 != b0
        parts = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1), (am[other], a1[other], b0[other], bm[other], err[other] + 1)]
        joined = [np.concatenate([p[i] for p in parts]) for i in range(5)]
        keep = (joined[0] < joined[1]) & (joined[2] < joined[3]) & (joined[4] <= budget)
        stack.append((d + 1, *(x[keep] for x in joined)))
    member = np.flatnonzero(sets.of != np.arange(n))
    return member, sets.of[member]


def _blocks_for(n: int, budget: int) -> int:
    """More blocks give deeper roots and more copies of each row: chosen so that a root holds few
    of n spread-out fingerprints."""
    for blocks in range(budget + 1, budget + 5):
        if n < 1 << (64 * (blocks - budget) // blocks + 9):
            return blocks
    return budget + 4


def link_stars(fps: DataFrame, n: int, budget: int = BUDGET, blocks: int | None = None) -> DataFrame:
    """(a BIGINT, b BIGINT), a a fingerprint and b another of its component, from distinct ``fp``."""
    orders = bit_orders(budget, blocks or _blocks_for(n, budget))

    def mask(order, depth: int) -> int:
        at, m = 0, 0
        for shift, width in order:
            if at >= depth:
                break
            m |= ((1 << width) - 1) << shift
            at += width
        return m - (1 << 64) if m >= 1 << 63 else m

    roots: list[Column] = [F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(mask(*o)).cast("bigint")).alias("root")) for c, o in enumerate(orders)]
    dealt = fps.select("fp", F.explode(F.array(*roots)).alias("r")).select("fp", "r.c", "r.root").repartition("c", "root").sortWithinPartitions("c", "root")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def links(c, fp):
            order, depth = orders[c]
            seen = permuted(fp, order)
            rank = np.argsort(seen)
            member, root = trie_links(seen[rank], depth, budget)
            a, b = fp[rank[member]], fp[rank[root]]
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held: list = []
        last = None
        for batch in batches:
            c, root, fp = (batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in ("c", "root", "fp"))
            if not len(c):
                continue
            fp = fp.view(np.uint64)
            edge = np.flatnonzero((c[1:] != c[:-1]) | (root[1:] != root[:-1])) + 1
            if last is not None and (c[0], root[0]) != last:
                edge = np.concatenate(([0], edge))
            if len(edge):  # all before the last edge are whole roots
                held.append((c[: edge[-1]], fp[: edge[-1]]))
                hc, hf = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                for k in np.unique(hc):
                    yield links(int(k), hf[hc == k])
                held = [(c[edge[-1] :], fp[edge[-1] :])]
            else:
                held.append((c, fp))
            last = (c[-1], root[-1])
        if held:
            hc, hf = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            for k in np.unique(hc):
                yield links(int(k), hf[hc == k])

    return map_batches(dealt, run, "a bigint, b bigint")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of undirected ``edges`` (a, b); root is the smallest node.

    Alternates the large-star and small-star steps (Kiveris et al. 2014), writing the edges each
    round, until no edge changes. Nodes without an edge are not returned.
    """
    e = scratch(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = lambda d: d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = mark(e)
    if not before[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    held = e
    for _ in range(max_rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e, old = scratch(e.select("x.u", "x.v").where("u <> v").distinct(), "edges"), held
        discard(old)
        held = e
        tidy(e.sparkSession)
        after = mark(e)
        if after == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET, shingle: int = SHINGLE, blocks: int | None = None) -> DataFrame:
    """(doc_id, fp BIGINT, component_id): component_id is the smallest doc_id reachable by links of
    at most ``budget`` differing bits.

    One row per input row: repeated doc_ids stay repeated, a null doc_id keeps its row and never
    names a component unless it has no other member. Empty table: empty result.
    """
    marked = scratch(fingerprints(docs, doc_id, text, shingle), "simhash")
    fps = scratch(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    n = fps.count()
    found = components(link_stars(fps.select("fp"), n, budget, blocks))
    named = fps.join(found, fps.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = cut(named.join(ids, "root").select("fp", "component_id"))
    return marked.join(ids, "fp").select("doc_id", "fp", "component_id")

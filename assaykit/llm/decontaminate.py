"""Benchmark decontamination: q-gram counts in diagonal bands, verified by banded alignment.

Texts and items are compared as lower-case letters and digits, with one blank for each run of
anything else. An item of m symbols may differ in e = min(rate * m, (m - q) / q) edits. If it
occurs in a text within e edits, all of it lies in some band of e + 1 neighbouring diagonals, and
at least m - q + 1 - q * e of its q-grams match there (the q-gram lemma). So the q-gram matches of
each item are counted in bands of diagonals that overlap by e, bands below that bound are left,
and the others are aligned symbol by symbol in the band, many at a time; one whose edits are spent is
let go at once. The filter loses no occurrence.

Of the q-grams that many items share, each item leaves out as many as its bound allows, and the bound is
lowered by as many: of k matches wanted, at least k - x are among the others if x are not looked at. So an
opening that thousands of items share is not counted for each of them wherever it stands.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from assaykit.functions.ship import map_batches

Q = 10
RATE = 0.08
#: Items are searched in blocks of so many characters, each broadcast by itself.
BLOCK_CHARS = 4 << 20
#: A q-gram of more positions in the items than this is shared; cells of one alignment step, and matches
#: that are counted at once.
SHARED, CELLS, MATCHES = 16, 1 << 18, 1 << 22


def normalise(raw: bytes):
    """(symbols as uint32, original code point position of each)."""
    import numpy as np

    from assaykit.llm.common import code_points, letter_tables

    _, alnum, lower = letter_tables()
    cp = code_points(raw)
    known = alnum[cp]
    out = np.where(known, lower[cp], 32).astype(np.uint32)
    keep = known.copy()
    keep[1:] |= known[:-1]
    at = np.flatnonzero(keep)
    return out[at], at


def gram_hashes(symbols, q: int):
    import numpy as np

    n = len(symbols) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(q):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += symbols[j : j + n]
    h ^= h >> np.uint64(31)
    return h * np.uint64(0xBF58476D1CE4E5B9)


class Items:
    """The q-grams of benchmark items, sorted by hash, with a bit table before them."""

    def __init__(self, items: list[tuple], q: int, rate: float):
        import numpy as np

        self.q = q
        self.ids, self.symbols = [], []
        for item_id, text in items:
            s = normalise((text or "").encode())[0]
            while len(s) and s[-1] == 32:
                s = s[:-1]
            if len(s) >= q:  # shorter items are no evidence
                self.ids.append(item_id)
                self.symbols.append(s)
        m = np.array([len(s) for s in self.symbols], np.int64)
        self.edits = np.minimum((rate * m).astype(np.int64), (m - q) // q)
        self.needed = m - q + 1 - q * self.edits
        self.width = 1 << np.ceil(np.log2(self.edits + 2)).astype(np.int64)
        hashes = [gram_hashes(s, q) for s in self.symbols]
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
        at = np.concatenate([np.arange(len(x)) for x in hashes]) if hashes else np.zeros(0, np.int64)
        rank = np.argsort(h, kind="stable")
        h, item, at = h[rank], item[rank], at[rank]
        kept = self._without_shared(h, item)
        h, item, at = h[kept], item[kept], at[kept]
        self.keys, self.first = np.unique(h, return_index=True)
        self.first = np.append(self.first, len(h))
        self.item, self.at = item, at
        self.shift = np.uint64(64 - min(26, max(12, (32 * max(1, len(self.keys))).bit_length())))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[self.keys >> self.shift] = True

    def _without_shared(self, h, item):
        """Which of the q-grams, sorted by hash, are looked at; lowers ``needed`` by those that are not."""
        import numpy as np

        kept = np.ones(len(h), bool)
        if not len(h):
            return kept
        _, slot, times = np.unique(h, return_inverse=True, return_counts=True)
        times = times[slot]
        shared = np.flatnonzero(times > SHARED)
        shared = shared[np.lexsort((-times[shared], item[shared]))]  # by item, the most frequent first
        of = item[shared]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        out = shared[place < self.needed[of] - 1]
        kept[out] = False
        self.needed = self.needed - np.bincount(item[out], minlength=len(self.needed))
        return kept

    def occurrences(self, raws: list[bytes]):
        """(text number, item number, start, end, edits) of occurrences; positions in code points."""
        import numpy as np

        if not len(self.keys):
            return []
        parts = [normalise(r) for r in raws]
        sizes = np.array([len(s) for s, _ in parts], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes + 1)))
        flat = np.zeros(int(starts[-1]), np.uint32)
        for (s, _), a in zip(parts, starts.tolist()):
            flat[a : a + len(s)] = s
        h = gram_hashes(flat, self.q)
        pos = np.flatnonzero(self.table[h >> self.shift])
        slot = np.minimum(np.searchsorted(self.keys, h[pos]), len(self.keys) - 1)
        real = self.keys[slot] == h[pos]
        pos, slot = pos[real], slot[real]
        if not len(pos):
            return []
        text = np.searchsorted(starts, pos, side="right") - 1
        candidates = [self._bands(starts, text[a:b], pos[a:b], slot[a:b]) for a, b in self._portions(text, slot)]
        t, i, band = (np.concatenate(x) for x in zip(*candidates))
        found: dict[tuple[int, int], list] = {}
        for at, hit in self.align([p[0] for p in parts], t, i, band * self.width[i]):
            found.setdefault((int(t[at]), int(i[at])), []).append(hit)
        out = []
        for (t, i), hits in found.items():
            taken: list = []
            for edits, a, b in sorted(hits):
                if all(b <= x or a >= y for _, x, y in taken):
                    taken.append((edits, a, b))
            at = parts[t][1]
            out += [(t, i, int(at[a]), int(at[b - 1]) + 1, edits) for edits, a, b in sorted(taken, key=lambda x: x[1])]
        return out

    def _portions(self, text, slot):
        """Stretches of whole texts with about MATCHES matches of q-grams and items."""
        import numpy as np

        ends = np.flatnonzero(np.append(text[1:] != text[:-1], True)) + 1
        total = np.cumsum(self.first[slot + 1] - self.first[slot])[ends - 1]
        start, done = 0, 0
        for k, end in enumerate(ends.tolist()):
            if k + 1 == len(ends) or total[k + 1] - done > MATCHES:
                yield start, end
                start, done = end, total[k]

    def _bands(self, starts, text, pos, slot):
        """(text, item, band) with enough matches, of matches at ``pos`` with the q-grams ``slot``."""
        import numpy as np

        many = self.first[slot + 1] - self.first[slot]
        which = np.repeat(np.arange(len(pos)), many)
        entry = self.first[slot][which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        item = self.item[entry]
        diagonal = (pos - starts[text])[which] - self.at[entry]
        width = self.width[item]
        band = diagonal // width
        again = diagonal - band * width < self.edits[item]
        # pairs are numbered, so that a number and a band fit 64 bits however many texts and items there are
        pairs, number = np.unique(text[which] * len(self.ids) + item, return_inverse=True)
        key = number.astype(np.int64) << 32
        bands, count = np.unique(np.concatenate((key + band + (1 << 30), (key + band - 1 + (1 << 30))[again])), return_counts=True)
        pair, band = pairs[bands >> 32], (bands & 0xFFFFFFFF) - (1 << 30)
        text, item = pair // len(self.ids), pair % len(self.ids)
        enough = count >= self.needed[item]
        return text[enough], item[enough], band[enough]

    def align(self, texts: list, t, i, low):
        """(candidate, (edits, start, end)) of the best occurrence of item i in text t on the diagonals low to
        low + width + edits, of all candidates that have one within the edits of the item. Candidates of about
        one length go together, a row each."""
        import numpy as np

        lengths = np.array([len(s) for s in self.symbols], np.int64)
        order = np.lexsort((i, lengths[i]))
        at = 0
        while at < len(order):
            span = int((self.width[i[order[at]]] + self.edits[i[order[at]]] + 1))
            some = order[at : at + max(1, CELLS // span)]
            span = int((self.width[i[some]] + self.edits[i[some]] + 1).max())
            at += len(some)
            yield from self._aligned(texts, some, t[some], i[some], low[some], lengths[i[some]], span)

    def _aligned(self, texts, names, t, i, low, m, span: int):
        import numpy as np

        pad, never, longest = 1 << 24, 1 << 60, int(m.max())
        line = np.full((len(names), span + longest), 0xFFFFFFFF, np.uint32)
        wanted = np.full((len(names), longest), 0xFFFFFFFE, np.uint32)
        own = self.width[i] + self.edits[i] + 1
        for k in range(len(names)):
            a, b = max(0, int(low[k])), min(len(texts[t[k]]), int(low[k] + own[k] + m[k]))
            if a < b:
                line[k, a - low[k] : b - low[k]] = texts[t[k]][a:b]
            wanted[k, : m[k]] = self.symbols[i[k]]
        d = np.arange(span)
        beyond = d >= own[:, None]
        cost = np.where(beyond, never, d)  # edits * pad + the diagonal on which the path began
        before, step, most = cost, d * pad, self.edits[i]
        for r in range(longest):
            cost = cost + (line[:, r : r + span] != wanted[:, r, None]) * pad
            cost[:, :-1] = np.minimum(cost[:, :-1], before[:, 1:] + pad)
            cost = np.minimum.accumulate(cost - step, axis=1) + step
            cost[beyond] = never
            before = cost
            ends = m == r + 1
            gone = ends
            if ends.any() or r % 16 == 15:
                least = cost.argmin(1)
                edits = cost[np.arange(len(cost)), least] // pad
                for k in np.flatnonzero(ends & (edits <= most)).tolist():
                    end = int(least[k])
                    n, begin = divmod(int(cost[k, end]), pad)
                    start, stop = max(0, int(low[k]) + begin), min(len(texts[t[k]]), int(low[k]) + end + int(m[k]))
                    if start < stop:
                        yield int(names[k]), (n, start, stop)
                gone = ends | (edits > most)  # edits never grow fewer from row to row
            if gone.any():
                left = ~gone
                if not left.any():
                    return
                names, t, i, low, m, most, line, wanted, beyond, cost = (x[left] for x in (names, t, i, low, m, most, line, wanted, beyond, cost))
                before = cost


def item_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS):
    """Items objects that together hold every item; one unless the items pass ``block_chars``."""
    rows = items.select(F.col(item_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = math.ceil(total / block_chars) or 1
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b)
        yield Items([(r.id, r.text) for r in part.collect()], q, rate)


def unsearched(items: DataFrame, item_id: str = "item_id", text: str = "text", q: int = Q) -> DataFrame:
    """(item_id, symbols): the items that find_leaks() does not search for, as they have fewer than ``q``
    symbols; so short a text is no evidence. A null text has none."""
    kind = items.schema[item_id].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from assaykit.llm.common import binary_column

        for batch in batches:
            sizes = []
            for raw in binary_column(batch, "text").to_pylist():
                s = normalise(raw)[0]
                sizes.append(int(np.flatnonzero(s != 32)[-1]) + 1 if (s != 32).any() else 0)
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], names=["item_id", "symbols"])
            yield out.filter(pa.array([n < q for n in sizes], pa.bool_()))

    return map_batches(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")), run, f"item_id {kind}, symbols int")


def _runs(raws: list[bytes], size: int = 2 << 20):
    start = 0
    while start < len(raws):
        stop, total = start, 0
        while stop < len(raws) and (stop == start or total + len(raws[stop]) < size):
            total += len(raws[stop])
            stop += 1
        yield start, stop
        start = stop


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start, end, edits): each occurrence of an item in a whole text; start and
    end (exclusive) are code points of the text, edits those of the normalised alignment.

    Null and empty texts hold nothing, and items of fewer than ``q`` symbols are not searched for:
    unsearched() names them.
    Repeated rows and items each give their own rows. Occurrences of one item in a text don't
    overlap: the one of fewer edits stays, then the first.
    """
    spark = docs.sparkSession
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, start bigint, end bigint, edits int"
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = to_arrow_type(items.schema[item_id].dataType)
    out = None
    for block in item_blocks(items, item_id, item_text, q, rate, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            import pyarrow as pa

            from assaykit.llm.common import binary_column

            known = shared.value
            ids = pa.array(known.ids, kind)
            for batch in batches:
                raws = binary_column(batch, "text").to_pylist()
                hits = [(a + t, *rest) for a, b in _runs(raws) for t, *rest in known.occurrences(raws[a:b])]
                if hits:
                    t, i, start, end, edits = zip(*hits)
                    cols = [batch.column(0).take(pa.array(t)), ids.take(pa.array(i)), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int32())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "start", "end", "edits"])

        part = map_batches(rows, run, schema)
        out = part if out is None else out.unionAll(part)
    return out


def drop_leaked(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = Q, rate: float = RATE) -> DataFrame:
    """The rows of docs whose text holds no item, with all columns of docs; no shuffle. A null or empty text
    holds none and stays; columns may have any names; equal rows stay or go alike."""
    index = docs.columns.index(text)
    for block in item_blocks(items, item_id, item_text, q, rate):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            import numpy as np
            import pyarrow as pa

            from assaykit.llm.common import binary_column

            for batch in batches:
                raws = binary_column(batch, batch.schema.names[index]).to_pylist()
                clean = np.ones(len(raws), bool)
                for a, b in _runs(raws):
                    for t, *_ in shared.value.occurrences(raws[a:b]):
                        clean[a + t] = False
                yield batch.filter(pa.array(clean))

        docs = map_batches(docs, run, docs.schema)
    return docs

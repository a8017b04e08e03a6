"""Language identification by interpolated Kneser-Ney character models.

Each language has one n-gram model. Counts cover all training texts and are summed in Spark; the
model is a set of arrays sorted by hash, shared by all languages, so one lookup of a symbol's
n-gram gives its log-probability in every language. No n-gram is left out, however rare. A model of
more than ``MAX_CELLS`` values is cut into shards by the last symbol but one, which an n-gram shares
with all that its probability is interpolated from; one shard at a time is collected and broadcast. The language with the lowest cross-entropy a
symbol wins. How far above its language's mean a cross-entropy may lie, for a text of its length,
is calibrated on a fifth of the documents with a model of the rest; a text beyond that, or without a letter, is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.functions.ship import map_batches
from assaykit.llm.common import cut, scratch, spare

ORDER = 4
#: Most values (n-grams times languages) that are collected and broadcast at once, at about 50 bytes a
#: value on the driver while a shard is built and 12 in a worker. One symbol's n-grams aren't cut.
MAX_CELLS = 8_000_000
FOLDS = 5
#: A text is rejected beyond this many times the calibrated spread.
MARGIN = 2.0
#: The calibrated spread is never under this: three deviations of a symbol in ordinary prose.
LEAST_SPREAD = 4.0
#: Symbols that the confidence score counts at most.
SCORE_SYMBOLS = 12
UNKNOWN = "und"
EDGE = 1
#: Bytes of texts whose symbols are held at a time; a longer text is held alone. Each symbol takes some 150 bytes.
PIECE_BYTES = 256 << 10


def fold(doc_id: str):
    """crc32 of the id as text, mod FOLDS; null counts as 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS, F.lit(0))


def _symbols(raws: list[bytes]):
    """(symbols as uint64, document of each symbol) of texts: lower-case letters, and one blank for
    each run of anything else; ORDER - 1 edge symbols before each text."""
    import numpy as np

    from assaykit.llm.common import code_points, letter_tables

    letter, _, lower = letter_tables()
    texts = [code_points(r) for r in raws]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    gap = ORDER - 1
    ends = np.cumsum(sizes + gap)
    doc = np.repeat(np.arange(len(texts)), sizes + gap)
    cp = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
    edge = np.zeros(len(cp), bool)
    for at, n, x in zip((ends - sizes).tolist(), sizes.tolist(), texts):
        cp[at : at + n] = x
        edge[at - gap : at] = True
    is_letter = letter[cp] & ~edge
    out = np.where(is_letter, lower[cp], 32)
    out = np.where(out < 65536, out, 0xE000 | (out * 40503 >> 8) & 0xFFF).astype(np.uint64)
    out[edge] = EDGE
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    return out[keep], doc[keep], np.bincount(doc[is_letter], minlength=len(texts))


def _piece(raws: list[bytes], start: int) -> int:
    """Where a piece of PIECE_BYTES that begins at ``start`` ends."""
    stop, size = start, 0
    while stop < len(raws) and (stop == start or size + len(raws[stop]) < PIECE_BYTES):
        size += len(raws[stop])
        stop += 1
    return stop


def _ngrams(symbols):
    """n-gram that ends at each symbol, 16 bits a symbol; 0 at edges."""
    import numpy as np

    grams = symbols.copy()
    for back in range(1, ORDER):
        grams[back:] |= symbols[:-back] << np.uint64(16 * back)
    grams[symbols == EDGE] = 0
    return grams


def _mix(keys):
    import numpy as np

    h = keys * np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(35)
    h *= np.uint64(0x9FB21C651E98DF25)
    return h ^ h >> np.uint64(28)


class HashArray:
    """Keys sorted by hash, with a directory of the hashes' leading bits, and a row of values each."""

    def __init__(self, keys, values):
        import numpy as np

        h = _mix(keys)
        rank = np.argsort(h)
        self.hashes, self.values = h[rank], np.ascontiguousarray(values[rank])
        self.shift = 64 - max(4, min(22, int(len(keys)).bit_length() + 1))
        first = np.searchsorted(self.hashes >> np.uint64(self.shift), np.arange((1 << (64 - self.shift)) + 1, dtype=np.uint64))
        self.first = first.astype(np.int32)

    def find(self, keys):
        """Index of each key, -1 where there is none."""
        import numpy as np

        h = _mix(keys)
        bucket = (h >> np.uint64(self.shift)).astype(np.int64)
        at, stop = self.first[bucket], self.first[bucket + 1]
        if not len(self.hashes):
            return np.full(len(keys), -1)
        hit = (at < stop) & (self.hashes[np.minimum(at, len(self.hashes) - 1)] == h)
        out = np.where(hit, at, -1)
        open_ = np.flatnonzero(~hit & (at + 1 < stop))
        while len(open_):
            at[open_] += 1
            same = self.hashes[at[open_]] == h[open_]
            out[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            open_ = open_[at[open_] + 1 < stop[open_]]
        return out


class Model:
    """Interpolated Kneser-Ney probabilities of all languages, as hash arrays by order."""

    def __init__(self, langs: list[str], grams, lang_of, counts, whole=None, symbols=None, others=None):
        """grams, lang_of, counts: n-grams of the top order, the language's number and the count.

        Of a shard, ``symbols`` are the last symbols but one of its n-grams, or ``others`` those of all other
        shards, so that one shard has the n-grams of symbols that were never seen; ``whole`` is what it
        needs of all n-grams: by order the numbers of n-grams that occur once and twice, by language, and
        the keys and counts of single symbols."""
        import numpy as np

        self.langs, self.symbols, self.others = langs, symbols, others
        n_langs = len(langs)
        keys, inverse = np.unique(grams, return_inverse=True)
        table = np.zeros((len(keys), n_langs))
        np.add.at(table, (inverse, lang_of), counts)
        levels = []
        for order in range(ORDER, 0, -1):
            if whole and order == 1:
                keys, table = whole[1]
            once, twice = whole[0][order] if whole else ((table == 1).sum(0), (table == 2).sum(0))
            discount = np.clip(np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5), 0.05, 0.95)
            context, of = np.unique(keys >> np.uint64(16), return_inverse=True)
            total, kinds = np.zeros((len(context), n_langs)), np.zeros((len(context), n_langs))
            np.add.at(total, of, table)
            np.add.at(kinds, of, table > 0)
            share = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            own = np.maximum(table - discount, 0) / np.maximum(total, 1)[of]
            levels.append((keys, own, of, context, share))
            lower, down = np.unique(keys & np.uint64((1 << 16 * (order - 1)) - 1), return_inverse=True)
            fewer = np.zeros((len(lower), n_langs))
            np.add.at(fewer, down, table > 0)
            keys, table = lower, fewer
        base = np.full((1, n_langs), 1.0 / (len(levels[-1][0]) + 1))
        self.base, self.levels = base, []
        below_keys, below = None, None
        for order, (keys, own, of, context, share) in enumerate(reversed(levels), 1):
            back = base if below is None else below[np.searchsorted(below_keys, keys & np.uint64((1 << 16 * (order - 1)) - 1))]
            prob = own + share[of] * back
            self.levels.append((HashArray(keys, prob.astype(np.float32)), HashArray(context, share.astype(np.float32))))
            below_keys, below = keys, prob
        top = self.levels[-1][0]
        self.top = HashArray.__new__(HashArray)
        self.top.__dict__.update(top.__dict__ | {"values": np.log2(top.values)})

    def _prob(self, order: int, keys):
        import numpy as np

        if not order:
            return np.broadcast_to(self.base, (len(keys), len(self.langs)))
        probs, shares = self.levels[order - 1]
        at = probs.find(keys)
        out = probs.values[at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            k = keys[miss]
            c = shares.find(k >> np.uint64(16))
            share = np.where(c[:, None] >= 0, shares.values[c], 1.0)
            out[miss] = share * self._prob(order - 1, k & np.uint64((1 << 16 * (order - 1)) - 1))
        return out

    def sums(self, raws: list[bytes]):
        """(bits by text and language, symbols, letters) of texts; the bits are those of the n-grams of
        the shard, if the model is one."""
        import numpy as np

        n, n_langs = len(raws), len(self.langs)
        bits, count, letters = np.zeros((n, n_langs)), np.zeros(n, np.int64), np.zeros(n, np.int64)
        start = 0
        while start < n:
            stop = _piece(raws, start)
            symbols, doc, letters[start:stop] = _symbols(raws[start:stop])
            grams = _ngrams(symbols)
            real = grams != 0
            grams, doc = grams[real], doc[real]
            count[start:stop] = np.bincount(doc, minlength=stop - start)
            if self.symbols is not None or self.others is not None:
                last = grams >> np.uint64(16) & np.uint64(0xFFFF)
                own = np.isin(last, self.symbols) if self.others is None else ~np.isin(last, self.others)
                grams, doc = grams[own], doc[own]
            at = self.top.find(grams)
            logs = self.top.values[at]
            miss = np.flatnonzero(at < 0)
            if len(miss):
                logs[miss] = np.log2(self._prob(ORDER, grams[miss]))
            for k in range(n_langs):
                bits[start:stop, k] = -np.bincount(doc, weights=logs[:, k], minlength=stop - start)
            start = stop
        return bits, count, letters

    def entropies(self, raws: list[bytes]):
        """(bits a symbol by text and language, symbols, letters) of texts."""
        import numpy as np

        bits, count, letters = self.sums(raws)
        return bits / np.maximum(count, 1)[:, None], count, letters


def ngram_counts(docs: DataFrame, text: str = "text", lang: str = "lang", part=None) -> DataFrame:
    """(lang, part, gram, n): character n-grams of the top order of all whole texts with a language,
    by ``part``, a BIGINT column of docs."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from assaykit.llm.common import binary_column

        held: dict[tuple, list] = {}

        def fold_in(name: tuple) -> None:
            grams, counts = (np.concatenate(x) for x in zip(*held[name]))
            keys, inverse = np.unique(grams, return_inverse=True)
            held[name] = [(keys, np.bincount(inverse, weights=counts).astype(np.int64))]

        for batch in batches:
            texts, names = binary_column(batch, "text").to_pylist(), list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            for name in set(names):
                own = [t for t, x in zip(texts, names) if x == name]
                start = 0
                while start < len(own):
                    stop = _piece(own, start)
                    grams = _ngrams(_symbols(own[start:stop])[0])
                    held.setdefault(name, []).append(np.unique(grams[grams != 0], return_counts=True))
                    start = stop
                if name in held and sum(len(x) for x, _ in held[name]) > 1 << 19:
                    fold_in(name)
        for name in held:
            fold_in(name)
            keys, counts = held[name][0]
            yield pa.RecordBatch.from_arrays([pa.array([name[0]] * len(keys), pa.string()), pa.array([name[1]] * len(keys), pa.int64()), pa.array(keys.view(np.int64)), pa.array(counts)], names=["lang", "part", "gram", "n"])

    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), (F.lit(0) if part is None else part).cast("bigint").alias("part"))
    return map_batches(known, run, "lang string, part bigint, gram bigint, n bigint").groupBy("lang", "part", "gram").agg(F.sum("n").alias("n"))


class Trained:
    """The languages and the shards of a model, each built when it is asked for."""

    def __init__(self, langs: list[str], shards: list):
        self.langs, self.shards = langs, shards


def train(counts: DataFrame, max_cells: int = MAX_CELLS) -> Trained:
    """A model of every language in ngram_counts(), in shards of at most ``max_cells`` values each,
    unless one symbol has more. The result is the same for any number of shards."""
    import numpy as np

    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    symbol = F.shiftrightunsigned("gram", 16).bitwiseAND(F.lit(0xFFFF)).cast("int")
    sizes = counts.groupBy("lang", symbol.alias("symbol")).agg(F.count("*").alias("m")).collect()
    langs = sorted({r.lang for r in sizes})
    if not langs:
        return Trained([], [])
    by_symbol: dict[int, int] = {}
    for r in sizes:
        by_symbol[r.symbol] = by_symbol.get(r.symbol, 0) + r.m * len(langs)
    parts: list[list[int]] = [[]]
    held = 0
    for s in sorted(by_symbol):
        if parts[-1] and held + by_symbol[s] > max_cells:
            parts.append([])
            held = 0
        parts[-1].append(s)
        held += by_symbol[s]
    number = {k: i for i, k in enumerate(langs)}
    several = len(parts) > 1
    if several:
        counts = scratch(counts, "ngrams")
        whole = _whole(counts, number)

    def shard(symbols: list[int]):
        def build() -> Model:
            got = (counts.where(symbol.isin(symbols)) if several else counts).toArrow()
            lang_of = np.array([number[x] for x in got["lang"].to_pylist()], np.int64)
            rest = {}
            if several and symbols is parts[0]:
                rest = {"whole": whole, "others": np.array([s for p in parts[1:] for s in p], np.uint64)}
            elif several:
                rest = {"whole": whole, "symbols": np.array(symbols, np.uint64)}
            return Model(langs, got["gram"].to_numpy().view(np.uint64), lang_of, got["n"].to_numpy(), **rest)

        return build

    return Trained(langs, [shard(p) for p in parts])


def _whole(counts: DataFrame, number: dict[str, int]):
    """What a shard needs of all n-grams (lang, gram, n); single symbols and languages are few."""
    import numpy as np

    seen = {}
    for order in range(ORDER, 0, -1):
        seen[order] = np.zeros(len(number)), np.zeros(len(number))
        for r in counts.groupBy("lang").agg(F.sum((F.col("n") == 1).cast("int")), F.sum((F.col("n") == 2).cast("int"))).collect():
            seen[order][0][number[r.lang]], seen[order][1][number[r.lang]] = r[1], r[2]
        if order > 1:
            mask = F.lit((1 << 16 * (order - 1)) - 1).cast("bigint")
            counts = scratch(counts.groupBy("lang", F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.count("*").alias("n")), "ngrams")
    rows = counts.collect()
    keys = np.unique(np.array([r.gram for r in rows], np.uint64))
    table = np.zeros((len(keys), len(number)))
    for r in rows:
        table[np.searchsorted(keys, np.uint64(r.gram)), number[r.lang]] = r.n
    return seen, (keys, table)


def _judged(langs: list[str], bits, count, letters):
    """(predictions, scores, bits of the predicted language, symbols) as arrays."""
    import numpy as np
    import pyarrow as pa

    names = np.array([*langs, UNKNOWN], dtype=object)
    known = (letters > 0) & (len(langs) > 0)
    if len(langs):
        best = bits.argmin(1)
        low = bits[np.arange(len(bits)), best]
        weight = np.exp2((low[:, None] - bits) * np.minimum(count, SCORE_SYMBOLS)[:, None])
        score = np.where(known, 1.0 / weight.sum(1), 0.0)
    else:
        best, low, score = np.zeros(len(count), np.int64), np.zeros(len(count)), np.zeros(len(count))
    return [pa.array(names[np.where(known, best, -1)], pa.string()), pa.array(score), pa.array(np.where(known, low, 0.0)), pa.array(count)]


def annotate(docs: DataFrame, model: Trained, text: str = "text", prefix: str = "lid_") -> DataFrame:
    """docs with four more columns: pred (a language, or UNKNOWN for a text without a letter), score
    (0 to 1), bits (cross-entropy a symbol) and symbols; their names start with ``prefix``. Of languages
    of equal cross-entropy the first by name is predicted."""
    fields = [T.StructField(prefix + n, t) for n, t in (("pred", T.StringType()), ("score", T.DoubleType()), ("bits", T.DoubleType()), ("symbols", T.LongType()))]
    schema = T.StructType([*docs.schema.fields, *fields])
    if len(model.shards) > 1:
        return _by_shards(docs, model, text, schema)
    shared = docs.sparkSession.sparkContext.broadcast(model.shards[0]() if model.shards else Model([], *_none()))
    index = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        from assaykit.llm.common import binary_column

        m = shared.value
        for batch in batches:
            extra = _judged(m.langs, *m.entropies(binary_column(batch, batch.schema.names[index]).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=schema.names)

    return map_batches(docs, run, schema)


def _none():
    import numpy as np

    return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)


def _by_shards(docs: DataFrame, model: Trained, text: str, schema: T.StructType) -> DataFrame:
    """annotate() with one shard broadcast at a time: each gives its bits of every row, which are added."""
    row, own = spare(schema.names, "__row", "__bits")
    rows = scratch(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    texts = rows.select(F.col(row).alias("row"), F.col(text).alias("text"))
    found = None
    for build in model.shards:
        shared = docs.sparkSession.sparkContext.broadcast(build())

        def run(batches, shared=shared):
            import numpy as np
            import pyarrow as pa

            from assaykit.llm.common import binary_column

            for batch in batches:
                bits, count, letters = shared.value.sums(binary_column(batch, "text").to_pylist())
                table = np.column_stack((bits, count, letters)).astype(float)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * table.shape[1], pa.int32()), pa.array(table.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["row", "bits"])

        part = scratch(map_batches(texts, run, "row bigint, bits array<double>"), "bits")
        shared.destroy()
        found = part if found is None else found.unionAll(part)
    langs, n = model.langs, len(model.langs)
    sums = F.array(*(F.sum(F.get("bits", F.lit(i))) if i < n else F.max(F.get("bits", F.lit(i))) for i in range(n + 2)))
    total = found.groupBy(F.col("row").alias(row)).agg(sums.alias(own))

    def judge(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            table = np.reshape(batch.columns[-1].flatten().to_numpy(zero_copy_only=False), (batch.num_rows, n + 2))
            count, letters = table[:, n].astype(np.int64), table[:, n + 1].astype(np.int64)
            extra = _judged(langs, table[:, :n] / np.maximum(count, 1)[:, None], count, letters)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *extra], names=schema.names)

    return map_batches(rows.join(total, row).select(*docs.columns, own), judge, schema)


def calibrate(docs: DataFrame, model: Trained, text: str = "text", lang: str = "lang") -> dict[str, tuple[float, float]]:
    """(mean bits a symbol, spread) by language: the spread is the 99.9 % point of the excess over the
    mean times the root of the length, over the texts whose language is found."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    seen = cut(annotate(known, model).where("lid_pred = lang and lid_symbols > 0").select("lang", "lid_bits", "lid_symbols"))
    means = seen.groupBy("lang").agg((F.sum(F.col("lid_bits") * F.col("lid_symbols")) / F.sum("lid_symbols")).alias("mean"))
    excess = (F.col("lid_bits") - F.col("mean")) * F.sqrt("lid_symbols")
    rows = seen.join(F.broadcast(means), "lang").groupBy("lang").agg(F.first("mean").alias("mean"), F.percentile_approx(excess, 0.999, 10000).alias("spread"))
    return {r.lang: (r.mean, max(r.spread, LEAST_SPREAD)) for r in rows.collect()}


def rejected(limits: dict[str, tuple[float, float]], prefix: str = "lid_", margin: float = MARGIN):
    """Whether an annotated row is without a language or too unlike all of them."""
    far = F.lit(False)
    for name, (mean, spread) in sorted(limits.items()):
        own = F.col(prefix + "bits") > F.lit(mean) + F.lit(margin * spread) / F.sqrt(F.greatest(F.col(prefix + "symbols"), F.lit(1)))
        far = F.when(F.col(prefix + "pred") == name, own).otherwise(far)
    return (F.col(prefix + "pred") == UNKNOWN) | far


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", prefix: str = "lid_", max_cells: int = MAX_CELLS) -> DataFrame:
    """docs with ``prefix`` + pred, score, bits, symbols, rejected and held_out.

    Learns from rows whose fold is not 0 and whose language is not null; the rejection is calibrated
    on fold 1 with a model of the other learning folds. Predicts every row from its text alone. No rows to learn from: every prediction is UNKNOWN.
    """
    learn = docs.where(fold(doc_id) != 0)
    counts = cut(ngram_counts(learn, text, lang, fold(doc_id)))
    model = train(counts, max_cells)
    rest = train(counts.where("part <> 1"), max_cells)
    limits = calibrate(docs.where(fold(doc_id) == 1), rest, text, lang) if rest.langs else {}
    out = annotate(docs, model, text, prefix)
    return out.withColumns({prefix + "rejected": rejected(limits, prefix), prefix + "held_out": fold(doc_id) == 0})


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs that are not rejected, with the columns of docs, whatever their names."""
    prefix = "__lid_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return identify(docs, doc_id, text, lang, prefix).where(~F.col(prefix + "rejected")).select(*docs.columns)

"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages, and only bags have labels. Every passage of a text is encoded: what kinds
of characters it has, what its words look like, how they repeat, and hashed words. A layer embeds the
encodings; gated attention (tanh times sigmoid, after Ilse, Tomczak and Welling 2018) weighs a document's
passages against each other; the weighted sum of the embeddings is its representation, from which the
score follows. All weights, attention's included, are learned together from documents' labels.

Encoding and scoring run in the tasks, row by row, over whole texts. The network is fitted on the driver
on a sample whose rows and passages are bounded by the parameters below.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.ship import map_batches
from assaykit.llm.common import scratch, table

#: Words of a passage, about; a text is cut into passages of equal size.
PASSAGE = 64
#: Buckets of words by their look and by themselves.
SHAPES, WORDS = 32, 64
#: The labelled documents learned from, at most, in order of a hash of their id, and their passages; a
#: document of over a tenth of these is not learned from.
MAX_ROWS, MAX_PASSAGES = 6000, 60_000
#: Hashes of ids are folded to so many places.
PLACES = 1 << 31
#: Sizes of the embedding and of the attention.
EMBEDDING, ATTENTION = 24, 12
EPOCHS, BATCH, RATE, DECAY = 60, 64, 4e-3, 2e-3
#: The share of documents learned from that only tells when to stop, and the score from which a document
#: is predicted to be good.
WATCHED, THRESHOLD = 0.15, 0.7

#: Kinds of characters: each of these strings is one, besides small letters, capitals, digits, bytes beyond
#: ASCII, controls and all that is left.
MARKS = (" ", "\n", "\t\r\x0b\x0c", ".", ",", ";:", "!", "?", "'\"`", "()[]{}", "-_", "#", "*", "$", "%", "&", "|", "<>", "@", "/\\", "=+~^")
N_KINDS = len(MARKS) + 6
#: After the kinds: word length, words (log), different words, words equal to the last, words on lines seen
#: before, first and last passage.
WIDTH = N_KINDS + 7 + SHAPES + WORDS


def _kinds():
    import numpy as np

    table_ = np.full(256, N_KINDS - 1, np.uint8)
    table_[:32] = N_KINDS - 2
    for k, chars in enumerate(MARKS):
        table_[list(chars.encode())] = k
    n = len(MARKS)
    table_[97:123], table_[65:91], table_[48:58], table_[128:] = n, n + 1, n + 2, n + 3
    return table_


def encode(raw: bytes):
    """A row of WIDTH numbers per passage of a text; a text without a word is one passage of zeros."""
    from zlib import crc32

    import numpy as np

    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros((1, WIDTH), np.float32)
    k = max(1, round(n / PASSAGE))
    edges = np.linspace(0, n, k + 1).astype(np.int64)
    of = np.repeat(np.arange(k), np.diff(edges))
    size = np.diff(edges).astype(np.float64)
    seen = np.frombuffer(raw, np.uint8)
    kind = _KINDS[seen]
    blank = (kind <= 2).astype(np.int8)
    starts = np.flatnonzero(np.diff(blank, prepend=1) < 0)
    stops = np.flatnonzero(np.diff(blank, append=1) > 0) + 1
    cuts = np.append(starts[edges[:-1]], len(seen))
    within = np.repeat(np.arange(k), np.diff(cuts))
    share = np.bincount(within * N_KINDS + kind[cuts[0] :], minlength=k * N_KINDS).reshape(k, N_KINDS) / np.diff(cuts)[:, None]

    own = np.fromiter(map(crc32, words), np.int64, n)
    # letters and digits that follow their like go: what is left is a word's look
    look = np.minimum(kind, len(MARKS) + 3)
    same = np.append(False, (look[1:] == look[:-1]) & (look[1:] >= len(MARKS)))
    bare = (np.where(blank, 32, look + 64)).astype(np.uint8)[~same].tobytes()
    looks = np.fromiter(map(crc32, bare.split()), np.int64, n)
    per = lambda hits: np.bincount(of[hits], minlength=k) / size
    bucket = lambda h, m: np.bincount(of * m + h % m, minlength=k * m).reshape(k, m) / size[:, None]
    different = np.bincount(np.unique(of << 32 | own) >> 32, minlength=k) / size
    line_of = np.cumsum(seen == 10)[starts]
    lines, old, met = raw.split(b"\n"), [], set()
    for x in lines:
        old.append(x in met)
        met.add(x)
    again = np.array(old)[line_of]
    rest = [np.log1p(np.bincount(of, stops - starts, k) / size), np.log1p(size), different, per(np.append(False, own[1:] == own[:-1])), per(again), np.arange(k) == 0, np.arange(k) == k - 1]
    return np.concatenate((np.sqrt(share), np.stack(rest, 1), np.sqrt(bucket(looks, SHAPES)), np.sqrt(bucket(own, WORDS))), axis=1).astype(np.float32)


_KINDS = None


def _ready() -> None:
    global _KINDS
    if _KINDS is None:
        _KINDS = _kinds()


@dataclasses.dataclass
class Network:
    """Weights by name, the encodings' means and scales; ``share`` alone if there was nothing to tell apart."""

    share: float
    weights: dict | None = None
    mean: object = None
    scale: object = None

    def read(self, bags):
        """(scores, attention) of encoded documents; attention is an array a document."""
        import numpy as np

        sizes = np.array([len(b) for b in bags])
        if self.weights is None:
            return np.full(len(bags), self.share), [np.full(s, 1 / s) for s in sizes]
        out = forward(self.weights, (np.concatenate(bags) - self.mean) / self.scale, sizes)
        return 1 / (1 + np.exp(-out["logit"].astype(np.float64))), np.split(out["a"], np.cumsum(sizes)[:-1])


def forward(w: dict, x, sizes) -> dict:
    import numpy as np

    first = np.cumsum(sizes) - sizes
    e = np.tanh(x @ w["embed"] + w["embed0"])
    u, g = np.tanh(e @ w["look"]), 1 / (1 + np.exp(-(e @ w["gate"])))
    raw = (u * g) @ w["attend"]
    raw = np.exp(raw - np.repeat(np.maximum.reduceat(raw, first), sizes))
    a = raw / np.repeat(np.add.reduceat(raw, first), sizes)
    z = np.add.reduceat(a[:, None] * e, first, axis=0)
    return {"e": e, "u": u, "g": g, "a": a, "z": z, "logit": z @ w["out"] + w["out0"][0], "first": first}


def gradients(w: dict, x, sizes, labels) -> dict:
    """Of the mean log loss, by the chain rule from the score down to the encodings."""
    import numpy as np

    f = forward(w, x, sizes)
    d = (1 / (1 + np.exp(-f["logit"])) - labels) / len(labels)
    dz = np.repeat(d[:, None] * w["out"], sizes, axis=0)
    da = (dz * f["e"]).sum(1)
    dr = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["first"]), sizes))
    du = dr[:, None] * w["attend"] * f["g"] * (1 - f["u"] ** 2)
    dg = dr[:, None] * w["attend"] * f["u"] * f["g"] * (1 - f["g"])
    de = (f["a"][:, None] * dz + du @ w["look"].T + dg @ w["gate"].T) * (1 - f["e"] ** 2)
    return {"embed": x.T @ de, "embed0": de.sum(0), "look": f["e"].T @ du, "gate": f["e"].T @ dg, "attend": (f["u"] * f["g"]).T @ dr, "out": f["z"].T @ d, "out0": np.array([d.sum()])}


def learn(bags: list, labels) -> Network:
    """A network from encoded documents and labels of 0 and 1, by Adam with weight decay; of the epochs that
    of the least loss on the watched documents is taken. The same rows give the same network."""
    import numpy as np

    labels = np.asarray(labels, np.float64)
    share = (labels.sum() + 1) / (len(labels) + 2)
    if len(set(labels.tolist())) < 2:
        return Network(float(share))
    rng = np.random.default_rng(13)
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 0.02
    bags = [((b - mean) / scale).astype(np.float64) for b in bags]
    init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {"embed": init(WIDTH, EMBEDDING), "embed0": np.zeros(EMBEDDING), "look": init(EMBEDDING, ATTENTION), "gate": init(EMBEDDING, ATTENTION), "attend": init(ATTENTION), "out": init(EMBEDDING), "out0": np.array([np.log(share / (1 - share))])}
    # watched documents of either label
    order = rng.permutation(len(bags))
    watched = np.concatenate([order[labels[order] == v][: int(WATCHED * (labels == v).sum())] for v in (0, 1)])
    used = np.setdiff1d(order, watched)
    used = used if len(set(labels[used].tolist())) == 2 else order
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    least, kept, step = np.inf, w, 0
    for _ in range(EPOCHS):
        turn = rng.permutation(used)
        for i in range(0, len(turn), BATCH):
            pick = turn[i : i + BATCH]
            g = gradients(w, np.concatenate([bags[j] for j in pick]), np.array([len(bags[j]) for j in pick]), labels[pick])
            step += 1
            for k, v in g.items():
                m1[k], m2[k] = 0.9 * m1[k] + 0.1 * v, 0.999 * m2[k] + 0.001 * v * v
                w[k] = w[k] - RATE * (m1[k] / (1 - 0.9**step) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8) + DECAY * w[k] * (w[k].ndim > 1))
        look = watched if len(watched) else used
        out = forward(w, np.concatenate([bags[j] for j in look]), np.array([len(bags[j]) for j in look]))["logit"]
        loss = np.mean(np.logaddexp(0, out) - labels[look] * out)
        if loss < least:
            least, kept = loss, dict(w)
    return Network(float(share), kept, mean, scale)


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text, modulo 4, is 2. A null id is none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list, list]:
    """Encoded documents and labels to learn from. A document whose labels disagree is left out, and so
    are labels that are null; of rows with one doc_id each text counts."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("most"))
    known = known.where("label = most and doc_id is not null").select("doc_id", "label")
    # ids and hashes first: texts are read again for the rows picked and never shuffled
    own = docs.select("doc_id", F.xxhash64("text").alias("h"))
    rows = scratch(own.join(known.hint("merge"), "doc_id").distinct().withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(PLACES))), "known")
    bound = min(PLACES, int(PLACES * 1.5 * MAX_ROWS / max(1, rows.count())))
    chosen = F.broadcast(rows.where(F.col("place") <= bound).orderBy("place", "doc_id", "h").limit(MAX_ROWS))  # at most MAX_ROWS small rows
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(chosen, ["doc_id", "h"]).groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.first("label").alias("label"))

    def run(batches):
        import pyarrow as pa

        from assaykit.llm.common import binary_column

        _ready()
        for batch in batches:
            for doc, label, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_column(batch, "text")):
                bag = encode(raw.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.string()), pa.array([label], pa.int32()), pa.array([len(bag)], pa.int64()), pa.array([bag.tobytes()], pa.binary())], names=["doc", "label", "n", "bag"])

    coded = scratch(map_batches(texts.select(F.col("doc_id").cast("string").alias("doc"), F.col("label").cast("int"), "text"), run, "doc string, label int, n bigint, bag binary"), "bags")
    sizes = coded.where(F.col("n") <= MAX_PASSAGES // 10).groupBy("n").count().orderBy("n").collect()  # at most MAX_ROWS rows
    room, most = MAX_PASSAGES, 0
    for n, count in sizes:  # of the shortest documents on, while there is room
        room -= n * count
        most = n if room >= 0 else most
    import numpy as np

    rows = coded.where(F.col("n") <= most).orderBy(F.xxhash64("doc"), "doc", F.xxhash64("bag")).collect()
    return [np.frombuffer(r.bag, np.float32).reshape(r.n, WIDTH) for r in rows], [r.label for r in rows]


def score(docs: DataFrame, network: Network) -> DataFrame:
    """(doc_id, score, n_passages, top_passage, top_weight): the score of each whole text, and the passage
    (from 0) of the most attention with its weight. A null text is an empty one, and that is one passage
    without words. Rows that are repeated are scored each."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from assaykit.llm.common import binary_column

        _ready()
        for batch in batches:
            raws, found = binary_column(batch, "text"), [[], [], [], []]
            for i in range(0, len(raws), 32):
                bags = [encode(x.as_py()) for x in raws[i : i + 32]]
                scores, attention = network.read(bags)
                for column, v in zip(found, (scores, map(len, bags), (int(a.argmax()) for a in attention), (float(a.max()) for a in attention))):
                    column.extend(v)
            kinds = (pa.float64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.asarray(v), k) for v, k in zip(found, kinds))], names=["doc_id", "score", "n_passages", "top_passage", "top_weight"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double, n_passages bigint, top_passage bigint, top_weight double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """score() of all documents by a network learned from the labelled ones that are not held out, with
    held_out and predicted: 1 if the score is the threshold or more, else 0.

    Without labels of both kinds every score is the share of ones, (ones + 1) / (labels + 2). An empty
    table gives an empty result. Only doc_id and text are read of docs.
    """
    found = score(docs, learn(*sample(docs, labels)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages", "top_passage", "top_weight")


def passage_quality(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Mixing to target weights by soft membership.

A multinomial logistic regression on words, fitted on labelled documents, gives every document a
posterior over domains. Document d has n_d tokens and rate r_d >= 0, the expected number of times that
it is taken; its expected tokens of domain k are r_d * n_d * p_dk. The rates are the nonnegative least
squares solution for the target token totals, found by projected gradient from equal rates. Each
step is one distributed sum of a few numbers; it is scaled by the inverse Gram matrix of the
domains, with which the problem's curvature is 1, so the unprojected problem is solved by one step
and the projected one by a few.
"""

from __future__ import annotations

import math
import re
import statistics

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.functions.ship import map_batches
from assaykit.llm.common import discard, scratch, spare

DOMAINS = ("good", "plain", "toxic")
WEIGHTS = {"good": 0.88, "plain": 0.12, "toxic": 0.0}
#: Labelled rows that the classifier is fitted on at most, taken in order of a hash of their id.
MAX_LABELLED = 20_000
#: The classifier's features are whole words, the first so many code points of longer ones, and marks.
PREFIX = 4
#: The chance that a feature which says nothing is taken for one that tells domains apart, and how many
#: times as often it is in documents of some domain as in the others: at any size of the sample, words
#: whose shares differ a little stay out.
CHANCE, LIFT = 1e-4, 4.0
#: Ridge penalty of the regression, and its steps at most.
RIDGE, FIT_STEPS = 0.1, 300
#: Posteriors are rounded to this part of one; documents of equal rounded posteriors have one rate.
GRID = 256
#: The tokens to take in all, as a part of all tokens.
SHARE = 0.5
MAX_STEPS = 40
#: Where the steps end: a residual of this part of the total, or eight steps that gain less than this
#: part of the loss.
TOLERANCE, SETTLED = 1e-3, 0.1


def quality_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the table of labels: toxic, or else good or plain by quality."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "plain").alias("domain"))


_MARKS = re.compile(r"[^\w\s.,;:'\"()?\u2019\u201c\u201d-]")


def features(raw: bytes):
    """(tokens, counts): lower-case words of a text; ^ with the first PREFIX code points of each longer
    one; and ~ for words with a mark that ordinary sentences lack."""
    from collections import Counter

    words = raw.decode("utf-8", "replace").lower().split()
    out = Counter(words)
    for w, n in list(out.items()):
        if len(w) > PREFIX:
            out["^" + w[:PREFIX]] += n
        if _MARKS.search(w):
            out["~"] += n
    return len(words), out


class Classifier:
    """Logistic regression on the logarithms of one more than the counts of features()."""

    def __init__(self, domains: list[str], words: dict[str, int], weights):
        """weights: a row by feature and a last one for all texts, a column by domain."""
        self.domains, self.words, self.weights = domains, words, weights

    def posteriors(self, raws: list[bytes]):
        """(tokens, posteriors) of texts."""
        import numpy as np

        tokens, out = np.zeros(len(raws), np.int64), np.zeros((len(raws), len(self.domains)))
        find = self.words.get
        for i, raw in enumerate(raws):
            tokens[i], found = features(raw)
            known = [(j, n) for w, n in found.items() if (j := find(w)) is not None]
            score = self.weights[-1].copy()
            if known:
                at, n = zip(*known)
                score += np.log1p(n) @ self.weights[list(at)]
            score = np.exp(score - score.max())
            out[i] = score / score.sum()
        return tokens, out


def regress(rows, columns, values, labels, n_features: int, n_domains: int):
    """Weights of a multinomial logistic regression with a ridge penalty, by accelerated gradient steps
    under a diagonal bound of the curvature. rows, columns, values: the nonzero inputs of the documents
    that ``labels`` has the domains of. The last row of weights is that of all documents, without
    penalty; it starts at the logarithms of the domains' shares."""
    import numpy as np

    n = len(labels)
    weights = np.zeros((n_features + 1, n_domains))
    seen = np.bincount(labels, minlength=n_domains)
    weights[-1] = np.log((seen + 1) / (n + n_domains))
    if not n:
        return weights
    rows, columns = np.concatenate((rows, np.arange(n))), np.concatenate((columns, np.full(n, n_features)))
    values = np.concatenate((values, np.ones(n)))
    target = np.eye(n_domains)[labels]
    bound = 0.5 * np.bincount(columns, values * np.bincount(rows, values, n)[rows], n_features + 1)
    ridge = np.append(np.full(n_features, RIDGE), 0.0)
    ahead, pace = weights, 1.0
    for _ in range(FIT_STEPS):
        score = np.stack([np.bincount(rows, values * ahead[columns, k], n) for k in range(n_domains)], 1)
        score = np.exp(score - score.max(1, keepdims=True))
        left = score / score.sum(1, keepdims=True) - target
        slope = np.stack([np.bincount(columns, values * left[rows, k], n_features + 1) for k in range(n_domains)], 1) + ridge[:, None] * ahead
        new = ahead - slope / np.maximum(bound + ridge, 1e-9)[:, None]
        pace, old = (1 + math.sqrt(1 + 4 * pace * pace)) / 2, pace
        ahead, moved = new + (old - 1) / pace * (new - weights), np.abs(new - weights).max()
        weights = new
        if moved < 1e-4:
            break
    return weights


def least_g(n_domains: int, chance: float = CHANCE) -> float:
    """The G statistic that a feature which says nothing of the domains passes with probability
    ``chance``: the chi-squared quantile by Wilson and Hilferty."""
    d, z = n_domains - 1, statistics.NormalDist().inv_cdf(1 - chance)
    return d * (1 - 2 / (9 * d) + z * math.sqrt(2 / (9 * d))) ** 3 if d else 0.0


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", domain: str = "domain", domains=DOMAINS, max_labelled: int = MAX_LABELLED) -> Classifier:
    """A classifier of labelled documents; unlabelled, unknown and null domains are left out.

    A document with several labels counts for each. A feature is used if the share of documents with it
    differs between domains by more than chance (G test), and is LIFT times as great in one as in the
    others; there is no least count and no most number of them. The labelled rows are bounded by
    ``max_labelled``, and so is what is broadcast and collected here.
    """
    import numpy as np

    domains, several = list(domains), range(len(domains))
    known = labels.where(F.col(domain).isin(domains) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.array_position(F.array(*map(F.lit, domains)), F.col(domain)).cast("int").alias("k"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "k").limit(max_labelled)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(known), "doc_id")
    texts = scratch(texts.select((F.col("k") - 1).alias("k"), "text"), "labelled")

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        from assaykit.llm.common import binary_column

        held: dict[int, Counter] = {}
        seen: Counter = Counter()
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), binary_column(batch, "text").to_pylist()):
                held.setdefault(k, Counter()).update(features(raw)[1].keys())
                seen[k] += 1
        rows = [(k, w, n) for k, c in held.items() for w, n in c.items()] + [(k, None, n) for k, n in seen.items()]
        if rows:
            k, w, n = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(w, pa.string()), pa.array(n, pa.int64())], names=["k", "w", "n"])

    sums = [F.sum(F.when(F.col("k") == i, F.col("n")).otherwise(0)).alias(f"d{i}") for i in several]
    counts = scratch(map_batches(texts, run, "k int, w string, n bigint").groupBy("w").agg(*sums), "words")
    seen = np.array([x or 0 for x in counts.where("w is null").agg(*(F.sum(f"d{i}") for i in several)).first()], float)
    all_ = float(seen.sum())
    d = sum((F.col(f"d{i}") for i in several), F.lit(0))

    def part(x, whole, share):
        return F.when((x > 0) & (whole > 0), x * F.log(x / (whole * share))).otherwise(0.0)

    g, lift = F.lit(0.0), F.lit(0.0)
    for i in several:
        own = F.col(f"d{i}")
        if seen[i]:
            share = F.lit(float(seen[i]) / all_)
            g = g + part(own, d, share) + part(F.lit(float(seen[i])) - own, F.lit(all_) - d, share)
            lift = F.greatest(lift, (own + 0.5) / F.lit(float(seen[i]) + 1) / ((d - own + 0.5) / F.lit(all_ - float(seen[i]) + 1)))
    some = counts.where("w is not null").where((2 * g >= least_g(len(domains))) & (lift >= LIFT)).select("w").orderBy("w").collect()
    place = {r.w: i for i, r in enumerate(some)}
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def inputs(batches):
        import numpy as np
        import pyarrow as pa

        from assaykit.llm.common import binary_column

        for batch in batches:
            found = []
            for raw in binary_column(batch, "text").to_pylist():
                found.append([(j, n) for w, n in features(raw)[1].items() if (j := shared.value.get(w)) is not None])
            at = [pa.array([[x[c] for x in f] for f in found], pa.list_(pa.int32())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *at], names=["k", "at", "n"])

    got = map_batches(texts, inputs, "k int, at array<int>, n array<int>").toArrow()
    discard(counts, texts)
    y = got["k"].to_numpy().astype(np.int64)
    sizes = np.array([len(x) for x in got["at"].to_pylist()], np.int64)
    flat = [got[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(y) else np.zeros(0, np.int64) for c in ("at", "n")]
    weights = regress(np.repeat(np.arange(len(y)), sizes), flat[0].astype(np.int64), np.log1p(flat[1]), y, len(place), len(domains))
    return Classifier(domains, place, weights)


def memberships(docs: DataFrame, model: Classifier, text: str, tokens: str, posterior: str) -> DataFrame:
    """docs with two more columns: the number of tokens and the posteriors in order of the domains."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    index = docs.columns.index(text)
    schema = T.StructType([*docs.schema, T.StructField(tokens, T.LongType()), T.StructField(posterior, T.ArrayType(T.DoubleType()))])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from assaykit.llm.common import binary_column

        for batch in batches:
            n, p = shared.value.posteriors(binary_column(batch, batch.schema.names[index]).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), lists], names=[*batch.schema.names, tokens, posterior])

    return map_batches(docs, run, schema)


def cells(rows: DataFrame, n: int, grid: int = GRID) -> DataFrame:
    """(cell, __tokens, __p) of rows (__tokens, __p): rows of equal rounded posteriors, their tokens and
    their mean posteriors by tokens, so that sums over cells are those over rows."""
    cell = F.transform("__p", lambda x: F.round(x * grid).cast("int"))
    tokens = F.sum("__tokens").cast("double")
    mean = F.array(*(F.sum(F.col("__tokens") * F.get("__p", F.lit(i))) / F.greatest(F.sum("__tokens"), F.lit(1)) for i in range(n)))
    return rows.groupBy(cell.alias("cell")).agg(tokens.alias("__tokens"), mean.alias("__p"))


class Rates:
    """Rates as the steps that lead to them: a row's rate needs only its tokens and posteriors."""

    def __init__(self, start: float):
        self.start, self.steps, self.history = start, [], []

    def of(self, tokens, p):
        """(rates, points from which the next step is taken) of rows."""
        import numpy as np

        rate = ahead = np.full(len(tokens), self.start)
        for move, push, anew in self.steps:
            new = np.maximum(0.0, (rate if anew else ahead) - p @ move)
            ahead, rate = (1 + push) * new - push * rate, new
        return rate, ahead


def _arrays(batch):
    """(tokens, posteriors) of a batch with __tokens and __p."""
    import numpy as np

    tokens = batch.column(batch.schema.get_field_index("__tokens")).to_numpy(zero_copy_only=False).astype(float)
    p = batch.column(batch.schema.get_field_index("__p")).flatten().to_numpy(zero_copy_only=False)
    return tokens, np.reshape(p, (len(tokens), -1))


def _sums(rows: DataFrame, of, n: int) -> list[float]:
    """Sums over all rows of the n numbers that ``of`` gives for a batch's tokens and posteriors. The
    plan is the same whatever the numbers in ``of``, so nothing is compiled anew from step to step."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(n)
        for batch in batches:
            if batch.num_rows:
                total += of(*_arrays(batch))
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=[f"s{i}" for i in range(n)])

    parts = map_batches(rows, run, ", ".join(f"s{i} double" for i in range(n)))
    return [float(x or 0) for x in parts.agg(*(F.sum(f"s{i}") for i in range(n))).first()]


def solve_rates(rows: DataFrame, targets: list[float], steps: int = MAX_STEPS) -> Rates:
    """Rates of rows with __tokens and __p whose expected domain tokens come closest to targets.

    The rate starts equal for all rows; each step moves against the gradient, divided by a row's tokens
    and scaled by the inverse Gram matrix in that metric (so that a rate depends on what a text is, not
    on its length), from a point ahead of the last two rates (Nesterov), and is cut at 0. The momentum
    starts anew when the loss grows. A task works out its rows' rates from the steps so far, and only
    sums come to the driver. The result is the step of the least residual, history[-1]. Ends at ``steps``, when the residual is under TOLERANCE of the total, or
    when eight steps gain less than SETTLED.
    """
    import numpy as np

    k = len(targets)
    rows = rows.select("__tokens", "__p")

    def grams(tokens, p):
        return np.concatenate(([tokens.sum()], ((p * tokens[:, None]).T @ p).ravel()))

    first = _sums(rows, grams, 1 + k * k)
    goal = np.array(targets, float)
    out = Rates(float(goal.sum()) / first[0] if first[0] else 0.0)
    if not first[0]:
        return out
    inverse = np.linalg.pinv(np.array(first[1:]).reshape(k, k), rcond=1e-9)
    pace, loss = 1.0, []

    def expected(tokens, p):
        rate, ahead = out.of(tokens, p)
        a = p * tokens[:, None]
        return np.concatenate((rate @ a, ahead @ a))

    for step in range(steps + 1):
        got = np.array(_sums(rows, expected, 2 * k))
        now, next_ = got[:k] - goal, got[k:] - goal
        out.history.append(float(np.abs(now).sum() / max(goal.sum(), 1e-9)))
        loss.append(float(now @ inverse @ now))
        settled = step > 8 and loss[-9] - loss[-1] < SETTLED * loss[-9]
        if step == steps or out.history[-1] < TOLERANCE or settled:
            break
        anew = step > 0 and loss[-1] > loss[-2]  # overshot
        if anew:
            pace, next_ = 1.0, now
        pace, old = (1 + math.sqrt(1 + 4 * pace * pace)) / 2, pace
        out.steps.append((inverse @ next_, (old - 1) / pace, anew))
    # where no rates meet the targets, the scaled steps lead away from the nearest ones
    best = out.history.index(min(out.history))
    out.steps, out.history = out.steps[:best], out.history[: best + 1]
    return out


def mix(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", domain: str = "domain", weights: dict[str, float] | None = None, share: float = SHARE, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id if None) of docs, n_tokens, posterior_<domain>, rate and residual.

    The rates' expected domain tokens match ``share`` of all tokens, dealt by ``weights``, as
    closely as nonnegative rates can. A domain of weight 0 is unwanted: documents of no likelier domain
    have rate 0, and its target is what the others bring of it at equal rates, so that soft memberships of
    clean documents cost them nothing. residual is what is left, as a part of the target, equal in all
    rows. Documents of one rounded posterior have one rate, and the steps run over these cells, of
    which there are no more than GRID allows, so documents are scanned once for all steps.

    A null or empty text has no tokens, the prior as posterior and that cell's rate. Without labels the
    posteriors are equal. Repeated rows are rows like others and have equal rates; ties can't occur. An
    empty table gives an empty result. A column of ``keep`` with the name of one that is added (rate,
    say) keeps its name and its values; the added one has underscores appended.
    """
    weights = weights or WEIGHTS
    keep = [doc_id] if keep is None else list(keep)
    model = fit(docs, labels, doc_id, text, domain, list(weights))
    tokens, posterior, cell, body = spare(keep, "__tokens", "__p", "__cell", "__text")
    named = docs.select(*(F.col(c) for c in keep), F.col(text).alias(body))
    rows = scratch(memberships(named, model, body, tokens, posterior).drop(body), "memberships")
    table = scratch(cells(rows.select(F.col(tokens).alias("__tokens"), F.col(posterior).alias("__p")), len(weights)), "cells")
    total = float(table.agg(F.sum("__tokens")).first()[0] or 0)
    brought, wanted = [0.0] * len(weights), F.lit(True)
    if unwanted := [i for i, w in enumerate(weights.values()) if not w]:
        own = [F.get("__p", F.lit(i)) for i in unwanted]
        for x in own:
            wanted &= x < F.array_max("__p")
        got = table.where(wanted).agg(*(F.sum(F.col("__tokens") * x) for x in own)).first()
        for i, x in zip(unwanted, got):
            brought[i] = share * float(x or 0)
    scale = (total * share - math.fsum(brought)) / (math.fsum(weights.values()) or 1.0)
    rates = solve_rates(table.where(wanted), [w * scale if w else b for w, b in zip(weights.values(), brought)])
    residual = rates.history[-1] if rates.history else 0.0

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rates.of(*_arrays(batch))[0])], names=["cell", "rate"])

    found = scratch(map_batches(table.where(wanted), run, "cell array<int>, rate double"), "rates")
    (rate,) = spare([*keep, tokens, posterior], "__rate")
    found = found.select(F.col("cell").alias(cell), F.col("rate").alias(rate))
    rows = rows.withColumn(cell, F.transform(posterior, lambda x: F.round(x * GRID).cast("int"))).join(found, cell, "left")
    added = spare(keep, "n_tokens", *(f"posterior_{name}" for name in weights), "rate", "residual")
    values = [F.col(tokens), *(F.get(posterior, F.lit(i)) for i in range(len(weights))), F.coalesce(rate, F.lit(0.0)), F.lit(residual)]
    return rows.select(*keep, *(v.alias(a) for v, a in zip(values, added)))

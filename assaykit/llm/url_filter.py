"""URL filters: rules first, then words of host and path under naive Bayes.

A host's labels often run words together. Each run of letters is split into the words of the
highest unigram probability (Viterbi). The unigrams are counted over all urls: a run that stands
between marks of a path or of a label counts as a word, unless it is other words run together; a label
of one run says nothing by itself and counts by the words that it is split into (a round of hard
expectation-maximisation). The labelled sample's words have half of all probability, whatever the
number of urls. Runs and words are matched by joins, so the words are neither collected nor
broadcast, and there is no most number and no greatest length of them. Multinomial naive Bayes on
the words, fitted on a labelled sample of urls, judges the urls that no rule fits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.ship import map_batches
from assaykit.llm.common import discard, scratch

#: Fixed values: (verdict, host, path prefix).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Log-probability of a word that is in neither the sample nor the urls, and of each of its letters.
UNSEEN, LETTER = math.log(1e-6), -2.5
#: Words that others may be made of have so many letters at least.
SHORTEST_PART = 3
#: The labelled sample: words of hosts and paths, joined into urls of both classes by fit().
BLOCKED = "casino bet bets betting poker slots jackpot win winner lottery free prize spam farm adult xxx porn sex cam cams escort dating nude pills pharma viagra cheap loan loans payday crypto miner torrent warez crack keygen hack malware phish clickbait popup".split()
ALLOWED = "news blog wiki docs help support about contact school university library museum science health history travel food recipe music book books art photo forum community open source code project data research journal article magazine weather map city state gov town park garden home house family kids shop store market bank office work job career team sport football tennis chess game games film theatre radio".split()


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, its verdict) of the longest rule that fits, null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def best_split(run: str, known: list[tuple[int, int, float]], whole: bool = True) -> list[str]:
    """The words of a run of letters: known are (start, length, log-probability) of words in it, anything
    else costs UNSEEN and LETTER a letter. Equal scores keep the longer last word. ``whole``: whether the
    run may be one word."""
    n = len(run)
    ends: dict[int, list[tuple[int, float]]] = {}
    for at, size, p in known:
        if whole or size < n:
            ends.setdefault(at + size, []).append((at, p))
    best, back = [0.0], [0]
    open_, since = 0.0, 0  # the best place where an unseen word begins
    for i in range(1, n + 1):
        score, j = open_ + UNSEEN + LETTER * i, since
        for at, p in ends.get(i, ()):
            if best[at] + p > score or best[at] + p == score and at < j:
                score, j = best[at] + p, at
        best.append(score)
        back.append(j)
        if score - LETTER * i > open_:
            open_, since = score - LETTER * i, i
    words, i = [], n
    while i:
        words.append(run[back[i] : i])
        i = back[i]
    return words[::-1]


class Segmenter:
    """Viterbi splits under a unigram model of given counts."""

    def __init__(self, counts: dict[str, int]):
        total = float(sum(counts.values()) or 1)
        self.log = {w: math.log(n / total) for w, n in counts.items()}
        self.longest = max(map(len, counts), default=0)

    def cost(self, word: str) -> float:
        known = self.log.get(word)
        return known if known is not None else UNSEEN + LETTER * len(word)

    def split(self, run: str) -> tuple[str, ...]:
        known = [(i, j - i, self.log[run[i:j]]) for i in range(len(run)) for j in range(i + 1, min(len(run), i + self.longest) + 1) if run[i:j] in self.log]
        return tuple(best_split(run, known))

    def words(self, host: str, path: str) -> list[str]:
        import re

        runs = re.findall(r"[^\W\d_]+", host.rpartition(".")[0] or host) + re.findall(r"[^\W\d_]+", path.lower())
        return [w for r in runs for w in self.split(r)]


class Bayes:
    """Multinomial naive Bayes of two classes with add-one smoothing; unseen words say nothing."""

    def __init__(self, samples: list[tuple[list[str], bool]]):
        from collections import Counter

        counts = {k: Counter(w for words, bad in samples if bad == k for w in words) for k in (True, False)}
        vocabulary = set(counts[True]) | set(counts[False])
        sums = {k: sum(c.values()) + len(vocabulary) for k, c in counts.items()}
        self.odds = {w: math.log((counts[True][w] + 1) / sums[True]) - math.log((counts[False][w] + 1) / sums[False]) for w in vocabulary}
        bad = sum(b for _, b in samples)
        self.prior = math.log((bad + 1) / (len(samples) - bad + 1))

    def score(self, words: list[str]) -> float:
        """Posterior probability of the blocked class."""
        odds = self.prior + sum(self.odds.get(w, 0.0) for w in words)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def labelled_urls() -> list[tuple[str, str, bool]]:
    """(host, path, blocked) made by rule from the sample's words."""
    out = []
    for bad, words in ((True, BLOCKED), (False, ALLOWED)):
        n = len(words)
        for i, w in enumerate(words):
            out += [(f"{w}{words[(i + 7) % n]}.net", "/", bad), (f"www.{w}-{words[(i + 13) % n]}.com", f"/{words[(i + 3) % n]}/", bad)]
    # a blocked class is rarer: equal counts of ordinary urls twice over
    return out + [x for x in out if not x[2]]


def runs_of(host: Column, path: Column) -> Column:
    """Array of (run, alone): the runs of letters of a host without its last label, and of a path; alone:
    whether the run is a whole label of the host."""
    labels = F.split(F.regexp_replace(host, r"\.[^.]*$", ""), r"\.")
    letters = lambda x: F.regexp_extract_all(x, F.lit(r"\p{L}+"), F.lit(0))
    of_host = F.flatten(F.transform(labels, lambda x: F.transform(letters(x), lambda r: F.struct(r.alias("run"), (r == x).alias("alone")))))
    of_path = F.transform(letters(F.lower(path)), lambda r: F.struct(r.alias("run"), F.lit(False).alias("alone")))
    return F.concat(of_host, of_path)


def _matches(runs: DataFrame, words: DataFrame) -> DataFrame:
    """(k1, k2, known): by a run's hashes the (start, length, p) of the words (w, p) in it. Only parts of a
    length that some word has are looked up, and no part carries its whole run along."""
    sizes = sorted(r[0] for r in words.select(F.length("w")).distinct().collect() if r[0])

    def run(batches):
        import pyarrow as pa

        names, kinds = ("k1", "k2", "at", "size", "w"), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
        held: tuple[list, ...] = ([], [], [], [], [])

        def full() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, kinds)], names=names)
            for c in held:
                c.clear()
            return out

        for batch in batches:
            for text, k1, k2 in zip(*(c.to_pylist() for c in batch.columns)):
                for n in sizes:
                    for low in range(0, len(text) - n + 1, 10_000):
                        at = range(low, min(low + 10_000, len(text) - n + 1))
                        for c, values in zip(held, ([k1] * len(at), [k2] * len(at), at, [n] * len(at), [text[i : i + n] for i in at])):
                            c.extend(values)
                        if len(held[0]) >= 10_000:
                            yield full()
        if held[0]:
            yield full()

    parts = map_batches(runs.select("run", "k1", "k2"), run, "k1 bigint, k2 bigint, at int, size int, w string")
    known = F.collect_list(F.struct("at", "size", "p"))
    return parts.join(words, "w").groupBy("k1", "k2").agg(known.alias("known"))


def _split_runs(runs: DataFrame, words: DataFrame, whole: bool = True) -> DataFrame:
    """(run, words): the best split of each run under the words (w, p)."""
    keyed = runs.select("run", F.xxhash64("run").alias("k1"), F.xxhash64(F.lit(1), "run").alias("k2"))
    rows = keyed.join(_matches(keyed, words), ["k1", "k2"], "left").select("run", "known")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [best_split(r, [(k["at"], k["size"], k["p"]) for k in known or ()], whole) for r, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["run", "words"])

    return map_batches(rows, run, "run string, words array<string>")


def unigrams(counted: DataFrame) -> DataFrame:
    """(w, p): log-probabilities of words by the counts (w, n) and the labelled sample, half each."""
    total = float(counted.agg(F.sum("n")).first()[0] or 0)
    known = [*BLOCKED, *ALLOWED]
    of_sample = counted.sparkSession.createDataFrame([(w,) for w in sorted(set(known))], "w string").withColumn("s", F.lit(1.0 / len(set(known))))
    both = counted.select("w", "n", F.lit(None).cast("double").alias("s")).unionAll(of_sample.select("w", F.lit(0).cast("bigint"), "s"))
    share = F.lit(0.5) * F.coalesce(F.sum("n"), F.lit(0)) / F.lit(total or 1.0) + F.lit(0.5) * F.coalesce(F.sum("s"), F.lit(0.0))
    return both.groupBy("w").agg(F.log(share).alias("p"))


def segment(rows: DataFrame) -> DataFrame:
    """(run, words) of every run in ``runs``, an array (run, alone) of rows, by unigrams over all rows."""
    seen = rows.select(F.explode("runs").alias("r")).groupBy("r.run", "r.alone").agg(F.count("*").alias("n"))
    seen = scratch(seen, "runs")
    runs = scratch(seen.select("run").distinct(), "distinct")
    apart = seen.where(~F.col("alone")).select(F.col("run").alias("w"), "n")
    words = scratch(unigrams(apart), "words")
    # a run that is other words run together is no word, however often it is seen
    parts = words.where(F.length("w") >= SHORTEST_PART)
    sample = F.col("run").isin([*BLOCKED, *ALLOWED])
    made = _split_runs(apart.select(F.col("w").alias("run")).where(~sample), parts, whole=False)
    pieces = scratch(made.select("run", F.explode("words").alias("w")).join(words, "w", "left").groupBy("run").agg(F.max(F.col("p").isNull()).alias("new"), F.count("*").alias("m")), "made")
    made = pieces.where("m > 1 and not new").select(F.col("run").alias("w"))
    own = scratch(unigrams(apart.join(made, "w", "left_anti")), "own")
    first = scratch(_split_runs(runs, own), "splits")
    counted = seen.join(first, "run").select(F.explode("words").alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n"))
    # what is counted anew are words, pieces that are no words included: they split no further
    last = scratch(unigrams(counted.join(made, "w", "left_anti")), "last")
    out = scratch(_split_runs(runs, last), "segments")
    discard(words, pieces, own, first, last, seen, runs)
    return out


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, words): one row per row of pages.

    A null url, or one without ://, has an empty host and path, fits no rule and is judged by the
    prior. score is the blocked class's posterior, words the segmented words. Equal urls have equal
    results, a null page_id keeps its row, and an empty table gives an empty result; no other column of
    pages is read. Of rules of equal length the last named wins.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("runs", runs_of(F.col("host"), F.col("path")))
    rows = scratch(rows.withColumn("key", F.array_join(F.transform("runs", lambda r: r.run), " ")), "urls")
    split = segment(rows)
    cutter = Segmenter(dict.fromkeys([*BLOCKED, *ALLOWED], 1))
    bayes = Bayes([(cutter.words(h, p), bad) for h, p, bad in labelled_urls()])
    odds = F.create_map(*(F.lit(x) for w, o in sorted(bayes.odds.items()) for x in (w, o)))
    told = split.withColumn("odds", F.aggregate("words", F.lit(0.0), lambda a, w: a + F.coalesce(odds[w], F.lit(0.0))))
    # equal runs are looked up once, however many urls have them
    keys = rows.select("key", "runs").dropDuplicates(["key"]).select("key", F.posexplode("runs").alias("at", "r")).select("key", "at", "r.run")
    found = keys.join(told, "run").groupBy("key").agg(F.sum("odds").alias("odds"), F.array_sort(F.collect_list(F.struct("at", "words"))).alias("parts"))
    found = scratch(found.select("key", "odds", F.array_join(F.flatten(F.transform("parts", lambda x: x.words)), " ").alias("words")), "found")
    total = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.lit(bayes.prior) + F.coalesce("odds", F.lit(0.0))))
    scored = rows.join(found, "key", "left").select("page_id", "host", "path", (1 / (1 + F.exp(-total))).alias("score"), F.coalesce("words", F.lit("")).alias("words"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") > threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score", "words")

"""Secret scans by patterns and by character Markov models, with DataFrame operations only.

Patterns give the base spans. Long tokens elsewhere are held against two character bigram models,
one of random strings and one of ordinary identifiers, fitted on labelled samples; a token whose
log-likelihood ratio is high enough is a span too. Positions come from the gaps and the matches of
a pattern, which together make up the text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm.common import let

#: Kinds in order of rank, their patterns and shortest lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
MIN_ASSIGN, MIN_ACCESS = 6, 20
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: A token is a span if its ratio is at least so much in all and for each bigram.
MIN_RATIO, MIN_MEAN = 12.0, 0.45
SAMPLES = 4096
#: Parts of ordinary identifiers for the labelled samples.
PARTS = "get set make load save parse user name list map index count total value file path data table column row key query result error handler request response session config option default test spec main base model view item node tree graph edge list size width height color image text line word page title header footer button click event state action reducer service client server database connection pool thread task queue job worker cache buffer stream reader writer format string number integer boolean array object class method function variable constant module package import export interface implementation factory builder manager controller provider adapter wrapper utility helper common shared global local internal external public private abstract the and of tion ing ment able ness https www com html index".split()


def running(steps: Column, block: int = 64) -> Column:
    """Array of the sums of the first 0, 1, 2, ... numbers of an array. Sums of whole blocks are kept, so
    that an array of n costs n times a block and not n times n."""
    add = lambda a: F.aggregate(a, F.lit(0), lambda t, x: t + x)

    def sums(all_: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), (F.size(all_) / block).cast("int")), lambda b: add(F.slice(all_, b * block + 1, block)))
        before = F.aggregate(blocks, F.array(F.lit(0)), lambda t, x: F.array_append(t, F.element_at(t, -1) + x))
        place = lambda s, i: F.get(s, (i / block).cast("int")) + add(F.slice(all_, i - i % block + 1, i % block))
        return let(before, lambda s: F.transform(F.sequence(F.lit(0), F.size(all_)), lambda i: place(s, i)))

    return let(steps, sums)


def spans_of(text: Column, pattern: str, kind: str, rank: int, least: int = 0, group: int = 0) -> Column:
    """Array of (start, rank, stop, kind, hit) of the leftmost matches of pattern; of those whose
    ``group`` has ``least`` characters, if given."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(h: Column) -> Column:
        steps = F.zip_with(gaps, h, lambda g, x: F.length(g) + F.coalesce(F.length(x), F.lit(0)))
        ends = running(steps)
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else h
        make = lambda e, v: F.transform(h, lambda x, i: F.struct((F.get(e, i + 1) - F.length(x)).alias("start"), F.lit(rank).alias("rank"), F.get(e, i + 1).alias("stop"), F.lit(kind).alias("kind"), x.alias("hit"), F.length(F.get(v, i)).alias("n")))
        return let(ends, lambda e: let(value, lambda v: F.filter(make(e, v), lambda x: x.n >= least)))

    none = F.array().cast("array<struct<start:int,rank:int,stop:int,kind:string,hit:string,n:int>>")
    return F.when(text.rlike(pattern), let(hits, placed)).otherwise(none)


def base_spans(text: Column) -> Column:
    parts = (spans_of(text, ASSIGN, "assign", 0, MIN_ASSIGN, 2), spans_of(text, ACCESS, "access", 1, MIN_ACCESS), spans_of(text, HEX, "hex", 2))
    return F.array_sort(F.concat(*parts))


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(token, random BOOLEAN): n rows made by rule, half random strings in base 64 and in hex, half
    identifiers in snake, camel, kebab and path case."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    raw = F.unhex(F.concat(digest, F.sha2(F.concat(F.lit("x"), F.col("id").cast("string")), 256)))
    size = 20 + F.pmod(F.xxhash64("id"), F.lit(24)).cast("int")
    strings = F.when(F.col("id") % 8 < 6, F.substring(F.translate(F.base64(raw), "\r\n", ""), F.lit(1), size)).otherwise(F.substring(digest, F.lit(1), size))
    parts = F.array(*map(F.lit, PARTS))
    pick = F.transform(F.sequence(F.lit(1), 3 + F.pmod(F.xxhash64("id"), F.lit(4)).cast("int")), lambda j: F.get(parts, F.pmod(F.xxhash64(F.col("id"), j), F.lit(len(PARTS))).cast("int")))
    camel = F.array_join(F.transform(pick, lambda w: F.initcap(w)), "")
    named = F.when(F.col("id") % 8 < 2, F.array_join(pick, "_")).when(F.col("id") % 8 < 4, camel).when(F.col("id") % 8 < 5, F.array_join(pick, "-")).when(F.col("id") % 8 < 6, F.array_join(pick, "/")).otherwise(F.array_join(pick, ""))
    ids = spark.range(n)
    return ids.where(f"id < {n // 2}").select(strings.alias("token"), F.lit(True).alias("random")).unionAll(ids.where(f"id >= {n // 2}").select(named, F.lit(False)))


def fit(samples: DataFrame, token: str = "token", random: str = "random") -> list[float]:
    """Log-likelihood ratios, random over ordinary, of the bigrams of ALPHABET, row by row; add-one
    smoothing. The table has the alphabet's size squared, whatever the samples."""
    grams = samples.where(F.col(token).isNotNull() & F.col(random).isNotNull()).select(F.col(random).alias("r"), F.explode(F.when(F.length(token) > 1, F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.substring(token, i, F.lit(2))))).alias("g"))
    place = {c: i for i, c in enumerate(ALPHABET)}
    n = len(ALPHABET)
    table = {True: [1.0] * (n * n), False: [1.0] * (n * n)}
    for r in grams.groupBy("r", "g").count().where(F.col("g").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).collect():
        table[r.r][place[r.g[0]] * n + place[r.g[1]]] += r["count"]
    out = []
    for i in range(n):
        random_sum, plain_sum = (sum(table[k][i * n : i * n + n]) for k in (True, False))
        out += [math.log(table[True][i * n + j] / random_sum) - math.log(table[False][i * n + j] / plain_sum) for j in range(n)]
    return out


def log_ratio(token: Column, weights: list[float]) -> Column:
    """Sum of the bigrams' ratios over a token of ALPHABET."""
    table, n = F.array(*map(F.lit, weights)), len(ALPHABET)
    at = lambda i: F.call_function("instr", F.lit(ALPHABET), F.substring(token, i, F.lit(1))) - 1
    return F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda acc, i: acc + F.coalesce(F.get(table, at(i) * n + at(i + 1)), F.lit(0.0)))


def scan(docs: DataFrame, weights: list[float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, found): arrays of (start, rank, stop, kind, hit, n), by start, then rank.

    base: the patterns' spans; found: those and the tokens that the models call random and that
    overlap none of them (kind random, rank 3). Positions are code points, stop is exclusive. A null
    text is empty; a row per row of docs.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), let(base_spans(body), lambda b: F.struct(b.alias("base"), _random(body, b, weights).alias("random"))).alias("x"))
    return rows.select("doc_id", F.col("x.base").alias("base"), F.array_sort(F.concat("x.base", "x.random")).alias("found"))


def _random(text: Column, base: Column, weights: list[float]) -> Column:
    tokens = spans_of(text, TOKEN, "random", 3)
    free = F.filter(tokens, lambda t: ~F.exists(base, lambda b: (b.start < t.stop) & (b.stop > t.start)))
    odd = lambda t: let(log_ratio(t.hit, weights), lambda x: (x >= MIN_RATIO) & (x >= MIN_MEAN * (F.length(t.hit) - 1)))
    return F.filter(free, odd)


def listed(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("bigint")

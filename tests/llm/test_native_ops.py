"""Line dedup, secrets and quality against brute-force versions."""

import math
import random
import re

from pyspark.sql import functions as F

from assaykit.llm import line_dedup, quality, secrets

SAMPLE = "/root/testdata/sf0.001/documents.parquet"


def brute_lines(docs, window=3, long_words=50):
    """docs: (doc_id, text) in order. Returns (text, removed, runs) each."""
    seen, out = set(), []
    for i, t in docs:
        if t is None:
            out.append((None, 0, 0))
            continue
        lines = t.split("\n")
        units = [(window, p) for p in range(len(lines) - window + 1) if "".join(lines[p : p + window]).strip(" ")]
        units += [(1, p) for p, x in enumerate(lines) if len(re.findall(r"[^ \t-\r]+", x)) >= long_words]
        dead = set()
        for n, p in units:
            key = (n, *lines[p : p + n])
            if key in seen:
                dead.update(range(p, p + n))
            seen.add(key)
        kept = "\n".join(x for p, x in enumerate(lines) if p not in dead) if dead else t
        out.append((kept, len(dead), sum(p - 1 not in dead for p in dead)))
    return out


def test_line_dedup(spark):
    rng = random.Random(2)
    pool = [f"line {i} {'x' * i}" for i in range(12)]
    docs = [(1, None), (2, ""), (3, "\n\n\n\n"), (4, "\n\n\n\n"), (5, "w " * 60), (6, "w " * 60), (7, "a\nb\nc\na\nb\nc\na\nb\nc")]
    docs += [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 25)))) for i in range(8, 60)]
    docs += [(r.doc_id + 100, r.text) for r in spark.read.parquet(SAMPLE).orderBy("doc_id").collect()]
    df = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, dead string").repartition(5)
    got = {r.doc_id: (r.text, r["__n_removed_lines"], r["__n_runs"]) for r in line_dedup.dedup_lines(df).collect()}
    assert got == dict(zip([i for i, _ in docs], brute_lines(docs)))
    twice = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc")], "doc_id long, text string")
    assert sorted(r.text for r in line_dedup.dedup_lines(twice).collect()) == ["", "", "a\nb\nc"]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def brute_spans(t):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    for k, (name, p, n) in enumerate((("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)), 1):
        out += [(m.start(), k, m.end(), name) for m in re.finditer(p, t) if len(m[0]) >= n]
    return sorted(out)


def test_secrets(spark):
    rng = random.Random(3)
    parts = ["password", "Token", "api_key", "APIKEY", "=", ":", " ", "  ", "\"", "'", "abcdef", "abc", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "ff", "é", "😀", "\n", "secret: token: abcdefg", "token=token=abcdefgh", "x.y-z_1"]
    docs = [None, "", "token=abcdef", "😀 token: 'Zz9+/==x'"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    docs += [r.text for r in spark.read.parquet(SAMPLE).collect()]
    odd = "key id " + "q7Zx9Kp2Lm4Vt8Rw3Ny6Jb1Hd5" + " and getUserSessionNameValueIndex plus https://www.example.com/index_of_the_pages"
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*docs, odd])], "doc_id long, text string, start int").repartition(3)
    weights = secrets.fit(secrets.labelled_samples(spark))
    rows = {r.doc_id: r for r in secrets.scan(df, weights).select("doc_id", secrets.listed(F.col("base")).alias("base"), secrets.listed(F.col("found")).alias("found")).collect()}
    for i, t in enumerate(docs):
        want = ",".join(f"{k}:{a}:{b}" for a, _, b, k in brute_spans(t or ""))
        assert rows[i].base == want, (t, rows[i].base, want)
        assert set(filter(None, want.split(","))) <= set(rows[i].found.split(","))
    assert rows[len(docs)].found == f"random:7:{7 + 26}"
    assert secrets.scan(df.limit(0), weights).count() == 0


def test_markov_models_tell_samples_apart(spark):
    samples = secrets.labelled_samples(spark, 2000)
    weights = secrets.fit(samples.where(F.pmod(F.xxhash64("token"), F.lit(2)) == 0))
    rest = samples.where((F.pmod(F.xxhash64("token"), F.lit(2)) == 1) & (F.length("token") >= 20))
    rows = rest.select("random", secrets.log_ratio(F.col("token"), weights).alias("x")).collect()
    assert sum((r.x > 0) == r.random for r in rows) >= 0.98 * len(rows)


def brute_counts(t):
    t = t or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, w in enumerate(tri) if tri.count(w) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_and_verdicts(spark):
    rng = random.Random(4)
    docs = [None, "", " \n\t", "a a a a", "a a a a a", "a b c a b c", "a b a b a b a", "x y z", "x\ny\nx\n\nx"]
    docs += [" ".join(rng.choice("abé#") for _ in range(rng.randint(1, 40))) for _ in range(80)]
    clean = "The quick one of many lines was read in the house, and it is as good as any other that we know. " * 1
    docs += [r.text for r in spark.read.parquet(SAMPLE).collect() if len(r.text) < 6000]
    docs += [" ".join(f"w{rng.randint(0, 9999)}{rng.choice('#*$')}##" for _ in range(80)), clean]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)], "doc_id long, text string, n_words int").repartition(3)
    rows = {r.doc_id: r for r in quality.judge(df).collect()}
    for i, t in enumerate(docs):
        r = rows[i]
        want = brute_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert not rows[len(docs) - 2].kept
    assert quality.judge(df.limit(0)).count() == 0


def test_posteriors_agree_with_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("quality", "label")
    rows = quality.judge(docs).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.label], [r.kept for r in rows if not r.label]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.5 * len(bad)


def test_estimation_recovers_planted_accuracies():
    rng = random.Random(6)
    patterns = {}
    for _ in range(20000):
        good = rng.random() < 0.7
        p = tuple(0 if rng.random() < 0.2 else (1 if good == (rng.random() < a) else -1) for a in (0.9, 0.8, 0.7, 0.95))
        patterns[p] = patterns.get(p, 0) + 1
    share, odds = quality.estimate(patterns, 300)
    assert abs(share - 0.7) < 0.04
    for (yes, no), a in zip(odds, (0.9, 0.8, 0.7, 0.95)):
        assert abs(yes - math.log(a / (1 - a))) < 0.35 and abs(no + math.log(a / (1 - a))) < 0.35

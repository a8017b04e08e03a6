"""Cases planted in the tables' own texts: secrets, joined hosts, edited notices."""

import random
import string

from pyspark.sql import functions as F

from assaykit.llm import licenses, secrets, url_filter

SF = "/root/testdata/sf0.001"


def test_random_tokens_in_texts_are_found(spark):
    rng = random.Random(12)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text) < 20_000]
    kinds = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-"]
    rows, want = [], []
    for i, t in enumerate(texts):
        rows.append((2 * i, t))
        token = "".join(rng.choice(kinds[i % 3]) for _ in range(rng.randint(24, 44))).strip("-_/+")
        at = t.find(" ", len(t) // 2)
        at = len(t) if at < 0 else at
        rows.append((2 * i + 1, f"{t[:at]} {token} {t[at:]}"))
        want.append((2 * i + 1, at + 1, at + 1 + len(token)))
    weights = secrets.fit(secrets.labelled_samples(spark))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = secrets.scan(df, weights).select("doc_id", F.filter("found", lambda s: s.kind == "random").alias("r")).collect()
    got = {(r.doc_id, s.start, s.stop) for r in found for s in r.r}
    hit = sum(w in got for w in want)
    false = [g for g in got if g not in want]
    assert hit >= 0.9 * len(want), (hit, len(want))
    assert len(false) <= 0.02 * len(texts), false[:5]


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randrange(9) for _ in range(n)]) for i, n in enumerate((0, 1, 63, 64, 65, 1000))]
    df = spark.createDataFrame(rows, "i int, a array<int>")
    for r in df.select("a", secrets.running(F.col("a")).alias("s")).collect():
        assert r.s == [sum(r.a[:k]) for k in range(len(r.a) + 1)]


def test_joined_hosts_of_held_out_pairs(spark):
    rng = random.Random(3)
    seen = {h for h, _, _ in url_filter.labelled_urls()}
    urls = []
    for bad, words in ((True, url_filter.BLOCKED), (False, url_filter.ALLOWED)):
        while sum(b == bad for _, b in urls) < 300:
            host = "".join(rng.sample(words, rng.randint(2, 3))) + ".net"
            if host not in seen:
                urls.append((f"http://{host}/", bad))
    # a third of all rows is one joined host, and unknown names stand among them
    rows = [u for u, _ in urls] + ["http://freecasinowin.net/"] * 600 + [f"http://{''.join(rng.choice('bcdfgklmnprst') for _ in range(9))}.net/x" for _ in range(600)]
    df = spark.createDataFrame(list(enumerate([*rows, None, ""])), "page_id long, url string").repartition(3)
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert len(got) == len(rows) + 2
    bad = [got[i].verdict for i, (_, b) in enumerate(urls) if b]
    good = [got[i].verdict for i, (_, b) in enumerate(urls) if not b]
    assert bad.count("block") >= 0.9 * len(bad) and good.count("allow") >= 0.9 * len(good)
    assert {(got[i].words, got[i].verdict) for i in range(len(urls), len(urls) + 600)} == {("free casino win", "block")}
    assert sum(got[i].verdict == "block" for i in range(len(urls) + 600, len(rows))) <= 30


def test_a_name_in_the_path_is_split_too(spark):
    urls = ["http://a.org.uk/freecasinowin/", "http://b.net/weathermap/", "http://c.net/" + "casinowin" * 400, "http://d.net/ünïcödé/x"] * 3
    rows = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    assert rows[0].words.endswith("free casino win") and rows[1].words.endswith("weather map")
    assert rows[2].words.split().count("casino") == 400 and rows[2].verdict == "block"
    assert rows[0].words == rows[4].words


def common_words(a, b):
    """Length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_edited_notices_and_brute_force(spark):
    rng = random.Random(4)
    every = [(name, licenses.words_of(t.encode())) for name, texts in licenses.TEMPLATES.items() for t in texts]
    filler = licenses.words_of(b"some words that say nothing at all of the software and its license or the version of it")
    rows, want = [], {}
    for i, (name, words) in enumerate(every):
        if len(words) < 12:
            continue
        out = list(words)
        for _ in range(len(words) // 20):
            out[rng.randrange(len(out))] = b"edited"
        before = [rng.choice(filler) for _ in range(40)]
        rows.append((i, b" ".join(before + out + before).decode()))
        want[i] = name
    rows += [(1000 + j, " ".join(rng.choice(rng.choice(every)[1]).decode() for _ in range(60))) for j in range(60)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, name in want.items():
        assert got[i].license == name, (name, got[i])
    for j, text in rows[len(want) :]:
        words = licenses.words_of(text.encode())
        able = {n for n, t in every if common_words(words, t) >= licenses.COVERAGE * len(t)}
        assert got[j].license is None or got[j].license in able
        if not able:
            assert got[j].license is None
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0

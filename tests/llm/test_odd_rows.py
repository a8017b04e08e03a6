"""Nulls, empty and very long texts, repeated rows, ties, empty tables and clashing names, by operator."""

from collections import Counter
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.llm import decontaminate, language_id, licenses, line_dedup, mixing, quality, secrets, simhash, suffix_dedup, url_filter
from tests.llm.test_native_ops import brute_lines, brute_spans
from tests.llm.test_simhash import fingerprint

ITEM = "the one long sentence of the benchmark that nobody else would ever write"
NOTICE = licenses.TEMPLATES["MIT"][1]
LONG = "\n".join(" ".join(f"word{(i * 31 + j) % 5003}" for j in range(60)) for i in range(2500))
LONG += f"\n{ITEM}\n{NOTICE}\ntoken = 'abcdefgh12345678'\n" + "\n".join(f"end {i % 40}" for i in range(200))
SHORT = "A short line of words that is here\nand another one of them\n" * 3
ROWS = [(1, LONG), (1, LONG), (2, SHORT), (2, SHORT), (3, None), (4, ""), (5, " \n\t "), (None, SHORT), (None, None), (6, "é😀 token: abcdefg")]


@pytest.fixture(scope="module")
def docs(spark):
    names = "base found n_words quality kept fp component_id rate license coverage lid_x row n text2".split()
    rows = [(i, t, *("x" for _ in names)) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)).repartition(3)


def count(t):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    hit = {j for i, g in enumerate(grams) if seen[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(hit)


def test_line_dedup(docs):
    got = line_dedup.dedup_lines(docs.select("doc_id", "text", "n", "row", F.col("found").alias("__dead"))).collect()
    order = sorted({(i is not None, i or 0, t or "", i, t) for i, t in ROWS}, key=lambda x: x[:3])
    want = {(i, t): w for (*_, i, t), w in zip(order, brute_lines([(i, t) for *_, i, t in order]))}
    assert len(got) == len(ROWS)
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, None if t is None else want[i, t][0]) for i, t in ROWS)


def test_secrets(spark, docs):
    got = secrets.scan(docs, secrets.fit(secrets.labelled_samples(spark))).select("doc_id", secrets.listed(F.col("base")).alias("base")).collect()
    want = Counter((i, ",".join(f"{k}:{a}:{b}" for a, _, b, k in brute_spans(t or ""))) for i, t in ROWS)
    assert Counter((r.doc_id, r.base) for r in got) == want


def test_decontaminate(spark, docs):
    items = spark.createDataFrame([(7, ITEM), (7, ITEM), (None, ITEM), (8, None)], "item_id int, text string")
    got = Counter((r.doc_id, r.item_id, r.start) for r in decontaminate.find_leaks(docs, items).collect())
    assert got == Counter({(1, 7, LONG.index(ITEM)): 4, (1, None, LONG.index(ITEM)): 2})
    assert Counter(r.doc_id for r in decontaminate.drop_leaked(docs, items).collect()) == Counter(i for i, t in ROWS if t != LONG)


def test_url_filter(spark):
    urls = ["http://casino.net/" + "win" * 20_000, None, "", "http://", "x", "http://a.org/b", "http://a.org/b"]
    df = spark.createDataFrame([(None if i == 4 else i % 5, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, words string, rule string")
    rows = url_filter.judge(df).collect()
    assert len(rows) == len(urls) and sum(r.page_id is None for r in rows) == 1
    assert [r.verdict for r in rows if r.host == "casino.net"] == ["block"]
    assert len({(r.verdict, r.score, r.words) for r in rows if r.host == "a.org"}) == 1


def test_licenses(docs):
    rows = licenses.scan(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ROWS)
    assert {(r.license, r.last_word - r.first_word + 1) for r in rows if r.doc_id == 1} == {("MIT", len(licenses.words_of(NOTICE.encode())))}
    assert all(r.license is None and r.coverage == 0 for r in rows if r.doc_id != 1)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_mixing(spark, docs):
    labels = spark.createDataFrame([(1, "good"), (2, "plain"), (2, "toxic"), (None, "good"), (4, None), (5, "other")], "doc_id long, domain string")
    rows = mixing.mix(docs, labels, keep=docs.columns).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ROWS)
    assert all(r.rate == "x" and r["rate_"] >= 0 and abs(r.posterior_good + r.posterior_plain + r.posterior_toxic - 1) < 1e-9 for r in rows)
    assert len({(r["rate_"], r.posterior_good) for r in rows if r.text == LONG}) == 1
    assert all(r.n_tokens == 0 for r in rows if not (r.text or "").strip())


def test_simhash(docs):
    rows = simhash.near_duplicates(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert {k: len(v) for k, v in by.items()} == dict(Counter(i for i, _ in ROWS))
    assert all(r.fp % (1 << 64) == fingerprint(LONG) and r.component_id == 1 for r in by[1])
    assert all(r.component_id == 3 for i in (3, 4, 5) for r in by[i])  # no word at all: one fingerprint
    assert {r.component_id for r in by[None]} == {2, 3}


def test_quality(docs):
    rows = quality.judge(docs).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == Counter((i, *count(t)) for i, t in ROWS)
    assert all(r.base_failed and not r.kept for r in rows if not r.n_words)


def test_ties_between_languages(spark):
    # two languages that learn from the same texts can't be told apart: the first by name is predicted
    train = [(i, "der hund und die katze", k) for i, k in enumerate(("xx", "aa") * 40)]
    df = spark.createDataFrame([*train, (500, "der hund", None)], "doc_id long, text string, lang string")
    rows = language_id.identify(df.repartition(3)).collect()
    learned = Counter(r.lang for r in rows if not r.lid_held_out and r.lang)
    told = {r.lid_pred for r in rows if r.doc_id == 500}
    assert told <= {"aa", "xx"} and (learned["aa"] != learned["xx"] or told == {"aa"})


def test_pieces_of_a_long_text_have_the_same_windows(monkeypatch):
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 101, 5000).astype(np.uint8).tobytes()

    def windows():
        out = {}
        for starts, ns, anchors, hashes in suffix_dedup._spans(raw, 100, 16, {}):
            for s, n, a, h in zip(starts.tolist(), ns.tolist(), anchors.tolist(), hashes.tolist()):
                out.update({w: (s + a, h) for w in range(s, s + n)})
        return out

    whole = windows()
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    assert windows() == whole and len(whole) == 5000 - 99


def test_large_groups_are_split_without_loss(spark):
    rng = np.random.default_rng(4)
    words = ["".join(map(chr, rng.integers(97, 103, rng.integers(1, 7)))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words, n))
    shared = text(90)
    docs = [f"{text(30)} {shared} {text(30)}" for _ in range(40)]
    near = text(200).split()
    docs += [" ".join([*near[:k], "changed", *near[k + 1 :]]) for k in rng.integers(0, 200, 40)] + docs[:3] + [text(300) for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    some = lambda group: {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(df, group=group).drop("kept").collect()}
    one, many = some(10_000), some(2)
    assert one == many and sum(r[1] > 0 for r in one.values()) >= 80


def test_passages_by_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words, n))
    p, q = text(55), text(49)
    docs = [f"{text(20)} {p} {text(9)}", f"{p}\n{text(30)}", f"{q} {text(5)}", f"{text(5)} {q}", " ".join(["a"] * 80), None, "", p, p]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    seen = Counter(tuple(w[i : i + 51]) for t in docs for w in [(t or "").split()] for i in range(len(w) - 50))
    for r in suffix_dedup.remove_repeats(df).collect():
        w = (docs[r.doc_id] or "").split()
        hit = {j for i in range(len(w) - 50) if seen[tuple(w[i : i + 51])] > 1 for j in range(i, i + 51)}
        assert (r.n_passage_words, r.n_passages) == (len(hit), sum(j - 1 not in hit for j in hit)), r.doc_id

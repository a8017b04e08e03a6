import hashlib
import random
from collections import Counter

import pytest

from assaykit.llm import suffix_dedup


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        hit = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                hit[i : i + length] = [True] * length
        kept = bytes(b for b, h in zip(r, hit) if not h)
        spans = sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit))
        out.append((len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = text(60)
    docs = [None, "", "short", "a" * 900, "a" * 500 + "b" + "a" * 450, "xyz" * 200, text(100)]
    docs += [docs[-1], docs[-1]]
    docs += [text(20) + shared + text(20) for _ in range(6)]
    docs += [shared[:200] + "#" + shared[200:], shared + text(3) + shared]
    near = text(300)
    docs += [near[:i] + "!" + near[i + 1 :] for i in rng.sample(range(len(near)), 20)]
    return docs + [text(200) for _ in range(10)]


@pytest.mark.parametrize("length,k", [(400, 64), (100, 16), (50, 8)])
def test_against_brute_force(spark, length, k):
    docs = corpus()
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(docs)], "doc_id long, text string, start int, mh string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, length=length, k=k).collect()}
    assert got == dict(enumerate(brute(docs, length)))


def test_empty_table_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(none).count() == 0
    twice = spark.createDataFrame([(1, "ab cd " * 100), (1, "ab cd " * 100), (None, "q" * 10)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup.remove_repeats(twice).collect())
    assert got == [(0, 0), (1, 600), (1, 600)]
